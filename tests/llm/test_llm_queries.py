"""The registered queries against their SQL, and the pipeline against a plain version of its stages."""

import os
import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from corpusloom.llm import decontaminate, line_crf, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df)
    if name not in queries.SQL:
        table = "pages" if name.startswith("op1_") else "documents"
        assert len(got) >= con.execute(f"select count(*) from {table}").fetchall()[0][0]
        return
    cur = con.execute(queries.SQL[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == sorted(df.columns)
    assert got == sorted((tuple(r[at[c]] for c in sorted(at)) for r in cur.fetchall()), key=repr)


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


def test_pipeline(spark):
    """Each stage's decision by plain Python on what the stage before kept."""
    from test_llm_dedup import WHITE, first_of_group
    from test_llm_text import contamination

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    score = {r.doc_id: r.score for r in line_crf.quality(docs, labels).collect()}
    kept = {d: t for d, t in kept.items() if score[d] >= 0.5}
    best = {}
    for d, t in kept.items():
        key = WHITE.sub("", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
    kept = {d: kept[d] for _, d in best.values()}
    kept = {d: kept[d] for d in set(first_of_group(kept).values())}
    bad = {d for (d, *_, b) in contamination(kept.items(), [(r.item_id, r.text) for r in bench.collect()]) if b}
    kept = {d: t for d, t in kept.items() if d not in bad}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(kept)
    total = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(total.values())
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "pack"]


def test_stages_return_the_columns_of_documents(spark, tricky):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, tricky, SF)
        assert out.columns == tricky.columns and out.count() <= tricky.count()


def test_stages_keep_columns_of_any_name(spark, tricky):
    odd = tricky.withColumnsRenamed({"fp": "__row", "shard": "__sha", "score": "__score", "lang": "doc", "n_words": "__scan", "kept": "__again"})
    for (name, stage) in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        assert {r["__score"] for r in out.collect()} <= {"s"}


def test_decontamination_finds_items(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    copies = bench.selectExpr("item_id as doc_id", "concat('before ', text, ' after') as text")
    assert decontaminate.clean(copies, bench).count() == 0
