"""Pruned search against the plain one, and how much it skips."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import common, index, pruned, retrieve, verify
from corpusloom.operators.common import stored


def texts(rng, n):
    """Documents about some topics; a few rare words, and common ones everywhere."""
    rows = []
    for i in range(n):
        topic = rng.randrange(12)
        words = [f"t{topic}w{rng.randrange(15)}" for _ in range(rng.randint(1, 40))] + ["the"] * rng.randint(0, 3) + [f"rare{rng.randrange(n)}"]
        rows.append((f"d{topic:02d}{i:05d}#c0", " ".join(words)))
    return rows


def asked(rng, n):
    return [(f"q{i}", " ".join(f"t{rng.randrange(12)}w{rng.randrange(15)}" for _ in range(rng.randint(1, 3))) + rng.choice(["", " the", " rare7 the"]))
            for i in range(n)]


def pairs(spark):
    return spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)


@pytest.mark.parametrize("n,size,k", [(0, 8, 3), (5, 8, 3), (900, 16, 5), (3000, 32, 4)])
def test_keyword_blocks(spark, n, size, k):
    rng = random.Random(n)
    chunks = stored(spark.createDataFrame(texts(rng, n), "chunk_id string, text string").orderBy("chunk_id"))
    questions = spark.createDataFrame([*asked(rng, 60), ("none", "zzz"), ("empty", "")], "question_id string, query string")
    forward = stored(index.forward_index(chunks))
    blocks = stored(pruned.keyword_blocks(forward, size))
    counts = pairs(spark)
    got = pruned.block_keyword_hits(blocks, stored(index.vocabulary_of(forward)), questions, k, counts)
    want = retrieve.bm25_hits(chunks, questions, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    if n == 3000:
        assert counts[0].value < 0.4 * counts[1].value


def test_fewer_rows_are_shuffled_than_k_for_each_task(spark):
    rng, k = random.Random(5), 10
    chunks = stored(spark.createDataFrame(texts(rng, 4000), "chunk_id string, text string").repartitionByRange(8, "chunk_id"))
    questions = spark.createDataFrame(asked(rng, 40), "question_id string, query string")
    forward = stored(index.forward_index(chunks))
    blocks = stored(pruned.keyword_blocks(forward, 32))
    stats = index.corpus_stats(index.vocabulary_of(forward))
    weighted = retrieve.weigh(retrieve.query_terms(questions), index.term_weights(index.vocabulary_of(forward), stats))
    sent = pruned._search(blocks, pruned._KeywordBlocks(weighted, stats.avgdl), k, "bm25", -1.0, True, None).count()
    assert blocks.rdd.getNumPartitions() > 1
    assert sent < blocks.rdd.getNumPartitions() * 40 * k / 2


@pytest.mark.parametrize("n,width,k", [(0, 4, 2), (3, 4, 5), (2500, 24, 6)])
def test_vector_cells(spark, n, width, k):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(15, width))
    rows = [(f"v{i:05d}", (centres[i % 15] + 0.15 * rng.normal(size=width)).tolist()) for i in range(n)]
    rows += [("null", None)] + ([("zero", [0.0] * width), ("copy1", rows[0][1]), ("copy2", rows[0][1])] if n else [])
    corpus = spark.createDataFrame(rows, "chunk_id string, vector array<double>")
    questions = spark.createDataFrame([(f"q{i}", (centres[i] + 0.1 * rng.normal(size=width)).tolist()) for i in range(15)]
                                      + [("none", None)] + [("far", rng.normal(size=width).tolist())], "question_id string, vector array<double>")
    blocks = stored(pruned.vector_blocks(corpus, cells=32, size=64))
    counts = pairs(spark)
    got = pruned.block_vector_hits(blocks, questions, k, counts=counts)
    want = retrieve.vector_hits(corpus, questions, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    if n == 2500:
        assert counts[0].value < 0.4 * counts[1].value
        # Blocks of questions give the same.
        parts = pruned.block_vector_hits(blocks, questions, k, block=6)
        assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, want.collect()))


def test_filter_before_a_join(spark):
    big = spark.range(20_000).withColumn("x", F.concat(F.lit("k"), F.col("id")))
    keys = stored(spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 7).alias("x")).unionByName(spark.range(1).select(F.lit(None).cast("string").alias("x"))))
    marked = common.mark_maybe(big, keys, ["x"])
    assert marked.where("_maybe and id % 7 = 0 and id < 2100").count() == 300
    assert marked.where("_maybe").count() < 300 + 0.03 * 20_000
    assert common.mark_maybe(big, keys.limit(0), ["x"]).where("_maybe").count() == 0
    for rows in (10, 1000):
        assert common.join_rare(big, keys, ["x"], rows).count() == 300
    plan = common.mark_maybe(big, keys, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and plan.count("strategy=broadcast") == 2


def test_an_identifier_asked_often(spark, monkeypatch):
    catalog = spark.createDataFrame([("pmid:1", "One", 2000, "", "", "", {}), ("pmid:2", "Retracted two", 2001, "", "", "", {})],
                                    "doc_id string, title string, year int, journal string, url string, doi string, extra map<string,string>")
    ids = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "3").otherwise("1").alias("identifier"))
    for rows in (200_000, 0):
        monkeypatch.setattr(verify, "fits", lambda df, rows=rows: df.limit(rows + 1).count() <= rows)
        got = dict(verify.verify_identifiers(ids, catalog).groupBy("note").count().collect())
        assert got == {"ok": 4500, "not_found": 500}
    assert math.isclose(retrieve.rounded_array(np.array([0.1234565]))[0], 0.123457)


def test_blocks_are_stored_in_small_row_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "term_bucket", lambda term, buckets: F.lit(0))
    forward = stored(index.forward_index(spark.range(600).selectExpr("concat('c', id) chunk_id", "concat('word', id % 7, ' common') text").coalesce(1)))
    built = index.KeywordIndex(index.postings_of(forward), index.vocabulary_of(forward), blocks=pruned.keyword_blocks(forward, 4))
    built.write(str(tmp_path))
    plain = stored(pruned.keyword_blocks(forward, 4), str(tmp_path / "own"), wide=True).inputFiles()
    for files in (list((tmp_path / "blocks").glob("*.parquet")), [f.removeprefix("file://") for f in plain]):
        groups = [pq.ParquetFile(f).metadata.row_group(g).num_rows for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
        assert sum(groups) == 150 and max(groups) <= 32
