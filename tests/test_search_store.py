"""The search store: batches, snapshots, crashes between any two steps, compaction."""

import os
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import index, retrieve, search_store, versions
from corpusloom.operators.chunk import docs_to_chunks
from corpusloom.schemas import DOC

WORDS = "salt pressure blood trial diet sleep sugar heart fibre water".split()


def docs_of(spark, texts, source="pubmed"):
    rows = [(d, source, f"title {d}", t, 2000 + len(d) % 7, "u", ["a"], "other", "", "", {}) for d, t in texts.items()]
    return spark.createDataFrame(rows, DOC)


def text(rng, n=80):
    return ". ".join(" ".join(rng.choice(WORDS) for _ in range(8)) + f" n{rng.randrange(30)}" for _ in range(n))


def questions(spark):
    return spark.createDataFrame([("1", "salt n3 n7"), ("2", "blood pressure n12"), ("3", "nothing of that")], "question_id string, query string")


def search(spark, chunks, vectors, keyword_index):
    q = questions(spark)
    kw = retrieve.bm25_index_hits(keyword_index, q, 6).select("question_id", "chunk_id", "bm25", "kw_rank")
    vec = retrieve.vector_text_hits(chunks, q, 6, vectors=vectors).select("question_id", "chunk_id", "distance", "vec_rank")
    return sorted(map(tuple, kw.collect())), sorted(map(tuple, vec.collect()))


def check(spark, path, state):
    """Chunks, document frequencies and search equal those of a build from ``state``."""
    now = search_store.snapshot(spark, path)
    want = index.storable(docs_to_chunks(docs_of(spark, state), merge_below=rules.CHUNK_MIN_CHARS))
    assert sorted(map(str, now.chunks.collect())) == sorted(map(str, want.collect()))
    full = index.build_keyword_index(want)
    assert sorted(map(tuple, now.keyword_index.vocabulary.collect())) == sorted(map(tuple, full.vocabulary.collect()))
    assert sorted(map(str, now.keyword_index.postings.select("chunk_id", "dl", "term", "tf").collect())) == sorted(
        map(str, full.postings.collect()))
    assert search(spark, now.chunks, now.vectors, now.keyword_index) == search(spark, want, None, full)


def apply(spark, path, texts, removed=(), **options):
    gone = spark.createDataFrame([(d,) for d in removed], "doc_id string") if removed else None
    return search_store.apply_documents(spark, path, docs_of(spark, texts), gone, buckets=4, term_buckets=8, **options)


def test_search_follows_batches_and_compaction(spark, tmp_path):
    rng, path, state = random.Random(1), str(tmp_path / "s"), {}
    assert search_store.snapshot(spark, path).chunks.count() == 0
    batches = [({f"d#c{i}": text(rng) for i in range(60)}, []), ({"d#c3": text(rng, 3), "d#c4": "", "new": text(rng)}, ["d#c7", "never"]),
               ({"d#c7": text(rng), "d#c3": text(rng, 40)}, ["new"]), ({}, ["d#c0"])]
    for n, (texts, removed) in enumerate(batches):
        assert apply(spark, path, texts, removed) == n + 1
        state = {d: t for d, t in state.items() if d not in removed} | texts
        if n in (1, 3):
            check(spark, path, state)
    before = search_store.snapshot(spark, path)
    assert len(before.body["segments"]) == 4
    big, small = before.body["segments"][0], before.body["segments"][1:]
    assert search_store.compactable([big, *small], ratio=0.01) == 4 - 1
    search_store.compact(spark, path, ratio=10)
    part = search_store.snapshot(spark, path)
    assert 1 <= len(part.body["segments"]) < 4
    check(spark, path, state)
    search_store.compact(spark, path, ratio=1000)
    assert len(search_store.snapshot(spark, path).body["segments"]) == 1
    check(spark, path, state)
    # A reader of the old version is not disturbed, until it is removed.
    assert before.chunks.count() > 0
    gone = versions.vacuum(spark, path, keep=1, grace_hours=0)
    assert set(gone) >= {s["folder"] for s in before.body["segments"]}
    check(spark, path, state)


def test_a_batch_is_applied_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert apply(spark, path, {"a": "salt"}, batch=("stream", 0)) == 1
    assert apply(spark, path, {"a": "other"}, batch=("stream", 0)) == 1
    assert apply(spark, path, {"a": "third"}, batch=("stream", 1)) == 2
    assert [r.text for r in search_store.snapshot(spark, path).chunks.collect()] == ["third"]
    assert [r.text for r in search_store.snapshot(spark, path, 1).chunks.collect()] == ["salt"]


class Crash(RuntimeError):
    pass


@pytest.mark.parametrize("job", ["apply", "compact", "replace"])
def test_a_crash_between_any_two_steps_leaves_the_version_before(spark, tmp_path, monkeypatch, job):
    rng, path = random.Random(2), str(tmp_path / "s")
    state = {f"d{i}": text(rng, 6) for i in range(5)}
    apply(spark, path, state)
    if job == "compact":
        apply(spark, path, {"d1": text(rng, 2)})
    new = {"d2": text(rng, 4), "e": text(rng, 3)}
    put, publish = versions.put, versions.publish

    def run():
        if job == "apply":
            return apply(spark, path, new, ["d4"])
        if job == "compact":
            return search_store.compact(spark, path, ratio=100)
        return search_store.replace_chunks(spark, path, docs_to_chunks(docs_of(spark, new)), buckets=4, term_buckets=8)

    before = search_store.snapshot(spark, path)
    rows = sorted(map(str, before.chunks.collect()))
    crashes = 0
    while True:
        left = [crashes]

        def step(real):
            def run_or_crash(*args, **more):
                if not left[0]:
                    raise Crash
                left[0] -= 1
                return real(*args, **more)
            return run_or_crash

        monkeypatch.setattr(versions, "put", step(put))
        monkeypatch.setattr(versions, "publish", step(publish))
        try:
            version = run()
            break
        except Crash:
            crashes += 1
            assert search_store.snapshot(spark, path).version == before.version
    assert crashes == 7 and version == before.version + 1
    assert sorted(map(str, before.chunks.collect())) == rows
    if job == "compact":
        assert sorted(map(str, search_store.snapshot(spark, path).chunks.collect())) == rows
    else:
        left = {d for d in [*state, "e"] if d != "d4"} if job == "apply" else set(new)
        assert {r.doc_id for r in search_store.snapshot(spark, path).chunks.collect()} == left


def test_an_unfinished_manifest_is_passed_over(spark, tmp_path):
    path = str(tmp_path / "s")
    apply(spark, path, {"a": "salt"})
    with open(f"{path}/versions/{2:012d}.json", "w") as f:
        f.write('{"segments": [')
    assert search_store.snapshot(spark, path).version == 1
    assert apply(spark, path, {"b": "sugar"}) == 3
    assert search_store.snapshot(spark, path).chunks.count() == 2


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    apply(spark, path, {"a": "salt"})
    body = search_store.snapshot(spark, path).body
    apply(spark, path, {"b": "sugar"})
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, body, 1)
    assert search_store.snapshot(spark, path).chunks.count() == 2


def test_untouched_files_are_not_read(spark, tmp_path):
    """Applying a batch needs neither texts of the corpus nor the forward rows of other buckets."""
    rng, path = random.Random(3), str(tmp_path / "s")
    state = {f"d{i}": text(rng, 4) for i in range(20)}
    apply(spark, path, state)
    mine = spark.range(1).select(search_store.bucket_of(F.lit("d5"), 4)).first()[0]
    folder = f"{path}/{search_store.snapshot(spark, path).body['segments'][0]['folder']}"
    aside = str(tmp_path / "aside")
    shutil.copytree(folder, aside)
    for top, _, names in os.walk(folder):
        keep = top.endswith(f"forward/bucket={mine}")
        for n in names:
            if n.endswith(".parquet") and not keep:
                with open(f"{top}/{n}", "w") as f:
                    f.write("not to be read")
                if os.path.exists(f"{top}/.{n}.crc"):
                    os.unlink(f"{top}/.{n}.crc")
    new = text(rng, 2)
    apply(spark, path, {"d5": new})
    shutil.copytree(aside, folder, dirs_exist_ok=True)
    check(spark, path, state | {"d5": new})


def scanned_files(df):
    """Files that the scans of an executed plan have opened."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if "AdaptiveSparkPlan" in p.nodeName():
            return walk(p.executedPlan())
        metric = p.metrics().get("numFiles")
        if metric.isDefined():
            found.append(metric.get().value())
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(found)


def test_filters_drop_files(spark, tmp_path):
    path = str(tmp_path / "s")
    both = docs_of(spark, {f"p{i}": "salt" for i in range(30)}).unionByName(docs_of(spark, {f"w{i}": "sugar" for i in range(30)}, "wiki"))
    both = both.unionByName(docs_of(spark, {"blank": "x"}, ""))
    search_store.apply_documents(spark, path, both, buckets=4, term_buckets=8)
    now = search_store.snapshot(spark, path)
    every, wiki = scanned_files(now.vectors), scanned_files(now.vectors_of("wiki"))
    assert 0 < wiki < every
    assert {r.doc_id for r in now.vectors_of("wiki").collect()} == {f"w{i}" for i in range(30)}
    assert [r.doc_id for r in now.vectors_of("").collect()] == ["blank"]
    assert {r.year for r in now.vectors_of(year_from=2003, year_to=2003).collect()} == {2003}
    assert "GreaterThanOrEqual(year,2003)" in now.vectors_of("wiki", 2003)._jdf.queryExecution().executedPlan().toString()


def counting(spark):
    """An accumulator and a step that adds the rows that go through it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return seen, lambda rows: rows.mapInArrow(count, rows.schema)


def test_a_batch_is_cut_embedded_and_counted_once(spark, tmp_path):
    rng = random.Random(4)
    chunks = index.storable(docs_to_chunks(docs_of(spark, {f"d{i}": text(rng, 20) for i in range(40)}))).localCheckpoint()
    embedded, seen, through = spark.sparkContext.accumulator(0), *counting(spark)

    def embed(column):
        @F.arrow_udf("array<double>")
        def one(t: pa.Array) -> pa.Array:
            embedded.add(len(t))
            return pa.array([[1.0, float(len(s.as_py()))] for s in t], pa.list_(pa.float64()))
        return one(column)

    search_store.apply_chunks(spark, str(tmp_path / "s"), through(chunks), chunks.select("doc_id").distinct(), embed=embed)
    n = chunks.count()
    assert seen.value == n and embedded.value == n


def test_index_computes_its_postings_once_and_keeps_terms_in_order(spark, tmp_path):
    words = spark.range(3000).selectExpr("concat('c', id) chunk_id", "concat('common w', id % 700) text")
    built = index.build_keyword_index(words)
    seen, through = counting(spark)
    index.KeywordIndex(through(built.postings), built.vocabulary).write(str(tmp_path / "i"), term_buckets=4)
    assert seen.value == built.postings.count() == 6000
    for path in (tmp_path / "i" / "postings").rglob("*.parquet"):
        terms = [r.term for r in spark.read.parquet(str(path)).collect()]
        assert terms == sorted(terms)


def test_snapshot_search_reads_counted_terms_and_no_texts(spark, tmp_path, monkeypatch):
    rng, path = random.Random(6), str(tmp_path / "s")
    apply(spark, path, {f"d{i}": text(rng, 20) for i in range(30)})
    apply(spark, path, {"d3": text(rng, 30), "d4": ""})
    now, asked = search_store.snapshot(spark, path), questions(spark)
    monkeypatch.setattr(retrieve, "SELECTIVE", 0.0)
    want = sorted(map(tuple, retrieve.bm25_hits(now.chunks, asked, 6).collect()))
    hits = retrieve.keyword_hits(now.chunks, now.keyword_index, asked, 6)
    assert sorted(map(tuple, hits.collect())) == want
    plan = hits._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan
