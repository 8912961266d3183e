"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from corpusloom.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(word, shortest=24, repeats=3):
    """Every period in turn; a stretch counts if no smaller period holds on it."""
    n, found = len(word), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and word[i] == word[i + q]:
                i += 1
            e = i + q
            if e - s >= max(shortest, repeats * q) and not any(
                    all(word[k] == word[k + p] for k in range(s, e - p)) for p in range(1, q)):
                found.add((s, e - s, q))
    return sorted(found)


def plant(doc_id, words):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = plant(doc_id, (text or "").encode().split())
    got = brute(words)
    gone = {k for s, n, q in got for k in range(s + q, s + n)}
    best = None
    for r in got:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    milli = (1000 * best[1] // best[2],) if best else (None,)
    return (doc_id, len(got), *(best or (None, None, None)), *milli,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in got).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 14), st.integers(0, 4)), max_size=5))
def test_runs_are_those_of_brute_force(parts):
    word = []
    for block, times, cut in parts:
        word += block * times + block[:cut]
    assert periodic_runs.runs(word) == brute(word)


def test_small_alphabets():
    rng = random.Random(3)
    for _ in range(300):
        word = [rng.randint(0, rng.randint(0, 2)) for _ in range(rng.randint(0, 130))]
        assert periodic_runs.runs(word) == brute(word)


def test_borders():
    assert periodic_runs.runs([0] * 23) == []
    assert periodic_runs.runs([0] * 24) == [(0, 24, 1)]
    assert periodic_runs.runs([*range(9)] * 3) == [(0, 27, 9)]
    assert periodic_runs.runs([*range(9)] * 2 + [*range(8)]) == []
    assert periodic_runs.runs([*range(100)] * 3 + [7]) == [(0, 300, 100)]
    assert periodic_runs.runs([0] * 100_000) == [(0, 100_000, 1)]


def rows(df):
    return sorted((tuple(r) for r in df.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=repr)


def test_query_on_tricky_rows(spark, tricky, no_docs):
    small = tricky.where("text is null or length(text) < 10000")
    got = rows(periodic_runs.digest(periodic_runs.planted(small)))
    assert got == sorted((expected(r.doc_id, r.text) for r in small.collect()), key=repr)
    assert periodic_runs.digest(periodic_runs.planted(no_docs)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) <= 700}
    got = [r for r in rows(queries.QUERIES["op13_factor_runs"](spark, SF)) if r[0] in short]
    assert got == sorted((expected(d, t) for d, t in short.items()), key=repr)
    assert any(r[1] for r in got) and any(not r[1] for r in got)


def test_texts_collapse(spark, table_of):
    text = "start " + "one two three " * 10 + "end"
    row = periodic_runs.find(table_of([(1, text), (2, None)])).orderBy("doc_id").collect()
    assert row[0].collapsed == "start one two three end"
    assert [tuple(r) for r in row[0].runs] == [(1, 30, 3)]
    assert row[1].collapsed == "" and row[1].runs == []


@pytest.mark.parametrize("size", [30_000])
def test_long_text(spark, table_of, size):
    words = [f"w{i}" for i in range(size // 3)] * 3
    row = periodic_runs.find(table_of([(1, " ".join(words))])).first()
    assert [tuple(r) for r in row.runs] == [(0, len(words), size // 3)]
