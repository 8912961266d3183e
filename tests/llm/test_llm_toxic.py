"""Toxicity by nearest examples: exact search against brute force, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import nearest_toxic as tox
from corpusloom.llm import queries

SF = "/root/testdata/sf0.1"


def random_examples(rng, n, terms):
    out = []
    for i in range(n):
        topic = rng.randrange(terms)
        ids = sorted({(topic + rng.randrange(6)) % terms for _ in range(rng.randint(1, 9))})
        w = np.array([rng.random() + 0.1 for _ in ids])
        out.append((rng.randrange(10_000) * 1000 + i, rng.randint(0, 1), np.array(ids), w / np.sqrt(w @ w)))
    return out


@pytest.mark.parametrize("n,terms", [(0, 5), (1, 3), (40, 4), (700, 60), (2500, 300)])
def test_search_is_exact(n, terms):
    rng = random.Random(n)
    examples = random_examples(rng, n, terms)
    index = tox.BlockMaxIndex.build(examples, terms)
    dense = {d: np.zeros(terms) for d, *_ in examples}
    for d, _, ids, w in examples:
        dense[d][ids] = w
    visited = 0
    for _, _, ids, w in random_examples(rng, 60, terms):
        q = np.zeros(terms)
        q[ids] = w
        every = sorted((-round(float(v @ q), 9), d) for d, v in dense.items())
        want = [(d, -s) for s, d in every if s < 0][:7]
        places, cosines, seen = index.search(ids, w, 7)
        assert [d for d, _ in want] == index.doc_id[places].tolist()
        assert np.allclose([s for _, s in want], cosines, atol=2e-9)
        visited += seen
    if n >= 700:
        assert visited < 0.5 * 60 * len(index.blocks)


def test_the_example_itself_can_be_left_out():
    examples = random_examples(random.Random(1), 200, 20)
    index = tox.BlockMaxIndex.build(examples, 20)
    for i, d in enumerate(index.doc_id.tolist()):
        ids, w = next((ids, w) for e, _, ids, w in examples if e == d)
        assert i not in index.search(ids, w, 5, without=i)[0].tolist()


def test_isotonic_pools():
    x, y = tox.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert x.tolist() == [0.1, 0.1, 0.2, 0.3, 0.4, 0.4] and y.tolist() == [0, 0, 0.5, 0.5, 1, 1]


@pytest.fixture(scope="module")
def scored(spark):
    return queries.QUERIES["op12_nearest_toxic"](spark, SF).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (scored.held_out == scored.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    both = scored.merge(labels, on="doc_id")
    held = both[both.held_out]
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert len(toxic) > 50
    assert toxic.predicted.mean() >= 0.75 and clean.predicted.mean() <= 0.02
    calibration = held.groupby(held.score > 0.5).agg(score=("score", "mean"), toxic=("toxic", "mean"))
    assert (calibration.score - calibration.toxic).abs().max() < 0.1


def test_evidence_is_learned_rows_only(spark, scored):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    some = scored[scored.evidence.map(len) > 0].head(300)
    assert len(some)
    for neighbours in some.evidence:
        similar = [e["similarity"] for e in neighbours]
        assert similar == sorted(similar, reverse=True) and len(neighbours) <= tox.K
        assert all(zlib.crc32(str(e["doc_id"]).encode()) % 5 and labels[e["doc_id"]] == e["toxic"] for e in neighbours)


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", tox.F.when(tox.held_out(tox.F.col("doc_id")), 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    a, b = (sorted(tuple(r) for r in tox.toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, other))
    assert a == b


LABELS = "doc_id long, toxic long, extra string"


def test_tricky_rows(spark, tricky, no_docs):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(12)] + [(None, 1, "x"), (3, None, "x"), (5, 0, "x"), (5, 7, "x")], LABELS)
    got = tox.toxicity(tricky, labels).collect()
    assert len(got) == tricky.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False] * 3
    assert tox.toxicity(no_docs, labels).count() == 0


def test_without_labels_of_both_classes(spark, tricky):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in tox.toxicity(tricky, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1, "x") for i in range(9)], LABELS)
    assert {r.score for r in tox.toxicity(tricky, ones).collect()} == {1.0}
