"""Exact, near and passage deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import components, exact_dedup, near_copies, simhash, substring_dedup

WHITE = re.compile(r"[\x20\x09-\x0D]")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(n))


def by_key(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[WHITE.sub("", text or "")].append((-len(text or ""), doc is None, doc or 0))
    return {k: (min(v), len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_exact_decisions(tricky, max_bits):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    groups = by_key(rows)
    got = exact_dedup.decisions(tricky, max_bits).collect()
    assert len(got) == len(rows)
    for key, ((_, null, keep), size) in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()]
        assert len(mine) == size and {r.group_size for r in mine} == {size}
        assert {r.keep_id for r in mine} == {None if null else keep} and sum(r.kept for r in mine) == 1


def test_exact_keeps_whole_rows(tricky, no_docs):
    kept = exact_dedup.keep_first(tricky)
    assert kept.columns == tricky.columns
    groups = by_key((r.doc_id, r.text) for r in tricky.collect())
    want = Counter((None if null else keep) for (_, null, keep), _ in groups.values())
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert exact_dedup.keep_first(no_docs).count() == exact_dedup.decisions(no_docs).count() == 0


def test_filter_has_every_repeated_key(spark):
    keys = spark.range(5000).select(F.sha2((F.col("id") % 4000).cast("string"), 256).alias("__sha"))
    maps, bits = exact_dedup.repeat_filter(keys, 5000)
    marked = exact_dedup.mark_possible(keys.withColumn("i", F.lit(1)), maps, bits).groupBy("__sha").agg(
        F.count(F.lit(1)).alias("n"), F.max("__again").alias("m")).collect()
    assert all(r.m for r in marked if r.n > 1)
    assert sum(r.m for r in marked if r.n == 1) < 150


def test_unique_rows_are_not_shuffled(tricky):
    plan = exact_dedup.keep_first(tricky)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") >= 1 and plan.startswith("Union")


def fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest index reachable over links of at most two bits."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_near_duplicates(tricky, no_docs):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    prints = {(d, t): fingerprint(t) for d, t in rows}
    roots = linked(prints.values())
    first = {}
    for (d, _), p in prints.items():
        if d is not None:
            first[roots[p]] = min(d, first.get(roots[p], d))
    want = Counter((d, f"{prints[d, t]:016x}", first.get(roots[prints[d, t]])) for d, t in rows)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(tricky).collect())
    assert got == want
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns and {r.doc_id for r in kept.collect()} >= set(first.values())
    assert simhash.near_duplicates(no_docs).count() == simhash.keep_one(no_docs).count() == 0


def planted_prints(rng):
    """Lone values, pairs, a long chain, and a dense ball; some bits rarely differ, some go together."""
    def value():
        v = rng.getrandbits(64) & ~0xFFFF
        return v | (0xFF00 if rng.random() < 0.5 else 0) | (rng.getrandbits(2) << 3)
    out = {0, value()} | {value() for _ in range(300)}
    for v in list(out)[:60]:
        out.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = value()
    for b in rng.sample(range(64), 24):
        chain ^= 1 << b
        out.add(chain)
    centre = value()
    for _ in range(700):
        out.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    return sorted(out)


@pytest.mark.parametrize("seed,bucket,dense", [(1, 256, 65), (2, 2, 65), (3, 256, 4), (4, 4, 400)])
def test_links_connect_exactly(spark, monkeypatch, seed, bucket, dense):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "DENSE", dense)
    values = planted_prints(random.Random(seed))
    signed = [int(v) for v in np.array(values, np.uint64).view(np.int64)]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(table)
    for r in edges.collect():
        assert ((r.u ^ r.v) & (2 ** 64 - 1)).bit_count() <= 2
    got = {r.node & (2 ** 64 - 1): r.root for r in components.components(edges).collect()}
    roots = linked(values)
    groups = defaultdict(set)
    for v in values:
        groups[roots[v]].add(v)
    for members in groups.values():
        assert len(members) == 1 and not members & set(got) or len({got[m] for m in members}) == 1
    assert len({got[v] for v in got}) == sum(len(m) > 1 for m in groups.values())


def test_pairs_of_a_dense_group_are_not_listed(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(62)
    values = {centre ^ (1 << a) ^ (1 << b) for a in range(62) for b in range(a)} | {centre}
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert edges.count() < 70 * len(values)


def test_thresholds_are_the_cheapest():
    from itertools import product
    rng = np.random.default_rng(0)
    cost = rng.random((50, 4, 4)) * 10
    cost[:, :, 0] = 0
    chosen, best = simhash.thresholds(cost)
    for row, t, b in zip(cost, chosen, best):
        options = [sum(row[i, x + 1] for i, x in enumerate(c)) for c in product((-1, 0, 1, 2), repeat=4) if sum(x + 1 for x in c) == 3]
        assert abs(min(options) - b) < 1e-9 and abs(sum(row[i, x + 1] for i, x in enumerate(t)) - b) < 1e-9


def test_correlated_bits_share_a_partition(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(400):
        v = rng.getrandbits(62)
        for b in (20, 40, 60):
            v = v & ~(1 << b) | ((v >> 3 & 1) << b)
        rows.append((v,))
    n, pairs = simhash.bit_pairs(spark.createDataFrame(rows, "fp long"))
    groups = simhash.group_bits(n, pairs)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert any({3, 20, 40, 60} <= set(g) for g in groups)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5), (2000, 1999), (2000, 1999)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(501)) and got[2000] == got[1999] == 1999
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, length=50):
    first = {}
    words = [(d, [w for w in WHITE.sub(" ", t or "").split(" ") if w]) for d, t in rows]
    order = lambda d: 1 << 63 if d is None else d
    for d, w in words:
        for i in range(len(w) - length + 1):
            key = tuple(w[i:i + length])
            first[key] = min(order(d), first.get(key, order(d)))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < order(d):
                gone[i:i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_repeated_passages(tricky, table_of, no_docs):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert Counter(map(tuple, substring_dedup.remove_repeats(tricky).drop("longest").collect())) == removed(rows)
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (49, 50, 51, 75, 99, 100, 230)]
    made = [(i, " ".join(x for _ in range(3) for x in (prose(rng, rng.randint(0, 40)), rng.choice(passages)))) for i in range(60)]
    made += [(100 + i, "ab cd " * rng.randint(20, 60)) for i in range(5)]
    assert Counter(map(tuple, substring_dedup.remove_repeats(table_of(made)).drop("longest").collect())) == removed(made)
    assert substring_dedup.remove_repeats(no_docs).count() == 0


def test_flushes_do_not_change_the_result(table_of, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_FLUSH_WORDS", 40)
    monkeypatch.setattr(substring_dedup, "_FLUSH_ROWS", 10)
    rng = random.Random(4)
    passage = prose(rng, 80)
    made = [(i, prose(rng, i % 7) + " " + passage + " " + prose(rng, 30)) for i in range(30)]
    assert Counter(map(tuple, substring_dedup.remove_repeats(table_of(made)).drop("longest").collect())) == removed(made)


def test_the_query_goes_through_all_levels(table_of):
    rng = random.Random(21)
    long, short = prose(rng, 900), prose(rng, 120)
    rows = [(1, long + " " + prose(rng, 30)), (2, prose(rng, 30) + " " + long), (3, prose(rng, 40) + " " + short), (4, short + " " + prose(rng, 9)),
            (5, prose(rng, 400)), (6, prose(rng, 400) + " z"), (7, "few words")]
    got = {r.doc_id: (r.longest, r.n_removed) for r in substring_dedup.remove_repeats(table_of(rows)).collect()}
    assert got == {1: (800, 0), 2: (800, 900), 3: (100, 0), 4: (100, 120), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_texts_without_a_mark_stay(table_of):
    rows = [(i, prose(random.Random(i), 70)) for i in range(30)] + [(99, prose(random.Random(3), 70) + " more")]
    plan = substring_dedup.remove_repeats(table_of(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("strategy=broadcast") >= 2


def test_levels_double_until_nothing_repeats(table_of):
    rng = random.Random(6)
    passage = prose(rng, 130)
    found = list(substring_dedup.levels(table_of([(1, prose(rng, 20) + " " + passage), (2, passage + " " + prose(rng, 20)), (3, prose(rng, 300))])))
    assert [n for n, _ in found] == [25, 50, 100, 200] and found[-1][1].isEmpty()
    again = {n: {r.uid: len(r.again) for r in f.collect()} for n, f in found[1:3]}
    assert all(set(again[n].values()) == {131 - n} and len(again[n]) == 2 for n in (50, 100))


def test_kept_text(table_of):
    rng = random.Random(8)
    passage = prose(rng, 60)
    got = {r.doc_id: r.kept for r in substring_dedup.remove_repeats(table_of([(1, passage), (2, "x " + passage + " y")]), with_text=True).collect()}
    assert got == {1: passage, 2: "x y"}


# Near copies of the pipeline's stage

def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = prose(rng, 1) + "x"
    return " ".join(out)


@pytest.mark.parametrize("bucket,pivots", [(64, 64), (4, 2)])
def test_near_copies_at_four_fifths(table_of, monkeypatch, bucket, pivots):
    """Pairs around the bound, a chain, and a dense group; every link of a brute-force comparison is there."""
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    rng = random.Random(5)
    bodies = []
    for n in (1, 2, 3, 4, 5, 6, 7, 8) * 5:
        base = prose(rng, 200).split()
        bodies += [" ".join(base), changed(rng, base, n)]
    chain = prose(rng, 300)
    for _ in range(6):
        chain = changed(rng, chain.split(), 4)
        bodies.append(chain)
    centre = prose(rng, 150).split()
    bodies += [changed(rng, centre, rng.randint(1, 4)) for _ in range(90)] + [" ".join(prose(rng, k).split()) for k in (1, 2, 4, 5)]
    bodies += ["", None, " \n", bodies[0].upper()]
    rng.shuffle(bodies)
    kept = [r.doc_id for r in near_copies.keep_one(table_of(enumerate(bodies))).collect()]
    assert sorted(kept) == sorted(set(first_of_group(dict(enumerate(bodies))).values()))


def first_of_group(bodies):
    """Smallest id reachable over pairs of similarity 0.8 or more, by comparing all pairs that share a shingle."""
    sets = {d: five_words(t) for d, t in bodies.items()}
    root = {d: d for d in bodies}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d] or [None]:
            holders[s].append(d)
    for a, b in {(a, b) for ds in holders.values() for i, b in enumerate(ds) for a in ds[:i]}:
        if find(a) != find(b) and similar(sets[a], sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in bodies}


def test_near_copies_of_no_table_and_odd_columns(spark, no_docs, tricky):
    assert near_copies.keep_one(no_docs).count() == 0 and near_copies.keep_one(no_docs).columns == no_docs.columns
    odd = tricky.withColumnsRenamed({"fp": "row", "shard": "__row", "score": "set", "lang": "doc"})
    got = near_copies.keep_one(odd)
    assert got.columns == odd.columns
    assert got.count() == len(set(first_of_group(dict(enumerate(r.text for r in tricky.collect()))).values()))


def test_a_bucket_gives_no_list_of_pairs(spark, table_of):
    """A thousand near copies of one text: links in proportion to the sets."""
    rng = random.Random(8)
    centre = prose(rng, 120).split()
    bodies = [changed(rng, centre, 2) for _ in range(1000)]
    rows = near_copies.stored(table_of(enumerate(bodies)).select(F.col("doc_id").alias("row"), "doc_id", "text"))
    nodes = near_copies.stored(near_copies.sketches(rows).select("set", "size", "keys", "least", F.struct("row").alias("place")))
    assert near_copies.links(nodes, rows).count() < near_copies.BANDS * 1000
    assert near_copies.keep_one(table_of(enumerate(bodies))).count() == 1


@pytest.mark.parametrize("least", [0.8, 0.85, 0.9, 1.0])
def test_recall_of_planted_pairs(table_of, least):
    rng, bodies = random.Random(int(100 * least)), {}
    while len(bodies) < 200:
        base = prose(rng, 160).split()
        words, other = list(base), base
        while True:
            words[rng.randrange(160)] = prose(rng, 1) + "y"
            a, b = five_words(" ".join(base)), five_words(" ".join(words))
            if len(a & b) / len(a | b) < least or least == 1:
                break
            other = list(words)
        bodies |= {len(bodies): " ".join(base), len(bodies) + 1: " ".join(other).upper()}
    kept = {r.doc_id for r in near_copies.keep_one(table_of(bodies.items())).collect()}
    assert kept == set(first_of_group(bodies).values()) and len(kept) == 100
