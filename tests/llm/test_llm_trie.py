"""Conversation trie against brute force and SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, depth string, key string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows, borrowed):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    built = {c: own.get(prefix_trie.family(c), [])[:borrowed(c)] + ts[borrowed(c):] for c, ts in own.items()}
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children, below = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node, cs in members.items():
        value = (len(cs) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves, saved = below.get(node[:d], (0, 0))
            below[node[:d]] = leaves + (node not in children), saved + value
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, [])), *below[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, borrowed, parts=7):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(parts)
    got = sorted((tuple(r) for r in prefix_trie.nodes(table, borrowed).select(prefix_trie.NODE).collect()), key=repr)
    assert got == brute(rows, borrowed)


def random_turns(rng, convs, longest, words=2):
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["a", "bc", "déf"][:words + 1])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed, monkeypatch):
    rng = random.Random(seed)
    if seed == 2:
        monkeypatch.setattr(prefix_trie, "HELD", 8)
    check(spark, random_turns(rng, 60, 14), prefix_trie.by_checksum if seed else prefix_trie.nobody)


def test_borders_between_tasks(spark, monkeypatch):
    """Every conversation cut by many tasks, with borrowed heads."""
    monkeypatch.setattr(prefix_trie, "HELD", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(9)
        rows = [(c, t, "user", rng.choice("ab")) for c in range(11) for t in range(60)]
        rows += [(c, t, "user", "same") for c in (20, 21, 22) for t in range(40)]
        check(spark, rows, prefix_trie.by_checksum)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tricky_rows(spark):
    rows = [(None, 1, "user", "no id"), (1, None, None, None), (1, None, "user", None), (1, 2, "user", ""), (1, 2, "user", "tie"),
            (2, 5, "user", "x" * 100_000), (2, 5, "user", "x" * 100_000), (-3, 0, "user", "hi"), (-7, 0, "user", "hi"), (-7, 1, "a", "b"),
            (10**15, 0, "user", "hi"), (10**15, 0, "user", "hi"), (4, 1, "user:", ""), (4, 1, "user", ":")]
    check(spark, rows, prefix_trie.by_checksum)
    check(spark, rows, prefix_trie.nobody)
    check(spark, [(3, 0, "user", "only one")], prefix_trie.nobody)
    assert prefix_trie.nodes(spark.createDataFrame([], TURNS), prefix_trie.by_checksum).count() == 0


def test_equal_long_conversations(spark):
    """Many copies of one conversation, and two long ones that differ at the end."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    rows += [(1000 + c, t, "user", f"long {t if t < 900 else (c, t)}") for c in (0, 5) for t in range(1000)]
    check(spark, rows, prefix_trie.nobody)


def test_screening_keeps_every_repeat(spark):
    """Several passes over a sketch of many shards; a single estimate is never wrong."""
    old = prefix_trie.FILTER, prefix_trie.CELLS_PER_PREFIX
    prefix_trie.FILTER, prefix_trie.CELLS_PER_PREFIX = 1 << 18, 20_000
    try:
        check(spark, random_turns(random.Random(4), 40, 9, 1), prefix_trie.by_checksum)
    finally:
        prefix_trie.FILTER, prefix_trie.CELLS_PER_PREFIX = old
    rows = prefix_trie.screened(prefix_trie.prefixes(spark.createDataFrame(
        [(c, t, "user", f"{t % 5} {c if t > 2 else 0}", "x", "y") for c in range(500) for t in range(6)], TURNS)))
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("single"))
    assert counts.where("single and n > 1").count() == 0
    assert counts.where("not single and n = 1").count() < 0.05 * counts.where("n = 1").count()


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    columns = ", ".join(prefix_trie.NODE)
    want = con.execute(f"SELECT {columns} FROM ({queries.SQL['op11_prefix_trie']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op11_prefix_trie"](spark, sf).select(prefix_trie.NODE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(got, key=repr) == brute(rows, lambda c: zlib.crc32(str(c).encode()) % 9)
