"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of a text's word
shingles. Two fingerprints are linked when at most ``RADIUS`` bits differ; documents of linked fingerprints form a component.

Only distinct fingerprints are compared. Their bits are grouped into partitions, correlated bits together, so
that skew stays in few partitions. For fingerprints within distance r and thresholds t_i (-1: partition not looked
at) with sum(t_i + 1) = r + 1, at least one partition i differs in at most t_i bits. Every
fingerprint gets thresholds of its own, the cheapest by dynamic programming over the partitions:
the exact number of fingerprints that share a partition's value is counted, and the number within one or two bits is
estimated from histograms of its halves. It then looks up all values within t_i and verifies what it finds.

Where even the cheapest thresholds cost more than ``DENSE`` candidates (hot values, large groups of
near copies), all 64 bits are taken as one partition with the distance split between both sides:
the fingerprint and all that differ in one bit are its meeting points, and fingerprints that share a point
are linked without being compared. A point is shared by 65 fingerprints at most. A pair of which one
side is not dense is found by that side's own lookup. So no link is lost, none is a candidate
of an unbounded bucket, and the pairs within a group are never listed.

Null and empty texts have fingerprint zero and are linked like any other. Null ids are never a
component's id unless no other is there. Repeated rows belong to one component. An empty table gives no rows.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import id_and_text, join_groups, stored, texts
from corpusloom.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
PARTS = 3
DENSE = 65
BUCKET = 256  # a lookup into a larger bucket makes its fingerprint dense
_CHUNK = 1 << 16


def shingle_fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    if len(words) >= size:
        spans = (starts[:len(words) - size + 1], (starts + lengths)[size - 1:])
    else:
        spans = (starts[:1], np.array([len(line)]))
    votes, n = np.zeros(64, np.int64), len(spans[0])
    for at in range(0, n, _CHUNK):
        pairs = zip(spans[0][at:at + _CHUNK].tolist(), spans[1][at:at + _CHUNK].tolist())
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in pairs), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


@arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(np.array([shingle_fingerprint(t) for t in texts(text)], np.uint64).view(np.int64))


def as_hex(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_pairs(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are set together (64 x 64)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64)), 0
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            total += b.T @ b
            rows += len(b)
        i, j = np.triu_indices(64)
        yield pa.RecordBatch.from_pydict({"i": [*i.tolist(), -1], "j": [*j.tolist(), -1],
                                          "n": [*total[i, j].astype(np.int64).tolist(), rows]})
    found = distinct.select("fp").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    pairs, rows = np.zeros((64, 64)), 0
    for r in found.collect():
        if r.i < 0:
            rows = r.n
        else:
            pairs[r.i, r.j] = pairs[r.j, r.i] = r.n
    return rows, pairs


def group_bits(rows: int, pairs: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits of each partition: grown from a pair of strongest correlation by the bit closest to the group."""
    p = pairs.diagonal() / max(rows, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-18))
    near = np.abs(pairs / max(rows, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(near, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        inside = near[np.ix_(left, left)]
        group = [left[i] for i in np.unravel_index(np.argmax(inside), inside.shape)][:width]
        group = list(dict.fromkeys(group)) or left[:1]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(near[np.ix_(rest, group)].sum(axis=1)))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def mask(bits: list[int]) -> int:
    """Bits as a signed 64-bit mask."""
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _half_value(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    value = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        value |= ((fps >> b) & 1) << k
    return value


def half_histograms(distinct: DataFrame, groups: list[list[int]]) -> list[list[np.ndarray]]:
    """Share of fingerprints at distance 0, 1 and 2 of each value of each half of each partition."""
    halves = [h for g in groups for h in (g[:len(g) // 2], g[len(g) // 2:])]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(1 << len(h), np.int64) for h in halves]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for t, h in zip(total, halves):
                t += np.bincount(_half_value(fps, h), minlength=len(t))
        for k, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_pydict({"half": pa.array(np.full(len(at), k)), "value": pa.array(at), "n": pa.array(t[at])})
    counts = [np.zeros(1 << len(h)) for h in halves]
    rows = distinct.select("fp").mapInArrow(count, "half long, value long, n long").groupBy("half", "value").agg(F.sum("n").alias("n"))
    for r in rows.collect():
        counts[r.half][r.value] = r.n
    out = []
    for c, h in zip(counts, halves):
        at = np.arange(len(c))
        one = sum((c[at ^ (1 << a)] for a in range(len(h))), np.zeros(len(c)))
        two = sum((c[at ^ (1 << a) ^ (1 << b)] for a, b in combinations(range(len(h)), 2)), np.zeros(len(c)))
        out.append([x / max(c.sum(), 1) for x in (c, one, two)])
    return out


def costs(fps: np.ndarray, shared: np.ndarray, groups: list[list[int]], shares: list, rows: int, radius: int = RADIUS) -> np.ndarray:
    """Candidates and lookups of each fingerprint (axis 0), partition (1) and threshold -1, 0, .. radius (2)."""
    out = np.zeros((len(fps), len(groups), radius + 2))
    for i, bits in enumerate(groups):
        cut = len(bits) // 2
        a, b = shares[2 * i], shares[2 * i + 1]
        va, vb = _half_value(fps, bits[:cut]), _half_value(fps, bits[cut:])
        near, lookups = np.zeros(len(fps)), 0
        for t in range(radius + 1):
            near = near + rows * sum(a[d][va] * b[t - d][vb] for d in range(t + 1))
            lookups += len(list(combinations(bits, t)))
            out[:, i, t + 1] = lookups + (shared[:, i] if t == 0 else np.maximum(near, shared[:, i]))
    return out


def thresholds(cost: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest thresholds with sum(t + 1) = radius + 1, by dynamic programming over partitions; and their cost."""
    n, parts, _ = cost.shape
    best = np.full((n, radius + 2), np.inf)
    best[:, 0] = 0
    chosen = np.zeros((n, parts, radius + 2), np.int64)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for spent in range(radius + 2):
            options = np.stack([best[:, spent - t] + cost[:, i, t] for t in range(spent + 1)], axis=1)
            chosen[:, i, spent] = options.argmin(axis=1)
            new[:, spent] = options.min(axis=1)
        best = new
    out, left, row = np.zeros((n, parts), np.int64), np.full(n, radius + 1), np.arange(n)
    for i in reversed(range(parts)):
        out[:, i] = chosen[row, i, left] - 1
        left = left - out[:, i] - 1
    return out, best[:, radius + 1]


def _lookups(groups, shares, rows, radius):
    """Batches of (fp, shared counts) to lookups (fp, part, key); part -1 are meeting points of dense fingerprints."""
    masks = np.array([mask(g) for g in groups], np.int64)
    flips = [[np.array([mask(list(c)) if c else 0 for c in combinations(g, t)], np.int64) for t in range(radius + 1)] for g in groups]
    points = np.array([0, *(mask([b]) for b in range(64))], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shared = np.array(batch.column(1).to_pylist(), float).reshape(len(fps), len(groups))
            chosen, cost = thresholds(costs(fps, shared, groups, shares, rows, radius), radius)
            dense = cost > DENSE
            parts = [(fps[dense], -1, points)]
            for i in range(len(groups)):
                for t in range(radius + 1):
                    these = fps[~dense & (chosen[:, i] >= t)]
                    parts.append((these, i, flips[i][t]))
            for these, part, flip in parts:
                for at in range(0, len(these), 4096):
                    some = these[at:at + 4096]
                    keys = ((some if part < 0 else some & masks[part])[:, None] ^ flip[None, :]).ravel()
                    yield pa.RecordBatch.from_pydict({
                        "fp": pa.array(np.repeat(some, len(flip))), "part": pa.array(np.full(len(keys), part, np.int32)),
                        "key": pa.array(keys)})
    return run


def meeting_points(fps: DataFrame) -> DataFrame:
    """Links among dense fingerprints: all that share a point hang on the smallest of them."""
    return (fps.withColumn("v", F.min("fp").over(Window.partitionBy("key")))
            .select(F.col("fp").alias("u"), "v").where("u <> v").distinct())


def links(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other."""
    if radius != 2:
        raise ValueError("meeting points one bit away stand for a radius of two")
    rows, pairs = bit_pairs(distinct)
    groups = group_bits(rows, pairs, parts)
    shares = half_histograms(distinct, groups)
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("key")) for i, g in enumerate(groups)])
    entries = distinct.select("fp", F.explode(keys).alias("e")).select("fp", F.col("e.part").alias("part"), F.col("e.key").alias("key"),
                                                                      F.xxhash64("e").alias("__e"))
    sizes = stored(entries.groupBy("__e").agg(F.count(F.lit(1)).alias("n")))
    counted = stored(join_groups(entries, sizes, "__e", F.col("n"), parts * rows, "inner"))
    shared = counted.groupBy("fp").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "n"))), lambda x: x["n"]).alias("shared"))
    asked = stored(shared.select("fp", "shared").mapInArrow(_lookups(groups, shares, rows, radius), "fp long, part int, key long"))
    large = counted.where(F.col("n") > BUCKET).select("part", "key").distinct()
    overflow = stored(asked.where("part >= 0").join(large, ["part", "key"], "left_semi").select("fp").distinct())
    found = (asked.where("part >= 0").join(overflow, "fp", "left_anti")
             .join(counted.where(F.col("n") <= BUCKET).select(F.col("fp").alias("other"), "part", "key"), ["part", "key"])
             .where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius))
             .select(F.col("fp").alias("u"), F.col("other").alias("v")))
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(mask([b]))) for b in range(64)])
    dense = (asked.where("part < 0").select("fp", "key")
             .unionByName(overflow.select("fp", F.explode(points).alias("key"))))
    return found.unionByName(meeting_points(dense))


def groups_of(docs: DataFrame) -> DataFrame:
    """(fp, component_id, n): smallest id of the component of every distinct fingerprint, for rows (doc_id, fp)."""
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = stored(components(links(distinct.select("fp"))))
    own = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = own.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return join_groups(own, named, "root", F.col("members"), distinct.count(), "inner").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    rows = stored(id_and_text(docs).select("doc_id", fingerprint("text").alias("fp")))
    total = rows.count()
    return join_groups(rows, stored(groups_of(rows)), "fp", F.col("n"), total, "inner").select(
        "doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every component, with all columns.

    Documents without an id stay only where their whole component has none.
    """
    rows = stored(docs.withColumn("__fp", fingerprint(F.coalesce(F.col("text"), F.lit("")))))
    narrow = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__fp").alias("fp"))
    found = stored(groups_of(narrow)).withColumnsRenamed({"fp": "__fp", "component_id": "__first", "n": "__n"})
    return (join_groups(rows, found, "__fp", F.col("__n"), rows.count(), "inner")
            .where(F.col("doc_id").eqNullSafe(F.col("__first"))).select(docs.columns))
