"""Trie of conversation prefixes: which conversations start alike, and what sharing their beginnings would save.

A node is a distinct sequence of the first d turns (role and text; null is empty) of some conversation, the root has none. Turns
are ordered by number, null first, then by a digest of role and text; rows without ``conv_id`` belong to no conversation.
``borrowed(c)`` says how many first turns a conversation takes over from conversation c - c % 5 before its own turns after as
many; nobody borrows by default.

1. Turns are range-partitioned by conversation and place without their texts, so that a long conversation is cut like any other. A task
   walks its sorted rows and gives every prefix a digest, a polynomial modulo 2^127 - 1 of the turns' SHA-256 prefixes: it
   can be shifted and joined. Families of conversations (c - c % 5) at a border of a task, or of over ``HELD`` rows in it, come
   out raw with their local digest; what precedes them, a few numbers a task, is summed on the driver and added in a second pass.
2. A count-min sketch of all digests, two rows of four to eight cells a prefix, is built in the tasks and merged by shard. An
   estimate of one proves that a prefix occurs once, and then all longer ones of the conversation do: such tails are written
   where they are. At most ``FILTER`` bytes of the sketch go to a task at a time; a larger one takes several passes.
3. Only prefixes that may be shared are shuffled and grouped by the whole digest. Sums over subtrees need no levels: let R(c)
   be the bytes of the longest prefix of c that a conversation with a smaller id has too, at depth r(c). Below a node of depth d,
   every member but the smallest saves R(c) less the bytes above the node; every member with r(c) <= d that goes on opens
   one child; every conversation that is the smallest of a childless node is one leaf.

Hot prefixes are aggregated in the map tasks, their groups joined by broadcast (``join_groups``). The list of ids behind an
``ends_sha256`` is hashed as a stream over sorted rows. Repeated rows are repeated turns; an empty table has no node, not even a root.
"""

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import join_groups, stored

PRIME = (1 << 127) - 1
RADIX = int.from_bytes(hashlib.sha256(b"radix").digest()[:15], "big")
FAMILY = 5
MOST_BORROWED = 8
HELD = 100_000
CELLS = 1 << 20  # of one row of the sketch in one shard
CELLS_PER_PREFIX = 4
FILTER = 64 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_PREFIX = "conv_id long, depth long, key binary, bytes long, last long, ends boolean"
_WALKED = f"raw boolean, part int, {_PREFIX}"


def nobody(conv_id: int) -> int:
    return 0


def by_checksum(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % (MOST_BORROWED + 1)


def family(conv_id: int) -> int:
    """c - c % 5 with a remainder of the sign of c, as SQL has it."""
    return conv_id - (abs(conv_id) % FAMILY) * (1 if conv_id >= 0 else -1)


def _key(digest: int, depth: int) -> bytes:
    return digest.to_bytes(16, "big") + depth.to_bytes(8, "big")


def _after(before: tuple, local: tuple) -> tuple:
    """(turns, digest, bytes) of one stretch of turns followed by another."""
    return before[0] + local[0], (before[1] * pow(RADIX, local[0], PRIME) + local[1]) % PRIME, before[2] + local[2]


class Graft:
    """How the prefixes of one conversation follow from its own and from the head that it borrows.

    ``own`` gives (turns, digest, bytes, last) of its first prefixes, ``head`` those it takes over.
    """

    def __init__(self, conv_id: int, turns: int, own: list[tuple], head: list[tuple], takes: int):
        self.conv_id = conv_id
        self.skip = 0 if family(conv_id) == conv_id else takes
        self.head = head[:self.skip]
        self.length = len(self.head) + max(0, turns - self.skip)
        _, above, size = self.head[-1][:3] if self.head else (0, 0, 0)
        _, mine, less = own[self.skip - 1][:3] if 0 < self.skip <= len(own) else (0, 0, 0)
        self.digest, self.bytes = (above - mine) % PRIME, size - less

    def top(self) -> Iterator[tuple]:
        """The root and the borrowed prefixes."""
        yield self.conv_id, 0, _key(0, 0), 0, 0, self.length == 0
        for turns, digest, size, last in self.head:
            yield self.conv_id, turns, _key(digest, turns), size, last, turns == self.length

    def prefix(self, turns: int, digest: int, size: int, last: int) -> tuple | None:
        """The rebuilt prefix that ends with the conversation's own turn number ``turns``."""
        if turns <= self.skip:
            return None
        depth = len(self.head) + turns - self.skip
        digest = (self.digest * pow(RADIX, turns - self.skip, PRIME) + digest) % PRIME
        return self.conv_id, depth, _key(digest, depth), self.bytes + size, last, depth == self.length


def _rows(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
_NAMES = ["conv_id", "depth", "key", "bytes", "last", "ends"]


def _walk(borrowed: Callable[[int], int]):
    """Prefixes of one task's turns (conv_id, digest, bytes), sorted; raw ones carry their place and digest within the task."""
    names, kinds = ["raw", "part", *_NAMES], [pa.bool_(), pa.int32(), *_KINDS]

    def finished(held: dict[int, list[tuple]]) -> Iterator[tuple]:
        for conv_id, own in held.items():
            graft = Graft(conv_id, len(own), own[:MOST_BORROWED], held.get(family(conv_id), [])[:MOST_BORROWED], borrowed(conv_id))
            yield from graft.top()
            yield from filter(None, (graft.prefix(*p) for p in own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple]] = {}
        out: list[tuple] = []
        group, raw, size, state = None, True, 0, {}

        def flush() -> None:
            nonlocal size
            if raw:
                out.extend((True, part, c, n, d.to_bytes(16, "big"), b, last, None) for c, own in held.items() for n, d, b, last in own)
            else:
                out.extend((False, part, *p) for p in finished(held))
            held.clear()
            size = 0

        for batch in batches:
            for conv_id, digest, last in zip(*(c.to_pylist() for c in batch.columns)):
                if family(conv_id) != group:
                    if group is not None:
                        flush()
                        raw = False
                    group, state = family(conv_id), {}
                turns, before, total = state.get(conv_id, (0, 0, 0))
                state[conv_id] = now = (turns + 1, (before * RADIX + int.from_bytes(digest, "big")) % PRIME, total + last)
                held.setdefault(conv_id, []).append((*now, last))
                size += 1
                if size >= HELD:
                    raw = True
                    flush()
            if len(out) >= 10_000:
                yield _rows(out, names, kinds)
                out.clear()
        raw = True
        flush()
        yield _rows(out, names, kinds)

    return run


def _resolved(walked: DataFrame, borrowed: Callable[[int], int]) -> tuple[dict, dict]:
    """What precedes each raw stretch (part, conv_id), and the graft of every conversation that has one."""
    raw = walked.where("raw")
    place = F.struct("depth", "key", "bytes", "last")
    ends = raw.groupBy("part", "conv_id").agg(
        F.max(F.struct("depth", "key", "bytes")).alias("end"),
        F.sort_array(F.collect_list(F.when(F.col("depth") <= MOST_BORROWED, place))).alias("first"))
    before, state, heads = {}, {}, {}
    for r in ends.orderBy("part", "conv_id").collect():
        c = r["conv_id"]
        was = before[r["part"], c] = state.get(c, (0, 0, 0))
        head = heads.setdefault(c, [])
        for n, key, size, last in r["first"]:
            if len(head) < MOST_BORROWED:
                head.append((*_after(was, (n, int.from_bytes(key, "big"), size)), last))
        n, key, size = r["end"]
        state[c] = _after(was, (n, int.from_bytes(key, "big"), size))
    return before, {c: Graft(c, n, heads[c], heads.get(family(c), []), borrowed(c)) for c, (n, _, _) in state.items()}


def _second_walk(before: dict, grafts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, c, n, key, size, last in zip(*(x.to_pylist() for x in batch.columns)):
                own = _after(before[part, c], (n, int.from_bytes(key, "big"), size))
                if own[0] == 1:
                    out.extend(grafts[c].top())
                got = grafts[c].prefix(*own, last)
                if got:
                    out.append(got)
            yield _rows(out, _NAMES, _KINDS)

    return run


def prefixes(turns: DataFrame, borrowed: Callable[[int], int] = nobody) -> DataFrame:
    """Every prefix of every (rebuilt) conversation: conv_id, depth, key, bytes of all its texts and of the last, whether the
    conversation ends there. Stored."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("last"),
                        F.monotonically_increasing_id().alias("row")).where("conv_id is not null")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    walked = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "last")
                    .mapInArrow(_walk(borrowed), _WALKED))
    before, grafts = _resolved(walked, borrowed)
    raw = walked.where("raw").select("part", "conv_id", "depth", "key", "bytes", "last")
    return walked.where("not raw").select(_NAMES).unionByName(
        stored(raw.mapInArrow(_second_walk(before, grafts), _PREFIX)))


def _cells(keys: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every key and its cells in both rows (2 x keys)."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), dtype=">u8").reshape(-1, 3).astype(np.uint64)
    mixed = (halves[:, 0] ^ (halves[:, 1] >> np.uint64(1))) * _ODD[0]
    shard = (mixed >> np.uint64(40)) % np.uint64(shards)
    cell = [((halves[:, i] + halves[:, 2]) * _ODD[i]) >> np.uint64(44) for i in (0, 1)]
    return shard.astype(np.int64), np.array(cell).astype(np.int64)


def _tally(shards: int):
    """Per shard and row of the sketch the cells that this task hits once, and more often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            shard, cells = _cells(batch.column(0), shards)
            places = np.concatenate([(shard * 2 + i) * CELLS + cells[i] for i in (0, 1)])
            cell, n = np.unique(np.concatenate([seen[0], places]), return_inverse=True)
            seen = cell, np.minimum(np.bincount(n, weights=np.concatenate([seen[1], np.ones(len(places), np.int64)])), 2).astype(np.int64)
        cell, n = seen
        cut = np.searchsorted(cell // (2 * CELLS), np.arange(shards + 1))
        out = []
        for s in np.flatnonzero(np.diff(cut)).tolist():
            own, times = cell[cut[s]:cut[s + 1]] - s * 2 * CELLS, n[cut[s]:cut[s + 1]]
            out.append((s, *(zlib.compress(np.diff(own[times == t], prepend=0).astype(np.int32).tobytes(), 1) for t in (1, 2))))
        yield _rows(out, ["shard", "once", "more"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _unpacked(deltas: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(deltas), np.int32), dtype=np.int64)


def _merged(shard: pa.Table) -> pa.Table:
    """The cells of a shard that all tasks together hit at least twice, as bits."""
    n = np.zeros(2 * CELLS, np.uint8)
    for once, more in zip(shard.column("once"), shard.column("more")):
        n[_unpacked(more.as_py())] = 2
        at = _unpacked(once.as_py())
        n[at] = np.minimum(n[at] + 1, 2)
    return pa.table({"shard": shard.column("shard")[:1], "repeated": pa.array([np.packbits(n == 2).tobytes()], pa.binary())})


def sketch(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Bitmaps (shard, repeated) of the count-min cells that ``keys.key`` hits at least twice, and the number of shards."""
    shards = 1
    while shards * CELLS < CELLS_PER_PREFIX * rows:
        shards *= 2
    maps = (keys.select("key").mapInArrow(_tally(shards), "shard int, once binary, more binary")
            .groupBy("shard").applyInArrow(_merged, "shard int, repeated binary"))
    return stored(maps), shards


def _screen(maps: dict[int, bytes], shards: int, lowest: int, highest: int):
    """Rows of some shards with ``single`` (the estimate is one) and ``local`` (so is the prefix before)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((highest - lowest, 2 * CELLS // 8), np.uint8)
        for s, held in maps.items():
            bits[s - lowest] = np.frombuffer(held, np.uint8)
        for batch in batches:
            shard, cells = _cells(batch.column("key"), shards)
            here = (shard >= lowest) & (shard < highest)
            at, shard, cells = batch.filter(pa.array(here)), shard[here] - lowest, cells[:, here]
            twice = np.ones(len(shard), bool)
            for i in (0, 1):
                place = cells[i] + i * CELLS
                twice &= (bits[shard, place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            conv, depth = at.column("conv_id").to_numpy(), at.column("depth").to_numpy()
            follows = np.append(False, (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1))[:len(conv)]
            # From its first single prefix on a conversation is alone.
            start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(conv))))
            alone = np.cumsum(~twice)
            single = alone - (alone - ~twice)[start] > 0
            local = follows & np.append(False, single[:-1])[:len(single)]
            yield pa.RecordBatch.from_arrays([*at.columns, pa.array(single), pa.array(local)], [*_NAMES, "single", "local"])

    return run


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``single`` and ``local``, stored."""
    maps, shards = sketch(rows, rows.count())
    step, out = max(1, FILTER // (2 * CELLS // 8)), None
    for low in range(0, shards, step):
        high = min(shards, low + step)
        held = {r["shard"]: bytes(r["repeated"]) for r in maps.where(F.col("shard").between(low, high - 1)).collect()}
        got = stored(rows.mapInArrow(_screen(held, shards, low, high), f"{_PREFIX}, single boolean, local boolean"))
        out = got if out is None else out.unionByName(got)
    return out


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from (key, conv_id) sorted by both; one id at a time."""
    now, running = None, None
    for batch in batches:
        out = []
        for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if key != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(str(conv_id).encode())
            else:
                running.update(f",{conv_id}".encode())
        yield _rows(out, ["key", "ends_sha256"], [pa.binary(), pa.string()])
    if now is not None:
        yield _rows([(now, running.hexdigest())], ["key", "ends_sha256"], [pa.binary(), pa.string()])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _alone(rows: DataFrame) -> DataFrame:
    """Nodes of prefixes that one conversation has; ``parent_conv_id`` is there."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.sha2(F.lit(b""), 256))
    return rows.select("conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("ends"), none).otherwise(one).alias("n_children"),
                       one.alias("n_leaves"), none.alias("saved_tokens"), ends.alias("ends_sha256"))


def nodes(turns: DataFrame, borrowed: Callable[[int], int] = nobody) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = screened(prefixes(turns, borrowed))
    shared = stored(rows.where("not single").drop("single", "local"))
    total = shared.count()
    groups = stored(shared.groupBy("key").agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n"), F.count_if("ends").alias("n_ends")))
    met = join_groups(shared.select("key", "conv_id", "depth", "bytes", "ends"), groups, "key", F.col("n"), total, "inner")
    # Of every conversation: its longest prefix that a smaller one has too, and whether it is the smallest of a childless node.
    own = stored(met.groupBy("conv_id").agg(
        F.max(F.when(F.col("least") < F.col("conv_id"), F.struct("depth", "bytes", "least"))).alias("up"),
        F.min(F.when(F.col("ends"), (F.col("least") == F.col("conv_id")) & (F.col("n") == F.col("n_ends")))).alias("leaf"),
        F.count(F.lit(1)).alias("held")).select(
            "conv_id", F.coalesce("up.depth", F.lit(-1)).alias("up_depth"), F.coalesce("up.bytes", F.lit(0)).alias("up_bytes"),
            F.col("up.least").alias("up_least"), F.coalesce("leaf", F.lit(True)).alias("leaf"), "held"))
    parent = F.when(F.col("depth") == F.coalesce("up_depth", F.lit(-1)) + 1, F.col("up_least")).otherwise(F.col("conv_id"))
    known = join_groups(shared, own, "conv_id", F.col("held"), total, "inner")
    first = F.col("up_depth") < F.col("depth")
    groups = known.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max(F.when(first, parent)).alias("parent_conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.count_if(~F.col("ends") & (F.col("up_depth") <= F.col("depth"))).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.coalesce(F.sum(F.when(~first, F.col("up_bytes") - F.col("bytes") + F.col("last"))), F.lit(0)).alias("saved_tokens"))
    ends = (shared.where("ends").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_ends, "key binary, ends_sha256 string"))
    grouped = groups.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    alone = rows.where("single")
    tops = alone.where("not local").join(own, "conv_id", "left").withColumn("parent_conv_id", parent)
    tails = alone.where("local").withColumn("parent_conv_id", F.col("conv_id"))
    return grouped.select(NODE).unionByName(_alone(tops)).unionByName(_alone(tails))
