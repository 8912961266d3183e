"""Shards of near-equal size by sampled splitters.

Records are ordered by a 64-bit key: bits of the text's hash, then of the id's, then of the row's number. Copies of a text so lie
side by side, and a text, or a row, that a third of all records share can still be divided. Samples drawn with a chance in
proportion to a record's size give quantile boundaries of ``ranges_per_shard`` ranges for each shard, or of as many as keep a range
at ``RANGE_BYTES``. The exact size of every range is then counted; those of
more than twice the wanted size are sampled again by themselves and subdivided, until none is left
that more than one key makes up. Whole ranges are dealt to shards, the largest first to the emptiest
shard, so sizes end up near equal (law ``bytes``). Only range totals and a number of samples set by the
parameters reach the driver.

A record's size is its UTF-8 bytes plus 16 (null text: 16). ``slot`` counts a shard's records from
0 without gaps. Null ids and repeated rows are ordinary records. Tables are read several times and should be stored, so that a row keeps
its number. With fewer records than shards some shards stay empty. An empty table gives no rows.
"""

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import stored

SHARDS = 40
RANGES_PER_SHARD = 64
SAMPLES_PER_RANGE = 8
RECORD_BYTES = 16
RANGE_BYTES = 512 << 20
_ID_BITS, _ROW_BITS = 14, 14
_DICE = 1 << 30


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    of_id = F.shiftleft(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << _ID_BITS) - 1)), _ROW_BITS)
    key = F.xxhash64(text).bitwiseAND(F.lit(-1 << (_ID_BITS + _ROW_BITS))).bitwiseOR(of_id).bitwiseOR(row)
    return docs.withColumns({"__key": key, "__size": F.octet_length(text).cast("long") + RECORD_BYTES,
                             "__crc": F.crc32(text.cast("binary"))})


def range_of(bounds: np.ndarray) -> Column:
    """Number of the range of ``__key``: boundaries at or below it."""
    @arrow_udf("int")
    def place(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, key.to_numpy(zero_copy_only=False), side="right").astype(np.int32))
    return place("__key")


def _splitters(samples: list[tuple[int, float]], parts: int) -> list[int]:
    """Keys at the weighted quantiles of samples (key, weight) sorted by key."""
    weights = np.array([w for _, w in samples])
    ends = np.cumsum(weights)
    cuts = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    out = set()
    for i in set(cuts.tolist()):
        key = samples[i][0]
        out.add(key)
        if weights[i] > 0.5 * ends[-1] / parts and key < (1 << 63) - 1:  # a record that alone fills a range
            out.add(key + 1)
    return sorted(out)


def _sample(rows: DataFrame, step: Column, seed: int) -> DataFrame:
    """Rows drawn with chance size / step, at most 1; ``weight`` is size over chance."""
    dice = F.pmod(F.xxhash64("__key", "__size", F.lit(seed)), F.lit(_DICE)) / F.lit(float(_DICE))
    return rows.where(dice * step < F.col("__size")).withColumn("weight", F.greatest(F.col("__size").cast("double"), step))


def ranges(keyed: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD,
           range_bytes: int = RANGE_BYTES) -> tuple[np.ndarray, list]:
    """Boundaries, and (range, records, size) of each range that has records.

    The driver holds the range totals and about ``SAMPLES_PER_RANGE`` samples a range: 1.6 million numbers at 100 TB.
    """
    total = keyed.agg(F.sum("__size")).first()[0]
    if not total:
        return np.zeros(0, np.int64), []
    parts = max(shards * ranges_per_shard, total // range_bytes)
    target = total / parts
    drawn = _sample(keyed, F.lit(target / SAMPLES_PER_RANGE), 0)
    bounds = np.array(_splitters(sorted((r[0], r[1]) for r in drawn.select("__key", "weight").collect()), parts), np.int64)
    for again in itertools.count(1):
        placed = keyed.withColumn("__range", range_of(bounds))
        counted = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("size"),
                                                F.min("__key").alias("low"), F.max("__key").alias("high")).collect()
        over = {r["__range"]: r for r in counted if r["size"] > 2 * target and r["low"] < r["high"]}
        if not over:
            break
        drawn = _sample(placed.where(F.col("__range").isin(list(over))), F.lit(target / (4 * SAMPLES_PER_RANGE)), again)
        by_range: dict[int, list] = {k: [] for k in over}
        for r in drawn.select("__range", "__key", "weight").collect():
            by_range[r[0]].append((r[1], r[2]))
        new = set(bounds.tolist())
        for k, samples in by_range.items():
            new.add(over[k]["high"])
            if samples:
                new.update(_splitters(sorted(samples), int(2 * over[k]["size"] / target) + 1))
        if len(new) == len(bounds):
            break
        bounds = np.array(sorted(new), np.int64)
    return bounds, sorted((r["__range"], r["n"], r["size"]) for r in counted)


def deal(found: list, shards: int = SHARDS) -> list[tuple[int, int, int]]:
    """(range, shard, first slot): the largest range first, to the shard with the fewest bytes."""
    heap = [(0, s, 0) for s in range(shards)]
    out = []
    for k, n, size in sorted(found, key=lambda r: (-r[2], r[0])):
        filled, shard, slots = heapq.heappop(heap)
        out.append((k, shard, slots))
        heapq.heappush(heap, (filled + size, shard, slots + n))
    return out


def placed(keyed: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """Add ``__range``, ``__shard`` and ``__base`` (first slot of the range) to rows of ``with_key``; rows do not move."""
    bounds, found = ranges(keyed.select("__key", "__size"), shards, **options)
    where = keyed.sparkSession.createDataFrame(deal(found, shards), "__range int, __shard int, __base long")
    return keyed.withColumn("__range", range_of(bounds)).join(F.broadcast(where), "__range")


def assign(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) of every document."""
    keyed = stored(with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    inside = Window.partitionBy("__range").orderBy("__key", F.col("doc_id").asc_nulls_last())
    return placed(keyed, shards, **options).select(
        "doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__base") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write the documents, all columns, into one folder for each shard, in key order inside each file."""
    rows = placed(with_key(docs), shards, **options)
    (rows.repartition("__range").sortWithinPartitions("__shard", "__range", "__key")
     .select(*docs.columns, F.col("__shard").alias("shard")).write.partitionBy("shard").parquet(path))
