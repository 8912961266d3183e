"""Shared plan shapes: size-checked broadcast, salted join, first-per-key, top-k."""

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# A side is broadcast only if it has at most this many rows (counted, with an
# early stop) and its rows are narrow.
BROADCAST_ROWS = 200_000
SALTS = 16


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count at most ``rows + 1`` rows; the limit stops the scan early."""
    return df.limit(rows + 1).count() <= rows


# A reader decodes up to 4,096 rows of a row group at once, so tables with a great many numbers in a row get small groups.
WIDE_ROWS = {"parquet.block.row.count.limit": 32}


def stored(df: DataFrame, folder: str | None = None, wide: bool = False) -> DataFrame:
    """Write ``df`` once as a table and read it back; ``wide`` for rows of hundreds of kilobytes.

    For plans that go over an expensive result several times. The table lies in a new folder below
    ``folder``, or below the one named by ``spark.checkpoint.dir``, shared by all executors, so a
    lost executor costs a re-read and nothing else. ``run_folder`` gives a flow a folder of its own.
    """
    spark = df.sparkSession
    path = new_folder(spark, folder)
    df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table in hash buckets of ``key``, sorted by it, one file each.

    A join or grouping by ``key`` reads it as it lies; the other side alone is shuffled, to as many partitions. For tables that are
    met again and again: caches, stored chunks. Choose ``buckets`` so that one has about 1 GB; with fewer than the session's shuffle
    partitions, the default, Spark shuffles both sides. The session's catalogue names the table.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"corpusloom_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", new_folder(spark, folder)).saveAsTable(name))
    return spark.table(name)


def laid_out(rows: DataFrame, folders: list[str], *order: str) -> DataFrame:
    """Rows dealt by ``folders`` and sorted by ``order`` in each partition, to be written by folder.

    Partitions are cut or put together by their size after the shuffle, so a large folder fills several files and small ones share a
    task. Ranges would have to be sampled, which computes ``rows`` twice.
    """
    return rows.hint("rebalance", *folders).sortWithinPartitions(*order)


def new_folder(spark: SparkSession, below: str | None = None) -> str:
    """Name of a new folder."""
    return f"{(below or _run.get() or shared_folder(spark)).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session (tests) may go without; it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="corpusloom-")


_run: ContextVar[str | None] = ContextVar("run folder", default=None)


@contextmanager
def run_folder(spark: SparkSession, path: str | None = None):
    """Stored tables made inside lie below one folder, which is removed at the end.

    For flows that write their results before they leave: a DataFrame that still reads a stored table must not get out.
    """
    path = path or new_folder(spark)
    token = _run.set(path)
    try:
        yield path
    finally:
        _run.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
               unique: Column | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side that is usually small.

    Within the size bound the small side is broadcast and ``big`` is not moved.
    Beyond it both sides are shuffled on the keys plus a salt taken from
    ``unique`` (a per-row unique column of ``big``), so one hot key is spread
    over ``SALTS`` tasks.
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), keys, how)
    return big.join(small, keys, how) if unique is None else salted_join(big, small, keys, unique, how)


# Bits of a filter for each key it holds, and at most: 32 MB. With more keys it lets more rows through, and the exact step
# behind it has more to do.
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 28
_MAP = 32768  # bits in one value of bitmap_construct_agg


def mark_maybe(rows: DataFrame, keys: DataFrame, on: list[str], name: str = "_maybe") -> DataFrame:
    """Add boolean ``name``: false if the row's ``on`` is certainly not among ``keys``. Rows do not move.

    A Bloom filter of two bits a key, as broadcast bitmaps. ``keys`` is best a stored table; it is counted first.
    """
    bits, n = _MAP, keys.count()
    while bits < min(MOST_FILTER_BITS, FILTER_BITS * n):
        bits *= 2
    slots = [F.pmod(F.xxhash64(F.lit(salt), *on), F.lit(bits)) for salt in (1, 2)]
    maps = (keys.select(F.explode(F.array(*slots)).alias("slot")).groupBy(F.floor(F.col("slot") / _MAP).cast("int").alias("_page"))
            .agg(F.bitmap_construct_agg(F.col("slot") % _MAP).alias("_map")))
    for i, slot in enumerate(slots):
        byte = F.expr(f"cast(conv(hex(substring(_map, cast(_slot % {_MAP} div 8 as int) + 1, 1)), 16, 10) as int)")
        rows = (rows.withColumn("_slot", slot).withColumn("_page", F.floor(F.col("_slot") / _MAP).cast("int"))
                .join(F.broadcast(maps), "_page", "left")
                .withColumn(f"_hit{i}", F.coalesce(F.getbit(byte, (F.col("_slot") % 8).cast("int")) == 1, F.lit(False)))
                .drop("_slot", "_page", "_map"))
    return rows.withColumn(name, F.col("_hit0") & F.col("_hit1")).drop("_hit0", "_hit1")


def join_rare(big: DataFrame, small: DataFrame, keys: list[str], rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join wide rows with a side that few of them match. ``small`` is best a stored table.

    Within the size bound it is broadcast. Beyond it a filter goes over ``big`` first, so only rows that may match are shuffled.
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), keys)
    # Spark would take the size of a compressed file for that of a broadcast table.
    return mark_maybe(big, small.select(keys), keys).where("_maybe").drop("_maybe").join(small.hint("merge"), keys)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], unique: Column, how: str = "inner") -> DataFrame:
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Copies are not counted in Spark's estimate, which would broadcast millions of them.
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Keep the first row of each key.

    Spark limits the group inside every map task before the shuffle, so a hot
    key sends one row per task and not its whole group.
    """
    return top_k(df, keys, 1, *order, rank="_rn").drop("_rn")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, keys: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """Number every row of each key. For rows already cut to a bounded list per key."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
