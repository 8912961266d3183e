"""Exact deduplication by two Bloom filters, in DataFrame functions only.

Texts are equal when they agree after deletion of white space; their key is the SHA-256 of what is
left. Of equal texts the row with the most code points stays, then the smallest ``doc_id`` (null
last), then any one of the identical rows. A null text is empty; empty texts equal each other.

The first pass fills a counting filter: each key has two slots. Slots that were hit at least twice
form the second filter, a set of bitmaps. A key can be repeated only if both its slots are in
it. In the second pass rows that fail this test are single and go straight on; the others, and a
few false positives, are shuffled and compared by the whole key.

The bitmaps are broadcast. Their size follows the number of rows, ``BITS_PER_ROW`` each, up to
``max_bits`` (32 MB by default); beyond that more rows count as possibly repeated and are shuffled,
with the same result.
"""

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.base import join_groups, stored

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
_BUCKET = 32768  # bits in one bitmap of bitmap_construct_agg


def with_key(docs: DataFrame) -> DataFrame:
    """Add ``__sha`` and ``__len`` (code points of the original text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("__sha", F.sha2(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""), 256))
            .withColumn("__len", F.length(text)))


def _slots(bits: int):
    return [F.pmod(F.xxhash64("__sha", F.lit(salt)), F.lit(bits)) for salt in (1, 2)]


def repeat_filter(keys: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Bitmaps of the slots that ``keys.__sha`` hits at least twice: (bucket, bitmap), and the number of bits."""
    bits = _BUCKET
    while bits < min(max_bits, BITS_PER_ROW * rows):
        bits *= 2
    again = (keys.select(F.explode(F.array(*_slots(bits))).alias("slot"))
             .groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"))
    maps = (again.groupBy(F.expr(f"cast(slot div {_BUCKET} as int)").alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.col("slot") % _BUCKET).alias("__map")))
    return maps, bits


def mark_possible(rows: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """Add boolean ``__again``: both slots of ``__sha`` are set. Rows do not move."""
    for i, slot in enumerate(_slots(bits)):
        bit = F.expr(f"shiftright(cast(conv(hex(substring(__map, cast(__slot % {_BUCKET} div 8 as int) + 1, 1)), 16, 10)"
                     f" as int), cast(__slot % 8 as int)) & 1")
        rows = (rows.withColumn("__slot", slot).withColumn("__bucket", F.expr(f"cast(__slot div {_BUCKET} as int)"))
                .join(F.broadcast(maps), "__bucket", "left")
                .withColumn(f"__hit{i}", F.col("__map").isNotNull() & (bit == 1)).drop("__slot", "__bucket", "__map"))
    return rows.withColumn("__again", F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def decisions(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of identical rows (same doc_id and text) one has ``kept``. An empty table gives no rows.
    """
    keyed = stored(with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
                   .select("doc_id", "__sha", "__len", F.monotonically_increasing_id().alias("__row")))
    total = keyed.count()
    maps, bits = repeat_filter(keyed, total, max_bits)
    marked = mark_possible(keyed, stored(maps), bits)
    single = marked.where(~F.col("__again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    possible = marked.where("__again").drop("__again")
    groups = possible.groupBy("__sha").agg(
        F.max_by(F.struct("doc_id", "__row"), F.struct("__len", F.bitwise_not("doc_id"), F.bitwise_not("__row"))).alias("__keep"),
        F.count(F.lit(1)).alias("group_size"))
    joined = join_groups(possible, groups, "__sha", F.col("group_size"), total, "inner")
    return single.unionByName(joined.select(
        "doc_id", F.col("__keep.doc_id").alias("keep_id"), "group_size",
        (F.col("__row") == F.col("__keep.__row")).alias("kept"), F.col("__sha").alias("text_sha256")))


def keep_first(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns.

    Possibly repeated rows are cut to the best of each key inside every map task before they are
    shuffled, so a hot text sends one row per task.
    """
    keys = stored(with_key(docs.select("text")).select("__sha"))
    maps, bits = repeat_filter(keys, keys.count(), max_bits)
    rows = with_key(docs.select(F.struct("*").alias("doc"), "doc_id", "text")).drop("text")
    marked = mark_possible(rows, stored(maps), bits)
    best = Window.partitionBy("__sha").orderBy(F.col("__len").desc(), F.col("doc_id").asc_nulls_last())
    first = marked.where("__again").withColumn("__rank", F.row_number().over(best)).where("__rank = 1")
    return marked.where(~F.col("__again")).select("doc.*").unionByName(first.select("doc.*"))
