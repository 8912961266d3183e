"""Documents to traceable chunks."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import rules
from corpusloom.functions.pieces import cutter
from corpusloom.functions.text import is_blank, strip, text_or_empty
from corpusloom.schemas import CHUNK_FIELDS

_CARRIED = ["doc_id", "source", "title", "year", "url", "tags", "evidence_level"]


def merge_tiny_pieces(pieces: Column, min_chars: int = rules.CHUNK_MIN_CHARS) -> Column:
    """Join a piece to the one before it if either is short. Works inside the row."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, piece: Column) -> Column:
        cur = acc["cur"]
        join = (F.length(cur) < min_chars) | (F.length(piece) < min_chars)
        return F.struct(
            F.when(cur.isNull() | join, acc["done"]).otherwise(F.concat(acc["done"], F.array(cur))).alias("done"),
            F.when(cur.isNull(), piece).when(join, strip(F.concat_ws(" ", cur, piece))).otherwise(piece).alias("cur"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(
        F.concat(a["done"], F.array(a["cur"]))))


def docs_to_chunks(docs: DataFrame, max_chars: int = rules.CHUNK_MAX_CHARS, overlap: int = rules.CHUNK_OVERLAP,
                   merge_below: int | None = None) -> DataFrame:
    """Cut every document; a document without text gives one chunk with its title.

    With ``merge_below`` short pieces are merged before the pieces leave the
    row. Nothing is shuffled either way.
    """
    pieces = F.col("_pieces")
    cut = docs.select(*_CARRIED, cutter(max_chars, overlap)(text_or_empty(F.col("text"))).alias("_pieces"))
    cut = cut.withColumn("_pieces", F.when(F.size(pieces) > 0, pieces).otherwise(
        F.array(text_or_empty(F.col("title")))))
    if merge_below is not None:
        cut = cut.withColumn("_pieces", merge_tiny_pieces(pieces, merge_below))
    # Outer, because a plain explode makes Spark test the array for emptiness below
    # it, which runs the cutter a second time. The array is never empty here.
    rows = cut.select(*_CARRIED, F.posexplode_outer("_pieces").alias("chunk_index", "text"))
    return rows.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"))).select(*CHUNK_FIELDS)


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit("#c"), index.cast("string"))


def merge_tiny_chunks(chunks: DataFrame, min_chars: int = rules.CHUNK_MIN_CHARS) -> DataFrame:
    """The same merge for a chunk table that already exists.

    The sequential merge has a closed form. A chunk below ``min_chars`` always
    joins the one before it. A chunk of ``min_chars`` or more starts a new one,
    unless everything before it in the document, put together, is still short.
    So two window sums give the group of every chunk. A window holds the chunks
    of one document, which was one row before it was cut.
    """
    size = F.length("text")
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.sum(F.when(size > 0, size + 1).otherwise(0)).over(before) - 1
    big_before = F.coalesce(F.max(size >= min_chars).over(before), F.lit(False))
    first = F.row_number().over(order) == 1
    starts = first | ((size >= min_chars) & (big_before | (so_far >= min_chars)))
    grouped = chunks.withColumn("_starts", starts.cast("int")).withColumn("_group", F.sum("_starts").over(order) - 1)
    kept = [c for c in _CARRIED if c not in ("doc_id", "year", "url")]
    at = F.col("chunk_index")
    merged = grouped.groupBy("doc_id", "_group").agg(
        F.sort_array(F.collect_list(F.struct(at, F.col("text")))).alias("_texts"),
        *[F.min_by(c, at).alias(c) for c in kept],
        F.min_by("url", F.when(text_or_empty(F.col("url")) != "", at)).alias("url"),
        F.min_by("year", F.when(F.coalesce(F.col("year"), F.lit(0)) != 0, at)).alias("year"))
    texts = F.filter(F.transform("_texts", lambda t: t["text"]), lambda t: t != "")
    return merged.withColumns({
        "text": strip(F.array_join(texts, " ")),
        "url": text_or_empty(F.col("url")),
        "chunk_index": F.col("_group").cast("int"),
        "chunk_id": chunk_id(F.col("doc_id"), F.col("_group").cast("int")),
    }).select(*CHUNK_FIELDS)


def _flaws() -> dict[str, Column]:
    cid, did = text_or_empty(F.col("chunk_id")), text_or_empty(F.col("doc_id"))
    return {
        "missing_doc_id": is_blank(F.col("doc_id")),
        "missing_title": is_blank(F.col("title")),
        "missing_url": is_blank(F.col("url")),
        "missing_text": is_blank(F.col("text")),
        "bad_ids": is_blank(F.col("chunk_id")) | ~F.contains(cid, F.lit("#")),
        "mismatched_ids": (did != "") & (cid != "") & ~F.startswith(cid, did),
    }


def traceability(chunks: DataFrame) -> DataFrame:
    """One row of counts. A missing URL is reported but does not fail the check."""
    flaws = _flaws()
    counts = chunks.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flaws.items()])
    fatal = [n for n in flaws if n != "missing_url"]
    ok = F.lit(True)
    for name in fatal:
        ok = ok & (F.col(name) == 0)
    return counts.withColumn("ok", ok)


def traceability_samples(chunks: DataFrame, flaw: str, n: int = 10) -> DataFrame:
    """First ``n`` chunk ids with a flaw; a bounded top-n, never a full collect."""
    return chunks.where(_flaws()[flaw]).select("chunk_id").orderBy("chunk_id").limit(n)


def require_buildable(chunks: DataFrame, target_chunks: int = 500) -> DataFrame:
    """Traceability row that raises when the corpus may not be published."""
    report = traceability(chunks)
    return report.withColumn("ok", F.when(~F.col("ok"), F.raise_error(F.lit("chunk traceability failed")))
                             .when(F.col("total") < target_chunks, F.raise_error(F.concat(
                                 F.lit("too few chunks: "), F.col("total").cast("string"))))
                             .otherwise(F.col("ok")))
