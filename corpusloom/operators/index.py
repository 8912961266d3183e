"""Keyword index tables and the chunk table's incremental upkeep."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import rules
from corpusloom.functions.pieces import COUNTS, term_counter, token_batches
from corpusloom.functions.text import index_tokens, lower_text
from corpusloom.operators.common import WIDE_ROWS, first_per_key, laid_out
from corpusloom.schemas import CHUNK_FIELDS
from corpusloom.sources.files import path_exists


# Row of the vocabulary that carries the corpus totals; no token is empty.
TOTALS = ""


@dataclass
class KeywordIndex:
    """``postings(chunk_id, dl, term, tf)`` and ``vocabulary(term, df, length)``.

    ``df`` counts the chunks with the term. The row of the empty term has the
    number of chunks as ``df`` and their total token count as ``length``. ``buckets`` is the number of term
    buckets of stored postings; it is stored with them. ``blocks`` are those of ``pruned.keyword_blocks``, ``forward`` a
    stored ``forward_index``, where there are any.
    """

    postings: DataFrame
    vocabulary: DataFrame
    buckets: int | None = None
    blocks: DataFrame | None = None
    forward: DataFrame | None = None

    def write(self, path: str, term_buckets: int = 256) -> None:
        """Store both tables. Postings are laid out by term hash, so a search
        reads only the directories of its own terms. Partitions are cut by size
        (``common.laid_out``), so the postings of a hot term fill many files; in
        each, rows are sorted by term. Postings are computed once."""
        (laid_out(self.postings.withColumn("bucket", term_bucket(F.col("term"), term_buckets)), ["bucket"], "bucket", "term")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings"))
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        if self.blocks is not None:
            self.blocks.write.mode("overwrite").options(**WIDE_ROWS).parquet(f"{path}/blocks")
        layout = self.vocabulary.sparkSession.createDataFrame([(term_buckets,)], "buckets int")
        layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "KeywordIndex":
        postings = "chunk_id string, dl bigint, term string, tf bigint, bucket int"
        return KeywordIndex(
            spark.read.schema(postings).parquet(f"{path}/postings"),
            spark.read.schema("term string, df bigint, length bigint").parquet(f"{path}/vocabulary"),
            spark.read.schema("buckets int").parquet(f"{path}/layout").first()[0],
            spark.read.parquet(f"{path}/blocks") if path_exists(spark, f"{path}/blocks") else None)


@dataclass
class CorpusStats:
    n: int
    avgdl: float
    mean_idf: float


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def raw_idf(n, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def build_keyword_index(chunks: DataFrame) -> KeywordIndex:
    """Index tables as plans over ``chunks(chunk_id, text)``.

    Terms are counted inside the row, so postings are not shuffled before they are stored. The vocabulary
    explodes each row's distinct tokens, so its shuffle is one row per term and task.
    """
    tokens = chunks.select(index_tokens(F.col("text")).alias("tokens")).select(
        F.size("tokens").cast("long").alias("dl"), F.array_distinct("tokens").alias("terms"))
    return KeywordIndex(postings_of(forward_index(chunks.select("chunk_id", "text"))), vocabulary_of(tokens))


def forward_index(chunks: DataFrame) -> DataFrame:
    """``dl, terms, counts`` in place of ``text``: token count, distinct terms in order and how often each occurs.

    Stored beside the index, it tells what a chunk holds without its text being tokenised again.
    """
    kept = [c for c in chunks.columns if c != "text"]
    count = term_counter()
    return chunks.select(*kept, lower_text(F.col("text")).alias("text")).mapInArrow(
        lambda batches: count(token_batches(batches)), T.StructType([*chunks.select(*kept).schema.fields, *COUNTS.fields]))


def postings_of(forward: DataFrame) -> DataFrame:
    """``chunk_id, dl, term, tf`` of a forward index."""
    # Outer explodes: the arrays are never empty, and a plain explode would add an
    # emptiness test that runs the tokenizer twice.
    return forward.select("chunk_id", "dl", F.explode_outer(F.arrays_zip(F.col("terms"), F.col("counts"))).alias("p")).select(
        "chunk_id", "dl", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf"))


def vocabulary_of(forward: DataFrame) -> DataFrame:
    """``term, df, length`` of a forward index, with the row of totals."""
    terms = F.concat(F.array(F.lit(TOTALS)), "terms")
    return forward.select("dl", F.explode_outer(terms).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("dl").alias("length"))


def corpus_stats(vocabulary: DataFrame) -> CorpusStats:
    """Chunk count, mean length and mean idf: two one-row aggregates over a stored or cached table."""
    totals = vocabulary.where(F.col("term") == TOTALS).select("df", "length").first()
    n = totals["df"] if totals else 0
    words = vocabulary.where(F.col("term") != TOTALS)
    mean = words.agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]
    return CorpusStats(n, totals["length"] / n if n else 0.0, mean or 0.0)


def term_weights(vocabulary: DataFrame, stats: CorpusStats) -> DataFrame:
    """Okapi idf per term; terms in more than half of the chunks get a share of the mean."""
    raw = raw_idf(F.lit(stats.n), F.col("df"))
    return vocabulary.where(F.col("term") != TOTALS).select("term", "df", F.when(
        raw < 0, F.lit(stats.mean_idf * rules.BM25_EPSILON)).otherwise(raw).alias("idf"))


def filter_years(items: DataFrame, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Inclusive; with a bound set, rows without a year are dropped."""
    if year_from is not None:
        items = items.where(F.col("year") >= year_from)
    if year_to is not None:
        items = items.where(F.col("year") <= year_to)
    return items


def storable(chunks: DataFrame) -> DataFrame:
    return chunks.select(*CHUNK_FIELDS)


def upsert(existing: DataFrame, new: DataFrame, *order: Column) -> DataFrame:
    """New rows replace rows of the same ``chunk_id``. Of several new ones the last by ``order`` stays, in a full tie any one of
    the equal rows; without an order the row with the greatest hash, so that a rerun keeps the same."""
    last = first_per_key(new, ["chunk_id"], *[o.desc() for o in order], row_hash().desc())
    return existing.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(storable(last))


def row_hash() -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in CHUNK_FIELDS])


def changed_chunks(existing: DataFrame, new: DataFrame, compat: bool = False) -> DataFrame:
    """Chunks that are new or differ. ``compat`` compares the text only; the
    default also sees a change of title, year, tags or level."""
    if compat:
        old = existing.select("chunk_id", F.col("text").alias("_old"))
        return new.join(old, "chunk_id", "left").where(
            ~F.col("text").eqNullSafe(F.col("_old"))).select(*CHUNK_FIELDS)
    old = existing.select("chunk_id", row_hash().alias("_hash"))
    fresh = storable(new).withColumn("_hash", row_hash())
    return fresh.join(old, ["chunk_id", "_hash"], "left_anti").select(*CHUNK_FIELDS)


def stale_chunks(existing: DataFrame, live: DataFrame, compat: bool = False) -> DataFrame:
    """Chunks to prune. ``compat`` prunes only documents that are gone; the
    default also prunes the tail of a document that got shorter."""
    key = "doc_id" if compat else "chunk_id"
    return existing.join(live.select(key).distinct(), key, "left_anti")


def rebuild_incremental(existing: DataFrame, full: DataFrame, compat: bool = False) -> DataFrame:
    """The chunk table after an incremental rebuild from a full snapshot."""
    changed = changed_chunks(existing, full, compat)
    kept = existing.join(full.select("doc_id" if compat else "chunk_id").distinct(),
                         "doc_id" if compat else "chunk_id", "left_semi")
    return upsert(kept.select(*CHUNK_FIELDS), changed)


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """Vectors for ``texts(text)``, computing only those the cache lacks.

    ``cache(text_hash, vector)``; returns the enlarged cache. ``embed`` maps a
    text column to a vector column. A cache that lies in buckets of ``text_hash`` (``stored_by``) is not shuffled.
    """
    hashed = texts.select(F.sha2("text", 256).alias("text_hash"), "text")
    missing = hashed.join(cache.select("text_hash"), "text_hash", "left_anti")
    # One text per hash; the partitioning of the join is that of the groups, so texts move once.
    once = missing.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    return cache.unionByName(once.select("text_hash", embed(F.col("text")).alias("vector")))
