"""Chunk table, vectors and keyword index kept together, in segments that are merged on read.

A batch of documents becomes one segment below the store's folder:

* ``chunks`` of the new documents, by hash buckets of ``doc_id``, and ``vectors``, by source and year;
* ``forward``: terms and counts of each chunk, in the same buckets; ``postings``, in buckets of terms;
* ``gone``: documents of earlier segments that the batch replaces or removes;
* ``vocabulary``: changes of document frequencies and lengths. What goes is subtracted, read from ``forward`` in the buckets of
  the batch, so no text of the corpus is read or tokenised again.

A row counts if no later segment has its document in ``gone``; document frequencies are sums. So search over a snapshot equals search
over tables that are built anew. Segments grow in size towards the past (``compact``), which bounds their number by a logarithm.
Publishing is one manifest (``versions``): a crash at any point leaves the version before.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import rules
from corpusloom.functions.pieces import embedder
from corpusloom.functions.text import text_or_empty
from corpusloom.operators import versions
from corpusloom.operators.chunk import docs_to_chunks, require_buildable
from corpusloom.operators.common import join_small, laid_out
from corpusloom.operators.index import (
    KeywordIndex, filter_years, forward_index, postings_of, storable, term_bucket, vocabulary_of,
)
from corpusloom.schemas import CHUNK, CHUNK_FIELDS

BUCKETS = 64
TERM_BUCKETS = 256
# A segment takes part in a compaction if it is at most so many times as large as all later ones together.
RATIO = 4

_BUCKET = T.StructField("bucket", T.IntegerType())
SCHEMAS = {
    "chunks": T.StructType([*CHUNK.fields, _BUCKET]),
    "vectors": "chunk_id string, doc_id string, source string, year int, vector array<double>, shelf string",
    "forward": "chunk_id string, doc_id string, dl bigint, terms array<string>, counts array<bigint>, bucket int",
    "postings": "chunk_id string, dl bigint, term string, tf bigint, bucket int",
    "vocabulary": "term string, df bigint, length bigint",
    "gone": "doc_id string",
}
_EMPTY = {"version": 0, "segments": [], "batches": {}}


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def shelf_of(source: Column) -> Column:
    """Folder of a source; a blank one has a name too."""
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("_none"))


def owner(chunk_id: Column) -> Column:
    """The document of a chunk: its id up to the last ``#c``."""
    return F.left(chunk_id, F.length(chunk_id) - F.length(F.substring_index(chunk_id, "#c", -1)) - 2)


@dataclass
class Snapshot:
    """The tables of one version. They stay as they are while newer versions are published."""

    spark: SparkSession
    path: str
    body: dict

    @property
    def version(self) -> int:
        return self.body["version"]

    def part(self, name: str, segment: int) -> DataFrame:
        folder = self.body["segments"][segment]["folder"]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{folder}/{name}")

    def live(self, name: str, first: int = 0, narrow=lambda df: df, doc_id: Column | None = None) -> DataFrame:
        """Rows of a table in the segments from ``first`` on that no later one of these has replaced; ``narrow`` filters each part."""
        parts = range(first, len(self.body["segments"]))
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        tombs = [self.part("gone", s).withColumn("_until", F.lit(s)) for s in parts if s > first and self.body["segments"][s]["gone"]]
        newest = narrow(self.part(name, parts[-1]))
        if not tombs:
            return reduce(DataFrame.unionByName, [narrow(self.part(name, s)) for s in parts[:-1]] + [newest])
        last = reduce(DataFrame.unionByName, tombs).groupBy(F.col("doc_id").alias("_doc")).agg(F.max("_until").alias("_until"))
        rows = reduce(DataFrame.unionByName, [narrow(self.part(name, s)).withColumn("_at", F.lit(s)) for s in parts[:-1]])
        rows = rows.withColumn("_doc", F.col("doc_id") if doc_id is None else doc_id)
        kept = join_small(rows, last, ["_doc"], "left").where("_until is null or _until <= _at")
        return kept.drop("_doc", "_until", "_at").unionByName(newest)

    @property
    def chunks(self) -> DataFrame:
        return self.live("chunks").select(*CHUNK_FIELDS)

    @property
    def vectors(self) -> DataFrame:
        return self.live("vectors").drop("shelf")

    def vectors_of(self, source: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
        """Vectors of one source, of some years: other sources' folders are not listed, and of what is left only the row groups
        whose years overlap are read, because files are cut and sorted by year."""
        def narrow(rows: DataFrame) -> DataFrame:
            if source is not None:
                rows = rows.where((F.col("shelf") == shelf_of(F.lit(source))) & (F.col("source") == source))
            return filter_years(rows, year_from, year_to)

        return self.live("vectors", narrow=narrow).drop("shelf")

    @property
    def forward(self) -> DataFrame:
        return self.live("forward")

    def vocabulary(self, first: int = 0) -> DataFrame:
        parts = [self.part("vocabulary", s) for s in range(first, len(self.body["segments"]))]
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS["vocabulary"])
        if len(parts) == 1:
            return parts[0]
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where(
            "df <> 0 or length <> 0")

    @property
    def keyword_index(self) -> KeywordIndex:
        return KeywordIndex(self.live("postings", doc_id=owner(F.col("chunk_id"))), self.vocabulary(),
                            self.body["term_buckets"] if self.body["segments"] else None,
                            forward=self.forward if self.body["segments"] else None)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The last version, or the given one; an empty store has version 0."""
    return Snapshot(spark, path, versions.manifest(spark, path, version) or dict(_EMPTY))


def apply_documents(spark: SparkSession, path: str, docs: DataFrame, removed: DataFrame | None = None, embed=None,
                    batch: tuple[str, int] | None = None, buckets: int = BUCKETS, term_buckets: int = TERM_BUCKETS) -> int:
    """Add or replace ``docs`` (one row per ``doc_id``), remove the documents of ``removed(doc_id)``; returns the version.

    ``batch`` names a stream and its batch number: a batch that the store already has changes nothing. The numbers of buckets
    count for a new store only.
    """
    chunks = storable(docs_to_chunks(docs, merge_below=rules.CHUNK_MIN_CHARS))
    return apply_chunks(spark, path, chunks, docs.select("doc_id"), removed, embed, batch, buckets, term_buckets)


def apply_chunks(spark: SparkSession, path: str, chunks: DataFrame, replaced: DataFrame, removed: DataFrame | None = None, embed=None,
                 batch: tuple[str, int] | None = None, buckets: int = BUCKETS, term_buckets: int = TERM_BUCKETS) -> int:
    """The same from finished chunks of the documents ``replaced(doc_id)``."""
    now = snapshot(spark, path)
    done = now.body["batches"]
    if batch is not None and done.get(batch[0], -1) >= batch[1]:
        return now.version
    body = {"buckets": now.body.get("buckets", buckets), "term_buckets": now.body.get("term_buckets", term_buckets)}
    folder = versions.new_segment(path)
    out = f"{path}/{folder}"
    stored, forward = _put_chunks(chunks, out, embed, **body)
    ids = replaced.select("doc_id") if removed is None else replaced.select("doc_id").unionByName(removed.select("doc_id"))
    going = _going(now, ids, body["buckets"])
    gone = versions.put(going.select("doc_id").distinct(), f"{out}/gone")
    change = vocabulary_of(forward).unionByName(vocabulary_of(going).select(
        "term", (-F.col("df")).alias("df"), (-F.col("length")).alias("length")))
    versions.put(change.groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length")).where(
        "df <> 0 or length <> 0"), f"{out}/vocabulary")
    segment = {"folder": folder, "rows": stored.count(), "gone": gone.count()}
    batches = done if batch is None else done | {batch[0]: batch[1]}
    return versions.publish(spark, path, body | {"segments": [*now.body["segments"], segment], "batches": batches}, now.version)


def replace_chunks(spark: SparkSession, path: str, chunks: DataFrame, embed=None, target_chunks: int | None = None,
                   buckets: int = BUCKETS, term_buckets: int = TERM_BUCKETS) -> int:
    """Make ``chunks`` the whole store. With ``target_chunks`` it is published only if traceability holds and it has so many rows."""
    now = snapshot(spark, path)
    body = {"buckets": buckets, "term_buckets": term_buckets}
    folder = versions.new_segment(path)
    out = f"{path}/{folder}"
    stored, forward = _put_chunks(chunks, out, embed, **body, least=target_chunks)
    versions.put(stored.select("doc_id").limit(0), f"{out}/gone")
    versions.put(vocabulary_of(forward), f"{out}/vocabulary")
    segment = {"folder": folder, "rows": stored.count(), "gone": 0}
    return versions.publish(spark, path, body | {"segments": [segment], "batches": {}}, now.version)


def _going(now: Snapshot, ids: DataFrame, buckets: int) -> DataFrame:
    """Live rows of ``forward`` of the given documents; only their buckets are read."""
    if not now.body["segments"]:
        return now.live("forward")
    touched = [r[0] for r in ids.select(bucket_of(F.col("doc_id"), buckets)).distinct().collect()]
    rows = now.live("forward", narrow=lambda df: df.where(F.col("bucket").isin(touched)))
    return join_small(rows, ids.distinct(), ["doc_id"], "left_semi")


def _put_chunks(chunks: DataFrame, out: str, embed, buckets: int, term_buckets: int,
                least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Write the tables that follow from chunks alone, each computed once. Files are cut by size, so a large bucket fills several."""
    bucket = bucket_of(F.col("doc_id"), buckets).alias("bucket")
    stored = versions.put(laid_out(chunks.select(*CHUNK_FIELDS, bucket), ["bucket"], "bucket", "chunk_id"), f"{out}/chunks", "bucket")
    if least is not None:
        require_buildable(stored, least).collect()
    vector = (embed or embedder())(text_or_empty(F.col("text"))).cast("array<double>").alias("vector")
    vectors = stored.select("chunk_id", "doc_id", "source", "year", vector, shelf_of(F.col("source")).alias("shelf"))
    versions.put(laid_out(vectors, ["shelf", "year"], "shelf", "year", "chunk_id"), f"{out}/vectors", "shelf")
    # In the buckets of the chunks, whose files are read one by one.
    forward = versions.put(forward_index(stored.select("chunk_id", "doc_id", "text", "bucket")).select(
        "chunk_id", "doc_id", "dl", "terms", "counts", "bucket"), f"{out}/forward", "bucket")
    postings = postings_of(forward).withColumn("bucket", term_bucket(F.col("term"), term_buckets))
    versions.put(laid_out(postings, ["bucket"], "bucket", "term"), f"{out}/postings", "bucket")
    return stored, forward


def compactable(segments: list[dict], ratio: float = RATIO) -> int:
    """The first segment of the longest tail in which each is at most ``ratio`` times as large as all later ones together."""
    first, later = len(segments), 0
    for i in reversed(range(len(segments))):
        size = segments[i]["rows"] + segments[i]["gone"]
        if i < len(segments) - 1 and size > ratio * later:
            break
        first, later = i, later + size
    return first


def compact(spark: SparkSession, path: str, ratio: float = RATIO) -> int:
    """Merge the youngest segments into one (``compactable``); earlier ones are not read. Returns the version."""
    now = snapshot(spark, path)
    segments = now.body["segments"]
    first = compactable(segments, ratio)
    if len(segments) - first < 2:
        return now.version
    folder = versions.new_segment(path)
    out = f"{path}/{folder}"
    chunks = versions.put(laid_out(now.live("chunks", first), ["bucket"], "bucket", "chunk_id"), f"{out}/chunks", "bucket")
    versions.put(laid_out(now.live("vectors", first), ["shelf", "year"], "shelf", "year", "chunk_id"), f"{out}/vectors", "shelf")
    versions.put(laid_out(now.live("forward", first), ["bucket"], "bucket", "chunk_id"), f"{out}/forward", "bucket")
    postings = now.live("postings", first, doc_id=owner(F.col("chunk_id")))
    versions.put(laid_out(postings, ["bucket"], "bucket", "term"), f"{out}/postings", "bucket")
    dead = reduce(DataFrame.unionByName, [now.part("gone", s) for s in range(first, len(segments))]).distinct()
    gone = versions.put(dead if first else dead.limit(0), f"{out}/gone")
    versions.put(now.vocabulary(first), f"{out}/vocabulary")
    segment = {"folder": folder, "rows": chunks.count(), "gone": gone.count()}
    return versions.publish(spark, path, now.body | {"segments": [*segments[:first], segment]}, now.version)
