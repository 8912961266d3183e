"""Search store upkeep as documents land: a file stream with a batch body.

Chunks, vectors and keyword index change together, one segment a batch (``operators.search_store``). The store remembers the last
batch of every stream, so a restarted stream may repeat its last batch.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators import search_store
from corpusloom.operators.common import first_per_key
from corpusloom.operators.search_store import BUCKETS
from corpusloom.schemas import DOC


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return search_store.snapshot(spark, path).chunks


def newest(docs: DataFrame) -> DataFrame:
    """One row per document: the last arrival wins, in one file the last place."""
    return first_per_key(docs, ["doc_id"], *[F.col(c).desc() for c in ("landed", "pos") if c in docs.columns], F.xxhash64("title", "text"))


def apply_documents(docs: DataFrame, path: str, buckets: int = BUCKETS, batch: tuple[str, int] | None = None, embed=None) -> int:
    """Replace the chunks, vectors and postings of every document in ``docs``; returns the version."""
    return search_store.apply_documents(docs.sparkSession, path, newest(docs), embed=embed, batch=batch, buckets=buckets)


def stream_documents(spark: SparkSession, landing: str, path: str, checkpoint: str, buckets: int = BUCKETS,
                     embed=None, compact_every: int = 16) -> StreamingQuery:
    """Keep the search store up to date with JSON-line documents landing in ``landing``; every so many batches the youngest
    segments are merged."""
    arrivals = spark.readStream.schema(DOC).json(landing).withColumns({
        "landed": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start")})

    def body(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            place = F.struct("_file", "_block", F.monotonically_increasing_id().alias("row"))
            apply_documents(batch.withColumn("pos", place).drop("_file", "_block"), path, buckets, (checkpoint, batch_id), embed)
        if compact_every and batch_id % compact_every == compact_every - 1:
            search_store.compact(batch.sparkSession, path)

    return (arrivals.writeStream.foreachBatch(body).option("checkpointLocation", f"{checkpoint}/state")
            .trigger(availableNow=True).start())
