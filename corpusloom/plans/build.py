"""The corpus build: sources to documents, reports, topic pages and chunk table."""

import json

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.operators import chunk, curate, index, pruned, report, retrieve, search_store, topics
from corpusloom.operators.common import run_folder, stored
from corpusloom.schemas import DOC_FIELDS
from corpusloom.sources.files import file_list, stage_counts


def curate_sources(*sources: DataFrame, regrade: bool = True) -> DataFrame:
    """Curated sources first. First-wins merge, fold dedupe, optional regrading."""
    return curate_landed(land(*sources), regrade)


def land(*sources: DataFrame) -> DataFrame:
    """The sources one after the other, parsed once and stored; all that follows reads this table."""
    return stored(curate.union_sources(*sources))


def curate_landed(landed: DataFrame, regrade: bool = True) -> DataFrame:
    docs = curate.dedupe_fold(curate.merge_first_wins(landed))
    return curate.grade_from_text(docs) if regrade else docs


def source_counts(landed: DataFrame, sources: int) -> DataFrame:
    """Rows ``stage, n`` of every source, from the positions alone; a source without rows has 0."""
    names = landed.sparkSession.range(sources).select(F.col("id").cast("int").alias("source"))
    counted = landed.groupBy(F.col("ord.source").alias("source")).agg(F.count("*").alias("n"))
    return names.join(F.broadcast(counted), "source", "left").select(
        F.concat(F.lit("source_"), F.col("source").cast("string")).alias("stage"), F.coalesce("n", F.lit(0)).alias("n"))


def write_search_tables(chunks: DataFrame, out: str, embed=None) -> None:
    """Vector table, forward index and keyword index of a stored chunk table; texts are tokenised once."""
    retrieve.vector_table(chunks, embed).write.mode("overwrite").parquet(f"{out}/vectors")
    index.forward_index(chunks.select("chunk_id", "text")).write.mode("overwrite").parquet(f"{out}/forward")
    forward = chunks.sparkSession.read.parquet(f"{out}/forward")
    index.KeywordIndex(index.postings_of(forward), index.vocabulary_of(forward), blocks=pruned.keyword_blocks(forward)).write(f"{out}/keyword_index")


def build_corpus(sources: list[DataFrame], out: str, updated_at: str, topic_rows=rules.TOPICS, regrade: bool = True,
                 target_chunks: int = 500, prose=None, embed=None, paths: list[str] | None = None) -> dict:
    """Write every table of the corpus below ``out`` and return them as read back, with the vector table as
    ``vectors`` and the ``keyword_index`` for ``ask_batch``.

    Chunks, vectors and keyword index are one version of the search store ``{out}/search``, published only if traceability
    holds and there are at least ``target_chunks`` chunks; until then readers see the version before. ``paths`` are the landed folders of the sources; their files are listed in the manifest.
    Intermediate tables lie in a folder of the run's own and are removed with it.
    """
    with run_folder(sources[0].sparkSession, f"{out}/_run"):
        return _build(sources, out, updated_at, topic_rows, regrade, target_chunks, prose, embed, paths or [])


def _build(sources, out, updated_at, topic_rows, regrade, target_chunks, prose, embed, paths) -> dict:
    spark = sources[0].sparkSession

    def put(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    parsed = land(*sources)
    docs = put("documents", curate_landed(parsed, regrade))
    summary = put("report", report.corpus_report(docs))
    blocks = topics.evidence_lines(docs, topics.topic_table(spark, topic_rows))
    pages = put("topic_pages", topics.render_pages(blocks, updated_at, prose))
    # Pages follow the documents; an equal id or title keeps the document.
    last = F.struct(F.lit((1 << 31) - 1).alias("source"), F.col("slug").alias("file"), F.lit(0).cast("long").alias("block"),
                    F.lit(0).cast("long").alias("row"), F.array().cast("array<int>").alias("place"))
    with_pages = docs.select(*DOC_FIELDS, "ord").unionByName(pages.select(*DOC_FIELDS, last.alias("ord")))
    all_docs = put("documents_with_pages", curate.dedupe_fold(curate.merge_first_wins(with_pages)))
    topics.write_topic_files(pages, f"{out}/topics")
    chunks = index.storable(chunk.docs_to_chunks(all_docs, merge_below=rules.CHUNK_MIN_CHARS))
    search_store.replace_chunks(spark, f"{out}/search", chunks, embed, target_chunks)
    now = search_store.snapshot(spark, f"{out}/search")
    table = now.chunks
    stats = put("store_stats", report.store_stats(table))
    manifest = source_counts(parsed, len(sources)).unionByName(stage_counts({
        "documents": docs, "topic_pages": pages, "documents_with_pages": all_docs, "chunks": table}))
    config = {"regrade": regrade, "target_chunks": target_chunks, "topics": len(topic_rows), "paths": paths}
    manifest = put("manifest", manifest.withColumns({"updated_at": F.lit(updated_at), "config": F.lit(json.dumps(config))}))
    landed = None
    for path in paths:
        landed = file_list(spark, path) if landed is None else landed.unionByName(file_list(spark, path))
    files = {} if landed is None else {"files": put("files", landed)}
    return {"documents": docs, "report": summary, "topic_pages": pages, "documents_with_pages": all_docs,
            "chunks": table, "store_stats": stats, "manifest": manifest, **files,
            "vectors": now.vectors, "keyword_index": now.keyword_index, "forward": now.forward}
