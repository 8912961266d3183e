"""Corpus and chunk-table reports. Every figure is an aggregate with map-side combine."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import is_blank, text_or_empty


def distribution(docs: DataFrame, by: Column, name: str = "key") -> DataFrame:
    """Count and percent of the total per value; the empty value is its own row."""
    total = docs.agg(F.count("*").alias("t")).scalar()
    return docs.groupBy(by.alias(name)).agg(F.count("*").alias("n")).withColumn(
        "pct", F.round(100.0 * F.col("n") / total, 1))


def tag_frequency(docs: DataFrame, limit: int | None = 10) -> DataFrame:
    total = docs.agg(F.count("*").alias("t")).scalar()
    counted = docs.select(F.explode(_tags()).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).withColumn(
        "pct", F.round(100.0 * F.col("n") / total, 1))
    ordered = counted.orderBy(F.col("n").desc(), F.col("tag"))
    return ordered.limit(limit) if limit else ordered


def quality_counts(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count("*").alias("total"), F.count_distinct("source").alias("n_sources"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.count_if(is_blank(F.col("text"))).alias("missing_text"),
        F.count_if(F.col("year").isNull()).alias("missing_year"),
        F.count_if(text_or_empty(F.col("doi")) != "").alias("with_doi"))


def missing_text_sample(docs: DataFrame, n: int = 20) -> DataFrame:
    return docs.where(is_blank(F.col("text"))).select("doc_id", "ord").orderBy("ord").limit(n)


def corpus_report(docs: DataFrame) -> DataFrame:
    """Long table ``section, key, n, pct`` of all distributions.

    Each document is expanded to its (section, key) pairs and counted once; the
    expansion is narrow and combined before the shuffle. The total is a plain
    count of the table, which reads no column. Absent tags are no tags.
    """
    pairs = F.concat(
        F.array(
            _pair("source", F.col("source")), _pair("year", F.col("year").cast("string")),
            _pair("level", F.col("evidence_level")), _pair("all", F.lit("total"))),
        F.array_compact(F.array(
            F.when(is_blank(F.col("text")), _pair("missing", F.lit("text"))),
            F.when(F.col("year").isNull(), _pair("missing", F.lit("year"))),
            F.when(text_or_empty(F.col("doi")) != "", _pair("present", F.lit("doi"))))),
        F.transform(_tags(), lambda t: _pair("tag", t)))
    counted = docs.select(F.explode(pairs).alias("p")).groupBy("p.section", "p.key").agg(F.count("*").alias("n"))
    total = docs.agg(F.count("*").alias("t")).scalar()
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / total, 1))


def _tags() -> Column:
    return F.coalesce(F.col("tags"), F.array().cast("array<string>"))


def _pair(section: str, key: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), F.coalesce(key, F.lit("unknown")).alias("key"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """Chunk and document counts overall and by source, level and year: one pass, grouping sets.

    Documents are counted exactly, so the aggregate first reduces to distinct
    (dimension, document) pairs inside the map tasks.
    """
    dims = chunks.select(
        "doc_id", F.explode(F.array(
            _pair("all", F.lit("total")), _pair("source", F.col("source")),
            _pair("level", F.col("evidence_level")), _pair("year", F.col("year").cast("string")))).alias("p"))
    per_doc = dims.groupBy("p.section", "p.key", "doc_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("section", "key").agg(F.sum("n").alias("chunks"), F.count("*").alias("docs"))


def report_markdown(report: DataFrame, title: str, generated_at: str) -> DataFrame:
    """Markdown lines of a report table. The table is an aggregate, one row per key."""
    line = F.concat(F.lit("| "), F.col("section"), F.lit(" | "), F.col("key"), F.lit(" | "),
                    F.col("n").cast("string"), F.lit(" | "), F.format_string("%.1f%%", F.col("pct")), F.lit(" |"))
    spark = report.sparkSession
    head = [f"# {title}", "", f"- {generated_at}", "", "| section | key | n | pct |", "|---|---|---|---|"]
    heading = spark.createDataFrame(list(enumerate(head)), "at int, value string").select(
        "at", F.lit("").alias("section"), F.lit("").alias("key"), "value")
    body = report.select(F.lit(len(head)).alias("at"), "section", "key", line.alias("value"))
    return heading.unionByName(body).orderBy("at", "section", "key").select("value")
