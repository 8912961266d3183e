"""Evaluation metrics and rollups."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import text_or_empty
from corpusloom.operators.common import top_k

RUBRIC = ["completeness", "relevance", "readability", "unsafe_advice"]


def gold_coverage(answer: Column, gold: Column) -> Column:
    """Share of gold points found in the answer, ignoring case; 0 without gold points."""
    low = F.lower(text_or_empty(answer))
    hits = F.size(F.filter(gold, lambda g: F.contains(low, F.lower(g))))
    return F.when(F.coalesce(F.size(gold), F.lit(0)) <= 0, F.lit(0.0)).otherwise(hits / F.size(gold))


def summarize(results: DataFrame) -> DataFrame:
    """One row for the two arms. ``results`` has ``rag`` and ``baseline`` structs.

    ``rag_empty_context_cases`` counts refusals as well, since a refusal reports
    no contexts.
    """
    n = F.greatest(F.count("*"), F.lit(1))

    def rate(c: Column) -> Column:
        return F.round(F.coalesce(F.sum(c.cast("double")), F.lit(0.0)) / n, 3)

    return results.agg(
        F.count("*").alias("n"),
        rate(F.col("rag.fake_citation_count") > 0).alias("rag_fake_citation_rate"),
        rate(F.col("baseline.fake_citation_signal") > 0).alias("baseline_fake_citation_signal_rate"),
        rate(F.col("rag.has_citations")).alias("rag_citation_coverage"),
        rate(F.col("rag.refused")).alias("rag_refusal_rate"),
        rate(F.col("rag.gold_coverage")).alias("rag_avg_gold_coverage"),
        rate(F.col("baseline.gold_coverage")).alias("baseline_avg_gold_coverage"),
        F.count_if(F.col("rag.n_contexts") == 0).alias("rag_empty_context_cases"))


def metric_delta(summary: DataFrame) -> DataFrame:
    """Retrieval arm minus baseline arm."""
    return summary.select(
        F.round(F.col("rag_fake_citation_rate") - F.col("baseline_fake_citation_signal_rate"), 3)
        .alias("fake_citation_delta"),
        F.round(F.col("rag_avg_gold_coverage") - F.col("baseline_avg_gold_coverage"), 3)
        .alias("gold_coverage_delta"))


def assessment_checks(records: DataFrame, citations: DataFrame, known: DataFrame) -> DataFrame:
    """Three checks per record plus ``passed``.

    ``records(question_id, refused, must_cite, expect_refusal)``,
    ``citations(question_id, doc_id)``, ``known(doc_id)`` — topic pages included.
    """
    unknown = citations.join(known.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("question_id").agg(
        F.count("*").alias("unknown"))
    counted = citations.groupBy("question_id").agg(F.count("*").alias("citation_count"))
    rows = records.join(counted, "question_id", "left").join(unknown, "question_id", "left")
    n = F.coalesce(F.col("citation_count"), F.lit(0))
    rows = rows.withColumns({
        "citation_count": n,
        "cite_present": F.col("refused") | ~F.col("must_cite") | (n > 0),
        "cite_ids_valid": F.coalesce(F.col("unknown"), F.lit(0)) == 0,
        "refuse_correct": F.col("refused") == F.col("expect_refusal"),
    }).drop("unknown")
    return rows.withColumn("passed", F.col("cite_present") & F.col("cite_ids_valid") & F.col("refuse_correct"))


def assessment_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def typical_cases(results: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` results of each case class, by id."""
    case = (F.when(F.col("rag.refused"), "refusal")
            .when(F.col("baseline.fake_citation_signal") > F.col("rag.fake_citation_count"), "fake_citation_contrast")
            .when(F.col("rag.gold_coverage") < F.col("baseline.gold_coverage"), "retrieval_drag")
            .otherwise("plain"))
    return top_k(results.withColumn("case_class", case), ["case_class"], n, F.col("id"), rank="n")


def rubric_template(results: DataFrame) -> DataFrame:
    """One line per result and rubric dimension, score and reviewer left open."""
    return results.select(
        "id", F.explode(F.array(*[F.lit(r) for r in RUBRIC])).alias("dimension"),
        F.lit(None).cast("int").alias("score"), F.lit("").alias("reviewer"))


def markdown_rows(results: DataFrame) -> DataFrame:
    """Table line of each result, ordered by id when written. Shares have two digits, ties to even."""
    def yes(c: Column) -> Column:
        return F.when(c, "True").otherwise("False")

    return results.select("id", F.concat_ws(
        "", F.lit("| "), F.col("id").cast("string"), F.lit(" | "), F.col("track"), F.lit(" | "),
        F.col("rag.fake_citation_count").cast("string"), F.lit(" | "),
        F.col("baseline.fake_citation_signal").cast("string"), F.lit(" | "),
        F.format_number(F.col("rag.gold_coverage"), 2), F.lit(" | "),
        F.format_number(F.col("baseline.gold_coverage"), 2), F.lit(" | "), yes(F.col("rag.refused")),
        F.lit(" |")).alias("line"))
