"""Two arms of answers to the same questions, compared."""

from pyspark.sql import DataFrame, functions as F

from corpusloom.operators import audit, evaluate
from corpusloom.sources.files import write_lines


def compare_arms(items: DataFrame, rag: DataFrame, baseline: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row per item with the figures of both arms as structs ``rag`` and ``baseline``.

    ``items(id, track, gold_points)``; ``rag(question_id, answer, refused)`` with its ``contexts``; ``baseline(question_id,
    answer)`` without evidence. A refusal reports no contexts; an item without an answer counts as an empty one.
    """
    asked = items.withColumnRenamed("id", "question_id")
    checked = audit.verify_citations(
        asked.select("question_id").join(rag, "question_id", "left").withColumns({
            "answer": F.coalesce("answer", F.lit("")), "refused": F.coalesce("refused", F.lit(False))}), contexts)
    plain = asked.select("question_id").join(baseline.select("question_id", "answer"), "question_id", "left").select(
        "question_id", F.coalesce("answer", F.lit("")).alias("plain"))
    gold = F.col("gold_points")
    return asked.join(checked, "question_id").join(plain, "question_id").select(
        F.col("question_id").alias("id"), "track",
        F.struct(F.col("fake_citation_count"), "has_citations", "refused",
                 evaluate.gold_coverage(F.col("answer"), gold).alias("gold_coverage"),
                 F.when(F.col("refused"), 0).otherwise(F.col("n_contexts")).alias("n_contexts")).alias("rag"),
        F.struct(audit.baseline_fake_signal(F.col("plain")).alias("fake_citation_signal"),
                 evaluate.gold_coverage(F.col("plain"), gold).alias("gold_coverage")).alias("baseline"))


def write_evaluation(results: DataFrame, out: str) -> dict[str, DataFrame]:
    """Results, summary, differences and typical cases as JSON lines, the result table as text lines; all are returned as read back.

    The results are written first and everything else is taken from what was written.
    """
    spark = results.sparkSession
    write_lines(results, f"{out}/results")
    stored = spark.read.schema(results.schema).json(f"{out}/results")
    summary = evaluate.summarize(stored)
    made = {"summary": summary, "delta": evaluate.metric_delta(summary), "cases": evaluate.typical_cases(stored),
            "rubric": evaluate.rubric_template(stored), "table": evaluate.markdown_rows(stored)}
    for name, df in made.items():
        write_lines(df, f"{out}/{name}")
    return {"results": stored, **{n: spark.read.schema(df.schema).json(f"{out}/{n}") for n, df in made.items()}}
