"""Supplied answers checked and worded for their readers."""

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.functions.wording import audit_note, mentions_dose, plain_terms
from corpusloom.operators.audit import verify_citations
from corpusloom.operators.gate import action_tips


def finish_answers(answers: DataFrame, contexts: DataFrame, terms=rules.PLAIN_TERMS, amount=rules.DOSE_AMOUNT_PATTERN,
                   dose_words=rules.DOSE_WORDS, warning: str = rules.DOSE_WARNING, **tips) -> DataFrame:
    """``answers(question_id, answer, track[, refused])`` and the contexts they may cite -> the audited answers.

    Claims that cannot be verified are listed below the answer. Nutrition answers get plain terms, a warning where they
    mention a dose, and ``tips``, advice from the contexts (``**tips`` goes to ``action_tips``). Refusals stay as they are.
    """
    audited = verify_citations(answers, contexts)
    refused = F.coalesce(F.col("refused"), F.lit(False)) if "refused" in answers.columns else F.lit(False)
    noted = audit_note(*[F.col(c) for c in ("answer", "ok", "invalid_brackets", "fake_pmids", "fake_ncts", "fake_docs")])
    plain = plain_terms(noted, terms)
    warned = F.when(mentions_dose(plain, amount, dose_words), F.concat(F.rtrim(plain), F.lit(warning))).otherwise(plain)
    nutrition = (F.col("track") == "nutrition") & ~refused
    listed = action_tips(contexts, **tips).groupBy("question_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n", "tip"))), lambda t: t["tip"]).alias("_tips"))
    none = F.array().cast("array<string>")
    return audited.withColumn("answer", F.when(refused, F.col("answer")).when(nutrition, warned).otherwise(noted)).join(
        listed, "question_id", "left").withColumn("tips", F.when(nutrition, F.coalesce("_tips", none)).otherwise(none)).drop("_tips")
