"""Question gates, evidence packs, and fresh documents put in front of them."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import contains_any, cut, head, or_else, overlap_ratio, text_or_empty, word_set
from corpusloom.functions.wording import evidence_block
from corpusloom.operators.common import top_k

SNIPPET_CHARS = 240


def out_of_scope(question: Column, words=rules.OUT_OF_SCOPE) -> Column:
    return contains_any(F.lower(question), [w.lower() for w in words])


def in_domain(question: Column, words=rules.DOMAIN_HINTS) -> Column:
    return contains_any(F.lower(question), [w.lower() for w in words])


def context_overlap(questions: DataFrame, contexts: DataFrame, depth: int = 3) -> DataFrame:
    """Per question: context count, best word overlap with its first contexts, levels found."""
    words = questions.select("question_id", word_set(F.col("question")).alias("q_words"))
    text = F.concat_ws(" ", text_or_empty(F.col("text")), text_or_empty(F.col("title")))
    near = contexts.where(F.col("rank") <= depth).select("question_id", word_set(text).alias("c_words"))
    overlap = near.join(words, "question_id").groupBy("question_id").agg(
        F.max(overlap_ratio(F.col("q_words"), F.col("c_words"))).alias("overlap"))
    found = contexts.groupBy("question_id").agg(
        F.count("*").alias("n_contexts"), F.collect_set("evidence_level").alias("levels"))
    return found.join(overlap, "question_id", "left")


def relevance_gate(questions: DataFrame, contexts: DataFrame, scope_words=rules.OUT_OF_SCOPE,
                   domain_words=rules.DOMAIN_HINTS, min_overlap: float = rules.MIN_OVERLAP,
                   expect_levels: list[str] | None = None) -> DataFrame:
    """``questions`` plus ``reason``: out_of_scope, low_relevance, missing_evidence_type or null.

    ``expect_levels`` applies to clinical questions if there is a ``track``
    column and to all questions otherwise.
    """
    seen = context_overlap(questions, contexts)
    rows = questions.join(seen, "question_id", "left").withColumns({
        "n_contexts": F.coalesce(F.col("n_contexts"), F.lit(0)),
        "overlap": F.coalesce(F.col("overlap"), F.lit(0.0)),
    })
    q = F.col("question")
    weak = ~in_domain(q, domain_words) & (F.col("overlap") < min_overlap)
    reason = F.when(out_of_scope(q, scope_words), "out_of_scope").when(
        weak | (F.col("n_contexts") == 0), "low_relevance")
    if expect_levels:
        wanted = F.array(*[F.lit(x) for x in expect_levels])
        lacking = ~F.coalesce(F.arrays_overlap(F.col("levels"), wanted), F.lit(False))
        if "track" in questions.columns:
            lacking = lacking & (F.col("track") == "clinical")
        reason = reason.when(lacking, "missing_evidence_type")
    return rows.withColumn("reason", reason).drop("levels")


def source_counts(contexts: DataFrame) -> DataFrame:
    """``{'source': n, …}`` display text per question."""
    per_source = contexts.groupBy("question_id", "source").agg(
        F.count("*").alias("n"), F.min("rank").alias("first"))
    shown = F.concat(F.lit("'"), F.col("source"), F.lit("': "), F.col("n").cast("string"))
    return per_source.groupBy("question_id").agg(F.concat(
        F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", shown.alias("t")))),
                                             lambda x: x["t"]), ", "), F.lit("}")).alias("source_counts"))


def citation_cards(contexts: DataFrame) -> DataFrame:
    """Numbered evidence cards; a stored year of -1 means unknown."""
    return contexts.select(
        "question_id", F.col("rank").cast("int").alias("index"),
        or_else(F.col("doc_id"), F.col("chunk_id"), F.concat(F.lit("ctx-"), F.col("rank").cast("string"))).alias("doc_id"),
        text_or_empty(F.col("title")).alias("title"), text_or_empty(F.col("source")).alias("source"),
        F.when(F.col("year") != -1, F.col("year")).alias("year"), text_or_empty(F.col("url")).alias("url"),
        or_else(F.col("evidence_level"), F.lit("other")).alias("evidence_level"),
        head(text_or_empty(F.col("text")), SNIPPET_CHARS).alias("snippet"))


def evidence_packs(cards: DataFrame) -> DataFrame:
    """One text block per question, cards in order and separated by blank lines."""
    block = evidence_block(*[F.col(c) for c in (
        "index", "evidence_level", "title", "source", "year", "doc_id", "url", "snippet")])
    return _joined(cards.select("question_id", F.col("index").alias("at"), block.alias("part")), "\n\n", "block")


def reference_section(cards: DataFrame) -> DataFrame:
    """Numbered reference list per question."""
    line = F.concat(
        F.lit("["), F.col("index").cast("string"), F.lit("] "), F.col("title"),
        F.coalesce(F.concat(F.lit("，"), F.col("year").cast("string")), F.lit("")),
        F.lit("，"), F.col("doc_id"), F.when(F.col("url") != "", F.concat(F.lit("，"), F.col("url"))).otherwise(""))
    return _joined(cards.select("question_id", F.col("index").alias("at"), line.alias("part")), "\n", "references")


def _joined(parts: DataFrame, sep: str, name: str) -> DataFrame:
    return parts.groupBy("question_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), sep).alias(name))


def clinical_outline(cards: DataFrame) -> DataFrame:
    """Levels present and leading titles per question."""
    return cards.groupBy("question_id").agg(
        F.array_join(F.sort_array(F.collect_set("evidence_level")), " ").alias("levels"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
            F.col("index") <= 3, F.struct("index", "title")))), lambda x: x["title"]), " | ").alias("top_titles"))


def augment_with_fresh(contexts: DataFrame, fresh: DataFrame, k: int = 5) -> DataFrame:
    """Put fresh documents in front, later ones first, unless the document is
    already there; keep ``k + 2``. ``fresh`` has ``pos``, its arrival order."""
    known = contexts.select("question_id", "doc_id").distinct()
    new = fresh.join(known, ["question_id", "doc_id"], "left_anti")
    new = top_k(new, ["question_id", "doc_id"], 1, F.col("pos"), rank="_n").drop("_n")
    new = new.withColumn("_place", -F.col("pos").cast("long") - 1).drop("pos")
    old = contexts.withColumn("_place", F.col("rank").cast("long")).drop("rank")
    return top_k(new.unionByName(old, allowMissingColumns=True), ["question_id"], k + 2, F.col("_place")).drop("_place")


def merge_fresh(offline: DataFrame, live: DataFrame, max_total: int = 8) -> DataFrame:
    """Offline first, then live; first of each document; at most ``max_total``. Both have ``pos``."""
    rows = offline.withColumn("_side", F.lit(0)).unionByName(live.withColumn("_side", F.lit(1)))
    first = top_k(rows, ["question_id", "doc_id"], 1, F.col("_side"), F.col("pos"), rank="_n").drop("_n")
    return top_k(first, ["question_id"], max_total, F.col("_side"), F.col("pos")).drop("_side", "pos")


def action_tips(contexts: DataFrame, action_words=rules.ACTION_WORDS, banned_words=rules.BANNED_TIP_WORDS,
                limit: int = 5, same_chars: int | None = None, shown_chars: int | None = None) -> DataFrame:
    """Advice sentences per question: keep action words, drop banned words, first of
    each form without white space, at most ``limit``. Forms are compared, and tips shown, in
    full unless a number of characters is given."""
    sentence = F.trim(F.col("raw"), F.lit(" \t\n\r　"))
    rows = contexts.select("question_id", "rank", F.posexplode(
        F.split(text_or_empty(F.col("text")), r"(?<=[。！？!?；;])")).alias("at", "raw"))
    rows = rows.select("question_id", "rank", "at", sentence.alias("tip")).where(
        (F.col("tip") != "") & ~contains_any(F.col("tip"), banned_words) & contains_any(F.col("tip"), action_words))
    rows = rows.withColumn("form", cut(F.regexp_replace("tip", r"(?U)\s+", ""), same_chars))
    first = top_k(rows, ["question_id", "form"], 1, F.col("rank"), F.col("at"), rank="_n").drop("_n", "form")
    first = first.withColumnRenamed("rank", "_rank")
    tips = top_k(first, ["question_id"], limit, F.col("_rank"), F.col("at"), rank="n")
    return tips.select("question_id", "n", cut(F.col("tip"), shown_chars).alias("tip"))


def attach_explanation(cards: DataFrame, explanation: DataFrame) -> DataFrame:
    """Cards with the rank parts and matching terms of `retrieve.explain`."""
    why = explanation.withColumnRenamed("rank", "index").drop("chunk_id")
    return cards.join(why, ["question_id", "index"], "left")
