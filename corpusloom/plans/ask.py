"""A table of questions in, a table of evidence packs or refusals out."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.functions.wording import asks_for_dose, expand_query, refusal_message, search_text
from corpusloom.operators.common import stored
from corpusloom.operators.gate import augment_with_fresh, citation_cards, evidence_packs, relevance_gate, source_counts
from corpusloom.operators.retrieve import retrieve


@dataclass
class AskRules:
    aliases: list = field(default_factory=lambda: rules.QUERY_ALIASES)
    dosage: list = field(default_factory=lambda: rules.DOSAGE_PATTERNS)
    scope_words: list = field(default_factory=lambda: rules.OUT_OF_SCOPE)
    domain_words: list = field(default_factory=lambda: rules.DOMAIN_HINTS)
    expect_levels: list = field(default_factory=lambda: rules.EXPECT_LEVELS)
    min_overlap: float = rules.MIN_OVERLAP


def prepare(questions: DataFrame, r: AskRules) -> DataFrame:
    """Dose requests flagged, retrieval query built. ``questions(question_id, question, track)``."""
    q = F.col("question")
    nutrition = F.col("track") == "nutrition"
    return questions.withColumns({
        "dose": nutrition & asks_for_dose(q, r.dosage),
        "query": F.when(nutrition, expand_query(q, search_text(q), r.aliases)).otherwise(search_text(q)),
    })


def ask_batch(chunks: DataFrame, questions: DataFrame, k: int = 5, use_vector: bool = True,
              ask_rules: AskRules | None = None, fresh: DataFrame | None = None, embed=None, rerank=None,
              contexts_to=None, vectors: DataFrame | None = None, keyword_index=None) -> DataFrame:
    """One row per question: ``reason`` and ``message`` for refusals, ``block`` otherwise.

    ``chunks`` is best a stored table, it is read several times. ``fresh`` holds
    chunks of newly found documents per question (``question_id, pos`` + chunk
    columns). ``contexts_to`` receives the chosen contexts as a DataFrame.
    """
    r = ask_rules or AskRules()
    prepared = prepare(questions, r)
    asked = prepared.where(~F.col("dose")).drop("dose")
    hits = retrieve(chunks, asked, k, use_vector=use_vector, embed=embed, rerank=rerank,
                    vectors=vectors, keyword_index=keyword_index)
    if fresh is not None:
        hits = augment_with_fresh(hits, fresh, k)
    hits = stored(hits)
    if contexts_to is not None:
        contexts_to(hits)
    gated = relevance_gate(asked, hits, r.scope_words, r.domain_words, r.min_overlap, r.expect_levels)
    gated = gated.select("question_id", "reason", F.col("n_contexts").alias("found"))
    rows = (prepared.join(gated, "question_id", "left")
            .join(source_counts(hits), "question_id", "left")
            .join(evidence_packs(citation_cards(hits)), "question_id", "left"))
    reason = F.when(F.col("dose"), "dosage_request").otherwise(F.col("reason"))
    refused = reason.isNotNull()
    told = F.when(F.col("reason").isNotNull(), refusal_message(F.col("reason"), F.col("found"), F.col("source_counts")))
    return rows.select(
        "question_id", "track", F.when(F.col("dose"), F.col("question")).otherwise(F.col("query")).alias("rewritten_query"),
        refused.alias("refused"), reason.alias("reason"), told.alias("message"),
        F.when(refused, 0).otherwise(F.coalesce("found", F.lit(0))).cast("bigint").alias("n_contexts"),
        F.when(~refused, F.col("block")).alias("block"))
