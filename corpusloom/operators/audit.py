"""Citation audit of supplied answers against each question's own contexts."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import (
    NOT_AFTER_WORD, NOT_BEFORE_WORD, search_tokens, strip, text_or_empty,
)
from corpusloom.operators.common import ranked

PMID = rf"(?i){NOT_AFTER_WORD}PMID[:\s]*([0-9]{{5,9}}){NOT_BEFORE_WORD}"
NCT = rf"(?i){NOT_AFTER_WORD}(NCT[0-9]{{8}}){NOT_BEFORE_WORD}"
DOC = rf"(?i){NOT_AFTER_WORD}((?:pmid|nct|epmc|local|wiki):[^\s\]，。；;,]+)"


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(pattern), F.lit(group))


# Stands for a bracket number too large for a bigint, which no list of contexts reaches.
_TOO_LARGE = (1 << 63) - 1


def bracket_numbers(answer: Column) -> Column:
    """Distinct ``[n]`` numbers, ascending; those too large to hold count as one."""
    return F.array_sort(F.array_distinct(F.transform(find_all(answer, r"\[(\d+)\]"), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(_TOO_LARGE)))))


def claimed_pmids(answer: Column) -> Column:
    return find_all(answer, PMID)


def claimed_ncts(answer: Column) -> Column:
    return F.transform(find_all(answer, NCT), F.upper)


def claimed_docs(answer: Column, compat: bool = False) -> Column:
    """Prefixed ids. Trailing dots, brackets and a ``#cN`` part are dropped unless ``compat``."""
    def clean(x: Column) -> Column:
        x = F.lower(x)
        return x if compat else F.regexp_replace(F.regexp_replace(x, r"[.)）]+$", ""), r"#c[0-9]+$", "")

    return F.transform(find_all(answer, DOC), clean)


def known_ids(contexts: DataFrame) -> DataFrame:
    """Ids a question may cite -> ``question_id, kind, id`` (distinct)."""
    doc = text_or_empty(F.col("doc_id"))
    low = F.lower(doc)
    place = F.concat_ws(" ", text_or_empty(F.col("url")), doc)
    tail = F.regexp_extract(doc, r"(?s)^[^:]*:(.*)$", 1)

    def kind(name: str, ids: Column) -> Column:
        return F.transform(ids, lambda i: F.struct(F.lit(name).alias("kind"), i.alias("id")))

    pmids = F.concat(find_all(place, PMID), F.when(F.startswith(low, F.lit("pmid:")), F.array(tail)).otherwise(F.array()))
    ncts = F.concat(claimed_ncts(place), F.when(
        F.startswith(low, F.lit("nct:")), F.array(F.upper(tail))).otherwise(F.array()))
    every = F.concat(kind("doc", F.array(low)), kind("pmid", pmids), kind("nct", ncts))
    return contexts.select("question_id", F.explode(every).alias("k")).select(
        "question_id", "k.kind", "k.id").distinct()


def verify_citations(answers: DataFrame, contexts: DataFrame, compat: bool = False) -> DataFrame:
    """``answers(question_id, answer)`` plus the audit columns.

    Claims become rows and meet the question's known ids in one equi-join on
    (question, kind, id); nothing is collected per context list.
    """
    answer = F.col("answer")

    def rows(kind: str, claims: Column) -> Column:
        return F.transform(claims, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), x.alias("id"), i.alias("at")))

    claims = answers.select("question_id", F.explode(F.concat(
        rows("pmid", claimed_pmids(answer)), rows("nct", claimed_ncts(answer)),
        rows("doc", claimed_docs(answer, compat)))).alias("c")).select("question_id", "c.*")
    fakes = claims.join(known_ids(contexts), ["question_id", "kind", "id"], "left_anti")

    def listed(kind: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(
            F.col("kind") == kind, F.struct("at", "id")))), lambda x: x["id"])

    fake = fakes.groupBy("question_id").agg(
        listed("pmid").alias("fake_pmids"), listed("nct").alias("fake_ncts"), listed("doc").alias("fake_docs"))
    counted = contexts.groupBy("question_id").agg(F.count("*").alias("n_contexts"))
    empty = F.array().cast("array<string>")
    out = answers.join(counted, "question_id", "left").join(fake, "question_id", "left")
    n = F.coalesce(F.col("n_contexts"), F.lit(0))
    used = bracket_numbers(answer)
    out = out.withColumns({
        "n_contexts": n,
        "used_brackets": used,
        "invalid_brackets": F.filter(used, lambda i: (i < 1) | (i > n)),
        "claimed_pmids": claimed_pmids(answer),
        "claimed_ncts": claimed_ncts(answer),
        **{c: F.coalesce(F.col(c), empty) for c in ("fake_pmids", "fake_ncts", "fake_docs")},
        "has_citations": F.size(used) > 0,
        "invent_phrase_hits": phrase_hits(answer),
    })
    lists = ["invalid_brackets", "fake_pmids", "fake_ncts", "fake_docs"]
    total = sum((F.size(c) for c in lists), F.lit(0))
    return out.withColumn("fake_citation_count", total).withColumn("ok", total == 0)


def phrase_hits(answer: Column, patterns=rules.INVENTED_PHRASES) -> Column:
    return sum((F.regexp_count(answer, F.lit(p)) for p in patterns), F.lit(0))


def baseline_fake_signal(answer: Column) -> Column:
    """Identifiers in an answer that had no evidence, plus one for three or more brackets."""
    many = F.when(F.regexp_count(answer, F.lit(r"\[\d+\]")) >= 3, 1).otherwise(0)
    return F.size(claimed_pmids(answer)) + F.size(find_all(answer, NCT)) + many


def dense_enough(answer: Column, min_cites: int = 2) -> Column:
    return F.size(bracket_numbers(answer)) >= min_cites


def repair_brackets(answer: Column, invalid: Column) -> Column:
    """Remove the ``[n]`` marks listed in ``invalid``."""
    return F.aggregate(invalid, answer, lambda text, n: F.replace(
        text, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))


def _context_terms(contexts: DataFrame) -> DataFrame:
    return contexts.select("question_id", F.explode(F.array_distinct(
        search_tokens(text_or_empty(F.col("text"))))).alias("term")).distinct()


def faithfulness(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """Share of an answer's distinct tokens that occur in its contexts."""
    words = answers.select("question_id", F.explode_outer(F.array_distinct(
        search_tokens(text_or_empty(F.col("answer"))))).alias("term"))
    seen = words.join(_context_terms(contexts).withColumn("hit", F.lit(1)), ["question_id", "term"], "left")
    return seen.groupBy("question_id").agg(F.coalesce(
        F.sum("hit") / F.nullif(F.count("term"), F.lit(0)), F.lit(0.0)).alias("faithfulness"))


def unsupported_claims(answers: DataFrame, contexts: DataFrame, min_support: float = 0.5) -> DataFrame:
    """Sentences whose best token overlap with one context stays below ``min_support``.

    Tokens meet context tokens in an equi-join on (question, term), so only
    matching tokens are paired.
    """
    split = F.posexplode(F.split(F.col("answer"), r"(?<=[。！？!?；;.\n])"))
    sentences = answers.select("question_id", split.alias("at", "raw")).select(
        "question_id", "at", strip(F.col("raw")).alias("claim")).where("claim <> ''")
    words = sentences.select("question_id", "at", "claim", F.array_distinct(
        search_tokens(F.col("claim"))).alias("tokens")).where(F.size("tokens") > 0)
    terms = words.select("question_id", "at", F.size("tokens").alias("n"), F.explode("tokens").alias("term"))
    context_terms = contexts.select("question_id", "rank", F.explode(F.array_distinct(
        search_tokens(text_or_empty(F.col("text"))))).alias("term"))
    support = terms.join(context_terms, ["question_id", "term"]).groupBy("question_id", "at", "rank", "n").agg(
        F.count("*").alias("hits")).groupBy("question_id", "at").agg(F.max(F.col("hits") / F.col("n")).alias("support"))
    judged = words.drop("tokens").join(support, ["question_id", "at"], "left").withColumn(
        "support", F.coalesce(F.col("support"), F.lit(0.0)))
    return ranked(judged.where(F.col("support") < min_support), ["question_id"], F.col("at"), rank="n").drop("at")
