"""Queries that run a whole flow."""

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.operators import gate, retrieve
from corpusloom.operators.common import stored
from corpusloom.plans import build
from corpusloom.plans.ask import AskRules, ask_batch
from corpusloom.plans.corpus import CHUNKS, chunks, docs, questions, table
from corpusloom.plans.q_answers import DOMAIN, EXPECT, SCOPE, GATE_SQL
from corpusloom.plans.q_curation import fold_sql
from corpusloom.plans.q_retrieval import HITS, hits, hybrid_sql
from corpusloom.plans.registry import query

_ALIASES = [(["th"], "that with this"), (["que"], "elle les")]
_DOSE = ["(ing|ung)[ .,]"]
_ASKED = """all_q AS MATERIALIZED (
  SELECT question_id, question, track, track = 'nutrition' AND regexp_matches(lower(question), '(ing|ung)[ .,]') AS dose,
    CASE WHEN track = 'nutrition' AND len(a) > 0 THEN base || ' ' || array_to_string(a, ' ') ELSE base END AS query
  FROM (SELECT item_id::VARCHAR AS question_id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'clinical' ELSE 'nutrition' END AS track,
    trim(text, ' ' || chr(10)) AS base,
    list_filter([CASE WHEN contains(lower(text), 'th') THEN 'that with this' END, CASE WHEN contains(lower(text), 'que') THEN 'elle les' END],
      lambda x: x IS NOT NULL) AS a FROM benchmark)),
questions AS MATERIALIZED (SELECT question_id, question, track, query FROM all_q WHERE NOT dose)"""


def _message() -> str:
    miss, suggest = rules.REFUSAL_MISSING, rules.REFUSAL_SUGGEST
    return f"""'{rules.REFUSAL_HEAD.strip()}' || chr(10) || '我能确认的是：'
  || CASE WHEN n_contexts = 0 THEN '{rules.REFUSAL_NOTHING_FOUND}' ELSE '检索到 ' || n_contexts || ' 条证据，来源分布 ' || shown END
  || '；但' || CASE reason WHEN 'out_of_scope' THEN '{miss["out_of_scope"]}' WHEN 'missing_evidence_type' THEN '{miss["missing_evidence_type"]}'
     ELSE '{miss["low_relevance"]}' END || '。' || chr(10) || '如需继续：'
  || CASE reason WHEN 'out_of_scope' THEN '{suggest["out_of_scope"]}' ELSE '{suggest["low_relevance"]}' END
  || '。' || chr(10) || '{rules.REFUSAL_TAIL}'"""


@query("ask_batch", f"""
WITH RECURSIVE {CHUNKS}, {hybrid_sql(5, asked=_ASKED)},
ctx AS (SELECT * FROM hits), {GATE_SQL},
sc AS (SELECT question_id, '{{' || string_agg('''' || source || ''': ' || n, ', ' ORDER BY first) || '}}' AS shown FROM (
  SELECT question_id, source, count(*) AS n, min(rank) AS first FROM ctx GROUP BY ALL) GROUP BY ALL),
pk AS (SELECT question_id, string_agg('[' || rank || '] (' || evidence_level || ') ' || title || ' | ' || source || ' | '
  || coalesce(year::VARCHAR, 'n/a') || ' | ' || doc_id || chr(10) || 'URL: ' || url || chr(10) || substr(text, 1, 240), chr(10) || chr(10) ORDER BY rank) AS block
  FROM hits GROUP BY ALL)
SELECT question_id, track, CASE WHEN dose THEN question ELSE query END AS rewritten_query, dose OR reason IS NOT NULL AS refused,
  CASE WHEN dose THEN 'dosage_request' ELSE reason END AS reason, CASE WHEN reason IS NOT NULL THEN {_message()} END AS message,
  CASE WHEN dose OR reason IS NOT NULL THEN 0 ELSE coalesce(n_contexts, 0) END AS n_contexts,
  CASE WHEN NOT (dose OR reason IS NOT NULL) THEN block END AS block
FROM all_q LEFT JOIN gated USING (question_id) LEFT JOIN sc USING (question_id) LEFT JOIN pk USING (question_id)""")
def _(spark, sf):
    r = AskRules(_ALIASES, _DOSE, SCOPE, DOMAIN, EXPECT, 0.5)
    return ask_batch(stored(chunks(spark, sf)), questions(spark, sf).drop("query"), 5, ask_rules=r)


@query("attach_explanation", f"""
WITH {HITS}, m AS (SELECT h.question_id, h.chunk_id, string_agg(term, ' ' ORDER BY term) AS matched_terms
  FROM hits h JOIN tfs USING (chunk_id) JOIN qt USING (question_id, term) GROUP BY ALL)
SELECT question_id, rank AS index, doc_id, title, kw_rank, score, matched_terms
FROM hits LEFT JOIN m USING (question_id, chunk_id) WHERE rank <= 5""")
def _(spark, sf):
    found = stored(hits(spark, sf, 5))
    why = retrieve.explain(found, docs(spark, sf).withColumn("chunk_id", F.col("doc_id")), questions(spark, sf))
    return gate.attach_explanation(gate.citation_cards(found), why).select(
        "question_id", "index", "doc_id", "title", "kw_rank", "score", "matched_terms")


@query("curate_sources", fold_sql("""docs AS MATERIALIZED (
  SELECT doc_id, source, title, text, year, url, tags, evidence_level, journal, doi, is_oa, in_pmc, ord FROM docs0
  UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'local', substr(text, 1, 30), text, NULL, '', ['local'], 'other', '', '', '', '', 288230376151711744 + conv_id * 1000 + turn
  FROM conversations)"""))
def _(spark, sf):
    c = table(spark, sf, "conversations")
    d = docs(spark, sf).withColumn("pos", F.col("ord")).drop("ord", "lang", "n_chars")
    talk = c.select(
        F.concat(F.lit("conv:"), "conv_id", F.lit(":"), "turn").alias("doc_id"), F.lit("local").alias("source"),
        F.substring("text", 1, 30).alias("title"), "text", F.lit(None).cast("int").alias("year"), F.lit("").alias("url"),
        F.array(F.lit("local")).alias("tags"), F.lit("other").alias("evidence_level"), F.lit("").alias("journal"),
        F.lit("").alias("doi"), F.create_map().cast("map<string,string>").alias("extra"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    d = build.curate_sources(d, talk, regrade=False)
    number = F.col("ord.source") * F.lit(1 << 58) + F.col("ord.row")
    return d.select(number.alias("ord"), "doc_id", "source", "title", "evidence_level", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "year",
                    "url", "journal", "doi", "tags", F.coalesce(F.element_at("extra", "isOpenAccess"), F.lit("")).alias("is_oa"),
                    F.coalesce(F.element_at("extra", "inPMC"), F.lit("")).alias("in_pmc"))
