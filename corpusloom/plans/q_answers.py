"""Question gates, evidence packs, citation audit and evaluation queries."""

from pyspark.sql import functions as F

from corpusloom.functions import rules, wording
from corpusloom.functions.text import clean_ocr
from corpusloom.operators import audit, evaluate, gate
from corpusloom.operators.common import stored
from corpusloom.plans.corpus import ANSWERS, CONTEXTS, answers, contexts, docs, questions, table
from corpusloom.plans.q_retrieval import HITS, hits
from corpusloom.plans.answers import finish_answers
from corpusloom.plans.evaluate import compare_arms
from corpusloom.plans.registry import SQL, query

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


def _set(text: str) -> str:
    return f"list_distinct({_WORDS.format(text)})"


SCOPE, DOMAIN, EXPECT = ["thrrel", "nicht"], ["with", "elle"], ["rct", "meta"]


def any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


GATE_SQL = f"""
qw AS (SELECT question_id, {_set("question")} AS w FROM questions),
ov AS (SELECT question_id, max(CASE WHEN len(w) = 0 OR len(c) = 0 THEN 0.0 ELSE len(list_intersect(w, c)) / len(w) END)::DOUBLE AS overlap
  FROM (SELECT question_id, {_set("text || ' ' || title")} AS c FROM ctx WHERE rank <= 3) JOIN qw USING (question_id) GROUP BY ALL),
cn AS (SELECT question_id, count(*) AS n_contexts, count(*) FILTER (evidence_level IN ('rct', 'meta')) AS strong FROM ctx GROUP BY ALL),
gated AS MATERIALIZED (
  SELECT question_id, coalesce(n_contexts, 0) AS n_contexts, round(coalesce(overlap, 0.0), 6)::DOUBLE AS overlap,
    CASE WHEN {any_sql("lower(question)", SCOPE)} THEN 'out_of_scope'
      WHEN (NOT {any_sql("lower(question)", DOMAIN)} AND coalesce(overlap, 0.0) < 0.5) OR coalesce(n_contexts, 0) = 0 THEN 'low_relevance'
      WHEN track = 'clinical' AND coalesce(strong, 0) = 0 THEN 'missing_evidence_type' END AS reason
  FROM questions LEFT JOIN ov USING (question_id) LEFT JOIN cn USING (question_id))"""


def _gated(spark, sf):
    """Gate result and the hits it looked at; the short hit lists are stored, since several steps read them."""
    found = stored(hits(spark, sf, 5))
    return gate.relevance_gate(questions(spark, sf), found, SCOPE, DOMAIN, 0.5, EXPECT), found


_CTX5 = f"{HITS}, ctx AS (SELECT * FROM hits WHERE rank <= 5)"


@query("relevance_gate", f"WITH {_CTX5}, {GATE_SQL} SELECT * FROM gated")
def _(spark, sf):
    return _gated(spark, sf)[0].select("question_id", "n_contexts", F.round("overlap", 6).alias("overlap"), "reason")


_MISS, _TRY = rules.REFUSAL_MISSING, rules.REFUSAL_SUGGEST


@query("refusal_message", f"""
WITH {_CTX5}, {GATE_SQL},
sc AS (SELECT question_id, '{{' || string_agg('''' || source || ''': ' || n, ', ' ORDER BY first) || '}}' AS shown FROM (
  SELECT question_id, source, count(*) AS n, min(rank) AS first FROM ctx GROUP BY ALL) GROUP BY ALL)
SELECT question_id, '{rules.REFUSAL_HEAD.strip()}' || chr(10) || '我能确认的是：'
  || CASE WHEN n_contexts = 0 THEN '{rules.REFUSAL_NOTHING_FOUND}' ELSE '检索到 ' || n_contexts || ' 条证据，来源分布 ' || shown END
  || '；但' || CASE reason WHEN 'out_of_scope' THEN '{_MISS["out_of_scope"]}' WHEN 'missing_evidence_type' THEN '{_MISS["missing_evidence_type"]}'
     ELSE '{_MISS["low_relevance"]}' END || '。' || chr(10) || '如需继续：'
  || CASE reason WHEN 'out_of_scope' THEN '{_TRY["out_of_scope"]}' ELSE '{_TRY["low_relevance"]}' END
  || '。' || chr(10) || '{rules.REFUSAL_TAIL}' AS message
FROM gated LEFT JOIN sc USING (question_id) WHERE reason IS NOT NULL""")
def _(spark, sf):
    gated, found = _gated(spark, sf)
    rows = gated.where(F.col("reason").isNotNull()).join(gate.source_counts(found), "question_id", "left")
    return rows.select("question_id", wording.refusal_message(
        F.col("reason"), F.col("n_contexts"), F.col("source_counts")).alias("message"))


CARDS = """cards AS MATERIALIZED (
  SELECT question_id, rank AS index, doc_id, title, source, year, url, evidence_level, substr(text, 1, 240) AS snippet FROM contexts)"""


@query("citation_cards", f"""
WITH {CONTEXTS}, {CARDS} SELECT question_id, index::BIGINT AS index, doc_id, title, source, year::BIGINT AS year, url,
  evidence_level, snippet FROM cards""")
def _(spark, sf):
    return gate.citation_cards(contexts(spark, sf))


@query("evidence_packs", f"""
WITH {CONTEXTS}, {CARDS} SELECT question_id, string_agg('[' || index || '] (' || evidence_level || ') ' || title || ' | ' || source
  || ' | ' || coalesce(year::VARCHAR, 'n/a') || ' | ' || doc_id || chr(10) || 'URL: ' || url || chr(10) || snippet,
  chr(10) || chr(10) ORDER BY index) AS block FROM cards GROUP BY question_id""")
def _(spark, sf):
    return gate.evidence_packs(gate.citation_cards(contexts(spark, sf)))


@query("reference_section", f"""
WITH {CONTEXTS}, {CARDS} SELECT question_id, string_agg('[' || index || '] ' || title || coalesce('，' || year, '') || '，' || doc_id
  || CASE WHEN url <> '' THEN '，' || url ELSE '' END, chr(10) ORDER BY index) AS "references" FROM cards GROUP BY question_id""")
def _(spark, sf):
    return gate.reference_section(gate.citation_cards(contexts(spark, sf)))


@query("clinical_outline", f"""
WITH {CONTEXTS}, {CARDS} SELECT question_id, string_agg(DISTINCT evidence_level, ' ' ORDER BY evidence_level) AS levels,
  string_agg(title, ' | ' ORDER BY index) FILTER (index <= 3) AS top_titles FROM cards GROUP BY question_id""")
def _(spark, sf):
    return gate.clinical_outline(gate.citation_cards(contexts(spark, sf)))


@query("evidence_cards", """
SELECT doc_id, '标题：' || coalesce(nullif(substr(string_split(text, chr(10))[1], 1, 80), ''), '（无标题）') || chr(10)
  || '年份：' || coalesce(CASE WHEN n_chars % 11 <> 0 THEN (n_chars % 30 + 1995)::VARCHAR END, '未知')
  || ' | 期刊：' || coalesce(nullif(CASE WHEN lang = 'en' THEN '' ELSE source END, ''), '未知') || chr(10)
  || '链接：' || CASE WHEN n_chars % 7 = 0 THEN '' ELSE 'https://docs.example/' || doc_id END AS card FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(F.col("ord").alias("doc_id"), wording.evidence_card(
        F.col("title"), F.col("year"), F.col("journal"), F.col("url")).alias("card"))


@query("live_augment", f"""
WITH {CONTEXTS}, fresh AS (
  SELECT conv_id || '-' || turn AS question_id, unnest(['local:' || conv_id, 'pmid:' || conv_id, 'pmid:' || conv_id, 'nct:x']) AS doc_id,
    unnest([0, 1, 2, 3]) AS pos FROM conversations WHERE role = 'assistant'),
new AS (SELECT question_id, doc_id, min(pos) AS pos FROM fresh ANTI JOIN contexts USING (question_id, doc_id) GROUP BY ALL)
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM (
  SELECT question_id, doc_id, -pos - 1 AS place FROM new UNION ALL SELECT question_id, doc_id, rank FROM contexts)
QUALIFY rank <= 5""")
def _(spark, sf):
    return gate.augment_with_fresh(contexts(spark, sf), _fresh(spark, sf), k=3).select("question_id", "doc_id", "rank")


def _fresh(spark, sf):
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    conv = F.col("conv_id").cast("string")
    found = F.array(F.concat(F.lit("local:"), conv), F.concat(F.lit("pmid:"), conv), F.concat(F.lit("pmid:"), conv),
                    F.lit("nct:x"))
    return a.select(F.concat_ws("-", conv, F.col("turn").cast("string")).alias("question_id"),
                    F.posexplode(found).alias("pos", "doc_id"))


@query("merge_fresh", f"""
WITH {CONTEXTS}, both_sides AS (
  SELECT question_id, doc_id, 0 AS side, rank AS pos FROM contexts
  UNION ALL SELECT conv_id || '-' || turn, unnest(['local:' || conv_id, 'pmid:' || conv_id, 'pmid:' || conv_id, 'nct:x']), 1,
    unnest([0, 1, 2, 3]) FROM conversations WHERE role = 'assistant'),
once AS (SELECT * FROM both_sides QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY side, pos) = 1)
SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY side, pos) AS rank FROM once QUALIFY rank <= 6""")
def _(spark, sf):
    offline = contexts(spark, sf).select("question_id", "doc_id", F.col("rank").alias("pos"))
    return gate.merge_fresh(offline, _fresh(spark, sf).select("question_id", "doc_id", "pos"), 6)


@query("action_tips", """
WITH s AS (SELECT conv_id, turn, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM (
    SELECT conv_id, turn, regexp_extract_all(replace(text, '.', ';'), '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$') AS p FROM conversations)),
t AS (SELECT conv_id, turn, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS tip FROM s),
k AS (SELECT *, regexp_replace(tip, '\\s+', '', 'g') AS form FROM t WHERE tip <> ''
  AND NOT (contains(tip, 'ß') OR contains(tip, 'with')) AND (contains(tip, 'th') OR contains(tip, 'er') OR contains(tip, 'que'))),
u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY conv_id, form ORDER BY turn, pos) = 1)
SELECT conv_id::VARCHAR AS question_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS n, tip
FROM u QUALIFY n <= 5""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("question_id"), F.col("turn").alias("rank"),
        F.replace("text", F.lit("."), F.lit(";")).alias("text"))
    return gate.action_tips(c, ["th", "er", "que"], ["ß", "with"])


@query("dosage_gate", """
SELECT item_id, regexp_matches(lower(text), '(th|er)ly|[aeiou]{3}n|in .{0,12}(que|sch)') AS asks_for_dose FROM benchmark""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", wording.asks_for_dose(
        F.col("text"), ["(th|er)ly", "[aeiou]{3}n", "in .{0,12}(que|sch)"]).alias("asks_for_dose"))


@query("dosage_in_answer", f"""
WITH {ANSWERS} SELECT question_id, regexp_matches(answer, '\\d+(\\.\\d+)?\\s*(nct|pmid)') AND (contains(answer, 'the') OR contains(answer, 'la '))
  AS mentions_dose FROM answers""")
def _(spark, sf):
    return answers(spark, sf).select("question_id", wording.mentions_dose(
        F.col("answer"), r"\d+(\.\d+)?\s*(nct|pmid)", ["the", "la "]).alias("mentions_dose"))


_ALIASES = [(["the", "that"], "article words"), (["ein", "ung"], "german endings"), (["que"], "french words"),
            (["la "], "french words")]


@query("alias_expand", """
SELECT item_id, CASE WHEN len(a) = 0 THEN base ELSE base || ' ' || array_to_string(a, ' ') END AS query FROM (
  SELECT item_id, trim(text, ' ' || chr(10)) AS base, list_filter([
    CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'that') THEN 'article words' END,
    CASE WHEN contains(lower(text), 'ein') OR contains(lower(text), 'ung') THEN 'german endings' END,
    CASE WHEN contains(lower(text), 'que') OR contains(lower(text), 'la ') THEN 'french words' END], lambda x: x IS NOT NULL) AS a FROM benchmark)""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", wording.expand_query(F.col("text"), None, _ALIASES).alias("query"))


@query("first_line_query", """
SELECT item_id, trim(text, ' ' || chr(10)) AS query FROM benchmark""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", wording.search_text(F.col("text")).alias("query"))


@query("term_simplify", """
SELECT doc_id, replace(replace(replace(text, 'tion', 'tion (act)'), 'act', 'deed'), 'the ', 'this ') AS text FROM documents""")
def _(spark, sf):
    terms = [("tion", "tion (act)"), ("act", "deed"), ("the ", "this ")]
    return table(spark, sf, "documents").select("doc_id", wording.plain_terms(F.col("text"), terms).alias("text"))


@query("ocr_clean", """
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^===== 第\\d+页 =====$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'),
  '[ \\t]{2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM (SELECT page_id, '===== 第' || page_id || '页 =====' || chr(10) || replace(replace(html, '<', chr(10) || '<'), '>', '>   ') AS t FROM pages)""")
def _(spark, sf):
    page = F.concat(F.lit("===== 第"), F.col("page_id").cast("string"), F.lit("页 =====\n"),
                    F.replace(F.replace("html", F.lit("<"), F.lit("\n<")), F.lit(">"), F.lit(">   ")))
    return table(spark, sf, "pages").select("page_id", clean_ocr(page, rules.OCR_PAGE_MARK).alias("text"))


@query("pico_query", """
SELECT doc_id, '"' || source || ' ' || lang || '"[Title/Abstract] OR ' || source || ' ' || lang || '[MeSH Terms] AND ('
  || lang || '[Title/Abstract] OR ' || source || '[Title/Abstract])'
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ' AND ' || source || '[Title/Abstract]' END || ' AND hasabstract[text]' AS query FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", wording.literature_query(
        F.concat_ws(" ", "source", "lang"), F.concat_ws(" OR ", "lang", "source"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))).alias("query"))


@query("decorate_term", """
SELECT doc_id, source || CASE WHEN lang = 'en' THEN ' AND 2001:3000[dp]' WHEN lang = 'fr' THEN ' AND 1800:' || (n_chars % 30 + 1990) || '[dp]' ELSE '' END
  || CASE WHEN n_chars % 2 = 0 THEN ' AND "review"[pt]' ELSE '' END AS term FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", wording.decorate_term(
        F.concat(F.lit(" "), "source", F.lit(" ")), F.when(F.col("lang") == "en", 2001),
        F.when(F.col("lang") == "fr", F.col("n_chars") % 30 + 1990), F.when(F.col("n_chars") % 2 == 0, "review")).alias("term"))


@query("track_routing", """
SELECT item_id, CASE WHEN contains(lower(text), 'the ') OR contains(lower(text), 'ung') THEN 'nutrition' ELSE 'clinical' END AS track,
  item_id % 6 < 3 OR contains(lower(text), 'que') AS live FROM benchmark""")
def _(spark, sf):
    t = F.col("text")
    return table(spark, sf, "benchmark").select(
        "item_id", wording.detect_track(t, ["the ", "ung"]).alias("track"),
        wording.wants_live_search(t, F.col("item_id") % 6, 3, ["que"]).alias("live"))


# --- citation audit -------------------------------------------------------

_NB = "(^|[^\\p{L}\\p{N}_])"
AUDIT = f"""{ANSWERS}, {CONTEXTS},
claimed AS MATERIALIZED (SELECT question_id, answer,
  list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::BIGINT))) AS used,
  regexp_extract_all(answer, '(?i){_NB}PMID[:\\s]*([0-9]{{5,9}})', 2) AS pmids,
  list_transform(regexp_extract_all(answer, '(?i){_NB}(NCT[0-9]{{8}})', 2), lambda x: upper(x)) AS ncts,
  list_transform(regexp_extract_all(answer, '(?i){_NB}((?:pmid|nct|epmc|local|wiki):[^\\s\\]，。；;,]+)', 2),
    lambda x: regexp_replace(regexp_replace(lower(x), '[.)）]+$', ''), '#c[0-9]+$', '')) AS docs FROM answers),
ids AS MATERIALIZED (SELECT question_id, count(*) AS n, list(lower(doc_id)) AS known,
  list(split_part(doc_id, ':', 2)) FILTER (starts_with(doc_id, 'pmid:')) AS known_pmids,
  list(upper(split_part(doc_id, ':', 2))) FILTER (starts_with(doc_id, 'nct:')) AS known_ncts FROM contexts GROUP BY ALL),
audit AS MATERIALIZED (SELECT question_id, answer, n, used, pmids, ncts,
  list_filter(used, lambda x: x < 1 OR x > n) AS invalid, list_filter(pmids, lambda x: NOT list_contains(known_pmids, x)) AS fake_pmids,
  list_filter(ncts, lambda x: NOT list_contains(known_ncts, x)) AS fake_ncts,
  list_filter(docs, lambda x: NOT list_contains(known, x)) AS fake_docs FROM claimed JOIN ids USING (question_id))"""


@query("citation_audit", f"""
WITH {AUDIT} SELECT question_id, n AS n_contexts, array_to_string(used, '|') AS used_brackets, array_to_string(invalid, '|') AS invalid_brackets,
  array_to_string(pmids, '|') AS claimed_pmids, array_to_string(ncts, '|') AS claimed_ncts,
  array_to_string(fake_pmids, '|') AS fake_pmids, array_to_string(fake_ncts, '|') AS fake_ncts, array_to_string(fake_docs, '|') AS fake_docs,
  len(used) > 0 AS has_citations, (len(invalid) + len(fake_pmids) + len(fake_ncts) + len(fake_docs))::BIGINT AS fake_citation_count,
  len(invalid) + len(fake_pmids) + len(fake_ncts) + len(fake_docs) = 0 AS ok FROM audit""")
def _(spark, sf):
    return audit.verify_citations(answers(spark, sf), contexts(spark, sf)).select(
        "question_id", "n_contexts", "used_brackets", "invalid_brackets", "claimed_pmids", "claimed_ncts", "fake_pmids",
        "fake_ncts", "fake_docs", "has_citations", "fake_citation_count", "ok")


def _quoted(x: str) -> str:
    return f"'[' || array_to_string(list_transform({x}, lambda y: '''' || y || ''''), ', ') || ']'"


@query("audit_note", f"""
WITH {AUDIT} SELECT question_id, CASE WHEN len(invalid) + len(fake_pmids) + len(fake_ncts) + len(fake_docs) = 0 THEN answer ELSE
  rtrim(answer) || chr(10) || chr(10) || '> 引用校验：' || array_to_string(list_filter([
    CASE WHEN len(invalid) > 0 THEN '无效引用编号: [' || array_to_string(invalid, ', ') || ']' END,
    CASE WHEN len(fake_pmids) > 0 THEN '无法核实的 PMID: ' || {_quoted("fake_pmids")} END,
    CASE WHEN len(fake_ncts) > 0 THEN '无法核实的 NCT: ' || {_quoted("fake_ncts")} END,
    CASE WHEN len(fake_docs) > 0 THEN '无法核实的文档 ID: ' || {_quoted("fake_docs")} END], lambda x: x IS NOT NULL), '；')
  || '。请仅采信与证据面板一致的引用。' END AS answer FROM audit""")
def _(spark, sf):
    a = audit.verify_citations(answers(spark, sf), contexts(spark, sf))
    return a.select("question_id", wording.audit_note(*[F.col(c) for c in (
        "answer", "ok", "invalid_brackets", "fake_pmids", "fake_ncts", "fake_docs")]).alias("answer"))


@query("repair_answer", f"""
WITH {AUDIT} SELECT question_id, CASE WHEN list_contains(invalid, 0) AND NOT list_contains(invalid, 5) AND NOT list_contains(invalid, 6) THEN replace(answer, '[0]', '')
  WHEN list_contains(invalid, 5) THEN replace(answer, '[5]', '') WHEN list_contains(invalid, 6) THEN replace(answer, '[6]', '') ELSE answer END AS answer FROM audit""")
def _(spark, sf):
    a = audit.verify_citations(answers(spark, sf), contexts(spark, sf))
    return a.select("question_id", audit.repair_brackets(F.col("answer"), F.col("invalid_brackets")).alias("answer"))


@query("fake_signal", f"""
WITH {ANSWERS}, a AS (SELECT question_id, CASE WHEN conv_id % 2 = 0 THEN answer || ' [2] et al. [3]' ELSE answer END AS answer FROM answers)
SELECT question_id, (len(regexp_extract_all(answer, '(?i){_NB}PMID[:\\s]*([0-9]{{5,9}})', 2)) + len(regexp_extract_all(answer, '(?i){_NB}NCT[0-9]{{8}}'))
  + CASE WHEN len(regexp_extract_all(answer, '\\[\\d+\\]')) >= 3 THEN 1 ELSE 0 END)::BIGINT AS fake_signal,
  len(regexp_extract_all(answer, 'et al\\.'))::BIGINT AS invent_phrase_hits,
  len(list_distinct(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))) >= 3 AS dense FROM a""")
def _(spark, sf):
    a = answers(spark, sf).withColumn("answer", F.when(F.col("conv_id") % 2 == 0, F.concat(
        "answer", F.lit(" [2] et al. [3]"))).otherwise(F.col("answer")))
    c = F.col("answer")
    return a.select("question_id", audit.baseline_fake_signal(c).alias("fake_signal"),
                    audit.phrase_hits(c).alias("invent_phrase_hits"), audit.dense_enough(c, 3).alias("dense"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_]+|[一-鿿]+'))"


@query("faithfulness_proxy", f"""
WITH {ANSWERS}, {CONTEXTS},
ct AS (SELECT question_id, list_distinct(flatten(list({_TOK.format("text")}))) AS c FROM contexts GROUP BY ALL),
aw AS (SELECT question_id, {_TOK.format("answer")} AS w FROM answers)
SELECT question_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_intersect(w, coalesce(c, []))) / len(w) END, 6)::DOUBLE AS faithfulness
FROM aw LEFT JOIN ct USING (question_id)""")
def _(spark, sf):
    f = audit.faithfulness(answers(spark, sf), contexts(spark, sf))
    return f.select("question_id", F.round("faithfulness", 6).alias("faithfulness"))


@query("unsupported_claims", f"""
WITH {ANSWERS}, {CONTEXTS},
s AS (SELECT question_id, unnest(p) AS raw, generate_subscripts(p, 1) AS pos FROM (
  SELECT question_id, regexp_extract_all(answer, '[^。！？!?；;.\\n]*[。！？!?；;.\\n]|[^。！？!?；;.\\n]+$') AS p FROM answers)),
w AS (SELECT question_id, pos, trim(raw, ' ' || chr(10)) AS claim, {_TOK.format("raw")} AS t FROM s),
sup AS (SELECT question_id, pos, max(len(list_intersect(t, {_TOK.format("text")})) / len(t)) AS support
  FROM w JOIN contexts USING (question_id) WHERE len(t) > 0 GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n, claim, round(coalesce(support, 0), 6)::DOUBLE AS support
FROM w LEFT JOIN sup USING (question_id, pos) WHERE len(t) > 0 AND coalesce(support, 0) < 0.5""")
def _(spark, sf):
    c = audit.unsupported_claims(answers(spark, sf), contexts(spark, sf))
    return c.select("question_id", "n", "claim", F.round("support", 6).alias("support"))


# --- evaluation -----------------------------------------------------------

EVAL = f"""{AUDIT},
asked AS (SELECT conv_id || '-' || (turn + 1) AS question_id, list_transform(string_split(text, ' '), lambda g: trim(g, '.,' || chr(10))) AS gold
  FROM conversations WHERE role = 'user'),
scored AS MATERIALIZED (SELECT a.question_id, a.answer, coalesce(gold, []) AS gold, n, used,
  CASE WHEN len(coalesce(gold, [])) = 0 THEN 0.0 ELSE len(list_filter(gold, lambda g: contains(lower(a.answer), lower(g)))) / len(gold) END::DOUBLE AS coverage,
  len(invalid) + len(fake_pmids) + len(fake_ncts) + len(fake_docs) AS fakes,
  len(pmids) + len(ncts) + CASE WHEN len(regexp_extract_all(a.answer, '\\[\\d+\\]')) >= 3 THEN 1 ELSE 0 END AS signal
  FROM audit a LEFT JOIN asked USING (question_id)),
results AS MATERIALIZED (SELECT question_id AS id, CASE WHEN contains(question_id, '3') THEN 'nutrition' ELSE 'clinical' END AS track,
  fakes AS rag_fakes, signal, round(coverage, 6) AS rag_cov, round(1 - coverage, 6) AS base_cov,
  len(used) > 1 AS rag_cites, fakes = 4 AS refused, CASE WHEN fakes = 4 THEN 0 ELSE n END AS rag_n FROM scored)"""


def _gold(spark, sf):
    user = table(spark, sf, "conversations").where("role = 'user'")
    words = F.transform(F.split("text", " "), lambda g: F.trim(g, F.lit(".,\n")))
    return user.select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string"))
                       .alias("question_id"), words.alias("gold"))


def _scored(spark, sf):
    a = audit.verify_citations(answers(spark, sf), contexts(spark, sf)).join(_gold(spark, sf), "question_id", "left")
    return a.withColumns({
        "coverage": evaluate.gold_coverage(F.col("answer"), F.col("gold")),
        "signal": audit.baseline_fake_signal(F.col("answer"))})


def _results(spark, sf):
    """Both arms per answer. The second arm mirrors the first, so the deltas are not trivial."""
    s = _scored(spark, sf)
    refused = F.col("fake_citation_count") == 4
    cov = F.col("coverage")
    return s.select(
        F.col("question_id").alias("id"),
        F.when(F.contains("question_id", F.lit("3")), "nutrition").otherwise("clinical").alias("track"),
        F.struct(F.col("fake_citation_count"), (F.size("used_brackets") > 1).alias("has_citations"),
                 refused.alias("refused"), F.round(cov, 6).alias("gold_coverage"),
                 F.when(refused, 0).otherwise(F.col("n_contexts")).alias("n_contexts")).alias("rag"),
        F.struct(F.col("signal").alias("fake_citation_signal"), F.round(1 - cov, 6).alias("gold_coverage")).alias("baseline"))


@query("gold_coverage", f"WITH {EVAL} SELECT question_id, round(coverage, 6) AS gold_coverage FROM scored")
def _(spark, sf):
    return _scored(spark, sf).select("question_id", F.round("coverage", 6).alias("gold_coverage"))


_SUMMARY = f"""{EVAL}, summary AS (SELECT count(*) AS n,
  round(avg((rag_fakes > 0)::INT), 3) AS rag_fake_citation_rate, round(avg((signal > 0)::INT), 3) AS baseline_fake_citation_signal_rate,
  round(avg(rag_cites::INT), 3) AS rag_citation_coverage, round(avg(refused::INT), 3) AS rag_refusal_rate,
  round(avg(rag_cov), 3) AS rag_avg_gold_coverage, round(avg(base_cov), 3) AS baseline_avg_gold_coverage,
  count(*) FILTER (rag_n = 0) AS rag_empty_context_cases FROM results)"""


@query("arm_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def _(spark, sf):
    return evaluate.summarize(_results(spark, sf))


@query("metric_delta", f"""
WITH {_SUMMARY} SELECT round(rag_fake_citation_rate - baseline_fake_citation_signal_rate, 3) AS fake_citation_delta,
  round(rag_avg_gold_coverage - baseline_avg_gold_coverage, 3) AS gold_coverage_delta FROM summary""")
def _(spark, sf):
    return evaluate.metric_delta(evaluate.summarize(_results(spark, sf)))


@query("typical_cases", f"""
WITH {EVAL}, c AS (SELECT id, CASE WHEN refused THEN 'refusal' WHEN signal > rag_fakes THEN 'fake_citation_contrast'
  WHEN rag_cov < base_cov THEN 'retrieval_drag' ELSE 'plain' END AS case_class FROM results)
SELECT case_class, id, row_number() OVER (PARTITION BY case_class ORDER BY id) AS n FROM c QUALIFY n <= 3""")
def _(spark, sf):
    return evaluate.typical_cases(_results(spark, sf), 3).select("case_class", "id", "n")


@query("rubric_template", f"""
WITH {ANSWERS} SELECT question_id AS id, unnest(['completeness', 'relevance', 'readability', 'unsafe_advice']) AS dimension,
  NULL::BIGINT AS score, '' AS reviewer FROM answers""")
def _(spark, sf):
    return evaluate.rubric_template(answers(spark, sf).select(F.col("question_id").alias("id")))


@query("result_lines", f"""
WITH {EVAL} SELECT id, '| ' || id || ' | ' || track || ' | ' || rag_fakes || ' | ' || signal || ' | ' || printf('%.2f', rag_cov) || ' | '
  || printf('%.2f', base_cov) || ' | ' || CASE WHEN refused THEN 'True' ELSE 'False' END || ' |' AS line FROM results""")
def _(spark, sf):
    return evaluate.markdown_rows(_results(spark, sf))


def known_pages(spark, sf):
    i = F.col("doc_id").cast("string")
    article = (F.col("doc_id") + 100000).cast("string")
    trial = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("nct:NCT"), F.lpad(i, 8, "0")))
    return table(spark, sf, "documents").select(F.explode(F.array_compact(F.array(
        F.concat(F.lit("local:"), i), F.concat(F.lit("pmid:"), article), trial))).alias("doc_id"))


_CHECKED = f"""{ANSWERS}, {CONTEXTS}, known AS (SELECT 'local:' || doc_id AS doc_id FROM documents UNION ALL SELECT 'pmid:' || (doc_id + 100000) FROM documents
  UNION ALL SELECT 'nct:NCT' || lpad(doc_id::VARCHAR, 8, '0') FROM documents WHERE doc_id % 2 = 0),
cited AS (SELECT question_id, doc_id FROM contexts),
c AS (SELECT question_id, count(*) AS citation_count, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM known)) AS bad FROM cited GROUP BY ALL),
r AS (SELECT question_id, conv_id % 4 = 0 AS refused, conv_id % 3 = 0 AS expect, citation_count, bad = 0 AS cite_ids_valid FROM answers JOIN c USING (question_id))"""


@query("assessment_checks", f"""
WITH {_CHECKED}
SELECT question_id, citation_count, true AS cite_present, cite_ids_valid, refused = expect AS refuse_correct,
  cite_ids_valid AND refused = expect AS passed FROM r""")
def _(spark, sf):
    records = answers(spark, sf).select(
        "question_id", (F.col("conv_id") % 4 == 0).alias("refused"), F.lit(True).alias("must_cite"),
        (F.col("conv_id") % 3 == 0).alias("expect_refusal"))
    cited = contexts(spark, sf).select("question_id", "doc_id")
    known = known_pages(spark, sf)
    return evaluate.assessment_checks(records, cited, known).select(
        "question_id", "citation_count", "cite_present", "cite_ids_valid", "refuse_correct", "passed")


@query("assessment_summary", f"""
WITH {_CHECKED} SELECT count(*) AS n, count(*) FILTER (cite_ids_valid AND refused = expect) AS passed FROM r""")
def _(spark, sf):
    records = answers(spark, sf).select(
        "question_id", (F.col("conv_id") % 4 == 0).alias("refused"), F.lit(True).alias("must_cite"),
        (F.col("conv_id") % 3 == 0).alias("expect_refusal"))
    cited = contexts(spark, sf).select("question_id", "doc_id")
    return evaluate.assessment_summary(evaluate.assessment_checks(records, cited, known_pages(spark, sf)))


# --- flows over supplied answers --------------------------------------------

_NOTED = SQL["audit_note"].rsplit("SELECT question_id, CASE", 1)


@query("finished_answers", f"""
{_NOTED[0]}, noted AS (SELECT question_id, CASE{_NOTED[1]}),
plain AS (SELECT question_id, conv_id % 2 = 0 AS nutrition, conv_id % 5 = 0 AS refused, a.answer AS given, n.answer AS noted,
  replace(replace(n.answer, 'tion', 'act'), 'the ', 'this ') AS plain FROM noted n JOIN answers a USING (question_id))
SELECT question_id, CASE WHEN refused THEN given WHEN NOT nutrition THEN noted WHEN regexp_matches(plain, '\\d+(\\.\\d+)?\\s*(nct|pmid)') AND contains(plain, 'la ')
  THEN rtrim(plain) || ' !' ELSE plain END AS answer FROM plain""")
def _(spark, sf):
    a = answers(spark, sf).withColumns({
        "track": F.when(F.col("conv_id") % 2 == 0, "nutrition").otherwise("clinical"), "refused": F.col("conv_id") % 5 == 0})
    return finish_answers(a, contexts(spark, sf), [("tion", "act"), ("the ", "this ")], r"\d+(\.\d+)?\s*(nct|pmid)", ["la "], " !").select(
        "question_id", "answer")


@query("evaluation_flow", f"""
WITH {EVAL}, plain AS (SELECT conv_id || '-' || (turn + 1) AS question_id, text || ' PMID: 1234567 [1] [2] [3]' AS answer FROM conversations WHERE role = 'user')
SELECT s.question_id AS id, CASE WHEN contains(s.question_id, '3') THEN 'nutrition' ELSE 'clinical' END AS track, fakes AS rag_fakes,
  round(coverage, 6) AS rag_coverage, CASE WHEN fakes = 4 THEN 0 ELSE n END AS n_contexts,
  coalesce(len(regexp_extract_all(p.answer, '(?i)PMID[:\\s]*([0-9]{{5,9}})', 1)) + 1, 0)::BIGINT AS baseline_signal,
  round(CASE WHEN len(gold) = 0 THEN 0 ELSE len(list_filter(gold, lambda g: contains(lower(coalesce(p.answer, '')), lower(g)))) / len(gold) END::DOUBLE, 6) AS baseline_coverage
FROM scored s LEFT JOIN plain p USING (question_id)""")
def _(spark, sf):
    a = answers(spark, sf).select("question_id", "answer")
    gold = _gold(spark, sf)
    refused = audit.verify_citations(a, contexts(spark, sf)).select("question_id", "answer", (F.col("fake_citation_count") == 4).alias("refused"))
    items = a.select("question_id").join(gold, "question_id", "left").select(
        F.col("question_id").alias("id"), F.when(F.contains("question_id", F.lit("3")), "nutrition").otherwise("clinical").alias("track"),
        F.col("gold").alias("gold_points"))
    user = table(spark, sf, "conversations").where("role = 'user'")
    plain = user.select(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("question_id"),
                        F.concat("text", F.lit(" PMID: 1234567 [1] [2] [3]")).alias("answer"))
    out = compare_arms(items, refused, plain, contexts(spark, sf))
    return out.select("id", "track", F.col("rag.fake_citation_count").alias("rag_fakes"), F.round("rag.gold_coverage", 6).alias("rag_coverage"),
                      F.col("rag.n_contexts").alias("n_contexts"), F.col("baseline.fake_citation_signal").alias("baseline_signal"),
                      F.round("baseline.gold_coverage", 6).alias("baseline_coverage"))
