"""Landed-file readers, topic pages and identifier checks.

The payloads are built by Spark from the given tables, so that the readers see
as many records as the tables have rows.
"""

from pyspark.sql import functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import strip
from corpusloom.operators import curate, topics, verify
from corpusloom.operators.common import new_folder
from corpusloom.plans.corpus import DOCS, docs, table
from corpusloom.plans.registry import query
from corpusloom.schemas import DOC_FIELDS
from corpusloom.sources import curated, files, markdown, payloads

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query("docs_json_roundtrip", f"""
WITH {DOCS} SELECT doc_id, source, title, text, year::BIGINT AS year, url, array_to_string(tags, '|') AS tags, evidence_level,
  journal, doi, is_oa FROM docs""")
def _(spark, sf):
    lines = docs(spark, sf).select(F.to_json(F.struct(*DOC_FIELDS)).alias("value"))
    back = lines.select(files.parse_docs(F.col("value")).alias("d")).select("d.*")
    return back.select(*[c for c in DOC_FIELDS if c != "extra"], F.element_at("extra", "isOpenAccess").alias("is_oa"))


@query("docs_files", f"""
WITH {DOCS} SELECT doc_id, source, title, text, year::BIGINT AS year, url, array_to_string(tags, '|') AS tags, evidence_level,
  journal, doi, is_oa FROM docs""")
def _(spark, sf):
    """Documents written as files and read back, many to a file."""
    path = new_folder(spark)
    files.write_docs(docs(spark, sf), path)
    back = files.read_docs(spark, path)
    return back.select(*[c for c in DOC_FIELDS if c != "extra"], F.element_at("extra", "isOpenAccess").alias("is_oa"))


@query("questions_file", """
SELECT item_id::VARCHAR AS id, text AS question, 'clinical' AS track, true AS must_cite, '' AS gold_points FROM benchmark""")
def _(spark, sf):
    path = new_folder(spark)
    lines = table(spark, sf, "benchmark").select(F.to_json(F.struct(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"))).alias("value"))
    lines.unionByName(lines.limit(1).select(F.lit("{no json").alias("value"))).write.text(path)
    return files.read_questions(spark, path)


@query("merge_files_order", """
SELECT 'd' || (doc_id % 100) AS doc_id, arg_min(text, ((doc_id % 7) % 3, doc_id % 7, doc_id)) AS text FROM documents GROUP BY ALL""")
def _(spark, sf):
    """First wins by path, whatever the sizes: files named 0 to 6 in three sources hold all documents, repeated ids."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), (i % 100).cast("string")).alias("doc_id"), "text", (i % 7).alias("part"), i.alias("at"))
    sources = []
    for source in range(3):
        path = new_folder(spark)
        rows = d.where(F.col("part") % 3 == source)
        rows.repartition("part").sortWithinPartitions("part", "at").select("doc_id", "text", "part").write.partitionBy("part").json(path)
        sources.append(files.read_docs(spark, path))
    return curate.merge_first_wins(curate.union_sources(*sources)).select("doc_id", "text")


@query("questions_jsonl", """
SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN 'nutrition' ELSE 'clinical' END AS track,
  true AS must_cite, CASE WHEN item_id % 3 = 0 THEN 'a|b' ELSE '' END AS gold_points FROM benchmark""")
def _(spark, sf):
    b = table(spark, sf, "benchmark")
    item = F.struct(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, "nutrition").alias("track"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("gold_points"))
    lines = b.select(F.explode(F.array(F.to_json(item), F.lit("  "))).alias("value"))
    return files.questions_from_lines(lines)


@query("stage_manifest", """
SELECT 'collected' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'distinct_texts', count(DISTINCT text) FROM documents
UNION ALL SELECT 'questions', count(*) FROM benchmark""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return files.stage_counts({"collected": d, "distinct_texts": d.select("text").distinct(),
                               "questions": table(spark, sf, "benchmark")})


@query("curated_jsonl", """
WITH r AS (SELECT doc_id, 'pmid:' || doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE substr(text, 1, 30) END AS title, text,
  (1990 + doc_id % 30) AS year, CASE WHEN doc_id % 5 = 0 THEN 'https://x/' || doc_id ELSE '' END AS url,
  CASE lang WHEN 'en' THEN 'guideline' WHEN 'fr' THEN 'umbrella_review' WHEN 'de' THEN 'cohort_study' ELSE 'letter' END AS source_type,
  CASE WHEN doc_id % 2 = 0 THEN 'core' END AS role FROM documents WHERE lang <> 'es')
SELECT id AS doc_id, CASE WHEN title = '' THEN id ELSE title END AS title, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, year::BIGINT AS year,
  CASE WHEN url = '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' ELSE url END AS url,
  concat_ws('|', 'salt', role, source_type) AS tags,
  CASE source_type WHEN 'guideline' THEN 'guideline' WHEN 'umbrella_review' THEN 'meta' WHEN 'cohort_study' THEN 'observational' ELSE 'other' END AS evidence_level,
  source_type, role FROM r""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    kind = F.when(F.col("lang") == "en", "guideline").when(F.col("lang") == "fr", "umbrella_review").when(
        F.col("lang") == "de", "cohort_study").otherwise("letter")
    record = F.struct(
        F.when(F.col("lang") == "es", " ").otherwise(F.concat(F.lit("pmid:"), i)).alias("id"),
        F.when(i % 4 == 0, "").otherwise(F.substring("text", 1, 30)).alias("title"), "text",
        (i % 30 + 1990).alias("year"), F.when(i % 5 == 0, F.concat(F.lit("https://x/"), i)).alias("url"),
        kind.alias("source_type"), F.when(i % 2 == 0, "core").alias("evidence_role"))
    out = curated.curated_docs(d.select(F.to_json(record).alias("value"), i.alias("pos")), "salt")
    return out.select("doc_id", "title", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "year", "url", "tags", "evidence_level",
                      F.element_at("extra", "source_type").alias("source_type"),
                      F.try_element_at("extra", F.lit("evidence_role")).alias("role"))


@query("collection_join", f"""
SELECT 'pmid:' || doc_id AS doc_id, CASE WHEN t = '' THEN 'f' || doc_id ELSE t END AS title, text,
  CASE WHEN doc_id % 3 <> 0 THEN 2000 + doc_id % 20 END::BIGINT AS year, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url, n_chars::VARCHAR AS if_value
FROM (SELECT *, trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE substr(text, 1, 400) END, {_WS}) AS t0, t0 AS t FROM documents)
WHERE lang <> 'de'""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    path = F.concat(F.lit("pdf/f"), i, F.lit(".pdf"))
    manifest = d.select(
        F.when(F.col("lang") == "de", " ").otherwise(i.cast("string")).alias("pmid"), path.alias("dest_pdf"),
        F.when(i % 5 == 0, " ").otherwise(F.substring("text", 1, 400)).alias("title"),
        F.when(i % 3 == 0, "n.d.").otherwise((i % 20 + 2000).cast("string")).alias("pub_year"),
        F.col("n_chars").cast("string").alias("if_value"), F.lit(None).cast("string").alias("q_value"),
        F.lit("x").alias("nlm_unique_id"), i.alias("pos"))
    out = curated.collection_docs(manifest, d.select(path.alias("dest_pdf"), "text"))
    return out.select("doc_id", "title", "text", "year", "url", F.element_at("extra", "if_value").alias("if_value"))


def _md_files(spark, sf):
    """Each document as a Markdown file: some of its lines become headings."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(F.lit("## "), x)).when(
        i % 4 == 3, F.concat(F.lit("#"), x)).otherwise(x))
    return table(spark, sf, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id")).alias("stem"), F.array_join(lines, "\n").alias("text"),
        F.col("doc_id").alias("pos"))


_MD = f"""md AS MATERIALIZED (
  SELECT 'f' || doc_id AS stem, pos - 1 AS pos, CASE WHEN (pos - 1) % 4 = 1 THEN '## ' || l WHEN (pos - 1) % 4 = 3 THEN '#' || l ELSE l END AS line
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS pos FROM (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
keptl AS (SELECT * FROM md QUALIFY NOT (line = '' AND pos = max(pos) OVER (PARTITION BY stem))),
sec AS (SELECT *, sum(CASE WHEN pos = 0 OR regexp_matches(line, '^#{{1,6}}\\s') THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY pos) - 1 AS i FROM keptl),
head_text AS (SELECT stem, i, CASE WHEN regexp_matches(arg_min(line, pos), '^#{{1,6}}\\s') THEN trim(regexp_extract(arg_min(line, pos), '^#{{1,6}}\\s+(.*)$', 1)) END AS t,
  trim(string_agg(line, chr(10) ORDER BY pos), {_WS}) AS text FROM sec GROUP BY ALL),
sections AS MATERIALIZED (SELECT stem, i, text, coalesce(last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY stem ORDER BY i), stem) AS title FROM head_text)"""


@query("section_split", f"""
WITH {_MD} SELECT stem, i::BIGINT AS i, title, text FROM sections WHERE text <> ''""")
def _(spark, sf):
    return markdown.with_sections(_md_files(spark, sf).drop("pos")).where("text <> ''")


@query("markdown_docs", f"""
WITH {_MD}, whole AS (SELECT stem, string_agg(line, chr(10) ORDER BY pos) AS text FROM md GROUP BY ALL)
SELECT 'local:md:' || stem AS doc_id, stem AS title, text FROM whole WHERE length(text) <= 3000
UNION ALL SELECT 'local:md:' || s.stem || ':' || i, title, s.text FROM sections s JOIN whole w ON w.stem = s.stem
  WHERE length(w.text) > 3000 AND s.text <> ''""")
def _(spark, sf):
    return markdown.markdown_docs(_md_files(spark, sf), whole_below=3000, max_chars=100_000).select("doc_id", "title", "text")


# Packing as a walk over units: paragraphs, the sentences of a long one, or the parts of a long sentence.
_PACK = f"""para AS (SELECT stem, i, p, trim(x, {_WS}) AS para FROM (SELECT stem, i, unnest(ps) AS x, generate_subscripts(ps, 1) AS p
    FROM (SELECT stem, i, string_split_regex(text, '\\n\\s*\\n') AS ps FROM sections WHERE length(text) > 800)) WHERE trim(x, {_WS}) <> ''),
judged AS (SELECT *, length(para) > 800 AS long, coalesce(lag(length(para) > 800) OVER (PARTITION BY stem, i ORDER BY p), false) AS after_long FROM para),
sentence AS (SELECT stem, i, p, unnest(ss) AS st, generate_subscripts(ss, 1) AS q FROM (SELECT stem, i, p,
    regexp_extract_all(para, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$') AS ss FROM judged WHERE long)),
broken AS (SELECT *, coalesce(lag(length(st) <= 800) OVER (PARTITION BY stem, i, p ORDER BY q), false) AS joins FROM sentence),
unit AS (SELECT stem, i, p, 0 AS q, 0 AS r, CASE WHEN NOT after_long THEN chr(10) END AS glue, para AS piece FROM judged WHERE NOT long
  UNION ALL SELECT stem, i, p, q, r, CASE WHEN joins AND length(st) <= 800 THEN '' END, substr(st, r * 800 + 1, 800)
  FROM (SELECT *, unnest(range(0, (length(st) + 799) // 800)) AS r FROM broken)),
units AS MATERIALIZED (SELECT stem, i, glue, piece, row_number() OVER (PARTITION BY stem, i ORDER BY p, q, r) AS n FROM unit),
walk AS (SELECT stem, i, n, 0 AS g, piece AS cur FROM units WHERE n = 1
  UNION ALL SELECT w.stem, w.i, u.n,
    CASE WHEN u.glue IS NOT NULL AND length(w.cur) + length(u.glue) + length(u.piece) <= 800 THEN w.g ELSE w.g + 1 END,
    CASE WHEN u.glue IS NOT NULL AND length(w.cur) + length(u.glue) + length(u.piece) <= 800 THEN w.cur || u.glue || u.piece ELSE u.piece END
  FROM walk w JOIN units u ON u.stem = w.stem AND u.i = w.i AND u.n = w.n + 1),
packed AS (SELECT stem, i, g, arg_max(cur, n) AS text FROM walk GROUP BY ALL)"""


@query("section_pack", f"""
WITH RECURSIVE {_MD}, {_PACK} SELECT *, trim(text, {_WS}) AS stripped FROM (
  SELECT 'local:md:' || stem || ':' || i AS doc_id, title, text FROM sections WHERE text <> '' AND length(text) <= 800
  UNION ALL SELECT 'local:md:' || p.stem || ':' || p.i || ':' || g, title || '（' || (g + 1) || '）', p.text FROM packed p JOIN sections s
    ON s.stem = p.stem AND s.i = p.i)""")
def _(spark, sf):
    out = markdown.split_sections(_md_files(spark, sf), max_chars=800)
    return out.select("doc_id", "title", "text", strip(F.col("text")).alias("stripped"))


def _table_files(spark, sf):
    """A literature table per document, with its text in the first column."""
    i = F.col("doc_id")
    first = F.regexp_replace("text", r"[|*\n]", " ")
    pmid = (i + 1_000_000).cast("string")
    row = F.concat(F.lit("| "), first, F.lit(" | Smith et al. *J "), F.col("source"), F.lit("* | PMID "), pmid,
                   F.lit(" · 10.5555/d"), i, F.lit(" | "), (i % 30 + 1990).cast("string"), F.lit(" |"))
    again = F.concat(F.lit("| again | [Jones et al.](http://x) | "), pmid, F.lit(" |"))
    other = F.concat(F.lit("| BM25 note | "), (i + 2_000_000).cast("string"), F.lit(" |"))
    md = F.concat(F.lit("# list\n| "), F.col("lang"), F.lit(" | 文献 |\n|---|---|\n"), row, F.lit("\n"), again, F.lit("\n"), other,
                  F.lit("\n\nplain text\n"))
    return table(spark, sf, "documents").select(F.concat(F.lit("f"), i).alias("file"), md.alias("text"))


_LIT = f"""lit AS (SELECT doc_id, lang, '| ' || regexp_replace(text, '[|*\\n]', ' ', 'g') || ' | Smith et al. *J ' || source || '* | PMID '
    || (doc_id + 1000000) || ' · 10.5555/d' || doc_id || ' | ' || (doc_id % 30 + 1990) || ' |' AS line,
  trim(regexp_replace(text, '[|*\\n]', ' ', 'g')) AS c0, source FROM documents)"""


@query("table_context", f"""
WITH {_LIT} SELECT 'f' || doc_id AS file, 3::BIGINT AS pos, line, lang AS context FROM lit
UNION ALL SELECT 'f' || doc_id, 4, '| again | [Jones et al.](http://x) | ' || (doc_id + 1000000) || ' |', lang FROM lit
UNION ALL SELECT 'f' || doc_id, 5, '| BM25 note | ' || (doc_id + 2000000) || ' |', lang FROM lit
UNION ALL SELECT 'f' || doc_id, 1, '| ' || lang || ' | 文献 |', '{rules.LITERATURE_DEFAULT_CONTEXT}' FROM lit""")
def _(spark, sf):
    return markdown.literature_rows(_table_files(spark, sf)).select("file", F.col("at").alias("pos"), "line", "context")


@query("literature_docs", f"""
WITH {_LIT} SELECT 'pmid:' || (doc_id + 1000000) AS doc_id, 'Smith et al. *J ' || source || '*' AS title,
  '文献出处：' || 'Smith et al. *J ' || source || '*' || chr(10) || lang AS text, (doc_id % 30 + 1990)::BIGINT AS year,
  '10.5555/d' || doc_id AS doi, 'Smith et al. *J ' || source || '*' AS journal FROM lit""")
def _(spark, sf):
    return markdown.literature_docs(_table_files(spark, sf)).select("doc_id", "title", "text", "year", "doi", "journal")


def _xml(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _xml_records(spark, sf):
    i = F.col("doc_id")
    words = F.split("text", " ")
    title = F.concat(_xml(words[0]), F.lit(" <i>"), _xml(F.col("source")), F.lit("</i> end"))
    year = F.when(i % 3 == 0, F.concat(F.lit("<MedlineDate>"), (i % 30 + 1990), F.lit(" Jan-Feb</MedlineDate>"))).otherwise(
        F.concat(F.lit("<Year>"), (i % 30 + 1990), F.lit("</Year>")))
    abstract = F.when(i % 5 == 0, "").otherwise(F.concat(
        F.lit("<Abstract><AbstractText>"), _xml(strip(F.col("text"))), F.lit("</AbstractText>"),
        F.array_join(F.transform(F.sequence(F.lit(2), i % 60 + 2), lambda k: F.concat(
            F.lit("<AbstractText Label=\"x\">part <b>"), k.cast("string"), F.lit("</b> here</AbstractText>"))), ""),
        F.lit("</Abstract>")))
    xml = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), i, F.lit("</PMID><Article><Journal><Title>J "), F.col("source"),
        F.lit("</Title><JournalIssue><PubDate>"), year, F.lit("</PubDate></JournalIssue></Journal><ArticleTitle>"), title,
        F.lit("</ArticleTitle>"), abstract, F.lit("<PublicationTypeList><PublicationType>"),
        F.when(F.col("lang") == "en", "Randomized Controlled Trial").otherwise("Letter"),
        F.lit("</PublicationType><PublicationType>Journal Article</PublicationType></PublicationTypeList></Article></MedlineCitation>"
              "<PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.5555/"), i,
        F.lit("</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType=\"doi\">10.1/ref</ArticleId>"
              "</ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"))
    return table(spark, sf, "documents").select(xml.alias("xml"), i.alias("pos"))


@query("pubmed_payload", f"""
WITH r AS (SELECT *, trim(string_split(text, ' ')[1] || ' ' || source || ' end', {_WS}) AS title FROM documents)
SELECT 'pmid:' || doc_id AS doc_id, title, CASE WHEN doc_id % 5 = 0 THEN title ELSE trim(text, {_WS}) || list_reduce(list_transform(range(2, doc_id % 60 + 3),
    lambda k: chr(10) || 'part ' || k || ' here'), lambda x, y: x || y) END AS text,
  (doc_id % 30 + 1990)::BIGINT AS year, 'J ' || source AS journal, '10.5555/' || doc_id AS doi,
  CASE WHEN lang = 'en' THEN 'rct' ELSE 'other' END AS evidence_level,
  '["' || CASE WHEN lang = 'en' THEN 'Randomized Controlled Trial' ELSE 'Letter' END || '","Journal Article"]' AS pub_types FROM r""")
def _(spark, sf):
    return payloads.pubmed_docs(_xml_records(spark, sf)).select(
        "doc_id", "title", "text", "year", "journal", "doi", "evidence_level", F.element_at("extra", "pub_types").alias("pub_types"))


def _studies(spark, sf):
    """One registry response per document with one study."""
    i = F.col("doc_id")

    def opt(cond, value):
        return F.when(cond, value)

    study = F.struct(F.struct(
        F.struct(F.concat(F.lit("NCT"), F.lpad(i.cast("string"), 8, "0")).alias("nctId"),
                 opt(i % 3 != 0, F.concat(F.lit("Official "), F.col("source"))).alias("officialTitle"),
                 opt(i % 6 != 0, F.lit("Brief")).alias("briefTitle")).alias("identificationModule"),
        F.struct(opt(i % 4 != 0, F.col("text")).alias("briefSummary")).alias("descriptionModule"),
        F.struct(F.lit("RECRUITING").alias("overallStatus"), F.struct(F.concat(
            (i % 30 + 1990).cast("string"), F.lit("-05")).alias("date")).alias("startDateStruct")).alias("statusModule"),
        F.struct(F.array("lang", "source").alias("conditions")).alias("conditionsModule"),
        F.struct(F.array(F.struct(F.lit("drug a").alias("name")), F.struct(F.lit("").alias("name")),
                         F.struct(F.lit("diet b").alias("name"))).alias("interventions")).alias("armsInterventionsModule"),
        F.struct(opt(i % 2 == 0, F.array(
            F.struct(F.lit(" m1 ").alias("measure"), F.lit("1 y").alias("timeFrame")),
            F.struct(F.lit("").alias("measure"), F.lit("2 y").alias("timeFrame")),
            F.struct(F.col("lang").alias("measure"), F.lit(None).cast("string").alias("timeFrame")))).alias("primaryOutcomes"),
            F.array(F.struct(F.lit("second").alias("measure"), F.lit("").alias("timeFrame"))).alias("secondaryOutcomes"))
        .alias("outcomesModule"),
        F.struct(F.array(F.lit("PHASE2")).alias("phases"), F.struct(i.alias("count")).alias("enrollmentInfo"))
        .alias("designModule")).alias("protocolSection"))
    value = F.to_json(F.struct(F.array(study).alias("studies")))
    return payloads.studies(table(spark, sf, "documents").select(value.alias("value"), i.alias("pos")))


_TRIAL = """tr AS (SELECT *, 'NCT' || lpad(doc_id::VARCHAR, 8, '0') AS nct,
  CASE WHEN doc_id % 3 <> 0 THEN 'Official ' || source WHEN doc_id % 6 <> 0 THEN 'Brief' ELSE 'NCT' || lpad(doc_id::VARCHAR, 8, '0') END AS title,
  CASE WHEN doc_id % 2 = 0 THEN 'm1（1 y）；' || lang ELSE 'second' END AS outcome FROM documents)"""


@query("trials_payload", f"""
WITH {_TRIAL} SELECT 'nct:' || nct AS doc_id, title, CASE WHEN doc_id % 4 <> 0 THEN text ELSE title END || chr(10) || chr(10) || 'Status: RECRUITING' || chr(10)
  || 'Conditions: ' || lang || ', ' || source || chr(10) || 'Interventions: drug a, diet b' || chr(10) || 'Primary Outcome: ' || outcome AS text,
  (doc_id % 30 + 1990)::BIGINT AS year, 'https://clinicaltrials.gov/study/' || nct AS url, 'rct' AS evidence_level, outcome,
  '["' || lang || '","' || source || '"]' AS conditions FROM tr""")
def _(spark, sf):
    return payloads.trial_docs(_studies(spark, sf)).select(
        "doc_id", "title", "text", "year", "url", "evidence_level", F.element_at("extra", "primary_outcome").alias("outcome"),
        F.element_at("extra", "conditions").alias("conditions"))


@query("trial_outcomes", f"WITH {_TRIAL} SELECT nct, outcome FROM tr")
def _(spark, sf):
    return _studies(spark, sf).select(F.col("p.identificationModule.nctId").alias("nct"),
                                      payloads.primary_outcome(F.col("p.outcomesModule")).alias("outcome"))


@query("europepmc_payload", """
SELECT 'epmc:' || CASE WHEN doc_id % 4 = 0 THEN 'MED' ELSE 'PMC' END || ':' || CASE WHEN doc_id % 3 = 0 THEN 'p' || doc_id ELSE 'i' || doc_id END AS doc_id,
  substr(text, 1, 20) AS title, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 20) ELSE text END AS text,
  CASE WHEN doc_id % 6 <> 0 THEN 1990 + doc_id % 30 END::BIGINT AS year,
  CASE WHEN doc_id % 3 = 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/p' || doc_id || '/' ELSE 'https://europepmc.org/article/'
    || CASE WHEN doc_id % 4 = 0 THEN 'MED' ELSE 'PMC' END || '/i' || doc_id END AS url,
  CASE WHEN lang = 'en' THEN 'meta' ELSE 'other' END AS evidence_level, source AS journal, CASE WHEN n_chars % 2 = 0 THEN 'Y' ELSE '' END AS is_oa
FROM documents""")
def _(spark, sf):
    i = F.col("doc_id")
    item = F.struct(
        F.when(i % 4 != 0, "PMC").alias("source"), F.when(i % 3 != 0, F.concat(F.lit("i"), i)).alias("id"),
        F.when(i % 3 == 0, F.concat(F.lit("p"), i)).alias("pmid"), F.substring("text", 1, 20).alias("title"),
        F.when(i % 5 != 0, F.col("text")).alias("abstractText"),
        F.when(i % 6 == 0, "n.d.").otherwise((i % 30 + 1990).cast("string")).alias("pubYear"),
        F.when(F.col("lang") == "en", "Systematic Review").otherwise("letter").alias("pubType"),
        F.col("source").alias("journalTitle"), F.when(F.col("n_chars") % 2 == 0, "Y").alias("isOpenAccess"))
    value = F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("resultList")))
    out = payloads.europepmc_docs(table(spark, sf, "documents").select(value.alias("value"), i.alias("pos")))
    return out.select("doc_id", "title", "text", "year", "url", "evidence_level", "journal",
                      F.element_at("extra", "isOpenAccess").alias("is_oa"))


# --- topic pages ----------------------------------------------------------

TOPICS = [("both", "Both words", ["that", "with"]), ("french", "French", ["fr", "elle"]), ("german", "German", ["de", "keit", "with"]),
          ("nothing", "Nothing", ["absent"])]
_TOPIC_SQL = """topics AS (SELECT * FROM (VALUES ('both', 'Both words', ['that', 'with']), ('french', 'French', ['fr', 'elle']),
  ('german', 'German', ['de', 'keit', 'with']), ('nothing', 'Nothing', ['absent'])) t(slug, title, query_tags)),
chosen AS MATERIALIZED (SELECT slug, doc_id, ord, overlap, row_number() OVER (PARTITION BY slug ORDER BY overlap DESC, coalesce(year, 0) DESC, ord) AS rank
  FROM (SELECT slug, doc_id, ord, year, len(list_intersect(tags, query_tags)) AS overlap FROM docs, topics) WHERE overlap > 0 QUALIFY rank <= 8),
blocks AS MATERIALIZED (SELECT slug, t.title, query_tags, count(c.doc_id) AS n_docs, coalesce(string_agg('- [' || d.doc_id || '] ' || d.title || ' (' || coalesce(d.year::VARCHAR, 'n/a') || '): '
  || substr(d.text, 1, 400), chr(10) || chr(10) ORDER BY rank), '（暂无相关文档）') AS block
  FROM topics t LEFT JOIN chosen c USING (slug) LEFT JOIN docs d ON d.doc_id = c.doc_id GROUP BY ALL)"""


@query("topic_select", f"WITH {DOCS}, {_TOPIC_SQL} SELECT slug, doc_id, overlap::BIGINT AS overlap, rank FROM chosen")
def _(spark, sf):
    return topics.select_docs(docs(spark, sf), topics.topic_table(spark, TOPICS)).select("slug", "doc_id", "overlap", "rank")


@query("topic_blocks", f"WITH {DOCS}, {_TOPIC_SQL} SELECT slug, n_docs, block FROM blocks")
def _(spark, sf):
    return topics.evidence_lines(docs(spark, sf), topics.topic_table(spark, TOPICS)).select("slug", "n_docs", "block")


@query("topic_refresh", f"""
WITH {DOCS}, {_TOPIC_SQL} SELECT 'wiki:' || slug AS doc_id, title, block || chr(10) || chr(10) || '---' || chr(10) || '> 本页基于 ' || n_docs
  || ' 条证据文档生成 · 更新于 2025-01-01 · 非诊疗建议' AS text, array_to_string(list_concat(query_tags, ['wiki']), '|') AS tags FROM blocks WHERE slug = 'french'""")
def _(spark, sf):
    page = topics.refresh_page(docs(spark, sf), topics.topic_table(spark, TOPICS), "french", "2025-01-01")
    return page.select("doc_id", "title", "text", "tags")


@query("topic_files", f"""
WITH {DOCS}, {_TOPIC_SQL} SELECT slug, title, '# ' || title || chr(10) || chr(10) || block || chr(10) || chr(10) || '---' || chr(10) || '> 本页基于 ' || n_docs
  || ' 条证据文档生成 · 更新于 2025-01-01 · 非诊疗建议' || chr(10) AS text,
  CASE WHEN slug = 'nothing' THEN 'missing_sections|no_page' ELSE 'missing_sections' END AS issues FROM blocks""")
def _(spark, sf):
    """Pages and index are written, read back and linted; of one page only the index entry is left and another page lacks nothing but
    its sections."""
    path = new_folder(spark)
    rendered = topics.render_pages(topics.evidence_lines(docs(spark, sf), topics.topic_table(spark, TOPICS)), "2025-01-01")
    topics.write_topic_files(rendered, path)
    pages, listed = topics.read_topic_files(spark, path)
    known = docs(spark, sf).select("doc_id")
    issues = topics.lint_pages(pages, listed, known).unionByName(topics.lint_pages(pages.where("slug <> 'nothing'"), listed, known))
    found = issues.groupBy("slug").agg(F.sort_array(F.collect_set("issue")).alias("issues"))
    return listed.join(pages, "slug").join(found, "slug").select("slug", "title", "text", "issues")


_SECTIONS = ["Th", "Er", "Le"]


@query("topic_lint", """
WITH pg AS MATERIALIZED (SELECT CASE WHEN lang = 'fr' THEN 'x' ELSE 'p' END || doc_id AS slug, '## ' || text || ' [local:' || (doc_id % 50) || '] [local:x' || doc_id || '] [other:1]'
    || CASE WHEN doc_id % 2 = 0 THEN ' updated' ELSE '' END AS text FROM documents),
ix AS (SELECT 'p' || doc_id AS slug FROM documents),
ck AS (SELECT pg.* FROM pg SEMI JOIN ix USING (slug)),
miss AS (SELECT slug, array_to_string(list_filter(['Th', 'Er', 'Le'], lambda s: NOT contains(text, '## ' || s)), ' ') AS detail FROM ck)
SELECT slug, 'no_page' AS issue, '' AS detail FROM ix ANTI JOIN pg USING (slug)
UNION ALL SELECT slug, 'not_in_index', '' FROM pg ANTI JOIN ix USING (slug)
UNION ALL SELECT slug, 'missing_sections', detail FROM miss WHERE detail <> ''
UNION ALL SELECT slug, 'no_update_mark', '' FROM ck WHERE NOT contains(text, 'updated')
UNION ALL SELECT slug, 'no_disclaimer', '' FROM ck WHERE NOT contains(text, 'th')
UNION ALL SELECT slug, 'unknown_citation', 'local:x' || substr(slug, 2) FROM ck""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    slug = F.concat(F.when(F.col("lang") == "fr", "x").otherwise("p"), i).alias("slug")
    text = F.concat(F.lit("## "), F.col("text"), F.lit(" [local:"), i % 50, F.lit("] [local:x"), i, F.lit("] [other:1]"),
                    F.when(i % 2 == 0, " updated").otherwise("")).alias("text")
    known = d.select(F.concat(F.lit("local:"), i).alias("doc_id"))
    listed = d.select(F.concat(F.lit("p"), i).alias("slug"))
    return topics.lint_pages(d.select(slug, text), listed, known, _SECTIONS, "updated", "th")


# --- identifiers ----------------------------------------------------------


@query("identifier_verify", """
WITH cat AS (SELECT doc_id, 'pmid:' || doc_id AS id, text || CASE WHEN doc_id % 9 = 0 THEN ' Retracted' ELSE '' END AS title, '10.5555/' || doc_id AS doi FROM documents),
ids AS (SELECT unnest(['PMID:' || doc_id, ' ' || (doc_id * 2), 'https' || doc_id, '10.5555/' || doc_id]) AS identifier, unnest(['p', 'p', 'p', 'd']) AS kind,
  unnest([doc_id::VARCHAR, (doc_id * 2)::VARCHAR, 'https' || doc_id, doc_id::VARCHAR]) AS k FROM documents)
SELECT identifier, cat.id IS NOT NULL AS exists, cat.id AS doc_id, title, coalesce(doc_id % 9 = 0, false) AS withdrawn,
  CASE WHEN cat.id IS NULL THEN 'not_found' WHEN doc_id % 9 = 0 THEN 'withdrawn' ELSE 'ok' END AS note
FROM ids LEFT JOIN cat ON cat.doc_id::VARCHAR = k""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    catalog = d.select(
        F.concat(F.lit("pmid:"), i).alias("doc_id"),
        F.concat("text", F.when(i % 9 == 0, " Retracted").otherwise("")).alias("title"),
        F.lit(None).cast("int").alias("year"), F.lit("").alias("journal"), F.lit("").alias("url"),
        F.concat(F.lit("DOI:10.5555/"), i).alias("doi"), F.create_map(F.lit("pub_types"), F.lit("[]")).alias("extra"))
    ids = d.select(F.explode(F.array(
        F.concat(F.lit("PMID:"), i), F.concat(F.lit(" "), i * 2), F.concat(F.lit("https"), i),
        F.concat(F.lit("10.5555/"), i))).alias("identifier"))
    return verify.verify_identifiers(ids, catalog).select("identifier", "exists", "doc_id", "title", "withdrawn", "note")


@query("trial_verify", f"""
WITH {_TRIAL}, ids AS (SELECT unnest(['nct' || lpad(doc_id::VARCHAR, 8, '0'), 'NCT9' || doc_id, 'x' || doc_id]) AS nct_id FROM documents)
SELECT nct_id, tr.title, CASE WHEN nct IS NOT NULL THEN 'RECRUITING' END AS status, tr.doc_id AS enrollment,
  CASE WHEN nct IS NOT NULL THEN 'drug a|diet b' END AS interventions,
  CASE WHEN NOT regexp_matches(upper(nct_id), '^NCT[0-9]+$') THEN 'bad_format' WHEN nct IS NULL THEN 'not_found' ELSE 'ok' END AS note
FROM ids LEFT JOIN tr ON nct = upper(nct_id)""")
def _(spark, sf):
    i = F.col("doc_id")
    ids = table(spark, sf, "documents").select(F.explode(F.array(
        F.concat(F.lit("nct"), F.lpad(i.cast("string"), 8, "0")), F.concat(F.lit("NCT9"), i), F.concat(F.lit("x"), i))).alias("nct_id"))
    return verify.trial_records(ids, payloads.trial_catalog(_studies(spark, sf))).select(
        "nct_id", "title", "status", "enrollment", "interventions", "note")
