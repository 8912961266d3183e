"""Curation and report queries."""

from pyspark.sql import functions as F

from corpusloom.functions import scoring
from corpusloom.functions.text import normalize_doi, normalize_level, normalize_title, tags_from_rules
from corpusloom.operators import curate, report
from corpusloom.operators.common import new_folder, stored
from corpusloom.plans.corpus import DOCS, LEVELS, TAGS, docs, sql_case, sql_tags, table
from corpusloom.plans.registry import query
from corpusloom.schemas import DOC_FIELDS
from corpusloom.sources import files

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DOI = f"""trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(doi)), '^https://doi\\.org/', ''),
   '^http://doi\\.org/', ''), '^doi:', ''))"""
_TITLE = f"""regexp_replace(regexp_replace(trim(lower(title), {_WS}), '^(the|a|an)\\s+', ''),
   '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"""
KEYED = f"""keyed AS MATERIALIZED (
  SELECT *, CASE WHEN k IN ('doi:', 'title:') THEN 'id:' || doc_id ELSE k END AS key
  FROM (SELECT *, CASE WHEN doi <> '' THEN 'doi:' || {_DOI} ELSE 'title:' || {_TITLE} END AS k FROM docs))"""


def _complete(text="text", year="year", url="url", journal="journal", doi="doi", tags="tags") -> str:
    return (f"(length(trim({text}, {_WS})) + CASE WHEN coalesce({year}, 0) <> 0 THEN 1000 ELSE 0 END"
            f" + CASE WHEN {url} <> '' THEN 500 ELSE 0 END + CASE WHEN {journal} <> '' THEN 500 ELSE 0 END"
            f" + CASE WHEN {doi} <> '' THEN 300 ELSE 0 END + len({tags}) * 100)")


@query("merge_first_wins", """
WITH everything AS (
  SELECT md5(text) AS doc_id, doc_id AS ord, text FROM documents
  UNION ALL SELECT md5(text), 288230376151711744 + item_id, text FROM benchmark
  UNION ALL SELECT md5(html), 576460752303423488 + page_id, html FROM pages)
SELECT doc_id, ord, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM everything
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1""")
def _(spark, sf):
    def source(name, key, text):
        return table(spark, sf, name).select(F.md5(text).alias("doc_id"), F.col(key).alias("pos"), F.col(text).alias("text"))

    merged = curate.merge_first_wins(curate.union_sources(
        source("documents", "doc_id", "text"), source("benchmark", "item_id", "text"), source("pages", "page_id", "html")))
    number = F.col("ord.source") * F.lit(1 << 58) + F.col("ord.row")
    return merged.select("doc_id", number.alias("ord"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query("dedupe_keys", f"""
WITH {DOCS}, {KEYED}
SELECT doc_id, key, {_complete()}::BIGINT AS completeness FROM keyed""")
def _(spark, sf):
    d = curate.with_completeness(docs(spark, sf))
    return d.select("doc_id", curate.dedupe_key(F.col("doc_id"), F.col("doi"), F.col("title")).alias("key"),
                    "completeness")


def fold_sql(source: str = "") -> str:
    """The sequential fold, one document at a time; ``source`` redefines ``docs`` over ``docs0``."""
    c, n = _complete(), _complete(*[f"n.{x}" for x in ("text", "year", "url", "journal", "doi", "tags")])
    f = _complete(*[f"f.{x}" for x in ("text", "year", "url", "journal", "doi", "tags")])
    win = f"{n} > {f}"

    def keep(x: str, empty: str) -> str:
        return (f"CASE WHEN {win} THEN (CASE WHEN {empty.format('n.' + x)} THEN f.{x} ELSE n.{x} END)"
                f" ELSE (CASE WHEN {empty.format('f.' + x)} THEN n.{x} ELSE f.{x} END) END")

    blank = f"trim({{}}, {_WS}) = ''"
    winner = [f"CASE WHEN {win} THEN n.{x} ELSE f.{x} END" for x in ("doc_id", "source", "title", "evidence_level")]
    tags = (f"CASE WHEN {win} THEN list_concat(n.tags, list_filter(f.tags, lambda x: NOT list_contains(n.tags, x)))"
            f" ELSE list_concat(f.tags, list_filter(n.tags, lambda x: NOT list_contains(f.tags, x))) END")
    given = f"{DOCS.replace('docs AS', 'docs0 AS', 1)}, {source}" if source else DOCS
    return f"""
WITH RECURSIVE {given}, {KEYED},
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS rn FROM keyed),
fold AS (
  SELECT key, rn, ord, doc_id, source, title, evidence_level, text, year, url, journal, doi, tags, is_oa, in_pmc
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT f.key, n.rn, f.ord, {winner[0]}, {winner[1]}, {winner[2]}, {winner[3]}, {keep('text', blank)},
    {keep('year', '{} IS NULL')}, {keep('url', "{} = ''")}, {keep('journal', "{} = ''")}, {keep('doi', "{} = ''")},
    {tags}, {keep('is_oa', "{} = ''")}, {keep('in_pmc', "{} = ''")}
  FROM fold f JOIN ranked n ON n.key = f.key AND n.rn = f.rn + 1)
SELECT ord, doc_id, source, title, evidence_level, length(text)::BIGINT AS n_chars, md5(text) AS text_md5, year::BIGINT AS year, url, journal,
  doi, array_to_string(tags, '|') AS tags, is_oa, in_pmc
FROM fold QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1"""


@query("dedupe_fold", fold_sql())
def _(spark, sf):
    return _folded(curate.dedupe_fold(stored(docs(spark, sf))))


def _folded(d):
    return d.select("ord", "doc_id", "source", "title", "evidence_level", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "year",
                    "url", "journal", "doi", "tags", F.element_at("extra", "isOpenAccess").alias("is_oa"),
                    F.coalesce(F.element_at("extra", "inPMC"), F.lit("")).alias("in_pmc"))


@query("fold_batches", fold_sql())
def _(spark, sf):
    """Documents land in three batches, one after the other; the corpus is that of one fold over all."""
    d = stored(docs(spark, sf))
    cut = d.agg(F.max("ord").alias("m")).first()[0] // 3 + 1
    corpus = stored(curate.dedupe_fold(d.where(F.col("ord") < cut)))
    for n in (1, 2):
        corpus = stored(curate.fold_into(corpus, d.where((F.col("ord") >= n * cut) & (F.col("ord") < (n + 1) * cut))))
    return _folded(corpus)


@query("doi_title_norms", f"""
WITH {DOCS} SELECT doc_id, {_DOI} AS doi_norm, {_TITLE} AS title_norm FROM docs""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", normalize_doi(F.col("doi")).alias("doi_norm"),
                                  normalize_title(F.col("title")).alias("title_norm"))


@query("level_rules", f"""
SELECT doc_id, {sql_case("lower(source || ' ' || text)", LEVELS, "'other'")} AS evidence_level FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", normalize_level(F.col("source"), F.col("text"), LEVELS).alias("evidence_level"))


_HEAD = "lower(title || ' ' || text)"


@query("level_enrich", f"""
WITH {DOCS}, weak AS (SELECT *, CASE WHEN lang = 'en' THEN 'other' ELSE evidence_level END AS lv FROM docs)
SELECT doc_id, CASE WHEN lv = 'other' THEN {sql_case(_HEAD, TAGS, 'lv')} ELSE lv END AS evidence_level FROM weak""")
def _(spark, sf):
    weak = docs(spark, sf).withColumn("evidence_level", F.when(F.col("lang") == "en", "other").otherwise(
        F.col("evidence_level")))
    return curate.grade_from_text(weak, TAGS).select("doc_id", "evidence_level")


@query("tag_rules", f"""
SELECT doc_id, array_to_string({sql_tags("lower(text)", TAGS)}, '|') AS tags FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tags_from_rules(F.lower("text"), TAGS).alias("tags"))


_MORE = [("ing", ["thing"]), ("du", ["du "]), ("that", ["that "])]


@query("enrich_local", f"""
WITH {DOCS}
SELECT doc_id, array_to_string(list_concat(tags, list_filter({sql_tags("lower(title || ' ' || text)", _MORE)},
    lambda x: NOT list_contains(tags, x))), '|') AS tags,
  CASE WHEN evidence_level = 'other' THEN {sql_case("lower(' ' || title)", [("rct", ["th"]), ("meta", ["de "])], "'other'")}
    ELSE evidence_level END AS evidence_level
FROM docs""")
def _(spark, sf):
    d = curate.enrich_local(docs(spark, sf), _MORE, [("rct", ["th"]), ("meta", ["de "])])
    return d.select("doc_id", "tags", "evidence_level")


@query("open_access_filter", f"""
WITH {DOCS} SELECT doc_id FROM docs
WHERE is_oa = 'Y' OR (in_pmc = 'Y' AND (doi <> '' OR url <> ''))""")
def _(spark, sf):
    return curate.open_access_only(docs(spark, sf)).select("doc_id")


@query("annotate_batch", """
SELECT 'local:' || doc_id AS doc_id, 'expanded' AS batch, 'documents' AS source, 'q1 | q2' AS queries,
  CASE WHEN n_chars % 2 = 0 THEN 'Y' ELSE 'N' END AS is_oa FROM documents""")
def _(spark, sf):
    d = curate.annotate_batch(docs(spark, sf), "expanded", "documents", ["q1", "q2"])
    return d.select("doc_id", *[F.element_at("extra", k).alias(n) for k, n in (
        ("collection_batch", "batch"), ("collection_source", "source"), ("collection_query", "queries"),
        ("isOpenAccess", "is_oa"))])


@query("ordered_unique", """
SELECT id, min(pos) AS pos FROM (
  SELECT source AS id, doc_id AS pos FROM documents UNION ALL SELECT md5(text), doc_id FROM documents) GROUP BY id""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    ids = d.select(F.explode(F.array(F.col("source"), F.md5("text"))).alias("id"), F.col("doc_id").alias("pos"))
    return curate.ordered_unique(ids)


@query("recency_priority", f"""
WITH {DOCS}, w AS (
  SELECT doc_id, CASE evidence_level WHEN 'meta' THEN 1.0 WHEN 'guideline' THEN 0.95 WHEN 'rct' THEN 0.9
      WHEN 'wiki' THEN 0.8 WHEN 'observational' THEN 0.6 WHEN 'ebook' THEN 0.4 ELSE 0.3 END::DOUBLE AS level_weight,
    CASE WHEN year IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, 2025 - year) / 8.0) END AS recency FROM docs)
SELECT doc_id, level_weight, round(recency, 6) AS recency, round(level_weight + recency * 0.5, 6) AS priority FROM w""")
def _(spark, sf):
    level, year = F.col("evidence_level"), F.col("year")
    return docs(spark, sf).select(
        "doc_id", scoring.level_priority(level).alias("level_weight"),
        F.round(scoring.recency_weight(year, 2025), 6).alias("recency"),
        F.round(scoring.combined_priority(level, year, 2025), 6).alias("priority"))


def _dist_sql(key: str) -> str:
    return f"""WITH {DOCS} SELECT {key} AS key, count(*) AS n,
  round(100.0 * count(*) / (SELECT count(*) FROM docs), 1)::DOUBLE AS pct FROM docs GROUP BY ALL"""


@query("source_distribution", _dist_sql("source"))
def _(spark, sf):
    return report.distribution(docs(spark, sf), F.col("source"))


@query("year_distribution", _dist_sql("year::BIGINT"))
def _(spark, sf):
    return report.distribution(docs(spark, sf), F.col("year")).orderBy(F.col("key").asc_nulls_last())


@query("level_distribution", _dist_sql("evidence_level"))
def _(spark, sf):
    return report.distribution(docs(spark, sf), F.col("evidence_level"))


@query("tag_frequency", f"""
WITH {DOCS} SELECT tag, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM docs), 1)::DOUBLE AS pct
FROM (SELECT unnest(tags) AS tag FROM docs) GROUP BY tag ORDER BY n DESC, tag LIMIT 10""")
def _(spark, sf):
    return report.tag_frequency(docs(spark, sf))


@query("quality_counts", f"""
WITH {DOCS} SELECT count(*) AS total, count(DISTINCT source) AS n_sources, min(year)::BIGINT AS min_year,
  max(year)::BIGINT AS max_year, count(*) FILTER (trim(text) = '') AS missing_text,
  count(*) FILTER (year IS NULL) AS missing_year, count(*) FILTER (doi <> '') AS with_doi FROM docs""")
def _(spark, sf):
    return report.quality_counts(docs(spark, sf))


@query("missing_text_sample", f"""
WITH {DOCS} SELECT doc_id, ord FROM docs WHERE n_chars % 13 = 0 OR trim(text, {_WS}) = '' ORDER BY ord LIMIT 20""")
def _(spark, sf):
    d = docs(spark, sf).withColumn("text", F.when(F.col("n_chars") % 13 == 0, " \n").otherwise(F.col("text")))
    return report.missing_text_sample(d)


@query("corpus_report", f"""
WITH {DOCS}, pairs AS (
  SELECT 'source' AS section, source AS key FROM docs UNION ALL SELECT 'year', coalesce(year::VARCHAR, 'unknown') FROM docs
  UNION ALL SELECT 'level', evidence_level FROM docs UNION ALL SELECT 'all', 'total' FROM docs
  UNION ALL SELECT 'missing', 'text' FROM docs WHERE trim(text, {_WS}) = ''
  UNION ALL SELECT 'missing', 'year' FROM docs WHERE year IS NULL
  UNION ALL SELECT 'present', 'doi' FROM docs WHERE doi <> '' UNION ALL SELECT 'tag', unnest(tags) FROM docs)
SELECT section, key, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM docs), 1)::DOUBLE AS pct
FROM pairs GROUP BY ALL""")
def _(spark, sf):
    return report.corpus_report(docs(spark, sf))


@query("report_lines", f"""
WITH {DOCS}, c AS (SELECT source, count(*) AS n FROM docs GROUP BY ALL)
SELECT '# Corpus' AS value UNION ALL SELECT '' UNION ALL SELECT '- 2025-01-01' UNION ALL SELECT ''
UNION ALL SELECT '| section | key | n | pct |' UNION ALL SELECT '|---|---|---|---|'
UNION ALL SELECT '| source | ' || source || ' | ' || n || ' | '
  || printf('%.1f', round(100.0 * n / (SELECT count(*) FROM docs), 1)::DOUBLE) || '% |' FROM c""")
def _(spark, sf):
    d = report.distribution(docs(spark, sf), F.col("source")).withColumn("section", F.lit("source"))
    return report.report_markdown(d, "Corpus", "2025-01-01")


@query("outside_lists", f"""
WITH {DOCS}, d AS (SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN lang WHEN n_chars % 7 = 0 THEN NULL ELSE source END AS source,
  CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE evidence_level END AS evidence_level FROM docs)
SELECT doc_id, 'source' AS field, source AS value FROM d WHERE source IS NULL OR source NOT IN ('pubmed', 'clinicaltrials', 'europepmc', 'local', 'wiki')
UNION ALL SELECT doc_id, 'evidence_level', evidence_level FROM d
  WHERE evidence_level NOT IN ('rct', 'meta', 'guideline', 'observational', 'ebook', 'wiki', 'other')""")
def _(spark, sf):
    n = F.col("n_chars")
    d = docs(spark, sf).withColumns({
        "source": F.when(n % 5 == 0, F.col("lang")).when(n % 7 != 0, F.col("source")),
        "evidence_level": F.when(n % 3 == 0, "none").otherwise(F.col("evidence_level"))})
    return curate.outside_lists(d)


@query("report_missing_fields", f"""
WITH {DOCS}, d AS (SELECT * REPLACE (CASE WHEN n_chars % 2 = 0 THEN tags ELSE [] END AS tags,
    CASE WHEN n_chars % 3 = 0 THEN '' ELSE text END AS text, CASE WHEN n_chars % 5 = 0 THEN '' ELSE doi END AS doi) FROM docs),
pairs AS (
  SELECT 'source' AS section, source AS key FROM d UNION ALL SELECT 'year', coalesce(year::VARCHAR, 'unknown') FROM d
  UNION ALL SELECT 'level', evidence_level FROM d UNION ALL SELECT 'all', 'total' FROM d
  UNION ALL SELECT 'missing', 'text' FROM d WHERE trim(text, {_WS}) = '' UNION ALL SELECT 'missing', 'year' FROM d WHERE year IS NULL
  UNION ALL SELECT 'present', 'doi' FROM d WHERE doi <> '' UNION ALL SELECT 'tag', unnest(tags) FROM d)
SELECT section, key, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM docs), 1)::DOUBLE AS pct
FROM pairs GROUP BY ALL""")
def _(spark, sf):
    """JSON lines that lack fields count in every figure; they are written and read back."""
    n = F.col("n_chars")
    d = docs(spark, sf).withColumns({
        "tags": F.when(n % 2 == 0, F.col("tags")), "text": F.when(n % 3 != 0, F.col("text")), "doi": F.when(n % 5 != 0, F.col("doi"))})
    path = new_folder(spark)
    d.select(*DOC_FIELDS).write.json(path)
    return report.corpus_report(files.read_docs(spark, path))
