"""The given tables seen as documents, questions, answers and contexts.

Each mapping exists twice, as a DataFrame and as the same thing in SQL for the
comparison run. The tables hold invented prose, so the rule operators run here
with words that do occur in it.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.text import head, level_from_rules, tags_from_rules
from corpusloom.operators.chunk import docs_to_chunks

LEVELS = [("meta", ["rewh"]), ("guideline", ["orre"]), ("rct", ["thatin"]), ("observational", ["ononst"]),
          ("ebook", ["keit"])]
TAGS = [("that", ["that ", "than "]), ("with", ["with "]), ("elle", ["elle"]), ("keit", ["keit", "heit"]),
        ("cion", ["ción"]), ("ing", ["thing"])]
LANG_SOURCE = {"en": "pubmed", "fr": "europepmc", "de": "clinicaltrials", "es": "wiki"}
REF_YEAR = 2025
# The default of 120 never applies to this prose, whose last pieces are longer.
MERGE_BELOW = 700


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` with derived metadata; ``ord`` is the table's id."""
    return as_docs(table(spark, sf, "documents"))


def as_docs(d: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    source = F.lit("local")
    for lang, name in LANG_SOURCE.items():
        source = F.when(F.col("lang") == lang, name).otherwise(source)
    title = head(F.split("text", "\n")[0], 80)
    prefix = F.when(F.col("doc_id") % 2 == 0, "https://doi.org/10.5555/").otherwise("DOI:10.5555/")
    low = F.lower("text")
    return d.select(
        F.concat(F.lit("local:"), F.col("doc_id").cast("string")).alias("doc_id"),
        source.alias("source"), title.alias("title"), "text",
        F.when(n % 11 != 0, (n % 30 + 1995).cast("int")).alias("year"),
        F.when(n % 7 == 0, "").otherwise(F.concat(F.lit("https://docs.example/"), F.col("doc_id"))).alias("url"),
        F.concat(F.array("lang"), tags_from_rules(low, TAGS)).alias("tags"),
        level_from_rules(low, LEVELS).alias("evidence_level"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("journal"),
        F.when(n % 3 == 0, F.concat(prefix, head(F.md5("text"), 12))).otherwise("").alias("doi"),
        F.create_map(F.lit("isOpenAccess"), F.when(n % 2 == 0, "Y").otherwise("N"),
                     F.lit("inPMC"), F.when(n % 5 == 0, "Y").otherwise("")).alias("extra"),
        F.col("doc_id").alias("ord"), "lang", "n_chars")


def sql_case(text: str, rules, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{name}'"
                     for name, ws in rules)
    return f"CASE {whens} ELSE {default} END"


def sql_tags(text: str, rules) -> str:
    items = ", ".join("CASE WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in ws) + f" THEN '{name}' END"
                      for name, ws in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


DOCS = f"""docs AS MATERIALIZED (
  SELECT 'local:' || doc_id AS doc_id,
    CASE lang WHEN 'en' THEN 'pubmed' WHEN 'fr' THEN 'europepmc' WHEN 'de' THEN 'clinicaltrials'
              WHEN 'es' THEN 'wiki' ELSE 'local' END AS source,
    substr(string_split(text, chr(10))[1], 1, 80) AS title, text,
    CASE WHEN n_chars % 11 <> 0 THEN n_chars % 30 + 1995 END AS year,
    CASE WHEN n_chars % 7 = 0 THEN '' ELSE 'https://docs.example/' || doc_id END AS url,
    list_concat([lang], {sql_tags("lower(text)", TAGS)}) AS tags,
    {sql_case("lower(text)", LEVELS, "'other'")} AS evidence_level,
    CASE WHEN lang = 'en' THEN '' ELSE source END AS journal,
    CASE WHEN n_chars % 3 = 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.5555/'
         ELSE 'DOI:10.5555/' END) || substr(md5(text), 1, 12) ELSE '' END AS doi,
    CASE WHEN n_chars % 2 = 0 THEN 'Y' ELSE 'N' END AS is_oa,
    CASE WHEN n_chars % 5 = 0 THEN 'Y' ELSE '' END AS in_pmc,
    doc_id AS ord, lang, n_chars
  FROM documents)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select(
        F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"),
        F.col("text").alias("query"),
        F.when(F.col("item_id") % 2 == 0, "clinical").otherwise("nutrition").alias("track"))


QUESTIONS = """questions AS MATERIALIZED (
  SELECT item_id::VARCHAR AS question_id, text AS question, text AS query,
    CASE WHEN item_id % 2 = 0 THEN 'clinical' ELSE 'nutrition' END AS track
  FROM benchmark)"""


def chunks(spark: SparkSession, sf: str, merge_below: int | None = None) -> DataFrame:
    return docs_to_chunks(docs(spark, sf), merge_below=merge_below)


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _cut(start: str) -> str:
    """End of the piece that starts at ``start`` (0-based): last separator of the
    first kind found past a third of the window, else the full window."""
    window = f"substr(t, {start} + 1, 1200)"

    def found(sep: str, width: int) -> str:
        back = f"strpos(reverse({window}), reverse({sep}))"
        return (f"CASE WHEN {back} > 0 AND length({window}) - {back} + 1 - {width} > 400 "
                f"THEN length({window}) - {back} + 1 END")

    seps = [("'。'", 1), ("'. '", 2), ("'；'", 1), ("'; '", 2), ("chr(10)", 1)]
    ends = ", ".join(found(s, w) for s, w in seps)
    return f"CASE WHEN {start} + 1200 >= n THEN n ELSE {start} + coalesce({ends}, 1200) END"


def _past_table(start: str) -> str:
    """A cut ``e`` that falls on a table row moves to the end of the table."""
    line = f"substr(t, {start} + 1, e - {start})"
    last = f"regexp_extract({line}, '[^\\n]*$')"
    rest = "regexp_extract(substr(t, e + 1), '^[^\\n]*(?:\\n[ \\t]*\\|[^\\n]*)*\\n?')"
    return f"CASE WHEN regexp_matches({last}, '^\\s*\\|') THEN e + length({rest}) ELSE e END"


CUTS = f"""body AS MATERIALIZED (
  SELECT doc_id, trim(regexp_replace(text, '[ \\t]+', ' ', 'g'), {_SPACE}) AS t FROM docs),
cuts AS (
  SELECT doc_id, t, n, 0 AS a, {_past_table("0")} AS b FROM (SELECT *, {_cut("0")} AS e FROM (SELECT *, length(t) AS n FROM body))
  UNION ALL
  SELECT doc_id, t, n, s AS a, {_past_table("s")} AS b FROM (SELECT *, {_cut("s")} AS e
  FROM (SELECT doc_id, t, n, greatest(a + 1, b - 150) AS s FROM cuts WHERE b < n))),
pieces AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i, piece
  FROM (SELECT doc_id, a, trim(substr(t, a + 1, b - a), {_SPACE}) AS piece FROM cuts) WHERE piece <> '')"""

_CHUNK_COLS = """d.source, d.title, d.year, d.url, d.tags, d.evidence_level"""
CHUNKS = f"""{DOCS}, {CUTS},
chunks AS MATERIALIZED (
  SELECT d.doc_id || '#c' || coalesce(p.i, 0) AS chunk_id, d.doc_id, {_CHUNK_COLS},
    coalesce(p.piece, d.title) AS text, coalesce(p.i, 0) AS chunk_index
  FROM docs d LEFT JOIN pieces p ON p.doc_id = d.doc_id)"""
_SHORT = f"length(f.cur) < {MERGE_BELOW} OR length(c.text) < {MERGE_BELOW}"
MERGED_CHUNKS = f"""{CHUNKS},
folded AS (
  SELECT doc_id, 0 AS i, 0 AS g, text AS cur FROM chunks WHERE chunk_index = 0
  UNION ALL
  SELECT f.doc_id, c.chunk_index, CASE WHEN {_SHORT} THEN f.g ELSE f.g + 1 END,
    CASE WHEN {_SHORT} THEN trim(f.cur || ' ' || c.text) ELSE c.text END
  FROM folded f JOIN chunks c ON c.doc_id = f.doc_id AND c.chunk_index = f.i + 1),
merged AS MATERIALIZED (
  SELECT d.doc_id || '#c' || m.g AS chunk_id, d.doc_id, {_CHUNK_COLS}, m.text, m.g AS chunk_index
  FROM docs d JOIN (SELECT doc_id, g, arg_max(cur, i) AS text FROM folded GROUP BY ALL) m ON m.doc_id = d.doc_id)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as answers. The prose cites nothing, so claims are appended:
    some point at the question's contexts and some do not."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    k = (F.col("conv_id") % 7).cast("string")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        "conv_id", "turn",
        F.concat(
            "text", F.lit(" ["), k, F.lit("][1] PMID: "), (F.col("conv_id") * 3 + 100001).cast("string"),
            F.lit(" pmid:"), (F.col("conv_id") % 4 + 100000).cast("string"),
            F.lit(" nct"), F.lpad((F.col("conv_id") + F.col("turn")).cast("string"), 8, "0"),
            F.lit(" (local:"), F.col("conv_id").cast("string"), F.lit(").")).alias("answer"))


ANSWERS = """answers AS MATERIALIZED (
  SELECT conv_id || '-' || turn AS question_id, conv_id, turn,
    text || ' [' || (conv_id % 7) || '][1] PMID: ' || (conv_id * 3 + 100001) || ' pmid:' || (conv_id % 4 + 100000)
      || ' nct' || lpad((conv_id + turn)::VARCHAR, 8, '0') || ' (local:' || conv_id || ').' AS answer
  FROM conversations WHERE role = 'assistant')"""


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Four contexts per answer: an article, a trial, a local document and the user's own words."""
    c = table(spark, sf, "conversations")
    user = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    a = c.where("role = 'assistant'").join(user, ["conv_id", "turn"], "left")
    conv = F.col("conv_id")
    ids = F.array(
        F.concat(F.lit("pmid:"), (conv * 3 + 100000 + conv % 2).cast("string")),
        F.concat(F.lit("nct:NCT"), F.lpad((conv + 1).cast("string"), 8, "0")),
        F.concat(F.lit("local:"), (conv - conv % 3).cast("string")),
        F.concat(F.lit("pmid:"), (conv % 2 + 100000).cast("string")))
    rows = a.select(
        F.concat_ws("-", conv.cast("string"), F.col("turn").cast("string")).alias("question_id"), "conv_id",
        F.coalesce("asked", F.lit("")).alias("text"), F.posexplode(ids).alias("i", "doc_id"))
    return rows.select(
        "question_id", (F.col("i") + 1).alias("rank"), "doc_id",
        F.concat("doc_id", F.lit("#c0")).alias("chunk_id"),
        F.element_at(F.split("doc_id", ":"), 1).alias("source"), head(F.col("text"), 40).alias("title"), "text",
        F.when(conv % 5 != 0, (conv % 30 + 1995).cast("int")).alias("year"),
        F.when(conv % 3 == 0, "").otherwise(F.concat(F.lit("https://docs.example/"), "doc_id")).alias("url"),
        F.when((conv + F.col("i")) % 3 == 0, "rct").otherwise("other").alias("evidence_level"))


CONTEXTS = """contexts AS MATERIALIZED (
  SELECT question_id, i AS rank, doc_id, doc_id || '#c0' AS chunk_id, string_split(doc_id, ':')[1] AS source,
    substr(text, 1, 40) AS title, text, CASE WHEN conv_id % 5 <> 0 THEN conv_id % 30 + 1995 END AS year,
    CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'https://docs.example/' || doc_id END AS url,
    CASE WHEN (conv_id + i - 1) % 3 = 0 THEN 'rct' ELSE 'other' END AS evidence_level
  FROM (SELECT question_id, conv_id, text, i, ids[i] AS doc_id FROM (
    SELECT a.conv_id || '-' || a.turn AS question_id, a.conv_id, coalesce(u.text, '') AS text,
      ['pmid:' || (a.conv_id * 3 + 100000 + a.conv_id % 2), 'nct:NCT' || lpad((a.conv_id + 1)::VARCHAR, 8, '0'),
       'local:' || (a.conv_id - a.conv_id % 3), 'pmid:' || (a.conv_id % 2 + 100000)] AS ids
    FROM conversations a LEFT JOIN conversations u
      ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
    WHERE a.role = 'assistant'), (SELECT unnest([1, 2, 3, 4]) AS i)))"""
