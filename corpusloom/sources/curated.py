"""Curated JSON lines and the full-text collection manifest."""

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.functions.scoring import lookup
from corpusloom.functions.text import normalize_level, or_else, strip, text_or_empty, whole_number
from corpusloom.schemas import CURATED

EMPTY_EXTRA = "map<string,string>"


def curated_docs(lines: DataFrame, tag: str) -> DataFrame:
    """``lines(value, pos)`` -> documents. Rows without an id are dropped."""
    r = lines.where(F.trim("value") != "").select("pos", F.from_json("value", CURATED).alias("r")).select("pos", "r.*")
    doc_id = strip(text_or_empty(F.col("id")))
    tail = F.element_at(F.split(doc_id, ":"), -1)
    extra = F.map_filter(
        F.create_map(*[x for k in rules.CURATED_EXTRA_KEYS for x in (F.lit(k), F.col(k))]),
        lambda k, v: v.isNotNull())
    some = [F.when(text_or_empty(F.col(c)) != "", F.col(c)) for c in ("evidence_role", "source_type")]
    return r.where(doc_id != "").select(
        doc_id.alias("doc_id"), F.lit("pubmed").alias("source"), or_else(F.col("title"), doc_id).alias("title"),
        text_or_empty(F.col("text")).alias("text"), "year",
        or_else(F.col("url"), pubmed_url(tail)).alias("url"),
        F.array_compact(F.array(F.lit(tag), *some)).alias("tags"),
        lookup(text_or_empty(F.col("source_type")), rules.SOURCE_TYPE_LEVELS, "other").alias("evidence_level"),
        text_or_empty(F.col("journal")).alias("journal"), text_or_empty(F.col("doi")).alias("doi"),
        extra.alias("extra"), "pos")


def pubmed_url(pmid: Column) -> Column:
    return F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))


def collection_docs(manifest: DataFrame, texts: DataFrame, tag: str = "collection500") -> DataFrame:
    """Manifest rows joined to their extracted full text.

    ``manifest(pmid, dest_pdf, title, pub_year, if_value, q_value,
    nlm_unique_id, pos)`` are strings as read from CSV; ``texts(dest_pdf, text)``
    is the output of a text extraction run. Rows without either are dropped.
    """
    def field(name: str) -> Column:
        return strip(text_or_empty(F.col(name)))

    rows = manifest.withColumns({"pmid": field("pmid"), "dest_pdf": field("dest_pdf"), "title": field("title"),
                                 "pub_year": field("pub_year")}).where("pmid <> '' and dest_pdf <> ''")
    stem = F.regexp_replace(F.element_at(F.split("dest_pdf", "/"), -1), r"\.[^.]*$", "")
    return rows.join(texts, "dest_pdf").select(
        F.concat(F.lit("pmid:"), F.col("pmid")).alias("doc_id"), F.lit("pubmed").alias("source"),
        or_else(F.col("title"), stem).alias("title"),
        "text", whole_number(F.col("pub_year")).alias("year"),
        pubmed_url(F.col("pmid")).alias("url"), F.array(F.lit(tag), F.lit("fulltext")).alias("tags"),
        normalize_level(F.lit(""), F.col("title"), rules.TITLE_LEVEL_RULES).alias("evidence_level"),
        F.lit("").alias("journal"), F.lit("").alias("doi"),
        F.create_map(*[x for c in ("if_value", "q_value", "nlm_unique_id")
                       for x in (F.lit(c), text_or_empty(F.col(c)))]).alias("extra"), "pos")
