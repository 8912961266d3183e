"""Landed payload files of the article, registry and open-access services."""

from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom.functions import rules
from corpusloom.functions.text import head, normalize_level, or_else, strip, tags_from_rules, text_or_empty, whole_number
from corpusloom.schemas import EUROPEPMC, STUDIES
from corpusloom.sources.curated import pubmed_url
from corpusloom.sources.files import as_position, inner_position, rejected_lines, scan_position

_ARTICLE = "PubmedArticle"


def read_pubmed_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row per article record. The record end is the line separator, so a
    large file splits over tasks; everything before the record start is cut."""
    raw = spark.read.option("lineSep", f"</{_ARTICLE}>").text(path)
    start = F.regexp_instr("value", F.lit(f"<{_ARTICLE}[\\s>]"))
    record = F.concat(F.substring("value", start, F.length("value")), F.lit(f"</{_ARTICLE}>"))
    return raw.where(start > 0).select(record.alias("xml"), scan_position().alias("pos"))


_RECORD = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("pmid", "title", "y", "md", "journal", "doi")],
    T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("pub_types", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType())])


def _flat(element: ElementTree.Element | None) -> str:
    """Text of an element with its inline markup flattened in reading order."""
    return "" if element is None else "".join(element.itertext()).strip()


def article_fields(xml: str) -> dict:
    """The fields of one record in one parse; what is no XML has only ``error``."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as failed:
        return {"error": str(failed)}
    own_doi = [e for e in root.findall("PubmedData/ArticleIdList/ArticleId") if e.get("IdType") == "doi"]
    return {
        "pmid": _flat(root.find(".//PMID")), "title": _flat(root.find(".//ArticleTitle")), "y": _flat(root.find(".//PubDate/Year")),
        "md": _flat(root.find(".//PubDate/MedlineDate"))[:4], "journal": _flat(root.find(".//Journal/Title")),
        "doi": _flat(own_doi[-1] if own_doi else None), "parts": [_flat(e) for e in root.iterfind(".//Abstract/AbstractText")],
        "pub_types": [_flat(e) for e in root.iter("PublicationType")], "error": None}


def article_records(records: DataFrame) -> DataFrame:
    """``records(xml, pos)`` with the parsed fields as ``r``; rows are parsed once, in Arrow batches."""
    @F.arrow_udf(_RECORD)
    def parse(xml: pa.Array) -> pa.Array:
        return pa.array([article_fields(x or "") for x in xml.to_pylist()], _ARROW_RECORD)
    return records.withColumn("r", parse("xml"))


_ARROW_RECORD = pa.struct([
    *[(n, pa.string()) for n in ("pmid", "title", "y", "md", "journal", "doi")],
    ("parts", pa.list_(pa.string())), ("pub_types", pa.list_(pa.string())), ("error", pa.string())])


def rejected_articles(records: DataFrame) -> DataFrame:
    """``pos, xml, reason`` of the records that are no XML."""
    return article_records(records).where("r.error is not null").select("pos", "xml", F.col("r.error").alias("reason"))


def pubmed_docs(records: DataFrame) -> DataFrame:
    """``records(xml, pos)`` -> documents. Records that are no XML are left to ``rejected_articles``."""
    raw = article_records(records).where("r.error is null").select("pos", "r.*")
    year = or_else(F.col("y"), F.col("md"))
    abstract = F.array_join(F.filter("parts", lambda p: p != ""), "\n")
    title = F.col("title")
    blob = F.lower(F.concat_ws(" ", title, or_else(abstract, title)))
    return raw.select(
        F.concat(F.lit("pmid:"), "pmid").alias("doc_id"), F.lit("pubmed").alias("source"),
        or_else(title, F.concat(F.lit("PMID "), "pmid")).alias("title"), or_else(abstract, title).alias("text"),
        whole_number(year).alias("year"), pubmed_url(F.col("pmid")).alias("url"),
        tags_from_rules(blob, rules.PUBMED_TAGS).alias("tags"),
        normalize_level(F.array_join("pub_types", " "), title, rules.TITLE_LEVEL_RULES).alias("evidence_level"),
        "journal", "doi", F.create_map(F.lit("pub_types"), F.to_json("pub_types")).alias("extra"), "pos")


def read_json_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per response file, with its position."""
    return spark.read.text(path, wholetext=True).select("value", scan_position().alias("pos"))


def rejected_payloads(payloads: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of ``payloads(value, ..)`` that are no JSON of a service's ``schema`` (``STUDIES``, ``EUROPEPMC``)."""
    return rejected_lines(payloads, schema)


def studies(payloads: DataFrame) -> DataFrame:
    """``payloads(value, pos)`` of the trial registry -> one ``protocolSection`` per row."""
    rows = payloads.select(as_position(payloads).alias("pos"), F.from_json("value", STUDIES).alias("p")).select(
        "pos", F.posexplode_outer("p.studies").alias("i", "s")).where("s is not null")
    return rows.select(inner_position(F.col("pos"), F.col("i")).alias("pos"), F.col("s.protocolSection").alias("p"))


def primary_outcome(outcomes: Column) -> Column:
    """``measure（time frame）`` list of the primary outcomes, else of the secondary ones."""
    def listed(items: Column) -> Column:
        def entry(o: Column) -> Column:
            frame = strip(text_or_empty(o["timeFrame"]))
            return F.concat(strip(text_or_empty(o["measure"])), F.when(
                frame != "", F.concat(F.lit("（"), frame, F.lit("）"))).otherwise(""))

        named = F.filter(items, lambda o: strip(text_or_empty(o["measure"])) != "")
        return F.array_join(F.transform(named, entry), "；")

    return or_else(listed(outcomes["primaryOutcomes"]), listed(outcomes["secondaryOutcomes"]), F.lit(""))


def _names(p: Column) -> Column:
    return F.filter(F.transform(
        F.coalesce(p["armsInterventionsModule"]["interventions"], F.array()), lambda a: text_or_empty(a["name"])),
        lambda n: n != "")


def trial_docs(protocols: DataFrame) -> DataFrame:
    """``protocols(p, pos)`` -> trial documents."""
    p = F.col("p")
    ident, status = p["identificationModule"], p["statusModule"]
    nct = text_or_empty(ident["nctId"])
    title = or_else(ident["officialTitle"], ident["briefTitle"], nct)
    brief = or_else(p["descriptionModule"]["briefSummary"], p["descriptionModule"]["detailedDescription"], title)
    conditions = F.coalesce(p["conditionsModule"]["conditions"], F.array().cast("array<string>"))
    outcome = primary_outcome(p["outcomesModule"])
    state = text_or_empty(status["overallStatus"])
    text = F.concat(
        brief, F.lit("\n\nStatus: "), state, F.lit("\nConditions: "), F.array_join(conditions, ", "),
        F.lit("\nInterventions: "), F.array_join(_names(p), ", "),
        F.when(outcome != "", F.concat(F.lit("\nPrimary Outcome: "), outcome)).otherwise(""))
    year = head(status["startDateStruct"]["date"], 4)
    return protocols.select(
        F.concat(F.lit("nct:"), nct).alias("doc_id"), F.lit("clinicaltrials").alias("source"), title.alias("title"),
        text.alias("text"), whole_number(F.when(F.length(year) == 4, year)).alias("year"),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"),
        tags_from_rules(F.lower(F.concat_ws(" ", title, text)), rules.TRIAL_TAGS).alias("tags"),
        F.lit("rct").alias("evidence_level"), F.lit("").alias("journal"), F.lit("").alias("doi"),
        F.create_map(F.lit("status"), state, F.lit("conditions"), F.to_json(conditions),
                     F.lit("primary_outcome"), outcome).alias("extra"), "pos")


def trial_catalog(protocols: DataFrame) -> DataFrame:
    """Record columns for the batch trial check."""
    p = F.col("p")
    ident, design = p["identificationModule"], p["designModule"]
    nct = text_or_empty(ident["nctId"])
    return protocols.select(
        nct.alias("nct_id"), or_else(ident["officialTitle"], ident["briefTitle"], nct).alias("title"),
        text_or_empty(p["statusModule"]["overallStatus"]).alias("status"),
        F.coalesce(design["phases"], F.array().cast("array<string>")).alias("phases"),
        design["enrollmentInfo"]["count"].alias("enrollment"),
        F.coalesce(p["conditionsModule"]["conditions"], F.array().cast("array<string>")).alias("conditions"),
        _names(p).alias("interventions"),
        F.concat(F.lit("https://clinicaltrials.gov/study/"), nct).alias("url"))


def europepmc_docs(payloads: DataFrame) -> DataFrame:
    """``payloads(value, pos)`` of the open-access service -> documents."""
    rows = payloads.select(as_position(payloads).alias("pos"), F.from_json("value", EUROPEPMC).alias("p")).select(
        "pos", F.posexplode_outer("p.resultList.result").alias("i", "r")).where("r is not null")
    rows = rows.select(inner_position(F.col("pos"), F.col("i")).alias("at"), "r.*")
    source = F.coalesce(F.col("source"), F.lit("MED"))
    ext = or_else(F.col("id"), F.col("pmid"), F.col("doi"), F.lit(""))
    title = text_or_empty(F.col("title"))
    abstract = or_else(F.col("abstractText"), title)
    page = F.concat(F.lit("https://europepmc.org/article/"), source, F.lit("/"), ext)
    flags = ("isOpenAccess", "inPMC", "pubType")
    return rows.select(
        F.concat(F.lit("epmc:"), source, F.lit(":"), ext).alias("doc_id"), F.lit("europepmc").alias("source"),
        title.alias("title"), abstract.alias("text"), whole_number(F.col("pubYear")).alias("year"),
        F.when(text_or_empty(F.col("pmid")) != "", pubmed_url(F.col("pmid"))).otherwise(page).alias("url"),
        tags_from_rules(F.lower(F.concat_ws(" ", title, abstract)), rules.EUROPEPMC_TAGS).alias("tags"),
        normalize_level(F.col("pubType"), title, rules.TITLE_LEVEL_RULES).alias("evidence_level"),
        text_or_empty(F.col("journalTitle")).alias("journal"), text_or_empty(F.col("doi")).alias("doi"),
        F.create_map(*[x for f in flags for x in (F.lit(f), text_or_empty(F.col(f)))]).alias("extra"),
        F.col("at").alias("pos"))
