"""Batch identifier checks against landed catalogues instead of one web call per id."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import normalize_doi, strip, text_or_empty
from corpusloom.operators.common import first_per_key, fits, join_rare, salted_join, stored


def is_trial_id(nct: Column) -> Column:
    return F.upper(strip(nct)).rlike("^NCT[0-9]+$")


def verify_identifiers(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """``ids(identifier)`` -> exists, metadata, withdrawn flag and note.

    ``catalog`` is a document table. Article ids match ``pmid:N``; ids that look
    like a DOI match the normalised ``doi``. The catalogue is first reduced to
    the ids that were asked for.
    """
    ident = strip(F.regexp_replace(F.lower(strip(F.col("identifier"))), "pmid:", ""))
    is_doi = F.contains(ident, F.lit("/")) & F.startswith(ident, F.lit("10."))
    asked = ids.select("identifier", F.when(is_doi, F.concat(F.lit("doi:"), ident)).otherwise(
        F.concat(F.lit("pmid:"), ident)).alias("key"))
    doi = text_or_empty(F.col("doi"))
    listed = catalog.where(F.col("doc_id").isNotNull()).withColumn("_doi", doi)
    # Articles are found by ids alone, those with equal ids answer to the same keys; titles move once, to all who asked for them.
    keys = F.array_compact(F.array(
        F.when(F.startswith(F.col("doc_id"), F.lit("pmid:")), F.lower("doc_id")),
        F.when(doi != "", F.concat(F.lit("doi:"), normalize_doi(doi)))))
    places = join_rare(listed.select(F.explode(keys).alias("key"), "doc_id", "_doi"), stored(asked.select("key").distinct()), ["key"])
    first = places.groupBy("key").agg(F.min(F.struct("doc_id", "_doi")).alias("_at")).select("key", "_at.*")
    first = stored(first)
    named = stored(asked.join(F.broadcast(first), "key", "left") if fits(first) else answered(asked, first, ["key"]))
    blob = F.concat_ws(" ", text_or_empty(F.col("title")), F.element_at("extra", "pub_types"))
    rows = listed.select(
        "doc_id", "_doi", "title", "year", "journal", "url",
        (F.contains(blob, F.lit("Retraction")) | F.contains(blob, F.lit("Retracted"))).alias("withdrawn"))
    at = ["doc_id", "_doi"]
    wanted = stored(named.where(F.col("doc_id").isNotNull()).select(at).distinct())
    rows = first_per_key(join_rare(rows, wanted, at), at, F.xxhash64("title", "year", "journal", "url", "withdrawn"))
    found = F.col("doc_id").isNotNull()
    withdrawn = F.coalesce(F.col("withdrawn"), F.lit(False))
    return answered(named, rows, at).select(
        "identifier", found.alias("exists"), "doc_id", "title", "year", "journal", "url",
        withdrawn.alias("withdrawn"),
        F.when(~found, "not_found").when(withdrawn, "withdrawn").otherwise("ok").alias("note"))


# A key with more askers is spread over several tasks.
ASKERS = 10_000


def answered(asked: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Every row of ``asked`` with the one of ``rows`` that has its ``on``, or nulls.

    Rows are shuffled once, whatever their width. Only those with more than ``ASKERS`` askers, few of all, are copied with a salt;
    rows that ask for nothing (a null in ``on``) are not moved.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    other = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in on]
    none, asked = asked.where(~known).select("*", *other), asked.where(known)
    hot = stored(asked.groupBy(on).count().where(F.col("count") > ASKERS).select(on))
    if hot.isEmpty():
        return asked.join(rows.hint("merge"), on, "left").unionByName(none)
    cold = asked.join(hot, on, "left_anti").join(rows.hint("merge"), on, "left")
    spread = salted_join(asked.join(hot, on, "left_semi"), rows.join(hot, on, "left_semi"), on, F.monotonically_increasing_id(), "left")
    return cold.unionByName(spread).unionByName(none)


def trial_records(ids: DataFrame, trials: DataFrame) -> DataFrame:
    """``ids(nct_id)`` -> registry record, or the reason there is none.

    ``trials`` has ``nct_id`` and the record columns of the registry reader. It is first reduced to the ids asked for.
    """
    asked = ids.select("nct_id", F.upper(strip(F.col("nct_id"))).alias("key"))
    keyed = trials.withColumn("key", F.upper("nct_id")).drop("nct_id")
    rows = first_per_key(join_rare(keyed, stored(asked.select("key").distinct()), ["key"]), ["key"], F.col("title"))
    return answered(asked, stored(rows.withColumn("_hit", F.lit(True))), ["key"]).withColumn(
        "note", F.when(~is_trial_id(F.col("nct_id")), "bad_format").when(F.col("_hit").isNull(), "not_found")
        .otherwise("ok")).drop("_hit", "key")
