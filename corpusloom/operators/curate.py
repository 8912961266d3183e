"""Corpus curation: source order, first-wins merge, fold dedupe, levels, tags, filters."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions import rules, scoring
from corpusloom.functions.text import (
    cut, level_from_rules, normalize_doi, normalize_level, normalize_title, strip, tags_from_rules, text_or_empty,
)
from corpusloom.operators.common import first_per_key, mark_maybe, stored
from corpusloom.sources.files import as_position

def union_sources(*sources: DataFrame) -> DataFrame:
    """Union in priority order. Each source has ``pos``, its own position, from a reader or a number; the
    result has ``ord``, one position for the whole corpus: the source's place, then the position in it."""
    numbered = [s.withColumn("ord", corpus_order(F.lit(i), as_position(s))).drop("pos") for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def corpus_order(source: Column, pos: Column) -> Column:
    return F.struct(source.cast("int").alias("source"), *[pos[f].alias(f) for f in ("file", "block", "row", "place")])


def merge_first_wins(docs: DataFrame) -> DataFrame:
    """First occurrence of each ``doc_id`` by ``ord``.

    Ids alone are counted. Rows whose id is certainly not repeated stay where they are; the others, and a few more by a filter's
    mistake, are shuffled, the first of each task only. ``docs`` is read twice: store what is dear to make.
    """
    repeated = stored(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    marked = mark_maybe(docs, repeated, ["doc_id"])
    first = first_per_key(marked.where("_maybe"), ["doc_id"], F.col("ord"))
    return marked.where("not _maybe").unionByName(first).drop("_maybe")


def dedupe_key(doc_id: Column, doi: Column, title: Column) -> Column:
    by_doi = F.concat(F.lit("doi:"), normalize_doi(doi))
    by_title = F.concat(F.lit("title:"), normalize_title(text_or_empty(title)))
    key = F.when(text_or_empty(doi) != "", by_doi).otherwise(by_title)
    return F.when(key.isin("doi:", "title:"), F.concat(F.lit("id:"), doc_id)).otherwise(key)


def with_completeness(docs: DataFrame) -> DataFrame:
    c = scoring.completeness(
        F.length(strip(text_or_empty(F.col("text")))), _filled("year"), _filled("url"), _filled("journal"),
        _filled("doi"), F.size(F.coalesce(F.col("tags"), F.array())))
    return docs.withColumn("completeness", c)


def _filled(name: str) -> Column:
    if name == "year":
        return F.coalesce(F.col("year") != 0, F.lit(False))
    return text_or_empty(F.col(name)) != ""


_FOLD_FIELDS = ["url", "journal", "doi", "year"]


def dedupe_fold(docs: DataFrame) -> DataFrame:
    """One document per DOI-else-title key, with the fields of the group merged.

    Meaning: walk the group by ``ord``; a document with strictly higher
    completeness than the merged document so far takes over and fills its gaps
    from it, any other document only fills gaps. The merged document's
    completeness grows as it absorbs, so the walk depends on the order.

    Plan: no group is ever collected, so a key that holds a third of the corpus
    is fine. Four facts make that possible.

    * Only a document whose own completeness exceeds that of all earlier ones in
      the group can take over. There are at most as many of those as there are
      distinct completeness values, and they are found after a map-side
      pre-aggregation to the first ``ord`` per (key, length, filled fields).
    * The merged document has a field as soon as any earlier document has it, so
      its completeness follows from first positions, which are ``min(ord)``.
    * The value of a field at the end is that of the last take-over that had one,
      else that of the first document that had one.
    * Tags and extra entries follow the same rule per tag and per entry.

    Year 0, blank text and empty extra values count as missing. ``docs`` needs
    ``ord``, of any type with an order; rows of one ``ord`` are told apart by ``doc_id``, so after
    ``merge_first_wins`` no two rows are alike. The result keeps the group's first ``ord``.

    Keys alone are counted. Documents whose key is certainly not repeated, the great majority, stay where they are and go past all
    steps, with their texts; of the others everything but the texts is stored as a narrow table, and their texts are shuffled once, to the row
    that keeps them. ``docs`` is read several times: store what is dear to make.
    """
    keys = _keyed(docs)
    repeated = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    marked = mark_maybe(keys, repeated, ["key"])
    alone = marked.where("not _maybe").drop("_maybe")
    asked = marked.where("_maybe").drop("_maybe")
    tags = F.array_distinct(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    year = F.when(_filled("year"), F.col("year"))
    extra = F.map_filter(F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>")),
                         lambda k, v: F.coalesce(v, F.lit("")) != "")
    cleaned = {"tags": tags, "year": year, "extra": extra}
    single = alone.unionByName(asked.join(repeated, "key", "left_anti")).drop("key").withColumns(cleaned)
    asked = asked.withColumn("ord", F.struct("ord", "doc_id"))
    keyed = stored(asked.withColumns(cleaned).withColumn("text_len", F.length(strip(text_or_empty(F.col("text")))))
                   .drop("text").join(repeated, "key", "left_semi"))
    kind = keyed.schema["ord"].dataType.simpleString()

    shape = keyed.select(
        "key", "ord", "text_len",
        *[_filled(f).alias(f"has_{f}") for f in _FOLD_FIELDS], F.size("tags").alias("n_tags"))
    shapes = shape.groupBy("key", "text_len", "n_tags", *[f"has_{f}" for f in _FOLD_FIELDS]).agg(
        F.min("ord").alias("ord"))
    shapes = shapes.withColumn("completeness", scoring.completeness(
        F.col("text_len"), F.col("has_year"), F.col("has_url"), F.col("has_journal"), F.col("has_doi"),
        F.col("n_tags")))

    group = Window.partitionBy("key")
    upto = group.orderBy(F.col("completeness").desc()).rangeBetween(Window.unboundedPreceding, 0)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = shapes.select(
        "*", (F.col("ord") == F.min("ord").over(upto)).alias("is_record"),
        F.min("ord").over(whole).alias("first_ord"),
        F.min(F.when(F.col("text_len") > 0, F.struct("ord", "text_len"))).over(whole).alias("first_text"),
        *[F.min(F.when(F.col(f"has_{f}"), F.col("ord"))).over(whole).alias(f"first_{f}") for f in _FOLD_FIELDS])

    tag_rows = keyed.select("key", "ord", F.posexplode("tags").alias("idx", "tag"))
    tag_first = tag_rows.groupBy("key", "tag").agg(F.min("ord").alias("ord"))
    tag_firsts = tag_first.groupBy("key").agg(F.collect_list("ord").alias("tag_firsts"))

    firsts = ["first_ord", "first_text", *[f"first_{f}" for f in _FOLD_FIELDS]]
    groups = marked.where("is_record").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(
            "ord", "completeness", "text_len", *[f"has_{f}" for f in _FOLD_FIELDS]))).alias("records"),
        *[F.first(c).alias(c) for c in firsts]).join(tag_firsts, "key", "left")

    none = F.lit(None).cast(kind)
    start = F.struct(
        F.array().cast(f"array<{kind}>").alias("winners"), none.alias("text"), F.lit(0).alias("text_len"),
        *[none.alias(f) for f in _FOLD_FIELDS])

    def step(acc: Column, r: Column) -> Column:
        def before(first: str) -> Column:
            return F.coalesce(F.col(first) < r["ord"], F.lit(False))

        state_len = F.when(acc["text"].isNotNull(), acc["text_len"]).when(
            F.coalesce(F.col("first_text.ord") < r["ord"], F.lit(False)), F.col("first_text.text_len")).otherwise(0)
        n_tags = F.size(F.filter(F.coalesce(F.col("tag_firsts"), F.array().cast(f"array<{kind}>")),
                                 lambda o: o < r["ord"]))
        state = scoring.completeness(state_len, before("first_year"), before("first_url"), before("first_journal"),
                                     before("first_doi"), n_tags)
        wins = (F.size(acc["winners"]) == 0) | (r["completeness"] > state)
        has_text = wins & (r["text_len"] > 0)
        return F.struct(
            F.when(wins, F.concat(acc["winners"], F.array(r["ord"]))).otherwise(acc["winners"]).alias("winners"),
            F.when(has_text, r["ord"]).otherwise(acc["text"]).alias("text"),
            F.when(has_text, r["text_len"]).otherwise(acc["text_len"]).alias("text_len"),
            *[F.when(wins & r[f"has_{f}"], r["ord"]).otherwise(acc[f]).alias(f) for f in _FOLD_FIELDS])

    walked = groups.select("key", *firsts, F.aggregate("records", start, step).alias("end"))
    last = F.element_at("end.winners", -1)
    winners = stored(walked.select(
        "key", "first_ord", F.col("end.winners").alias("winners"), last.alias("winner"),
        F.coalesce(F.col("end.text"), F.col("first_text.ord"), last).alias("text_ord"),
        *[F.coalesce(F.col(f"end.{f}"), F.col(f"first_{f}")).alias(f"{f}_ord") for f in _FOLD_FIELDS]))

    # Fields that come from another row than the winner.
    borrowed = winners.select("key", F.explode(F.filter(
        F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_ord").alias("ord")) for f in _FOLD_FIELDS]),
        lambda b: b["ord"] != F.col("winner"))).alias("b")).select("key", "b.field", "b.ord")
    lent = borrowed.join(keyed.select("ord", *_FOLD_FIELDS), "ord").groupBy("key").agg(
        *[F.max(F.when(F.col("field") == f, F.col(f))).alias(f"lent_{f}") for f in _FOLD_FIELDS])

    # Take-overs are numbered, so that the latest can come first whatever the type of ``ord``.
    took_over = winners.select(F.posexplode("winners").alias("won", "ord"))
    parts = keyed.select("key", "ord", "tags", "extra").join(took_over, "ord", "left")
    won = F.col("won").isNotNull()

    # Tags of take-overs, latest first; then the rest by first appearance.
    tag_order = parts.select("key", "ord", "won", F.posexplode("tags").alias("idx", "tag")).groupBy("key", "tag").agg(
        F.max(F.when(won, F.struct(F.col("won"), (-F.col("idx")).alias("at")))).alias("w"),
        F.min(F.struct("ord", "idx")).alias("f"))
    merged_tags = tag_order.select("key", F.struct(
        F.col("w").isNull().alias("late"), (-F.col("w.won")).alias("a"), (-F.col("w.at")).alias("b"),
        F.col("f.ord").alias("c"), F.col("f.idx").alias("d"), "tag").alias("t")).groupBy("key").agg(
        F.transform(F.sort_array(F.collect_list("t")), lambda t: t["tag"]).alias("tags"))

    entries = parts.select("key", "ord", "won", F.explode("extra").alias("k", "v")).groupBy("key", "k").agg(
        F.coalesce(F.max(F.when(won, F.struct("ord", "v"))), F.min(F.struct("ord", "v"))).alias("e"))
    merged_extra = entries.groupBy("key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "e.v")))).alias("extra"))

    light = [c for c in keyed.columns if c not in ("key", "ord", "tags", "extra", "text_len")]
    base = keyed.select(F.col("ord").alias("winner"), *light)
    merged = (winners.drop("winners")
              .join(lent, "key", "left").join(merged_tags, "key", "left").join(merged_extra, "key", "left")
              .join(base, "winner"))

    def final(name: str) -> Column:
        if name == "ord":
            return F.col("first_ord.ord").alias("ord")
        if name == "tags":
            return F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags")
        if name == "extra":
            return F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>")).alias("extra")
        if name in _FOLD_FIELDS:
            return F.coalesce(F.when(_filled(name), F.col(name)), F.col(f"lent_{name}"), F.col(name)).alias(name)
        return F.col(name)

    fields = [c for c in docs.columns if c != "text"]
    decided = merged.select("text_ord", *[final(c) for c in fields])
    texts = asked.select(F.col("ord").alias("text_ord"), "text")
    return decided.join(texts, "text_ord").select(*docs.columns).unionByName(single.select(*docs.columns))


def fold_into(corpus: DataFrame, landed: DataFrame) -> DataFrame:
    """``corpus``, a result of ``dedupe_fold`` or of this, after more documents have landed behind it.

    The folded document of a key is all that the walk needs to go on: its completeness is that of its fields, and tags and extra
    entries are in the order of the walk. So only documents of landed keys are folded again, as the first of their
    group; any split of a corpus into batches in order gives the same rows as one fold. Other documents stay where they are. Both
    tables are read several times and should be stored; every ``ord`` of ``landed`` is greater than all of ``corpus``.
    """
    keys = stored(_keyed(landed).select("key").distinct())
    marked = mark_maybe(_keyed(corpus), keys, ["key"])
    asked = marked.where("_maybe").drop("_maybe")
    touched = asked.join(keys, "key", "left_semi").drop("key")
    others = marked.where("not _maybe").drop("_maybe").unionByName(asked.join(keys, "key", "left_anti")).drop("key")
    return others.select(corpus.columns).unionByName(dedupe_fold(stored(touched.unionByName(landed.select(corpus.columns)))))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", dedupe_key(F.col("doc_id"), F.col("doi"), F.col("title")))


def folded_changes(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``fold_into`` has changed: new or different documents, and ``doc_id`` of those that are no more. For ``search_store``."""
    columns = [c for c in after.columns if c != "extra"]
    shape = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in columns], F.sort_array(F.map_entries("extra")))
    old = before.select("doc_id", shape.alias("_shape"))
    changed = after.withColumn("_shape", shape).join(old, ["doc_id", "_shape"], "left_anti").drop("_shape")
    return changed, before.select("doc_id").join(after.select("doc_id"), "doc_id", "left_anti")


def grade_from_text(docs: DataFrame, level_rules=rules.TEXT_LEVEL_RULES, most: int | None = None) -> DataFrame:
    """Re-grade level ``other`` from title + text, or from their first ``most`` characters."""
    blob = F.lower(cut(F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("text"))), most))
    level = F.col("evidence_level")
    return docs.withColumn("evidence_level", F.when(
        level == "other", level_from_rules(blob, level_rules)).otherwise(level))


def enrich_local(docs: DataFrame, tag_rules=rules.LOCAL_TAGS, level_rules=rules.TITLE_LEVEL_RULES) -> DataFrame:
    """Append missing topic tags; grade from the title where the level is ``other``."""
    blob = F.lower(F.concat_ws(" ", text_or_empty(F.col("title")), text_or_empty(F.col("text"))))
    level = F.col("evidence_level")
    return docs.withColumns({
        "tags": F.array_union(F.coalesce(F.col("tags"), F.array().cast("array<string>")), tags_from_rules(blob, tag_rules)),
        "evidence_level": F.when(level == "other", normalize_level(
            F.lit(""), F.col("title"), level_rules)).otherwise(level),
    })


def annotate_batch(docs: DataFrame, batch: str, source: str, queries: list[str]) -> DataFrame:
    """Record the collection batch in ``extra``; existing entries of that name are replaced."""
    note = {"collection_batch": batch, "collection_source": source, "collection_query": " | ".join(queries)}
    added = F.create_map(*[F.lit(x) for kv in note.items() for x in kv])
    extra = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(extra, lambda k, v: ~k.isin(list(note)))
    return docs.withColumn("extra", F.map_concat(kept, added))


def is_open_access(extra: Column, doi: Column, url: Column) -> Column:
    def flag(name: str) -> Column:
        return F.coalesce(F.upper(F.element_at(extra, name)) == "Y", F.lit(False))

    linked = (text_or_empty(doi) != "") | (text_or_empty(url) != "")
    return flag("isOpenAccess") | (flag("inPMC") & linked)


def open_access_only(docs: DataFrame, observation=None) -> DataFrame:
    """Open access, or archived and linked. ``observation`` counts kept and dropped rows."""
    keep = is_open_access(F.col("extra"), F.col("doi"), F.col("url"))
    if observation is not None:
        docs = docs.observe(observation, F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))
    return docs.where(keep)


def ordered_unique(ids: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """First position of every id. A hash aggregate with map-side combine, no sort."""
    return ids.groupBy(key).agg(F.min(order).alias(order))


def outside_lists(docs: DataFrame, sources=rules.SOURCE_NAMES, levels=rules.EVIDENCE_LEVELS) -> DataFrame:
    """``doc_id, field, value`` of every source and evidence level that is not in its closed list; null counts as not."""
    def bad(name: str, known: list[str]) -> Column:
        value = F.col(name)
        return F.when(~F.coalesce(value.isin(known), F.lit(False)), F.struct(F.lit(name).alias("field"), value.alias("value")))

    found = F.array_compact(F.array(bad("source", sources), bad("evidence_level", levels)))
    return docs.select("doc_id", F.explode(found).alias("b")).select("doc_id", "b.field", "b.value")
