"""Topic pages: document selection, evidence block, single-page refresh, lint."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import rules
from corpusloom.functions.text import head, text_or_empty
from corpusloom.operators.common import BROADCAST_ROWS, join_small, top_k


def topic_table(spark: SparkSession, topics=rules.TOPICS) -> DataFrame:
    return spark.createDataFrame(topics, "slug string, title string, query_tags array<string>")


# Topics compared inside the document row; a longer table is joined by tag.
TOPICS_IN_ROW = 1000


def select_docs(docs: DataFrame, topics: DataFrame, limit: int = 8) -> DataFrame:
    """Top documents per topic by number of shared tags, then year, then corpus order.

    Up to ``TOPICS_IN_ROW`` topics, every document counts its shared tags itself, and each task keeps
    ``limit`` rows per topic before the shuffle. Beyond that both sides meet by tag in a salted join.
    """
    held = topics.select("slug", "query_tags").limit(TOPICS_IN_ROW + 1).collect()
    if len(held) <= TOPICS_IN_ROW:
        wanted = F.array(*[F.struct(F.lit(t.slug).alias("slug"), F.array(*map(F.lit, t.query_tags or [])).cast("array<string>")
                                    .alias("tags")) for t in held]) if held else F.array().cast(
            "array<struct<slug:string,tags:array<string>>>")
        have = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
        shared = F.filter(F.transform(wanted, lambda t: F.struct(t["slug"].alias("slug"), F.size(F.array_intersect(
            have, t["tags"])).cast("long").alias("overlap"))), lambda t: t["overlap"] > 0)
        scored = docs.select("doc_id", "ord", "year", F.explode(shared).alias("t")).select("t.slug", "doc_id", "ord", "year", "t.overlap")
    else:
        asked = topics.select("slug", F.explode(F.array_distinct("query_tags")).alias("tag"))
        tagged = docs.select("doc_id", "ord", "year", F.explode(F.array_distinct("tags")).alias("tag"))
        scored = join_small(tagged, asked, ["tag"], unique=F.col("doc_id")).groupBy("slug", "doc_id", "ord", "year").agg(
            F.count("*").alias("overlap"))
    return top_k(scored, ["slug"], limit, F.col("overlap").desc(), F.coalesce(F.col("year"), F.lit(0)).desc(),
                 F.col("ord"))


def evidence_lines(docs: DataFrame, topics: DataFrame, limit: int = 8) -> DataFrame:
    """Topic -> evidence text block and number of source documents; topics without documents included."""
    chosen = select_docs(docs, topics, limit).select("slug", "doc_id", "rank")
    line = F.concat(
        F.lit("- ["), F.col("doc_id"), F.lit("] "), F.col("title"), F.lit(" ("),
        F.coalesce(F.when(F.col("year") != 0, F.col("year").cast("string")), F.lit("n/a")), F.lit("): "),
        head(text_or_empty(F.col("text")), 400))
    if topics.count() * limit <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    lines = docs.select("doc_id", line.alias("line")).join(chosen, "doc_id")
    blocks = lines.groupBy("slug").agg(
        F.count("*").alias("n_docs"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))),
                                 lambda x: x["line"]), "\n\n").alias("block"))
    return topics.select("slug", "title", "query_tags").join(blocks, "slug", "left").withColumns({
        "n_docs": F.coalesce(F.col("n_docs"), F.lit(0)),
        "block": F.coalesce(F.col("block"), F.lit(rules.TOPIC_NO_DOCS)),
    })


def render_pages(blocks: DataFrame, updated_at: str, prose: Column | None = None) -> DataFrame:
    """Page documents. ``prose`` is a column of supplied page text; the evidence
    block is the body without it. ``updated_at`` is a parameter."""
    body = F.concat(
        prose if prose is not None else F.col("block"), F.lit("\n\n---\n> 本页基于 "), F.col("n_docs").cast("string"),
        F.lit(f" 条证据文档生成 · {rules.TOPIC_UPDATED_MARK} {updated_at} · {rules.TOPIC_DISCLAIMER_MARK}"))
    return blocks.select(
        F.concat(F.lit("wiki:"), F.col("slug")).alias("doc_id"), F.lit("wiki").alias("source"), "title",
        body.alias("text"), F.lit(None).cast("int").alias("year"), F.lit("").alias("url"),
        F.concat("query_tags", F.array(F.lit("wiki"))).alias("tags"), F.lit("wiki").alias("evidence_level"),
        F.lit("").alias("journal"), F.lit("").alias("doi"),
        F.create_map().cast("map<string,string>").alias("extra"), "slug")


def refresh_page(docs: DataFrame, topics: DataFrame, slug: str, updated_at: str) -> DataFrame:
    """Page document of one topic; an unknown slug is an error."""
    one = topics.where(F.col("slug") == slug)
    if one.isEmpty():
        raise ValueError(f"unknown topic slug: {slug}")
    return render_pages(evidence_lines(docs, one), updated_at)


def write_pages(pages: DataFrame, path: str) -> None:
    """One directory per slug. Writing some slugs leaves the others in place."""
    (pages.select("slug", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("text")).alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").text(path))


def topic_index(pages: DataFrame) -> DataFrame:
    """``slug, title`` of every page, for the index beside the pages."""
    return pages.select("slug", "title")


def write_topic_files(pages: DataFrame, path: str) -> None:
    """Pages below ``path/pages`` and their index, JSON lines, below ``path/index``."""
    write_pages(pages, f"{path}/pages")
    topic_index(pages).coalesce(1).write.mode("overwrite").json(f"{path}/index")


def read_topic_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``pages(slug, text)`` and ``index(slug, title)`` as they were written."""
    pages = spark.read.schema("value string, slug string").text(f"{path}/pages", wholetext=True)
    return pages.select("slug", F.col("value").alias("text")), spark.read.schema("slug string, title string").json(f"{path}/index")


def lint_pages(pages: DataFrame, index: DataFrame, known: DataFrame, sections=rules.TOPIC_SECTIONS,
               updated_mark: str = rules.TOPIC_UPDATED_MARK,
               disclaimer_mark: str = rules.TOPIC_DISCLAIMER_MARK) -> DataFrame:
    """Issues as rows ``slug, issue, detail``.

    ``pages(slug, text)``, ``index(slug)``, ``known(doc_id)``. Contents are
    checked only for pages that are in the index; its slugs count as known ids.
    """
    index = index.select("slug").distinct()
    missing_file = index.join(pages.select("slug"), "slug", "left_anti").select(
        "slug", F.lit("no_page").alias("issue"), F.lit("").alias("detail"))
    missing_entry = pages.select("slug").join(index, "slug", "left_anti").select(
        "slug", F.lit("not_in_index").alias("issue"), F.lit("").alias("detail"))
    checked = pages.join(index, "slug", "left_semi")
    text = F.col("text")
    absent = F.filter(F.array(*[F.lit(s) for s in sections]), lambda s: ~F.contains(text, F.concat(F.lit("## "), s)))

    def issue(cond: Column, name: str, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("issue"), detail.alias("detail")))

    content = checked.select("slug", F.explode(F.array_compact(F.array(
        issue(F.size(absent) > 0, "missing_sections", F.array_join(absent, " ")),
        issue(~F.contains(text, F.lit(updated_mark)), "no_update_mark", F.lit("")),
        issue(~F.contains(text, F.lit(disclaimer_mark)), "no_disclaimer", F.lit("")),
    ))).alias("i")).select("slug", "i.issue", "i.detail")
    return missing_file.unionByName(missing_entry).unionByName(content).unionByName(
        unknown_citations(checked, index, known))


def unknown_citations(pages: DataFrame, index: DataFrame, known: DataFrame, shown: int | None = None) -> DataFrame:
    """Ids cited as ``[prefix:id]`` that the corpus lacks; all of a page's, or the first ``shown``."""
    cited = pages.select("slug", F.explode(F.array_distinct(F.regexp_extract_all(
        F.col("text"), F.lit(r"\[([\p{L}\p{N}_:.\-]+)\]"), F.lit(1)))).alias("doc_id"))
    prefixed = F.lit(False)
    for p in rules.CITED_PREFIXES:
        prefixed = prefixed | F.startswith(F.col("doc_id"), F.lit(p))
    own = index.select(F.concat(F.lit("wiki:"), F.col("slug")).alias("doc_id"))
    unknown = cited.where(prefixed).join(known.select("doc_id").unionByName(own), "doc_id", "left_anti")
    first = unknown if shown is None else top_k(unknown, ["slug"], shown, F.col("doc_id"))
    return first.groupBy("slug").agg(F.array_join(F.sort_array(F.collect_list("doc_id")), " ").alias("detail")).select(
        "slug", F.lit("unknown_citation").alias("issue"), "detail")
