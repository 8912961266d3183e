"""Local Markdown files and literature tables in Markdown."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import rules
from corpusloom.functions.pieces import packer
from corpusloom.functions.text import (
    level_from_rules, normalize_level, or_else, strip, text_or_empty,
)
from corpusloom.operators.common import first_per_key
from corpusloom.sources.files import as_position, inner_position, scan_position

# The line ends that a Unicode-aware line splitter knows.
_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``stem, text, pos`` of every ``*.md`` file below ``path``."""
    name = F.col("_metadata.file_name")
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_replace(name, r"\.md$", "").alias("stem"), F.col("value").alias("text"),
                        scan_position().alias("pos"))


def lines_of(text: Column) -> Column:
    """Lines without the empty one after a final line end."""
    lines = F.split(text, _LINE_END, -1)
    n = F.size(lines)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, n - 1)).otherwise(lines)


_HEADING = r"#{1,6}[^\S\n]"


def with_sections(files: DataFrame) -> DataFrame:
    """``files(stem, text, …)`` with ``i, title, text`` per section.

    One split before every heading line gives the sections without leaving the
    row. A heading without a title keeps the title before it.
    """
    text = F.regexp_replace(F.col("text"), _LINE_END, "\n")
    sections = F.split(F.regexp_replace(text, "\n$", ""), rf"(?U)\n(?={_HEADING})")
    rows = files.withColumn("_sections", sections)
    titles = F.transform("_sections", lambda s, i: F.when(
        s.rlike(rf"(?U)^{_HEADING}"), strip(F.regexp_extract(s, r"(?U)^#{1,6}[^\S\n]+([^\n]*)", 1)))
        .when(i == 0, F.col("stem")).otherwise(""))
    # The last number with a title up to each section, in one pass: numbers of titled sections, and how many there are so far.
    rows = rows.withColumn("_titles", titles)
    titled = F.filter(F.transform("_titles", lambda t, i: F.when(t != "", i)), lambda i: i.isNotNull())
    kept = [c for c in files.columns if c != "text"]
    rows = rows.withColumn("_titled", titled)
    spans = F.transform("_titled", lambda at, k: F.coalesce(F.get("_titled", k + 1), F.size("_titles")) - at)
    carried = F.flatten(F.transform(F.arrays_zip(F.col("_titled").alias("at"), spans.alias("n")), lambda x: F.array_repeat(
        F.get("_titles", x["at"]), x["n"])))
    leading = F.array_repeat(F.col("stem"), F.coalesce(F.get("_titled", F.lit(0)), F.size("_titles")))
    named = F.concat(leading, carried)
    rows = rows.select(*kept, F.posexplode_outer(F.arrays_zip(named.alias("title"), F.col("_sections").alias("text")))
                       .alias("i", "s"))
    return rows.select(*kept, "i", F.col("s.title").alias("title"), strip(F.col("s.text")).alias("text"))


def _local_doc(doc_id: Column, title: Column, text: Column) -> list[Column]:
    return [
        doc_id.alias("doc_id"), F.lit("local").alias("source"), title.alias("title"), text.alias("text"),
        F.lit(None).cast("int").alias("year"), F.lit("").alias("url"),
        F.array(F.lit("local"), F.lit("ebook")).alias("tags"), F.lit("ebook").alias("evidence_level"),
        F.lit("").alias("journal"), F.lit("").alias("doi"),
        F.create_map().cast("map<string,string>").alias("extra")]


def markdown_docs(files: DataFrame, whole_below: int | None = None,
                  max_chars: int = rules.SECTION_MAX_CHARS) -> DataFrame:
    """``files(stem, text[, pos])`` by section; a section above ``max_chars`` is packed from its paragraphs. Empty sections are
    dropped but keep their number. With ``whole_below``, files of at most that many characters become one document each.
    """
    stem, text = F.col("stem"), F.col("text")
    if "pos" not in files.columns:
        files = files.withColumn("pos", F.lit(0))
    short = F.lit(False) if whole_below is None else F.length("text") <= whole_below
    whole = files.select("stem", as_position(files).alias("pos"), short.alias("short"), F.when(short, text).alias("whole"),
                         F.when(short, "").otherwise(text).alias("text"))
    rows = with_sections(whole).where(F.col("short") | (F.col("text") != ""))
    rows = rows.withColumn("text", F.when(F.col("short"), F.col("whole")).otherwise(text)).drop("whole")
    packed = ~F.col("short") & (F.length("text") > max_chars)
    rows = rows.withColumn("_packed", packer(max_chars)(F.when(packed, text)))
    parts = F.when(packed, F.col("_packed")).otherwise(F.array("text"))
    rows = rows.select("stem", "pos", "short", "i", "title", packed.alias("packed"), F.posexplode_outer(parts).alias("j", "text"))
    section = F.concat(F.lit(":"), F.col("i").cast("string"))
    part = F.concat(F.lit(":"), F.col("j").cast("string"))
    suffix = F.concat(F.lit("（"), (F.col("j") + 1).cast("string"), F.lit("）"))
    place = F.when(F.col("short"), "").when(F.col("packed"), F.concat(section, part)).otherwise(section)
    title = F.when(F.col("short"), stem).when(F.col("packed"), F.concat("title", suffix)).otherwise(F.col("title"))
    return rows.select(*_local_doc(F.concat(F.lit("local:md:"), stem, place), title, text),
                       inner_position(F.col("pos"), F.col("i"), F.col("j")).alias("pos"))


def split_sections(files: DataFrame, max_chars: int = rules.SECTION_MAX_CHARS) -> DataFrame:
    """One document per section of every file, however short the file."""
    return markdown_docs(files, max_chars=max_chars)


def _cells(row: Column) -> Column:
    bare = F.regexp_replace(row, r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: strip(F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")))


LOOK_BACK = 6


def table_context(line: Column) -> Column:
    """First cell of a line that names the literature column; null for any other line."""
    named = (F.contains(line, F.lit("|")) & ~F.contains(line, F.lit("PMID"))
             & F.contains(line, F.lit(rules.LITERATURE_CONTEXT_WORD)) & ~F.contains(line, F.lit("|---|---")))
    return F.when(named, strip(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|")[0]))


def literature_rows(files: DataFrame, default_context: str = rules.LITERATURE_DEFAULT_CONTEXT) -> DataFrame:
    """Table lines of ``files(file, text[, pos])`` with their context -> ``file, at, line, context, pos``.

    The context is the first cell of the earliest of the six lines before that names the literature column. It belongs to
    the first line of the file with that exact content; a line with outer blanks has none and gets the default.
    Contexts are found inside the row, six lines at a time; only short rows leave it.
    """
    if "pos" not in files.columns:
        files = files.withColumn("pos", F.lit(0))
    rows = files.select("file", as_position(files).alias("pos"), lines_of(F.col("text")).alias("lines"))
    rows = rows.withColumn("_named", F.transform("lines", table_context))
    shown = F.transform("lines", lambda x, i: F.when(F.startswith(strip(x), F.lit("|")), F.struct(
        i.alias("at"), x.alias("raw"), F.coalesce(*[F.get("_named", F.greatest(i - back, F.lit(-1)))
                                                    for back in range(LOOK_BACK, 0, -1)]).alias("near"))))
    rows = rows.select("file", "pos", F.explode(F.array_compact(shown)).alias("t")).select(
        "file", "pos", "t.*", strip(F.col("t.raw")).alias("line"))
    rows = rows.where(~F.startswith("line", F.lit("|---")) & ~F.startswith("line", F.lit(rules.LITERATURE_HEADER)))
    first = rows.where(F.col("raw") == F.col("line")).groupBy("file", "line").agg(F.min_by("near", "at").alias("context"))
    return rows.join(first, ["file", "line"], "left").select(
        "file", "at", "line", F.coalesce("context", F.lit(default_context)).alias("context"),
        inner_position(F.col("pos"), F.col("at")).alias("pos"))


_START = r"(?<![\p{L}\p{N}_])"
_STOP = r"(?![\p{L}\p{N}_])"
_SKIPPED = rf"(?<!\p{{Lu}})({'|'.join(rules.LITERATURE_SKIP_WORDS)})(?![\p{{Lu}}0-9])"


def literature_docs(files: DataFrame, default_context: str = rules.LITERATURE_DEFAULT_CONTEXT) -> DataFrame:
    """Literature tables -> documents; the first row of each article in a file wins.

    Rows with a skip word are left out, not those where its letters are part of a longer word in capitals. The year is that of a cell with nothing
    else in it, else the first in the row.
    """
    rows = literature_rows(files, default_context).withColumn("cells", _cells(F.col("line")))
    joined = F.array_join("cells", " ")
    rows = rows.withColumn("joined", joined).withColumn(
        "pmid", F.regexp_extract("joined", rf"{_START}([0-9]{{7,8}}){_STOP}", 1))
    rows = rows.where((F.col("pmid") != "") & ~F.col("joined").rlike(_SKIPPED))
    rows = first_per_key(rows, ["file", "pmid"], F.col("at"))
    named = F.get(F.filter("cells", lambda c: F.contains(c, F.lit("et al")) | F.contains(c, F.lit("*"))), F.lit(0))
    rows = rows.withColumn("title", F.regexp_replace(F.coalesce(named, F.col("joined")), "<[^>]+>", ""))
    blob = F.concat_ws(" ", F.get("cells", F.lit(0)), "title", "joined")
    level = normalize_level(F.lit(""), blob, rules.TITLE_LEVEL_RULES)
    alone = F.get(F.filter("cells", lambda c: c.rlike("^(19|20)[0-9]{2}$")), F.lit(0))
    year = F.coalesce(alone, F.regexp_extract("joined", rf"{_START}(19[0-9]{{2}}|20[0-9]{{2}}){_STOP}", 1))
    return rows.select(
        F.concat(F.lit("pmid:"), "pmid").alias("doc_id"), F.lit("pubmed").alias("source"), "title",
        F.concat(F.lit(rules.LITERATURE_TEXT_PREFIX), "title", F.lit("\n"), "context").alias("text"),
        F.nullif(year, F.lit("")).cast("int").alias("year"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"),
        F.array(F.lit("literature"), F.lit("curated")).alias("tags"),
        F.when(level == "other", level_from_rules(F.lower(blob), rules.LITERATURE_LEVEL_RULES)).otherwise(level)
        .alias("evidence_level"),
        text_or_empty(F.get(F.filter("cells", lambda c: F.contains(c, F.lit("*"))), F.lit(0))).alias("journal"),
        F.regexp_extract("joined", rf"{_START}(10\.[0-9]{{4,9}}/[^\s·|]+)", 1).alias("doi"),
        F.create_map().cast("map<string,string>").alias("extra"),
        "file", "pos")
