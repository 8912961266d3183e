"""Document, question and manifest files."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from corpusloom.schemas import DOC, QUESTION
from corpusloom.sources.arrays import array_records


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern of paths, names anything."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


# Place of a record: its file, the split of the file, its number there, and places inside the record.
POSITION = "struct<file:string,block:bigint,row:bigint,place:array<int>>"


def scan_position() -> Column:
    """Position of each row of a file scan, in the order of paths and places, whatever the sizes of files and
    splits. Rows of one split are read by one task in order, so a number that grows within a task orders them."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), F.array().cast("array<int>").alias("place"))


def inner_position(pos: Column, *places: Column) -> Column:
    """Position of a part of the record at ``pos``."""
    return F.struct(pos["file"].alias("file"), pos["block"].alias("block"), pos["row"].alias("row"),
                    F.concat(pos["place"], F.array(*[p.cast("int") for p in places])).alias("place"))


def as_position(docs: DataFrame, name: str = "pos") -> Column:
    """A position column as it is, or a caller's numbers as positions without a file."""
    if docs.schema[name].dataType.typeName() == "struct":
        return F.col(name).cast(POSITION)
    return F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col(name).cast("long").alias("row"),
                    F.array().cast("array<int>").alias("place"))


def read_docs(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Document JSON with ``pos``; no path, no rows.

    One document per line, in splits of any size. Absent fields are empty (``with_defaults``). ``arrays`` is for files that are one JSON value each, an
    array or an object; an array with line breaks between its records is read by as many tasks as it has splits (``arrays``). Records that are no JSON are left out here and listed by ``rejected_docs``.
    """
    return with_defaults(_parsed_docs(spark, path, arrays).where("_rejected is null").drop("_rejected"))


def with_defaults(docs: DataFrame) -> DataFrame:
    """Absent fields of a document: text fields are empty, there are no tags and no extra entries, the level is ``other``. Id,
    source and year stay null."""
    empty = {"tags": F.array().cast("array<string>"), "extra": F.create_map().cast("map<string,string>"), "evidence_level": F.lit("other")}
    blank = {c: F.lit("") for c in ("title", "text", "url", "journal", "doi")}
    return docs.withColumns({c: F.coalesce(F.col(c), value) for c, value in {**blank, **empty}.items()})


def rejected_docs(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """``pos, value`` of the lines (or files) that are no document JSON."""
    return _parsed_docs(spark, path, arrays).where("_rejected is not null").select("pos", F.col("_rejected").alias("value"))


def _parsed_docs(spark: SparkSession, path: str, arrays: bool) -> DataFrame:
    fields = [*DOC.fieldNames(), "pos", "_rejected"]
    if not path_exists(spark, path):
        return spark.createDataFrame([], DOC).withColumns({
            "pos": F.lit(None).cast(POSITION), "_rejected": F.lit(None).cast("string")})
    lines = spark.read.text(path).select("value", scan_position().alias("pos")).where(F.trim("value") != "")
    schema = T.StructType([*DOC.fields, T.StructField("_rejected", T.StringType())])
    options = {"columnNameOfCorruptRecord": "_rejected"}
    if not arrays:
        return lines.select(F.from_json("value", schema, options).alias("d"), "pos").select("d.*", "pos").select(*fields)
    records = array_records(spark, path)
    at = F.struct("file", "block", F.col("n").alias("row"), F.array().cast("array<int>").alias("place"))
    listed = F.concat(F.lit("["), "value", F.lit("]"))
    rows = records.select(at.alias("pos"), "value", F.posexplode_outer(F.from_json(listed, T.ArrayType(schema), options)).alias("i", "d"))
    bad = F.col("d").isNull() | F.col("d._rejected").isNotNull()
    return rows.select(
        *[F.col(f"d.{f}") for f in DOC.fieldNames()], inner_position(F.col("pos"), F.coalesce("i", F.lit(0))).alias("pos"),
        F.when(bad, F.col("value")).alias("_rejected")).select(*fields)


def write_docs(docs: DataFrame, path: str, fmt: str = "json") -> int:
    """Write and return the row count, taken from the write job itself."""
    seen = Observation()
    out = docs.select(*DOC.fieldNames()).observe(seen, F.count("*").alias("n"))
    out.write.mode("overwrite").format(fmt).save(path)
    return seen.get["n"]


def parse_docs(line: Column) -> Column:
    return F.from_json(line, DOC)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions_from_lines(spark.read.text(path))


def questions_from_lines(lines: DataFrame) -> DataFrame:
    """JSON lines of questions; blank lines are skipped, lines that are no JSON are left to ``rejected_lines``."""
    rows = _judged(lines, QUESTION).where("q._rejected is null").select("q.*").drop("_rejected")
    return rows.withColumns({
        "track": F.coalesce("track", F.lit("clinical")),
        "must_cite": F.coalesce("must_cite", F.lit(True)),
        "gold_points": F.coalesce("gold_points", F.array().cast("array<string>")),
    })


def _judged(lines: DataFrame, schema: T.StructType) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("_rejected", T.StringType())])
    return lines.where(F.trim("value") != "").withColumn(
        "q", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_rejected"}))


def rejected_lines(lines: DataFrame, schema: T.StructType = QUESTION) -> DataFrame:
    """The rows of ``lines(value, ..)`` that are no JSON of this form."""
    return _judged(lines, schema).where("q._rejected is not null").drop("q")


def fixed_docs(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A handful of hand-written documents as a source; missing fields are empty."""
    blank = {"title": "", "text": "", "url": "", "tags": [], "evidence_level": "other", "journal": "", "doi": "",
             "extra": {}, "source": "local", "year": None}
    data = [tuple({**blank, **r}[f] for f in DOC.fieldNames()) + (i,) for i, r in enumerate(rows)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DOC) + ", pos bigint"
    return spark.createDataFrame(data, schema)


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Manifest rows ``stage, n``; one aggregate per stage, in one plan."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, modified`` of every file below a path, for a run manifest."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, for manifests, summaries and result tables."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
