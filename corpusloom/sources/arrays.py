"""Large JSON arrays read by many tasks.

A string in JSON holds no line break, so at the start of a line no string is open, and the depth of brackets there is the sum of what the lines before
open and close. A first pass sums that for each split of a file, the driver adds the splits up, and the second pass cuts
the lines of a split where the depth is back at that of the array. Only records that run across the border of two splits are
shuffled. A file without line breaks is one line and so one task, as for every reader of lines.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_STRINGS = re.compile(r'"(?:\\.|[^"\\])*"?')
_BLANK = "\ufeff \t\r\n"  # with a byte order mark
_SPLIT = "file string, block long, total long, least long, first string"
_PART = "file string, owner long, block long, n long, whole boolean, value string"


def _change(line: str) -> int:
    bare = _STRINGS.sub("", line) if '"' in line else line
    return bare.count("[") + bare.count("{") - bare.count("]") - bare.count("}")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str] | None]]:
    """((file, block), lines) as they come, and (.., None) at the end of a split."""
    now = None
    for batch in batches:
        files, blocks, values = (c.to_pylist() for c in batch.columns)
        at = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or files[i] != files[at] or blocks[i] != blocks[at]:
                if now is not None and now != (files[at], blocks[at]):
                    yield now, None
                now = files[at], blocks[at]
                yield now, values[at:i]
                at = i
    if now is not None:
        yield now, None


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split what its lines open and close in total, the least sum at the end of a line, and its first character."""
    rows, depth, least, first = [], 0, None, None
    for split, lines in _by_split(batches):
        if lines is None:
            rows.append({"file": split[0], "block": split[1], "total": depth, "least": least, "first": first})
            depth, least, first = 0, None, None
            continue
        for line in lines:
            depth += _change(line)
            least = depth if least is None else min(least, depth)
            first = first or line.lstrip(_BLANK)[:1] or None
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("least", pa.int64()), ("first", pa.string())]))


def _starts(splits: list) -> dict[tuple, tuple[int, int, int]]:
    """Of each split the depth it starts with, the depth between records, and the split in which the record open there began."""
    out, file = {}, None
    for r in sorted(splits, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, depth, owner, top = r["file"], 0, r["block"], None
        top = top or r["first"]
        between = 1 if top == "[" else 0
        out[file, r["block"]] = depth, between, owner
        open_at_start = depth > between
        ends_here = not open_at_start or depth + r["least"] <= between
        depth += r["total"]
        if ends_here and depth > between:
            owner = r["block"]
    return out


def _front(text: str, first: bool, array: bool) -> str:
    """Without the array's opening bracket, or the comma that separates records."""
    text = text.lstrip(_BLANK)
    if array and first:
        text = text.removeprefix("[").lstrip()
    return text.removeprefix(",").lstrip()


def _back(text: str, last: bool, array: bool) -> str:
    """Without the array's closing bracket, or the comma."""
    text = text.rstrip()
    if array and last:
        text = text.removesuffix("]").rstrip()
    return text.removesuffix(",").rstrip()


def _cut(starts: dict[tuple, tuple[int, int, int]]):
    """Whole records (or some of one line) of a split, and the parts of those that cross its borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        fresh = True
        for split, lines in _by_split(batches):
            if fresh:
                depth, between, owner = starts[split]
                begun, held, n = depth, [], 0
                owner, fresh = owner if depth > between else split[1], False
            if lines is None:
                if held:
                    text = "\n".join(held)
                    rows.append(_part(split, owner, n, False, _front(text, begun == 0, between == 1) if owner == split[1] else text))
                fresh = True
                continue
            for line in lines:
                held.append(line)
                depth += _change(line)
                if depth <= between:
                    text, mine = _back("\n".join(held), depth <= 0, between == 1), owner == split[1]
                    if mine:
                        text = _front(text, begun == 0, between == 1)
                    if text or not mine:
                        rows.append(_part(split, owner, n, mine, text))
                    begun, held, n, owner = depth, [], n + 1, split[1]
            if len(rows) > 5000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def _part(split: tuple, owner: int, n: int, whole: bool, value: str) -> dict:
    return {"file": split[0], "owner": owner, "block": split[1], "n": n, "whole": whole, "value": value}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("file", pa.string()), ("owner", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("value", pa.string())]))


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, value``: comma-separated records in the order of (file, block, n). A file that holds one object is one record."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = lines.mapInArrow(_sums, _SPLIT).collect()
    parts = lines.mapInArrow(_cut(_starts(splits)), _PART)
    whole = parts.where("whole").select("file", "block", "n", "value")
    # Parts of a record belong to the split where it began, as its last entry.
    crossing = parts.where("not whole").groupBy("file", "owner").agg(
        F.max(F.when(F.col("block") == F.col("owner"), F.col("n"))).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(crossing.select("file", F.col("owner").alias("block"), F.coalesce("n", F.lit(0)).alias("n"), "value"))
