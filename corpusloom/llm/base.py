"""Helpers of the training-data operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.operators.common import new_folder, stored

# A key with more than a HOT_PARTS-th of all rows is hot, so fewer than HOT_PARTS keys are: that
# bounds what is broadcast for them.
HOT_PARTS = 1000

# Fixed byte classes: white space is \x20 and \x09-\x0D, the default of bytes.split().
_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_WORD_TABLE = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEEP else b if b in _KEEP else 0x20 for b in range(256))


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def plain_words(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of an Arrow string array without nulls."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return at, np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(column) -> Iterator[bytes]:
    """UTF-8 bytes of each value of an Arrow string array; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: Column, total: int, how: str = "left") -> DataFrame:
    """Join rows with one row per ``key`` where a few keys may hold most rows.

    Groups with more than ``total / HOT_PARTS`` rows number fewer than ``HOT_PARTS``; they are
    broadcast, and their rows stay where they are. All other keys are shuffled.
    """
    hot = groups.where(size > total // HOT_PARTS)
    cold = groups.where(size <= total // HOT_PARTS)
    mark = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    return (mark.where("__hot").drop("__hot").join(F.broadcast(hot), key, "inner")
            .unionByName(mark.where("__hot is null").drop("__hot").join(cold, key, how)))


__all__ = ["HOT_PARTS", "id_and_text", "join_groups", "new_folder", "plain_words", "stored", "text_buffers", "texts"]
