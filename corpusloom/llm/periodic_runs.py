"""Periodic runs of words, found with a dictionary of basic factors.

Words are separated by white space. A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(SHORTEST, REPEATS * q)`` words that no neighbouring word extends keeping period ``q``.

For every power of two ``L`` the factors of ``L`` words get names, each made from the names of its two halves. A
factor's next occurrence within ``2 * L`` words proposes a period; neighbouring places with the same period form one stretch, an
arithmetic progression of occurrences, which is extended word by word and kept once. Nothing is missed: take a run with
period ``q`` and the ``L`` with ``L / 2 < q <= L``. A factor of ``L`` words at its start recurs ``q`` words later, and not earlier,
since two periods on ``L + q`` words would give the run a smaller one. For the same reason a proposed period is the smallest
of its stretch. Levels end as soon as no factor is repeated.

A text is worked on inside its row, in time and memory of its words times the logarithm of their number; nothing is shuffled. A null or
empty text has no words and no runs; a null ``doc_id`` stays null; repeated rows give equal rows, an empty table none.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.base import id_and_text, texts

SHORTEST = 24
REPEATS = 3
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SPACES = r"[\x20\x09-\x0D]+"


def numbered(words: list[bytes]) -> list[int]:
    """Each word's number; equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def runs(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n, size, found = len(word), 1, set()
    key = np.array(word, dtype=np.int64)
    while n >= SHORTEST and REPEATS * (size // 2 + 1) <= n:
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        same = in_order[1:] == in_order[:-1]
        if not same.any():
            break
        step = np.diff(order)
        near = same & (step <= 2 * size)
        found |= _extended(word, order[:-1][near], step[near], size)
        name = np.empty(len(key), np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        key = name[:-size] * np.int64(len(key)) + name[size:]
        size *= 2
    return sorted((s, e - s, p) for s, e, p in found if e - s >= max(SHORTEST, REPEATS * p))


def _extended(word: list[int], place: np.ndarray, period: np.ndarray, size: int) -> set[tuple[int, int, int]]:
    """(start, end, period) of the stretches: neighbouring places with one period, as far as that period holds."""
    if not len(place):
        return set()
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(place) != 1) | (np.diff(period) != 0)]))
    last = np.append(first[1:], len(place)) - 1
    out, n, done, of = set(), len(word), 0, 0
    for start, end, p in zip(place[first].tolist(), (place[last] + size + period[last]).tolist(), period[first].tolist()):
        if p == of and end <= done:
            continue
        while start and word[start - 1] == word[start - 1 + p]:
            start -= 1
        while end < n and word[end] == word[end - p]:
            end += 1
        out.add((start, end, p))
        done, of = end, p
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that any run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in found:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, kept = [], []
        for raw in texts(batch.column(1)):
            words = raw.split()
            got = runs(numbered(words))
            spans.append([dict(zip(("start", "length", "period"), r)) for r in got])
            kept.append(b" ".join(collapsed(words, got)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
            ["doc_id", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """Per document doc_id, ``runs`` (start, length, period, by start and period) and ``collapsed``: the kept words, one space between."""
    return id_and_text(docs).mapInArrow(
        _find, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The texts with a run made in every tenth document: its words from one place on repeat.

    h is the CRC-32 of the decimal ``doc_id``, g = h div 10. If h mod 10 is 0, word i >= a becomes word a + (i - a) mod p with
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). A null id has no h and its text stays.
    """
    rows = id_and_text(docs).withColumn("_h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    made = rows.withColumn("_w", F.when(F.col("_h") % 10 == 0, F.filter(F.split("text", SPACES), lambda w: w != "")))
    made = made.withColumns({"_n": F.size("_w").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    made = made.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    made = made.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("array_join(transform(_w, (w, i) -> _w[cast(if(i < _a, i, _a + (i - _a) % _p) as int)]), ' ')")
    return made.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def strongest(found: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first by start and period. Null without runs."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: number of runs, its strongest run, digests of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = find(docs).withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
