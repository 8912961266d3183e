"""Passages that repeat across documents, by level-wise doubling of window lengths.

Level one looks at windows of ``half`` words. Not every one is counted: a window of two halves is
stood for by the first smallest hash among the half windows inside it, its anchor, so equal windows have equal anchors, about one position
in thirteen. Anchors seen in two documents survive. Only windows whose anchor survived are extended to
twice the length and compared again; on later levels a window is extended if both its halves repeat. This goes on
until no candidate is left or the wanted length is reached.

A word is removed if a window of ``2 * half`` words that covers it also starts in a document
with a smaller id. Every task first compares its own windows: of equal ones only those of the smallest document are sent on, one row
with all their places. So a passage in a third of all documents sends one row per task. Documents with the same
words as one with a smaller id are settled beforehand and take no part in the windows.

Words are runs without white space, unchanged. A null text has no words. A null id counts as larger than any other; of
documents with equal ids neither counts as smaller. Windows are compared by 64-bit hashes. An empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import id_and_text, join_groups, stored, texts
from corpusloom.operators.common import mark_maybe

HALF = 25
_LAST = (1 << 63) - 1
_FLUSH_WORDS = 1 << 20
_FLUSH_ROWS = 2 << 20
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
_ROWS = pa.schema([("hash", pa.int64()), ("ord", pa.int64()), ("uid", pa.int64()), ("at", pa.list_(pa.int32())),
                   ("known", pa.bool_()), ("again", pa.bool_())])
_ROWS_DDL = "hash long, ord long, uid long, at array<int>, known boolean, again boolean"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _K1 + (b ^ (b >> _K3)) * _K2
    return h ^ (h >> _K3)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from every place on; that of 2n words is made from two of n."""
    out, n = words, 1
    for bit in bin(length)[3:]:
        if len(out) <= n:
            return out[:0]
        out, n = _mix(out[:-n], out[n:]), 2 * n
        if bit == "1":
            whole = max(len(words) - n, 0)
            out, n = _mix(out[:whole], words[n:n + whole]), n + 1
    return out


def first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of ``width`` values from every place on."""
    n = len(values) - width + 1
    best, size = np.arange(len(values)), 1
    while 2 * size <= width:
        a, b = best[:-size], best[size:]
        best, size = np.where(values[b] < values[a], b, a), 2 * size
    a, b = best[:n], best[width - size:width - size + n]
    return np.where(values[b] < values[a], b, a)


class _Buffer:
    """Candidate windows of a task. Equal ones are settled here as far as this task's own documents go."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, hashes, ords, uids, places) -> None:
        if len(hashes):
            self.parts.append((hashes.view(np.int64), ords, uids, places.astype(np.int32)))
            self.rows += len(hashes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        h, o, u, p = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.rows = [], 0
        order = np.lexsort((p, u, o, h))
        h, o, u, p = h[order], o[order], u[order], p[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        low, high = np.repeat(o[start], size), np.repeat(o[start + size - 1], size)
        first = o == low
        yield from self._rows(h[first], o[first], u[first], p[first], (high > low)[first], False)
        rest = np.flatnonzero(~first)
        rest = rest[np.lexsort((p[rest], u[rest]))]
        yield from self._rows(u[rest], np.full(len(rest), _LAST), u[rest], p[rest], np.ones(len(rest), bool), True)

    @staticmethod
    def _rows(h, o, u, p, again, known) -> Iterator[pa.RecordBatch]:
        """One row for each hash and document, with all places."""
        if not len(h):
            return
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (u[1:] != u[:-1])])
        ends = np.r_[start[1:], len(h)]
        for at in range(0, len(start), 1 << 16):
            s, e = start[at:at + (1 << 16)], ends[at:at + (1 << 16)]
            offsets = np.r_[s, e[-1]] - s[0]
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(p[s[0]:e[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(h[s]), pa.array(o[s]), pa.array(u[s]), lists,
                                              pa.array(np.full(len(s), known)), pa.array(again[s])], schema=_ROWS)


def candidates(flat: np.ndarray, ends: np.ndarray, marked: np.ndarray | None, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows to compare at ``length``.

    ``flat`` holds the words of many documents, ``ends`` the end of its own document for every word, ``marked`` the places that survived the
    level below.
    """
    if length == half:
        hashes = window_hashes(flat, half)
        places = np.unique(_anchors(hashes, ends, half))
        return places, hashes[places]
    if length > 2 * half:
        hashes = window_hashes(flat, length)
        at = np.arange(len(hashes))
        at = at[(at + length <= ends[:len(hashes)]) & marked[:len(hashes)] & marked[length // 2:length // 2 + len(hashes)]]
        return at, hashes[at]
    short = window_hashes(flat, half)
    whole = _whole(short, ends, half)
    if not len(whole):
        return whole, short[:0]
    at = whole[marked[first_smallest(short, half + 1)[whole]]]
    return at, _mix(short[at], short[at + half])


def _whole(hashes: np.ndarray, ends: np.ndarray, half: int) -> np.ndarray:
    """Places from which two halves fit into the document."""
    n = max(len(hashes) - half, 0)
    return np.flatnonzero(np.arange(n) + 2 * half <= ends[:n])


def _anchors(hashes: np.ndarray, ends: np.ndarray, half: int) -> np.ndarray:
    whole = _whole(hashes, ends, half)
    return first_smallest(hashes, half + 1)[whole] if len(whole) else whole


def _compare(length: int, half: int):
    """Rows (uid, ord, text[, at]) to candidate rows of one level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, docs, held = _Buffer(), [], 0

        def settle():
            sizes = np.array([len(d[2]) for d in docs])
            flat, ends = np.concatenate([d[2] for d in docs]), np.cumsum(sizes)
            starts = ends - sizes
            marked = None
            if length > half:
                marked = np.zeros(len(flat) + length, bool)
                marked[np.concatenate([np.asarray(d[3], np.int64) + s for d, s in zip(docs, starts)])] = True
            places, hashes = candidates(flat, np.repeat(ends, sizes), marked, length, half)
            doc = np.searchsorted(ends, places, side="right")
            buffer.add(hashes, np.array([d[1] for d in docs], np.int64)[doc], np.array([d[0] for d in docs], np.int64)[doc],
                       places - starts[doc])

        for batch in batches:
            places = batch.column(3) if length > half else [None] * batch.num_rows
            for uid, order, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), places):
                words = raw.split()
                if len(words) >= max(length, 2 * half):
                    docs.append((uid, order, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)),
                                 at.values.to_numpy() if at is not None else None))
                    held += len(words)
                    if held >= _FLUSH_WORDS:
                        settle()
                        docs, held = [], 0
                        if buffer.rows >= _FLUSH_ROWS:
                            yield from buffer.flush()
        if docs:
            settle()
        yield from buffer.flush()
    return run


def level(rows: DataFrame, length: int, half: int = HALF) -> DataFrame:
    """(uid, again, covered): places of windows that repeat in another document, and of those that do in a smaller one.

    ``rows`` has uid, ord, text, and above the first level ``at``, the places that survived the level below.
    """
    found = rows.mapInArrow(_compare(length, half), _ROWS_DDL)
    same = Window.partitionBy("hash")
    judged = found.withColumn("low", F.min("ord").over(same)).withColumn("high", F.max("ord").over(same))
    covered = F.col("known") | (F.col("ord") > F.col("low"))
    kept = judged.where(covered | F.col("again") | (F.col("high") > F.col("low")))
    return kept.groupBy("uid").agg(F.flatten(F.collect_list("at")).alias("again"),
                                   F.flatten(F.collect_list(F.when(covered, F.col("at")))).alias("covered"))


@arrow_udf(T.StringType())
def word_sequence(text: pa.Array) -> pa.Array:
    """Digest of the words in order."""
    return pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts(text)], pa.string())


def side(docs: DataFrame) -> DataFrame:
    """doc_id, uid (same for rows equal in id and text), ord (the id, null last), text."""
    return id_and_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("uid"),
                                    F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), "text")


def copies(rows: DataFrame) -> DataFrame:
    """uid of every document whose words are all those of one with a smaller id."""
    narrow = stored(rows.select("uid", "ord", word_sequence("text").alias("words")))
    groups = narrow.groupBy("words").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_groups(narrow, groups, "words", F.col("n"), narrow.count(), "inner").where("ord > first").select("uid").distinct()


def levels(docs: DataFrame, half: int = HALF, longest: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(length, stored table of ``level``) for each length, doubled until none repeats or ``longest`` is passed."""
    rows = side(docs)
    yield from _levels(rows, stored(copies(rows)), half, longest)


def _levels(rows: DataFrame, alone: DataFrame, half: int, longest: int | None) -> Iterator[tuple[int, DataFrame]]:
    length, found = half, None
    while longest is None or length <= longest:
        if found is None:
            inputs = rows.select("uid", "ord", "text")
        else:
            at = stored(found.where(F.size("again") > 0).select("uid", F.col("again").alias("at")).join(alone, "uid", "left_anti"))
            inputs = _meet(rows, at).select("uid", "ord", "text", "at")
        found = stored(level(inputs, length, half))
        yield length, found
        if found.isEmpty():
            return
        length *= 2


def _meet(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Texts with what a stored table knows of their uid; rows equal in id and text meet the same. Texts of which it certainly knows
    nothing are not moved."""
    marked = mark_maybe(rows.select("doc_id", "uid", "ord", "text"), narrow.select("uid"), ["uid"])
    return marked.where("_maybe").drop("_maybe").join(narrow, "uid")


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, longest long"


def removed_words(n: int, places: np.ndarray, length: int) -> np.ndarray:
    """True for every word that a window from one of ``places`` covers."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, places, 1)
    np.add.at(steps, places + length, -1)
    return np.cumsum(steps[:n]) > 0


def _cut(length: int, with_text: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text, pa.int64()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text, "longest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, raw, at, copy, most in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2),
                                                batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words = raw.split()
                if copy and len(words) >= length:
                    kept = []
                elif at.is_valid and len(at.values):
                    gone = removed_words(len(words), at.values.to_numpy().astype(np.int64), length)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                text = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), *[text.decode()] * with_text, most or 0))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)
    return run


def remove_repeats(docs: DataFrame, half: int = HALF, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and on request the kept words as ``kept``; last ``longest``, the
    longest doubled length at which a window of it repeats in another document that is no copy of it, 0 without any.

    All levels run, until no window repeats; what is removed follows from those of ``2 * half`` words. Texts without a mark stay where they are.
    """
    rows = side(docs)
    alone = stored(copies(rows))
    covered, repeats = None, None
    for length, found in _levels(rows, alone, half, None):
        if length == half:
            continue
        seen = found.where(F.size("again") > 0).select("uid", F.lit(length).cast("long").alias("longest"))
        repeats = seen if repeats is None else repeats.unionByName(seen)
        if length == 2 * half:
            covered = found.where(F.size("covered") > 0).select("uid", "covered")
    copied = alone.withColumn("copy", F.lit(True))
    if covered is None:
        marks = copied.select("uid", F.lit(None).cast("array<int>").alias("covered"), "copy", F.lit(0).cast("long").alias("longest"))
    else:
        marks = (repeats.groupBy("uid").agg(F.max("longest").alias("longest")).join(covered, "uid", "left")
                 .join(copied, "uid", "full").select("uid", "covered", "copy", F.coalesce("longest", F.lit(0)).alias("longest")))
    marks = stored(marks)
    marked = mark_maybe(rows.select("doc_id", "uid", "text"), marks.select("uid"), ["uid"])
    asked = marked.where("_maybe").join(marks, "uid", "left").select("doc_id", "text", "covered", "copy", "longest")
    others = marked.where("not _maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("covered"),
                                               F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("long").alias("longest"))
    schema = _RESULT if with_text else _RESULT.replace(", kept string", "")
    return asked.unionByName(others).mapInArrow(_cut(2 * half, with_text), schema)
