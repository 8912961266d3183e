"""Packing of token ids into sequences by best-fit decreasing.

Documents are tokenised and closed with an end id. One longer than a sequence is first cut into
full windows; what is left over is a piece like any shorter document. Pieces are dealt at random
into groups of bounded size, and each group is packed by itself: pieces in falling order of length, each into the open
sequence with the least room that still holds it. The open sequences are counted by remaining room
at the leaves of a segment tree, where the tightest one is found in a logarithmic number of steps.
A group leaves at most a few sequences part filled, so padding does not depend on the number of groups.

A null or empty text is the end id alone. Null ids and repeated rows are documents like any other.
An empty table gives no rows. Every id of every text is in one piece.
"""

import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import id_and_text, stored, texts

SEQUENCE = 2048
GROUP_DOCS = 16384
END_ID = 1
# Words remembered by a Python worker, about 180 bytes each; the worker keeps them as long as it lives, also through other stages.
CACHE_WORDS = 250_000
_TOKENIZERS: dict = {}


class _Numbers(dict):
    """Words to running numbers; new ones wait in ``new``."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class WordIds:
    """Ids of whole texts by way of their words, each encoded once while it is remembered.

    White space always ends a token of this vocabulary, so a text's ids are those of its words in
    a row. Words of letters and closing marks are encoded many in one call and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.ids, self.starts, self.sizes = _Numbers(), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _together(self, words: list[str], closings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that have ``closings`` ids that end something, many words in one text."""
        parts, steps = [], range(0, len(words), 256)
        lines = self.tokenizer.encode_batch_fast([" ".join(words[i:i + 256]) for i in steps], add_special_tokens=False)
        for i, line in zip(steps, lines):
            ids = np.array(line.ids, "<u4")
            ends, wanted = np.flatnonzero(self.closing[ids]) + 1, np.cumsum(closings[i:i + 256])
            # Otherwise there is a letter whose lower case is no letter.
            parts.append((ids, np.diff(ends[wanted - 1], prepend=0)) if len(ends) == wanted[-1] else self._encode(words[i:i + 256]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _learn(self) -> None:
        new = [w.decode() for w in self.numbers.new]
        self.numbers.new.clear()
        if not new:
            return
        cores = [w.rstrip(string.punctuation) for w in new]
        simple = np.fromiter(map(str.isalpha, cores), bool, len(new))
        order = np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]
        empty = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        closings = np.array([1 + (c != w) for c, w in zip(cores, new)])[simple]
        ids, sizes = (self._together([new[k] for k in order[:len(closings)]], closings) if len(closings) else empty)
        more, others = (self._encode([new[k] for k in order[len(closings):]]) if len(closings) < len(new) else empty)
        sizes, starts = np.r_[sizes, others], np.zeros(len(new), np.int64)
        starts[order] = len(self.ids) + np.cumsum(sizes) - sizes
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, sizes[np.argsort(order)]])
        self.ids = np.concatenate([self.ids, ids, more])

    def batch(self, raw: list[bytes], step: int = 256) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for i in range(0, len(raw), step):
            if len(self.numbers) > CACHE_WORDS:
                self._forget()
            numbers = []
            for text in raw[i:i + step]:
                words = text.lower().split()
                numbers.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            self._learn()
            for n in numbers:
                sizes = self.sizes[n]
                ends = np.cumsum(sizes)
                shift = np.repeat(self.starts[n] - ends + sizes, sizes)
                yield self.ids[shift + np.arange(len(shift))].tobytes()


def word_ids(path: str) -> WordIds:
    """The tokenizer of a vocabulary file, loaded once in each Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, and on request its ids as binary."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_ids(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in names]
                for doc, ids in zip(part.column(0).to_pylist(), tokens.batch(list(texts(part.column(1))))):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, sequence):
                        piece = ids[4 * start:4 * (start + sequence)]
                        for values, v in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n, piece)):
                            values.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)
    return id_and_text(docs).mapInArrow(cut, schema)


class RoomTree:
    """Open sequences by remaining room, at the leaves of a segment tree of counts."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.held: list[list[int]] = [[] for _ in range(self.width)]

    def add(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, room: int) -> tuple[int, int] | None:
        """(sequence, its room) of an open sequence with the least room of at least ``room``."""
        node = room + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up, until the right neighbour has one
                node >>= 1
            if node == 1:
                return None
            node += 1
        while node < self.width:
            node *= 2
            if not self.count[node]:
                node += 1
        found = node - self.width
        self._change(found, -1)
        return self.held[found].pop(), found


def best_fit(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(sequence number, offset) of each piece, pieces taken in falling order of length."""
    tree, used = RoomTree(sequence), 0
    out = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        number, room = tree.take(lengths[i]) or (used, sequence)
        used = max(used, number + 1)
        out[i] = (number, sequence - room)
        if room > lengths[i]:
            tree.add(room - lengths[i], number)
    return out


def pack(cut: DataFrame, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Add sequence_id and offset to ``pieces``.

    The pieces are stored once. Groups hold about ``group_docs`` pieces each, dealt by a hash of the
    stored row's number, so no document or copy can fill one. ``sequence_id`` has the group in its upper half.
    """
    numbered = stored(cut.withColumn("__row", F.monotonically_increasing_id()))
    groups = numbered.count() // group_docs + 1
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"

    def fit(table: pa.Table) -> pa.Table:
        # Only numbers are sorted; the pieces, which may carry their ids, stay as they came.
        lengths, row = table.column("length").to_numpy(), table.column("__row").to_numpy()
        order = np.lexsort((row, -lengths))
        group = table.column("__group")[0].as_py()
        at = np.empty((len(order), 2), np.int64)
        at[order] = best_fit(lengths[order].tolist(), sequence)
        return (table.drop_columns(["__row", "__group"])
                .append_column("sequence_id", pa.array((group << 32) + at[:, 0], pa.int64()))
                .append_column("offset", pa.array(at[:, 1], pa.int64())))
    dealt = numbered.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(fit, schema)


def sequences(packed: DataFrame, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """Packed pieces with their ids as rows of training input: sequence_id, ids (padded), doc_ids, offsets."""
    held = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    pad = np.array([pad_id], "<u4").tobytes().hex().upper()
    return held.select("sequence_id", F.unhex(F.rpad(ids, 8 * sequence, pad)).alias("ids"),
                       F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
