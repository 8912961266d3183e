"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is ten
consecutive words of an item; an item of fewer words (but not none) is one window. All windows of
all items form one automaton over normalised text, where words are joined by one space. Each text
is normalised and scanned once; matches are turned back into word positions, and, on request, into
character offsets of the original text.

Null texts have no words. Items with null text or no words have no window. Hits of an item with a
null ``item_id`` count as hits but not as an item. Repeated items with one id count once. An empty
benchmark leaves every document clean.

The items are a stated query set: they are collected and sent to every task, in blocks of at most
``block_bytes`` of text, one pass over the texts for each block (one block for any usual benchmark).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import id_and_text, plain_words, texts

WINDOW = 10
BLOCK_BYTES = 8 << 20
_BUILT: dict = {}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))]))


def item_windows(items: list[tuple[int | None, str]], window: int = WINDOW) -> dict[bytes, tuple[int, frozenset]]:
    """Each distinct window in normalised form: its number of words and the ids of its items."""
    found: dict[bytes, tuple[int, set]] = {}
    for item, text in items:
        words = plain_words((text or "").encode())
        if words:
            n = min(window, len(words))
            for i in range(len(words) - n + 1):
                found.setdefault(b" ".join(words[i:i + n]), (n, set()))[1].add(item)
    return {w: (n, frozenset(ids)) for w, (n, ids) in found.items()}


def automaton(items: list, window: int):
    """The automaton of a block, built once in each Python worker; None if there is no window."""
    import ahocorasick

    key = (hash(tuple(items)), len(items), window)
    if key not in _BUILT:
        _BUILT.clear()
        tree = ahocorasick.Automaton()
        for text, (n, ids) in item_windows(items, window).items():
            # Latin-1 keeps one character per byte, so offsets are byte offsets.
            spaced = " " + text.decode("latin-1") + " "
            tree.add_word(spaced, (n, len(spaced), ids))
        if len(tree):
            tree.make_automaton()
        _BUILT[key] = tree if len(tree) else None
    return _BUILT[key]


def scan(words: list[bytes], tree) -> list[tuple[int, int, frozenset]]:
    """(first word, number of words, item ids) of each occurrence."""
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    ends = [(end, hit) for end, hit in tree.iter(line)]
    if not ends:
        return []
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    return [(int(np.searchsorted(starts, end + 1 - size)), n, ids) for end, (n, size, ids) in ends]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[list[tuple]]:
    """Distinct items in blocks of bounded size. Items stream to the driver one partition at a time."""
    out, size = [[]], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    for row in items.toLocalIterator():
        if out[-1] and size + len(row.text) > block_bytes:
            out.append([])
            size = 0
        out[-1].append((row.item_id, row.text))
        size += len(row.text)
    return [sorted(b, key=lambda r: (r[0] is None, r[0] or 0, r[1])) for b in out]


def _scanner(items: list, window: int):
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = automaton(items, window)
        for batch in batches:
            n_words, spans = [], []
            for raw in texts(batch):
                words = plain_words(raw)
                n_words.append(len(words))
                spans.append([{"start": s, "n": n, "items": sorted(i for i in ids if i is not None)}
                              for s, n, ids in (scan(words, tree) if tree is not None and words else [])])
            yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, _SPANS)], ["n_words", "spans"])
    return arrow_udf(found, "struct<n_words:bigint,spans:array<struct<start:bigint,n:bigint,items:array<bigint>>>>")


def with_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``__scan``: n_words and the occurrences (first word, words, item ids). Rows do not move."""
    out, names = docs, []
    for i, items in enumerate(blocks(benchmark, block_bytes)):
        out = out.withColumn(f"__scan{i}", _scanner(items, window)(F.coalesce(F.col("text"), F.lit(""))))
        names.append(f"__scan{i}")
    spans = F.flatten(F.array(*[F.col(n)["spans"] for n in names]))
    return out.withColumn("__scan", F.struct(F.col(names[0])["n_words"].alias("n_words"), spans.alias("spans"))).drop(*names)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    scanned = with_spans(id_and_text(docs), benchmark, window).select("doc_id", "__scan.*")
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("spans", lambda s: s["items"]))),
                                     lambda i: i.cast("string")))
    return scanned.select(
        "doc_id", "n_words", _union_length(F.col("spans")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def _union_length(spans):
    """Words covered by spans of any order and length."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["n"]).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at"))
    return F.aggregate(
        ordered, start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["at"]))).alias("n"),
                                F.greatest(acc["at"], s["b"]).alias("at")),
        lambda acc: acc["n"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns."""
    rows = docs.select(F.struct("*").alias("doc"), "text")
    return with_spans(rows, benchmark, window).where(F.size("__scan.spans") == 0).select("doc.*")


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of (first word, number of words)."""
    import re

    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(at[s][0], at[s + n - 1][1]) for s, n in spans]

