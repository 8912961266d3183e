"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line is described by its own make-up (kinds of characters, words that
follow themselves, distinct words, length, whether it stood before in the text) and by that of the lines before and
after it; a transition weight joins neighbouring labels. Training takes a document's label for all its lines and maximises the
likelihood of the label sequences. A document's score is the mean of the forward-backward marginals of ``good``,
weighted by line length, over the whole text.

Only the text is an input. The model is fitted on at most ``train_docs`` labelled documents of at most ``train_lines``
lines, the first by a hash of their id, never on held-out ones (crc32 of the id as text, modulo 3, is 1). Labels are
joined by id; of several for one id the largest counts, null ones are left out. Without
labels of both kinds all scores are 0.5. Null and empty texts are one empty line. Repeated rows and null ids are scored like others; a
document without an id is not held out and never trained on. An empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from corpusloom.llm.base import id_and_text, texts

TRAIN_DOCS = 4000
TRAIN_LINES = 300
STEPS = 300
RATE = 0.05
PENALTY = 1e-3
_CLASSES = [bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b" \t\r\x0b\x0c", b".,;:?'\"()-", b"|", b"!",
            bytes(b for b in range(0x21, 0x7F) if chr(b) in "#$%&*+/<=>@[\\]^_`{}~"), bytes(range(0x80, 0x100))]
_OWN = 1 + 1 + len(_CLASSES) + 5


def line_features(lines: list[bytes]) -> np.ndarray:
    """A row of numbers between 0 and about 1 for every line."""
    out, seen = np.zeros((len(lines), _OWN), np.float32), set()
    for row, line in zip(out, lines):
        n = len(line)
        words = line.split()
        m = len(words)
        row[0] = 1
        row[1] = np.log1p(n) / 8
        if n:
            row[2:10] = [(n - len(line.translate(None, c))) / n for c in _CLASSES]
        if m:
            row[10] = sum(map(bytes.__eq__, words, words[1:])) / m
            row[11] = 1 - len(set(words)) / m
            row[12] = min(n / m / 20, 2)
        row[13] = m == 0
        row[14] = n > 20 and line in seen
        seen.add(line)
    out[:, 2:12] = np.sqrt(out[:, 2:12])
    return out


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Own features, and those of the line before and after in the same document (0 at its ends)."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts] = 0
    after[np.r_[starts[1:], len(own)] - 1] = 0
    return np.hstack([own, before, after])


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


@dataclass
class Chain:
    """Documents as runs of lines, in order of falling length; the first ``active[t]`` have more than t lines."""

    starts: np.ndarray
    sizes: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(-self.sizes, kind="stable")
        self.first = self.starts[self.order]
        size = self.sizes[self.order]
        self.active = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]) + 1)] if len(size) else [0]
        self.last = self.first + size - 1

    def messages(self, e: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good: from the lines up to each one, and from the lines after it."""
        forward, backward = e.copy(), np.zeros_like(e)
        for t in range(1, len(self.active)):
            at = self.first[:self.active[t]] + t
            r = forward[at - 1]
            forward[at] += np.logaddexp(psi[0, 1], r + psi[1, 1]) - np.logaddexp(psi[0, 0], r + psi[1, 0])
        for t in range(len(self.active) - 2, -1, -1):
            at = self.first[:self.active[t + 1]] + t
            s = e[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(psi[1, 0], psi[1, 1] + s) - np.logaddexp(psi[0, 0], psi[0, 1] + s)
        return forward, backward


def chain_of(sizes: np.ndarray) -> Chain:
    return Chain(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Model:
    weights: np.ndarray
    psi: np.ndarray

    def marginals(self, features: np.ndarray, chain: Chain) -> np.ndarray:
        forward, backward = chain.messages(features @ self.weights, self.psi)
        return 1 / (1 + np.exp(-(forward + backward)))


def fit(features: np.ndarray, sizes: np.ndarray, good: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam on the exact gradient."""
    chain = chain_of(sizes)
    y = np.repeat(good.astype(float), sizes)
    inner = np.ones(len(y), bool)
    inner[chain.starts + sizes - 1] = False
    at = np.flatnonzero(inner)
    n, k = features.shape
    theta = np.zeros(k + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at].astype(int), y[at + 1].astype(int)), 1)
    for step in range(1, steps + 1):
        w, psi = theta[:k], theta[k:].reshape(2, 2)
        e = features @ w
        forward, backward = chain.messages(e, psi)
        p = 1 / (1 + np.exp(-(forward + backward)))
        tail = e[at + 1] + backward[at + 1]
        logs = np.stack([np.zeros(len(at)) + psi[0, 0], psi[0, 1] + tail, forward[at] + psi[1, 0], forward[at] + psi[1, 1] + tail])
        pairs = np.exp(logs - np.logaddexp.reduce(logs, axis=0)).sum(axis=1).reshape(2, 2)
        gradient = np.r_[features.T @ (y - p), (seen - pairs).ravel()] / len(sizes) - PENALTY * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient ** 2
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(theta[:k], theta[k:].reshape(2, 2))


def _own_features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features of all lines of some texts, lines of each, and lengths of the lines in bytes, plus one."""
    lines = [split_lines(t) for t in raw]
    own = np.concatenate([line_features(x) for x in lines])
    return own, np.array([len(x) for x in lines]), np.array([len(line) + 1.0 for x in lines for line in x])


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, sizes, weight = _own_features(raw)
    return with_neighbours(own, np.cumsum(sizes) - sizes), sizes, weight


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> Model | None:
    """Model from a bounded sample of labelled documents; None without labels of both kinds.

    An id on several rows gives one document, the text with the least hash. What reaches the driver are the lines' own features, at
    most ``train_docs * train_lines`` rows of 60 bytes.
    """
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = list(texts(batch.column(1)))
            short = pa.array([raw.count(b"\n") < train_lines for raw in every], pa.bool_())
            batch, raw = batch.filter(short), [x for x, ok in zip(every, short.to_pylist()) if ok]
            if raw:
                rows, sizes, _ = _own_features(raw)
                cuts = np.cumsum(sizes)[:-1]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "quality": batch.column(2),
                    "rows": pa.array([x.astype("<f4").tobytes() for x in np.split(rows, cuts)], pa.binary())})
    sample = (id_and_text(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality")
              .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "t.text", "quality"))
    got = sorted(sample.mapInArrow(describe, "doc_id long, quality int, rows binary").collect(), key=lambda r: r.doc_id)
    good = np.array([r.quality > 0 for r in got])
    if not len(got) or good.all() or not good.any():
        return None
    rows = [np.frombuffer(r.rows, "<f4").reshape(-1, _OWN) for r in got]
    sizes = np.array([len(r) for r in rows])
    return fit(with_neighbours(np.concatenate(rows), np.cumsum(sizes) - sizes).astype(float), sizes, good)


def scorer(model: Model | None):
    """Column function: text to score between 0 and 1."""
    def score(text: pa.Array) -> pa.Array:
        raw = list(texts(text))
        out = np.full(len(raw), 0.5)
        if model is not None:
            for at in range(0, len(raw), 512):
                rows, sizes, weight = _features(raw[at:at + 512])
                chain = chain_of(sizes)
                good = model.marginals(rows, chain) * weight
                out[at:at + 512] = np.add.reduceat(good, chain.starts) / np.add.reduceat(weight, chain.starts)
        return pa.array(np.clip(out, 0, 1))
    return arrow_udf(score, "double")


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    score = scorer(train(docs, labels, **options))
    return (id_and_text(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents with a score of at least 0.5, with all their columns. Rows do not move."""
    score = scorer(train(docs, labels, **options))
    rows = docs.select(F.struct("*").alias("doc"), score(F.coalesce(F.col("text"), F.lit(""))).alias("score"))
    return rows.where("score >= 0.5").select("doc.*")
