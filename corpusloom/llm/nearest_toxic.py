"""Toxicity by the nearest labelled examples.

A text is a bag of terms: its lower-cased words and their beginnings of ``PREFIXES`` bytes, so that inflected forms meet. Terms that
labelled examples use more often when toxic than chance explains make the vocabulary; a text is its TF-IDF vector
over it. The ``k`` examples with the highest cosine vote, each with weight 1 / (distance + ``NEAR``), and an isotonic curve
fitted on votes that leave the example itself out turns the vote into a share of toxic documents. The neighbours are the evidence.

Search is exact. Examples lie in blocks of ``BLOCK``, alike ones together; every term has the largest weight of each block
beside its postings. The sum of those bounds a block's scores: blocks are scored from the highest bound down, until the next
bound is below the ``k``-th best score, and all others are skipped. Equal scores go by the example's ``doc_id``.

Bounded: at most ``EXAMPLES`` labelled documents of each class, chosen by a hash of the id, are examples, of at most
``MOST_TERMS`` terms; class weights put back the shares among all labelled documents. Document frequencies are
counted over all documents. A label counts if it is 0 or 1, the larger of repeated ones; an id on several rows gives
one example, the text with the least hash. Labels of ids with crc32(id) mod 5 = 0 are not read.

A null text is empty. A text without a term of the vocabulary gets the share of toxic ones among such examples. Without labels
of both classes every score is the share of toxic labels (0 without any). A null ``doc_id`` stays null and is not held out.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.base import id_and_text, plain_words, stored, texts

EXAMPLES = (4096, 2048)  # documents of class 0 and 1
MOST_TERMS = 1024
CANDIDATES = 8192
PREFIXES = range(3, 9)
FEWEST = 3
BLOCK = 32
K = 15
NEAR = 0.05
_END = b"\x00"  # marks a whole word; no word holds it
_MEMO = 300_000


def words(text: bytes) -> list[bytes]:
    return plain_words(text.decode("utf-8", "replace").lower().encode())


def terms_of(word: bytes) -> list[bytes]:
    return [word + _END, *[word[:n] for n in PREFIXES if n < len(word)]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Vocabulary:
    """Numbers of the chosen terms; a word's terms are looked up once."""

    def __init__(self, terms: list[bytes]):
        self.number, self.memo = {t: i for i, t in enumerate(terms)}, {}

    def __getstate__(self):
        return {"number": self.number, "memo": {}}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            got = self.memo[word] = tuple(self.number[t] for t in terms_of(word) if t in self.number)
        return got

    def counts(self, text: bytes) -> dict[int, int]:
        """Occurrences of every chosen term."""
        out: dict[int, int] = {}
        for word, n in Counter(words(text)).items():
            for t in self.of_word(word):
                out[t] = out.get(t, 0) + n
        return out


def _vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and weights of length one."""
    ids = np.array(sorted(counts), np.int64)
    w = (1 + np.log(np.array([counts[i] for i in ids.tolist()], float))) * idf[ids]
    return ids, w / (math.sqrt(float(w @ w)) or 1.0)


@dataclass
class BlockMaxIndex:
    """Examples as inverted lists in blocks, with the largest weight of every term in each block."""

    doc_id: np.ndarray
    label: np.ndarray
    terms: int
    bound_at: np.ndarray = field(default=None)     # per term, its slice of bound_block and bound_most
    bound_block: np.ndarray = field(default=None)
    bound_most: np.ndarray = field(default=None)
    blocks: list = field(default_factory=list)     # per block: its terms, their slices, places in the block, weights

    @staticmethod
    def build(examples: list[tuple[int, int, np.ndarray, np.ndarray]], terms: int) -> "BlockMaxIndex":
        """From (doc_id, label, term numbers, weights) of examples that have terms."""
        alike = sorted(examples, key=lambda e: (int(e[2][np.argmax(e[3])]), e[1], -float(e[3].max()), e[0]))
        index = BlockMaxIndex(np.array([e[0] for e in alike], np.int64), np.array([e[1] for e in alike], np.int64), terms)
        place = np.repeat(np.arange(len(alike)), [len(e[2]) for e in alike])
        term = np.concatenate([e[2] for e in alike]) if alike else np.zeros(0, np.int64)
        weight = np.concatenate([e[3] for e in alike]) if alike else np.zeros(0)
        block, bounds = place // BLOCK, []
        for b in range(-(-len(alike) // BLOCK)):
            mine = np.flatnonzero(block == b)
            mine = mine[np.argsort(term[mine], kind="stable")]
            own, first = np.unique(term[mine], return_index=True)
            index.blocks.append((own, np.append(first, len(mine)), place[mine] - b * BLOCK, weight[mine]))
            bounds.append((own, np.full(len(own), b), np.maximum.reduceat(weight[mine], first)))
        if bounds:
            of, at, most = (np.concatenate(x) for x in zip(*bounds))
            order = np.argsort(of, kind="stable")
            of, index.bound_block, index.bound_most = of[order], at[order], most[order]
        else:
            of, index.bound_block, index.bound_most = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        index.bound_at = np.searchsorted(of, np.arange(terms + 1))
        return index

    def search(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and cosines of the ``k`` nearest examples, best first, and the number of blocks that were scored."""
        at, of = _entries(self.bound_at[ids], self.bound_at[ids + 1])
        bound = np.bincount(self.bound_block[at], weights=self.bound_most[at] * weights[of], minlength=len(self.blocks))
        order = np.argsort(-bound, kind="stable")
        places, cosines, seen = np.zeros(0, np.int64), np.zeros(0), 0
        for b in order[:np.count_nonzero(bound > 0)].tolist():
            # Rounded cosines decide, so a bound that only rounds to the k-th best is still looked at.
            if len(cosines) == k and bound[b] < cosines[-1] - 1e-8:
                break
            seen += 1
            own, slices, inside, held = self.blocks[b]
            hit = np.searchsorted(own, ids)
            ok = (hit < len(own)) & (own[np.minimum(hit, len(own) - 1)] == ids)
            at, of = _entries(slices[hit[ok]], slices[hit[ok] + 1])
            score = np.round(np.bincount(inside[at], weights=held[at] * weights[ok][of], minlength=BLOCK), 9)
            got = np.flatnonzero(score > 0)
            got = got[got + b * BLOCK != without]
            places, cosines = np.append(places, got + b * BLOCK), np.append(cosines, score[got])
            keep = np.lexsort((places, self.doc_id[places], -cosines))[:k]
            places, cosines = places[keep], cosines[keep]
        return places, cosines, seen


def _entries(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the slices first:last, and which slice each belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    class_weight: np.ndarray
    share: float        # of toxic documents among all labelled ones
    without: float      # score of a text without a known term
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        y = self.index.label[places]
        w = self.class_weight[y] / (np.maximum(1 - cosines, 0) + NEAR)
        return float((w @ y + self.share) / (w.sum() + 1))

    def calibrated(self, vote: float) -> float:
        """The curve is flat in places; a fiftieth of the vote itself keeps their order."""
        return min(1.0, max(0.0, 0.98 * float(np.interp(vote, *self.curve)) + 0.02 * vote))

    def score(self, text: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        counts = self.vocabulary.counts(text)
        places, cosines = np.zeros(0, np.int64), np.zeros(0)
        if counts:
            places, cosines, _ = self.index.search(*_vector(counts, self.idf), K)
        return (self.calibrated(self.vote(places, cosines)) if len(places) else self.without), places, cosines


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the weighted least-squares increasing curve, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for at in np.unique(x):
        m = x == at
        pools.append([float(w[m] @ y[m]), float(w[m].sum()), float(at), float(at)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    return (np.array([v for p in pools for v in (p[2], p[3])]), np.array([p[0] / p[1] for p in pools for _ in (0, 1)]))


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for label, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            seen[label].update({t for w in set(words(raw)) for t in terms_of(w)})
    every = list(seen[0].keys() | seen[1].keys())
    for lo in range(0, len(every), 100_000):
        part = every[lo:lo + 100_000]
        yield pa.RecordBatch.from_pydict({"term": pa.array(part, pa.binary()), **{
            name: pa.array([seen[c][t] for t in part], pa.int64()) for name, c in (("clean", 0), ("toxic", 1))}})


def _frequencies(vocabulary: Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(vocabulary.number) + 1, np.int64), 0
        for batch in batches:
            for raw in texts(batch.column(0)):
                rows += 1
                df[list({t for w in set(words(raw)) for t in vocabulary.of_word(w)})] += 1
        df[-1] = rows
        yield pa.RecordBatch.from_pydict({"n": np.arange(len(df)), "df": df})

    return count


def _counted(vocabulary: Vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(vocabulary.counts(raw).items()) for raw in texts(batch.column(2))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "label": batch.column(1),
                "ids": pa.array([[i for i, _ in h] for h in held], pa.list_(pa.int64())),
                "n": pa.array([[n for _, n in h] for h in held], pa.list_(pa.int64()))})

    return count


def choose_terms(sample: DataFrame, sizes: list[int], most: int = MOST_TERMS) -> list[bytes]:
    """Terms that the toxic examples hold more often than chance explains.

    With share p of toxic examples, a term in n examples, a of them toxic, has a chance of at most exp(-n KL(a/n, p)); it is
    chosen if that is below one in the number of terms, so about one term is chosen wrongly.
    """
    got = stored(sample.select("label", "text").mapInArrow(_class_counts, "term binary, clean long, toxic long")
                 .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    p = sizes[1] / sum(sizes)
    n, a = F.col("clean") + F.col("toxic"), F.col("toxic") / (F.col("clean") + F.col("toxic"))
    rest = F.when(a < 1, (1 - a) * F.ln((1 - a) / (1 - p))).otherwise(0.0)
    odd = got.where((F.col("toxic") >= FEWEST) & (a > p)).select("term", (n * (a * F.ln(a / p) + rest)).alias("odd"))
    best = odd.orderBy(F.col("odd").desc(), "term").limit(CANDIDATES).collect()
    least = math.log(max(1, got.count()))
    return [bytes(r["term"]) for r in best if r["odd"] > least][:most]


def fit(docs: DataFrame, labels: DataFrame, examples: tuple[int, int] = EXAMPLES) -> Model:
    """The model, from labels of ids that are not held out."""
    rows = id_and_text(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = dict(known.groupBy("label").count().collect())
    n = [total.get(c, 0) for c in (0, 1)]
    share = n[1] / max(1, sum(n))
    spark = docs.sparkSession
    chosen = [r for c in (0, 1) for r in known.where(F.col("label") == c)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples[c]).collect()]
    ids = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))
    sample = stored(rows.join(ids, "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", "t.text"))
    held = dict(sample.groupBy("label").count().collect())
    sizes = [held.get(c, 0) for c in (0, 1)]
    terms = choose_terms(sample, sizes) if min(sizes) else []
    vocabulary = Vocabulary(terms)
    empty = BlockMaxIndex.build([], len(terms))
    if not terms:
        return Model(vocabulary, np.zeros(0), empty, np.ones(2), share, share)
    counted = dict(rows.select("text").mapInArrow(_frequencies(vocabulary), "n long, df long")
                   .groupBy("n").agg(F.sum("df")).collect())
    idf = np.log(1 + counted[len(terms)] / np.maximum(1, [counted[i] for i in range(len(terms))]))
    got = sample.mapInArrow(_counted(vocabulary), "doc_id long, label int, ids array<long>, n array<long>").collect()
    vectors = [(r["doc_id"], r["label"], *_vector(dict(zip(r["ids"], r["n"])), idf)) for r in got if r["ids"]]
    weight = np.array([n[c] / sum(n) / (sizes[c] / sum(sizes)) for c in (0, 1)])
    bare = np.array([sizes[c] - sum(v[1] == c for v in vectors) for c in (0, 1)]) * weight
    model = Model(vocabulary, idf, BlockMaxIndex.build(vectors, len(terms)), weight, share,
                  float((bare[1] + share) / (bare.sum() + 1)))
    place = {d: i for i, d in enumerate(model.index.doc_id.tolist())}
    votes = np.array([model.vote(*model.index.search(ids, w, K, place[d])[:2]) for d, _, ids, w in vectors])
    y = np.array([v[1] for v in vectors])
    model.curve = isotonic(votes, y.astype(float), weight[y])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row doc_id, held_out, score, predicted and ``evidence``: the neighbours with similarity and label, nearest first."""
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = [], []
            for raw in texts(batch.column(1)):
                s, places, cosines = model.score(raw)
                scores.append(s)
                evidence.append([{"doc_id": d, "similarity": c, "toxic": t} for d, c, t in zip(
                    model.index.doc_id[places].tolist(), cosines.tolist(), model.index.label[places].tolist())])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(scores, pa.float64()),
                                              "evidence": pa.array(evidence, kind)})

    got = id_and_text(docs).mapInArrow(
        run, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
