"""Exact top-k search that skips blocks which cannot hold a hit.

The corpus is stored as blocks, one row each: some chunks' postings with the highest count and least length of every term, or some vectors that
lie close together with their centre and radius. Both give a bound on the score of anything in the block. A first pass has
every task score the most promising block of each question and return one number, its k-th best score; the best of these is a threshold
that no task has to go below. The second pass skips all blocks whose bound is worse, and returns only hits that reach the
threshold, far fewer than k rows for each task and question. Results are those of ``bm25_hits`` and ``vector_hits``.

Blocks are made inside the tasks, from rows as they lie (chunks of one document follow each other) or sorted by cell.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions import rules
from corpusloom.operators.common import top_k
from corpusloom.operators.index import corpus_stats, term_weights
from corpusloom.operators.search_tasks import VECTOR_BLOCK, Best, query_terms, question_blocks, rounded_array, unit_rows, weigh

CHUNKS_IN_BLOCK = 128
VECTORS_IN_BLOCK = 256
CELLS = 256
# Vectors that centres are fitted on. They decide how tight blocks are, and never which hits are found.
FIT_VECTORS = 20_000
_SLACK = 2e-6  # scores are rounded to six digits

KEYWORD_BLOCK = ("chunk_ids array<string>, dl array<bigint>, terms array<string>, most array<bigint>, least_dl array<bigint>, "
                 "starts array<int>, member array<int>, tf array<bigint>")
VECTOR_BLOCK_ROW = "chunk_ids array<string>, vectors array<double>, centre array<double>, radius double"


def keyword_blocks(forward: DataFrame, size: int = CHUNKS_IN_BLOCK) -> DataFrame:
    """Blocks of ``size`` neighbouring rows of a forward index (chunk_id, dl, terms, counts). Store them as ``wide``."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                rows = batch.slice(lo, size)
                ids, dl = rows.column(0), rows.column(1).to_numpy()
                lengths = rows.column(2).value_lengths().to_numpy()
                words = rows.column(2).flatten().dictionary_encode()
                tf = rows.column(3).flatten().to_numpy()
                member = np.repeat(np.arange(len(ids)), lengths)
                by = np.argsort(words.indices.to_numpy(), kind="stable")
                code, starts = np.unique(words.indices.to_numpy()[by], return_index=True)
                yield pa.RecordBatch.from_pydict({
                    "chunk_ids": [ids], "dl": [dl], "terms": [words.dictionary.take(pa.array(code))],
                    "most": [np.maximum.reduceat(tf[by], starts)], "least_dl": [np.minimum.reduceat(dl[member[by]], starts)],
                    "starts": [np.append(starts, len(by)).astype(np.int32)], "member": [member[by].astype(np.int32)], "tf": [tf[by]]},
                    schema=_arrow(KEYWORD_BLOCK))

    return forward.select("chunk_id", "dl", "terms", "counts").mapInArrow(build, KEYWORD_BLOCK)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = []
    for part in ddl.split(", "):
        name, kind = part.split(" ")
        fields.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(fields)


class _KeywordBlocks:
    """Bounds and scores of keyword blocks for weighted questions (question, term, w)."""

    def __init__(self, weighted: pa.Table, avgdl: float):
        self.qids = weighted.column("question_id").unique().to_pylist()
        self.terms = weighted.column("term").unique()
        question = pc.index_in(weighted.column("question_id"), pa.array(self.qids, pa.string())).to_numpy()
        term = pc.index_in(weighted.column("term"), self.terms).to_numpy()
        order = np.argsort(term, kind="stable")
        self.question, self.w = question[order], weighted.column("w").to_numpy()[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.base, self.slope = rules.BM25_K1 * (1 - rules.BM25_B), rules.BM25_K1 * rules.BM25_B / (avgdl or 1.0)

    def factor(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        """Grows with tf and falls with dl, so the highest count and the least length bound it."""
        return tf * (rules.BM25_K1 + 1) / (tf + self.base + self.slope * dl)

    def bound(self, row: dict) -> tuple[np.ndarray, tuple]:
        """Upper bound of every question, and what scoring the block needs."""
        code = pc.fill_null(pc.index_in(row["terms"], self.terms), -1).to_numpy()
        at = np.flatnonzero(code >= 0)
        top = self.factor(row["most"][at], row["least_dl"][at])
        n = self.first[code[at] + 1] - self.first[code[at]]
        of = np.repeat(np.arange(len(at)), n)
        entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[code[at]][of]
        bound = np.bincount(self.question[entry], weights=np.maximum(0, self.w[entry]) * top[of], minlength=len(self.qids))
        return np.where(bound > 0, bound, -np.inf), (at, of, entry)

    def score(self, row: dict, held: tuple, some: np.ndarray) -> np.ndarray:
        """Chunks x questions, of the questions ``some``."""
        at, of, entry = held
        place = np.full(len(self.qids), -1)
        place[some] = np.arange(len(some))
        mine = place[self.question[entry]] >= 0
        weights = np.zeros((len(at), len(some)))
        weights[of[mine], place[self.question[entry[mine]]]] = self.w[entry[mine]]
        lo, hi = row["starts"][at], row["starts"][at + 1]
        term = np.repeat(np.arange(len(at)), hi - lo)
        posting = np.arange(len(term)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[term]
        member = row["member"][posting]
        grid = np.zeros((len(row["dl"]), len(at)))
        grid[member, term] = self.factor(row["tf"][posting], row["dl"][member])
        return rounded_array(grid @ weights)

    def rows(self, batch: pa.RecordBatch) -> Iterator[dict]:
        for i in range(batch.num_rows):
            row = {name: column[i].values for name, column in zip(batch.schema.names, batch.columns)}
            yield {n: v if n in ("terms", "chunk_ids") else v.to_numpy() for n, v in row.items()}


class _VectorBlocks:
    """The same for vectors; a score is minus the distance, so that larger is better."""

    def __init__(self, qids: list, matrix: np.ndarray):
        self.qids, self.unit = qids, unit_rows(matrix)

    def bound(self, row: dict) -> tuple[np.ndarray, None]:
        """No vector of the block is nearer than the angle to its centre less the radius."""
        angle = np.arccos(np.clip(self.unit @ row["centre"], -1, 1))
        return np.cos(np.maximum(0, angle - row["radius"])) - 1, None

    def score(self, row: dict, held: None, some: np.ndarray) -> np.ndarray:
        return -rounded_array(1.0 - row["vectors"] @ self.unit[some].T)

    def rows(self, batch: pa.RecordBatch) -> Iterator[dict]:
        width = self.unit.shape[1]
        for i in range(batch.num_rows):
            flat = batch.column(1)[i].values.to_numpy()
            if len(flat) != len(batch.column(0)[i]) * width:
                raise ValueError(f"vectors of the corpus must have {width} numbers, as those of the questions")
            yield {"chunk_ids": batch.column(0)[i].values, "vectors": flat.reshape(-1, width),
                   "centre": batch.column(2)[i].values.to_numpy(), "radius": batch.column(3)[i].as_py()}


def _first_pass(blocks, k: int):
    """(question_id, score): the k-th best score in the most promising block of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(blocks.qids), -np.inf)
        for batch in batches:
            rows = list(blocks.rows(batch))
            if not rows:
                continue
            found = [blocks.bound(row) for row in rows]
            bounds = np.array([b for b, _ in found])
            promising = bounds.argmax(axis=0)
            for i in np.unique(promising):
                some = np.flatnonzero((promising == i) & (bounds[i] > best))
                if not len(some) or len(rows[i]["chunk_ids"]) < k:
                    continue
                score = blocks.score(rows[i], found[i][1], some)
                best[some] = np.maximum(best[some], np.partition(score, len(score) - k, axis=0)[len(score) - k])
        some = np.flatnonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array([blocks.qids[i] for i in some], pa.string()), pa.array(best[some], pa.float64())],
                                         ["question_id", "score"])

    return run


def _second_pass(blocks, k: int, threshold: np.ndarray, name: str, sign: float, positive: bool, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(blocks.qids, k, -threshold)
        for batch in batches:
            for row in blocks.rows(batch):
                bound, held = blocks.bound(row)
                some = np.flatnonzero(np.isfinite(bound) & (bound + _SLACK >= -best.limit))
                if counts is not None:
                    counts[0].add(len(some) * len(row["chunk_ids"]))
                    counts[1].add(len(blocks.qids) * len(row["chunk_ids"]))
                if len(some):
                    score = blocks.score(row, held, some)
                    best.offer(np.array(row["chunk_ids"].to_pylist(), dtype=object),
                               np.where(score > 0, -score, np.inf) if positive else -score, some)
        yield from best.batches(name, sign)

    return run


def _search(table: DataFrame, blocks, k: int, name: str, sign: float, positive: bool, counts) -> DataFrame:
    seen = table.mapInArrow(_first_pass(blocks, k), "question_id string, score double").groupBy("question_id").agg(F.max("score").alias("s"))
    known = dict(seen.collect())
    # A keyword score of 0 is no hit, so it bounds nothing.
    threshold = np.array([s if (s := known.get(q, -np.inf)) > 0 or not positive else -np.inf for q in blocks.qids])
    return table.mapInArrow(_second_pass(blocks, k, threshold, name, sign, positive, counts),
                            f"question_id string, chunk_id string, {name} double")


def block_keyword_hits(table: DataFrame, vocabulary: DataFrame, questions: DataFrame, k: int = 16, counts=None) -> DataFrame:
    """``bm25_hits`` over stored ``keyword_blocks``. ``counts``, two accumulators, get the chunk-question pairs scored and all of them."""
    stats = corpus_stats(vocabulary)
    weights = term_weights(vocabulary, stats)

    def one(asked: DataFrame) -> DataFrame:
        found = _search(table, _KeywordBlocks(weigh(asked, weights), stats.avgdl), k, "bm25", -1.0, True, counts)
        return top_k(found, ["question_id"], k, F.col("bm25").desc(), F.col("chunk_id"), rank="kw_rank")

    return question_blocks(query_terms(questions), one)


def _assigned(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                if flat.shape[1] != centres.shape[1]:
                    raise ValueError(f"vectors of the corpus must have {centres.shape[1]} numbers")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((unit_rows(flat) @ centres.T).argmax(axis=1).astype(np.int32))],
                                                 ["chunk_id", "vector", "cell"])

    return run


def _balls(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(2).to_numpy()
            unit = unit_rows(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
            for of in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
                for lo in range(0, len(of), size):
                    part = unit[of[lo:lo + size]]
                    centre = unit_rows(part.mean(axis=0)[None])[0]
                    radius = float(np.arccos(np.clip(part @ centre, -1, 1)).max()) + 1e-7
                    yield pa.RecordBatch.from_pydict({
                        "chunk_ids": [batch.column(0).slice(of[lo], len(part))], "vectors": [part.ravel()], "centre": [centre],
                        "radius": [radius if np.any(centre) else np.pi]}, schema=_arrow(VECTOR_BLOCK_ROW))

    return run


def vector_blocks(corpus: DataFrame, cells: int = CELLS, size: int = VECTORS_IN_BLOCK, fit: int = FIT_VECTORS) -> DataFrame:
    """Blocks of vectors (chunk_id, vector) that lie close together. Store them as ``wide``.

    Vectors go to the nearest of ``cells`` centres, fitted on at most ``fit`` vectors by a hash of the id, and are sorted by cell; a block
    has its own centre and radius.
    """
    rows = corpus.where("vector is not null").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    sample = rows.orderBy(F.xxhash64("chunk_id")).limit(fit).toArrow()
    if not sample.num_rows:
        return corpus.sparkSession.createDataFrame([], VECTOR_BLOCK_ROW)
    centres = _centres(unit_rows(np.array(sample.column("vector").to_pylist(), float)), cells)
    placed = rows.mapInArrow(_assigned(centres), "chunk_id string, vector array<double>, cell int")
    by = ["cell", "chunk_id"]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_balls(size), VECTOR_BLOCK_ROW)


def _centres(unit: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced starts."""
    centres = unit[np.linspace(0, len(unit) - 1, min(cells, len(unit))).astype(int)]
    for _ in range(rounds):
        of = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, unit)
        filled = np.bincount(of, minlength=len(centres)) > 0
        centres[filled] = unit_rows(sums[filled])
    return centres


def block_vector_hits(table: DataFrame, questions: DataFrame, k: int = 16, block: int = VECTOR_BLOCK, counts=None) -> DataFrame:
    """``vector_hits`` over stored ``vector_blocks``."""
    def one(asked: DataFrame) -> DataFrame:
        rows = asked.where("vector is not null").select("question_id", "vector").toArrow()
        schema = "question_id string, chunk_id string, distance double"
        if rows.num_rows:
            held = _VectorBlocks(rows.column("question_id").to_pylist(), np.array(rows.column("vector").to_pylist(), float))
            found = _search(table, held, k, "distance", 1.0, False, counts)
        else:
            found = table.sparkSession.createDataFrame([], schema)
        return top_k(found, ["question_id"], k, F.col("distance"), F.col("chunk_id"), rank="vec_rank")

    return question_blocks(questions, one, block)


