"""What the search operators share: rounded scores, blocks of questions, and the best hits of a task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.text import index_tokens
from corpusloom.operators.common import BROADCAST_ROWS, stored

# Scores are sums of doubles whose order is not fixed, so ranking looks at
# rounded scores and breaks ties by id: a rerun or retry gives the same ranks.
# One rule rounds columns and arrays alike: half goes up.
SCORE_DIGITS = 6
_SCALE = 10.0 ** SCORE_DIGITS


def rounded(score: Column) -> Column:
    return F.floor(score * _SCALE + 0.5) / _SCALE


def rounded_array(score: np.ndarray) -> np.ndarray:
    return np.floor(score * _SCALE + 0.5) / _SCALE


# Largest block of question vectors held by a task.
VECTOR_BLOCK = 4096


def query_terms(questions: DataFrame, query: str = "query") -> DataFrame:
    """Distinct terms of each question with their multiplicity."""
    return questions.select("question_id", F.explode_outer(index_tokens(F.col(query))).alias("term")).groupBy(
        "question_id", "term").agg(F.count("*").alias("qtf"))


def question_blocks(rows: DataFrame, one, block: int = BROADCAST_ROWS) -> DataFrame:
    """Answers of ``one(part)`` for hash blocks of questions with about ``block`` of the given rows each.

    With several, each is stored as it is done, so that neither plan nor driver holds more than one block.
    """
    blocks, out = max(1, -(-rows.count() // block)), None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b)
        best = one(part)
        best = best if blocks == 1 else stored(best)
        out = best if out is None else out.unionByName(best)
    return out


def weigh(wanted: DataFrame, weights: DataFrame) -> pa.Table:
    """(question_id, term, w) of one block of asked terms."""
    asked = wanted.toArrow()
    local = wanted.sparkSession.createDataFrame(asked) if asked.num_rows else wanted
    return weights.join(F.broadcast(local), "term").select("question_id", "term", (F.col("qtf") * F.col("idf")).alias("w")).toArrow()


class Best:
    """The ``k`` lowest (value, id) pairs of every question seen by one task, none above its ``limit``."""

    def __init__(self, qids: list, k: int, limit: np.ndarray | None = None):
        self.qids, self.k = qids, k
        self.ids = [np.empty(0, dtype=object)] * len(qids)
        self.values = [np.empty(0)] * len(qids)
        self.limit = np.full(len(qids), np.inf) if limit is None else limit.copy()

    def offer(self, ids: np.ndarray, values: np.ndarray, some: np.ndarray | None = None) -> None:
        """``values`` is rows x questions, or x the questions ``some``; infinite means no match."""
        some = np.arange(len(self.qids)) if some is None else some
        near = (values <= self.limit[some]) & np.isfinite(values)
        for i in np.flatnonzero(near.any(axis=0)):
            j = some[i]
            rows = np.flatnonzero(near[:, i])
            column = values[rows, i]
            if len(rows) > self.k:
                inside = column <= np.partition(column, self.k - 1)[self.k - 1]
                rows, column = rows[inside], column[inside]
            all_ids = np.concatenate([self.ids[j], ids[rows]])
            all_values = np.concatenate([self.values[j], column])
            keep = np.lexsort((all_ids, all_values))[:self.k]
            self.ids[j], self.values[j] = all_ids[keep], all_values[keep]
            if len(keep) == self.k:
                self.limit[j] = min(self.limit[j], self.values[j][-1])

    def batches(self, name: str, sign: float = 1.0):
        for qid, ids, values in zip(self.qids, self.ids, self.values):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([qid] * len(ids)), pa.array(list(ids)), pa.array(sign * values + 0.0)],
                    ["question_id", "chunk_id", name])


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)
