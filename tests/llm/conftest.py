import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("shard", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType())])


def prose(rng: random.Random, n: int) -> str:
    syllables = ["an", "er", "the", "on", "ti", "re", "ha", "sh", "éa", "ou"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def tricky_rows() -> list[tuple]:
    """Nulls, empty, blank, short and very long texts, ties, copies, repeated rows; columns that clash."""
    rng = random.Random(7)
    base = prose(rng, 120)
    texts = [None, "", " \t\n\x0b\x0c\r", "one", "one two", base, base, base.replace(" ", "  "), base + " end", prose(rng, 60),
             base.upper(), prose(rng, 30) + "\n" + base + "\n" + prose(rng, 20), prose(rng, 30000), "a a a " * 300, "\x00", "é" * 50,
             "Released under the MIT License. mit license", "x" * 40000, "İstanbul   日本語 ###%%% 12,3 can't!"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, base), (5, base), (None, base), (None, "no id"), (None, "no id"), (30, prose(rng, 80)), (30, "other text, same id")]
    extra = ("en", "s", "f", "h", "w", "k")
    return [(*r, *extra) for r in rows]


@pytest.fixture(scope="session")
def tricky(spark):
    return spark.createDataFrame(tricky_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def table_of(spark):
    def make(rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")
    return make
