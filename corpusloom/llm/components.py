"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.base import join_groups, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u long, v long); the root is the smallest node reachable.

    Each round hangs every node on a smaller neighbour of its own; a node with many neighbours is
    aggregated in the map tasks and broadcast as a hot key, so no star is gathered anywhere. Rounds grow with
    the logarithm of a component's width. Tables between rounds lie in the shared folder.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (join_groups(both.where("v > u"), _least(both), "u", F.col("n"), 2 * before[0], "inner")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        large = stored(large)
        small = join_groups(large, _least(large), "u", F.col("n"), before[0], "inner")
        edges = stored(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
                       .where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
