"""Named queries with their SQL counterpart."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; its columns are made comparable."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, sf: plain(fn(spark, sf))
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def plain(df: DataFrame) -> DataFrame:
    """Integers as bigint and string arrays as ``|``-joined text."""
    def col(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(c.cast("array<string>"), "|").alias(f.name)
        return c
    return df.select(*[col(f) for f in df.schema.fields])
