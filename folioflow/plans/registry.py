"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """Whole numbers as longs and floats as doubles, so that both engines give one type."""
    wide = {T.IntegerType(): "long", T.ShortType(): "long", T.ByteType(): "long", T.FloatType(): "double"}
    return df.select(*[F.col(f"`{f.name}`").cast(wide[f.dataType]).alias(f.name) if f.dataType in wide else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: widened(f(spark, sf_dir))
        if sql:
            ORACLES[key] = sql
        return f

    return register
