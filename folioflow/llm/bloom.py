"""Bloom filters as tables of bitmaps, in DataFrame operations only.

A filter says of a key that it is certainly absent or may be present. It is used to keep rows that can't
match from being shuffled, so a filter that is too small costs time but never changes a result. At most
``MOST_BITS`` bits (16 MB) are broadcast, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import cut, spare_name

BUCKET = 32768  # bits of one bitmap of bitmap_construct_agg
MOST_BITS = 1 << 27
PER_KEY = 16


@dataclass
class Filter:
    bitmaps: DataFrame  # bucket, bitmap
    bits: int
    hits: int  # cells of a key


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    bits = BUCKET
    while bits < PER_KEY * keys and bits < most:
        bits *= 2
    return bits


def cells(key: Column, bits: int, hits: int) -> list[Column]:
    """The cells that a key hits."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hits)]


def of_cells(hit: DataFrame, bits: int, hits: int) -> Filter:
    """Filter with the bits in ``cell`` set."""
    at = hit.select((F.col("cell") / BUCKET).cast("long").alias("bucket"), F.pmod("cell", F.lit(BUCKET)).alias("at"))
    return Filter(cut(at.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))), bits, hits)


def of_keys(keys: DataFrame, key: Column, most: int = MOST_BITS) -> Filter:
    """Filter, with one cell a key, of all keys in a table that has been cut, as it is read twice."""
    bits = bits_for(2 * keys.count(), most)
    return of_cells(keys.select(cells(key, bits, 1)[0].alias("cell")), bits, 1)


def flagged(df: DataFrame, key: Column, found: Filter, out: str) -> DataFrame:
    """``df`` with the boolean ``out``: false where the key is certainly absent."""
    columns = df.columns
    tests = []
    for i, cell in enumerate(cells(key, found.bits, found.hits)):
        bucket, bitmap = spare_name(columns, f"bucket{i}"), spare_name(columns, f"bitmap{i}")
        side = F.broadcast(found.bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        df = df.withColumn(f"{bucket}_of", (cell / BUCKET).cast("long"))
        df = df.join(side, F.col(f"{bucket}_of") == F.col(bucket), "left")
        at = F.pmod(cell, F.lit(BUCKET)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8))) == 1, F.lit(False)))
    return df.select(*columns, reduce(and_, tests).alias(out))


def maybe(df: DataFrame, key: Column, found: Filter) -> DataFrame:
    """The rows whose key may be present."""
    out = spare_name(df.columns, "may_match")
    return flagged(df, key, found, out).filter(F.col(out)).drop(out)


def settle(docs: DataFrame, key: Column, todo: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``todo`` (key, stays), but for one row of each key that stays.

    ``todo`` has been cut. Rows whose key is certainly not in it are not shuffled. Keys may be structs with
    null fields.
    """
    name, may = (spare_name(docs.columns, c) for c in ("row_key", "may_match"))
    todo = todo.withColumnRenamed("key", name)
    rows = flagged(docs.withColumn(name, key), F.col(name), of_keys(todo, F.col(name)), may)
    alone = rows.filter(~F.col(may)).select(*docs.columns)
    some = rows.filter(F.col(may))
    others = some.join(todo, name, "left_anti").select(*docs.columns)
    # Copies are dropped map-side first, so that a row that very many others repeat isn't gathered.
    once = some.dropDuplicates([name]).join(todo.filter("stays"), name, "left_semi").select(*docs.columns)
    return alone.unionByName(others).unionByName(once)
