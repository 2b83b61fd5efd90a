"""Exact deduplication by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 lets every text hash hit two cells of a bit table; cells that are hit at least twice form
the *repeat filter*, built with Spark's bitmap aggregates. Pass 2 tests each row against that
filter, which is broadcast. A row with a cell that was hit once is certainly unique and passes
straight through; only the others are shuffled, grouped by their full SHA-256 and resolved.

One filter has at most ``max_bits`` bits (16 MB at the default), so its broadcast is bounded. A table
that needs more is worked off in up to ``MOST_RANGES`` ranges of the hash, each with a filter of its own.
Beyond that more rows count as possibly repeated and are shuffled, as narrow hashes; the result stays the
same. A text that a third of all rows share is aggregated map-side before it is shuffled, and the
join back to its rows is a plain sort-merge join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .workspace import cut

SPACES = r"[\x20\x09-\x0D]"
MOST_RANGES = 16


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text_col)), 256))


def _points(text_col: str) -> Column:
    return F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, sha, n) of each row; cut, so that the row's number holds."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _sha(text_col).alias("sha"), _points(text_col).alias("n")))


def repeat_filter(keys: DataFrame, bits: int) -> bloom.Filter:
    """Pass 1: the cells that are hit at least twice."""
    hits = keys.select(F.explode(F.array(*bloom.cells(F.col("sha"), bits, 2))).alias("cell"))
    return bloom.of_cells(hits.groupBy("cell").agg(F.count("*").alias("hits")).filter("hits >= 2"), bits, 2)


def flag_repeats(keys: DataFrame, max_bits: int = bloom.MOST_BITS) -> DataFrame:
    """Pass 2: ``keys`` with the boolean ``maybe``, false where the text is certainly unique."""
    n = keys.count()
    ranges = max(1, min(MOST_RANGES, -(-bloom.PER_KEY * n // max_bits)))
    bits = bloom.bits_for(-(-n // ranges), max_bits)
    out = None
    for i in range(ranges):
        part = keys.filter(F.pmod(F.xxhash64("sha", F.lit("range")), F.lit(ranges)) == i) if ranges > 1 else keys
        flagged = bloom.flagged(part, F.col("sha"), repeat_filter(part, bits), "maybe")
        out = flagged if out is None else out.unionByName(flagged)
    return out


def _winners(rep: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("void"), F.col("id").alias("id"), F.col("row").alias("row")))
    return rep.groupBy("sha").agg(best.alias("best"), F.count("*").alias("group_size"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MOST_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space. Of equal texts the row with
    the most code points, then the smallest id, stays, and no other: of rows that tie in both, as repeated
    rows do, any one. Null texts equal empty texts. A null id loses against any other. Only ``id_col`` and
    ``text_col`` are read; other columns don't matter. An empty table gives no rows.
    """
    flagged = flag_repeats(_keys(docs, id_col, text_col), max_bits)
    winners = cut(_winners(flagged.filter("maybe")))
    alone = flagged.filter("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    again = flagged.filter("maybe").join(winners, "sha")
    again = again.select("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return alone.unionByName(again).withColumnRenamed("id", id_col)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = bloom.MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only rows that go, and rows that tie with one that stays, carry their text through a shuffle.
    Edge cases are those of ``classify``.
    """
    flagged = flag_repeats(_keys(docs, id_col, text_col), max_bits)
    again = flagged.filter("maybe")
    each = again.join(cut(_winners(again).filter("group_size > 1")), "sha")
    todo = each.groupBy("sha", "id", "n").agg(F.max(F.col("row") == F.col("best.row")).alias("stays"), F.count("*").alias("rows"))
    todo = todo.filter("not stays or rows > 1").select(F.struct("sha", "id", "n").alias("key"), "stays")
    key = F.struct(_sha(text_col).alias("sha"), F.col(id_col).alias("id"), _points(text_col).alias("n"))
    return bloom.settle(docs, key, cut(todo))
