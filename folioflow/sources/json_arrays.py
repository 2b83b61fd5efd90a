"""The arrays of one large JSON document, read in byte ranges.

Spark's text source cuts the file at each closing brace, so it is split like any text file. Whether a brace stands
inside a string, and how deep it stands, depends on all that comes before it: each piece is measured for both cases
(outside a string, inside one), and running sums inside a split, begun at the totals of the splits before,
choose between them. Totals are one row a split. Pieces of an object meet by its number in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import stored

#: From inside a string to its end, or to the piece's end.
REST = r'(?s)^[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)'
STRING = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)'
#: What stands before an element: no brace outside strings; after the document's own one in the first piece.
LEAD = r'(?s)^(?:[^"{]++|' + STRING[4:] + r")*+"
FIRST_LEAD = LEAD + r"\{" + LEAD[5:]
#: A member's name and the beginning of its array, with what may stand there before the first object.
NAME = r'(?s)"((?:[^"\\]|\\.)*+)"\s*:\s*\[(?:[^"{:]++|' + STRING[4:] + r")*+\z"
#: The same where no other array has begun in it.
PLAIN = r'(?s):\s*\[(?:[^"{:\[\]]++|' + STRING[4:] + r")*+\z"


def _depth(text: Column) -> Column:
    """Openings less closings outside strings, of a text that begins outside one."""
    bare = F.regexp_replace(text, STRING, "")
    opened = F.char_length(F.regexp_replace(bare, r"[^\[{]", ""))
    return opened - F.char_length(F.regexp_replace(bare, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(split, at, value, flips, outside, inside): texts up to each closing brace, in file order by (split, at);
    whether a piece goes in or out of a string, and the depth it adds if it begins outside, or inside, of one."""
    lines = spark.read.option("lineSep", "}").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    quotes = F.char_length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', ""))
    return lines.select("split", "at", "value", (quotes % 2).alias("flips"), _depth(F.col("value")).alias("outside"), _depth(F.regexp_replace("value", REST, "")).alias("inside"))


def _before(rows: DataFrame, amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows before each, as ``name``."""
    totals = rows.groupBy("split").agg(F.sum(amount).alias("total"))
    ahead = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    totals = totals.select("split", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(F.broadcast(totals), "split").withColumn(name, F.col("ahead") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("ahead")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(section, pos, value): the objects in the arrays that are members of the document, as JSON text.

    ``pos`` ascends in file order. Members of other kinds are skipped; an empty array gives no row. A file that is
    no JSON document, cut off or unbalanced, raises an error, and so do arrays whose arrays hold objects
    outside of elements.
    """
    rows = stored(_pieces(spark, path))
    rows = _before(rows, "flips", "quotes").withColumn("ends_outside", (F.col("quotes") + F.col("flips")) % 2 == 0)
    change = F.when(F.col("quotes") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    rows = rows.withColumn("change", change - F.col("ends_outside").cast("int"))
    rows = _before(rows, "change", "before").withColumn("deep", F.col("before") + F.col("change"))
    rows = rows.withColumn("closes", (F.col("ends_outside") & (F.col("deep") <= 2)).cast("int"))
    rows = stored(_before(rows, "closes", "pos").select("split", "at", "value", "before", "deep", "closes", "pos", F.col("ends_outside").alias("out")))
    end = rows.agg(F.max_by(F.struct("deep", "out"), F.struct("split", "at")).alias("e")).first()["e"]
    if end is None or not end["out"] or end["deep"] not in (0, -1):  # the text behind the last brace counts as one more
        raise ValueError(f"{path} is not one whole JSON document")
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "value")))
    text = F.concat(F.array_join(F.transform(parts, lambda x: x["value"]), "}"), F.lit("}"))
    first = F.min_by("before", F.struct("split", "at"))
    whole = rows.groupBy("pos").agg(text.alias("text"), first.alias("before"), F.max(F.when(F.col("closes") == 1, F.col("deep"))).alias("deep"))
    lead = F.when(F.col("pos") == 0, F.regexp_extract("text", FIRST_LEAD, 0)).otherwise(F.regexp_extract("text", LEAD, 0))
    found = whole.filter("deep = 2").withColumn("lead", lead)
    # The brace behind the lead opens an element where it stands at depth 2 and isn't a member's value.
    at = F.col("before") + _depth(F.col("lead"))
    nested = (at > 2) & ~F.col("lead").rlike(PLAIN)
    element = (at == 2) & ~F.col("lead").rlike(r":\s*\z")
    found = found.filter(F.when(nested, F.raise_error(F.lit("an array of arrays holds objects")).cast("boolean")).otherwise(element))
    name = F.when(F.col("lead").rlike(NAME), F.regexp_extract("lead", NAME, 1))
    found = stored(found.select("pos", name.alias("name"), F.expr("substr(text, char_length(lead) + 1)").alias("value")))
    # One row: the document's member arrays.
    starts = found.filter("name is not null").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("starts"))
    section = F.element_at(F.filter("starts", lambda s: s["pos"] <= F.col("pos")), -1)["name"]
    return found.crossJoin(F.broadcast(starts)).select(section.alias("section"), "pos", "value")
