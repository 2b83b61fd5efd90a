"""Packing text regions into overlapping chunks, and word windows for entity extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import TEXT, TEXTUAL

PAGE_COLUMNS = ("doc_id", "page_index")


def packed(regions: Column, max_chars: int, overlap_chars: int) -> Column:
    """Fold array<struct<id,text>> in reading order into array<struct<text,ids>>.

    A region that would overflow closes the chunk first, unless nothing is gathered. The last
    ``overlap_chars`` characters of a closed chunk open the next one without its region ids. Line breaks
    between regions don't count towards the length, and no region is split.
    """
    chunk_type = "array<struct<text:string,ids:array<string>>>"
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.array().cast("array<string>").alias("ids"), F.lit(0).alias("length"), F.array().cast(chunk_type).alias("done")
    )

    def closed(s: Column) -> tuple[Column, Column]:
        """What is done after closing, and the tail for the next chunk."""
        text = tx.strip(F.array_join(s["parts"], "\n"))
        chunk = F.array(F.struct(text.alias("text"), s["ids"].alias("ids")))
        tail = F.right(text, F.lit(overlap_chars)) if overlap_chars > 0 else F.lit("")
        return F.when(text == "", s["done"]).otherwise(F.concat(s["done"], chunk)), tail

    def step(s: Column, r: Column) -> Column:
        n = F.char_length(r["text"])
        done, tail = closed(s)
        full = (s["length"] + n > max_chars) & (F.size(s["parts"]) > 0)
        fresh = F.when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.concat(F.when(full, fresh).otherwise(s["parts"]), F.array(r["text"])).alias("parts"),
            F.concat(F.when(full, F.array().cast("array<string>")).otherwise(s["ids"]), F.array(r["id"])).alias("ids"),
            (F.when(full, F.char_length(tail)).otherwise(s["length"]) + n).alias("length"),
            F.when(full, done).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(regions, start, step, lambda s: F.when(F.size(s["parts"]) > 0, closed(s)[0]).otherwise(s["done"]))


def chunk_regions(regions: DataFrame, max_chars: int = 1200, overlap_chars: int = 150, min_chars: int = 40) -> DataFrame:
    """Chunks (schema CHUNK) of the textual regions of each page that have ``min_chars`` characters or more.

    A page's regions are gathered in one row; pages are small, and the only shuffle is by page.
    """
    usable = regions.filter(F.col("category").isin(*TEXTUAL) & (F.coalesce("text", F.lit("")) != "") & (F.char_length("text") >= min_chars))
    entry = F.struct("reading_order", F.col("region_id").alias("id"), "text", "doc_id", "page_index")
    pages = usable.groupBy("page_key").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    first = F.col("rows")[0]
    chunks = pages.select(
        first["doc_id"].alias("doc_id"), first["page_index"].alias("page_index"), F.posexplode(packed(F.col("rows"), max_chars, overlap_chars)).alias("seq", "chunk")
    )
    return chunks.select(
        F.concat(F.col("doc_id"), F.lit(":"), F.col("page_index").cast("string"), F.lit(":c"), F.col("seq").cast("string")).alias("chunk_id"),
        "doc_id",
        "page_index",
        F.col("chunk.text").alias("text"),
        F.col("chunk.ids").alias("region_ids"),
        F.lit(TEXT).alias("category"),
    )


def word_windows(text: Column, size: int = 250, overlap: int = 30) -> Column:
    """Overlapping windows of ``size`` words; a text that fits in one window stays as it is."""
    step = max(1, size - overlap)
    stripped = tx.strip(text)
    words = F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, rf"(?U){tx.BLANK}+"))
    last = lambda w: F.greatest(F.ceil((F.size(w) - size) / F.lit(step)), F.lit(0)).cast("int")
    # An outer transform binds the words, which would be split again for each window.
    windows = lambda w: F.transform(F.sequence(F.lit(0), last(w)), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
    many = F.get(F.transform(F.array(words), windows), 0)
    return F.when(F.size(words) <= size, F.array(text)).otherwise(many)
