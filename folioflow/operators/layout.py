"""From page annotations to ordered, clamped regions with crop rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import VISUAL

ROW_HEIGHT = 20  # pixels of one reading row
LEAST_CROP = 8


def reading_rank(df: DataFrame, page: list[str], x: str, y: str, idx: str, out: str = "reading_order") -> DataFrame:
    """Rank annotations within their page by row of 20 pixels, half-even, then x, then place in the file."""
    order = Window.partitionBy(*page).orderBy(F.bround(F.col(y) / ROW_HEIGHT, 0), F.col(x), F.col(idx))
    return df.withColumn(out, F.row_number().over(order) - 1)


def corners(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """Whole-number corners; sums are truncated after adding."""
    return [x.cast("int"), y.cast("int"), (x + w).cast("int"), (y + h).cast("int")]


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """struct(x1, y1, x2, y2) within the page; null where no area is left."""
    cut = lambda c, top: F.greatest(F.lit(0), F.least(c, top))
    x1, y1, x2, y2 = corners(x, y, w, h)
    x1, x2, y1, y2 = cut(x1, width), cut(x2, width), cut(y1, height), cut(y2, height)
    box = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), box)


def crop_eligible(category: Column, box: Column) -> Column:
    """Visual regions whose clamped box is at least 8 pixels either way."""
    large = (box["x2"] - box["x1"] >= LEAST_CROP) & (box["y2"] - box["y1"] >= LEAST_CROP)
    return category.isin(*VISUAL) & F.coalesce(large, F.lit(False))


def extract_regions(pages: DataFrame, crops_dir: str) -> DataFrame:
    """Regions of pages (schema PAGE). Ranks are given before unknown categories drop out, so they may have gaps."""
    each = pages.select("key", "doc_id", "page_index", "width", "height", F.posexplode("annotations").alias("idx", "ann"))
    box = F.col("ann.bbox")
    flat = each.select("*", *[F.try_element_at(box, F.lit(i + 1)).alias(n) for i, n in enumerate("xywh")])
    ranked = reading_rank(flat, ["key", "doc_id", "page_index"], "x", "y", "idx")
    kept = ranked.filter(F.col("ann.category_id").between(1, 5))
    region_id = F.concat_ws(":", "doc_id", "page_index", F.coalesce(F.col("ann.id"), F.col("idx").cast("long")))
    inside = clamped(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    df = kept.withColumn("region_id", region_id).withColumn("inside", inside)
    return df.select(
        "region_id",
        "doc_id",
        F.col("key").alias("page_key"),
        "page_index",
        F.col("ann.category_id").alias("category"),
        F.struct("x", "y", "w", "h").alias("bbox"),
        "reading_order",
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("caption"),
        F.when(crop_eligible(F.col("ann.category_id"), F.col("inside")), tx.crop_file(crops_dir, F.col("region_id"))).alias("crop_path"),
    )


def visual_with_crop(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("category").isin(*VISUAL) & (F.coalesce("crop_path", F.lit("")) != ""))


def captioned(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("category").isin(*VISUAL) & (F.coalesce("caption", F.lit("")) != ""))


def uncaptioned(regions: DataFrame, files: DataFrame) -> DataFrame:
    """Visual regions with an existing crop file (``files``: path) and no caption yet."""
    todo = visual_with_crop(regions).filter(F.coalesce("caption", F.lit("")) == "")
    return todo.join(files.select(F.col("path").alias("crop_path")), "crop_path", "left_semi")


def large_enough(images: DataFrame, least: int = LEAST_CROP) -> DataFrame:
    """Images to embed: readable (known size) and at least ``least`` pixels either way."""
    return images.filter((F.col("width") >= least) & (F.col("height") >= least))
