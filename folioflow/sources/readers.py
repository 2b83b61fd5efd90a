"""Reading pages, regions, chunks and question sets, and writing stage results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions import text as tx
from . import json_arrays, shards
from .keyed import KeyedTable
from .parts import write_whole

COCO_IMAGE = "id bigint, file_name string, width int, height int"
COCO_ANNOTATION = "id bigint, image_id bigint, category_id int, bbox array<double>, category_name string"
COCO_CATEGORY = "id int, name string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines under an explicit schema; blank lines are skipped, missing keys are null."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.REGION)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.CHUNK)


def region_table(spark: SparkSession, path: str) -> KeyedTable:
    """The table of regions by page: a page's regions are replaced as a whole, also by none."""
    return KeyedTable(spark, path, "page_key")


def put_regions(regions: DataFrame, pages: DataFrame, path: str, commit: str | None = None) -> int:
    """Put the regions of ``pages`` (key) in place of what the table has of these pages.

    A page that is worked off again leaves one copy, a crash leaves the old regions or the new ones, and the
    replay of a batch that is named by ``commit`` changes nothing.
    """
    return region_table(regions.sparkSession, path).put(regions, pages.select(F.col("key").alias("page_key")), commit)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replace all chunks."""
    chunks.write.mode("overwrite").parquet(path)


def read_coco(spark: SparkSession, annotations_path: str, image_dir: str | None = None, max_pages: int = 0) -> DataFrame:
    """Pages of a COCO file; images whose file is missing are skipped and don't count towards ``max_pages``.

    The file, one JSON document, is read in byte ranges (``json_arrays``).
    """
    found = json_arrays.read_arrays(spark, annotations_path)

    def section(name: str, schema: str) -> DataFrame:
        return found.filter(F.col("section") == name).select("pos", F.from_json("value", schema).alias("a")).select("pos", "a.*")

    images = section("images", COCO_IMAGE).drop("pos")
    annotations = section("annotations", COCO_ANNOTATION)
    categories = section("categories", COCO_CATEGORY).drop("pos")
    if image_dir is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(image_dir)
        files = files.select(F.element_at(F.split("path", "/"), -1).alias("base"), F.col("content").alias("image"))
        images = images.withColumn("base", F.element_at(F.split("file_name", "/"), -1)).join(files, "base").drop("base")
    else:
        images = images.withColumn("image", F.lit(None).cast("binary"))
    pages = coco_pages(images, annotations, categories)
    return pages.limit(max_pages) if max_pages else pages


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """One COCO file of three tables whose columns are the objects' fields; null fields are left out."""
    listed = lambda df: df.select(F.concat(F.lit(","), F.to_json(F.struct("*"))).alias("value"))
    write_whole([b'{"images": [\n', listed(images), b'], "annotations": [\n', listed(annotations), b'], "categories": [\n', listed(categories), b"]}\n"], path, skip=1)


def coco_pages(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Images with their annotations in file order; images without any have an empty list.

    The categories, a table that a data set fixes, are joined left; a name that an annotation has stays.
    """
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("known"))
    named = annotations.join(names, "category_id", "left").withColumn("category_name", F.coalesce("category_name", "known", F.lit("")))
    one = F.struct("id", "category_id", "bbox", "category_name")
    grouped = named.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("a")))).alias("l"))
    grouped = grouped.select("id", F.col("l.a").alias("annotations"))
    key = F.regexp_replace("file_name", r"\.[^./]*$", "")
    return images.join(grouped, "id", "left").select(
        key.alias("key"), tx.page_key_doc(key).alias("doc_id"), tx.page_key_index(key).alias("page_index"), "image", "width", "height",
        F.coalesce("annotations", F.array().cast(f"array<{schemas.ANNOTATION}>")).alias("annotations"),
    )


def png_size(image: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from a PNG's header."""
    if image is None or image[:8] != b"\x89PNG\r\n\x1a\n" or len(image) < 24:
        return None, None
    return int.from_bytes(image[16:20], "big"), int.from_bytes(image[20:24], "big")


def shard_pages(samples: DataFrame, max_pages: int = 0) -> DataFrame:
    """Pages (schema PAGE) of shard samples; metadata that isn't an object has no annotations."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [png_size(x) for x in batch.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], [*batch.schema.names, "width", "height"]
            )

    sized = samples.mapInArrow(run, "key string, image binary, meta string, width int, height int")
    found = F.from_json("meta", f"annotations array<{schemas.ANNOTATION}>")["annotations"]
    pages = sized.select(
        "key", tx.page_key_doc(F.col("key")).alias("doc_id"), tx.page_key_index(F.col("key")).alias("page_index"), "image", "width", "height",
        F.coalesce(found, F.array().cast(f"array<{schemas.ANNOTATION}>")).alias("annotations"),
    )
    return pages.limit(max_pages) if max_pages else pages


def read_shards(spark: SparkSession, paths: list[str], max_pages: int = 0, everywhere: bool = True) -> DataFrame:
    """Pages of tar shards, split into byte ranges. All are read through Spark's file systems, with or without ``everywhere``."""
    return shard_pages(shards.read_samples(spark, paths), max_pages)


def pages(spark: SparkSession, config: Config) -> DataFrame:
    """The configured source's pages."""
    ingest = config.ingest
    if ingest.source == "webdataset":
        return read_shards(spark, list(ingest.shard_urls), ingest.max_pages)
    if ingest.source == "coco":
        return read_coco(spark, ingest.coco_annotations, ingest.coco_image_dir or None, ingest.max_pages)
    raise ValueError(f"unknown source: {ingest.source}")


def expected_pages(df: DataFrame, max_pages: int = 0) -> int | None:
    """How many pages to expect; None for streams."""
    if df.isStreaming:
        return None
    n = df.count()
    return min(n, max_pages) if max_pages else n


def json_record(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)
