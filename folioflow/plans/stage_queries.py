"""Stage results in tables of replaceable rows, the resumed graph, and names on a stream, over the standard tables."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..models import stand_ins
from ..operators import layout, search
from ..sources import graphml, readers
from ..sources.collection import Collection
from ..streaming import incremental, resolution
from .graph_build import GraphBuild
from .graph_queries import ITEM_SQL, chunks, tables
from .layout_queries import ANN_SQL, page_table
from .registry import ORACLES, query, table
from .storage import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream. The pattern lets a table be one file or a folder."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque[t]")


@query(f"""WITH {ANN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y / 20, 0), x, idx) - 1 AS reading_order FROM cut)
SELECT 'O:' || page || ':' || idx AS region_id, 'O_' || page AS page_key, category, reading_order + CASE WHEN page % 3 = 0 THEN 100 ELSE 0 END AS reading_order
FROM r WHERE category BETWEEN 1 AND 5 AND page % 7 <> 0""")
def page_sink(spark: SparkSession, d: str) -> DataFrame:
    """All pages are put in; then a third come again with other numbers, twice, and a seventh without any region."""
    pages, path = page_table(spark, d), fresh_folder(spark, "regions")
    regions = layout.extract_regions(pages, "crops")
    readers.put_regions(regions, pages, path, "first")
    again = pages.filter("page_index % 3 = 0")
    shifted = layout.extract_regions(again, "crops").withColumn("reading_order", F.col("reading_order") + 100)
    readers.put_regions(shifted, again, path, "second")
    readers.put_regions(regions, pages, path, "first")  # a replay
    readers.put_regions(regions.filter("false"), pages.filter("page_index % 7 = 0"), path, "third")
    return readers.region_table(spark, path).read().select("region_id", "page_key", "category", "reading_order")


@query("""WITH p AS (SELECT 'D' || doc_id AS chunk_id, source AS doc_id, md5(text) AS body, doc_id AS n FROM documents)
SELECT 'before' AS version, chunk_id, doc_id, body FROM p WHERE n % 2 = 0
UNION ALL SELECT 'after', chunk_id, doc_id, CASE WHEN n % 3 = 0 THEN md5('new ' || n) ELSE body END FROM p WHERE n % 2 = 0 OR n % 3 = 0""")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """A collection is made, filled and upserted; who opened it before still sees the version of then."""
    n = F.col("n")
    docs = table(spark, d, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("doc_id"), F.lit(0).alias("page_index"), "text",
        F.array().cast("array<string>").alias("region_ids"), F.lit(1).alias("category"), F.col("doc_id").alias("n"),
    )

    def points(rows: DataFrame) -> DataFrame:
        made = rows.select("chunk_id", F.array(F.char_length("text").cast("float")).alias("dense"), F.create_map(F.lit(0), F.lit(1.0).cast("float")).alias("sparse"))
        return search.text_points(rows.drop("n"), made)

    store = Collection.open(spark, fresh_folder(spark, "collection"), "text")
    store.upsert(points(docs.filter(n % 2 == 0)))
    before = store.read()
    store.upsert(points(docs.filter(n % 3 == 0).withColumn("text", F.concat(F.lit("new "), n.cast("string")))))
    shown = lambda df, name: df.select(F.lit(name).alias("version"), "chunk_id", "doc_id", F.md5("text").alias("body"))
    return shown(before, "before").unionByName(shown(store.read(), "after"))


@query(f"""WITH {ITEM_SQL} SELECT DISTINCT doc_id AS src, chunk_id AS dst, 'HAS_CHUNK' AS key, NULL AS relation, NULL AS chunk_id FROM chunk
UNION ALL SELECT chunk_id, entity, 'MENTIONS', NULL, NULL FROM mention
UNION ALL SELECT DISTINCT part, supplier, 'CO_OCCURS', NULL, NULL FROM chunk
UNION ALL SELECT part, supplier, 'RELATES', max_by(relation, ord), max_by(chunk_id, ord) FROM chunk GROUP BY ALL""")
def graph_resumed(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a graph whose first run ends after one batch and whose second run does the rest."""
    base, kg = stand_ins(), Config().kg
    rows = chunks(spark, d)
    rows = rows.withColumn("text", F.concat("part", "supplier", F.lit(" "), "relation"))
    word = lambda c, pattern: F.regexp_extract(c, pattern, 0)
    part, supplier, ships = r"Part \d+", r"supplier \d+", r"ships \w+"
    entity = lambda c, pattern, label: F.struct(word(c, pattern).alias("text"), F.lit(label).alias("label"), F.lit(1.0).alias("score"))
    providers = dataclasses.replace(
        base,
        entities=lambda c: F.array(entity(c, part, "part"), entity(c, supplier, "supplier")),
        relations=lambda c: F.to_json(F.array(F.struct(word(c, part).alias("subject"), word(c, ships).alias("relation"), word(c, supplier).alias("object")))),
    )
    config = dataclasses.replace(Config(), kg=dataclasses.replace(kg, entity_labels=("part", "supplier"), checkpoint_every=150_000))
    path = fresh_folder(spark, "graph")
    first = dataclasses.replace(config, kg=dataclasses.replace(config.kg, checkpoint_every=25_000))
    GraphBuild(spark, path, first, providers).run(rows, most_batches=1)
    build = GraphBuild(spark, path, config, providers)
    build.run(rows)
    return build.graph()[1]


@query("""WITH item AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM lineitem),
u AS (SELECT (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord, 'part ' || l_partkey AS name, l_returnflag AS label FROM item)
SELECT name, 'entity::' || min_by(label, (ord, label)) || '::' || name AS id, min_by(label, (ord, label)) AS label FROM u GROUP BY name""")
def stream_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of parts, resolved on a stream of line items."""
    resolution.use_state_store(spark)
    uses = streamed(spark, d, "lineitem").select(
        F.concat(F.lit(" Part "), F.col("l_partkey").cast("string")).alias("text"), F.col("l_returnflag").alias("label"), F.col("l_orderkey").cast("long").alias("ord"),
        F.col("l_linenumber").cast("int").alias("kind"), F.col("l_partkey").cast("int").alias("pos"), F.col("l_suppkey").cast("int").alias("side"),
    )
    path = fresh_folder(spark, "names")
    found = resolution.resolve_stream(uses).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    found.start(f"{path}/table").awaitTermination()
    return spark.read.parquet(f"{path}/table").select("name", "id", "label")


@query("""SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY user_id""")
def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events appended from a stream, after half of them had arrived in another way; each is kept once."""
    path = fresh_folder(spark, "events")
    events = table(spark, d, "events").select("event_id", "user_id")
    incremental.append_new(events.filter("event_id % 2 = 0"), f"{path}/table", "event_id")
    stream = streamed(spark, d, "events").select("event_id", "user_id")
    each = lambda batch, number: incremental.append_new(batch, f"{path}/table", "event_id")
    incremental.start(stream, each, f"{path}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query(ORACLES["graph_nodes"])
def graphml_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The graph written as one GraphML file and read back."""
    path = f"{fresh_folder(spark, 'graphml')}/graph.graphml"
    nodes, edges = tables(spark, d, relations=False)
    graphml.write_graphml(nodes, edges, path)
    return graphml.read_graphml(spark, path)[0]


@query("""WITH a AS (SELECT l_orderkey, l_partkey, r_name || ' {"[' AS name FROM lineitem LEFT JOIN region ON r_regionkey = l_linenumber % 7)
SELECT o_orderkey AS image_id, count(l_orderkey) AS n_annotations, coalesce(sum(l_partkey), 0)::BIGINT AS parts, coalesce(string_agg(coalesce(name, ''), ',' ORDER BY coalesce(name, '')), '') AS names
FROM orders LEFT JOIN a ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def coco_file(spark: SparkSession, d: str) -> DataFrame:
    """Orders as images and line items as annotations, written as one COCO file and read back in byte ranges."""
    path = f"{fresh_folder(spark, 'coco')}/annotations.json"
    key = F.col("o_orderkey")
    images = table(spark, d, "orders").select(key.alias("id"), F.concat(F.lit('a "b}/O_'), key.cast("string"), F.lit(".png")).alias("file_name"), F.lit(612).alias("width"), F.lit(792).alias("height"))
    notes = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_linenumber") % 7).alias("category_id"), F.array(F.col("l_partkey").cast("double")).alias("bbox"))
    kinds = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.concat("r_name", F.lit(' {"[')).alias("name"))
    readers.write_coco(images, notes, kinds, path)
    pages = readers.read_coco(spark, path)
    names = F.array_join(F.sort_array(F.transform("annotations", lambda a: a["category_name"])), ",")
    parts = F.aggregate("annotations", F.lit(0).cast("long"), lambda s, a: s + a["bbox"][0].cast("long"))
    return pages.select(F.col("page_index").cast("long").alias("image_id"), F.size("annotations").cast("long").alias("n_annotations"), parts.alias("parts"), names.alias("names"))
