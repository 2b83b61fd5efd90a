"""Graph tables on disk as Parquet, and GraphML for exchange with other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .parts import write_whole

NAMESPACE = "http://graphml.graphdrawing.org/xmlns"
NODE_KEYS = ("ntype", "label", "name", "doc_id", "page_index")
EDGE_KEYS = ("relation", "chunk_id")


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schemas.NODE).parquet(f"{path}/nodes"), spark.read.schema(schemas.EDGE).parquet(f"{path}/edges")


def _lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One element in each row, as text."""

    def escaped(value: Column) -> Column:
        for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
            value = F.replace(value, F.lit(mark), F.lit(name))
        return value

    def data(kind: str, names: tuple[str, ...]) -> list[Column]:
        one = lambda n: F.concat(F.lit(f'<data key="{kind}_{n}">'), escaped(F.col(n).cast("string")), F.lit("</data>"))
        return [F.coalesce(one(n), F.lit("")) for n in names]

    attribute = lambda name, column: F.concat(F.lit(f' {name}="'), escaped(F.col(column).cast("string")), F.lit('"'))
    node = F.concat(F.lit("<node"), attribute("id", "id"), F.lit(">"), *data("node", NODE_KEYS), F.lit("</node>"))
    edge = F.concat(F.lit("<edge"), attribute("source", "src"), attribute("target", "dst"), attribute("id", "key"), F.lit(">"), *data("edge", EDGE_KEYS), F.lit("</edge>"))
    return nodes.select(node.alias("value")), edges.select(edge.alias("value"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file at ``path``, put in place at the end; the driver holds no row of it."""
    keys = "".join(f'<key id="{kind}_{n}" for="{kind}" attr.name="{n}" attr.type="{"int" if n == "page_index" else "string"}"/>\n' for kind, names in (("node", NODE_KEYS), ("edge", EDGE_KEYS)) for n in names)
    head = f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="{NAMESPACE}">\n{keys}<graph edgedefault="directed">\n'
    write_whole([head.encode(), *_lines(nodes, edges), b"</graph>\n</graphml>\n"], path)


#: A line that is one whole element, a line that declares one key, and what no other line may have for the text source to do.
ELEMENT = r"^\s*<(node|edge)(?=[\s/>])[^<>]*+(?:(?<=/)>|>(?:\s*<data(?=[\s/>])[^<>]*+(?:(?<=/)>|>[^<]*+</data\s*+>))*+\s*</\1\s*+>)\s*$"
KEY = r"^\s*<key(?=[\s/>])[^<>]*+(?:(?<=/)>|>(?:<default>[^<]*+</default>)?</key>)\s*$"
OTHER = r"[<:](?:node|edge|key)(?:[\s/>]|$)|<!"
REFERENCE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"
#: Places of a file that are looked at for line ends, and how many bytes at each.
PROBES, PROBE = 64, 1 << 16


def _has_lines(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a file with line ends all over it; one long line is nothing for the text source."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return False
    size = fs.getFileStatus(at).getLen()
    if size <= PROBES * PROBE:
        return True
    stream = fs.open(at)
    try:
        for k in range(PROBES):
            stream.seek((size - PROBE) * k // (PROBES - 1))
            if b"\n" not in jvm.org.apache.commons.io.IOUtils.toByteArray(stream, PROBE):
                return False
        return True
    finally:
        stream.close()


def _declared_by_line(spark: SparkSession, path: str) -> list[str] | None:
    """The lines that declare keys, of a file whose elements stand on lines of their own; None for any other file."""
    if not _has_lines(spark, path):
        return None
    value = F.col("value")
    plain = (value.rlike(ELEMENT) | value.rlike(KEY) | ~value.rlike(OTHER)) & ~value.rlike(REFERENCE)
    row = spark.read.text(path).agg(F.coalesce(F.bool_and(plain), F.lit(False)).alias("plain"), F.collect_set(F.when(value.rlike(KEY), value)).alias("keys")).first()
    return row["keys"] if row["plain"] else None


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GraphML; the driver sees the declared keys only.

    A file with each element on a line of its own is read as lines, in byte ranges, and each line is parsed as XML. Any
    other is read by Spark's XML source, which takes one task for a file. Data under keys that aren't declared, or that
    the graph's tables don't have, are left out.
    """
    options = {"ignoreSurroundingSpaces": "false"}
    keys = _declared_by_line(spark, path)

    def read(tag: str, schema: str) -> DataFrame:
        if keys is None:
            return spark.read.format("xml").options(rowTag=tag, **options).schema(schema).load(path)
        lines = spark.createDataFrame([(k,) for k in keys], "value string") if tag == "key" else spark.read.text(path).filter(F.col("value").rlike(rf"^\s*<{tag}[\s/>]"))
        return lines.select(F.from_xml("value", schema, options).alias("e")).select("e.*")

    declared = read("key", "_id string, _for string, `_attr.name` string").select("_id", "_for", F.col("`_attr.name`").alias("name")).collect()
    data = "data array<struct<_key:string,_VALUE:string>>"

    def value(kind: str, name: str) -> Column:
        ids = [r["_id"] for r in declared if r["name"] == name and r["_for"] in (kind, "all", None)]
        found = F.get(F.filter("data", lambda x: x["_key"].isin(ids)), F.lit(0))
        return F.when(found.isNotNull(), F.coalesce(found["_VALUE"], F.lit("")))

    nodes = read("node", f"_id string, {data}").select(F.col("_id").alias("id"), *[value("node", n).alias(n) for n in NODE_KEYS[:-1]], value("node", "page_index").try_cast("int").alias("page_index"))
    edges = read("edge", f"_source string, _target string, _id string, {data}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), F.col("_id").alias("key"), *[value("edge", n).alias(n) for n in EDGE_KEYS])
    return nodes, edges
