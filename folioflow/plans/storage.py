"""Tables that several parts of a plan read are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of its own only in local mode, where it is unset."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="folioflow-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet, in folders ``by`` the values of columns, and read it back.

    Plans that read it several times then scan files, with their sizes known and the folders pruned, and don't
    repeat what made it; a lost executor costs a re-read. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``ord``, their place in an order from 0; sorted in parallel, and kept in a table of its own."""
    placed = stored(rows.orderBy(*order).withColumn("part_no", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id()))
    counts = {r["part_no"]: r["n"] for r in placed.groupBy("part_no").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = rows.sparkSession.createDataFrame(before, "part_no int, before long")
    at = F.col("before") + F.col("within") - F.shiftleft(F.col("part_no").cast("long"), 33)
    # One row for each partition of the sort.
    return placed.drop("ord").join(F.broadcast(starts), "part_no").withColumn("ord", at).drop("part_no", "within", "before")
