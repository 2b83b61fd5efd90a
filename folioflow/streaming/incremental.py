"""Incremental ingest with Structured Streaming: idempotent, keyed, and safe to stop."""

from __future__ import annotations

import signal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import search


def read_stream(spark: SparkSession, path: str, schema: str, file_format: str = "json", files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(batch: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table doesn't have; a batch that is replayed adds nothing."""
    batch = batch.dropDuplicates([key])
    if _exists(batch.sparkSession, path):
        batch = search.pending(batch, batch.sparkSession.read.parquet(path), key)
    batch.write.mode("append").parquet(path)


def upsert_versions(batch: DataFrame, path: str, key: str, order: str, batch_id: int) -> None:
    """Write the table's next version with the batch put in; readers take the newest whole version."""
    spark = batch.sparkSession
    old = current(spark, path, before=batch_id)
    search.upsert(old, batch, key, order).write.mode("overwrite").parquet(f"{path}/version={batch_id:012d}")


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest whole version of a table written by ``upsert_versions``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [(int(s.getPath().getName().split("=")[1]), str(s.getPath())) for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    whole = [(v, p) for v, p in found if (before is None or v < before) and fs.exists(hadoop.Path(f"{p}/_SUCCESS"))]
    return spark.read.parquet(max(whole)[1]) if whole else None


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Run ``each`` on every micro-batch, resuming from ``checkpoint``; ``once`` works off what is there and ends."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def stop_on_signal(query: StreamingQuery, cleanup: Callable[[], None] | None = None) -> Callable[[], None]:
    """Stop the query and clean up on an interrupt, then exit with 130; returns what restores the old handler."""
    old = signal.getsignal(signal.SIGINT)

    def handler(signum, frame):
        query.stop()
        if cleanup:
            cleanup()
        raise SystemExit(130)

    signal.signal(signal.SIGINT, handler)
    return lambda: signal.signal(signal.SIGINT, old)


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums per tumbling window and event type. Windows over time go beyond the page pipeline's needs."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
