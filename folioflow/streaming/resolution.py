"""Entity names resolved on a stream: the first to use a name gives it its node for good."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as tx
from ..shipping import ship

#: A use of a name: where it stands in the order of arrival, its label, and its spelling.
USE = "text string, label string, ord long, kind int, pos int, side int"
ORDER = ("ord", "kind", "pos", "side", "label", "text")
#: Names are kept in so many groups, since a visit to the state costs about a millisecond. A checkpoint holds for its number only.
BUCKETS = 1 << 16
#: Bytes of uses that a task holds at once.
HELD_BYTES = 64 << 20
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstUse(StatefulProcessor):
    """Keeps the names of a bucket that were used, and passes on new names only, with the label and spelling of their first use."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "name string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = {}
        for r in rows:
            place = tuple((r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in ORDER)
            if r["name"] not in first or place < first[r["name"]][0]:
                first[r["name"]] = place, r
        for (name,) in self.known.get():
            first.pop(name, None)
        if first:
            self.known.appendList([(name,) for name in first])
        for name, (_, r) in first.items():
            yield Row(name=name, id=f"entity::{r['label']}::{name}", label=r["label"], surface=r["surface"])

    def close(self) -> None:
        pass


def _first_of_each(held: list[pa.RecordBatch]) -> pa.Table:
    """The first use of each name, by ORDER with nulls first."""
    uses = pa.Table.from_batches(held).combine_chunks()
    order = pc.sort_indices(uses, sort_keys=[(c, "ascending") for c in ORDER], null_placement="at_start")
    placed = pa.table({"name": uses.column("name").take(order), "place": np.arange(len(order))})
    return uses.take(order.take(placed.group_by("name").aggregate([("place", "min")]).column("place_min")))


def first_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First uses of a task's names. Once ``HELD_BYTES`` are held, only first uses stay; where these are many, they are passed on."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= HELD_BYTES:
            first = _first_of_each(held)
            held, size = first.to_batches(), first.nbytes
            if 2 * size >= HELD_BYTES:
                yield from held
                held, size = [], 0
    if held:
        yield from _first_of_each(held).to_batches()


def resolve_stream(uses: DataFrame) -> DataFrame:
    """(name, id, label, surface): each name once, when it is first used.

    ``uses`` is a stream of rows (USE). Earlier batches come first; within one, the order of arrival decides.
    Blank names drop out. The state holds each name once and outlasts restarts in the query's checkpoint; it is
    visited once for each bucket of names and batch. Of a batch's uses only the first of each name in a task are shuffled,
    and only the first of all reach the state (or one for each ``HELD_BYTES`` of first uses, where there are more), so
    a name that very many chunks use doesn't gather in one task.
    """
    named = uses.withColumn("name", tx.normal_name(F.col("text"))).filter("name <> ''").select("name", *ORDER)
    ship(uses.sparkSession)
    bucket = F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int").alias("bucket")
    dealt = named.mapInArrow(first_uses, named.schema).select(bucket, "*").repartition("bucket")
    kept = dealt.mapInArrow(first_uses, dealt.schema).withColumn("surface", tx.strip(F.col("text")))
    return kept.groupBy("bucket").transformWithState(FirstUse(), "name string, id string, label string, surface string", "Append", "None")


def use_state_store(spark: SparkSession) -> None:
    """Have the session keep stateful operators' state in the store that they need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
