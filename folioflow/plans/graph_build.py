"""Building the graph in committed batches, so that a run that ends early is taken up where it stopped.

What models extract from a chunk is costly and is kept: mentions and triples go to tables keyed by chunk, and
after them the batch's chunks go to a ledger. A chunk in the ledger is never extracted again; one that isn't
there is, and replaces whatever its earlier, broken-off extraction has left. The graph is made of the three
tables and is the same as if one run had done all.
"""

from __future__ import annotations

import dataclasses
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..models import Providers
from ..operators import graph, search
from ..sources.keyed import KeyedTable
from . import stages
from .storage import numbered, stored

LEDGER = "chunk_id string, doc_id string, page_index int, ord long"
#: Segments after which the tables are folded.
MOST_SEGMENTS = 20
#: Batches that are extracted side by side, since one keeps a core or two busy.
AT_ONCE = 8


class GraphBuild:
    """The state of a graph's build in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, config: Config, providers: Providers):
        self.spark, self.config, self.providers = spark, config, providers
        self.ledger, self.mentions, self.triples = (KeyedTable(spark, f"{path}/{name}", "chunk_id") for name in ("chunks", "mentions", "triples"))
        self.ledger.create(LEDGER)
        self.mentions.create(schemas.MENTION)
        self.triples.create(schemas.TRIPLE)

    def pending(self, chunks: DataFrame) -> DataFrame:
        """The chunks that no committed batch has."""
        return search.pending(chunks, self.ledger.read(), "chunk_id")

    def run(self, chunks: DataFrame, most_batches: int | None = None) -> int:
        """Extract the pending ones of ``chunks`` (chunk_id, doc_id, page_index, text, ord) in batches; the number of batches.

        A batch has ``checkpoint_every`` chunks (0: all) in order of ``ord``. Up to ``AT_ONCE`` batches are extracted side by
        side; each is committed by itself and in order, so an interrupt or error ends the run, leaves the batches committed before
        it, and costs those under way. ``most_batches`` ends it as well. Triples are taken
        from the first ``max_relation_chunks`` chunks that arrive over all runs.
        """
        kg = self.config.kg
        first = self.ledger.count()
        todo = numbered(self.pending(chunks), "ord", "chunk_id").withColumn("ord", F.col("ord") + first)
        every = kg.checkpoint_every
        batch = F.expr(f"(ord - {first}) div {every}") if every else F.lit(0).cast("long")
        todo = todo.withColumn("batch", batch)
        todo = stored(todo if most_batches is None else todo.filter(F.col("batch") < most_batches), "batch")
        last = todo.agg(F.max("batch")).first()[0]
        batches = 0 if last is None else int(last) + 1
        each = [todo.filter(F.col("batch") == k).drop("batch") for k in range(batches)]
        for k in range(0, batches, AT_ONCE):
            self.commit(each[k : k + AT_ONCE])
        return batches

    def commit(self, batches: list[DataFrame]) -> None:
        """Extract batches side by side and commit each in order, its place in the ledger last."""
        tables = (self.mentions, self.triples, self.ledger)
        with ThreadPoolExecutor(3 * AT_ONCE) as pool:
            written = [[(table, pool.submit(table.write, *rows)) for table, *rows in self._extracted(batch)] for batch in batches]
            try:
                for batch in written:
                    for table, name in [(table, segment.result()) for table, segment in batch]:
                        table.put(name)
            except BaseException:
                pool.shutdown(wait=True, cancel_futures=True)
                raise
            list(pool.map(lambda table: table.fold(MOST_SEGMENTS), tables))  # no segment is under way any more

    def _extracted(self, batch: DataFrame) -> list[tuple]:
        """What a batch puts into each table: rows, and the keys that they replace where these aren't the rows' own."""
        kg, keys = self.config.kg, batch.select("chunk_id")
        out = [(self.mentions, stages.extract_entities(batch, self.config, self.providers), keys)]
        if kg.use_llm_relations:
            within = batch.filter(F.col("ord") < kg.max_relation_chunks) if kg.max_relation_chunks else batch
            every = dataclasses.replace(self.config, kg=dataclasses.replace(kg, max_relation_chunks=0))
            out.append((self.triples, stages.extract_triples(within, every, self.providers), keys))
        out.append((self.ledger, batch.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "ord")))
        return out

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of all committed batches; chunks count in order of arrival."""
        done = stored(self.ledger.read())
        place = done.select("chunk_id", "ord")
        # Each table is put beside its chunks once, and mentions stay in their chunk's row.
        said = F.array_sort(F.collect_list(F.struct("pos", "text", "label"))).alias("said")
        mentions = stored(self.mentions.read().groupBy("chunk_id").agg(said).join(place, "chunk_id"))
        triples = stored(self.triples.read().join(place, "chunk_id")) if self.config.kg.use_llm_relations else None
        return graph.build(done, mentions, triples, self.config.kg.cooccurrence, keep=stored)
