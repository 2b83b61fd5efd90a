"""Batches of the graph's build are extracted side by side and committed in order."""

import threading

import pytest
from pyspark.sql import functions as F

from folioflow.plans import graph_build
from folioflow.plans.graph_build import GraphBuild
from folioflow.sources.keyed import KeyedTable

from .test_build import CHUNK, config, providers


def test_batches_overlap_and_are_committed_in_order(spark, tmp_path, monkeypatch):
    rows = [(f"C{i}", f"D{i // 5}", 0, f"Alpha Beta m{i}", i) for i in range(50)]
    chunks = spark.createDataFrame(rows, CHUNK)
    together, write = threading.Barrier(3, timeout=60), KeyedTable.write

    def met(self, rows, keys=None):
        if self.path.endswith("/mentions"):
            together.wait()  # breaks where batches come one after the other
        return write(self, rows, keys)

    monkeypatch.setattr(graph_build, "AT_ONCE", 3)
    build = GraphBuild(spark, str(tmp_path / "g"), config(checkpoint_every=10), providers())
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "write", met)
        assert build.run(chunks, most_batches=3) == 3
    order = lambda: [i // 10 for i in sorted(r["ord"] for r in build.ledger.read().collect())]
    assert order() == [0] * 10 + [1] * 10 + [2] * 10
    # The batch after the one that fails is extracted too, but not committed.
    with pytest.raises(Exception, match="broken off"):
        GraphBuild(spark, str(tmp_path / "g"), config(checkpoint_every=10), providers("m34$")).run(chunks)
    assert len(order()) == 30
    assert build.run(chunks) == 2 and sorted(r["ord"] for r in build.ledger.read().collect()) == list(range(50))
    assert build.mentions.read().groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n <> 2").count() == 0
