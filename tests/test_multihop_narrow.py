"""The first chunks of each bridge are found among names; entities of all its chunks meet only where none of these fits."""

from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.operators import graph
from folioflow.plans.storage import stored


def test_entities_of_all_chunks_meet_for_open_bridges_only(spark, monkeypatch):
    mentions = [(f"C{i}", f"entity::t::{name}", "MENTIONS", None, None) for i in range(40) for name in ("hub name", f"side {0 if i < 38 else i}", f"pair {i // 2}")]
    names = sorted({m[1] for m in mentions})
    nodes = spark.createDataFrame([(f"C{i}", "chunk", None, None, f"D{i}", 0) for i in range(40)] + [(n, "entity", "t", n[11:], None, None) for n in names], schemas.NODE)
    edges = spark.createDataFrame(mentions, schemas.EDGE)
    held, only = [], graph._only

    def spied(rows, key, known):
        held.append((rows.count(), only(rows, key, known).count()))
        return only(rows, key, known)

    want = sorted(map(tuple, graph.multihop_candidates(nodes, edges, tries=1000).collect()))
    monkeypatch.setattr(graph, "_only", spied)
    assert sorted(map(tuple, graph.multihop_candidates(nodes, edges, tries=2, keep=stored).collect())) == want
    assert held and held[0][1] < held[0][0]
    assert {b for _, b, _, _ in want} >= {"entity::t::hub name"} and nodes.filter(F.col("ntype") == "entity").count() == len(names)
