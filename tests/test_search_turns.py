"""Graph search writes and shuffles what it needs only, and documents are counted in turns."""

from pyspark.sql import functions as F

from folioflow.operators import graph
from folioflow.plans import graph_queries
from folioflow.plans.storage import stored

D = "/root/testdata/sf0.001"


def test_documents_are_not_written_for_a_search_between_entities(spark):
    nodes, edges = graph_queries.stored_tables(spark, D, ("entity",), placed=False)
    assert {r["ntype"] for r in nodes.select("ntype").distinct().collect()} == {"entity"}
    assert {r["key"] for r in edges.select("key").distinct().collect()} == {"MENTIONS", "CO_OCCURS", "RELATES"}


def test_other_rows_are_dropped_before_a_shuffle(spark, monkeypatch):
    rows, known = spark.range(100).select(F.concat(F.lit("n"), "id").alias("src")), spark.createDataFrame([("n3",), ("n4",), ("n3",)], "node string")
    assert sorted(r[0] for r in graph._only(rows, "src", known).collect()) == ["n3", "n4"]
    monkeypatch.setattr(graph, "LISTED", 2)
    assert graph._only(rows, "src", known).count() == 100


def test_documents_are_counted_in_turns(spark):
    mentioned = spark.createDataFrame([(f"e{i % 7}", i * 300_000 % 5_000_000) for i in range(70)], "entity string, doc int")
    reached = spark.createDataFrame([(q, f"e{(q * k) % 7}") for q in range(20) for k in range(3)], "qid long, entity string")
    turns = []

    def keep(df, *by):
        turns.append(df.columns)
        return stored(df, *by)

    once = sorted(map(tuple, graph.count_documents(mentioned, reached, keep).collect()))
    assert turns.count(["qid", "n_docs", "first"]) == 1
    assert sorted(map(tuple, graph.count_documents(mentioned, reached, keep, at_once=100).collect())) == once
    assert turns.count(["qid", "n_docs", "first"]) > 4
    pairs = reached.join(mentioned, "entity").groupBy("qid").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("first"))
    assert once == sorted(map(tuple, pairs.collect()))
