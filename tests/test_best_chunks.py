"""Mentions made in their chunk's row, and the best chunks of queries that reach nearly everything, equal the plain ways."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import graph
from folioflow.plans.storage import stored

CHUNK = "chunk_id string, doc_id string, page_index int, ord long"
FOUND = "chunk_id string, window int, pos int, text string, label string, score double"


@pytest.fixture(scope="module")
def found(spark):
    r = random.Random(12)
    names = [" Alpha", "alpha", "BETA ", "beta", "", "  ", "Gamma", *[f"name {i}" for i in range(40)]]
    return spark.createDataFrame([(f"C{c}", w, p, r.choice(names), r.choice(["task", "method"]), 0.5) for c in range(50) for w in range(2) for p in range(r.randint(0, 9))], FOUND)


def in_rows(found):
    return found.groupBy("chunk_id").agg(F.collect_list(F.struct("window", "pos", "text", "label", "score")).alias("said"))


def test_mentions_in_rows_are_those_of_the_table(found):
    want = graph.distinct_mentions(found).select("chunk_id", "pos", "text", "label", "score")
    listed = graph.distinct_mentions(in_rows(found)).select("chunk_id", F.explode("said").alias("m")).select("chunk_id", "m.pos", "m.text", "m.label", "m.score")
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, want.collect())) != []


@pytest.mark.parametrize("keep", [stored, lambda df, *by: df])
@pytest.mark.parametrize("hops,implied,block", [(1, True, 16_384), (2, True, 3), (2, False, 3)])
def test_best_chunks_are_those_of_the_whole_ranking(spark, found, monkeypatch, hops, implied, block, keep):
    monkeypatch.setattr(graph, "BLOCK", block)
    chunks = spark.createDataFrame([(f"C{i}", f"D{i // 4}", i % 4, i) for i in range(50)], CHUNK)
    nodes, edges = graph.build(chunks, graph.distinct_mentions(in_rows(found)).join(chunks.select("chunk_id", "ord"), "chunk_id"), None, False, keep=stored)
    nodes, edges = stored(nodes, "ntype"), stored(edges, "key")
    entities = sorted(x["id"] for x in nodes.filter("ntype = 'entity'").collect())
    linked = spark.createDataFrame([(f"q{q}", e) for q in range(9) for e in random.Random(q).sample(entities, q % 3 + 1)], "qid string, entity string")
    want = graph.ranked_chunks(edges, graph.reached_entities(nodes, edges, linked, hops, implied)).filter("rank <= 7")
    row = lambda df: sorted((x["qid"], x["rank"], x["chunk_id"], x["score"]) for x in df.collect())
    got = graph.best_chunks(edges, linked, hops, 7, implied, keep)
    assert row(got) == row(want) != []
    # Pairs of a query and a mention are made above the last shuffle by chunk, which carries lists.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(nos") < plan.index("RepartitionByExpression [chunk_id")


def test_build_does_not_shuffle_mentions_of_a_large_table_of_names(spark, found):
    chunks = spark.createDataFrame([(f"C{i}", f"D{i // 4}", i % 4, i) for i in range(50)], CHUNK)
    said = stored(graph.distinct_mentions(in_rows(found.withColumn("label", F.lit("task")).withColumn("text", F.concat("text", F.lit(" "), F.md5(F.concat("text", "chunk_id")))))).join(chunks.select("chunk_id", "ord"), "chunk_id"))
    # The table of names is taken for larger than what may be broadcast; that of contested names is empty.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1500")
        _, edges = graph.build(chunks, said, None, False, keep=stored)
        plan = edges.filter("key = 'MENTIONS'")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hash" not in plan and "BroadcastHashJoin" in plan


def test_texts_are_not_shuffled_for_the_fused_candidates(spark):
    """The candidates are found once, for the items and for the reranker, and are small enough to be sent to the texts."""
    from folioflow.plans import search_queries

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
        plan = search_queries.retrieved(spark, "/root/testdata/sf0.001", "enhanced")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "MapInArrow" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_anchors_are_linked_once_for_the_channel_and_the_paths(spark, monkeypatch):
    from folioflow.config import Config, variant
    from folioflow.plans import retrieval, search_queries

    calls, link = [], graph.link_entities
    monkeypatch.setattr(graph, "link_entities", lambda *a: calls.append(1) or link(*a))
    d = "/root/testdata/sf0.001"
    system = retrieval.System(variant(Config(), "enhanced"), search_queries.stores(spark, d), search_queries.countable())
    system.explain(search_queries.questions(spark, d))
    assert len(calls) == 1
