"""The best chunks and counts of documents, found without scoring all that is reached, equal those of the whole search."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import graph
from folioflow.plans.storage import stored


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(8)
    chunks = [(f"C{i}", f"D{i // 4}", i % 4, i) for i in range(120)]
    mentions = [(c, p, f"name {min(int(r.expovariate(0.12)), 60)}", "task", 1.0) for c, *_ in chunks for p in range(r.randint(1, 3))]
    nodes, edges = graph.build(spark.createDataFrame(chunks, "chunk_id string, doc_id string, page_index int, ord long"), spark.createDataFrame(mentions, "chunk_id string, pos int, text string, label string, score double"), keep=stored)
    linked = spark.createDataFrame([(q, f"entity::task::name {n}") for q, n in ((1, 0), (2, 30), (2, 25), (3, 9), (4, 41), (4, 2))], "qid long, entity string")
    return stored(nodes, "ntype"), stored(edges, "key"), linked.join(nodes.select(F.col("id").alias("entity")), "entity", "left_semi").select("qid", "entity")


@pytest.mark.parametrize("hops,k", [(1, 3), (2, 5), (2, 60)])
def test_top_chunks_are_those_of_the_whole_ranking(small, hops, k):
    nodes, edges, linked = small
    want = graph.ranked_chunks(edges, graph.reached_entities(nodes, edges, linked, hops)).filter(F.col("rank") <= k)
    row = lambda df: sorted((r["qid"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())
    assert row(graph.top_chunks(edges, linked, hops, k, stored)) == row(want) != []


def test_documents_are_counted_as_in_the_lists(small):
    nodes, edges, linked = small
    reached = graph.reached_entities(nodes, edges, linked)
    want = {r["qid"]: (len(r["doc_ids"]), min(int(x[1:]) for x in r["doc_ids"])) for r in graph.reached_documents(nodes, graph.ranked_chunks(edges, reached)).collect()}
    number = nodes.filter("ntype = 'chunk'").select(F.col("id").alias("src"), F.substring("doc_id", 2, 9).cast("int").alias("doc"))
    mentioned = edges.filter("key = 'MENTIONS'").join(number, "src").select(F.col("dst").alias("entity"), "doc")
    assert {r["qid"]: (r["n_docs"], r["first"]) for r in graph.count_documents(mentioned, reached).collect()} == want
