"""What the retriever sends about: texts of what stays, names that are asked for, long lists of queries once and not with each mention."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.config import Config, variant
from folioflow.operators import graph
from folioflow.plans import retrieval, search_queries
from folioflow.plans.storage import stored

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def retriever(spark):
    return retrieval.Retriever(variant(Config(), "enhanced"), search_queries.stores(spark, D), search_queries.countable())


def test_texts_are_fetched_for_the_items_that_stay(spark, retriever):
    found = retriever.retrieve(search_queries.questions(spark, D))
    assert "text" in found.columns and "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.groupBy("qid").count().agg(F.max("count")).first()[0] == retriever.config.retrieval.top_k


def test_only_names_in_questions_are_looked_up(spark, retriever, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "stored", lambda df, *by: kept.append(stored(df, *by)) or kept[-1])
    monkeypatch.setattr(retriever, "_linked", None)
    asked = search_queries.questions(spark, D)
    row = lambda df: sorted(map(tuple, df.select("qid", "entity", "name", "surface", "freq", "rank").collect()))
    whole = graph.anchor_index(retriever.stores.nodes, retriever.stores.edges)
    assert row(retriever.linked(asked)) == row(graph.link_entities(whole, asked)) != []
    assert max(t.count() for t in kept) < whole.count() / 4


@pytest.mark.parametrize("least,most", [(1, 2_000_000), (2, 30), (8, 0)])
def test_long_lists_of_queries_are_joined_where_a_chunk_is_put_together(spark, monkeypatch, least, most):
    monkeypatch.setattr(graph, "LONG_LIST", least)
    monkeypatch.setattr(graph, "LISTED", most)
    r = random.Random(4)
    said = {(f"C{c}", f"e{int(40 * r.random() ** 3)}") for c in range(60) for _ in range(8)}
    edges = stored(spark.createDataFrame([(c, e, "MENTIONS") for c, e in sorted(said)], "src string, dst string, key string"))
    nodes = spark.createDataFrame([(f"e{i}", "entity") for i in range(40)], "id string, ntype string")
    linked = spark.createDataFrame([(q, f"e{e}") for q in range(20) for e in r.sample(range(40), 2)], "qid long, entity string")
    got = graph.best_chunks(edges, linked, 1, 9, True, stored)
    want = graph.ranked_chunks(edges, graph.reached_entities(nodes, edges, linked, 1, True)).filter("rank <= 9")
    row = lambda df: sorted((x["qid"], x["rank"], x["chunk_id"], x["score"]) for x in df.collect())
    assert row(got) == row(want) != []
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(nos") < plan.index("Join LeftOuter") < plan.index("RepartitionByExpression [chunk_id")
