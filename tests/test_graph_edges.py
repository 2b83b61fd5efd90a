"""The graph's edges against a plain build, with names that come under several labels; mentions aren't shuffled for them."""

import random

import pytest

from folioflow.operators import graph
from folioflow.plans.storage import stored

MENTION = "chunk_id string, pos int, text string, label string, score double"
TRIPLE = "chunk_id string, pos int, subject string, relation string, object string"


@pytest.mark.parametrize("keep", [stored, lambda df, *by: df])
def test_build_equals_a_plain_one(spark, keep):
    r = random.Random(4)
    names = ["Alpha", " alpha", "BETA", "beta", "Gamma", "Delta ", "Eps"]
    chunks = [(f"C{i}", f"D{i // 3}", i % 3, 5 * i) for i in range(30)]
    mentions = [(c, p, r.choice(names), r.choice(["task", "task", "method"]), 1.0) for c, *_ in chunks for p in range(r.randint(0, 4))]
    triples = [(c, p, r.choice([*names, "Zeta"]), f"r{r.randint(0, 9)}", r.choice(names)) for c, *_ in chunks for p in range(r.randint(0, 2))]
    norm = lambda t: t.strip().lower()
    order, ids = {c: o for c, _, _, o in chunks}, {}
    uses = [((order[c], 0, p, 0), t, lab) for c, p, t, lab, _ in mentions] + [((order[c], 1, p, side), t, "concept") for c, p, s, _, o in triples for side, t in enumerate((s, o))]
    for _, t, lab in sorted(uses):
        ids.setdefault(norm(t), f"entity::{lab}::{norm(t)}")
    said = {c: [ids[norm(t)] for d, _, t, _, _ in mentions if d == c] for c, *_ in chunks}
    want = {(d, c, "HAS_CHUNK", None, None) for c, d, *_ in chunks} | {(c, e, "MENTIONS", None, None) for c, es in said.items() for e in es}
    want |= {(a, b, "CO_OCCURS", None, None) for es in said.values() for i, a in enumerate(es) for b in es[i + 1 :]}
    last = {(ids[norm(s)], ids[norm(o)]): (rel, c) for c, p, s, rel, o in sorted(triples, key=lambda t: (order[t[0]], t[1]))}
    want |= {(a, b, "RELATES", *v) for (a, b), v in last.items()}
    frame = spark.createDataFrame
    nodes, edges = graph.build(frame(chunks, "chunk_id string, doc_id string, page_index int, ord long"), frame(mentions, MENTION), frame(triples, TRIPLE), keep=keep)
    got = [tuple(x) for x in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert sorted(x["id"] for x in nodes.filter("ntype = 'entity'").collect()) == sorted(ids.values())


def test_listed_mentions_are_not_shuffled(spark):
    chunks = spark.createDataFrame([("C1", "D1", 0, 1, [(0, "Alpha", "task"), (1, "Beta", "task")])], "chunk_id string, doc_id string, page_index int, ord long, said array<struct<pos:int,text:string,label:string>>")
    _, edges = graph.build(chunks.drop("said"), chunks.select("chunk_id", "ord", "said"), keep=stored)
    plan = edges.filter("key = 'MENTIONS'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Exchange range" not in plan
