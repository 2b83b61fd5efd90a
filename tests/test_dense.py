"""Vector search against a full search, with few queries and with more than one block of them."""

import random

import numpy as np
import pytest

from folioflow.operators import search


def full(docs, queries, k):
    out = set()
    for q, v in queries:
        if v is None or not any(v):
            continue
        hits = []
        for d, w in docs:
            if w is not None and any(w):
                a, b = np.array(v, float), np.array(w, float)
                hits.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), d))
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("block,bucket", [(4096, 65_536), (7, 40), (1, 1000), (7, 1)])
def test_topk_equals_a_full_search(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "ROW_BUCKET", bucket if bucket > 1 else 60)
    r = random.Random(block)
    vector = lambda: [float(r.randint(-2, 2)) for _ in range(4)]  # noqa: E731  many ties
    docs = [(f"d{i}", vector()) for i in range(150)] + [("null", None), ("zero", [0.0] * 4)]
    queries = [(i, vector()) for i in range(20)] + [(90, None), (91, [0.0] * 4)]
    d, q = spark.createDataFrame(docs, "key string, v array<float>"), spark.createDataFrame(queries, "qid long, v array<float>")
    got = {(x.qid, x.key, x.score, x["rank"]) for x in search.dense_topk(d, q, 5, "key", "v").collect()}
    assert {(a, b, round(c, 5), e) for a, b, c, e in got} == {(a, b, round(c, 5), e) for a, b, c, e in full(docs, queries, 5)}
    assert search.dense_topk(d, q.filter("qid >= 90"), 5, "key", "v").count() == 0
    assert search.dense_topk(d.filter("false"), q, 5, "key", "v").count() == 0
    assert {x.key for x in search.dense_topk(d.limit(3), q, 5, "key", "v").collect()} <= {k for k, _ in docs}


@pytest.mark.parametrize("most,cells", [(1 << 18, 4_000_000), (1 << 18, 30), (5, 30)])
def test_sparse_topk_equals_a_full_search(spark, monkeypatch, most, cells):
    monkeypatch.setattr(search, "MOST_POSTINGS", most)
    monkeypatch.setattr(search, "SCORE_CELLS", cells)
    r = random.Random(cells)
    weights = lambda: {t: float(r.randint(-1, 3)) for t in r.sample("abcdefghij", r.randint(0, 5))}
    docs = [(i, {**weights(), "the": 1.0}) for i in range(120)] + [(900, None), (901, {}), (902, {"zz": 1.0})]
    queries = [(f"q{i}", weights()) for i in range(15)] + [("the", {"the": 2.0}), ("none", {}), ("null", None), ("odd", {"nowhere": 1.0})]
    want = set()
    for q, a in queries:
        hits = sorted((-sum(a[t] * b[t] for t in a if t in b), d) for d, b in docs if b and a and set(a) & set(b))
        want |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(hits[:4])}
    d, q = spark.createDataFrame(docs, "key long, m map<string,float>"), spark.createDataFrame(queries, "qid string, m map<string,float>")
    assert {(x.qid, x.key, x.score, x["rank"]) for x in search.sparse_topk(d, q, 4, "key", "m").collect()} == want
    assert search.sparse_topk(d, q.filter("qid = 'none'"), 4, "key", "m").count() == 0
    assert search.sparse_topk(d.filter("false"), q, 4, "key", "m").count() == 0
