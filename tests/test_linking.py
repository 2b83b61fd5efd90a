"""Entity linking against a plain search, with odd word edges and very long runs."""

import random
import re
import time

from folioflow.operators import graph

ANCHOR = "entity string, name string, surface string, freq long"


def linked(names, question, most):
    text = question.lower()
    hits = [(f, n) for n, f in names if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", text)]
    return [n for _, n in sorted(hits)[:most]]


def test_linking_equals_a_plain_search(spark):
    r = random.Random(3)
    parts = ["bert", "a.b", "x-ray", "é", "data", "set", "(q)", "long", "of", "__", "1.5"]
    names = {" ".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(150)} | {"a  b", "bert-data"}
    anchors = [(f"e{i}", n, n, r.randint(1, 40)) for i, n in enumerate(sorted(names))]
    glue = [" ", " ", " ", "(", ")", ", ", "  ", "-", "x", "\n"]
    questions = [(i, "".join(r.choice(parts).upper() + r.choice(glue) for _ in range(r.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, " ")]
    got = {}
    found = graph.link_entities(spark.createDataFrame(anchors, ANCHOR), spark.createDataFrame(questions, "qid long, question string"))
    for x in sorted(found.collect(), key=lambda x: (x.qid, x.rank)):
        got.setdefault(x.qid, []).append(x.name)
    want = {q: linked([(a[1], a[3]) for a in anchors], t, 8) for q, t in questions if t}
    assert got == {q: n for q, n in want.items() if n}
    assert graph.link_entities(spark.createDataFrame([], ANCHOR), spark.createDataFrame(questions, "qid long, question string")).count() == 0


def test_a_long_run_takes_linear_time(spark):
    anchors = spark.createDataFrame([("e", "bert", "BERT", 3), ("f", "a.b", "a.b", 2)], ANCHOR)
    times = []
    for n in (1000, 100_000):
        text = "x" * n + " " + "a.b." * (n // 4) + " (bert)"
        q = spark.createDataFrame([(1, text)], "qid long, question string")
        began = time.time()
        assert [x.name for x in graph.link_entities(anchors, q).orderBy("rank").collect()] == ["a.b", "bert"]
        times.append(time.time() - began)
    assert times[1] < times[0] + 8
