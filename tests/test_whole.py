"""Registered queries do the whole job: against brute force on tables that a shortcut would get wrong."""

import datetime
import hashlib

from folioflow.operators import graph
from folioflow.plans import graph_queries, metric_queries, search_queries, text_queries


def stored(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_gold_is_contained_anywhere(spark, tmp_path):
    passage = "one two  three four five six\nseven eight nine"
    texts = [
        (9, f"before {passage} after"), (4, f"x{passage}y more"), (7, passage), (2, passage.replace("eight", "8")), (3, "short words in here"),
        (5, "one two three four five six\nseven eight nine"), (6, None), (8, ""), (1, "a a a a a a a b"), (10, "ends in a a a a a a c"),
    ]
    items = [(0, passage), (1, "words in"), (2, "nowhere to be found in any of these"), (3, "ort wor"), (4, "a a a a a a c"), (5, "two three four five six\nseven eigh")]
    d = stored(spark, tmp_path, documents=(texts, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    want = {q: min((str(i) for i, t in sorted(texts) if t is not None and b in t), key=int, default=None) for q, b in items}
    assert want[0] == "4" and want[2] is None
    assert {r["qid"]: r["gold_id"] for r in metric_queries.gold(spark, d).collect()} == want


def test_graph_of_whole_texts(spark, tmp_path):
    texts = [(1, " ".join(f"longword{i} of" for i in range(20)) + " longword3"), (2, "short\nones LONGWORD19 anotherone"), (3, None), (4, "")]
    d = stored(spark, tmp_path, documents=([(*x, "en", "src") for x in texts], "doc_id long, text string, lang string, source string"), pages=([(1, "<p>x</p>")], "page_id long, html string"))
    found = search_queries.stores(spark, d)
    edges = found.edges
    words = {f"D{i}": list(dict.fromkeys(w.lower() for w in (t or "").split() if len(w) >= 7)) for i, t in texts}
    of = lambda key: sorted((r["src"], r["dst"]) for r in edges.filter(edges["key"] == key).collect())
    name = "entity::method::"
    assert of("MENTIONS") == sorted((c, name + w) for c, ws in words.items() for w in ws)
    assert found.implied and not of("CO_OCCURS")
    linked = spark.createDataFrame([(1, name + "longword7"), (2, name + "anotherone")], "qid long, entity string")
    reached = graph.reached_entities(found.nodes, edges, linked, 1, implied=True).collect()
    near = lambda w: {x for ws in words.values() if w in ws for x in ws}
    want = {(q, name + x, int(x != w)) for q, w in ((1, "longword7"), (2, "anotherone")) for x in near(w)}
    assert sorted((r["qid"], r["entity"], r["dist"]) for r in reached) == sorted(want)


def test_customers_ask_about_all_parts(spark, tmp_path):
    keys = [1, 5, 12, 13, 20, 399, 400, 1000]
    d = stored(spark, tmp_path, customer=([(k,) for k in keys], "c_custkey long"), part=([(k,) for k in range(1, 701)], "p_partkey long"))
    got = {r["qid"]: r["question"] for r in graph_queries.asked(spark, d).collect()}
    assert got == {k: f"who ships (part {1 + k * 7 % 700}) or Part {1 + k * 3 % 700}, not part 17x?" for k in (20, 400, 1000)}


def test_multihop_bridges_over_all_entities(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    lines = [(o, (o * 3 + n) % 7, (o + n * n) % 3, n, float(n), 1.0, "O", day) for o in range(1, 9) for n in range(1, 4)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp"
    d = stored(spark, tmp_path, lineitem=(lines, schema))
    chunk = {f"C{o * 1000 + n}": (o, {f"entity::part::part {p}", f"entity::supplier::supplier {s}"}) for o, p, s, n, *_ in lines}
    want = set()
    for c1, (doc, names) in chunk.items():
        for b in names:
            fits = [(hashlib.md5(f"42{b}|{c2}".encode()).hexdigest(), a, c2) for a in names - {b} for c2, (other, about) in chunk.items() if b in about and a not in about and other != doc]
            want |= {(a, b, c1, c2) for _, a, c2 in sorted(fits)[:1]}
    row = lambda df: sorted((r["a"], r["b"], r["c1"], r["c2"]) for r in df.collect())
    assert row(graph_queries.multihop_candidates(spark, d)) == sorted(want) and any("supplier" in b for _, b, _, _ in want)
    nodes, edges = graph_queries.tables(spark, d, relations=False)
    for tries in (1, 2):  # few tries leave some to be held against all chunks
        assert row(graph.multihop_candidates(nodes, edges, tries=tries)) == sorted(want)


def test_replies_are_whole_texts(spark, tmp_path):
    long = "".join(f"w{i} é " for i in range(400))
    texts = [(1, long + "[S7] tail"), (2, "[S8] " + long), (5, long + "answer: late [S6]"), (15, long), (4, ""), (6, None), (7, "x")]
    d = stored(spark, tmp_path, documents=(texts, "doc_id long, text string"))
    contents = {r["doc_id"]: r["content"] for r in text_queries.replies(spark, d).collect()}
    for k, t in texts:
        if t is None:
            assert contents[k] is None
            continue
        half = len(t) // 2
        mark = (" ANSWER: draft [S9] " if k % 3 == 0 else "") + ("" if k % 5 == 0 else "\nAnswer: ")
        assert contents[k] == f"Reasoning: {t[:half]}{mark}{t[half:]} [S{1 + k % 3}] [S1] [S1, S2]"
    tags = {r["doc_id"]: r["tags"] for r in text_queries.citation_tags(spark, d).collect()}
    assert tags[1] == "S1,S2,S7" and tags[2] == "S1,S3,S8" and tags[5] == "S1,S3,S6"
    answers = {r["doc_id"]: r["answer"] for r in text_queries.answer_split(spark, d).collect()}
    assert answers[1].startswith(texts[0][1][len(texts[0][1]) // 2 :].strip()) and answers[5].startswith("late [S6]")
    questions = {r["doc_id"]: r["question"] for r in text_queries.question_cleanup(spark, d).collect()}
    assert questions[1] == texts[0][1] + "?"
