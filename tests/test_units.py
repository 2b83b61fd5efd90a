"""Small golden cases of the pipeline's parts, and the cases that the tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow import config
from folioflow.functions import text as tx
from folioflow.models import stand_ins
from folioflow.operators import answering, chunking, evaluation, fusion, graph, layout, qa, search
from folioflow.plans import stages
from folioflow.plans.retrieval import Stores, System
from folioflow.sources import graphml, readers
from folioflow.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v)


@pytest.mark.parametrize("key,doc,page", [("PMC4991227_00003", "PMC4991227", 3), ("oddkey", "oddkey", 0), ("a_1_00002", "a_1", 2)])
def test_page_key(spark, key, doc, page):
    assert one(spark, tx.page_key_doc(lit(key))) == doc and one(spark, tx.page_key_index(lit(key))) == page


@pytest.mark.parametrize("box,want", [((90, 90, 50, 50), (90, 90, 100, 100)), ((200, 200, 10, 10), None), ((10, 10, 0, 5), None), ((10, 10, 20, 20), (10, 10, 30, 30))])
def test_clamp(spark, box, want):
    got = one(spark, layout.clamped(*[lit(float(v)) for v in box], lit(100), lit(100)))
    assert (tuple(got) if got else None) == want


def test_regions_keep_gaps_and_crop_rules(spark):
    ann = "array<struct<id:bigint,category_id:int,bbox:array<double>,category_name:string>>"
    rows = [("D_00001", "D", 1, None, 100, 100, [(7, 5, [0.0, 0.0, 40.0, 40.0], ""), (8, 9, [0.0, 21.0, 5.0, 5.0], ""), (9, 4, [0.0, 50.0, 40.0, 1.0], "")])]
    pages = spark.createDataFrame(rows, f"key string, doc_id string, page_index int, image binary, width int, height int, annotations {ann}")
    got = {r["region_id"]: (r["reading_order"], r["crop_path"]) for r in layout.extract_regions(pages, "c/").collect()}
    assert got == {"D:1:7": (0, "c/D_1_7.png"), "D:1:9": (2, None)}


def pack(texts, top, overlap):
    """The packing rule as a plain loop."""
    out, buf, ids, n = [], [], [], 0

    def flush():
        body = "\n".join(buf).strip()
        if body:
            out.append((body, list(ids)))
        return body[-overlap:] if overlap and body else ""

    for i, t in enumerate(texts):
        if n + len(t) > top and buf:
            tail = flush()
            buf, ids, n = ([tail] if tail else []), [], len(tail)
        buf.append(t)
        ids.append(str(i))
        n += len(t)
    if buf:
        flush()
    return out


def test_packing_against_a_loop(spark):
    r = random.Random(4)
    for top, overlap in ((50, 10), (30, 0), (200, 30)):
        texts = ["".join(r.choice("ab \n") for _ in range(r.randint(1, 60))) for _ in range(60)]
        regions = spark.createDataFrame([(t, str(i)) for i, t in enumerate(texts)], "text string, id string")
        rows = F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("o"), "id", "text")))
        got = regions.agg(chunking.packed(rows, top, overlap).alias("c")).first()["c"]
        assert [(c["text"], c["ids"]) for c in got] == pack(texts, top, overlap)


def test_word_windows(spark):
    words = [f"w{i}" for i in range(130)]
    got = one(spark, chunking.word_windows(lit(" ".join(words)), 50, 10))
    assert len(got) == 3 and got[-1].endswith("w129") and all(len(w.split()) <= 50 for w in got)
    assert one(spark, chunking.word_windows(lit(" a  b "), 50, 10)) == [" a  b "]


def test_text_functions(spark):
    assert one(spark, tx.strip(lit("\n\x1c a b\t"))) == "a b"
    assert one(spark, tx.answer_of(lit("x ANSWER: a Answer: b "))) == "b" and one(spark, tx.answer_of(lit(" plain "))) == "plain"
    assert one(spark, tx.reasoning_of(lit("Reasoning: why\nAnswer: b"))) == "why"
    assert [one(spark, tx.judge_score(lit(s))) for s in ("-0.5", "4/5", "none", ".25")] == [0.5, 1.0, None, 0.25]
    assert one(spark, tx.has_word(lit("the alphamethodology"), lit("alpha method"))) is False
    assert one(spark, tx.has_word(lit("éa.b(c"), lit("a.b"))) is False and one(spark, tx.has_word(lit("x a.b(c"), lit("a.b"))) is True
    assert one(spark, tx.citation_tags(lit("[S2] [S10] [S2] [S1, S3]"))) == ["S10", "S2"]
    assert [one(spark, tx.short_duration(lit(s))) for s in (7.4, 65.0, 3723.0)] == ["7.4s", "1m 05s", "1h 02m 03s"]
    assert one(spark, tx.triples(lit('no [{"subject": "a", "relation": "b", "object": ""}, 3]'))) == []


def test_fusion_order(spark):
    text = [(1, f"c{i}", i + 1) for i in range(5)]
    image = [(1, "v0", 1), (1, "v1", 2)]
    hits = fusion.tagged(spark.createDataFrame(text, "qid int, item string, rank int"), "text", 1.0)
    hits = hits.unionByName(fusion.tagged(spark.createDataFrame(image, "qid int, item string, rank int"), "image", 1.0))
    got = [r["item"] for r in fusion.cut(fusion.fuse(hits)).orderBy("position").collect()]
    assert got == ["c0", "v0", "c1", "v1", "c2"]
    shared = hits.unionByName(fusion.tagged(spark.createDataFrame([(1, "c3", 1)], "qid int, item string, rank int"), "graph", 1.0))
    assert fusion.fuse(shared).orderBy("position").first()["item"] == "c3"


def test_gold_rank(spark):
    arrays = lambda *v: F.array(*[lit(x) for x in v])
    rank = lambda ids, docs, g, d, ok=True: one(spark, evaluation.gold_rank(arrays(*ids), arrays(*docs), lit(g), lit(d), lit(ok)))
    assert rank("abc", ["d1", "d2", "d3"], "b", "d2") == 2
    assert rank("abc", ["d1", "d2", "d3"], "z", "d2") == 2 and rank("abc", ["d1", "d2", "d3"], "z", "d2", False) is None
    assert rank("abcde", ["g", "x", "x", "x", "g"], "e", "g") == 5


@pytest.fixture(scope="module")
def mini(spark):
    chunks = spark.createDataFrame([("C1", "D1", 0, 1), ("C2", "D2", 0, 2)], "chunk_id string, doc_id string, page_index int, ord long")
    mentions = spark.createDataFrame([("C1", 0, "Alpha Method", "method", 1.0), ("C1", 1, "beta result", "result", 1.0), ("C2", 0, "Beta result", "metric", 1.0), ("C2", 1, "gamma signal", "task", 1.0)], "chunk_id string, pos int, text string, label string, score double")
    triples = spark.createDataFrame([("C1", 0, "alpha method", "improves", "Beta Result"), ("C2", 0, "Alpha Method", "shows", "beta result"), ("C2", 1, "delta", "is", "Gamma signal")], "chunk_id string, pos int, subject string, relation string, object string")
    return graph.build(chunks, mentions, triples)


def test_graph(spark, mini, tmp_path):
    nodes, edges = mini
    ids = {r["id"] for r in nodes.filter("ntype = 'entity'").collect()}
    assert ids == {"entity::method::alpha method", "entity::result::beta result", "entity::task::gamma signal", "entity::concept::delta"}
    rel = edges.filter("key = 'RELATES'").collect()
    assert {(r["src"][-12:], r["relation"]) for r in rel} == {("alpha method", "shows"), ("ept::delta", "is")} or {r["relation"] for r in rel} == {"shows", "is"}
    q = spark.createDataFrame([(1, "What is the (Alpha Method)?"), (2, "alphamethodology"), (3, "")], "qid int, question string")
    out = {r["qid"]: r for r in graph.expand(nodes, edges, q).collect()}
    assert set(out) == {1} and out[1]["chunk_ids"] == ["C1", "C2"] and out[1]["entity_names"] == ["Alpha Method"] and out[1]["paths"] == ["Alpha Method --shows--> beta result"]
    cand = [tuple(r) for r in graph.multihop_candidates(nodes, edges).collect()]
    assert ("entity::method::alpha method", "entity::result::beta result", "C1", "C2") in cand
    path = str(tmp_path / "kg.graphml")
    graphml.write_graphml(nodes, edges, path)
    n2, e2 = graphml.read_graphml(spark, path)
    assert sorted(map(str, n2.collect())) == sorted(map(str, nodes.select(*n2.columns).collect())) and e2.count() == edges.count()


def test_merge_graph_keeps_first_label(spark, mini):
    chunks = spark.createDataFrame([("C3", "D3", 0, 3)], "chunk_id string, doc_id string, page_index int, ord long")
    more = graph.build(chunks, spark.createDataFrame([("C3", 0, "beta RESULT", "dataset", 1.0)], "chunk_id string, pos int, text string, label string, score double"))
    nodes, edges = stages.merge_graph(*mini, *more)
    assert nodes.filter("lower(name) = 'beta result'").count() == 1
    assert edges.filter("src = 'C3' and key = 'MENTIONS'").first()["dst"] == "entity::result::beta result"


def test_config():
    base, over = {"a": 1, "nested": {"x": 1, "y": 2}}, {"nested": {"y": 9}, "b": 3}
    assert config.merge(base, over) == {"a": 1, "nested": {"x": 1, "y": 9}, "b": 3} and base["nested"]["y"] == 2
    flags = ("use_sparse", "use_image", "use_graph", "use_rerank")
    for name in ("abl_hybrid", "abl_image", "abl_graph", "abl_rerank"):
        assert sum(getattr(config.variant(config.Config(), name).retrieval, f) for f in flags) == 1
    with pytest.raises(ValueError):
        config.from_dict({"retrieval": {"top_k": "five"}})
    assert config.from_dict({"chunk": {"max_chars": 9}}).chunk.overlap_chars == 150
    with pytest.raises(ValueError):
        readers.pages(None, config.from_dict({"ingest": {"source": "other"}}))


def test_search_ties_nulls_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (4, [0.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.1]) for i in range(5)], "qid long, embedding array<float>")
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    got = search.dense_topk(docs, q, 2).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["vec_id"]) for r in got] == [(i, v) for i in range(5) for v in (1, 3)]
    assert search.dense_topk(docs, q.limit(0), 2).count() == 0


def test_judge_means_and_upgrade(spark):
    rows = spark.createDataFrame([("t", 1.0, 0.5), ("t", None, 1.0)], "qtype string, faithfulness double, answer_relevancy double")
    got = {(r["qtype"], r["metric"]): r["value"] for r in evaluation.judge_means(rows).collect()}
    assert got[("overall", "faithfulness")] == 1.0 and got[("t", "answer_relevancy")] == 0.75
    old = spark.createDataFrame([("q", "c1", "d1")], "question string, gold_chunk_id string, gold_doc_id string")
    r = qa.upgrade(old).first()
    assert (r["qtype"], r["gold_id"], r["gold_kind"]) == ("text", "c1", "chunk")


def test_vision_prompt_blanks_images(spark):
    fields = "doc_id string, page_index int, score double, modality string, text string, chunk_id string, region_id string, crop_path string, source string"
    rows = [(1, 1, "D", 2, 0.5, "image", "wrong caption", None, "D:2:r1", "x.png", "image"), (1, 2, "D", 1, 0.4, "text", "some text", "D:1:c0", None, None, "text_dense")]
    items = spark.createDataFrame(rows, f"qid int, position int, {fields}")
    lists = answering.evidence_lists(items, spark.createDataFrame([(1, "q?"), (2, "none")], "qid int, question string"))
    prompted = answering.prompts(lists, vision=True)
    out = {r["qid"]: r for r in answering.answers(prompted, lambda s, u, i: F.lit("Reasoning: r Answer: 4900 MFI. [S1]")).collect()}
    assert out[1]["text"] == "4900 MFI. [S1]" and out[1]["citations"] == ["D:2:r1"] and out[1]["evidence"][0]["text"] == "wrong caption" and out[2]["citations"] == []
    user = {r["qid"]: r for r in prompted.collect()}
    assert "wrong caption" not in user[1]["user_prompt"] and user[1]["images"] == ["x.png"]


def test_sources(spark, tmp_path):
    import io
    import json
    import tarfile

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (64).to_bytes(4, "big") + (32).to_bytes(4, "big")
    path = tmp_path / "a.tar"
    with tarfile.open(path, "w") as tar:
        for name, data in (("P_00001.png", png), ("P_00001.json", json.dumps({"annotations": [{"id": 1, "category_id": 1, "bbox": [1, 2, 3, 4]}]}).encode()), ("P_00002.png", png), ("Q_1.png", png), ("Q_1.json", b"[]")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    for everywhere in (False, True):
        got = {r["key"]: (r["doc_id"], r["width"], len(r["annotations"])) for r in readers.read_shards(spark, [str(path)], everywhere=everywhere).collect()}
        assert got == {"P_00001": ("P", 64, 1), "Q_1": ("Q", 64, 0)}
    coco = tmp_path / "c.json"
    coco.write_text(json.dumps({"images": [{"id": 1, "file_name": "X_00004.png", "width": 5, "height": 6}, {"id": 2, "file_name": "Y.png", "width": 5, "height": 6}], "annotations": [{"id": 9, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 1, "name": "text"}]}))
    got = {r["key"]: [a["category_name"] for a in r["annotations"]] for r in readers.read_coco(spark, str(coco)).collect()}
    assert got == {"X_00004": ["text"], "Y": []}
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "X_00004.png").write_bytes(png)
    assert [r["page_index"] for r in readers.read_coco(spark, str(coco), str(tmp_path / "img")).collect()] == [4]


def test_streaming_is_idempotent(spark, tmp_path):
    src, out, versions = (str(tmp_path / n) for n in ("src", "out", "versions"))
    rows = lambda *v: spark.createDataFrame(list(v), "id long, v string, n long")
    rows((1, "a", 1), (2, "b", 1)).write.json(src)
    each = lambda b, i: (incremental.append_new(b, out, "id"), incremental.upsert_versions(b, versions, "id", "n", i))
    incremental.start(incremental.read_stream(spark, src, "id long, v string, n long"), each, str(tmp_path / "cp"), once=True).awaitTermination()
    rows((2, "c", 2), (3, "d", 1)).write.mode("append").json(src)
    incremental.start(incremental.read_stream(spark, src, "id long, v string, n long"), each, str(tmp_path / "cp"), once=True).awaitTermination()
    incremental.append_new(rows((3, "again", 9)), out, "id")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted((r["id"], r["v"]) for r in incremental.current(spark, versions).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_system_from_pages_to_metrics(spark):
    providers, cfg = stand_ins(32), config.Config()
    chunks = spark.createDataFrame([(f"D{i}:0:c0", f"D{i}", 0, f"The {n} engine runs on {m} fuel every day", [f"r{i}"], 1, i) for i, (n, m) in enumerate((("Turbo", "Diesel"), ("Rotary", "Petrol"), ("Turbo", "Kerosene")))], "chunk_id string, doc_id string, page_index int, text string, region_ids array<string>, category int, ord long")
    index = stages.index_text(chunks, None, providers)
    assert stages.index_text(chunks, index, providers).count() == 3
    nodes, edges = stages.build_graph(chunks, cfg, providers)
    stores = Stores(index, None, nodes, edges)
    q = spark.createDataFrame([(0, 0, "Which engine runs on Petrol fuel?", "text", "D1:0:c0", "D1")], "qid long, place long, question string, qtype string, gold_id string, gold_doc_id string")
    got = System(config.variant(cfg, "enhanced"), stores, providers).explain(q.select("qid", "question")).first()
    assert got["evidence"][0]["source_id"] == "D1:0:c0" and got["evidence"][0]["cited"]
    values = stages.evaluate(cfg, stores, q, providers, ["baseline", "abl_graph"], judged=("baseline",))
    assert {r["value"] for r in values.filter("metric = 'recall@5'").collect()} == {1.0}
    table = stages.comparison(values, ["abl_graph", "baseline"]).orderBy("place").collect()
    assert [r["variant"] for r in table] == ["abl_graph", "baseline"]
