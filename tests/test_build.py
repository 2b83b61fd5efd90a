"""The graph in committed batches, and names resolved on a stream."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from folioflow.config import Config
from folioflow.models import stand_ins
from folioflow.plans import stages
from folioflow.plans.graph_build import GraphBuild, numbered
from folioflow.streaming import resolution

CHUNK = "chunk_id string, doc_id string, page_index int, text string, ord long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def providers(fails=None):
    """Capitalised words as entities, a relation between the first two words, and an error at texts that match ``fails``."""
    base = stand_ins()
    guard = lambda c: c if fails is None else F.when(c.rlike(fails), F.raise_error(F.lit("broken off"))).otherwise(c)
    words = lambda c: F.split(c, " ")
    relation = lambda c: F.concat(F.lit('[{"subject": "'), words(c)[0], F.lit('", "relation": "before '), F.char_length(c).cast("string"), F.lit('", "object": "'), words(c)[1], F.lit('"}]'))
    return dataclasses.replace(base, entities=lambda c: base.entities(guard(c)), relations=relation)


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(6)
    names = ["Alpha", "Beta", "alpha", "Gamma", "Delta", "BETA", "Epsilon"]
    rows = [(f"C{i}", f"D{i // 5}", i % 5, " ".join(r.choice(names) + ("x" if r.random() < 0.1 else "") for _ in range(6)) + f" m{i}", 7 * i) for i in range(60)]
    return spark.createDataFrame(rows, CHUNK).repartition(5)


def config(**kg):
    return dataclasses.replace(Config(), kg=dataclasses.replace(Config().kg, **kg))


def test_numbered(spark, chunks):
    got = numbered(chunks, "ord", "chunk_id").select("chunk_id", "ord").collect()
    assert sorted((r["ord"], r["chunk_id"]) for r in got) == [(i, f"C{i}") for i in range(60)]
    assert numbered(chunks.filter("false"), "ord").count() == 0


@pytest.mark.parametrize("budget", [0, 25])
def test_a_build_that_breaks_off_is_taken_up(spark, chunks, tmp_path, budget):
    cfg = config(checkpoint_every=10, max_relation_chunks=budget)
    path = str(tmp_path / "g")
    with pytest.raises(Exception, match="broken off"):
        GraphBuild(spark, path, cfg, providers("m34$")).run(chunks)
    assert sorted(r[0] for r in GraphBuild(spark, path, cfg, providers()).pending(chunks).select("chunk_id").collect()) == sorted(f"C{i}" for i in range(30, 60))
    # What batches 1 to 3 have is not extracted again: it would raise now.
    again = GraphBuild(spark, path, cfg, providers("m[0-9]$|m[12][0-9]$"))
    assert again.run(chunks, most_batches=1) == 1 and again.run(chunks) == 2 and again.run(chunks) == 0
    once = GraphBuild(spark, str(tmp_path / "one"), config(checkpoint_every=0, max_relation_chunks=budget), providers())
    assert once.run(chunks) == 1
    plain = stages.build_graph(numbered(chunks, "ord"), cfg, providers())
    for got, same, want in zip(again.graph(), once.graph(), plain, strict=True):
        assert rows_of(got) == rows_of(same) == rows_of(want)


def test_a_half_written_batch_is_replaced(spark, chunks, tmp_path, monkeypatch):
    cfg = config(checkpoint_every=30)
    build = GraphBuild(spark, str(tmp_path / "g"), cfg, providers())
    monkeypatch.setattr(build.ledger, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        build.run(chunks)
    again = GraphBuild(spark, str(tmp_path / "g"), cfg, providers())
    assert again.mentions.count() > 0 and again.graph()[1].count() == 0 and again.pending(chunks).count() == 60
    again.run(chunks)
    for got, want in zip(again.graph(), stages.build_graph(numbered(chunks, "ord"), cfg, providers()), strict=True):
        assert rows_of(got) == rows_of(want)


def test_segments_are_folded(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr("folioflow.plans.graph_build.MOST_SEGMENTS", 2)
    build = GraphBuild(spark, str(tmp_path / "g"), config(checkpoint_every=15, use_llm_relations=False), providers())
    assert build.run(chunks) == 4
    assert len(build.ledger.snapshot()["segments"]) <= 2 and build.ledger.count() == 60


@pytest.mark.parametrize("cuts", [(400,), (1, 2, 150, 400), (100, 200, 300, 400)])
def test_stream_resolves_as_the_batch_does(spark, tmp_path, cuts):
    r = random.Random(9)
    names = ["Alpha", " alpha", "BETA", "beta ", "Gamma", "", "  ", "delta"]
    uses = [(r.choice(names) + r.choice(["", "", "2"]), r.choice(["method", "task", "concept"]), i // 3, i % 2, i % 3, 0) for i in range(400)]
    first = {}
    for t, lab, *_ in sorted(uses, key=lambda u: u[2:]):
        name = t.lower().strip()
        if name:
            first.setdefault(name, (name, f"entity::{lab}::{name}", lab, t.strip()))
    resolution.use_state_store(spark)
    src, out, at, begin = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "cp"), 0
    ordered = sorted(uses, key=lambda u: u[2:])
    for stop in cuts:  # each run starts the query anew from its checkpoint
        spark.createDataFrame(ordered[begin:stop], resolution.USE).repartition(3).write.mode("append").json(src)
        begin = stop
        found = resolution.resolve_stream(spark.readStream.schema(resolution.USE).json(src))
        found.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted((tuple(x) for x in spark.read.parquet(out).select("name", "id", "label", "surface").collect()), key=repr) == sorted(first.values(), key=repr)
