"""Importance resampling, token-id files and centroid clustering against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioflow.llm import clustering, range_coder, resampling, token_files

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def plain_draw(rows, target, least=20, share=(10, 100), buckets=10_000, seed=2024):
    """Rows of (id, text) to sorted (id, features, weight, score, rank)."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    code = lambda w: zlib.crc32(w.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, x in rows:
        for w in find(x):
            s[code(w)] += 1
    for x in target:
        for w in find(x):
            t[code(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, x in rows:
        words = find(x)
        weight = math.floor(sum(gain[code(w)] for w in words) / len(words)) if words else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = eligible[: share[0] * len(eligible) // share[1]]
    return out, [(r[3], r[0]) for r in drawn]


def check_draw(spark, rows, target, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, score string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resampling.draw(docs, goal, **options).collect()]
    out, drawn = plain_draw(rows, target, **({"share": options["share"]} if "share" in options else {}))
    assert sorted(((*r[:4],) for r in got), key=repr) == sorted(out, key=repr)
    ranked = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r[3], r[0]) for r in ranked] == drawn


def test_draw(spark, monkeypatch):
    r = random.Random(3)
    words = ["Wort", "the", "and", "é中", "x1", "lorem", "9", "Über"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + "\x1c!") for i in range(600)]
    rows += [(None, "the and " * 30)] * 40 + [(7, None), (8, ""), rows[3], (9, "Wort\t" * 20_000)]
    target = ["the lorem the", None, ""]
    check_draw(spark, rows, target)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    check_draw(spark, rows, target, share=(60, 100))
    check_draw(spark, rows, target, share=(0, 100))
    check_draw(spark, rows, [], share=(100, 100))
    check_draw(spark, [], target)


def test_feature_runs():
    at, features, words = resampling.word_buckets([b"A b c", None], 1000, 2)
    assert features.tolist() == [5, 0] and words.tolist() == [3, 0]
    assert at.tolist() == [zlib.crc32(x) % 1000 for x in (b"a", b"b", b"c", b"a b", b"b c")]


@pytest.mark.parametrize("limit", [None, 0, 1, 50, 10_000])
def test_merge(limit):
    r = random.Random(4)
    runs = [sorted(((r.randint(0, 9), r.choice([None, *range(20)]), k) for _ in range(r.randint(0, 90))), key=resampling.order_key) for k in range(13)]
    pieces = [(k, run[i : i + 7]) for k, run in enumerate(runs) for i in range(0, len(run), 7)]
    pieces.sort(key=lambda p: resampling.order_key(p[1][0]))
    got = list(resampling.merge(iter(pieces), limit))
    every = sorted((x for run in runs for x in run), key=resampling.order_key)
    n = len(every) if limit is None else limit
    assert [resampling.order_key(x) for x in got[:n]] == [resampling.order_key(x) for x in every[:n]]
    assert sorted(got, key=repr) == sorted(every, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 70_000])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_000, n), np.zeros(n, int), np.arange(n), np.tile([3, 5, (1 << 24) - 1], n)[:n]):
        for lanes in (1, 3, range_coder.LANES):
            if lanes > 1 or n < 6000:
                block = range_coder.encode_block(ids.astype(np.uint32), lanes)
                assert (range_coder.decode_block(block) == ids).all()


def test_range_coder_gains_from_repeats():
    r = np.random.default_rng(1)
    phrase = r.integers(0, 50_000, 200)
    block = range_coder.encode_block(np.tile(phrase, 1000).astype(np.uint32))
    assert len(block) < 200_000 * 4 / 12


def test_range_coder_notices_damage():
    block = bytearray(range_coder.encode_block(np.arange(3000, dtype=np.uint32) % 700))
    block[-500] ^= 4
    with pytest.raises((ValueError, IndexError)):
        range_coder.decode_block(bytes(block))
    with pytest.raises(ValueError):
        range_coder.decode_block(b"XXXX" + bytes(60))
    with pytest.raises(ValueError):
        range_coder.encode_block(np.array([1 << 24], np.uint32))


def test_token_files(spark, docs, rows, none, tmp_path):
    library = Tokenizer.from_file(VOCAB)
    library.no_truncation()
    library.no_padding()
    for name, block_ids in (("large", token_files.BLOCK_IDS), ("small", 50)):
        path = f"{tmp_path}/{name}"
        token_files.write(docs, path, VOCAB, block_ids=block_ids)
        got = sorted((tuple(r) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
        keys = [r[0] for r in got]
        assert keys == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i))
        at = 0
        for _, start, n, ids in got:
            assert start == at and len(ids) == 4 * n
            at += n
        want = sorted((repr(i), np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t, _ in rows)
        assert sorted((repr(r[0]), bytes(r[3])) for r in got) == want
    token_files.write(none, f"{tmp_path}/none", VOCAB)
    assert token_files.read(spark, f"{tmp_path}/none").count() == 0


def plain_clusters(kept, k, rounds, scale=1024, seed=3):
    """(id, vector) rows to centroids, and to (id, cluster, distance) rows."""
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in kept]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [e for _, e in sorted(v, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def near(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, e in v:
            groups[near(e)[1]].append(e)
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    return centroids, [(i, j, d) for i, e in v for d, j in [near(e)]]


@pytest.mark.parametrize("spread", [1, 40, 3000])
def test_clusters(spark, spread):
    r = random.Random(spread)
    vector = lambda: [r.randint(-spread, spread) / 1024 for _ in range(4)]  # noqa: E731  small spreads give many ties
    kept = [(i, vector()) for i in range(400)]
    kept += [(1000 + i, kept[5][1]) for i in range(200)] + [(None, kept[1][1]), kept[2], kept[2], (3, vector())]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 3), (2003, [0.0] * 5), (2004, [0.0, None, 0.0, 0.0]), (2005, [float("nan"), 0.0, 0.0, 0.0]), (2006, [0.0, float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, e, 5, "x") for i, e in kept + bad], "vec_id long, embedding array<double>, cluster int, key string").repartition(4)
    got = clustering.cluster(df, dims=4, k=5, rounds=6).collect()
    centroids, rows = plain_clusters(kept, 5, 6)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(rows, key=repr)
    total = sum(d for _, _, d in rows)
    for x in got:
        assert x.inertia == total and x.cluster_inertia == sum(d for _, j, d in rows if j == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()
    assert clustering.cluster(df.filter("vec_id >= 2000"), dims=4).collect() == []
    assert {x.cluster for x in clustering.cluster(df.filter("vec_id < 2"), dims=4).collect()} <= {0, 1}


def test_bounds_save_distances(spark):
    r = np.random.default_rng(2)
    where = r.integers(-20_000, 20_000, (8, 16))
    v = where[r.integers(0, 8, 3000)] + r.integers(-400, 400, (3000, 16))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, v array<int>")
    start = v[:8] + r.integers(-50, 50, (8, 16))
    _, _, counts = clustering.fit(table, start.astype(np.int64), 5)
    assert counts[0] <= 3000 * 9
    assert all(c < 3000 * 8 / 4 for c in counts[2:])


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [20_000.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="under"):
        clustering.cluster(df, dims=2).collect()
