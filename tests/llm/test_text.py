"""Encoding, packing, language, quality, secrets and chat against brute force."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import bpe, chat, language_id, packing, quality, queries, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_encoding_and_decoding(docs, none, library):
    out = bpe.tokenise(docs, VOCABULARY, ids_col="ids")
    texts = collections.Counter((r["doc_id"], tuple(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in out.collect()) == texts
    back = bpe.detokenise(out, VOCABULARY)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == collections.Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert bpe.detokenise(bpe.tokenise(none, VOCABULARY), VOCABULARY).count() == 0


def test_encoder_against_the_library(library):
    import random

    r = random.Random(1)
    letters = ["a", "b", "A", "é", "ß", "中", "²", "½", "\n", " ", "  ", "\t", "\x1c", "\x85", "\xa0", "​", "　", "'s", "'LL", "'ll", "<|endoftext|>", "!", "1", "٣", "é", "😀", "\0", "aaaa", "_", "\x0b"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)] + ["a" * 3001, "ab" * 2000, " " * 2000, "", "\n" * 50 + "x"]
    coder = bpe.Encoder(VOCABULARY)
    got = coder.encode(texts)
    assert all(a.tolist() == b.ids for a, b in zip(got, library.encode_batch(texts, add_special_tokens=False), strict=True))
    assert all(bpe.decode(coder.vocabulary, a) == t for a, t in zip(got, texts, strict=True))


def test_packing(docs, unique_docs, none, library):
    out = packing.pack(unique_docs, VOCABULARY).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append(r)
        windows[r["sequence_id"]].append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in unique_docs.collect()}
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes() and {r["doc_tokens"] for r in mine} == {len(ids)}
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()]
        assert all(zlib.crc32(bytes(r["ids"])) is not None and len(r["ids"]) == 4 * r["length"] for r in mine)
    for w in windows.values():
        w.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in w] == [0, *np.cumsum([r["length"] for r in w])[:-1].tolist()] and sum(r["length"] for r in w) <= 1024
    assert sum(r["length"] for r in packing.pack(docs, VOCABULARY).collect()) == sum(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert packing.pack(none, VOCABULARY).count() == 0


def slow_cuts(places, penalties, capacity):
    xs, best = [0, *places], [0.0]
    for j in range(1, len(xs)):
        best.append(min((best[i] + capacity - (xs[j] - xs[i]) + penalties[j - 1] for i in range(j) if xs[j] - xs[i] <= capacity), default=float("inf")))
    return best[-1]


def test_window_cuts_are_optimal():
    r = np.random.default_rng(8)
    for _ in range(200):
        gaps = r.integers(1, 12, r.integers(1, 60))
        places, penalties = np.cumsum(gaps), r.choice([0, 2], len(gaps))
        cuts = packing.best_cuts(places, penalties, capacity=40, split=16)
        cost, last, at = 0, 0, dict(zip(places.tolist(), penalties.tolist(), strict=True))
        for c in cuts:
            assert c - last <= 40
            cost += 40 - (c - last) + at[c]
            last = c
        assert last == places[-1] and cost == slow_cuts(places.tolist(), penalties.tolist(), 40)
    assert packing.best_cuts(np.array([1000]), np.array([0]), capacity=64)[-1] == 1000


def test_language(spark, docs, none):
    english = "the house and the garden were quiet that evening while rain fell on the old stone wall"
    german = "das haus und der garten waren still an diesem abend und regen fiel auf die alte mauer"
    russian = "дом и сад были тихи в тот вечер"
    train = spark.createDataFrame([(f"{english} {i}", "en") for i in range(20)] + [(f"{german} {i}", "de") for i in range(20)] + [(f"{russian} {i}", "ru") for i in range(20)] + [(None, "en"), ("no label", None)], "text string, lang string")
    model = language_id.train(train)
    assert model.languages == ["de", "en", "ru"]
    rows = [(1, english), (2, german), (3, f"{english}. {german}"), (4, None), (5, "123 ²½ --"), (6, ""), (7, "тихий вечер"), (8, "中文字"), (1, english), (9, "word " * 30000)]
    out = {r["doc_id"]: r for r in language_id.label(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "ru"]
    assert [s["lang"] for s in out[3]["spans"]] == ["en", "de"] and 0.4 < out[3]["score"] < 0.7
    assert (english + ". " + german)[out[3]["spans"][0]["start"] : out[3]["spans"][0]["end"]] == english
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert language_id.label(docs, model).count() == docs.count() and language_id.label(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.label(docs, language_id.train(none)).collect()} == {"und"}


def test_viterbi_against_all_paths():
    import itertools

    r = np.random.default_rng(4)
    scores = [r.normal(size=(n, 3)).astype(np.float32) for n in (6, 1, 0, 4)]
    for s, path in zip(scores, language_id.viterbi(scores, 1.0), strict=True):
        value = lambda p, s=s: sum(s[i, x] for i, x in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert len(path) == len(s)
        if len(s):
            assert abs(value(path.tolist()) - max(map(value, itertools.product(range(3), repeat=len(s))))) < 1e-5


def test_language_accuracy_on_held_out(spark):
    from folioflow.llm.queries import op5_language_id

    sf = "/root/testdata/sf0.001"
    import os

    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    hits = op5_language_id(spark, sf).filter("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()["a"]
    assert hits > 0.97


def base_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, none):
    out = quality.judge(docs)
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out.collect())
    want = collections.Counter()
    for r in docs.collect():
        c = base_counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()
    assert quality.judge(none).count() == 0 and quality.keep_good(none).count() == 0


def test_quality_learns_which_rules_to_trust(spark):
    import random

    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice("abcdeorst") for _ in range(r.randint(2, 9))) for _ in range(80)) + "."
    rows = [(i, good(), True) for i in range(80)]
    rows += [(100 + i, " ".join(w + r.choice(["$$$", "###", "&&&"]) for w in good().split()), False) for i in range(8)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in good().split()), False) for i in range(8)]
    rows += [(300 + i, good().replace(" ", " | "), False) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fine boolean")
    out = quality.judge(df).join(df, "doc_id").collect()
    assert all(x["kept"] == x["fine"] for x in out)


ASSIGN = re.compile(r"""(?P<k>(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secrets(docs, none):
    out = secrets.report(docs)
    got = collections.Counter((r["doc_id"], r["base_sha256"]) for r in out.collect())
    assert got == collections.Counter((r["doc_id"], hashlib.sha256(base_spans(r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    r = out.filter("doc_id = 143").first()
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (2, 1, 2)
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}
    assert "hunter22x" not in clean[143] and "AKIA" not in clean[143] and clean[130] is None and "token:abc" in clean[143]
    assert secrets.report(none).count() == 0 and secrets.redact(none).count() == 0


def test_random_strings_score_above_names(spark, docs):
    model = secrets.train(docs)
    random_ones = ["ghp16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY"]
    names = ["keitschberenheittekeit", "------------------------", "/usr/local/share/documents/en", "THISISASHOUTEDSENTENCEOFWORDS"]
    df = spark.createDataFrame([(x,) for x in random_ones + names], "v string")
    got = {r["v"]: r["l"] for r in df.select("v", secrets.likeness(F.col("v"), model).alias("l")).collect()}
    assert min(got[x] for x in random_ones) > model.threshold > max(got[x] for x in names)


def test_chat(spark):
    talk = lambda c, *turns: [(c, i, r, t, "extra") for i, (r, t) in enumerate(turns)]
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    rows = [*talk(1, a, b), *talk(2, a, b, c), *talk(3, a, b, c), *talk(4, a), *talk(5, ("user", "hi "), b), *talk(6, (None, None)), *talk(7, ("user", "")), (None, 0, "user", "lost", "extra"), *talk(2, a)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string")
    out = {r["conv_id"]: r for r in chat.collapse(df).collect()}
    assert {k: r["status"] for k, r in out.items()} == {1: "snapshot", 2: "kept", 3: "copy", 4: "snapshot", 5: "kept", 6: "kept", 7: "copy", None: "kept"}
    assert out[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n" and out[1]["rendered"] is None and out[2]["n_turns"] == 3
    assert chat.collapse(df.limit(0)).count() == 0


def test_quality_model_against_plain_iteration(spark):
    """The fitted model equals a loop over the documents, and what the votes show decides, whatever the table's size."""
    r = np.random.default_rng(12)
    names = [f"vote_{x[0]}" for x in quality.RULES]
    n, k = 4000, len(names)
    bad = r.random(n) < 0.2
    right = np.where(bad[:, None], r.choice([0.9, 0.8, 0.1, 0.02], k)[None, :], 0.97)
    votes = np.where(r.random((n, k)) < right, ~bad[:, None], bad[:, None]).astype(float)
    votes[r.random((n, k)) < 0.15] = np.nan

    def iterate(v, prior, steps=500):
        m = [prior, np.full(k, 0.98), np.full(k, 0.3)]
        for _ in range(steps):
            p, q = np.log(m[0]), np.log(1 - m[0])
            lg = p + np.where(v == 1, np.log(m[1]), np.where(v == 0, np.log(1 - m[1]), 0)).sum(1)
            lb = q + np.where(v == 1, np.log(1 - m[2]), np.where(v == 0, np.log(m[2]), 0)).sum(1)
            g = 1 / (1 + np.exp(lb - lg))
            fit = np.logaddexp(lg, lb).sum()
            rate = lambda yes, no, e: (yes + (0.02 * (yes + no) + 1) * e) / (1.02 * (yes + no) + 1)
            new = [
                (g.sum() + 1) / (len(v) + 2),
                rate((g[:, None] * (v == 1)).sum(0), (g[:, None] * (v == 0)).sum(0), 0.98),
                rate(((1 - g)[:, None] * (v == 0)).sum(0), ((1 - g)[:, None] * (v == 1)).sum(0), 0.3),
            ]
            moved = max(abs(new[0] - m[0]), np.abs(new[1] - m[1]).max(), np.abs(new[2] - m[2]).max())
            m = new
            if moved < 1e-9:
                break
        return fit, m

    rows = [tuple(None if np.isnan(x) else int(x) for x in v) for v in votes]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names)).repartition(4)
    model = quality.fit(df, tolerance=1e-9)
    _, want = max((iterate(votes, p) for p in quality.STARTS), key=lambda x: round(x[0], 3))
    assert abs(model.prior - want[0]) < 1e-6 and np.allclose(model.on_good, want[1], atol=1e-6) and np.allclose(model.on_bad, want[2], atol=1e-6)
    assert np.std(model.on_bad) > 0.1  # rules that see more weigh more
    again = quality.fit(df.unionByName(df).unionByName(df), tolerance=1e-9)
    assert abs(again.prior - model.prior) < 0.002 and np.allclose(again.on_bad, model.on_bad, atol=0.01)
    judged = df.withColumn("p", quality.posterior(model)).collect()
    truth = dict(zip(rows, bad, strict=True))
    assert np.mean([(x["p"] < 0.5) == truth[tuple(x)[:-1]] for x in judged]) > 0.9
    assert quality.fit(df.limit(0)) == quality.start(quality.STARTS[1])


def test_quality_recovers_known_accuracies(spark):
    """Votes drawn with known accuracies give these back, and the data overrule what was expected of a rule."""
    r = np.random.default_rng(5)
    names = [f"vote_{x[0]}" for x in quality.RULES]
    n, k = 20000, len(names)
    bad = r.random(n) < 0.25
    on_good, on_bad = np.array([0.95] * 6 + [0.8, 0.9]), np.array([0.6] * 5 + [0.9, 0.3, 0.05])
    right = r.random((n, k)) < np.where(bad[:, None], on_bad, on_good)
    votes = np.where(right, ~bad[:, None], bad[:, None]).astype(int)
    rows = [tuple(int(x) if u < 0.9 else None for x, u in zip(v, us, strict=True)) for v, us in zip(votes, r.random((n, k)), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    model = quality.fit(df)
    assert abs(model.prior - 0.75) < 0.03
    assert np.abs(np.array(model.on_good) - on_good).max() < 0.05 and np.abs(np.array(model.on_bad) - on_bad).max() < 0.05
    judged = df.withColumn("after", quality.posterior(model) < 0.5).withColumn("before", quality.posterior(quality.start(quality.STARTS[0])) < 0.5).collect()
    truth = dict(zip(rows, bad, strict=True))
    wrong = lambda c: sum(x[c] != truth[tuple(x)[:k]] for x in judged)
    assert wrong("after") < wrong("before")  # the fit decides, and for the better


def test_quality_verdicts_follow_labels(spark):
    """On the given documents no labelled good text that passes the base rules goes and no bad one stays."""
    base = "/root/testdata/sf0.01"
    if not os.path.exists(f"{base}/labels.parquet"):
        pytest.skip("no given tables")
    judged = quality.judge(spark.read.parquet(f"{base}/documents.parquet"))
    labels = spark.read.parquet(f"{base}/labels.parquet").filter("quality is not null")
    rows = judged.join(labels, "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert len(rows) > 200 and all(x["kept"] == (x["quality"] == 1) for x in rows)


def test_chat_of_rows_without_conversation(spark, tmp_path):
    """Rows without an id are conversations of one turn; a long conversation is gathered whole."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(None, 1, "user", "hello"), (None, 1, "user", "hello"), (None, 2, "user", "hello"), (None, 1, None, "other"), (None, None, "user", None), (3, 1, "user", "other"), (3, 2, "user", "more")]
    rows += [(5, k, "user", f"turn {k}") for k in range(3000)] + [(6, k, "user", f"turn {k}") for k in range(2999)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    out = sorted(queries.op2_chat_format(spark, str(tmp_path)).collect(), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(queries.OP2_SQL)
    order = [c[0] for c in cursor.description]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in out))) == sorted(map(repr, cursor.fetchall()))
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["status"]) for r in out) == [
        (0, 1, "copy"), (0, 1, "kept"), (0, 1, "kept"), (0, 1, "snapshot"), (3, 2, "kept"), (5, 3000, "kept"), (6, 2999, "snapshot"),
    ]
