"""Corpus operators do the whole job, where a shortcut would lose rows or text."""

import hashlib
import random

import pytest

from folioflow.llm import language_id, near_dedup, substring_dedup
from folioflow.llm.hashing import Hasher, word_hashes
from folioflow.llm.queries import op8_paragraph_dedup


def test_passages_inside_and_over_lines(spark, tmp_path):
    r = random.Random(8)
    sentence = lambda: " ".join("".join(r.choice("abcdéghiklmnorstu") for _ in range(r.randint(3, 8))) for _ in range(r.randint(8, 14))) + "."
    text = lambda n: [sentence() for _ in range(n)]
    shared, broken = text(25), text(25)
    docs = [
        (1, " ".join([*text(30), *shared, *text(20)])), (2, " ".join([*text(11), *shared, *text(40)])),  # inside long lines
        (3, "\n".join([*text(9), *broken, *text(9)])), (4, "\n".join([*text(14), *broken, *text(3)])),  # over short lines
        (5, " ".join(text(40))), (6, None), (7, "one two"), (8, "one two"),
    ]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {x["doc_id"]: x for x in substring_dedup.remove_passages(df).collect()}
    texts = dict(docs)
    assert all(out[k]["text"] == texts[k] and not out[k]["removed"] for k in (1, 3, 5, 6, 7, 8))
    for k, passage in ((2, " ".join(shared)), (4, "\n".join(broken))):
        data, spans = texts[k].encode(), out[k]["removed"]
        low = data.index(passage.encode())
        inside = sum(min(s["end"], low + len(passage.encode()) + 1) - max(s["start"], low) for s in spans)
        assert inside >= 0.7 * len(passage.encode()) and sum(s["end"] - s["start"] for s in spans) == inside
        kept = bytes(b for i, b in enumerate(data) if not any(s["start"] <= i < s["end"] for s in spans))
        assert out[k]["text"] == kept.decode()
    got = {x["doc_id"]: x for x in op8_paragraph_dedup(spark, str(tmp_path)).collect()}
    assert {k for k, x in got.items() if x["n_removed"]} == {2, 4}
    assert all(x["kept_sha256"] == hashlib.sha256((out[k]["text"] or "").encode()).hexdigest() for k, x in got.items())


@pytest.mark.parametrize("how", ["on a line", "inside a line", "over short lines"])
def test_passages_of_over_fifty_words_are_found(spark, how):
    """Each of 300 passages of 51 to 120 words stands in two documents; at least 95 % of the later ones lose a part of it."""
    r = random.Random(13)
    words = ["".join(r.choice("abcdeghiklmnorstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]

    def prose(n):
        out = [r.choice(words) for _ in range(n)]
        for k in range(r.randint(5, 15), n, r.randint(6, 16)):
            out[k] += "."
        return out

    rows = []
    for k in range(300):
        passage = prose(r.randint(51, 120))
        body = "\n".join(" ".join(passage[i : i + 9]) for i in range(0, len(passage), 9)) if how == "over short lines" else " ".join(passage)
        gap = "\n" if how == "on a line" else " "
        rows += [(i, f"{' '.join(prose(r.randint(20, 150)))}{gap}{body}{gap}{' '.join(prose(r.randint(20, 150)))}") for i in (k, 1000 + k)]
    out = {x["doc_id"]: x["removed"] for x in substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(out[k] for k in range(300)) and sum(bool(out[1000 + k]) for k in range(300)) >= 285


@pytest.mark.parametrize("sentences", [(6, 16), (14, 40)])
def test_passages_lose_nearly_all_their_words_and_nothing_else(spark, sentences):
    """100 passages a length stand in two texts each: at least 0.9 of the later copies lose 0.9 of the bytes or more."""
    r = random.Random(17)
    words = ["".join(r.choice("abcdeghiklmnorstu") for _ in range(r.randint(2, 9))) for _ in range(6000)]

    def prose(n):
        out = [r.choice(words) for _ in range(n)]
        k = r.randint(3, sentences[1])
        while k < n:
            out[k] += "."
            k += r.randint(*sentences)
        return out

    rows, at = [], {}
    for m, n in enumerate((51, 60, 80, 120)):
        for k in range(100):
            body = " ".join(prose(n))
            for i in (1000 * m + k, 10000 + 1000 * m + k):
                head = " ".join(prose(r.randint(20, 150))) + " "
                at[i] = (len(head), len(head) + len(body))
                rows.append((i, f"{head}{body} {' '.join(prose(r.randint(20, 150)))}"))
    out = {x["doc_id"]: x["removed"] for x in substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for m in range(4):
        shares, outside = [], 0
        for k in range(100):
            assert not out[1000 * m + k]
            i = 10000 + 1000 * m + k
            low, high = at[i]
            inside = sum(max(0, min(s["end"], high) - max(s["start"], low)) for s in out[i])
            # A paragraph at the passage's edge may hold some words from outside and still reach the similarity.
            assert sum(s["end"] - s["start"] for s in out[i]) <= inside + 60
            outside += sum(s["end"] - s["start"] for s in out[i]) - inside
            shares.append(inside / (high - low))
        assert sum(x >= 0.9 for x in shares) >= 90 and outside < 300, (m, outside, shares)


def test_paragraph_heads_depend_on_no_other_text():
    r = random.Random(9)
    texts = [" ".join(r.choice(["ab", "cde.", "f\n", "ghij", "k!"]) for _ in range(r.randint(0, 300))).encode() for _ in range(40)] + [b"ab " * 1000, b""]
    h = word_hashes(texts, Hasher(5))
    heads = substring_dedup.paragraph_heads(texts, *h)
    for k, t in enumerate(texts):
        one = word_hashes([t], Hasher(5))
        alone = substring_dedup.paragraph_heads([t], *one)
        assert heads[h[1] == k].tolist() == alone.tolist()
        starts = one[2][alone].tolist()
        parts = [t[a:b].split() for a, b in zip(starts, [*starts[1:], len(t)], strict=False)]
        assert sum(parts, []) == t.split() and all(len(x) <= substring_dedup.MOST for x in parts)
        assert len(parts) == 1 or all(len(x) > substring_dedup.REACH for x in parts)


def test_near_copies_of_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(10)
    text = lambda: [f"w{r.randrange(10**6)}" for _ in range(80)]
    a, b, c, d, e = text(), text(), text(), text(), text()
    near = lambda t: " ".join([*t[:40], "changed", *t[41:]])
    a, b, c, d, e, a2, b2 = *(" ".join(t) for t in (a, b, c, d, e)), near(a), near(b)
    rows = [(1, a), (7, a2), (7, c), (7, b2), (2, b), (None, a2), (None, d), (None, e), (None, d), (9, e), (9, e), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((x["doc_id"], x["text"]) for x in near_dedup.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, a), (7, c), (2, b), (None, d), (9, e), (None, None), (None, "")], key=repr)
    out = near_dedup.classes(df).collect()
    assert len(out) == len(rows) and sum(x["kept"] for x in out) == len(kept)
    assert sorted((x["group_id"] is None, x["group_id"] or 0, x["group_size"]) for x in out if x["doc_id"] == 7) == [(False, 1, 3), (False, 2, 2), (False, 7, 1)]
    assert sorted(x["group_size"] for x in out if x["doc_id"] is None) == [1, 1, 2, 2, 3, 3]


def test_training_draws_from_distinct_labelled_texts_of_each_language(spark):
    words = "house garden evening rain stone wall river bridge window table".split()
    r = random.Random(11)
    rows = [(f"{' '.join(r.choices(words, k=12))} {i}", None) for i in range(3000)]  # most rows have no label
    rows += [(f"{' '.join(r.choices(words, k=12))}", "en") for _ in range(300)] + [("the same text again", "en")] * 500
    rows += [("тихий вечер в саду", "ru"), ("старая каменная стена", "ru")]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(df, sample_docs=60)
    assert model.languages == ["en", "ru"]
    once = language_id.train(df.distinct(), sample_docs=60)  # copies change nothing
    assert (model.scores == once.scores).all()
    out = language_id.label(spark.createDataFrame([(1, "каменная стена"), (2, "river bridge")], "doc_id long, text string"), model)
    assert {x["doc_id"]: x["lang_pred"] for x in out.collect()} == {1: "ru", 2: "en"}
