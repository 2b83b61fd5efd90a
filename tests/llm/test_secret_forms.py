"""Secret spans against plain loops: many matches, overlaps, ids that say nothing."""

import random
import re

from pyspark.sql import functions as F

from folioflow.llm import secrets

PATTERNS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def plain_base(text):
    out = []
    for k, (_, pattern, group, least) in enumerate(PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(out)


def plain_strands(text):
    base = plain_base(text)
    found = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text)]
    return [s for s in found if all(b[0] >= s[2] or s[0] >= b[2] for b in base)]


def texts():
    r = random.Random(8)
    parts = ["token: ", "secret=", "AKIA", "Q" * 16, "0a" * 12, "é", " ", "x" * 25, "\x01", "password: abc", "api_key='", "zz", "+/", "abcdef0123", "_" * 7, "中"]
    return ["", " ", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(300))]


def test_spans_equal_loops(spark):
    every = texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "i int, t string")
    t = F.col("t")
    for r in df.select("t", secrets.base_spans(t).alias("b"), secrets._strands(t).alias("s")).collect():
        assert [(x.start, x.kind, x.end) for x in r.b] == plain_base(r.t)
        assert [(x.start, x.kind, x.end) for x in r.s] == plain_strands(r.t.replace("\x01", " "))


def test_redaction_equals_a_loop(spark):
    every = [*texts(), " ".join(f"token: abc{i:04d}x" for i in range(3000)), None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(every)], "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    for r in secrets.redact(docs).collect():
        text, at, out = every[r.doc_id], 0, ""
        if text is None:
            assert r.text is None
            continue
        for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in spans[r.doc_id].split(",") if x):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        assert r.text == out + text[at:]


def test_ids_say_nothing(spark):
    r = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = ["the", "quick", "brown", "house", "river", "people", "morning"]
    rows = [(i, " ".join(r.choice(words) for _ in range(80)) + ("" if i % 10 else " " + "".join(r.choice(letters) for _ in range(40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for ids in (F.col("doc_id"), F.lit(None).cast("long"), F.lit(7).cast("long")):
        found.append(sorted(x.spans for x in secrets.report(docs.withColumn("doc_id", ids)).collect()))
    assert found[0] == found[1] == found[2]
    assert sum("random" in s for s in found[0]) >= 25
    tripled = secrets.train(docs.unionAll(docs).unionAll(docs))
    assert tripled.ratio and len(tripled.ratio) == secrets.SIZE**2
