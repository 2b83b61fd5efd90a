"""Exact, near, paragraph and substring deduplication against brute force."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import components, dart_minhash, exact_dedup, near_dedup, substring_dedup, suffix_dedup, suffix_sort
from folioflow.llm.hashing import Hasher, word_hashes

VOID = (1 << 63) - 1


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_exact(docs, none, bits):
    groups = collections.defaultdict(list)
    for i, t in rows_of(docs):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    want = collections.Counter()
    for k, v in groups.items():
        for at, (n, void, i) in enumerate(sorted(v)):
            keep = None if min(v)[1] else min(v)[2]
            want[None if void else i, keep, len(v), at == 0, hashlib.sha256(k.encode()).hexdigest()] += 1
    got = exact_dedup.classify(docs, max_bits=bits)
    assert collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got.collect()) == want
    kept = exact_dedup.deduplicate(docs, max_bits=bits)
    assert kept.columns == docs.columns
    stays = [min((-len(t or ""), i is None, i or 0) for i, t in rows_of(docs) if re.sub("[\x20\x09-\x0d]", "", t or "") == k) for k in groups]
    assert collections.Counter((-len(t or ""), i is None, i or 0) for i, t in rows_of(kept)) == collections.Counter(stays)
    assert exact_dedup.classify(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("max_bits", [1 << 15, 1 << 27])
def test_exact_past_the_filters_size(spark, max_bits):
    """30,000 rows need 15 filters of the least size; hardly a row that is unique counts as possibly repeated."""
    rows = [(i, f"text {i}") for i in range(29_000)] + [(40_000 + i, f"te xt{i}") for i in range(1000)] + [(None, "same")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    flagged = exact_dedup.flag_repeats(exact_dedup._keys(df, "doc_id", "text"), max_bits)
    assert flagged.count() == 30_200 and 2200 <= flagged.filter("maybe").count() <= 2900
    kept = exact_dedup.deduplicate(df, max_bits=max_bits)
    assert kept.count() == 29_001 and kept.filter("doc_id is null").count() == 1 and exact_dedup.classify(df, max_bits=max_bits).filter("kept").count() == 29_001


def shingle_set(text, width=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components_of(sets, threshold=0.8):
    u = Union()
    keys = sorted(sets)
    for x in range(len(keys)):
        u.find(keys[x])
        for y in range(x):
            a, b = sets[keys[x]], sets[keys[y]]
            if a and b and len(a & b) >= threshold * len(a | b):
                u.join(keys[x], keys[y])
    return {k: u.find(k) for k in keys}


def bag(text, width=5):
    """A text's shingles as a set of (shingle, occurrence): its Jaccard similarity is the weighted one."""
    w = (text or "").encode().split()
    times, out = collections.Counter(), set()
    for x in [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [tuple(w)] if w else []:
        times[x] += 1
        out.add((x, times[x]))
    return frozenset(out)


def test_near(unique_docs, docs, none):
    want = components_of({i: bag(t) for i, t in rows_of(unique_docs)})
    out = near_dedup.classes(unique_docs).collect()
    assert {r["doc_id"]: r["group_id"] for r in out} == want
    sizes = collections.Counter(want.values())
    assert all(r["group_size"] == sizes[r["group_id"]] and r["kept"] == (r["doc_id"] == r["group_id"]) for r in out)
    kept = near_dedup.keep_one(unique_docs)
    assert kept.columns == unique_docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())
    assert near_dedup.classes(docs).count() == docs.count()  # repeated and null ids don't break it
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_near_weighs_shingles_by_their_number(spark):
    """Families in which sets of shingles are alike and their numbers aren't, and the reverse."""
    r = np.random.default_rng(4)
    line = lambda: " ".join(f"w{x}" for x in r.integers(0, 10**6, 12))
    rows = []
    for family in range(12):
        often, tail = line(), " ".join(line() for _ in range(6))
        for times in (1, 2, 9, 10, 40, 44):
            rows.append((len(rows), f"{f'{often} ' * times}{tail}{' odd' * (family % 3)}"))
    want = components_of({i: bag(t) for i, t in rows})
    assert len(set(want.values())) == 36  # few and few, ten and ten, forty and forty of each family
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["group_id"] for x in got} == want


@pytest.mark.parametrize("full", [0, 256])
def test_near_copies_of_many_versions(spark, monkeypatch, full):
    """Versions of one text that fall into several components, under a phrase that all texts share: as brute force."""
    r = np.random.default_rng(5)
    phrase = " ".join(f"p{x}" for x in range(30))
    rows = []
    for family in range(6):
        words = [f"f{family}x{x}" for x in range(60)]
        for _ in range(25):
            copy = list(words)
            for at in r.integers(0, 60, r.integers(0, 5)):
                copy[at] = f"new{r.integers(0, 3)}"
            rows.append((len(rows), f"{phrase} {' '.join(copy)}"))
    want = components_of({i: bag(t) for i, t in rows})
    assert 6 < len(set(want.values())) < 120
    monkeypatch.setattr(near_dedup.linked_classes, "__defaults__", (0.8, full))  # large buckets and small ones
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x["doc_id"]: x["group_id"] for x in got} == want


def test_parity_bits_differ_in_no_more_places_than_elements():
    r = np.random.default_rng(8)
    for words in (1, 2, 16):
        for _ in range(60):
            a, b = (set(r.integers(0, r.integers(5, 400), r.integers(0, 300)).tolist()) for _ in "ab")
            x = np.array([*a, *b], np.uint64)
            bits = near_dedup.parity_bits(x, np.repeat([0, 2], [len(a), len(b)]), 3, words)
            apart = sum(bin(int(p ^ q) & (1 << 64) - 1).count("1") for p, q in zip(bits[0].tolist(), bits[2].tolist(), strict=True))
            assert apart <= len(a ^ b) and (len(a ^ b) - apart) % 2 == 0 and not bits[1].any()


def test_dart_cells_are_thrown_in_bounded_parts(monkeypatch):
    r = np.random.default_rng(6)
    e, w, owner = r.integers(1, 1 << 63, 300, dtype=np.uint64), r.integers(1, 9, 300), np.sort(r.integers(0, 20, 300))
    whole = dart_minhash.signatures(e, w, owner, 20, 60)
    monkeypatch.setattr(dart_minhash, "CELLS", 500)
    assert (dart_minhash.signatures(e, w, owner, 20, 60) == whole).all()
    assert dart_minhash.signatures(e[:0], w[:0], owner[:0], 2, 60).shape == (2, 60)


def test_near_finds_links_beside_the_bucket_lead(spark):
    """In a chain, neighbours are alike but the ends are not: links that don't pass the bucket's lead count too."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 8 : i * 8 + 200])) for i in range(8)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    assert {r["group_id"] for r in near_dedup.classes(df).collect()} == {0}


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 9), (7, 8), (8, 7), (None, 1), *[(20, k) for k in range(21, 60)]]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9, 7: 7, 8: 7, **{k: 20 for k in range(20, 60)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    e = r.integers(1, 1 << 63, 150, dtype=np.uint64)
    w = r.random(150) * 4 + 0.1
    v = np.where(r.random(150) < 0.5, w, w / 2)
    sig = dart_minhash.signatures(np.concatenate((e, e)), np.concatenate((w, v)), np.repeat([0, 2], 150), 3, 3000)
    assert abs((sig[0] == sig[2]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    assert (sig[1] == 0xFFFFFFFF).all()


def paragraphs_of(text):
    """(start, end, words) of a text's paragraphs; where the cuts fall has its own tests."""
    data = (text or "").encode()
    h = word_hashes([data], Hasher(5))
    starts = h[2][substring_dedup.paragraph_heads([data], *h)].tolist()
    return [(a, b, len(data[a:b].split())) for a, b in zip(starts, [*starts[1:], len(data)], strict=False)]


def words_around(data, place, after):
    """Words on one side of a place, nearest first, and the byte each reaches."""
    each = [(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    return [(w, e) for w, s, e in each if s >= place] if after else [(w, s) for w, s, e in reversed(each) if e <= place]


def removed_of(texts, least=20):
    """Spans that go, by document: runs of paragraphs that repeat an earlier one, with the words around them that
    stand around the earlier one too, of ``least`` words or more."""
    sets = {(i, a, b): shingle_set(texts[i].encode()[a:b].decode()) for i in texts for a, b, _ in paragraphs_of(texts[i])}
    parts = components_of(sets)
    out = {}
    for i in texts:
        runs = []
        for a, b, n in paragraphs_of(texts[i]):
            lead = parts[i, a, b]
            if lead != (i, a, b):
                if runs and runs[-1][1] == a:
                    runs[-1][1:] = [b, runs[-1][2] + n, runs[-1][3], lead]
                else:
                    runs.append([a, b, n, lead, lead])
        gone, spans = set(), []
        for a, b, n, first, last in runs:
            for after, place, (j, x, y) in ((False, a, first), (True, b, last)):
                mine, theirs = words_around(texts[i].encode(), place, after), words_around(texts[j].encode(), y if after else x, after)
                for (w, e), (v, _) in zip(mine, theirs, strict=False):
                    if w != v:
                        break
                    n, a, b = n + 1, (a if after else e), (e if after else b)
            spans += [(a, b)] if n >= least else []
        for a, b in spans:
            gone |= set(range(a, b))
        out[i] = [(a, min(b for b in gone if b >= a and b + 1 not in gone) + 1) for a in sorted(gone) if a - 1 not in gone]
    return out


def test_paragraphs(unique_docs, docs, none):
    texts = dict(rows_of(unique_docs))
    want = removed_of(texts)
    assert any(want.values())
    out = substring_dedup.remove_passages(unique_docs)
    assert out.columns == [c for c in unique_docs.columns if c != "removed"] + ["removed"]
    for r in out.collect():
        t = texts[r["doc_id"]]
        assert [(x["start"], x["end"]) for x in r["removed"]] == want[r["doc_id"]]
        data = (t or "").encode()
        kept = bytes(b for k, b in enumerate(data) if not any(a <= k < e for a, e in want[r["doc_id"]])).decode()
        assert r["text"] == (None if t is None else kept)
    assert substring_dedup.remove_passages(docs).count() == docs.count() and substring_dedup.remove_passages(none).count() == 0


def test_paragraphs_of_rows_that_share_an_id_or_have_none(spark):
    r = np.random.default_rng(7)
    text = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    shared, other = text(90), text(90)
    rows = [(1, shared), (None, f"{text(40)} {shared} {text(40)}"), (None, text(120)), (None, None), (4, f"{text(30)} {other}"), (4, text(80)), (7, f"{other} {text(50)}"), (7, text(70)), (8, text(60)), (8, None)]
    rows += [rows[8], rows[1]]
    out = substring_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    lost = sorted((x["doc_id"] or -1, len(x["removed"])) for x in out)
    assert lost == sorted([(1, 0), (-1, 1), (-1, 1), (-1, 0), (-1, 0), (4, 0), (4, 0), (7, 1), (7, 0), (8, 0), (8, 0), (8, 0)])
    before = {t for _, t in rows}
    assert all(x["text"] in before for x in out if not x["removed"])


def brute_repeats(texts, length=100):
    seen, out = {}, {}
    for i, t in sorted(texts):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen.setdefault(t[s : s + length], (i, s)) != (i, s):
                gone[s : s + length] = b"\1" * length
        out[i] = bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(gone)
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_suffix_removal(docs, none, hot):
    texts = {(VOID if i is None else i, (t or "").encode()) for i, t in rows_of(docs) if i is not None}
    want = brute_repeats(texts)
    some = docs.filter("doc_id is not null")
    out = suffix_dedup.remove_repeats(some, hot=hot).collect()
    assert len(out) == some.count()
    for r in out:
        assert bytes(r["kept"]) == want[r["doc_id"]][0] and sum(x["end"] - x["start"] for x in r["removed"]) == want[r["doc_id"]][1]
    assert suffix_dedup.remove_repeats(docs, hot=hot).count() == docs.count()  # null ids too
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_removal_of_rows_that_share_an_id_or_have_none(spark):
    """Against brute force with documents in the order of (id, text's hash), null ids last."""
    r = np.random.default_rng(9)
    text = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    a, b, c, d = text(700), text(700), text(400), text(300)
    rows = [(1, a), (None, a[:300] + b[:300]), (None, c), (None, None), (2, b), (2, c + d), (2, a[:150]), (3, d[:200] + text(50)), (3, ""), (2, b), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {(x["doc_id"], x["text"]): x["mark"] for x in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS mark").collect()}
    place = {k: n for n, k in enumerate(sorted(order, key=lambda k: (VOID if k[0] is None else k[0], order[k])))}
    want = brute_repeats({(place[k], (k[1] or "").encode()) for k in order})
    got = suffix_dedup.remove_repeats(df).collect()
    key = lambda i, kept, n: (VOID if i is None else i, kept, n)
    assert sorted(key(x["doc_id"], bytes(x["kept"]), sum(s["end"] - s["start"] for s in x["removed"])) for x in got) == sorted(key(i, *want[place[i, t]]) for i, t in rows)


def test_suffix_groups_across_small_batches(monkeypatch):
    """The streaming group step gives the same rows however its input is cut into batches."""
    r = np.random.default_rng(2)
    n = 400
    rows = sorted({(int(a), int(c), int(k), int(p) << 32 | 1) for a, c, k, p in zip(r.integers(0, 30, n), r.integers(0, 6, n), r.integers(0, 50, n), r.integers(0, 9, n), strict=True)})
    columns = [pa.array([x[j] for x in rows]) for j in range(4)]
    batch = pa.RecordBatch.from_arrays(columns, ["anchor", "context", "key", "at"])

    def run(size, limit):
        parts = [batch.slice(s, size) for s in range(0, len(rows), size)]
        return sorted((a, k, at) for b in suffix_dedup._group(iter(parts), limit) for a, k, at in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))

    for limit in (2, 1000):
        whole = [(a, k, at >> 2) for a, k, at in run(len(rows), 1000)]
        for size in (1, 3, 17):
            assert [(a, k, at >> 2) for a, k, at in run(size, limit)] == whole


def test_suffix_array_against_sorting():
    import random

    r = random.Random(3)
    for _ in range(150):
        letters = r.choice([b"ab", b"abc", b"\x00\x01\xff", b"a"])
        strings = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 12))]
        depth = r.choice([7, 10, 21, 40])
        symbols, _ = suffix_sort.lay_out(strings)
        flat = symbols.tolist()
        order = suffix_sort.suffix_array(symbols, depth).tolist()
        heads = [flat[p : flat.index(0, p)][:depth] for p in order]
        assert sorted(order) == list(range(len(flat))) and heads == sorted(heads)


