"""Repeated passages: paragraph MinHash banding, exact verification, and removal by components.

Paragraphs are made from whole texts by content, so that a passage falls into the same ones wherever it
stands: on lines of its own, inside a longer line, or over several short ones. A cut stands where a hash of
the next two words is the least within ``REACH`` words on both sides, starts of sentences and lines before
all other places. Paragraphs thus have 8 words or more, 15 on average; one of more than ``MOST`` words, as
of a text that says one thing over and over, is cut into equal parts.

Paragraphs with equal sets of five-word shingles are one class; classes that agree in one of ``BANDS`` bands
of ``ROWS`` minima are compared by exact Jaccard similarity, and links make components
(``near_dedup.linked_classes``). Of each component the paragraph that comes first, by document and then
place, stays where it is. The others are repeated.

A passage begins and ends within paragraphs, which it shares with what stands around it. So each run of
repeated paragraphs is extended to both sides, word by word, as long as the words around it equal those
around the paragraph that stays. That needs no more words than the next paragraph's and ``REACH`` + 1: if it
were equal beyond them, its cuts would be too, and it would be repeated itself. (Equal parts of long
paragraphs are the exception; there extension ends with these words.) A run goes if it has ``LEAST`` words or
more then, since less is a turn of phrase and not a passage.

At a similarity of 0.8 a pair misses all 5 bands of 2 rows with a probability of 1 in 165, at 0.9 of 1 in
4,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .hashing import Hasher, U, mixed, small_shingles, word_hashes
from .near_dedup import SHINGLE, THRESHOLD, VOID, band_values, blocks, linked_classes, lists, parity_bits, placed, repeated, set_hashes
from .workspace import cut, drop_folder, shared_folder, ship, spare_name

BANDS, ROWS = 5, 2
REACH, MOST, LEAST = 7, 64, 20
WORDS = 1  # longs of a paragraph's parity bits


def min_signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """Minima of ``k`` multiply-and-add permutations over each item's shingles; all ones without any."""
    rng = np.random.default_rng(11)
    times, plus = rng.integers(1, 1 << 63, (2, k), dtype=U)
    out = np.full((n, k), ~U(0), U)
    if len(elements):
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        some = owner[starts]
        for j in range(k):
            out[some, j] = np.minimum.reduceat(elements * (times[j] | U(1)) + plus[j], starts) >> U(16)
    return out


def paragraph_heads(texts: list[bytes], hashes: np.ndarray, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the words (see ``word_hashes``) begin a paragraph."""
    n = len(hashes)
    if not n:
        return np.zeros(0, bool)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lines = np.cumsum(data == 10)
    strong = np.zeros(n, bool)
    strong[1:] = np.isin(data[end[:-1] - 1], np.frombuffer(b".!?", np.uint8)) | (lines[start[1:]] > lines[end[:-1] - 1])
    after = np.append(np.where(owner[1:] == owner[:-1], hashes[1:], U(0)), U(0))
    score = mixed(hashes + after * U(31)) >> U(2)
    score[~strong] |= U(1 << 62)
    place = np.arange(n) + (owner + 1) * REACH  # texts stand apart, so that none sees another
    wide = np.full(place[-1] + REACH + 1, ~U(0), U)
    wide[place] = score
    least = np.ones(n, bool)
    for k in range(1, REACH + 1):
        least &= (score < wide[place - k]) & (score <= wide[place + k])
    counts = np.bincount(owner, minlength=len(texts))
    at = np.arange(n) - (np.cumsum(counts) - counts)[owner]
    least &= (at > REACH) & (at < counts[owner] - REACH)
    least |= at == 0
    first = np.flatnonzero(least)
    sizes = np.diff(np.append(first, n))
    for s, size in zip(first[sizes > MOST].tolist(), sizes[sizes > MOST].tolist(), strict=True):
        least[s : s + size : -(-size // -(-size // MOST))] = True
    return least


def _parts(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """``make`` for each block's paragraphs: words' hashes, owners, places, heads, and shingles by paragraph."""
    hasher = Hasher(5)
    for batch in batches:
        for part, texts in blocks(batch):
            hashes, owner, start, end = word_hashes(texts, hasher)
            heads = paragraph_heads(texts, hashes, owner, start, end)
            if len(heads):
                first = np.flatnonzero(heads)
                elements, of = small_shingles(hashes, np.cumsum(heads) - 1, len(first), SHINGLE)
                yield make(part, texts, len(hashes), owner[first], start[first], first, elements, of)


def _sign(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    def make(part, texts, n_words, doc, begin, first, elements, of):
        n = len(first)
        counts = np.bincount(of, minlength=n)
        one, two = set_hashes(elements, counts)
        values = band_values(min_signatures(elements << U(20), of, n, bands * rows), bands, rows)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        begin = begin - (np.cumsum(sizes) - sizes)[doc]
        stop = np.append(begin[1:], 0)
        last = np.append(doc[1:] != doc[:-1], True)
        stop[last] = sizes[doc[last]] - 1
        words = np.diff(np.append(first, n_words))
        whole = lambda x: pa.array(x.astype(np.int32))
        columns = [part.column("id").take(pa.array(doc)), part.column("mark").take(pa.array(doc)), whole(begin), whole(stop), whole(words)]
        columns += [pa.array(one), pa.array(two), whole(counts)]
        columns += [lists(parity_bits(elements, of, n, WORDS).ravel(), np.full(n, WORDS)), lists(values.ravel(), np.full(n, bands))]
        return pa.RecordBatch.from_arrays(columns, ["id", "mark", "start", "end", "words", "one", "two", "n", "bits", "bands"])

    return _parts(batches, make)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(part, texts, n_words, doc, begin, first, elements, of):
        counts = np.bincount(of, minlength=len(first))
        return pa.RecordBatch.from_arrays([pa.array(set_hashes(elements, counts)[0]), lists(elements.view(np.int64), counts)], ["class", "items"])

    return _parts(batches, make)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of a text's spots, the hashes of the words on its side, nearest first, and how far each reaches."""
    hasher = Hasher(5)
    for batch in batches:
        for part, texts in blocks(batch):
            hashes, owner, start, end = word_hashes(texts, hasher)
            first = np.flatnonzero(paragraph_heads(texts, hashes, owner, start, end))
            counts = np.bincount(owner, minlength=len(texts))
            stop = np.cumsum(counts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            base = np.cumsum(sizes) - sizes
            spots = part.column("spots").flatten().to_numpy()
            of = np.repeat(np.arange(len(texts)), part.column("spots").value_lengths().to_numpy())
            after = spots & 1
            word = np.searchsorted(start, (spots >> 1) + base[of])
            edges = np.concatenate(([0], first, [len(hashes)]))
            low = np.maximum(edges[np.searchsorted(first, word)] - REACH - 1, (stop - counts)[of])
            high = np.minimum(edges[np.searchsorted(first, word, side="right") + 1] + REACH + 1, stop[of])
            n = np.where(after, high - word, word - low)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            behind = np.repeat(after, n)
            at = np.repeat(word, n) + np.where(behind, step, -1 - step)
            places = (np.where(behind, end[at], start[at]) - np.repeat(base[of], n)).astype(np.int32)
            columns = [part.column("id").take(pa.array(of)), part.column("mark").take(pa.array(of)), pa.array(spots)]
            yield pa.RecordBatch.from_arrays([*columns, lists(hashes[at].view(np.int64), n), lists(places, n)], ["id", "mark", "spot", "near", "places"])


def _extended(docs: DataFrame, runs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, start, end, words) of ``runs``, each with the words on its sides that also stand around its leads.

    ``runs`` have the lead of their first paragraph and of their last one. A spot is twice the place of an
    edge, plus 1 where what comes after it is asked for.
    """
    side = lambda at, lead, lead_at: F.struct(at.alias("spot"), lead["id"].alias("id_b"), lead["mark"].alias("mark_b"), lead_at.alias("spot_b"))
    place = lambda c, k: F.col(c).cast("long") * 2 + k
    first = side(place("start", 0), F.col("first"), place("first.start", 0))
    last = side(place("end", 1), F.col("last"), place("last.end", 1))
    edges = runs.select("id", "mark", "start", "end", "words", F.inline(F.array(first, last)))
    spots = edges.select("id", "mark", "spot").unionByName(edges.select(F.col("id_b").alias("id"), F.col("mark_b").alias("mark"), F.col("spot_b").alias("spot")))
    wanted = cut(spots.groupBy("id", "mark").agg(F.collect_set("spot").alias("spots")))
    key = F.struct("id", "mark")
    texts = bloom.maybe(_keyed(docs, id_col, text_col), key, bloom.of_keys(wanted, key)).join(wanted, ["id", "mark"])
    near = texts.mapInArrow(_around, "id bigint, mark bigint, spot bigint, near array<bigint>, places array<int>")
    near = cut(near.dropDuplicates(["id", "mark", "spot"]), release=True)
    theirs = near.select(F.col("id").alias("id_b"), F.col("mark").alias("mark_b"), F.col("spot").alias("spot_b"), F.col("near").alias("near_b"))
    both = edges.join(near, ["id", "mark", "spot"]).join(theirs, ["id_b", "mark_b", "spot_b"])
    differs = F.array_position(F.zip_with("near", "near_b", lambda a, b: a.eqNullSafe(b)), False)
    both = both.withColumn("more", F.when(differs > 0, differs.cast("int") - 1).otherwise(F.size("near")))
    far = F.coalesce(F.get("places", F.col("more") - 1), (F.col("spot") / 2).cast("int"))
    ends = both.groupBy("id", "mark", F.col("start").alias("s"), F.col("end").alias("e"), "words").agg(F.min(far).alias("start"), F.max(far).alias("end"), F.sum("more").alias("more"))
    return ends.select("id", "mark", "start", "end", (F.col("words") + F.col("more")).alias("words"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, data) of texts: the id as a long, the largest one standing for null, and the text's hash."""
    whole = docs.filter(F.col(text_col).isNotNull())
    return whole.select(F.coalesce(F.col(id_col).cast("long"), F.lit(VOID)).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("binary").alias("data"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, mark, start, end, words, one, two, n, bits, bands) of each paragraph; start and end in bytes."""
    ship(docs.sparkSession)
    schema = "id bigint, mark bigint, start int, end int, words int, one bigint, two bigint, n int, bits array<bigint>, bands array<bigint>"
    return _keyed(docs, id_col, text_col).mapInArrow(lambda batches: _sign(batches, bands, rows), schema)


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: int = LEAST, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(id, mark, spans) of the documents that lose something; spans are (start, end) in bytes, ascending."""
    spark = docs.sparkSession
    # The table is columnar, since most steps need a few of its columns only.
    folder = shared_folder(spark, "paragraphs")
    paragraphs(docs, id_col, text_col, bands, rows).write.parquet(folder)
    table = spark.read.parquet(folder)

    def sets_of(wanted: DataFrame) -> DataFrame:
        # The texts that have a class first are read again for it; no others are shuffled.
        member = bloom.maybe(table.select("one", "id", "mark"), F.col("one"), bloom.of_keys(wanted, F.col("class"))).join(wanted, F.col("one") == F.col("class"), "left_semi")
        member = cut(member.groupBy("one").agg(F.min(F.struct("id", "mark")).alias("key")).select("key.*").distinct())
        key = F.struct("id", "mark")
        texts = bloom.maybe(_keyed(docs, id_col, text_col), key, bloom.of_keys(member, key)).join(member, ["id", "mark"], "left_semi")
        found = texts.select("data").mapInArrow(_sets, "class bigint, items array<bigint>")
        return cut(bloom.maybe(found, F.col("class"), bloom.of_keys(wanted, F.col("class"))).join(wanted, "class", "left_semi").dropDuplicates(["class"]))

    parts = linked_classes(table, sets_of, WORDS, threshold)
    keyed = table.select(F.struct("id", "start", "end", "mark").alias("key"), "words", "one", "two")
    groups = repeated(keyed, parts)
    gone = placed(keyed, groups).filter("key <> lead").select("key.*", "words", "lead").distinct()
    by = Window.partitionBy("id", "mark").orderBy("start")
    runs = gone.withColumn("new", F.when(F.lag("end").over(by) == F.col("start"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    ends = [F.min_by("lead", "start").alias("first"), F.max_by("lead", "start").alias("last")]
    runs = cut(runs.groupBy("id", "mark", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), *ends), release=True)
    spans = _extended(docs, runs, id_col, text_col).filter(F.col("words") >= least)
    # Runs that were extended towards each other may meet.
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    spans = spans.groupBy("id", "mark", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    out = cut(spans.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")), release=True)
    drop_folder(spark, folder)
    return out


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, and ``removed``: their (start, end) in bytes.

    Null texts stay null and lose nothing, nor do texts of fewer than ``least`` words. Ids are whole numbers;
    null counts as the largest. Rows that share an id are told apart by their texts, and rows that repeat an
    id and text are the same document and lose the same. Columns keep their names; one that is called
    ``removed`` is replaced. An empty table gives no rows. A document that certainly loses nothing isn't
    shuffled.
    """
    found = repeated_passages(docs, id_col, text_col, **options)
    names = [c for c in docs.columns if c.lower() != "removed"]
    key, spans, may = (spare_name(docs.columns, c) for c in ("row_key", "spans", "may_match"))
    found = found.select(F.struct("id", "mark").alias(key), F.col("spans").alias(spans))
    keyed = docs.select(*names, F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(VOID)).alias("id"), F.xxhash64(text_col).alias("mark")).alias(key))
    flagged = bloom.flagged(keyed, F.col(key), bloom.of_keys(found, F.col(key)), may)
    kind = "array<struct<start:int,end:int>>"
    same = flagged.filter(~F.col(may)).select(*names, F.array().cast(kind).alias("removed"))
    some = flagged.filter(F.col(may)).join(found, key, "left")
    s, data = F.col(spans), F.col(text_col).cast("binary")

    def piece(i):
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end"])
        stop = F.when(i == F.size(s), F.length(data)).otherwise(F.get(s, i)["start"])
        return F.decode(F.substring(data, begin + 1, stop - begin), "UTF-8")

    kept = F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), piece), "")
    text = F.when(s.isNull(), F.col(text_col)).otherwise(kept)
    some = some.select(*[(text if c == text_col else F.col(c)).alias(c) for c in names], F.coalesce(s, F.array().cast(kind)).alias("removed"))
    return same.unionByName(some)
