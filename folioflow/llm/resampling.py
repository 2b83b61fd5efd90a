"""Importance resampling towards a target distribution, by hashed word features.

A document's weight is the mean of its features' gains: how much likelier a feature's bucket is in the target
texts than in the documents. With Gumbel noise added, the highest scores are a draw without replacement.

The draw is exact at any size. A histogram of the scores, which are small integers, tells from which score
on documents are drawn, and the rank at which each score begins. Documents from there on are sorted into
runs, partition by partition, and cut by ranges of scores. Each range's runs are merged by a tournament
tree in one streaming pass: pieces of runs arrive in the order of their first keys, and a run has one open piece
at a time. Ranks count on from the documents in higher ranges, and ranking stops with the last one drawn.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import blocks
from .workspace import cut, ship

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: digits, letters, and all beyond ASCII
RUN_ROWS, PIECE_ROWS, RANGE_ROWS = 50_000, 512, 100_000
NEVER = (math.inf,)


def word_buckets(texts: list[bytes | None], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all texts' features end to end, and how many features and words each text has."""
    flat: list[bytes] = []
    features, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = WORD.findall((text or b"").lower())
        before = len(flat)
        flat += found
        for n in range(2, longest + 1):
            flat += [b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)]
        features[k], words[k] = len(flat) - before, len(found)
    return np.fromiter(map(zlib.crc32, flat), np.int64, len(flat)) % buckets, features, words


def bucket_counts(df: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in blocks(batch, "text"):
                count += np.bincount(word_buckets(part.column("text").to_pylist(), buckets, longest)[0], minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])

    ship(df.sparkSession)
    rows = df.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: 1000 times the logarithm of how much likelier it is in the target, rounded down."""
    all_s, all_t, n = int(source.sum()), int(target.sum()), len(source)
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in pairs], np.int64)


def noise(key: object, seed: int) -> int:
    """Gumbel noise of a document, from its id's digest; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for batch in batches:
            for part in blocks(batch, "text"):
                at, features, words = word_buckets(part.column("text").to_pylist(), len(gain), longest)
                upto = np.concatenate(([0], np.cumsum(gain[at])))
                ends = np.cumsum(features)
                weight = (upto[ends] - upto[ends - features]) // np.maximum(features, 1)
                luck = np.array([noise(k, seed) for k in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, (words, features, weight, weight + luck))], names)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


class Tournament:
    """A tree of matches between runs; the run whose next key is smallest wins. It grows as runs join."""

    def __init__(self):
        self.keys: list[tuple] = [NEVER]
        self.winner = [0, 0]

    def put(self, run: int, key: tuple) -> None:
        """Set the next key of a run and replay its matches."""
        while run >= len(self.keys):
            self.grow()
        self.keys[run] = key
        node = (len(self.keys) + run) // 2
        while node:
            self.play(node)
            node //= 2

    def play(self, node: int) -> None:
        a, b = self.winner[2 * node], self.winner[2 * node + 1]
        self.winner[node] = a if self.keys[a] <= self.keys[b] else b

    def grow(self) -> None:
        self.keys += [NEVER] * len(self.keys)
        n = len(self.keys)
        self.winner = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            self.play(node)

    def first(self) -> tuple[int, tuple]:
        run = self.winner[1]
        return run, self.keys[run]


def order_key(row: tuple) -> tuple:
    """Highest score first, then the smaller id, nulls first. ``row`` begins with score and id."""
    return (-row[0], 0) if row[1] is None else (-row[0], 1, row[1])


def merge(pieces: Iterator[tuple[int, list[tuple]]], limit: int | None = None) -> Iterator[tuple]:
    """Rows of sorted runs in order. A run's pieces come as its number and rows; pieces come in the order of their first rows.

    A piece is opened when the merge reaches its first row, so a run has one open piece at a time. After
    ``limit`` rows no matches are played any more: rows that are left come in any order.
    """
    tree, leaf_of, opened, made = Tournament(), {}, {}, 0
    pieces = iter(pieces)
    following = next(pieces, None)
    while limit is None or made < limit:
        leaf, key = tree.first()
        while following is not None and order_key(following[1][0]) <= key:
            run, rows = following
            leaf = leaf_of.setdefault(run, len(leaf_of))
            rest, at = opened.get(leaf, ([], 0))
            opened[leaf] = [rest[at:] + rows, 0]  # of a run's open piece only rows with the same key can be left
            tree.put(leaf, order_key(opened[leaf][0][0]))
            following = next(pieces, None)
            leaf, key = tree.first()
        if key == NEVER:
            return
        rows, at = opened[leaf]
        yield rows[at]
        made += 1
        if at + 1 < len(rows):
            opened[leaf][1] = at + 1
            tree.put(leaf, order_key(rows[at + 1]))
        else:
            del opened[leaf]
            tree.put(leaf, NEVER)
    for rows, at in opened.values():
        yield from rows[at:]
    while following is not None:
        yield from following[1]
        following = next(pieces, None)


def _sorted_runs(drawn: DataFrame, lows: list[int]) -> DataFrame:
    """Rows as pieces of sorted runs, cut by ranges of scores. ``lows`` are the ranges' lowest scores, descending."""
    kind, longs = drawn.schema["doc_id"].dataType, T.ArrayType(T.LongType())
    fields = [("range", T.IntegerType()), ("head_score", T.LongType()), ("head_id", kind), ("run", T.LongType()), ("score", longs), ("doc_id", T.ArrayType(kind)), ("n_features", longs), ("weight", longs)]
    schema = T.StructType([T.StructField(*f) for f in fields])
    upside = [-x for x in lows]
    columns = ["score", "doc_id", "n_features", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, types, rows = TaskContext.get().partitionId() << 32, None, []

        def emit() -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=order_key)
            out, at = [], 0
            while at < len(rows):
                place = bisect_left(upside, -rows[at][0])
                stop = bisect_left(rows, -lows[place] + 1, at, key=lambda r: -r[0])
                piece = rows[at : min(stop, at + PIECE_ROWS)]
                out.append((place, piece[0][0], piece[0][1], number, *map(list, zip(*piece, strict=True))))
                at += len(piece)
            number += 1
            kinds = [pa.int32(), pa.int64(), types[1], pa.int64(), *map(pa.list_, types)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema.names)

        for batch in batches:
            types = [batch.schema.field(c).type for c in columns]
            for s in range(0, batch.num_rows, RUN_ROWS):
                rows += zip(*(batch.column(c).slice(s, RUN_ROWS).to_pylist() for c in columns), strict=True)
                if len(rows) >= RUN_ROWS:
                    yield emit()
                    rows = []
        if rows:
            yield emit()

    return drawn.select(*columns).mapInArrow(run, schema)


def _ranked(pieces: DataFrame, before: list[int], n_draw: int) -> DataFrame:
    """Merge each range's pieces and rank its rows, up to the last one drawn. ``before`` counts rows in higher ranges."""
    kind = pieces.schema["head_id"].dataType
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(n, T.LongType()) for n in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def stream() -> Iterator[tuple]:
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field("head_id").type
                for k in range(batch.num_rows):
                    place, number, *lists = (batch.column(c)[k].as_py() for c in ("range", "run", "score", "doc_id", "n_features", "weight"))
                    yield place, number, list(zip(*lists, strict=True))

        def table(out: list[tuple]) -> pa.RecordBatch:
            score, doc_id, n_features, weight, rank = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc_id, id_type), *(pa.array(c, pa.int64()) for c in (n_features, weight, score, rank))], names)

        for place, group in groupby(stream(), key=lambda x: x[0]):
            left, out = n_draw - before[place], []
            for i, row in enumerate(merge(((n, rows) for _, n, rows in group), left)):
                out.append((*row, before[place] + i + 1 if i < left else None))
                if len(out) == RUN_ROWS:
                    yield table(out)
                    out = []
            if out:
                yield table(out)

    order = ("range", F.col("head_score").desc(), F.col("head_id").asc_nulls_first())
    return pieces.repartitionById(len(before), F.col("range")).sortWithinPartitions(*order).mapInArrow(run, schema)


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, longest: int = 1, seed: int = 2024, least_words: int = 20, share: tuple[int, int] = (10, 100)) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, and rank for those drawn, else null.

    Null and empty texts have no features, weight 0 and the noise alone as their score. Rows that share an id
    have the same noise and are ranked each for itself; rows that tie in score and id are drawn in any order. A
    null id counts as an empty one and as the smallest. An empty target makes all rare buckets likelier; an empty
    table gives no rows. Of other columns, whatever their names, none is read. The driver sees bucket counts and
    the histogram of scores; a score is a logarithm in thousandths, so there are some 100,000 different ones at most.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, text_col, buckets, longest))
    scored = cut(score(docs, gain, id_col, text_col, longest, seed))
    eligible = scored.filter(F.col("n_words") >= least_words)
    histogram = sorted(((r["score"], r["n"]) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    n_draw = share[0] * sum(n for _, n in histogram) // share[1]
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = lambda df: df.select(*columns, F.lit(None).cast("long").alias("rank"))
    if not n_draw:
        return undrawn(scored).withColumnRenamed("doc_id", id_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(RANGE_ROWS, -(-n_draw // parts))
    lows, before, passed, held = [], [], 0, 0
    for value, n in histogram:
        if not held:
            before.append(passed)
            lows.append(value)
        passed, held, lows[-1] = passed + n, held + n, value
        if held >= size or passed >= n_draw:
            held = 0
        if passed >= n_draw:
            break
    high = (F.col("n_words") >= least_words) & (F.col("score") >= lows[-1])
    ranked = _ranked(_sorted_runs(scored.filter(high), lows), before, n_draw)
    return ranked.unionByName(undrawn(scored.filter(~high))).withColumnRenamed("doc_id", id_col)
