"""Removal of repeated 100-byte strings across documents, by distributed suffix sorting.

Every 100-byte string (window) has one anchor: the 32-byte string in it with the least hash, leftmost
among equals. Equal windows have equal anchors at equal places, so windows can be dealt to tasks by
their anchor's hash, and no repeat is missed. Consecutive windows with the same anchor form a
*stretch*; its bytes are its *context*.

1. Each task finds the stretches of its documents: anchor hash, context hash, document, place. Within a
   block, a stretch whose context was met before is settled at once, and neighbours are joined.
2. Stretches are dealt by anchor and sorted. Of those with equal contexts the earliest represents the
   others, all of whose windows start earlier there. Only representatives of anchors with several
   different contexts go on.
3. Their contexts are fetched from the documents and dealt by anchor again. All contexts of a block are
   suffix-sorted in two stages, and neighbours in that order that share 100 bytes are repeats; all but
   the earliest of them are removed.
4. A document's removals are united and cut out.

An anchor with more than ``HOT`` different contexts would make one task too large: its windows are dealt
singly, by their own 100 bytes. Contexts are compared as pairs of independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Hasher, U, mixed
from .suffix_sort import lay_out, long_common, suffix_array
from .workspace import cut, ship

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1  # grams in a window
BLOCK = 1 << 20
SORT_BYTES = 1_000_000
HOT = 20_000
VOID = (1 << 63) - 1  # stands for a null id
SETTLED, OPEN, HOT_OPEN = 0, 1, 2


def pack_place(low: np.ndarray, span: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """First window's place, number of windows after it, and kind, in one number."""
    return (low.astype(np.int64) << 32) | (span.astype(np.int64) << 2) | kind


def unpack_place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 32, (at >> 2) & ((1 << 30) - 1), at & 3


class Finder:
    def __init__(self):
        self.one, self.two = Hasher(1), Hasher(2)

    def stretches(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(anchor hash, context hash, text's number, first window, windows after it) of each stretch."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        windows = np.maximum(lengths - LENGTH + 1, 0)
        if not windows.any():
            none = np.zeros(0, np.int64)
            return none.astype(U), none.astype(U), none, none, none
        starts = np.cumsum(lengths) - lengths
        sums = self.one.sums(data)
        n = len(data) - GRAM + 1
        gram = mixed((sums[GRAM:] - sums[:-GRAM]) * self.one.down[:n])
        bits = U(max(1, int(n).bit_length()))
        low = (U(1) << bits) - U(1)
        least = (gram & ~low) | np.arange(n, dtype=U)
        width = 1
        while 2 * width <= REACH:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < REACH:
            rest = REACH - width
            least = np.minimum(least[:-rest], least[rest:])
        anchor_at = (least & low).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
        anchor = anchor_at[place]
        fresh = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])))
        first = np.flatnonzero(fresh)
        final = np.concatenate((first[1:], [len(anchor)])) - 1
        lo, hi, anchor, owner = place[first], place[final], anchor[first], owner[first]
        other = self.two.sums(data)
        context = self.two.of(other, lo, hi + LENGTH) ^ mixed(((anchor - lo) << 20 | (hi - lo)).astype(U))
        return gram[anchor], context, owner, lo - starts[owner], hi - lo


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    for batch in batches:
        keys, texts = batch.column("key").to_numpy(), batch.column("data").to_pylist()
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        group = (np.cumsum(sizes) - sizes) // BLOCK
        bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e > s:
                yield _settle_block(finder, keys[s:e], texts[s:e])


def _settle_block(finder: Finder, keys: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Stretches of a block; those whose context an earlier one has are settled and joined with neighbours."""
    anchor, context, owner, lo, span = finder.stretches(texts)
    key = keys[owner]
    order = np.lexsort((lo, key, context, anchor))
    a, c, k, p = anchor[order], context[order], key[order], lo[order]
    repeat = np.zeros(len(order), bool)
    if len(order):
        head = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        repeat[order] = ~head & ((k != k[lead]) | (p != p[lead]))
    # Stretches of a text are in order and adjacent, so a run of settled ones is one range of windows.
    r = np.flatnonzero(repeat)
    if len(r):
        new = np.concatenate(([True], (np.diff(r) != 1) | (owner[r][1:] != owner[r][:-1])))
        first, final = r[new], r[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(r) - 1]))]
        settled = (key[first], lo[first], lo[final] + span[final] - lo[first])
    else:
        settled = (key[:0], lo[:0], span[:0])
    live = ~repeat
    spread = mixed(settled[0].astype(U) ^ mixed(settled[1].astype(U)))
    columns = [
        np.concatenate((_signed(anchor[live]), _signed(spread))),
        np.concatenate((_signed(context[live]), np.zeros(len(spread), np.int64))),
        np.concatenate((key[live], settled[0])),
        np.concatenate((pack_place(lo[live], span[live], OPEN), pack_place(settled[1], settled[2], SETTLED))),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "context", "key", "at"])


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _group(batches: Iterator[pa.RecordBatch], limit: int = HOT) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, context, key and place: settled ranges, and representatives to compare.

    State carried between batches is one anchor's representatives, at most ``limit`` of them.
    """

    def out(anchor, key, at):
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(key), pa.array(at)], ["anchor", "key", "at"])

    carry = None  # rows of the last anchor's representatives, and its latest one
    hot = None  # an anchor that is known to be hot
    for anchor, context, key, at in _batches(batches, ["anchor", "context", "key", "at"]):
        decided = (at & 3) == SETTLED
        if decided.any():
            yield out(anchor[decided], key[decided], at[decided])
            live = ~decided
            anchor, context, key, at = anchor[live], context[live], key[live], at[live]
        if len(anchor) == 0:
            continue
        old = 0 if carry is None else len(carry[0])
        if old:
            anchor, context, key, at = (np.concatenate(x) for x in zip(carry, (anchor, context, key, at), strict=True))
        head = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])))
        lead = np.maximum.accumulate(np.where(head, np.arange(len(anchor)), 0))
        repeat = ~head & ((key != key[lead]) | (at != at[lead]))
        repeat[:old] = False
        if repeat.any():
            yield out(anchor[repeat], key[repeat], at[repeat] & ~np.int64(3))
        anchor, context, key, at = anchor[head], context[head], key[head], at[head]
        groups = np.cumsum(np.concatenate(([True], anchor[1:] != anchor[:-1]))) - 1
        several = np.bincount(groups)[groups] > 1
        closed = groups < groups[-1]
        go = closed & several & (anchor != (hot if hot is not None else anchor[-1]))
        if hot is not None and anchor[0] == hot and closed[0]:
            mine = closed & (anchor == hot)
            mine[0] = False  # the carried representative of a hot anchor has gone out already
            if mine.any():
                yield out(anchor[mine], key[mine], at[mine] ^ np.int64(OPEN ^ HOT_OPEN))
        if go.any():
            yield out(anchor[go], key[go], at[go])
        carry = [x[~closed] for x in (anchor, context, key, at)]
        is_hot = hot is not None and carry[0][0] == hot
        if is_hot or len(carry[0]) > limit:
            send = slice(1, None) if is_hot else slice(0, None)
            if len(carry[0][send]):
                yield out(carry[0][send], carry[2][send], carry[3][send] ^ np.int64(OPEN ^ HOT_OPEN))
            hot = carry[0][0]
            carry = [x[-1:] for x in carry]  # the latest context is needed to know its repeats
        else:
            hot = None
    if carry is not None and hot is None and len(carry[0]) > 1:
        yield out(carry[0], carry[2], carry[3])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the representatives' contexts; windows of hot anchors singly, as hashes of their bytes."""
    finder = Finder()
    for batch in batches:
        anchors, keys, places, data = [], [], [], []
        for key, text, todo in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), batch.column("found").to_pylist(), strict=True):
            hot = [x["at"] for x in todo if x["at"] & 3 == HOT_OPEN]
            for x in todo:
                anchor, at = x["anchor"], x["at"]
                if at & 3 == OPEN:
                    lo, span = at >> 32, (at >> 2) & ((1 << 30) - 1)
                    anchors.append(anchor)
                    keys.append(key)
                    places.append(at)
                    data.append(text[lo : lo + span + LENGTH])
            if hot:
                low, span, _ = unpack_place(np.array(hot, np.int64))
                at = np.repeat(low, span + 1) + np.arange((span + 1).sum()) - np.repeat(np.cumsum(span + 1) - span - 1, span + 1)
                raw = np.frombuffer(text, np.uint8)
                one = _signed(finder.one.of(finder.one.sums(raw), at, at + LENGTH))
                two = _signed(finder.two.of(finder.two.sums(raw), at, at + LENGTH))
                anchors += one.tolist()
                keys += [key] * len(at)
                places += pack_place(at, np.zeros(len(at), np.int64), HOT_OPEN).tolist()
                data += [x.tobytes() for x in two]
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.int64()), pa.array(data, pa.binary())], ["anchor", "key", "at", "data"]
        )


def repeated_windows(keys: np.ndarray, lows: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context's number, first, windows after it): windows that an earlier equal one exists for.

    ``lows`` are the contexts' places in their documents. One suffix sort over all contexts.
    """
    symbols, starts = lay_out(contexts)
    order = suffix_array(symbols, LENGTH)
    lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
    owner_of = np.repeat(np.arange(len(contexts)), lengths + 1)
    inside = np.arange(len(symbols)) - starts[owner_of]
    is_window = inside <= lengths[owner_of] - LENGTH
    order = order[is_window[order]]
    same = long_common(symbols, order, LENGTH)
    member = same.copy()
    member[:-1] |= same[1:]
    order, same = order[member], same[member]
    if len(order) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    group = np.cumsum(~same) - 1
    owner = owner_of[order]
    key, place = keys[owner], lows[owner] + inside[order]
    by = np.lexsort((place, key, group))
    group, key, place, owner, at = group[by], key[by], place[by], owner[by], inside[order][by]
    head = np.concatenate(([True], group[1:] != group[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    repeat = (key != key[lead]) | (place != place[lead])
    owner, at = owner[repeat], at[repeat]
    by = np.lexsort((at, owner))
    owner, at = owner[by], at[by]
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (np.diff(at) != 1))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    final = np.concatenate((first[1:], [len(at)]))[: len(first)] - 1
    return owner[first], at[first], at[final] - at[first]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole anchors are gathered into blocks of ``SORT_BYTES`` and suffix-sorted."""

    def out(key, at):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int64())], ["key", "at"])

    def work(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[1] for r in rows], np.int64)
        low, _, _ = unpack_place(np.array([r[2] for r in rows], np.int64))
        owner, at, span = repeated_windows(keys, low, [r[3] for r in rows])
        return out(keys[owner], pack_place(low[owner] + at, span, SETTLED))

    rows: list[tuple] = []
    held = 0  # bytes gathered
    hot_anchor, firsts = None, {}  # of the latest hot window's hash: the earliest row of each second hash
    for batch in batches:
        gone_key, gone_at = [], []
        columns = [batch.column(n).to_pylist() for n in ("anchor", "key", "at", "data")]
        for row in zip(*columns, strict=True):
            anchor, key, at, data = row
            if at & 3 == HOT_OPEN:
                if anchor != hot_anchor:
                    hot_anchor, firsts = anchor, {}
                if firsts.setdefault(data, (key, at)) != (key, at):
                    gone_key.append(key)
                    gone_at.append(at & ~3)
                continue
            if not rows or anchor != rows[-1][0]:
                if held >= SORT_BYTES:
                    yield work(rows)
                    rows, held = [], 0
            rows.append(row)
            held += len(data)
        if gone_key:
            yield out(gone_key, gone_at)
    if rows:
        yield work(rows)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans = [], []
        for text, lists in zip(batch.column("data").to_pylist(), zip(batch.column("ats").to_pylist(), batch.column("more").to_pylist(), strict=True), strict=True):
            at = np.array([x for xs in lists if xs for x in xs if x & 3 == SETTLED], np.int64)
            low, span, _ = unpack_place(at)
            order = np.argsort(low, kind="stable")
            low, end = low[order], np.minimum((low + span + LENGTH)[order], len(text))
            runs, done, parts = [], 0, []
            if len(low):
                reach = np.maximum.accumulate(end)
                new = np.concatenate(([True], low[1:] > reach[:-1]))
                first = np.flatnonzero(new)
                final = np.concatenate((first[1:], [len(low)])) - 1
                runs = list(zip(low[first].tolist(), reach[final].tolist(), strict=True))
            for s, e in runs:
                parts.append(text[done:s])
                done = e
            kept.append(b"".join([*parts, text[done:]]))
            spans.append([{"start": s, "end": e} for s, e in runs])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array([len(x) for x in batch.column("data").to_pylist()], pa.int64())], ["id", "kept", "removed", "n_bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per document: id, kept (bytes), removed (spans in bytes), n_bytes.

    Texts are UTF-8 bytes, null ones empty; texts under 100 bytes lose nothing. Ids are whole numbers;
    a null id counts as the largest. Rows that repeat an id and text are the same document; rows with one
    id, or none, and different texts are different documents, in the order of their texts' hashes. Only the
    two named columns are read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_, data = F.coalesce(F.col(id_col).cast("long"), F.lit(VOID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data")
    rows = docs.select(id_, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), data)
    named = None
    if rows.groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low < high").isEmpty():
        keyed = rows.select(F.col("id").alias("key"), "data")
    else:
        # Ids don't tell the documents apart: number them in order of id and text's hash.
        named = rows.select("id", "mark").distinct().repartitionByRange(n, "id", "mark").sortWithinPartitions("id", "mark")
        named = cut(named.select("id", "mark", F.monotonically_increasing_id().alias("key")))
        keyed = rows.join(named, ["id", "mark"]).select("key", "data")
    # One exchange of the texts, by document, feeds the search, the fetch and the cutting: all three must
    # ask for the same columns to share it. The same holds for the exchange of what was found.
    dealt = keyed.repartition(n, "key")
    stretches = dealt.mapInArrow(_find, "anchor long, context long, key long, at long")
    sorted_ = stretches.repartition(n, "anchor").sortWithinPartitions("anchor", "context", "key", "at")
    grouped = sorted_.select("anchor", "context", "key", "at").mapInArrow(partial(_group, limit=hot), "anchor long, key long, at long")
    lists = grouped.repartition(n, "key").groupBy("key").agg(F.collect_list(F.struct("anchor", "at")).alias("found"))
    todo = lists.withColumn("found", F.filter("found", lambda x: x["at"].bitwiseAND(F.lit(3)) != SETTLED)).filter(F.size("found") > 0)
    fetched = dealt.join(todo, "key").select("key", "data", "found")
    contexts = fetched.mapInArrow(_contexts, "anchor long, key long, at long, data binary")
    compared = contexts.repartition(n, "anchor").sortWithinPartitions("anchor", "key", "at").mapInArrow(_compare, "key long, at long")
    more = compared.repartition(n, "key").groupBy("key").agg(F.collect_list("at").alias("more"))
    settled = lists.select("key", F.filter(F.transform("found", lambda x: x["at"]), lambda x: x.bitwiseAND(F.lit(3)) == SETTLED).alias("ats"))
    joined = dealt.join(settled, "key", "left").join(more, "key", "left")
    joined = joined.withColumn("id", F.col("key")) if named is None else joined.join(named.select("key", "id"), "key")
    joined = joined.select(F.when(F.col("id") != VOID, F.col("id")).cast(docs.schema[id_col].dataType).alias("id"), "data", "ats", "more")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(_cut_out, f"id {kind}, kept binary, removed array<struct<start:bigint,end:bigint>>, n_bytes long")
    return out.withColumnRenamed("id", id_col)
