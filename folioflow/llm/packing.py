"""Order-preserving packing by dynamic programming over window cuts.

A partition's documents form one token stream. A window of at most ``capacity`` tokens may end at a
document's end (free), at a sentence's end (small penalty) or, filled to the brim, anywhere (larger
penalty). With x the places where windows may end and f the least cost of cutting up to a place,

    f(j) = penalty(j) + capacity - x(j) + min over i with x(i) >= x(j) - capacity of f(i) + x(i)

so a monotone queue of f(i) + x(i) gives each transition in amortised constant time. The stream is
worked off in blocks; cuts near a block's end stay open until the next block, so memory is bounded and
blocks leave no padding behind. What is left at the partition's end becomes windows whose lengths are
powers of two, which need no padding, when that is cheaper than padding one window.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import blocks, byte_letters
from .workspace import ship

CAPACITY = 1024
SENTENCE_PENALTY, SPLIT_PENALTY = 2, 16
BLOCK_TOKENS = 1_500_000
LANE = 64  # of places for brimful cuts this close together only the cheapest is followed


class Tokeniser:
    """Ids of whole texts under a byte-level BPE file, and which ids end a sentence."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in data["model"]["vocab"].items()}
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.ends = np.zeros(max([*ranks.values(), *special.values()]) + 1, bool)
        for token, i in ranks.items():
            self.ends[i] = token.rstrip(b'"\')').endswith((b".", b"!", b"?", b"\n"))

    def ids(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return np.asarray(self.coder.encode_ordinary(text), np.uint32)
        return np.asarray(self.coder.encode(text, allowed_special=self.special), np.uint32)


_TOKENISERS: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    if path not in _TOKENISERS:
        _TOKENISERS[path] = Tokeniser(path)
    return _TOKENISERS[path]


def best_cuts(places: np.ndarray, penalties: np.ndarray, capacity: int = CAPACITY, split: int = SPLIT_PENALTY) -> list[int]:
    """Window ends, ascending, of the cheapest way to cut a stream from 0 to the last place.

    ``places`` are the ascending positions where a window may end at the cost in ``penalties``. Where
    no place lies within the last ``split`` tokens of a full window, cutting it mid-sentence is tried.
    """
    xs: list[int] = [0]
    cost: list[float] = [0.0]
    back: list[int] = [-1]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (f + x, state), increasing in both
    forced: deque[list] = deque()  # (place, cost, state): brimful windows to come
    at = 0
    todo = list(zip(places.tolist(), penalties.tolist(), strict=True))
    n = len(todo)

    def brim(state: int) -> None:
        """Let the full window after a state end mid-sentence, unless a place lies close before its end."""
        end = xs[state] + capacity
        if end >= last:
            return
        k = int(np.searchsorted(places, end, side="right")) - 1
        if k >= 0 and places[k] > end - split and places[k] > xs[state]:
            return
        price = cost[state] + split
        if forced and end - forced[-1][0] < LANE:
            if price < forced[-1][1]:
                forced[-1][:] = [end, price, state]
        else:
            forced.append([end, price, state])

    last = todo[-1][0] if n else 0
    sparse = n * 24 < last  # the search for brimful cuts is needed where places are rare
    gaps = np.diff(places, prepend=0) if n else places
    wide = sparse or bool((gaps > split).any())
    if wide:
        brim(0)
    while at < n:
        if forced and forced[0][0] <= todo[at][0]:
            x, price, origin = forced.popleft()
            if x == todo[at][0]:
                continue
            f, i = price, origin
        else:
            x, penalty = todo[at]
            at += 1
            while xs[queue[0][1]] < x - capacity:
                queue.popleft()
            g, i = queue[0]
            f = g + capacity - x + penalty
        state = len(xs)
        xs.append(x)
        cost.append(f)
        back.append(i)
        g = f + x
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, state))
        if wide:
            brim(state)
    out, state = [], len(xs) - 1
    while state > 0:
        out.append(xs[state])
        state = back[state]
    return out[::-1]


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs one partition's stream; ``add`` and ``finish`` yield pieces of documents."""

    def __init__(self, lane: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, lane << 32
        self.ids = np.zeros(0, np.uint32)
        self.docs: list[tuple[object, int, int]] = []  # key, place of its first token (may be negative), length

    def add(self, keys: list, parts: list[np.ndarray], ends: np.ndarray, final: bool) -> dict[str, list]:
        at = len(self.ids)
        stream = np.concatenate([self.ids, *parts]) if parts else self.ids
        for key, part in zip(keys, parts, strict=True):
            self.docs.append((key, at, len(part)))
            at += len(part)
        total = len(stream)
        starts = np.array([d[1] for d in self.docs], np.int64)
        lengths = np.array([d[2] for d in self.docs], np.int64)
        stops = starts + lengths
        sentence = ends[stream]
        sentence[stops[stops <= total] - 1] = True
        places = np.flatnonzero(sentence) + 1
        penalties = np.full(len(places), SENTENCE_PENALTY)
        penalties[np.searchsorted(places, stops)] = 0
        cuts = best_cuts(places, penalties, self.capacity)
        if final:
            start = cuts[-2] if len(cuts) > 1 else 0
            rest = total - start
            lens = powers(rest) if rest else []
            if rest and (len(lens) - 1) * SPLIT_PENALTY < self.capacity - rest:
                cuts = cuts[:-1] + (start + np.cumsum(lens)).tolist()
        else:
            cuts = [c for c in cuts if c <= total - 4 * self.capacity]
        return self.pieces(stream, starts, lengths, stops, cuts)

    def pieces(self, stream, starts, lengths, stops, cuts) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("key", "start", "length", "tokens", "sequence", "offset", "ids")}
        done = cuts[-1] if cuts else 0
        if done:
            bounds = np.unique(np.concatenate(([0], cuts, stops[stops <= done])))
            s, e = bounds[:-1], bounds[1:]
            doc = np.searchsorted(starts, s, side="right") - 1
            edge = np.concatenate(([0], cuts))
            seq = np.searchsorted(edge, s, side="right") - 1
            out["key"] = [self.docs[d][0] for d in doc.tolist()]
            out["start"] = s - starts[doc]
            out["length"] = e - s
            raw = stream.astype("<u4").view(np.uint8).data
            out["ids"] = [bytes(raw[4 * a : 4 * b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            out["tokens"] = lengths[doc]
            out["sequence"] = self.next_id + seq
            out["offset"] = s - edge[seq]
            self.next_id += len(cuts)
        self.ids = stream[done:]
        self.docs = [(k, a - done, n) for (k, a, n), b in zip(self.docs, stops.tolist(), strict=True) if b > done]
        return out


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its text's ids and then id 0, so null and empty texts are one token. Its pieces
    cover it without gaps; a sequence's pieces have gapless offsets from 0. ``ids`` are packed
    little-endian unsigned 32-bit integers. Rows are packed in the order in which their partition has them; repeated rows
    are packed each for itself, other columns are not read, and an empty table gives no rows.
    A ``sequence_id`` is the partition's number times 2 ** 32 plus a count.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField(id_col, kind)]
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(fields + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = tokeniser(vocab_path)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        keys: list = []
        parts: list[np.ndarray] = []
        held, key_type = 0, None
        zero = np.zeros(1, np.uint32)

        def emit(final: bool):
            out = packer.add(keys, parts, coder.ends, final)
            columns = [pa.array(out["key"], key_type), *(pa.array(np.asarray(out[k], np.int64)) for k in ("start", "length", "tokens", "sequence", "offset")), pa.array(out["ids"], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [id_col, *names, "ids"])

        for batch in batches:
            key_type = batch.schema.field(id_col).type
            for part in blocks(batch, text_col):
                for key, text in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist(), strict=True):
                    ids = np.concatenate((coder.ids(text or ""), zero))
                    keys.append(key)
                    parts.append(ids)
                    held += len(ids)
                    if held >= BLOCK_TOKENS:
                        yield emit(False)
                        keys, parts, held = [], [], 0
        if key_type is not None:
            yield emit(True)

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
