"""Byte-level BPE encoding by a pair occurrence index, and decoding.

Texts are cut into pieces by the vocabulary's pattern. The pieces that a worker has not seen yet are
laid end to end as one linked list of symbols. An index maps each mergeable pair's rank to all places
where the pair stands. Active ranks are taken in ascending order: all places of a rank are merged at
once, and the pairs that this makes go into the lists of their own ranks. A merge makes only pairs of
higher ranks, so one ascending sweep merges every piece just as merging it alone would.

Ids travel as packed little-endian unsigned 32-bit integers (``ids``), the form that checksums and
token files use.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .workspace import ship

#: Fixed: white space in the pattern language of the vocabulary.
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
BLOCK_CHARS = 6_000_000
CACHE_PIECES = 600_000


def _ranges(kind: str, last: int) -> str:
    """A character class's inside for all code points of a general category up to ``last``."""
    out, start = [], None
    for cp in range(last + 2):
        inside = cp <= last and unicodedata.category(chr(cp))[0] == kind
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{cp - 1:08x}")
            start = None
    return "".join(out)


def piece_pattern(last: int = sys.maxunicode) -> re.Pattern:
    """Contractions, then runs of letters, of numbers and of other marks with a space before, then white space.

    It holds for texts without code points over ``last``; small classes match faster.
    """
    letter, number = _ranges("L", last), _ranges("N", last)
    space = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SPACES if b <= last)
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.left = [ids[a] for a, _ in pairs]
        self.right = [ids[b] for _, b in pairs]
        self.made = [ids[a + b] for a, b in pairs]
        keys = (np.array(self.left, np.int64) << 32) | np.array(self.right, np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 for pairs that don't merge; negative ids never do."""
        keys = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and how many each piece has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        owner = np.repeat(np.arange(len(pieces)), lengths)
        place = np.arange(len(owner)) + owner + 1  # one gap before each piece and one at the end
        n = len(owner) + len(pieces) + 1
        sym = np.full(n, -1, np.int64)
        sym[place] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            hit = ranks >= 0
            places, ranks = places[hit], ranks[hit]
            if len(ranks) == 0:
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for s, e in zip(bounds, bounds[1:], strict=False):
                r = int(ranks[s])
                if r in index:
                    index[r].append(places[s:e])
                else:
                    index[r] = [places[s:e]]
                    heapq.heappush(active, r)

        enter(np.arange(n - 1), self.ranks(sym[:-1], sym[1:]))
        fresh = np.zeros(n + 1, bool)
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, c = self.left[r], self.right[r], self.made[r]
            p = p[sym[p] == a]
            q = after[p]
            still = sym[q] == b
            p, q = p[still], q[still]
            if len(p) == 0:
                continue
            if a == b and len(p) > 1:  # in a run such as aaa the first two merge: take every other place
                order = np.argsort(p)
                p, q = p[order], q[order]
                first = np.concatenate(([True], p[1:] != q[:-1]))
                at = np.arange(len(p))
                odd = (at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0
                p, q = p[odd], q[odd]
            sym[p], sym[q] = c, -2
            following = after[q]
            after[p] = following
            before[following] = p
            fresh[p] = True
            previous = before[p]
            left = previous[~fresh[previous]]  # a fresh neighbour enters the shared pair as its right one
            fresh[p] = False
            places = np.concatenate((p, left))
            enter(places, self.ranks(sym[places], sym[after[places]]))
        alive = sym >= 0
        counts = np.bincount(owner[alive[place]], minlength=len(pieces)) if len(pieces) else np.zeros(0, np.int64)
        return sym[alive].astype(np.uint32), counts


class Encoder:
    """Encodes blocks of texts; keeps the ids of pieces it has met, at most ``CACHE_PIECES`` between blocks."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.ascii, self.basic, self.full = (piece_pattern(last) for last in (0x7F, 0xFFFF, sys.maxunicode))
        self.split = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")") if self.vocabulary.special else None
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.values, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        return (self.full if wide else self.basic).findall(text)

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.vocabulary.special):
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(self.split.split(text)):
            out += [("\0" + part)] if i % 2 else self.find(part)  # marked: no piece of two kinds starts so
        return out

    def learn(self, cut: list[list[str]]) -> None:
        new = list(set().union(*cut).difference(self.code))
        if not new:
            return
        special = self.vocabulary.special
        marked = [w for w in new if w[0] == "\0" and w[1:] in special]
        plain = [w for w in new if not (w[0] == "\0" and w[1:] in special)]
        ids, counts = self.vocabulary.merge([w.encode("utf-8") for w in plain])
        ids = np.concatenate((ids, np.array([special[w[1:]] for w in marked], np.uint32)))
        counts = np.concatenate((counts, np.ones(len(marked), np.int64)))
        base = len(self.code)
        self.code.update(zip(plain + marked, range(base, base + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.values) + np.cumsum(counts) - counts))
        self.lengths = np.concatenate((self.lengths, counts))
        self.values = np.concatenate((self.values, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        if len(self.code) > CACHE_PIECES:
            self.forget()
        cut = [self.pieces(t) for t in texts]
        self.learn(cut)
        out = []
        for words in cut:
            codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
            lengths = self.lengths[codes]
            ends = np.cumsum(lengths)
            shift = self.starts[codes] - (ends - lengths)
            out.append(self.values[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids, special tokens included; bytes that aren't UTF-8 become replacement characters."""
    lengths = vocabulary.lengths[ids]
    ends = np.cumsum(lengths)
    shift = vocabulary.starts[ids] - (ends - lengths)
    data = vocabulary.flat[np.repeat(shift, lengths) + np.arange(ends[-1] if len(ends) else 0)]
    return data.tobytes().decode("utf-8", "replace")


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``limit`` bytes of a text column, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for s, e in zip(bounds, bounds[1:], strict=False):
        yield batch.slice(s, e - s)


def tokenise(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with its text column replaced by packed ids in ``ids_col``, the last column.

    Whole texts are encoded; null counts as empty and gives empty ids. Strings of special tokens in a
    text become those tokens. Other columns ride along untouched, whatever their names; a column that
    is named like ``ids_col`` is replaced. Empty tables give empty results.
    """
    others = [f for f in docs.schema.fields if f.name not in (text_col, ids_col)]
    schema = T.StructType([*others, T.StructField(ids_col, T.BinaryType())])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder = encoder(vocab_path)
        for batch in batches:
            for part in blocks(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                packed = pa.array([x.astype("<u4").tobytes() for x in coder.encode(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), packed], [*names, ids_col])

    ship(docs.sparkSession)
    return docs.select(*names, text_col).mapInArrow(run, schema)


def detokenise(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids in ``text_col``, the last column; null ids give null."""
    others = [f for f in encoded.schema.fields if f.name != text_col]
    schema = T.StructType([*others, T.StructField(text_col, T.StringType())])
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        vocabulary = encoder(vocab_path).vocabulary
        for batch in batches:
            for part in blocks(batch, ids_col):
                texts = [None if x is None else decode(vocabulary, np.frombuffer(x, "<u4")) for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_col])

    ship(encoded.sparkSession)
    return encoded.select(*names).mapInArrow(run, schema)
