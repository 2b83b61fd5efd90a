"""Vectorised 64-bit hashes of substrings, words and word shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * U(pow(base, done, 1 << 64))
        done += more
    return out


class Hasher:
    """Prefix sums of byte values times powers, from which any substring's hash follows at once."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U) | U(1)
        self.up, self.down = np.ones(1, U), np.ones(1, U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            n = max(1 << 20, len(data)) + 1
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        out = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start])


def word_hashes(texts: list[bytes], hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text's number, start, end) of each word of the texts laid end to end; ASCII space parts words."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate(([False], ~SPACE[data]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.searchsorted(np.cumsum(lengths + 1), start, side="right")
    return hasher.of(hasher.sums(data), start, end), owner, start, end


def word_runs(hashes: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text's number) in order: hashes of ``width`` consecutive words.

    A text with fewer words, but some, has one shingle of all its words.
    """
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    starts = np.cumsum(counts) - counts
    each = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    text = np.repeat(np.arange(n_texts), each)
    at = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + starts[text]
    padded = np.concatenate((hashes, np.zeros(width, U)))
    out = np.zeros(len(text), U)
    for i in range(width):
        inside = at + i < (starts + counts)[text]
        out = mixed(out + np.where(inside, padded[at + i], U(i + 1)) * U(BASE))
    return out, text


def shingle_bags(hashes: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text's number, times), distinct and sorted by text."""
    out, text = word_runs(hashes, owner, n_texts, width)
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    new = np.concatenate(([True], (out[1:] != out[:-1]) | (text[1:] != text[:-1]))) if len(out) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return out[first], text[first], np.diff(np.append(first, len(out)))


def small_shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text's number), distinct and sorted by text, of at most 2 ** 20 short texts; shingles have 44 bits."""
    out, text = word_runs(hashes, owner, n_texts, width)
    both = np.sort(text.astype(U) << U(44) | out >> U(20))
    both = both[np.concatenate(([True], both[1:] != both[:-1]))] if len(both) else both
    return both & U((1 << 44) - 1), (both >> U(44)).astype(np.int64)
