"""Two-stage suffix sorting of many short byte strings at once, to a bounded depth, in numpy.

Stage one sorts directly only the suffixes that are smaller than their successors. Stage two induces
all others: one scan over the buckets of first bytes, in ascending order, puts each suffix that is
larger than its successor behind those already known, since its rank follows from its successor's.
"""

from __future__ import annotations

import numpy as np

WORD = 7  # symbols of nine bits in one sorting key


def lay_out(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1 to 256 of all strings with a 0 after each, and where each string starts."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    data[starts + lengths] = 0
    return data, starts


def smaller_than_next(symbols: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a symbol later; end marks are."""
    n = len(symbols)
    differs = np.concatenate((symbols[:-1] != symbols[1:], [True]))
    at = np.where(differs, np.arange(n), n - 1)
    last = np.minimum.accumulate(at[::-1])[::-1]  # last place of the run that the suffix starts in
    following = np.concatenate((symbols, [1 << 20]))[last + 1]
    return (symbols < following) | (symbols == 0)


def words(symbols: np.ndarray) -> np.ndarray:
    """The next ``WORD`` symbols at each place as one number; nothing counts after an end mark."""
    padded = np.concatenate((symbols, np.zeros(WORD, np.int64)))
    n = len(symbols)
    out, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(WORD):
        part = padded[i : i + n]
        out = (out << 9) | np.where(open_, part, 0)
        open_ &= part != 0
    return out


def sort_direct(places: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first ``depth`` symbols at least; equal ones stay side by side.

    Each round orders the groups that are still tied by their next word.
    """
    order = places[np.argsort(keys[places], kind="stable")]
    k = keys[order]
    same = np.concatenate(([False], k[1:] == k[:-1]))  # tied with the one before
    ended = (k & 511) == 0  # an end mark lies within the word
    for offset in range(WORD, depth, WORD):
        tied = same.copy()
        tied[:-1] |= same[1:]
        tied &= ~ended
        at = np.flatnonzero(tied)
        if len(at) == 0:
            break
        group = np.cumsum(~same[at])
        k = keys[order[at] + offset]
        inner = np.lexsort((k, group))
        k = k[inner]
        order[at] = order[at][inner]
        same[at] = np.concatenate(([False], (k[1:] == k[:-1]) & (group[1:] == group[:-1])))
        ended[at] = (k & 511) == 0
    return order


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``symbols`` in the order of their suffixes, exact to ``depth`` symbols.

    Suffixes that agree to that depth are adjacent. End marks come first.
    """
    n = len(symbols)
    rising = smaller_than_next(symbols)
    keys = np.concatenate((words(symbols), np.zeros(depth + WORD, np.int64)))
    direct = sort_direct(np.flatnonzero(rising), keys, depth)
    first = symbols[direct]
    bounds = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(257)]
    falling = ~rising
    out = []

    def scan(found: np.ndarray, bucket: int) -> np.ndarray:
        """Put what stands before the found suffixes into its buckets; return those of this bucket."""
        before = found[found > 0] - 1
        before = before[falling[before]]
        symbol = symbols[before]
        here = before[symbol == bucket]
        more = symbol > bucket
        before, symbol = before[more], symbol[more].astype(np.uint16)
        if len(before):
            order = np.argsort(symbol, kind="stable")
            before, symbol = before[order], symbol[order]
            cuts = [0, *(np.flatnonzero(symbol[1:] != symbol[:-1]) + 1).tolist(), len(symbol)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                induced[int(symbol[s])].append(before[s:e])
        return here

    for bucket in range(257):
        wave = np.concatenate(induced[bucket]) if induced[bucket] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = scan(wave, bucket)
        settled = direct[bounds[bucket] : bounds[bucket + 1]]
        if len(settled):
            out.append(settled)
            scan(settled, bucket)
    result = np.concatenate(out) if out else np.zeros(0, np.int64)
    assert len(result) == n
    return result


def long_common(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix in ``order`` shares ``length`` symbols with the one before it."""
    same = np.zeros(len(order), bool)
    at = np.arange(1, len(order))
    for offset in range(length):
        if len(at) == 0:
            break
        at = at[symbols[order[at] + offset] == symbols[order[at - 1] + offset]]
    same[at] = True
    return same
