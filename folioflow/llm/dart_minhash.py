"""Weighted minwise signatures from hashed darts.

The plane of (weight, rank) above each element is divided into unit cells. A cell holds a Poisson number
of darts, all given by hashes of the element and the cell: each has a weight, a rank and one of ``k``
coordinates. Of the darts under an element's weight, each coordinate keeps the one with the least rank,
and two weighted sets agree in a coordinate with the probability of their weighted Jaccard similarity.

A set of total weight W needs ranks up to about (k ln k + 4k) / W only, so the number of darts hardly
depends on the set's size. Sets that leave a coordinate empty get twice as many ranks.
"""

from __future__ import annotations

import math

import numpy as np

from .hashing import U, mixed

#: Cumulative probabilities of a Poisson variable of mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])

CELLS = 1 << 18  # cells whose darts are thrown at once; an element with more is taken by itself


def _throw(elements, weights, owner, ranks, n_sets: int, k: int) -> np.ndarray:
    """(set, coordinate) table of the least dart: rank in the high 32 bits, the dart's name in the low."""
    table = np.full(n_sets * k, ~U(0), U)
    tall = np.ceil(weights).astype(np.int64)
    cells = tall * ranks[owner]
    bounds = np.searchsorted(np.cumsum(cells), np.arange(CELLS, int(cells.sum()) + CELLS, CELLS), side="left") + 1
    for s, t in zip([0, *bounds.tolist()], bounds.tolist(), strict=False):  # memory for a bounded number of cells at a time
        if t <= s:
            continue
        part = slice(s, t)
        e = np.repeat(np.arange(len(elements))[part], cells[part])
        if len(e) == 0:
            continue
        c = np.arange(len(e)) - np.repeat(np.cumsum(cells[part]) - cells[part], cells[part])
        level, rank = c % tall[e], c // tall[e]
        cell = mixed(elements[e] ^ mixed((rank.astype(U) << U(24)) | level.astype(U)))
        darts = np.searchsorted(POISSON, (cell >> U(11)).astype(np.float64) / (1 << 53), side="right")
        d = np.repeat(np.arange(len(e)), darts)
        i = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
        name = mixed(cell[d] + (i + 1).astype(U) * U(0xD6E8FEB86659FD93))
        if (weights != tall).any():
            under = level[d] + ((name >> U(8)) & U(0xFFFF)).astype(np.float64) / 65536 < weights[e[d]]
            d, name = d[under], name[under]
        place = (rank[d].astype(U) << U(16)) | ((name >> U(24)) & U(0xFFFF))
        at = owner[e[d]] * k + ((name >> U(40)) % U(k)).astype(np.int64)
        np.minimum.at(table, at, (place << U(32)) | (mixed(name) & U(0xFFFFFFFF)))
    return table.reshape(n_sets, k)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """(sets, k) array of dart names; sets without elements have all ones. ``owner`` numbers the sets."""
    total = np.bincount(owner, weights, minlength=n_sets) if len(owner) else np.zeros(n_sets)
    ranks = np.ceil((k * math.log(k) + 4 * k) / np.maximum(total, 1e-9)).astype(np.int64)
    ranks[total == 0] = 0
    table = _throw(elements, weights, owner, ranks, n_sets, k)
    while True:
        short = (table == ~U(0)).any(1) & (total > 0)
        if not short.any():
            return table & U(0xFFFFFFFF)
        ranks = np.where(short, 2 * ranks, 0)
        again = short[owner]
        number = np.cumsum(short) - 1
        table[short] = _throw(elements[again], weights[again], number[owner[again]], ranks[short], int(short.sum()), k)
