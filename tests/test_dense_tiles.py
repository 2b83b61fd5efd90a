"""Dense search holds a bounded number of scores at once, and gives the same hits."""

import numpy as np
import pyarrow as pa
import pytest

from folioflow.operators import search


@pytest.mark.parametrize("cells", [1, 70, 1000, 4_000_000])
def test_scores_held_at_once_are_bounded(monkeypatch, cells):
    held, hits = [], search._hits
    monkeypatch.setattr(search, "SCORE_CELLS", cells)
    monkeypatch.setattr(search, "_hits", lambda scores, *a: held.append(scores.size) or hits(scores, *a))
    r = np.random.default_rng(3)
    x, m = r.integers(-2, 3, (90, 4)).astype(float), r.integers(-2, 3, (50, 4)).astype(float)
    got = pa.Table.from_batches(search._tiles(x, m, pa.array(range(90)), pa.array(range(50)), 5, "key")).to_pylist()
    assert max(held) <= cells
    for q in range(50):
        mine = sorted((-h["score"], h["key"]) for h in got if h["qid"] == q)[:5]
        assert mine == sorted((-float(s), i) for i, s in enumerate(np.round(x @ m[q], search.SCORE_DIGITS)))[:5]
