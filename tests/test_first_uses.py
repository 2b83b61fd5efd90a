"""Of a task's uses of a name only the first goes on to the state, whatever batches they come in."""

import random

import pyarrow as pa
import pytest

from folioflow.streaming import resolution


@pytest.mark.parametrize("held", [1, 3000, 64 << 20])
def test_first_uses_of_many_batches(monkeypatch, held):
    monkeypatch.setattr(resolution, "HELD_BYTES", held)
    r = random.Random(5)
    some = lambda *x: r.choice([*x, None])
    rows = [{"name": f"n{r.randint(0, 20)}", "ord": some(1, 2, 30), "kind": some(0, 1), "pos": some(0, 7), "side": 0, "label": some("a", "é", "z"), "text": some("T", "t")} for _ in range(3000)]
    schema = pa.schema([("name", pa.string()), ("ord", pa.int64()), ("kind", pa.int32()), ("pos", pa.int32()), ("side", pa.int32()), ("label", pa.string()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 100], schema=schema) for i in range(0, len(rows), 100)]
    got = [x for b in resolution.first_uses(iter(batches)) for x in b.to_pylist()]
    place = lambda x: tuple((x[c] is not None, x[c] if x[c] is not None else 0) for c in resolution.ORDER)
    first = lambda of: {n: min(place(x) for x in of if x["name"] == n) for n in {x["name"] for x in of}}
    assert first(got) == first(rows)
    if held > 1:  # uses that 30 batches repeat are not passed on again
        assert len(got) == 21
    assert list(resolution.first_uses(iter([]))) == []
