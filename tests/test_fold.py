"""Folding a table's segments rewrites rows seldom and changes none."""

from folioflow.sources.keyed import KeyedTable


def test_rows_are_rewritten_seldom(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), "k")
    rewritten, rows = [], KeyedTable._rows
    for i in range(22):
        table.put(spark.createDataFrame([(j, i) for j in range(i, i + 3)], "k int, v int").coalesce(1))
        monkeypatch.setattr(KeyedTable, "_rows", lambda self, state, segments: rewritten.append(len(segments)) or rows(self, state, segments))
        table.fold(8)
        monkeypatch.setattr(KeyedTable, "_rows", rows)
        assert len(table.snapshot()["segments"]) <= 8
    assert sum(rewritten) <= 30 and min(rewritten) > 1
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [(j, min(j, 21)) for j in range(24)]
