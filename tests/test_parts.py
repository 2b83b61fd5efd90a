"""One file out of parts: parts are zipped until they are copied, and ones without rows don't matter."""

from folioflow.sources.parts import write_whole


def test_whole_file_of_zipped_parts(spark, tmp_path, monkeypatch):
    rows = lambda a, b: spark.range(a, b, 1, 1).selectExpr("concat(',', id) AS value")
    table = rows(0, 5).filter("value = 'none'").unionByName(rows(0, 3)).unionByName(rows(3, 5))
    made, write = [], type(table.write).text
    monkeypatch.setattr(type(table.write), "text", lambda self, path, **o: made.append(o.get("compression")) or write(self, path, **o))
    write_whole([b"[\n", table, b"]\n", table.filter("false")], str(tmp_path / "out.json"), 1)
    assert (tmp_path / "out.json").read_text() == "[\n0\n,1\n,2\n,3\n,4\n]\n" and made == ["gzip", "gzip"]
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["out.json"]
