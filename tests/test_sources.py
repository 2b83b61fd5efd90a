"""Splittable tar shards against a sequential reading, and tables of replaceable groups of rows."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from folioflow.sources import keyed, readers, shards


def write_tar(path, entries, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            else:
                info.size = len(data)
            tar.addfile(info, None if data is None else io.BytesIO(data))


def sequential(path):
    """Samples by one pass with the standard library."""
    out, parts, current = [], {}, None
    with tarfile.open(path) as tar:
        for m in [*tar, None]:
            folder, slash, base = m.name.rpartition("/") if m else ("", "", "")
            key = folder + slash + base.split(".", 1)[0] if m else None
            if key != current:
                if {"png", "json"} <= parts.keys():
                    out.append((current, parts["png"], parts["json"].decode()))
                parts, current = {}, key
            if m and m.isfile():
                parts[base.partition(".")[2]] = tar.extractfile(m).read()
    return out


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_shards_equal_a_sequential_reading(spark, tmp_path, form):
    r = random.Random(form)
    entries = [("pages", None)]
    for i in range(160):
        stem = f"pages/PMC{i}_0000{i % 10}" + ("n" * 120 if i % 7 == 0 and form != tarfile.USTAR_FORMAT else "")
        size = r.choice([0, 1, 511, 512, 513, 3000, 20_000])
        pair = [(f"{stem}.png", r.randbytes(size)), (f"{stem}.json", json.dumps({"i": i}).encode()), (f"{stem}.seg.txt", b"more")]
        r.shuffle(pair)
        entries += pair[: 2 if i % 11 == 0 else 3]
    entries.insert(200, ("pages/large.png", r.randbytes(300_000)))
    entries.insert(201, ("pages/large.json", b"{}"))
    path = str(tmp_path / "a.tar")
    write_tar(path, entries, form)
    want = sorted(sequential(path))
    for split in (10_240, 40_960, 200_000, 1 << 30):
        parts = shards.shard_parts(spark, path, split)
        assert split > 200_000 or parts.rdd.getNumPartitions() > 4
        assert parts.filter("at is not null").agg(F.max(F.length("edge"))).first()[0] <= max(split, 1 << 20)
        assert sorted((x.key, bytes(x.image), x.meta) for x in shards.read_samples(spark, [path], split).collect()) == want
    both = shards.read_samples(spark, [path, path], 40_960).count()
    assert both == 2 * len(want)


def test_shard_inside_a_shard_is_noticed(spark, tmp_path):
    r = random.Random(1)
    inner = str(tmp_path / "inner.tar")
    write_tar(inner, [(f"x{i}.{k}", r.randbytes(900)) for i in range(60) for k in ("png", "json")])
    data = open(inner, "rb").read()
    path = str(tmp_path / "outer.tar")
    write_tar(path, [("a.png", b"1"), ("a.json", b"{}"), ("b.png", data), ("b.json", b"{}"), ("c.png", b"2"), ("c.json", b"{}")])
    with pytest.raises(Exception, match="one split"):
        shards.read_samples(spark, [path], 20_480).collect()
    assert {x.key for x in shards.read_samples(spark, [path], 1 << 30).collect()} == {"a", "b", "c"}


def test_cut_off_shard_is_noticed(spark, tmp_path):
    path = str(tmp_path / "a.tar")
    write_tar(path, [(f"x{i}.{k}", b"y" * 5000) for i in range(20) for k in ("png", "json")])
    data = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(data[:51_200])
    with pytest.raises(Exception, match="cut off"):
        shards.read_samples(spark, [path], 20_480).collect()


def test_shards_through_another_file_system(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + (30).to_bytes(4, "big") + (40).to_bytes(4, "big")
    write_tar(str(tmp_path / "s.tar"), [("PMC1_00002.png", png), ("PMC1_00002.json", b'{"annotations": [{"id": 1, "category_id": 2, "bbox": [0, 0, 9, 9]}]}'), ("odd.png", png)])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shardtest.link./in", f"file://{tmp_path}")
    row = readers.read_shards(spark, ["viewfs://shardtest/in/s.tar"]).first()
    assert (row.doc_id, row.page_index, row.width, row.height, len(row.annotations)) == ("PMC1", 2, 30, 40, 1)
    assert shards.read_samples(spark, []).count() == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_keyed_table(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k")
    assert table.read() is None and table.count() == 0 and table.versions() == []
    table.create("k string, v int")
    table.create("k string, v int, w int")
    assert table.count() == 0 and table.versions() == [0]
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    table.put(make([("a", 1), ("a", 2), ("b", 3), (None, 4)]), commit="0")
    before = table.read()
    table.put(make([("a", 5), (None, 6)]), commit="1")
    table.put(make([("a", 5), (None, 6)]), commit="1")  # a replay
    assert rows_of(table.read()) == rows_of(make([("a", 5), ("b", 3), (None, 6)]))
    assert rows_of(before) == rows_of(make([("a", 1), ("a", 2), ("b", 3), (None, 4)])) == rows_of(table.read(1))
    table.put(make([]), keys=make([("b", 0)]).select("k"))
    assert rows_of(table.read()) == rows_of(make([("a", 5), (None, 6)]))
    table.put(make([("b", 9)]))
    table.delete(make([(None, 0)]))
    want = rows_of(make([("a", 5), ("b", 9)]))
    assert rows_of(table.read()) == want and table.count() == 2
    table.compact()
    table.vacuum()
    assert rows_of(table.read()) == want and len(table.versions()) == 1
    assert len(list((tmp_path / "t" / "segments").iterdir())) == 1


def test_keyed_table_survives_a_crash_and_a_rival(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k")
    make = lambda rows: spark.createDataFrame(rows, "k string, v int")
    table.put(make([("a", 1)]))
    commit = keyed.KeyedTable._commit
    monkeypatch.setattr(keyed.KeyedTable, "_commit", lambda *a, **b: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.put(make([("a", 2)]))
    monkeypatch.setattr(keyed.KeyedTable, "_commit", commit)
    assert rows_of(table.read()) == [("a", 1)]
    old = table.snapshot()
    keyed.KeyedTable(spark, str(tmp_path / "t"), "k").put(make([("b", 3)]))
    with pytest.raises(keyed.Conflict):
        table._commit(old, segments=[])
    monkeypatch.setattr(table, "snapshot", iter([old, old, table.snapshot()]).__next__)
    table.put(make([("c", 4)]))  # its first try is late and is made again on the newer version
    monkeypatch.undo()
    assert rows_of(table.read()) == [("a", 1), ("b", 3), ("c", 4)]


def test_graphml_round_trip(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from folioflow import schemas
    from folioflow.sources import graphml

    odd = ['a & b <c> "d"', " spaced ", "line\nbreak\ttab", "é中 ]]> --", "", None]
    nodes = [(f"n{i} <&\">", "entity", odd[i % 6], odd[(i + 1) % 6], None, i if i % 2 else None) for i in range(60)]
    edges = [(f"n{i} <&\">", f"n{i + 1} <&\">", "RELATES" if i % 2 else "MENTIONS", odd[i % 6], odd[(i + 2) % 6]) for i in range(59)]
    path = str(tmp_path / "g.graphml")
    n, e = spark.createDataFrame(nodes, schemas.NODE).repartition(3), spark.createDataFrame(edges, schemas.EDGE).repartition(3)
    graphml.write_graphml(n, e, path)
    graphml.write_graphml(n, e, path)
    root = ET.parse(path).getroot()
    assert len(root.findall(f".//{{{graphml.NAMESPACE}}}node")) == 60 and len(root.findall(f".//{{{graphml.NAMESPACE}}}edge")) == 59
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    back = graphml.read_graphml(spark, path)
    assert rows_of(back[0]) == rows_of(n) and rows_of(back[1]) == rows_of(e)
    other = tmp_path / "other.graphml"
    other.write_text('<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d1" for="node" attr.name="ntype" attr.type="string" />\n<key id="d0" for="edge" attr.name="relation"/><key id="d9" for="node" attr.name="colour"/><graph edgedefault="directed"><node id="a"><data key="d9">red</data><data key="d1">entity</data></node><node id="b" />\n<edge source="a" target="b" id="K"><data key="d0">is</data></edge></graph></graphml>')
    back = graphml.read_graphml(spark, str(other))
    assert rows_of(back[0]) == [("a", "entity", None, None, None, None), ("b", None, None, None, None, None)]
    assert rows_of(back[1]) == [("a", "b", "K", "is", None)]
