"""GraphML with each element on its own line is read in byte ranges, and gives what the XML source gives."""

from folioflow import schemas
from folioflow.sources import graphml

HEAD = '<?xml version="1.0"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
KEYS = '<key id="d1" for="node" attr.name="ntype" attr.type="string" />\n  <key id="d0" for="edge" attr.name="relation"><default>x</default></key>\n'
BODY = """<graph edgedefault="directed">
  <node id="a &gt;&#x41;"> <data key="d1"> en&amp;ti>ty </data></node>
<node id='b' />
<node id="c"><data key="d1"/><data key="d9">x</data></node>
<edge source="b" target="c" id="K"><data key="d0">is
</data></edge>
</graph></graphml>
"""


def both(spark, path, monkeypatch):
    """What is read, and what the XML source gives."""
    found = [sorted(map(tuple, df.collect()), key=str) for df in graphml.read_graphml(spark, path)]
    with monkeypatch.context() as m:
        m.setattr(graphml, "_declared_by_line", lambda *_: None)
        return found, [sorted(map(tuple, df.collect()), key=str) for df in graphml.read_graphml(spark, path)]


def test_read_in_byte_ranges(spark, tmp_path, monkeypatch):
    odd = ['a & b <c> "d"', " spaced ", "line\nbreak\ttab\rreturn", "é中 ]]> --", "", None, "<node id='x'/>", "&#65;"]
    nodes = [(f"n{i} <&\">'", "entity", odd[i % 8], odd[(i + 1) % 8], None, i if i % 2 else None) for i in range(2000)]
    edges = [(f"n{i} <&\">'", f"n{i + 1} <&\">'", "RELATES", odd[i % 8], odd[(i + 2) % 8]) for i in range(1999)]
    path = str(tmp_path / "g.graphml")
    graphml.write_graphml(spark.createDataFrame(nodes, schemas.NODE), spark.createDataFrame(edges, schemas.EDGE), path)
    found, whole = both(spark, path, monkeypatch)
    assert found == whole == [sorted(nodes, key=str), sorted(edges, key=str)]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
        assert graphml.read_graphml(spark, path)[0].rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_files_of_others(spark, tmp_path, monkeypatch):
    one_line = BODY.replace("is\n", "is")
    odd = {
        "lines": (HEAD + KEYS + one_line, True),
        "over two lines": (HEAD + KEYS + BODY, False),
        "comment": (HEAD + KEYS + "<!--\n<node id='z'/>\n-->\n" + one_line, False),
        "in one line": ((HEAD + KEYS + one_line).replace("\n", ""), False),
        "key with more": (HEAD + KEYS.replace("<default>", "<desc>y</desc><default>") + one_line, False),
        "attributes below": (HEAD + KEYS + one_line.replace("<node id='b'", "<node\nid='b'"), False),
        "cdata": (HEAD + KEYS + one_line.replace(">is<", "><![CDATA[<is>]]><"), False),
        "entity": (HEAD + KEYS + one_line.replace(">is<", ">&is;<"), False),
    }
    for name, (text, by_line) in odd.items():
        path = tmp_path / f"{name.replace(' ', '_')}.graphml"
        path.write_text(text)
        assert (graphml._declared_by_line(spark, str(path)) is not None) == by_line, name
        found, whole = both(spark, str(path), monkeypatch)
        assert found == whole, name
    assert found[0][0][:2] == ("a >A", " en&ti>ty ")


def test_long_lines_are_left_to_the_xml_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphml, "PROBE", 64)
    monkeypatch.setattr(graphml, "PROBES", 4)
    path = tmp_path / "long.graphml"
    path.write_text(HEAD + KEYS + "<graph>" + "".join(f"<node id='{i}'/>" for i in range(100)) + "</graph></graphml>\n")
    assert not graphml._has_lines(spark, str(path))
    assert graphml.read_graphml(spark, str(path))[0].count() == 100
