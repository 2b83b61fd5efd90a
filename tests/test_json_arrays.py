"""The arrays of one JSON document, read in byte ranges, against a parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioflow.sources import json_arrays, readers


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def document(r: random.Random) -> dict:
    """Strings hold braces, brackets, quotes, backslashes and what looks like a member's name."""
    odd = lambda: "".join(r.choice(['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", "𝄞", '"images": [', "}}"]) for _ in range(r.randint(0, 12)))
    images = [{"id": i, "file_name": f"X{odd().replace('/', '')}_{i:05d}.png", "width": 5, "height": 6} for i in range(r.randint(0, 60))]
    rle = lambda: r.choice([[[1, 2.5], [3]], {"counts": odd(), "size": [1, {"deep": [{}]}]}, []])
    annotations = [{"id": i, "image_id": r.randrange(70), "category_id": r.randrange(4), "bbox": [0, 1.5, 2, 3], "segmentation": rle(), "note": odd()} for i in range(r.randint(0, 150))]
    members = [("info", {"about": odd(), "by": {"who": [odd()]}}), ("licenses", [{"id": 1, "name": odd()}] * r.randint(0, 2)), ("tags", [odd(), odd()]), ("version", 3)]
    members += [("images", images), ("annotations", annotations), ("categories", [{"id": i, "name": odd()} for i in range(3)])]
    r.shuffle(members)
    return dict(members)


@pytest.mark.parametrize("seed", range(8))
def test_arrays_equal_a_parser(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    doc = document(r)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(doc, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5) + r.choice(["", "\n"]))
    rows = json_arrays.read_arrays(spark, str(path)).orderBy("pos").collect()
    want = [(k, x) for k, v in doc.items() if isinstance(v, list) for x in v if isinstance(x, dict)]
    assert [(x["section"], json.loads(x["value"])) for x in rows] == want


def test_a_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    doc = {"images": [{"id": i, "file_name": f"P_{i:05d}.png", "width": 1, "height": 2} for i in range(300)], "annotations": [{"id": i, "image_id": i % 310, "category_id": 1, "bbox": [i, 0, 1, 1]} for i in range(900)], "categories": [{"id": 1, "name": "text"}]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(doc))
    assert json_arrays._pieces(spark, str(path)).select("split").distinct().count() > 10
    pages = {p["page_index"]: [a["id"] for a in p["annotations"]] for p in readers.read_coco(spark, str(path)).collect()}
    assert pages == {i: [k for k in range(900) if k % 310 == i] for i in range(300)}


@pytest.mark.parametrize("text", ["", '{"images": [{"id": 1}', '{"images": [{"id": "a}]}'])
def test_broken_documents_are_refused(spark, tmp_path, text):
    path = tmp_path / "b.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        json_arrays.read_arrays(spark, str(path))


@pytest.mark.parametrize("doc", [{"x": [[{"a": 1}]], "images": [{"id": 1}]}, {"x": [{"a": 1}, [{"b": 1}], {"c": 1}]}])
def test_arrays_of_arrays_of_objects_are_refused(spark, tmp_path, doc):
    path = tmp_path / "n.json"
    path.write_text(json.dumps(doc))
    with pytest.raises(Exception, match="array of arrays"):
        json_arrays.read_arrays(spark, str(path)).collect()


def test_members_that_are_objects_or_hold_other_things(spark, tmp_path):
    doc = {"a": {"list": [{"x": 1}], "b": {}, "c": {"d": [{}, {}]}}, "mixed": [1, "two {", {"k": 1}, [3], {"k": 2}], "": [{"n": 0}], "e": {}, "f": [], "images": [{"id": 1}, {}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(doc))
    got = [(r["section"], json.loads(r["value"])) for r in json_arrays.read_arrays(spark, str(path)).orderBy("pos").collect()]
    assert got == [("mixed", {"k": 1}), ("mixed", {"k": 2}), ("", {"n": 0}), ("images", {"id": 1}), ("images", {})]


def test_written_coco_reads_back(spark, tmp_path):
    path = str(tmp_path / "w.json")
    images = spark.range(40).select(F.col("id"), F.concat(F.lit('Q "{_'), F.col("id").cast("string"), F.lit(".png")).alias("file_name"), F.lit(3).alias("width"), F.lit(4).alias("height")).repartition(4)
    notes = spark.range(100).select("id", (F.col("id") % 40).alias("image_id"), F.lit(2).alias("category_id"), F.array(F.lit(1.0)).alias("bbox"))
    readers.write_coco(images, notes, spark.createDataFrame([(2, "fig}ure")], "id int, name string"), path)
    assert len(json.loads(open(path).read())["annotations"]) == 100
    pages = readers.read_coco(spark, path).collect()
    assert len(pages) == 40 and sum(len(p["annotations"]) for p in pages) == 100
    assert {a["category_name"] for p in pages for a in p["annotations"]} == {"fig}ure"}
    readers.write_coco(images.limit(0), notes.limit(0), spark.createDataFrame([], "id int, name string"), path)
    assert readers.read_coco(spark, path).count() == 0
