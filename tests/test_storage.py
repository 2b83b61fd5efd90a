"""Tables written once to the shared folder."""

import os

from folioflow.plans.storage import shared_folder, stored


def test_stored_tables_read_back_whole(spark):
    schema = "id long, kind string, x array<string>"
    rows = [(1, "7", ["a", None]), (1, "7", ["a", None]), (2, "b/c = d", []), (None, None, None)]
    for by in ((), ("kind",)):
        df = spark.createDataFrame(rows, schema)
        out = stored(df, *by)
        assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in df.schema.fields]
        assert sorted(out.collect(), key=repr) == sorted(df.collect(), key=repr)
        assert stored(spark.createDataFrame([], schema), *by).collect() == []


def test_stored_tables_prune_folders_and_lie_in_the_shared_folder(spark):
    out = stored(spark.createDataFrame([(1, "a"), (2, "b")], "id long, kind string"), "kind").filter("kind = 'a'")
    assert [r["id"] for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan
    folder = os.path.realpath(shared_folder(spark).removeprefix("file:"))
    paths = [os.path.realpath("/" + p.removeprefix("file:").lstrip("/")) for p in out.inputFiles()]
    assert paths and all(p.startswith(folder) for p in paths)
