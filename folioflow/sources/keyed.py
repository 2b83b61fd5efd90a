"""Tables of replaceable groups of rows: each write is seen as a whole or not at all, and readers keep their version.

A table is a folder of segments and snapshots. A segment holds rows and the keys that it replaces; a snapshot
is a small file that lists the segments of one version, in order. Writing puts a segment in place and then
adds the next snapshot by a rename that fails where another writer was first, so a crash leaves the old
version and a reader never meets half a write. Of a key's rows those of the newest segment that replaces it count.
Nothing is rewritten by a write; ``compact`` folds segments when they have become many.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Names of segments that others were folded into.
FOLDED = "segment-folded-"


class Conflict(RuntimeError):
    """Another writer has added the version first."""


class KeyedTable:
    """A table at ``path`` whose rows are replaced by the values of the column ``key``, nulls among them."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at(self.path).getFileSystem(self.conf)

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """The versions that there are, ascending."""
        folder = self._at(f"{self.path}/snapshots")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())

    def snapshot(self, version: int | None = None) -> dict | None:
        """What a version consists of; the newest one, or None where the table doesn't exist."""
        found = self.versions()
        if version is None and not found:
            return None
        version = found[-1] if version is None else version
        stream = self.fs.open(self._at(f"{self.path}/snapshots/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, last: dict | None, **changed) -> int:
        """Add the version after ``last``; raises ``Conflict`` where it exists."""
        version = 0 if last is None else last["version"] + 1
        state = {"segments": [], "commits": []} | (last or {}) | changed | {"version": version}
        draft, final = (self._at(f"{self.path}/snapshots/{n}") for n in (f"draft-{uuid.uuid4().hex}", f"{version:012d}.json"))
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(self.conf).getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {version} of {self.path} exists") from error
            raise
        return version

    def create(self, schema: T.StructType | str) -> None:
        """Make an empty table; one that exists stays as it is."""
        if self.snapshot() is None:
            kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
            try:
                self._commit(None, schema=kind.jsonValue())
            except Conflict:
                pass

    def write(self, rows: DataFrame, keys: DataFrame | None = None) -> str:
        """Write a segment that no version has yet, and give its name for ``put``; several may be written side by side. ``vacuum`` takes it."""
        if self.snapshot() is None:
            self.create(rows.schema)
        name = f"segment-{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(self.snapshot()["schema"])
        rows.select(*schema.names).write.parquet(f"{self.path}/segments/{name}/rows")
        keys = self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/rows") if keys is None else keys
        keys.select(self.key).distinct().write.parquet(f"{self.path}/segments/{name}/keys")
        return name

    def put(self, rows: DataFrame | str, keys: DataFrame | None = None, commit: str | None = None) -> int:
        """Replace the rows of ``keys`` (by default the keys that ``rows`` has) by ``rows``; the new version.

        Keys without rows lose theirs. A write whose ``commit`` is in the table already, as after the replay of a
        batch, changes nothing. A table that doesn't exist is made. Extra columns are refused by Spark's reader.
        ``rows`` may be the name of a segment from ``write``, which is then only added.
        """
        last = self.snapshot()
        if last is not None and commit is not None and commit in last["commits"]:
            return last["version"]
        name = rows if isinstance(rows, str) else self.write(rows, keys)
        while True:
            last = self.snapshot()
            if commit is not None and commit in last["commits"]:
                return last["version"]
            try:
                return self._commit(last, segments=[*last["segments"], name], commits=last["commits"] + ([commit] if commit is not None else []))
            except Conflict:
                pass

    def delete(self, keys: DataFrame) -> int:
        """Drop the rows of ``keys``."""
        state = self.snapshot()
        schema = T.StructType.fromJson(state["schema"])
        return self.put(self.spark.createDataFrame([], schema), keys)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None where the table doesn't exist.

        The result stays the same while others write, until ``vacuum`` takes its version.
        """
        state = self.snapshot(version)
        if state is None:
            return None
        return self._rows(state, state["segments"])

    def _rows(self, state: dict, segments: list[str]) -> DataFrame:
        """The rows of some of a version's segments, in order."""
        schema = T.StructType.fromJson(state["schema"])
        place = lambda i, what: f"{self.path}/segments/{segments[i]}/{what}"
        n = len(segments)
        if n == 0:
            return self.spark.createDataFrame([], schema)
        part = lambda i: self.spark.read.schema(schema).parquet(place(i, "rows"))
        if n == 1:
            return part(0)
        rows, keys = part(0).withColumn("segment_no", F.lit(0)), None
        for i in range(1, n):
            rows = rows.unionByName(part(i).withColumn("segment_no", F.lit(i)))
            one = self.spark.read.schema(T.StructType([schema[self.key]])).parquet(place(i, "keys")).select(F.col(self.key).alias("replaced_key"), F.lit(i).alias("newest_no"))
            keys = one if keys is None else keys.unionByName(one)
        newest = keys.groupBy("replaced_key").agg(F.max("newest_no").alias("newest_no"))
        joined = rows.join(newest, rows[self.key].eqNullSafe(newest["replaced_key"]), "left")
        return joined.filter(F.col("segment_no") >= F.coalesce("newest_no", F.lit(0))).select(*schema.names)

    def keys(self) -> DataFrame | None:
        """Keys that the newest version's segments have, with rows or without; None where the table doesn't exist."""
        state = self.snapshot()
        return None if state is None else self._keys(state, state["segments"])

    def _keys(self, state: dict, segments: list[str]) -> DataFrame:
        schema = T.StructType([T.StructType.fromJson(state["schema"])[self.key]])
        paths = [f"{self.path}/segments/{s}/keys" for s in segments]
        return self.spark.read.schema(schema).parquet(*paths).distinct() if paths else self.spark.createDataFrame([], schema)

    def count(self) -> int:
        """Rows of the newest version; 0 where the table doesn't exist."""
        rows = self.read()
        return 0 if rows is None else rows.count()

    def compact(self, start: int = 0) -> int:
        """Fold the segments from ``start`` on into one; raises ``Conflict`` where another version was added meanwhile."""
        state = self.snapshot()
        name, folded = f"{FOLDED}{uuid.uuid4().hex}", state["segments"][start:]
        self._rows(state, folded).write.parquet(f"{self.path}/segments/{name}/rows")
        self._keys(state, folded).write.parquet(f"{self.path}/segments/{name}/keys")
        return self._commit(state, segments=[*state["segments"][:start], name])

    def fold(self, most: int) -> None:
        """Keep the segments to ``most``, rewriting rows seldom: new segments are folded, and all only when few of them are new."""
        segments = self.snapshot()["segments"]
        if len(segments) > most:
            old = next((i for i, s in enumerate(segments) if not s.startswith(FOLDED)), len(segments))
            self.compact(old if old < most and 2 * (len(segments) - old) >= most else 0)
            self.vacuum()

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions, and the segments that none of these has."""
        found = self.versions()
        used = {s for v in found[-keep:] for s in self.snapshot(v)["segments"]}
        for v in found[:-keep]:
            self.fs.delete(self._at(f"{self.path}/snapshots/{v:012d}.json"), False)
        folder = self._at(f"{self.path}/segments")
        if self.fs.exists(folder):
            for s in self.fs.listStatus(folder):
                if s.getPath().getName() not in used:
                    self.fs.delete(s.getPath(), True)
