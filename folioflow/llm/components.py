"""Connected components by alternating large and small stars, all in tables.

A large star joins each node's larger neighbours to the least node around it, a small star its smaller
ones; both keep components, and after a number of rounds that grows with the logarithm of the graph each
node hangs on the least node of its component. Minima are taken map-side first, so a hub's links don't
meet in one task; the join that hands a hub's minimum back to its links is one that adaptive execution
can split. Each round is written to the shared folder as Parquet, and the round before it is deleted. A table
from ``cut`` keeps the size estimate of the plan that made it; joins multiply estimates, so over the rounds
the estimate would become a number of millions of digits in the driver. Files have their true size.

Up to ``ONE_TASK`` links, a bound of some tens of megabytes, one executor task finds the same components
by union and find, which spares the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut, drop_folder, shared_folder, ship

ONE_TASK = 300_000


def _written(df: DataFrame, folders: list[str]) -> DataFrame:
    """``df`` as a table of files in a folder of its own, which is added to ``folders``."""
    path = shared_folder(df.sparkSession, "stars")
    df.write.parquet(path)
    folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _star(pairs: DataFrame, folders: list[str]) -> DataFrame:
    """``pairs`` of (node, neighbour) with each node's least neighbour or itself as ``least``."""
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    least = _written(least.select("node", F.least("node", "least").alias("least")), folders)
    return pairs.join(least, "node")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of one partition; keys may be numbers or structs of numbers."""
    up: dict = {}
    kind = None

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        kind = batch.schema.field("node").type
        plain = lambda c: [tuple(v.values()) for v in c.to_pylist()] if pa.types.is_struct(kind) else c.to_pylist()
        for a, b in zip(plain(batch.column("node")), plain(batch.column("other")), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        nodes = list(up)
        roots = [root(x) for x in nodes]
        if pa.types.is_struct(kind):
            names = [f.name for f in kind]
            nodes, roots = ([dict(zip(names, x, strict=True)) for x in xs] for xs in (nodes, roots))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(roots, kind)], ["node", "component"])


def connected_components(links: DataFrame, rounds: int = 40, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b); a component is named by its least node.

    Self-links, repeated and reversed links are allowed; links with a null end are ignored. An empty
    table gives an empty result.
    """
    links = links.filter("a is not null and b is not null")
    links = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    alone = links.filter("node = other").select("node")
    edges = cut(links.filter("node <> other").distinct())
    if edges.count() <= one_task:
        ship(links.sparkSession)
        kind = edges.schema["node"].dataType.simpleString()
        known = edges.coalesce(1).mapInArrow(_united, f"node {kind}, component {kind}")
        return cut(_with_alone(known, alone))
    mark, folders = None, []
    edges = _written(edges, folders)
    for _ in range(rounds):  # far more than the rounds that any graph needs which fits a cluster
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both, folders).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
        large = _written(large.filter("node <> other").distinct(), folders)
        star = _star(large, folders)
        small = star.select(F.col("other").alias("node"), F.col("least").alias("other")).filter("node <> other")
        small = small.unionByName(star.select("node", F.col("least").alias("other")))
        edges = _written(small.distinct(), folders)
        while len(folders) > 1:
            drop_folder(edges.sparkSession, folders.pop(0))
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    named = edges.select("node", F.col("other").alias("component"))
    roots = edges.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    known = cut(_with_alone(named.unionByName(roots), alone))
    drop_folder(edges.sparkSession, folders.pop())
    return known


def _with_alone(known: DataFrame, alone: DataFrame) -> DataFrame:
    """``known`` and the nodes that are linked with themselves only."""
    return known.unionByName(alone.distinct().join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
