"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector keeps an upper bound on the distance to its own centroid and a lower bound for each of the
k centroids. Bounds move with the centroids; a distance is calculated only where neither a lower bound nor half
the distance between two centroids proves the other centroid to be farther. Bounds are rounded away from
the truth and prune only where they are strictly apart, so ties come out as in a full search. Distances
that decide are exact integers.

A round is one pass over a table in the shared folder that holds vectors and bounds: it writes the next
one, whose last row of each task has the task's sums by centroid. A lost executor costs its tasks'
repetition. Only the k centroids and their sums come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import cut, drop_folder, shared_folder, ship

#: Components are under this in size, so that distances and sums are exact in 64 bits.
LIMIT = 1 << 24
SLACK = 2.0**-50


@dataclass
class State:
    """Vectors by row with their centroid (-1 before the first round), upper bound and k lower bounds."""

    vectors: np.ndarray
    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


class Centroids:
    """Centroids of a round, how far each has moved since the last one, and half their mutual distances."""

    def __init__(self, now: np.ndarray, last: np.ndarray | None = None):
        self.now = now
        self.moved = np.sqrt(squares(now - last)) * (1 + SLACK) if last is not None else np.zeros(len(now))
        apart = np.sqrt(squares(now[:, None, :] - now[None, :, :]))
        self.half = apart / 2 * (1 - SLACK)
        others = np.where(np.eye(len(now), dtype=bool), np.inf, self.half)
        self.nearest = others.min(axis=1)


def squares(difference: np.ndarray) -> np.ndarray:
    """Exact squared lengths of integer vectors."""
    return np.einsum("...i,...i->...", difference, difference)


def assign(state: State, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """Bring ``state`` to the nearest centroids. Gives exact squared distances, where they are known, and how many were calculated."""
    v, k = state.vectors, len(centroids.now)
    state.upper = (state.upper + centroids.moved[np.maximum(state.own, 0)]) * (1 + SLACK)
    state.lower = np.maximum(0.0, (state.lower - centroids.moved) * (1 - SLACK))
    exact = np.zeros(len(v), np.int64)
    known = np.zeros(len(v), bool)
    count = 0

    def measure(rows: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        nonlocal count
        count += len(rows)
        d = squares(v[rows] - centroids.now[to])
        state.lower[rows, to] = np.sqrt(d) * (1 - SLACK)
        return d

    def tighten(rows: np.ndarray) -> None:
        """Know the distance to the own centroid."""
        exact[rows] = measure(rows, state.own[rows])
        state.upper[rows] = np.sqrt(exact[rows]) * (1 + SLACK)
        known[rows] = True

    new = np.flatnonzero(state.own < 0)
    state.own[new] = 0
    tighten(new)
    open_rows = np.flatnonzero(state.upper >= centroids.nearest[state.own])

    def undecided(rows: np.ndarray, c: int) -> np.ndarray:
        own, upper = state.own[rows], state.upper[rows]
        return rows[(own != c) & (state.lower[rows, c] <= upper) & (centroids.half[own, c] <= upper)]

    for c in range(k):
        rows = undecided(open_rows, c)
        tighten(rows[~known[rows]])
        rows = undecided(rows, c)
        d = measure(rows, c)
        nearer = (d < exact[rows]) | ((d == exact[rows]) & (c < state.own[rows]))
        rows, d = rows[nearer], d[nearer]
        state.own[rows], exact[rows] = c, d
        state.upper[rows] = np.sqrt(d) * (1 + SLACK)
    return exact, known, count


def distances(state: State, centroids: Centroids) -> np.ndarray:
    """Exact squared distances to the nearest centroids."""
    exact, known, _ = assign(state, centroids)
    rows = np.flatnonzero(~known)
    exact[rows] = squares(state.vectors[rows] - centroids.now[state.own[rows]])
    return exact


def whole(vector: Column, dims: int) -> Column:
    """True where a vector has ``dims`` components, none null or non-finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & good, F.lit(False))


def _loaded(batch: pa.RecordBatch, dims: int, k: int) -> State:
    flat = lambda name, width: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    v = flat("v", dims).astype(np.int64)
    if len(v) and int(np.abs(v).max()) >= LIMIT:
        raise ValueError(f"components must be under {LIMIT} in size")
    if "own" not in batch.schema.names:
        n = len(v)
        return State(v, np.full(n, -1), np.full(n, np.inf), np.zeros((n, k)))
    own, upper = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "upper"))
    return State(v, own.astype(np.int64), upper.copy(), flat("lower", k).copy())


def _lists(table: np.ndarray) -> pa.Array:
    n, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(table.reshape(-1)))


def _round(table: DataFrame, centroids: Centroids, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Write the next table to ``path``; give the sums and sizes of the clusters and how many distances it took."""
    k, dims = centroids.now.shape
    key = table.schema["key"]
    fields = [key, T.StructField("v", T.ArrayType(T.IntegerType())), T.StructField("own", T.IntegerType()), T.StructField("upper", T.DoubleType())]
    schema = T.StructType([*fields, T.StructField("lower", T.ArrayType(T.DoubleType())), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, kind = np.zeros(k * (dims + 1) + 1, np.int64), None
        for batch in batches:
            kind = batch.schema.field("key").type
            state = _loaded(batch, dims, k)
            sums[-1] += assign(state, centroids)[2]
            for c in range(k):
                mine = state.vectors[state.own == c]
                sums[c * dims : (c + 1) * dims] += mine.sum(axis=0)
                sums[k * dims + c] += len(mine)
            columns = [batch.column("key"), batch.column("v"), pa.array(state.own.astype(np.int32)), pa.array(state.upper), _lists(state.lower), pa.nulls(len(state.own), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)
        if kind is not None:
            columns = [pa.nulls(1, t) for t in (kind, pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, _lists(sums[None, :])], schema.names)

    table.mapInArrow(run, schema).write.parquet(path)
    made = table.sparkSession.read.parquet(path).select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(k * (dims + 1) + 1, np.int64)
    for r in made:
        sums[r["at"]] = r["x"]
    return sums[: k * dims].reshape(k, dims), sums[k * dims : -1], int(sums[-1])


def fit(table: DataFrame, start: np.ndarray, rounds: int) -> tuple[DataFrame, Centroids, list[int]]:
    """The last round's table, the centroids after it, and the distances calculated in each round.

    ``table`` has columns ``key`` and ``v``. Rounds end early once no centroid moves, as all later ones
    would be alike.
    """
    spark = table.sparkSession
    centroids, held, counts = Centroids(start), None, []
    ship(spark)
    for _ in range(rounds):
        path = shared_folder(spark, "clusters")
        sums, sizes, count = _round(table, centroids, path)
        table = spark.read.parquet(path).filter(F.col("sums").isNull()).drop("sums")
        if held:
            drop_folder(spark, held)
        held, last = path, centroids.now
        counts.append(count)
        now = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], last)
        centroids = Centroids(now, last)
        if (now == last).all():
            break
    return table, centroids, counts


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """One row per kept vector: its id, cluster, distance, cluster_inertia, inertia and centroid_sha256.

    Kept are vectors of ``dims`` components, none null or non-finite; a component x becomes floor(scale * x),
    which must be under 2 ** 24 in size. The first centroids are the k vectors whose ids have the smallest
    digests; a null id counts as an empty one, and vectors whose digests tie go by their components. Repeated rows
    count each. With fewer than k vectors there are as many clusters as vectors; where none is kept the result is
    empty. Other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    kept = vectors.filter(whole(vector, dims)).select(F.col(id_col).alias("key"), F.transform(vector, lambda x: F.floor(x * scale).cast("int")).alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    start = [r["v"] for r in kept.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()]
    if not start:
        kind = vectors.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table, centroids, _ = fit(kept, np.array(start, np.int64), rounds)
    schema = T.StructType([table.schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    size = len(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            state = _loaded(batch, dims, size)
            exact = distances(state, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(state.own.astype(np.int32)), pa.array(exact)], schema.names)

    ship(spark)
    done = cut(table.mapInArrow(run, schema))
    inertia = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    prints = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids.now]
    return done.select(
        F.col("key").alias(id_col), "cluster", "distance", of([inertia.get(c, 0) for c in range(size)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(prints).alias("centroid_sha256"),
    )
