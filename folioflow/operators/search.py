"""Exact top-k search over dense and sparse vectors, and the index tables with key-based upserts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Queries whose vectors are handed to the tasks at once, and rows that a block of queries meets at once where there are more.
QUERY_BLOCK, ROW_BUCKET = 4096, 65_536
#: Terms of all queries that are handed to the tasks at once, and scores that a task holds at once.
MOST_POSTINGS, SCORE_CELLS = 1 << 18, 4_000_000
SCORE_DIGITS = 6


def _best(hits: DataFrame, k: int, key: str) -> DataFrame:
    """The k best hits of each query; ties fall to the smaller key."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc(key))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The places of a column's vectors that have a length, and these vectors, scaled to length one."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, np.zeros((0, 0))
    flat = column.take(pa.array(rows)) if len(rows) < len(column) else column
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)
    length = np.sqrt((x * x).sum(1))
    return rows[length > 0], x[length > 0] / length[length > 0][:, None]


def _hits(scores: np.ndarray, keys: pa.Array, names: pa.Array, k: int, key: str) -> pa.RecordBatch:
    """The k best rows of each column of ``scores``; ties fall to the smaller key."""
    n = len(scores)
    if n > k:  # all that reach the k-th best score, which ties may make more
        q, at = np.nonzero((scores >= np.partition(scores, n - k, axis=0)[n - k]).T)
    else:
        q, at = np.repeat(np.arange(scores.shape[1]), n), np.tile(np.arange(n), scores.shape[1])
    kept, place = np.unique(at, return_inverse=True)
    by_key = np.argsort(np.argsort(np.array(keys.take(pa.array(kept)).to_pylist(), dtype=object), kind="stable"))[place]
    order = np.lexsort((by_key, -scores[at, q], q))
    q, at = q[order], at[order]
    within = np.arange(len(q)) - np.searchsorted(q, q)
    q, at = q[within < k], at[within < k]
    return pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys.take(pa.array(at)), pa.array(scores[at, q])], ["qid", key, "score"])


def _tiles(x: np.ndarray, matrix: np.ndarray, keys: pa.Array, names: pa.Array, k: int, key: str) -> Iterator[pa.RecordBatch]:
    """The k best of the rows ``x`` for each row of ``matrix``, tile by tile, so that only ``SCORE_CELLS`` scores are held at once.

    A tile has many rows and few queries, so that few hits leave it; no more than k rows of each stretch of rows stay.
    """
    wide = max(1, min(len(x), SCORE_CELLS // 64))
    few = max(1, SCORE_CELLS // wide)
    for a in range(0, len(x), wide):
        for b in range(0, len(matrix), few):
            scores = np.round(x[a : a + wide] @ matrix[b : b + few].T, SCORE_DIGITS)
            yield _hits(scores, keys.slice(a, wide), names.slice(b, few), k, key)


def _scan(docs: DataFrame, key: str, vector: str, names: pa.Array, matrix: np.ndarray, k: int, schema: str) -> DataFrame:
    """One pass over ``docs`` for one block of unit query vectors; each batch keeps its k best per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch.column(vector))
            if len(rows):
                yield from _tiles(x, matrix, batch.column(key).take(pa.array(rows)), names, k, key)

    return docs.select(key, vector).mapInArrow(run, schema)


def _grid(docs: DataFrame, asked: DataFrame, key: str, k: int, blocks: int, schema: str) -> DataFrame:
    """Blocks of queries against buckets of rows: each pair of a block and a bucket meets in one task.

    Rows go to every block and queries to every bucket, so the rows are shuffled once for ``QUERY_BLOCK`` queries.
    """
    buckets = max(1, -(-docs.count() // ROW_BUCKET))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = docs.withColumn("bucket", dealt(buckets, key, "v")).select("bucket", each(blocks).alias("block"), F.col(key).alias("key"), "v")
    right = asked.withColumn("block", dealt(blocks, "qid", "v")).select("block", each(buckets).alias("bucket"), "qid", "v")

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        at, x = _vectors(rows.column("v").combine_chunks())
        q, m = _vectors(queries.column("v").combine_chunks())
        if len(at) and len(q):
            keys, names = rows.column("key").combine_chunks().take(pa.array(at)), queries.column("qid").combine_chunks().take(pa.array(q))
            return pa.Table.from_batches(_tiles(x, m, keys, names, k, key))
        empty = [pa.array([], t) for t in (queries.schema.field("qid").type, rows.schema.field("key").type, pa.float64())]
        return pa.table(empty, names=["qid", key, "score"])

    return left.groupBy("block", "bucket").cogroup(right.groupBy("block", "bucket")).applyInArrow(meet, schema)


def dense_topk(docs: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rank): cosine top-k of each query (qid, vector) over all rows, exactly.

    Up to ``QUERY_BLOCK`` queries go to the tasks as one matrix, and the collection is scanned in place; only k
    rows per query and batch leave a task. More queries are never held by the driver: blocks of them meet
    buckets of rows (``_grid``). Scores are rounded to six digits before ranking, so ties don't hang on the
    order of additions. Null and zero vectors match nothing.
    """
    asked = queries.select("qid", F.col(vector).alias("v")).filter("v is not null")
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
    first = asked.limit(QUERY_BLOCK + 1).toArrow()
    if first.num_rows <= QUERY_BLOCK:
        at, matrix = _vectors(first.column("v").combine_chunks())
        names = first.column("qid").combine_chunks().take(pa.array(at))
        hits = _scan(docs, key, vector, names, matrix, k, schema) if len(at) else docs.sparkSession.createDataFrame([], schema)
    else:
        rows = docs.select(key, F.col(vector).alias("v")).filter("v is not null")
        hits = _grid(rows, asked, key, k, -(-asked.count() // QUERY_BLOCK), schema)
    return _best(hits, k, key)


def match_documents(df: DataFrame, doc_ids: list[str] | None, doc_col: str = "doc_id") -> DataFrame:
    """Rows of the given documents; no or an empty list doesn't filter."""
    return df.filter(F.col(doc_col).isin(list(doc_ids))) if doc_ids else df


def _sparse_scan(docs: DataFrame, key: str, weights: str, postings: pa.Table, k: int, schema: str) -> DataFrame:
    """One pass over ``docs`` against the queries' postings (qid, term, wq); each batch keeps its k best per query."""
    names, terms = (postings.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("qid", "term"))
    term = terms.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    query = names.indices.to_numpy()[order]
    weight = postings.column("wq").to_numpy().astype(np.float64)[order]
    sizes = np.bincount(term, minlength=len(terms.dictionary))
    begins = np.cumsum(sizes) - sizes
    names, terms = names.dictionary, terms.dictionary
    step = max(1, SCORE_CELLS // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            column = batch.column(weights)
            offsets = column.offsets.to_numpy()
            low, high = int(offsets[0]), int(offsets[-1])
            found = pc.index_in(column.keys.slice(low, high - low), value_set=terms)
            at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            t = found.take(pa.array(at)).to_numpy()
            w = column.items.slice(low, high - low).take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.searchsorted(offsets, at + low, side="right") - 1
            for s in range(0, batch.num_rows, step):
                a, e = np.searchsorted(row, (s, s + step))
                n = sizes[t[a:e]]
                place = np.repeat(begins[t[a:e]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(row[a:e] - s, n) * len(names) + query[place]
                shape = (min(step, batch.num_rows - s), len(names))
                scores = np.bincount(cell, np.repeat(w[a:e], n) * weight[place], shape[0] * shape[1])
                shared = np.bincount(cell, minlength=shape[0] * shape[1]) > 0
                scores = np.where(shared, np.round(scores, SCORE_DIGITS), -np.inf).reshape(shape)
                some = np.flatnonzero(shared.reshape(shape).any(axis=1))
                if len(some):
                    hits = _hits(scores[some], batch.column(key).take(pa.array(some + s)), names, k, key)
                    yield hits.filter(pc.is_finite(hits.column("score")))

    return docs.select(key, weights).mapInArrow(run, schema)


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", weights: str = "sparse") -> DataFrame:
    """(qid, key, score, rank): dot product over shared terms; rows without a shared term don't match.

    Both sides are (id, map<term, weight>) tables with one row for each id. Up to ``QUERY_BLOCK`` queries of together
    ``MOST_POSTINGS`` terms go to the tasks as postings, and the rows are scanned in place: only k rows per query
    and batch leave a task, also where a term stands in every row. Beyond that terms are joined by hash.
    """
    q = queries.select("qid", F.explode(weights).alias("term", "wq")).filter("wq is not null")
    first = q.limit(MOST_POSTINGS + 1).toArrow()
    if first.num_rows <= MOST_POSTINGS and len(first.column("qid").unique()) <= QUERY_BLOCK:
        schema = f"qid {q.schema['qid'].dataType.simpleString()}, {key} {docs.schema[key].dataType.simpleString()}, score double"
        hits = _sparse_scan(docs, key, weights, first, k, schema) if first.num_rows else docs.sparkSession.createDataFrame([], schema)
        return _best(hits, k, key)
    d = docs.select(key, F.explode(weights).alias("term", "wd"))
    hits = d.join(q, "term").groupBy("qid", key).agg(F.round(F.sum(F.col("wd").cast("double") * F.col("wq").cast("double")), SCORE_DIGITS).alias("score"))
    return _best(hits, k, key)


def hybrid_topk(dense: DataFrame, sparse: DataFrame, k: int, key: str, rrf_k: int = 2) -> DataFrame:
    """Fuse two ranked lists (qid, key, rank from 1) without weights, counting ranks from 0."""
    both = dense.select("qid", key, "rank").unionByName(sparse.select("qid", key, "rank"))
    hits = both.groupBy("qid", key).agg(F.round(F.sum(1 / (rrf_k + F.col("rank") - 1 + F.lit(0.0))), 12).alias("score"))
    return _best(hits, k, key)


def text_points(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of the text index: payload and vectors (``embeddings``: chunk_id, dense, sparse)."""
    return chunks.join(embeddings, "chunk_id").select(
        tx.point_id(F.col("chunk_id")).alias("point_id"), "chunk_id", "doc_id", "page_index", "text", "region_ids", "category", F.lit("text").alias("modality"), "dense", "sparse"
    )


def image_points(regions: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Rows of the image index (``embeddings``: region_id, image); null captions and crops become empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return regions.join(embeddings, "region_id").select(
        tx.point_id(F.col("region_id")).alias("point_id"), "region_id", "doc_id", "page_index", "category", empty("caption"), empty("crop_path"), F.lit("image").alias("modality"), "image"
    )


def upsert(stored: DataFrame | None, arrived: DataFrame, key: str = "point_id", order: str | Column | None = None) -> DataFrame:
    """``stored`` with ``arrived`` put in by key; of several arrivals the last by ``order`` wins.

    Keys are replaced by an anti-join, so stored rows are not sorted; without ``order`` arrivals must be unique.
    """
    if order is not None:
        names = [c for c in arrived.columns if c != key]
        newest = arrived.groupBy(key).agg(F.max_by(F.struct(*names), F.col(order) if isinstance(order, str) else order).alias("row"))
        arrived = newest.select(key, *[F.col(f"row.{c}").alias(c) for c in names])
    if stored is None:
        return arrived
    arrived = arrived.select(*stored.columns)
    return stored.join(arrived.select(key), key, "left_anti").select(*stored.columns).unionByName(arrived)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been done yet."""
    return rows.join(done.select(key), key, "left_anti")


def update_payload(stored: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``stored`` with one payload column replaced where ``new`` (key, column) has a value; one row per key in ``new``."""
    fresh = new.select(key, F.col(column).alias("fresh_value"))
    out = stored.join(fresh, key, "left").withColumn(column, F.coalesce("fresh_value", column))
    return out.select(*stored.columns)


def point_ids(stored: DataFrame) -> DataFrame:
    return stored.select("point_id")


def fetch_in_order(stored: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows for each query's list of ids (qid, ids) in list order: missing ids drop out, repeated ones repeat."""
    each = wanted.select("qid", F.posexplode("ids").alias("pos", key))
    return each.join(stored, key).withColumn("score", F.lit(0.0))


def fetch_documents(stored: DataFrame, doc_ids: list[str], limit: int, key: str = "chunk_id") -> DataFrame:
    """Up to ``limit`` rows of the given documents, smallest keys first."""
    return match_documents(stored, doc_ids).orderBy(key).limit(limit)
