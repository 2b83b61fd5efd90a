"""Token-id files: whole texts to ids, written in document order as range-coded blocks, and read back.

A file set is a folder of Parquet files with one row for each block: the partition it belongs to, its
place there, the ids and lengths of its documents, and the coded ids (``range_coder``). A block holds
whole documents and is coded on its own. Spark's own writer commits the files, on any store, so a lost
executor costs a task's repetition and no half-written file counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import range_coder
from .bpe import blocks
from .packing import tokeniser
from .workspace import ship, spare_name

END_ID = 2
BLOCK_IDS = 2_000_000


def write(docs: DataFrame, path: str, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode all texts and write them to the new folder ``path`` in ascending order of ``id_col``, nulls first.

    Null texts count as empty and are the end id alone. Rows that share an id, or have none, are written
    each for itself, ordered by a hash of their texts. Other columns are not read, whatever their names. An
    empty table gives a folder without blocks. A block has ``block_ids`` ids or little more; a longer text
    is a block of its own.
    """
    kind = docs.schema[id_col].dataType
    fields = [("part", T.IntegerType()), ("block", T.LongType()), ("start", T.LongType()), ("n_ids", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("lengths", T.ArrayType(T.LongType())), ("coded", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        coder, part = tokeniser(vocab_path), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        keys: list = []
        ids: list[np.ndarray] = []
        block = start = held = 0

        def emit(key_type: pa.DataType) -> pa.RecordBatch:
            all_ids, sizes = np.concatenate([x for d in ids for x in (d, end)]), [len(d) + 1 for d in ids]
            row = [pa.array([part], pa.int32()), pa.array([block]), pa.array([start]), pa.array([len(all_ids)]), pa.array([keys], pa.list_(key_type)), pa.array([sizes]), pa.array([range_coder.encode_block(all_ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names)

        for batch in batches:
            key_type = batch.schema.field(id_col).type
            for piece in blocks(batch, text_col):
                for key, text in zip(piece.column(id_col).to_pylist(), piece.column(text_col).to_pylist(), strict=True):
                    new = coder.ids(text or "")
                    if held and held + len(new) >= block_ids:
                        yield emit(key_type)
                        block, start, held, keys, ids = block + 1, start + held, 0, [], []
                    keys.append(key)
                    ids.append(new)
                    held += len(new) + 1
        if held:
            yield emit(key_type)

    ship(docs.sparkSession)
    tie = spare_name([id_col, text_col], "text_hash")
    ordered = docs.select(id_col, text_col, F.xxhash64(text_col).alias(tie)).orderBy(F.col(id_col).asc_nulls_first(), tie)
    ordered.select(id_col, text_col).mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: its id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids``.

    The id column is named ``doc_id``; ``ids`` are packed little-endian unsigned 32-bit integers with the end
    id. A damaged block raises an error. To the driver come the numbers of ids by partition of the writing job.
    """
    table = spark.read.parquet(path)
    totals = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, before = {}, 0
    for part in sorted(totals):
        first[part] = before
        before += totals[part]
    kind = table.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, doc_ids, lengths, coded = (batch.column(c)[k] for c in ("part", "start", "doc_ids", "lengths", "coded"))
                ids = range_coder.decode_block(coded.as_buffer())
                sizes = lengths.values.to_numpy(zero_copy_only=False)
                upto = np.concatenate(([0], np.cumsum(sizes)))
                if upto[-1] != len(ids):
                    raise ValueError("a block's documents don't add up to its ids")
                places = pa.py_buffer((4 * upto).astype(np.int32).tobytes())
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places, pa.py_buffer(ids.tobytes())])
                begin = pa.array(first[part.as_py()] + start.as_py() + upto[:-1])
                yield pa.RecordBatch.from_arrays([doc_ids.values, begin, pa.array(sizes), packed], schema.names)

    ship(spark)
    return table.select("part", "start", "doc_ids", "lengths", "coded").mapInArrow(run, schema)
