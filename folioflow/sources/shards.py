"""Tar shards on any store that Spark reads, split into byte ranges.

A shard's bytes come from Spark's own fixed-length record reader, which splits a file and works on every
Hadoop file system. A split that begins inside a sample looks for the first block that is a member's header by
its checksum. Samples well inside a split are complete and leave its task at once; the bytes at a split's two ends
go to the shard's other ends, are laid end to end, and give the samples that lie across splits. There each
stretch must end just where the next split's first whole sample begins, so a block that only looks like a
header (a tar file inside a tar file) is noticed; such a shard has to be read with one split.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

BLOCK = 512
SPLIT_BYTES = 32 << 20
LONGEST_RECORD = 1 << 20
SAMPLE = "key string, image binary, meta string"
PART = f"shard string, at long, edge binary, {SAMPLE}"


def is_header(block: bytes) -> bool:
    """True for a block whose checksum field is the sum of its bytes, that field taken as spaces."""
    field = block[148:156].strip(b" \0")
    if len(block) < BLOCK or not field or field.strip(b"01234567"):
        return False
    return int(field, 8) == sum(block[:148]) + sum(block[156:BLOCK]) + 8 * 32


def first_header(data: bytes) -> int | None:
    """Where the first member's header begins, of data that begin at a block."""
    return next((at for at in range(0, len(data), BLOCK) if is_header(data[at : at + BLOCK])), None)


def sample_name(member: str) -> tuple[str, str]:
    """A member's sample and kind: its path up to the first dot of the last part, and the rest."""
    folder, slash, base = member.rpartition("/")
    stem, _, kind = base.partition(".")
    return folder + slash + stem, kind


def members(data: bytes, start: int = 0) -> Iterator[tuple[int, int, str, str, bytes | None]]:
    """(begin, end, sample, kind, content) of the members that are whole in ``data``, which has a header at ``start``.

    ``begin`` is where the headers of a long name begin, ``end`` the first block after the content; entries that
    aren't files have no content.
    """
    try:
        with tarfile.open(fileobj=io.BytesIO(memoryview(data)[start:]), mode="r:") as tar:
            for m in tar:
                begin, body = start + m.offset, start + m.offset_data
                size = m.size if m.isreg() else 0
                end = body + -(-size // BLOCK) * BLOCK
                if end > len(data):
                    return
                yield begin, end, *sample_name(m.name), data[body : body + size] if m.isreg() else None
    except tarfile.TarError:  # cut off in a header
        return


def whole_samples(found: list[tuple]) -> Iterator[tuple[str, bytes, str]]:
    """(key, image, meta) of neighbouring members that share a name, where both picture and JSON are there."""
    parts: dict[str, bytes] = {}
    current = None
    for *_, key, kind, content in [*found, (None, None, None)]:
        if key != current:
            if current is not None and {"png", "json"} <= parts.keys():
                yield current, parts["png"], parts["json"].decode("utf-8", "replace")
            current, parts = key, {}
        if content is not None:
            parts[kind] = content


def split_parts(shard: str, at: int, data: bytes) -> Iterator[tuple]:
    """Rows (PART) of one split: samples inside it, and the bytes before the first and after the last of them.

    The first group of members may go on from the split before, and a split may begin behind the header that holds
    a long name, so two groups are left to the edge; of the last one more may follow.
    """
    start = 0 if at == 0 else first_header(data)
    found = [] if start is None else list(members(data, start))
    groups = [i for i, m in enumerate(found) if i == 0 or m[2] != found[i - 1][2]]
    head = 0 if at == 0 else 2
    if len(groups) < head + 2:
        yield shard, at, data, None, None, None
        return
    inner = found[groups[head] : groups[-1]]
    for key, image, meta in whole_samples(inner):
        yield shard, None, None, key, image, meta
    if head:
        yield shard, at, data[: inner[0][0]], None, None, None
    tail = found[groups[-1]][0]
    yield shard, at + tail, data[tail:], None, None, None


def joined_edges(edges: list[tuple[int, bytes]]) -> Iterator[tuple[str, bytes, str]]:
    """Samples that lie across splits, from all edges (place, bytes) of a shard."""
    runs: list[list] = []
    for at, data in sorted(edges):
        if runs and runs[-1][0] + sum(map(len, runs[-1][1])) == at:
            runs[-1][1].append(data)
        else:
            runs.append([at, [data]])
    for k, (at, parts) in enumerate(runs):
        data = b"".join(parts)
        found = list(members(data))
        done = found[-1][1] if found else 0
        final = k == len(runs) - 1
        if (not final and done != len(data)) or (final and data[done : done + BLOCK].strip(b"\0")):
            raise ValueError(f"members don't meet at {at + done}: a block that isn't a header was taken for one, or the file is cut off; read the shard with one split")
        yield from whole_samples(found)


def record_length(size: int, limit: int = LONGEST_RECORD) -> int:
    """The longest record of whole blocks, up to ``limit``, that divides a file."""
    if size % BLOCK:
        raise ValueError("a tar file is a number of whole blocks")
    blocks = size // BLOCK
    return BLOCK * max((d for d in range(1, min(blocks, limit // BLOCK) + 1) if blocks % d == 0), default=1)


def shard_parts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, name: str | None = None) -> DataFrame:
    """Rows (PART) of one shard, called ``name`` there. A task holds one split."""
    name = path if name is None else name
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    if size == 0:
        return spark.createDataFrame([], PART)
    length = record_length(size, min(split_bytes, LONGEST_RECORD))
    conf = {
        "org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(length),
        "mapreduce.input.fileinputformat.split.maxsize": str(max(split_bytes, length)),
    }
    records = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)

    def parts(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        place, blobs = None, []
        for index, blob in rows:
            place = index if place is None else place
            blobs.append(bytes(blob))
        if blobs:
            data = b"".join(blobs)
            yield from split_parts(name, place * length, data)

    return spark.createDataFrame(records.mapPartitions(parts), PART)


def read_samples(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(key, image, meta) of the samples of all shards that have both a picture and their JSON.

    Equal to a sequential reading, in no order. Splits are read twice: for the samples inside them, and for
    their edges. Edges meet by shard; a shard's are at most a few samples for each of its splits.
    """
    ship(spark)
    found = None
    for k, path in enumerate(paths):
        one = shard_parts(spark, path, split_bytes, f"{k} {path}")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], SAMPLE)

    def join(table):
        import pyarrow as pa

        rows = list(joined_edges(list(zip(table["at"].to_pylist(), table["edge"].to_pylist(), strict=True))))
        keys, images, metas = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.table([pa.array(keys, pa.string()), pa.array(images, pa.binary()), pa.array(metas, pa.string())], names=["key", "image", "meta"])

    across = found.filter("edge is not null").select("shard", "at", "edge").groupBy("shard").applyInArrow(join, SAMPLE)
    return found.filter("edge is null").select("key", "image", "meta").unionByName(across)
