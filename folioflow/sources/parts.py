"""One file out of parts that executors write, for formats that are a single document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def write_whole(pieces: list[bytes | DataFrame], path: str, skip: int = 0) -> None:
    """One file at ``path``, put in place at the end: bytes, and the rows (value string) of tables, a line each.

    The executors write the lines in parallel; the parts are then copied one after the other, byte by byte
    through the file system, so the driver holds no row of them; they are zipped, and go once copied. The first ``skip`` bytes of each table are
    left out: rows may begin with a separator.
    """
    spark = next(p for p in pieces if isinstance(p, DataFrame)).sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs, parts = at(path).getFileSystem(conf), f"{path}.parts-{uuid.uuid4().hex}"
    try:
        for k, piece in enumerate(pieces):
            if isinstance(piece, DataFrame):
                piece.write.text(f"{parts}/{k}", compression="gzip")
        out = fs.create(at(f"{parts}/whole"))
        for k, piece in enumerate(pieces):
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
                continue
            left = skip
            unzip = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
            found = [s for s in fs.listStatus(at(f"{parts}/{k}")) if s.getPath().getName().startswith("part-") and s.getLen()]
            for name in sorted(s.getPath().toString() for s in found):
                part = unzip.getCodec(at(name)).createInputStream(fs.open(at(name)))
                if left and part.read() >= 0:  # a zipped part without rows isn't empty
                    jvm.org.apache.hadoop.io.IOUtils.skipFully(part, left - 1)
                    left = 0
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                part.close()
                fs.delete(at(name), False)
        out.close()
        fs.delete(at(path), True)
        fs.rename(at(f"{parts}/whole"), at(path))
    finally:
        fs.delete(at(parts), True)
