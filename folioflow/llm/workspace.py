"""Where intermediate tables live, and how lineage is cut.

``cut`` writes a table to the folder named by ``spark.checkpoint.dir``. All executors and the
driver share that folder, so a lost executor costs a re-read and not a recomputation. Spark's
context cleaner removes the files once no plan refers to them, when
``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
"""

from __future__ import annotations

import gc
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Take ``spark.checkpoint.dir`` from the session; choose a folder only where it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioflow-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame, release: bool = False) -> DataFrame:
    """Compute ``df`` once into the shared folder and return a table that reads it back.

    ``release`` then lets Spark's cleaner drop the shuffle files of what led here: it does so for plans
    that the driver's garbage collector has found unused, which otherwise may take half an hour.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    if release:
        del df
        release_unused(spark)
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release_unused(spark: SparkSession) -> None:
    """Have the driver find plans that nothing refers to any more, so that their files can go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spare_name(columns: list[str], wanted: str) -> str:
    """A column name that clashes with none of ``columns``, which Spark compares ignoring case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, through Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_folioflow_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    archive = pathlib.Path(tempfile.mkdtemp(prefix="folioflow-ship-")) / "folioflow-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._folioflow_shipped = True
