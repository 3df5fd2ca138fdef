"""Session helpers: ship this package to Python workers that don't have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Bytes of the batches that go to Python workers, where the session has Spark's own 64 MB: buffers of that size, held several
#: times over on either side, are much of an executor's memory.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8388608b")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a context, once; Spark's file server hands it to each executor."""
    name, default, own = ARROW_BYTES
    if spark.conf.get(name, None) == default:
        spark.conf.set(name, own)
    sc = spark.sparkContext
    if getattr(sc, "_floorspan_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="floorspan_"))  # the driver serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "floorspan_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(target)
    sc._floorspan_shipped = True


def checkpoint_ready(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names; only in local mode, where none is set, one beside the warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared checkpoint folder.

    What is read has the size of its files, whatever it was made of: after ``checkpoint()`` a frame keeps the planner's estimate, which
    multiplies with each join, so that loops of joins soon plan for numbers of millions of digits and never broadcast anything.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._floorspan_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that ``cut`` has made of a frame, once nothing reads it any more."""
    path = getattr(df, "_floorspan_path", None)
    if path is not None:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    return f"{checkpoint_ready(spark)}/scratch-{uuid.uuid4().hex}"
