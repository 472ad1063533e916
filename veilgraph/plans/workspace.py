"""Intermediate results that outlive executors.

Long jobs cut their lineage by writing a Parquet table to the folder that the
cluster shares between the driver and the executors (``spark.checkpoint.dir``).
A lost executor then costs the tasks it was running, never a finished step.

Small tables that are read again soon are held on the executors' disks instead, with their lineage: what
a lost executor held is computed again.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Columns, as arrays, of tables that the driver made from them.
_AT_HAND: weakref.WeakKeyDictionary[DataFrame, dict[str, np.ndarray]] = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The shared folder: what spark.checkpoint.dir names; unset, a folder of our own in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="veilgraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


#: Rows of a small table that one file should hold, and so one task write.
FILE_ROWS = 1 << 16


def materialize(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there; in few files where it is known to have few rows."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/veilgraph/{uuid.uuid4().hex}"
    if most_rows is not None and most_rows <= 64 * FILE_ROWS:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks once it has been computed. Its lineage stays, so lost parts are computed again; not for loops, where lineage would grow."""
    return df.persist(StorageLevel.DISK_ONLY)


def keep_at_hand(df: DataFrame, columns: dict[str, np.ndarray]) -> DataFrame:
    """``df``, of which the driver has these columns as arrays, for as long as it is used."""
    _AT_HAND[df] = columns
    return df


def at_hand(df: DataFrame, column: str) -> np.ndarray | None:
    """A column of a table as an array if the driver has it; None if it would have to be collected."""
    return _AT_HAND.get(df, {}).get(column)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = shared_root(spark)
        folders = {f.rpartition("/")[0] for f in df.inputFiles()}
        for folder in folders:
            if "/veilgraph/" in folder and folder.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps, rather than whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _number(setting: str) -> int:
    """A setting's number, of bytes if it has a unit."""
    digits, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(digits) << 10 * " kmgtp".find(unit.strip("b")[:1] or " ")


def bounded_batches(spark: SparkSession, records: int = 2000, size: int = 8 << 20) -> None:
    """Keep Arrow batches small enough for rows with very long texts: the session's bounds are lowered to these where they are above.

    They have to hold when a plan runs, which is after the operator that made it has returned, so they stay.
    """
    for key, most in (("maxRecordsPerBatch", records), ("maxBytesPerBatch", size)):
        now = _number(spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def freeing(function):
    """``function`` over Arrow batches, giving the memory that it no longer needs back to the system at the end of a task.

    Python workers stay for later tasks; what their allocators keep would count against an executor whose next stage needs it.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim is not None:
                trim(0)

    return run
