"""The folder all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def root(spark: SparkSession) -> str:
    """URI of the shared folder: ``spark.checkpoint.dir``, or on one machine, where that is unset, a temporary folder that
    goes with the driver. Elsewhere it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidewatch-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = _OWN[spark.sparkContext.applicationId] = "file://" + own
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared folder; two calls never give the same one."""
    _MADE.append(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def sweep(spark: SparkSession, since: int) -> None:
    """Delete the folders made since ``since`` (a length of ``made``) but the last, which holds all that is needed on."""
    for uri in _MADE[since:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _MADE[since:-1]


def made() -> int:
    return len(_MADE)


def local_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder as a path that Python on every node can open; the shared folder must be mounted."""
    uri = urlparse(folder(spark, name))
    if uri.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri.scheme}:")
    os.makedirs(uri.path, exist_ok=True)
    return uri.path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def trimmed(task, owner: str = ""):
    """``task`` over batches that gives freed memory back at its end; a reused worker would else keep its peak. Caches that
    tasks of another ``owner`` left in the worker are dropped first."""

    def run(batches):
        release(owner)
        try:
            yield from task(batches)
        finally:
            release(owner, ended=True)
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """A worker's objects by name, kept from one task of ``owner`` to the next; those with a method ``rest`` are told of a
    task's end."""
    return _CACHES.setdefault(owner, {})


def release(owner: str, ended: bool = False) -> None:
    for name in [k for k in _CACHES if k != owner]:
        del _CACHES[name]
    if ended:
        for kept in _CACHES.get(owner, {}).values():
            getattr(kept, "rest", lambda: None)()
