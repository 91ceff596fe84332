"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths that this process made up in the shared folder; what is left of them goes when it ends.
_written: dict[str, None] = {}


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system it is on, so that every reader takes it for the same."""
    target, fs = _hadoop(spark, path)
    return fs.makeQualified(target).toString()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """For workers: the file system of a qualified path and the path on it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) and not path.startswith("file:"):
        raise ValueError(f"not a path that workers can open: {path}")
    return pafs.LocalFileSystem(), re.sub(r"^file:", "", path)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop(spark, path)
    return fs.exists(target)


def matching_paths(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what a path, which may be a pattern, names."""
    target, fs = _hadoop(spark, path)
    found = [(x.getPath().toString(), x.isDirectory()) for x in fs.globStatus(target) or ()]
    if not found:
        raise FileNotFoundError(path)
    return found


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset a local master, as in tests, gets a temporary folder; a cluster none."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="framewright-")
    where = qualified(spark, where)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    if not _written:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = None
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the rows to the shared folder and read them again: no lineage, and no executor that must not be lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that this session wrote."""
    target, fs = _hadoop(spark, path)
    fs.delete(target, True)
    _written.pop(path, None)


def written() -> set[str]:
    return set(_written)


def release(keep: set[str] | None = None) -> None:
    """Delete the tables written so far, but those to keep. What still reads them can't be worked out any more."""
    if SparkContext._active_spark_context is None or SparkContext._active_spark_context._jsc is None:
        return
    spark = SparkSession.getActiveSession()
    for path in [p for p in _written if p not in (keep or ())] if spark else []:
        try:
            remove(spark, path)
        except Exception:  # the process ends, or the folder has gone before
            return
