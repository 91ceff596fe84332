"""Files of folders, listed and read by the workers, so that no process holds the names of all."""

from __future__ import annotations

import functools
import hashlib
import math
import os
import re
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.blocks import partitions
from framewright.storage import filesystem, matching_paths, materialise

NAMES = 10_000  # names, or bytes of contents, that a worker hands on at once
BYTES = 16 << 20
TASK = 50_000  # files that a task reads

Header = Callable[[bytes], tuple[int, int, str] | None]
_FACTS = [("objectid", pa.string(), T.StringType()), ("width", pa.int32(), T.IntegerType()), ("height", pa.int32(), T.IntegerType()), ("format", pa.string(), T.StringType()), ("modified", pa.timestamp("us", tz="UTC"), T.TimestampType())]


@functools.lru_cache(8)
def _root(scheme: str, rest: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(f"{scheme}://{rest}/")
    return fs, at.rstrip("/")


def opened(path: str) -> tuple[pafs.FileSystem | None, str]:
    """The file system of a path, None where it is the local one, and the path on it."""
    named = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)/?(.*)$", path, re.S)
    if named is None or named[1] == "file":
        return None, filesystem(path)[1] if named is None else "/" + named[3]
    fs, at = _root({"s3a": "s3", "s3n": "s3"}.get(named[1], named[1]), named[2])
    return fs, f"{at}/{named[3]}"


def hidden(name: str) -> bool:
    """Whether Spark's own readers pass a file or a folder of this name over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata")))


def _entries(folder: str) -> Iterator[tuple[str, bool]]:
    """(path, whether it is a folder) of what lies in a folder."""
    fs, at = opened(folder)
    if fs is None:
        with os.scandir(at) as found:
            for e in found:
                if not hidden(e.name) and ((down := e.is_dir()) or e.is_file()):
                    yield f"{at.rstrip('/')}/{e.name}", down
        return
    for e in fs.get_file_info(pafs.FileSelector(at)):
        if not hidden(e.base_name):
            yield f"{folder.rstrip('/')}/{e.base_name}", e.type == pafs.FileType.Directory


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            found = _entries(folder)
            while some := list(islice(found, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.string()), pa.array([d for _, d in some], pa.bool_())], names=["path", "folder"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path) of all files below a folder, or the folders that a pattern names; those of the local file system without a scheme.

    Folders of one depth are listed at once, each by one task, which hands names on as it reads them, and the names are written to the
    shared folder. Of other file systems than the local one a task holds the names of a folder.
    """
    roots = matching_paths(spark, path)
    known = [(re.sub(r"^file:(//)?(?=/)", "", p), down) for p, down in roots]
    levels = [spark.createDataFrame([(p,) for p, down in known if not down], "path string")]
    folders = spark.createDataFrame([(p,) for p, down in known if down], "path string")
    while not folders.isEmpty():
        level = materialise(folders.repartition(partitions(spark)).mapInArrow(_list, "path string, folder boolean"), "names")
        levels.append(level.filter("not folder").select("path"))
        folders = level.filter("folder").select("path")
    return functools.reduce(DataFrame.unionByName, levels)


def _contents(path: str) -> tuple[bytes, datetime]:
    fs, at = opened(path)
    if fs is None:
        with open(at, "rb") as file:
            return file.read(), datetime.fromtimestamp(os.fstat(file.fileno()).st_mtime, timezone.utc)
    with fs.open_input_stream(at) as file:
        return file.read(), fs.get_file_info([at])[0].mtime


def _read(path: str, header: Header | None, keep: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, start = batch.schema.get_field_index(path), 0
            facts, contents, held = [], [], 0
            for k, name in enumerate(batch.column(at).to_pylist()):
                raw, modified = _contents(name)
                facts.append((hashlib.sha256(raw).hexdigest(), *((header(raw) if header else None) or (None, None, None)), modified))
                if keep:
                    contents.append(raw)
                    held += len(raw)
                if held >= BYTES or k + 1 == batch.num_rows:
                    own = batch.slice(start, k + 1 - start)
                    new = [pa.array(x, kind) for x, (_, kind, _) in zip(zip(*facts, strict=True), _FACTS, strict=True)] + ([pa.array(contents, pa.binary())] if keep else [])
                    yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*own.schema.names, *(n for n, _, _ in _FACTS), *(["content"] if keep else [])])
                    facts, contents, held, start = [], [], 0, k + 1

    return of


def read_files(files: DataFrame, path: str, header: Header | None = None, content: bool = False) -> DataFrame:
    """The rows with what their files hold: objectid, width, height and format as ``header`` reads them, modified, and, where asked for, content.

    A worker holds one file at a time, or as many contents as ``BYTES`` takes.
    """
    kind = T.StructType([*files.schema.fields, *(T.StructField(n, k) for n, _, k in _FACTS), *([T.StructField("content", T.BinaryType())] if content else [])])
    return files.mapInArrow(_read(path, header, content), kind)


def spread(files: DataFrame, n: int) -> DataFrame:
    """The rows dealt to so many tasks that none reads very many files."""
    return files.repartition(max(partitions(files.sparkSession), math.ceil(n / TASK)))


__all__ = ["hidden", "list_files", "read_files", "spread"]
