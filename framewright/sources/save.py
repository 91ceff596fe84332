"""Saving a dataset: names, captions, sidecars, contents and an index."""

from __future__ import annotations

import html
import json
import logging
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from framewright.frame import in_order, order_columns, visible
from framewright.functions.strings import save_stem
from framewright.plans.operator import Operator
from framewright.storage import filesystem, qualified, remove


def manifest(df: DataFrame, by_format: bool = False) -> DataFrame:
    """The rows with ``_file``: the stem of the original name, the objectid, and a number from the second such row on.

    The extension is that of the original file, or of the format where asked for.
    """
    named = df.withColumn("_stem", save_stem(F.col("original_path"), F.col("objectid")))
    k = F.row_number().over(Window.partitionBy("_stem").orderBy(*order_columns(df))) - 1
    ends = F.when(F.col("format") == "JPEG", ".jpg").otherwise(F.concat(F.lit("."), F.lower("format"))) if by_format else F.col("ext")
    return named.withColumn("_k", k).withColumn("_stem", F.when(F.col("_k") > 0, F.concat("_stem", F.lit("_"), F.col("_k").cast("string"))).otherwise(F.col("_stem"))).withColumn("_file", F.concat("_stem", ends)).drop("_k")


def sidecars(df: DataFrame) -> DataFrame:
    """Rows (_stem, sidecar): the visible properties that have a value, as JSON."""
    return df.select("_stem", F.to_json(F.struct(*(F.col(f"`{c}`") for c in visible(df)))).alias("sidecar"))


def _plain(x):
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items()}
    return [_plain(v) for v in x] if isinstance(x, list) else x.hex() if isinstance(x, bytes | bytearray) else x


def shortened(x, longest: int = 100):
    return [*x[:25], "...", *x[-25:]] if isinstance(x, list) and len(x) > longest else x


def index_html(df: DataFrame) -> Iterator[str]:
    """The pieces of a page with a table of all rows; the driver holds one partition at a time."""
    shown = visible(df)
    some = df.agg(*(F.count(F.col(f"`{c}`")) for c in shown)).first() if shown else ()
    names = [c for c, n in zip(shown, some, strict=True) if n]
    yield f"<!doctype html><meta charset=utf-8><table><tr><th>image</th>{''.join(f'<th>{html.escape(c)}</th>' for c in names)}</tr>"
    for r in in_order(df).toLocalIterator():
        image = f'<td><img src="{html.escape(r["_file"])}"></td>' if "_file" in df.columns else "<td></td>"
        cells = "".join(f"<td>{html.escape(json.dumps(shortened(_plain(r[c])), default=str, ensure_ascii=False)) if r[c] is not None else ''}</td>" for c in names)
        yield f"<tr>{image}{cells}</tr>"
    yield "</table>"


def clusters_page(df: DataFrame, clusters: DataFrame) -> Iterator[str]:
    """The pieces of a page of all clusters of more than one image, largest first."""
    shown = df.join(clusters.filter("size > 1").select("objectid", "root", "size"), "objectid").orderBy(F.desc("size"), "root", "objectid")
    last = None
    yield "<!doctype html><meta charset=utf-8>"
    for r in shown.toLocalIterator():
        if r.root != last:
            yield f"<h2>{r['size']} images</h2>"
            last = r.root
        path = html.escape(str(r.original_path))
        yield f'<p><img src="{path}" loading="lazy" height="200"> {path} {r.width}x{r.height} {r.format}</p>'


def clusters_html(df: DataFrame, clusters: DataFrame, path: str) -> None:
    _write_text(df.sparkSession, path, clusters_page(df, clusters))


def _write_text(spark: SparkSession, path: str, pieces: Iterator[str]) -> None:
    """Write a file piece by piece."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    held: list[str] = []
    for piece in pieces:
        held.append(piece)
        if len(held) == 1000:
            stream.write(bytearray("".join(held).encode()))
            held.clear()
    stream.write(bytearray("".join(held).encode()))
    stream.close()


class Save(Operator):
    """Write images, captions and sidecars to a folder that all executors share, which is deleted first; rows pass unchanged.

    An image is taken from the object store, else from its original path. Where neither has it, or the path's folder may
    not be entered, the row's caption and sidecar are written all the same, and a warning says how many images are missing.

    ``table`` writes one Parquet table (file, content, caption, sidecar) instead of a file a row, which suits object
    stores and very many rows.
    """

    def __init__(self, dir: str = "output", captions: bool = True, sidecars: bool = True, caption_ext: str = ".txt", index: bool = True, by_format: bool = False, table: bool = False):
        super().__init__()
        self.dir, self.captions, self.sidecars, self.caption_ext, self.index, self.by_format, self.table = dir, captions, sidecars, caption_ext, index, by_format, table

    def eval(self, dataset: DataFrame) -> DataFrame:
        target = self.workspace.resolve(self.dir)
        remove(self.workspace.spark, target)
        named = manifest(dataset, self.by_format)
        caption = F.nullif(F.col("caption"), F.lit("")) if self.captions and "caption" in dataset.columns else F.lit(None).cast("string")
        facts = F.to_json(F.struct(*(F.col(f"`{c}`") for c in visible(dataset)))) if self.sidecars else F.lit(None).cast("string")
        rows = named.select("_stem", "_file", "original_path", "objectid", caption.alias("caption"), facts.alias("sidecar"))
        rows = self.workspace.objects.get(rows)
        if self.table:
            rows.select(F.col("_file").alias("file"), "content", "caption", "sidecar").write.parquet(target)
        else:
            folder, caption_ext = qualified(self.workspace.spark, target), self.caption_ext
            missing = self.workspace.spark.sparkContext.accumulator(0)

            def write(part: Iterator[Row]) -> None:
                fs, at = filesystem(folder)
                fs.create_dir(at, recursive=True)

                def put(name: str, data: bytes) -> None:
                    with fs.open_output_stream(f"{at}/{name}") as out:
                        out.write(data)

                for r in part:
                    source = Path(r.original_path)
                    if r.content is not None:
                        put(r._file, bytes(r.content))
                    elif os.path.exists(source):  # unlike Path.exists not an error where the path can't be asked for
                        if isinstance(fs, pafs.LocalFileSystem):
                            _link(source, Path(at) / r._file)
                        else:
                            put(r._file, source.read_bytes())
                    else:
                        missing.add(1)
                    if r.caption:
                        put(f"{r._stem}{caption_ext}", r.caption.encode())
                    if r.sidecar:
                        put(f"{r._stem}.json", r.sidecar.encode())

            rows.foreachPartition(write)
            if missing.value:
                logging.getLogger("framewright").warning("%s: %d images are neither in the object store nor at their original path", target, missing.value)
        if self.index and not dataset.isEmpty():
            _write_text(self.workspace.spark, f"{target}/index.html" if not self.table else f"{target}.html", index_html(named.drop("_stem")))
        return dataset


def _link(source: Path, target: Path) -> None:
    """A hard link, or a copy where there can be none."""
    import shutil

    target.unlink(missing_ok=True)
    try:
        os.link(source, target)
    except OSError:
        shutil.copyfile(source, target)


__all__ = ["Save", "clusters_html", "index_html", "manifest", "sidecars"]
