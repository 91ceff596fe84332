"""What the operators' entry points share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.storage import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as a long, and the text: no other column is read or can clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of the columns'."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def text_hash(text: Column) -> Column:
    """60 bits of a text's MD5, by which different texts under one id are told apart; null for a null text."""
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(15)), 16, 10).cast("long")


def settled(df: DataFrame) -> DataFrame:
    """Rows whose partitions are the same however often a task is run again: those of a plain scan, else a written copy."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df if "FileScan" in plan and not any(x in plan for x in ("Exchange", "Arrow", "Python", "Pandas", "rand(")) else materialise(df, "settled")


def ship(spark: SparkSession, path: str) -> None:
    """Send a vocabulary file, a few megabytes, to every worker, whether or not it has the path itself."""
    spark.sparkContext.addFile(path)


def local_copy(path: str) -> str:
    """Where a file that was shipped lies on this machine; the path itself where none was."""
    from pyspark import SparkFiles

    try:
        own = SparkFiles.get(path.rsplit("/", 1)[-1])
    except Exception:  # outside of Spark
        return path
    return own if os.path.exists(own) else path


def int_lists(values, counts) -> pa.ListArray:
    """Arrow lists of int32 from the values one after the other and each list's length."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
