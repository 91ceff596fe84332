"""Datasets: DataFrames with an order.

A dataset is a DataFrame with one row an item and a hidden ordinal ``_pos``. Order is part of its meaning for first-wins,
stable sorting, taking and numbering; partition order never is. ``_pos`` only has to ascend, so numbering anew after a
sort needs no pass of its own. Concatenation adds ``_src``, the number of the source, instead of shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POS, SRC = "_pos", "_src"
IMAGE_SCHEMA = "_pos long, objectid string, original_path string, ext string, width int, height int, format string"


def order_columns(df: DataFrame) -> list[str]:
    found = [c for c in (SRC, POS) if c in df.columns]
    if POS not in found:
        raise ValueError("a dataset needs the column _pos; see with_positions")
    return found


def with_positions(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Number rows in the order of the keys by a range sort: no single partition ever holds all rows."""
    return df.drop(SRC, POS).orderBy(*keys).withColumn(POS, F.monotonically_increasing_id()) if keys else df.drop(SRC, POS).withColumn(POS, F.monotonically_increasing_id())


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*order_columns(df))


def prop(df: DataFrame, name: str, kind: str | T.DataType) -> DataFrame:
    """The dataset with a property: a column of nulls where it had none."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def visible(df: DataFrame, hidden: bool = False) -> list[str]:
    """Names of properties; those that begin with an underscore are hidden."""
    return [c for c in df.columns if hidden or not c.startswith("_")]


def aspect_ratio() -> Column:
    return F.col("width").cast("double") / F.nullif(F.col("height").cast("double"), F.lit(0.0))
