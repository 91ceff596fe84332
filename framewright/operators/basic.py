"""Loading, filtering, mapping, ordering, sampling and joining datasets."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.frame import POS, SRC, aspect_ratio, in_order, order_columns, prop, visible, with_positions
from framewright.functions.keys import memo_key_column
from framewright.functions.strings import elide, extension
from framewright.plans.operator import Abort, Operator
from framewright.sources.images import FACTS, list_images, read_facts

log = logging.getLogger("framewright")


class Load(Operator):
    """All JPEG, PNG and WEBP images below a folder, by path.

    What a file holds is kept in the memo store under its path, also that it is no image; only files that are new are read.
    """

    def __init__(self, folder: str):
        super().__init__()
        self.folder = folder

    def eval(self) -> DataFrame:
        spark = self.workspace.spark
        files = list_images(spark, self.folder)
        known = self.workspace.memo.fill(files, memo_key_column("load", F.col("original_path")), read_facts, "_facts", FACTS, scope="load")
        return with_positions(known.filter("_facts is not null").select("original_path", "_facts.objectid", extension(F.col("original_path")).alias("ext"), "_facts.width", "_facts.height", "_facts.format"), "original_path")


class From(Operator):
    """A DataFrame as a dataset; it is numbered by the keys unless it has positions."""

    def __init__(self, df: DataFrame, *keys: str | Column):
        super().__init__()
        self.df, self.keys = df, keys

    def eval(self) -> DataFrame:
        return self.df if POS in self.df.columns and not self.keys else with_positions(self.df, *self.keys)


def size_filter(min_width=None, min_height=None, min_edge=None, max_width=None, max_height=None, max_edge=None) -> Column:
    """Inclusive bounds; ``min_edge`` on the shorter side, ``max_edge`` on the longer. None and 0 are no bounds."""
    w, h = F.col("width"), F.col("height")
    tests = [c >= b for c, b in ((w, min_width), (h, min_height), (F.least(w, h), min_edge)) if b] + [c <= b for c, b in ((w, max_width), (h, max_height), (F.greatest(w, h), max_edge)) if b]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


class FilterBySize(Operator):
    def __init__(self, min_width=None, min_height=None, min_edge=None, max_width=None, max_height=None, max_edge=None):
        super().__init__()
        self.bounds = (min_width, min_height, min_edge, max_width, max_height, max_edge)

    def eval(self, dataset: DataFrame) -> DataFrame:
        return dataset.filter(size_filter(*self.bounds))


class FilterByAspectRatio(Operator):
    """Inclusive bounds on width / height; None and 0 are no bounds."""

    def __init__(self, min_aspect: float | None = None, max_aspect: float | None = None):
        super().__init__()
        self.low, self.high = min_aspect, max_aspect

    def eval(self, dataset: DataFrame) -> DataFrame:
        tests = ([aspect_ratio() >= F.lit(float(self.low))] if self.low else []) + ([aspect_ratio() <= F.lit(float(self.high))] if self.high else [])
        return dataset.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


def _batches(function: Callable[[Any], Any], many: bool):
    """A Python function of rows over Arrow batches."""

    def run(frames):
        for frame in frames:
            rows = [function(row) for row in frame.itertuples(index=False)]
            if many:
                yield pd.DataFrame([dict(r._asdict() if hasattr(r, "_asdict") else r) for r in rows], columns=frame.columns)
            else:
                yield frame[[bool(r) for r in rows]]

    return run


class Filter(Operator):
    """Rows for which a predicate holds: a column, SQL text, or a Python function of a row. Null drops the row."""

    def __init__(self, predicate: Column | str | Callable[[Any], Any]):
        super().__init__()
        self.predicate = predicate

    def eval(self, dataset: DataFrame) -> DataFrame:
        if isinstance(self.predicate, Column | str):
            return dataset.filter(self.predicate)
        hidden = {c: f"p{c}" for c in dataset.columns if c.startswith("_")}
        named = dataset.withColumnsRenamed(hidden)
        return named.mapInPandas(_batches(self.predicate, False), named.schema).withColumnsRenamed({v: k for k, v in hidden.items()})


class Map(Operator):
    """``f(DataFrame) -> DataFrame`` of columns, or, with ``rows``, a Python function from a row to a mapping."""

    def __init__(self, function: Callable[[Any], Any], rows: bool = False):
        super().__init__()
        self.function, self.rows = function, rows

    def eval(self, dataset: DataFrame) -> DataFrame:
        if not self.rows:
            return self.function(dataset)
        hidden = {c: f"p{c}" for c in dataset.columns if c.startswith("_")}
        named = dataset.withColumnsRenamed(hidden)
        return named.mapInPandas(_batches(self.function, True), named.schema).withColumnsRenamed({v: k for k, v in hidden.items()})


class Apply(Operator):
    """Named columns, ``Apply(caption=F.upper("caption"))``, or a function run for each partition's rows for its effect."""

    def __init__(self, effect: Callable[[Any], None] | None = None, **columns: Column):
        super().__init__()
        self.effect, self.columns = effect, columns

    def eval(self, dataset: DataFrame) -> DataFrame:
        if self.effect is not None:
            effect = self.effect
            dataset.foreachPartition(lambda rows: [effect(r) for r in rows] and None)
        return dataset.withColumns(self.columns) if self.columns else dataset


class Set(Operator):
    """Properties in the order given, later ones seeing earlier: constants, columns or functions of the DataFrame's columns."""

    def __init__(self, **props: Any):
        super().__init__()
        self.props = props

    def eval(self, dataset: DataFrame) -> DataFrame:
        for name, value in self.props.items():
            value = value(dataset) if callable(value) and not isinstance(value, Column) else value
            if not isinstance(value, Column):
                value = F.array(*map(F.lit, sorted(value))) if isinstance(value, set | frozenset) else F.array(*map(F.lit, value)) if isinstance(value, list | tuple) else F.lit(value)
            dataset = dataset.withColumn(name, value)
        return dataset


class SetCaption(Operator):
    def __init__(self, caption: str):
        super().__init__()
        self.caption = caption

    def eval(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("caption", F.lit(self.caption))


class MapCaption(Operator):
    """Replace captions that are there and not empty: ``f(Column) -> Column``, or a function of strings with ``rows``."""

    def __init__(self, function: Callable[[Any], Any], rows: bool = False):
        super().__init__()
        self.function, self.rows = function, rows

    def eval(self, dataset: DataFrame) -> DataFrame:
        dataset = prop(dataset, "caption", "string")
        function = self.function
        if self.rows:

            @F.pandas_udf(T.StringType())
            def mapped(captions: pd.Series) -> pd.Series:
                return captions.map(lambda c: function(c) if c else c)

            new = mapped("caption")
        else:
            new = function(F.col("caption"))
        return dataset.withColumn("caption", F.when(F.length("caption") > 0, new).otherwise(F.col("caption")))


class Passthrough(Operator):
    def eval(self, dataset: DataFrame) -> DataFrame:
        return dataset


class Sleep(Operator):
    """Wait on the driver; a second or more is cut to whole seconds."""

    def __init__(self, seconds: float):
        super().__init__()
        self.seconds = seconds

    def eval(self, dataset: DataFrame) -> DataFrame:
        time.sleep(int(self.seconds) if self.seconds >= 1 else self.seconds)
        return dataset


class Fail(Operator):
    def __init__(self, message: str = "error"):
        super().__init__()
        self.message = message

    def eval(self, dataset: DataFrame) -> DataFrame:
        raise Abort(self.message)


class Info(Operator):
    """Print each row's properties, of all rows, one partition after the other; long lists are cut in their middle."""

    def __init__(self, include_hidden_properties: bool = False):
        super().__init__()
        self.hidden = include_hidden_properties

    def table(self, dataset: DataFrame) -> DataFrame:
        shown = visible(dataset, self.hidden)
        lists = {f.name for f in dataset.schema if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)}
        return in_order(dataset).select(*(elide(F.col(c), 50).alias(c) if c in lists else F.col(c) for c in shown))

    def eval(self, dataset: DataFrame) -> DataFrame:
        for n, row in enumerate(self.table(dataset).toLocalIterator()):
            print(f"image {n}")
            for name, value in row.asDict().items():
                print(f"  {name}: {value}")
        return dataset


class Sorted(Operator):
    """Stable sort; reversed, ties keep their order. Nulls come last."""

    def __init__(self, key: str | Column, reverse: bool = False):
        super().__init__()
        self.key, self.reverse = key, reverse

    def eval(self, dataset: DataFrame) -> DataFrame:
        return self.ordered(dataset)

    def ordered(self, dataset: DataFrame, first: int | None = None) -> DataFrame:
        """The rows in their order, or the first n of them, which needs no sort of all."""
        key = F.col(self.key) if isinstance(self.key, str) else self.key
        ranked = dataset.withColumn("_key", key)
        keys = [F.col("_key").desc_nulls_last() if self.reverse else F.col("_key").asc_nulls_last(), *map(F.col, order_columns(dataset))]
        out = ranked.orderBy(*keys)
        return (out if first is None else out.limit(first)).drop(SRC, "_key").withColumn(POS, F.monotonically_increasing_id())


class Take(Operator):
    """The first n rows, or n rows at random in a random order, repeatable by the seed whatever the partitions."""

    def __init__(self, n: int, random: bool = False, seed: int = 0):
        super().__init__()
        if n < 0:
            raise ValueError("n must not be negative")
        self.n, self.random, self.seed = n, random, seed

    def eval(self, dataset: DataFrame) -> DataFrame:
        keys = order_columns(dataset)
        if not self.random:
            if len(self.sources) == 1 and isinstance(self.sources[0], Sorted):  # a top n instead of a sort of all
                return self.sources[0].ordered(self.sources[0].sources[0].dataset(), self.n)
            return dataset.orderBy(*keys).limit(self.n)
        lot = F.sha2(F.concat_ws("|", F.lit(str(self.seed)), *(F.col(k).cast("string") for k in keys)), 256)
        drawn = dataset.orderBy(lot, *keys).limit(self.n)
        return drawn.withColumn("_lot", lot).orderBy("_lot", *keys).drop(SRC, "_lot").withColumn(POS, F.monotonically_increasing_id())


class Shuffle(Operator):
    def __init__(self, seed: int | None = None):
        super().__init__()
        self.seed = seed

    def eval(self, dataset: DataFrame) -> DataFrame:
        lot = F.rand() if self.seed is None else F.xxhash64(F.lit(self.seed), *map(F.col, order_columns(dataset)))
        return dataset.withColumn("_lot", lot).orderBy("_lot").drop(SRC, "_lot").withColumn(POS, F.monotonically_increasing_id())


def concat(datasets: Iterable[DataFrame]) -> DataFrame:
    """All rows of all datasets, in their order; properties that some lack are null there."""
    parts = [with_positions(d, *order_columns(d)) if SRC in d.columns else d for d in datasets]
    if not parts:
        raise Abort("nothing to join")
    if len(parts) == 1:
        return parts[0]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn(SRC, F.lit(k)) for k, d in enumerate(parts)))


class Concat(Operator):
    """``Concat(a, b)`` or ``Concat << a << b``: all rows of the sources, in their order."""

    def __init__(self, *sources: Operator):
        super().__init__()
        for s in sources:
            self << s

    def eval(self, datasets: list[DataFrame]) -> DataFrame:
        return concat(datasets)
