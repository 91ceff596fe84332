"""Comparing the rows of groups in pairs, however large a group is, and counting the links within classes.

A group of more than ``BLOCK`` rows is dealt to blocks by a hash of its rows, and each pair of its blocks is a group of its
own, so no task ever holds more than two blocks of one group. Small groups travel together.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.graph import connected_components
from framewright.storage import materialise

BLOCK = 8_192
STRIP = 1 << 18  # pairs that are compared at once
SMALL = 32
ROWS = 16_384  # rows of small groups that travel together

#: near(a, b): of arrays (..., s, w) and (..., t, w) which are near, (..., s, t)
Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def tidy() -> None:
    """Give freed memory back, which a Python worker otherwise keeps while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(f: Callable) -> Callable:
    """A function for mapInArrow that leaves no freed memory behind."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return of


def lean_group(f: Callable) -> Callable:
    """A function for applyInArrow, of one group or of two, that leaves no freed memory behind."""
    if f.__code__.co_argcount == 2:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(left, right)
            tidy()
            return out

        return both

    def of(group: pa.Table) -> pa.Table:
        out = f(group)
        tidy()
        return out

    return of


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tallied(f: Callable, name: str) -> Callable:
    """For mapInArrow: instead of f's rows, how many there are of each value of a column, (name, n), added up batch by batch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in f(batches):
            found, n = np.unique(batch.column(name).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=[name, "n"])

    return of


def large(sizes: DataFrame, block: int = BLOCK) -> DataFrame | None:
    """Of rows (group, n) those of large groups, as a written table, or None; each stands for more than ``block`` rows."""
    found = materialise(sizes.filter(F.col("n") > block), "large")
    return None if found.isEmpty() else found


def dealt(rows: DataFrame, group: str, key: str, sizes: DataFrame | None, expected: float, block: int = BLOCK) -> DataFrame:
    """The rows with part, lo, hi and own: what is in one part meets, of a large group the block ``lo`` the block ``hi``.

    sizes: ``large`` groups; expected: how many rows there are, about.
    """
    parts = F.lit(max(partitions(rows.sparkSession), int(expected / ROWS)))
    cold = F.pmod(F.xxhash64(group), parts)
    zero = F.lit(0).cast("int")
    if sizes is None:
        return rows.withColumns({"part": cold, "lo": zero, "hi": zero, "own": zero})
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("int")
    met = rows.join(sizes.withColumnRenamed(group, "_g"), F.col(group) == F.col("_g"), "left").withColumn("_k", blocks).withColumn("own", F.pmod(F.xxhash64(F.lit(5), key), F.col("_k")).cast("int"))
    met = met.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).withColumn("lo", F.least("own", "_o")).withColumn("hi", F.greatest("own", "_o"))
    return met.withColumn("part", F.when(F.col("_k") == 1, cold).otherwise(F.xxhash64(group, "lo", "hi"))).drop("_g", "_k", "_o", "n")


def near_pairs(x: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, own: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of rows of one group, in portions of at most ``STRIP`` or so; each pair once, of two blocks only across."""
    order = np.lexsort((own, hi, lo, group))
    g, a, z = group[order], lo[order], hi[order]
    begin = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (z[1:] != z[:-1])])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(g)))
    few = (size > 1) & (size <= SMALL) & (a[begin] == z[begin])
    for s in np.unique(size[few]):
        at = begin[few & (size == s)]
        step = max(1, STRIP // (s * s))
        for c in range(0, len(at), step):
            rows = order[at[c : c + step, None] + np.arange(s)]
            q, i, j = np.nonzero(near(x[rows], x[rows]))
            up = j > i
            yield rows[q[up], i[up]], rows[q[up], j[up]]
    for k in np.flatnonzero((size > 1) & ~few):
        rows = order[begin[k] : begin[k] + size[k]]
        within = a[begin[k]] == z[begin[k]]
        left = rows if within else rows[own[rows] == a[begin[k]]]
        right = rows if within else rows[own[rows] != a[begin[k]]]
        step = max(1, STRIP // max(1, len(right)))
        for c in range(0, len(left), step):
            to = right[c:] if within else right
            i, j = np.nonzero(near(x[left[c : c + step]], x[to]))
            if within:
                up = j > i
                i, j = i[up], j[up]
            yield left[c + i], to[j]


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row of each row's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same rows as the pairs do, fewer than n: of every row to the least of its component."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pairs:
        if len(i) > 1024:  # a portion's own stars first
            rows, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            label = least_labels(len(rows), back[: len(i)], back[len(i) :])
            far = np.flatnonzero(label != np.arange(len(rows)))
            i, j = rows[label[far]], rows[far]
        left.append(i)
        right.append(j)
    label = least_labels(n, np.concatenate(left), np.concatenate(right))
    far = np.flatnonzero(label != np.arange(n))
    return far, label[far]


def column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


def edges_of(key: str, group: str, payload: Callable[[pa.Table], np.ndarray], near: Near):
    """For applyInArrow: rows (a, b) of keys whose edges join what is near."""

    def of(table: pa.Table) -> pa.Table:
        ids = column(table, key)
        i, j = stars(len(ids), near_pairs(payload(table), *(column(table, c) for c in (group, "lo", "hi", "own")), near))
        return pa.table({"a": ids[i], "b": ids[j]})

    return of


def links_of(key: str, payload: Callable[[pa.Table], np.ndarray], near: Near):
    """For applyInArrow: rows (key, links), the summed copies of all that is near."""

    def of(table: pa.Table) -> pa.Table:
        ids, copies, n = column(table, key), column(table, "copies"), np.zeros(table.num_rows, np.int64)
        for i, j in near_pairs(payload(table), *(column(table, c) for c in ("root", "lo", "hi", "own")), near):
            n += np.bincount(i, weights=copies[j], minlength=len(n)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(n)).astype(np.int64)
        some = n > 0
        return pa.table({key: ids[some], "links": n[some]})

    return of


def classed(kinds: DataFrame, edges: DataFrame, names: list[str], columns: list[str], payload: Callable[[pa.Table], np.ndarray], near: Near, block: int = BLOCK, links: DataFrame | None = None) -> DataFrame:
    """Rows (*columns, first, links) of kinds (kind, first, copies, *columns), a kind being all rows that are equal.

    ``first`` becomes the least of the class, that is, of the component of the edges (a, b); ``links`` are all other rows that
    are near, counted over the whole class: of the kind's own copies and of all near kinds'. names: the fields of ``first``. links: rows (kind, near) where they are known.
    """
    roots = materialise(connected_components(edges).withColumnRenamed("node", "kind"), "roots")
    members = kinds.join(roots, "kind")
    if links is None:
        sizes = large(roots.groupBy("root").agg(F.count("*").alias("n")), block)
        rows = dealt(members.select("root", "kind", "copies", *columns), "root", "kind", sizes, roots.count(), block)
        links = rows.groupBy("part").applyInArrow(lean_group(links_of("kind", payload, near)), "kind long, links long").groupBy("kind").agg(F.sum("links").alias("near"))
    least = roots.join(members.groupBy("root").agg(F.min("first").alias("least")), "root").select("kind", "least")
    found = kinds.join(least, "kind", "left").join(links, "kind", "left")  # by kind, which is never null: most kinds have no root
    first = F.coalesce("least", "first")
    return found.select(*columns, *(first[c].alias(f"first_{c}") for c in names), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
