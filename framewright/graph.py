"""Connected components by alternating stars, all of it DataFrame operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.storage import shared_dir

FEW = 1 << 17  # edges that are solved at once


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    return both.withColumn("m", least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    own = least.select("u", F.col("m").alias("v"))
    rest = least.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def _solved(links: DataFrame) -> DataFrame:
    """The same of at most ``FEW`` edges, by numbers, on the driver."""
    found = links.toArrow().combine_chunks()
    ends = pa.chunked_array([*found.column("u").chunks, *found.column("v").chunks], found.schema.field("u").type)
    names = ends.unique().sort()
    at = pa.compute.index_in(ends, value_set=names).to_numpy(zero_copy_only=False) if len(ends) else np.zeros(0, np.int64)
    i, j, label = at[: found.num_rows], at[found.num_rows :], np.arange(len(names))
    while True:
        least = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        np.minimum.at(least, label[i], low)
        np.minimum.at(least, label[j], low)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return links.sparkSession.createDataFrame(pa.table({"node": names, "root": names.take(pa.array(label))}))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """Rows (node, root) of every node that has an edge; the root is the least node of its component.

    Null ends and loops are ignored. Rounds grow with the logarithm of the longest chain; lineage is cut by a reliable
    checkpoint each round. At most ``few`` edges are solved on the driver: a bound of a few megabytes, checked first.
    """
    shared_dir(edges.sparkSession)
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    if links.count() <= few:
        return _solved(links)
    last = None
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
    roots = links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
