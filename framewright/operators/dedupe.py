"""Exact and similarity deduplication."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.frame import order_columns, with_positions
from framewright.plans.operator import Abort, Operator
from framewright.similarity import vector_classes
from framewright.storage import exists


def exact_dedupe(df: DataFrame) -> DataFrame:
    """One row an objectid, the first in order."""
    first = F.row_number().over(Window.partitionBy("objectid").orderBy(*order_columns(df)))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")


class ExactDedupe(Operator):
    def eval(self, dataset: DataFrame) -> DataFrame:
        return exact_dedupe(dataset)


def fuzzy_clusters(df: DataFrame, threshold: float = 0.95, vector: str = "clip", exact: bool = False) -> DataFrame:
    """Rows (objectid, root, size, links): every objectid with the least of its cluster; links are cosines above the threshold."""
    placed = vector_classes(df, "objectid", vector, threshold, exact)
    return placed.join(placed.groupBy("root").agg(F.count("*").alias("size")), "root").select("objectid", "root", "size", "links")


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """One row (clusters, largest, mean_size)."""
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_size"))


def largest_of(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Of each cluster the row of the largest area, the first objectid on ties; ordered by objectid."""
    area = F.col("width").cast("long") * F.col("height")
    best = F.row_number().over(Window.partitionBy("root").orderBy(area.desc(), "objectid", *order_columns(df)))
    picked = df.join(clusters.select("objectid", "root"), "objectid").withColumn("_n", best).filter("_n = 1").drop("_n", "root")
    return with_positions(picked.select(*df.columns), "objectid")


def fuzzy_dedupe(df: DataFrame, threshold: float = 0.95, vector: str = "clip", exact: bool = False) -> DataFrame:
    return largest_of(df, fuzzy_clusters(df, threshold, vector, exact))


class FuzzyDedupe(Operator):
    """One image of each cluster of images whose embeddings are alike.

    Pairs above the threshold are found by hashing to a recall that is planned, or, with ``exact``, all of them; neither is bounded, so
    ``n_trees`` and ``n_neighbors`` are taken and not used. The clusters of a data set are kept in the workspace under the fingerprint of its
    vectors, so a second run compares nothing.
    """

    def __init__(self, threshold: float = 0.95, debug_html: str | None = None, n_trees: int = 10, n_neighbors: int = 50, vector: str = "clip", exact: bool = False):
        super().__init__()
        self.threshold, self.debug_html, self.vector, self.exact = threshold, debug_html, vector, exact

    def clusters(self, dataset: DataFrame) -> DataFrame:
        path = f"{self.workspace.path}/clusters/{fingerprint(dataset, self.vector)}-{self.threshold!r}{'-exact' if self.exact else ''}"
        if not exists(self.workspace.spark, f"{path}/_SUCCESS"):
            fuzzy_clusters(dataset, self.threshold, self.vector, self.exact).write.mode("overwrite").parquet(path)
        return self.workspace.spark.read.parquet(path)

    def eval(self, dataset: DataFrame) -> DataFrame:
        if self.vector not in dataset.columns or not dataset.filter(F.col(self.vector).isNull()).isEmpty():
            raise Abort(f"FuzzyDedupe needs {self.vector} on all images")
        clusters = self.clusters(dataset)
        if self.debug_html:
            from framewright.sources.save import clusters_html

            clusters_html(dataset, clusters, self.workspace.resolve(self.debug_html))
        return largest_of(dataset, clusters)


def fingerprint(df: DataFrame, vector: str = "clip") -> str:
    """A hash of all vectors by objectid, whatever their order; the key under which a whole data set's result is kept."""
    parts = df.select(F.sha2(F.concat_ws("|", "objectid", F.to_json(vector)), 256).alias("h"))
    halves = [F.sum(F.conv(F.substring("h", a, 15), 16, 10).cast("decimal(38,0)")) for a in (1, 16)]
    n, first, second = parts.agg(F.count("*"), *halves).first()
    return hashlib.sha256(f"{n}-{first}-{second}".encode()).hexdigest()


__all__ = ["ExactDedupe", "FuzzyDedupe", "cluster_stats", "exact_dedupe", "fingerprint", "fuzzy_clusters", "fuzzy_dedupe", "largest_of"]
