"""The object store: contents by their SHA-256, in a table partitioned by its first two digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.storage import exists

SCHEMA = "objectid string, content binary, prefix string"


def with_object_ids(rows: DataFrame, content: str = "content") -> DataFrame:
    return rows.withColumn("objectid", F.sha2(F.col(content), 256))


class ObjectStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def objects(self) -> DataFrame:
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, rows: DataFrame) -> DataFrame:
        """Store the distinct contents that are new; gives the rows with their ``objectid``. Null contents are not stored.

        Ids alone tell what is new; only new contents are shuffled, so that each is stored once.
        """
        named = with_object_ids(rows)
        new = named.filter("content is not null").select("objectid", "content").join(self.objects().select("objectid"), "objectid", "left_anti").dropDuplicates(["objectid"])
        new.withColumn("prefix", F.substring("objectid", 1, 2)).write.mode("append").partitionBy("prefix").parquet(self.path)
        return named

    def import_from(self, other: ObjectStore) -> int:
        """Take another store's objects that this one lacks; gives how many."""
        lacking = other.objects().select("objectid", "content", "prefix").join(self.objects().select("objectid"), "objectid", "left_anti")
        n = lacking.count()
        if n:
            lacking.write.mode("append").partitionBy("prefix").parquet(self.path)
        return n

    def get(self, rows: DataFrame) -> DataFrame:
        """Rows with the content of their ``objectid``. Ids are unique in the store; of few rows only their prefixes' folders are read."""
        held = self.objects().select(F.col("objectid").alias("_id"), F.col("prefix").alias("_prefix"), "content")
        return rows.join(held, (F.substring("objectid", 1, 2) == F.col("_prefix")) & (F.col("objectid") == F.col("_id")), "left").drop("_id", "_prefix")
