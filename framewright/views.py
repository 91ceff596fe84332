"""Datasets made of the fixture tables: images of parts, boxes of line items, detections of events, decisions of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("_pos"), F.sha2(F.concat("p_name", F.lit("|"), "p_brand"), 256).alias("objectid"),
        F.concat(F.lit("/data/"), F.lower("p_type"), F.lit("/"), "p_name", F.lit(".png")).alias("original_path"), F.lit(".png").alias("ext"),
        (256 + F.col("p_size") * 32).cast("int").alias("width"), (256 + F.col("p_partkey") * 7 % 41 * 32).cast("int").alias("height"),
        F.when(F.col("p_partkey") % 3 == 0, "JPEG").when(F.col("p_partkey") % 3 == 1, "PNG").otherwise("WEBP").alias("format"), F.col("p_retailprice").alias("aesthetic_score"),
    )


IMAGES_SQL = """images AS (SELECT p_partkey AS _pos, sha256(p_name || '|' || p_brand) AS objectid, '/data/' || lower(p_type) || '/' || p_name || '.png' AS original_path, '.png' AS ext,
CAST(256 + p_size * 32 AS INTEGER) AS width, CAST(256 + p_partkey * 7 % 41 * 32 AS INTEGER) AS height, CASE p_partkey % 3 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' ELSE 'WEBP' END AS format, p_retailprice AS aesthetic_score FROM part)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image of 1024 x 768: (l_orderkey, boxes)."""
    x1, y1 = (F.col("l_partkey") * 37 % 1000).cast("int"), (F.col("l_suppkey") * 53 % 760).cast("int")
    x2, y2 = F.least(x1 + 10 + F.col("l_partkey") * 11 % 130, F.lit(1024)).cast("int"), F.least(y1 + 6 + F.col("l_suppkey") * 7 % 90, F.lit(768)).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))).alias("boxes"))


BOXES_SQL = """raw AS (SELECT l_orderkey, l_partkey * 37 % 1000 AS x1, l_suppkey * 53 % 760 AS y1, l_partkey * 11 % 130 AS dx, l_suppkey * 7 % 90 AS dy FROM lineitem),
boxes AS (SELECT l_orderkey, x1, y1, least(x1 + 10 + dx, 1024) AS x2, least(y1 + 6 + dy, 768) AS y2 FROM raw)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an image: (image_id, nudenet)."""
    found = F.collect_list(F.struct(F.col("event_type").alias("class"), F.col("value").alias("score")))
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 20).cast("long").alias("image_id")).agg(found.alias("nudenet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: content by its hash, tags of language and source, the text as caption."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("_pos"), "doc_id", F.sha2("text", 256).alias("objectid"), F.array_sort(F.array("lang", "source")).alias("tags"), F.col("text").alias("caption"), "lang", "source", "n_chars")


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with verdicts: passed where their quality is 1, rejected where they are toxic, null where unlabelled."""
    own = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("rejected"))
    return documents(spark, sf_dir).join(own, "doc_id", "left")


REVIEWED_SQL = """reviewed AS (SELECT d.doc_id, sha256(d.text) AS objectid, list_sort([d.lang, d.source]) AS tags, d.text AS caption, d.lang, d.source, l.quality = 1 AS passed, l.toxic = 1 AS rejected
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def memo_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of the memo store: key by user, domain by kind, the last by time in force."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("events").alias("scope"), F.concat(F.lit("events("), F.col("user_id").cast("string"), F.lit(")")).alias("key"), F.col("event_type").alias("domain"),
        (F.col("event_id") % 7 != 0).alias("present"), F.when(F.col("event_id") % 7 != 0, F.col("event_id").cast("string")).alias("value"),
        F.col("ts").alias("updated_at"),
    )


ENTRIES_SQL = """raw AS (SELECT 'events(' || CAST(user_id AS VARCHAR) || ')' AS key, event_type AS domain, event_id % 7 <> 0 AS present, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS value, ts, event_id FROM events),
entries AS (SELECT key, domain, present, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key, domain ORDER BY ts DESC) AS k FROM raw) WHERE k = 1)"""
