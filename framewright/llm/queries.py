"""The registered queries of these operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import ann, forest, lm, packing, sentencepieces, sharding, simhash, substrings, token_counts, toxicity
from framewright.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.duplicate_spans(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


#: Of every vector three copies with its coordinates moved: two so little that they are near, one, for most vectors, not.
_MOVED = ((1, 31, 17, 7, 0.004), (2, 13, 29, 5, 0.02), (3, 7, 11, 9, 0.03))


def embedding_duplicates_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last operator on data that has near copies at every scale."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = e.withColumnRenamed("vec_id", "own")  # within a lambda a new column's name would count before the old column's

    def moved(k: int, a: int, b: int, m: int, by: float) -> DataFrame:
        shift = lambda x, i: (x.cast("double") + ((F.col("own") * a + i * b) % m - m // 2) * F.lit(by)).cast("float")
        return own.select((F.col("own") + k * 10_000_000).alias("vec_id"), F.transform("embedding", shift).alias("embedding"))

    return forest.near_duplicates(reduce(DataFrame.unionByName, (moved(*x) for x in _MOVED), e))


_COPIES_SQL = " UNION ALL ".join(["SELECT vec_id, embedding FROM embeddings", *(f"SELECT vec_id + {k * 10_000_000}, list_transform(range(len(embedding)), lambda i: CAST(CAST(embedding[i + 1] AS DOUBLE) + (((vec_id * {a} + i * {b}) % {m}) - {m // 2}) * CAST({by} AS DOUBLE) AS FLOAT)) FROM embeddings" for k, a, b, m, by in _MOVED)])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_lm_scoring, op4_token_counts, op5_toxicity, op6_substrings, op7_packing, op8_neighbours, op9_sharding, op10_embedding_duplicates, embedding_duplicates_of_copies)}

#: The other operators have no SQL form that is exact or quick on whole tables; tests/llm holds them to brute force.
ORACLE_SQL: dict[str, str] = {"op6_substrings": substrings.duplicate_spans_sql(), "op9_sharding": sharding.shard_sql(), "op10_embedding_duplicates": forest.near_duplicates_sql(), "embedding_duplicates_of_copies": f"WITH copies AS ({_COPIES_SQL}) SELECT * FROM ({forest.near_duplicates_sql('copies')})"}
