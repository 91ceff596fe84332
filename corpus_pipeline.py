"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, passages that repeat an
earlier document are cut out, and what is left is packed into windows of tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the docs of
the next. All stages but the last keep the columns of ``documents``.

Defined results: rows with a null id or a null or empty text, and texts without words, pass the first three stages unchanged, but that of equal
empty texts one stays; null texts give no tokens. Rows that repeat an id and a text are one document and pass or go together; different texts
under an id are documents of their own. A document whose whole text repeats earlier ones goes. Extra columns, whatever their names, are
kept up to packing, which reads only the id and the text. An empty table gives no windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import packing, simhash, substrings, toxicity
from framewright.llm.common import table
from framewright.storage import materialise, release, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier fitted on the labelled ones rejects go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return simhash.drop_near_duplicates(docs)


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of lesser id has too are cut out; ``n_chars`` follows."""
    return substrings.cut_duplicates(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of tokens with their boundary records."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_substrings),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
            # What led to a stage's table is no longer needed once that is written.
            release(before | {p for p in written() if p.rpartition("/")[2].startswith(f"{name}-")})
    return docs


#: No stage but the substrings' has an SQL form; tests/llm holds each to brute force.
ORACLE_SQL: str | None = None
