"""Sharding by weighted rendezvous hashing.

Each record scores every shard with -ln(u) / weight, u being a hash of the record's key and the shard's name taken as
a number in (0, 1), and goes to the shard of the least score. Scores do not depend on other shards: when one is
added, only the records that it wins move; when one is removed, only its own records do. It is one projection without
a shuffle, and the same key lands on the same shard in any run, partitioning or executor.

Defined results: rows are kept one for one, repeated ones on one shard; a null key is a key of its own, distinct from the
empty string; the input's other columns are not looked at; equal scores go to the shard that sorts first by name.
Weights must be positive and names distinct. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The production layout: 16 shards, of which four have twice the room.
SHARDS: dict[str, float] = {f"shard-{i:02d}": 2.0 if i % 4 == 0 else 1.0 for i in range(16)}
_UNIT = float(1 << 52)


def _checked(shards: Mapping[str, float]) -> list[tuple[str, float]]:
    if not shards or any(w is None or not w > 0 or w == float("inf") for w in shards.values()):
        raise ValueError("shards need positive finite weights")
    return sorted((str(k), float(w)) for k, w in shards.items())


def score(key: Column, shard: str, weight: float) -> Column:
    """The first 13 hex digits of MD5(key | shard) as u in (0, 1), then -ln(u) / weight."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    digits = F.substring(F.md5(F.concat(text, F.lit("|" + shard)).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_UNIT)
    return -F.log(u) / F.lit(weight)


def shard_of(key: Column, shards: Mapping[str, float]) -> Column:
    ranked = F.array(*(F.struct(score(key, name, w).alias("s"), F.lit(name).alias("shard")) for name, w in _checked(shards)))
    return F.array_min(ranked)["shard"]


def shard(df: DataFrame, key_col: str = "doc_id", shards: Mapping[str, float] = SHARDS) -> DataFrame:
    """Rows (key_col, shard)."""
    return df.select(F.col(key_col), shard_of(F.col(key_col), shards).alias("shard"))


def moved(df: DataFrame, before: Mapping[str, float], after: Mapping[str, float], key_col: str = "doc_id") -> DataFrame:
    """Rows (key_col, shard_before, shard_after) of the records that change shards."""
    both = df.select(F.col(key_col), shard_of(F.col(key_col), before).alias("shard_before"), shard_of(F.col(key_col), after).alias("shard_after"))
    return both.filter("shard_before <> shard_after")


def shard_sql(table: str = "documents", key: str = "doc_id", shards: Mapping[str, float] = SHARDS) -> str:
    """The same in ANSI SQL."""
    text = f"coalesce('k' || CAST({key} AS VARCHAR), 'n')"
    names = ", ".join(f"('{n}', CAST({w!r} AS DOUBLE))" for n, w in _checked(shards))
    return f"""
WITH shards(shard, weight) AS (VALUES {names}), keys AS (SELECT row_number() OVER () AS rid, {key} FROM {table}),
scored AS (SELECT rid, {key}, shard, -ln((CAST(CAST('0x' || substr(md5({text} || '|' || shard), 1, 13) AS UBIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({_UNIT!r} AS DOUBLE)) / weight AS s FROM keys CROSS JOIN shards)
SELECT {key}, shard FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY s, shard) AS k FROM scored) WHERE k = 1"""
