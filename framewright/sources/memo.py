"""The memo store: a table of results by key and domain.

Entries are only ever appended, each put in a folder of its own partitioned by scope; a reader takes the last entry of each (key, domain), so a
put replaces, also where the domain is null. ``present`` tells a memoised null from a result that there is not.
Looking up is a left join, working out what lacks an anti join.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.storage import exists, remove

SCHEMA = "scope string, key string, domain string, present boolean, value string, updated_at timestamp"


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each key and domain; of several at one moment a memoised null, else the greatest value."""
    last = F.struct("updated_at", (~F.col("present")).alias("none"), "value", "present")
    return entries.groupBy("key", "domain").agg(F.max(last).alias("last"), F.max("scope").alias("scope")).select("scope", "key", "domain", F.col("last.present").alias("present"), F.col("last.value").alias("value"), F.col("last.updated_at").alias("updated_at"))


def matching(entries: DataFrame, pattern: str = "*", domain: str | None = None) -> DataFrame:
    """Entries whose key matches a shell pattern, of one domain or of all."""
    found = entries.filter(F.col("key").rlike(_regex(pattern)))
    return found if domain is None else found.filter(F.col("domain") == domain)


def _regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression."""
    return re.sub(r"^\(\?s:(.*)\)\\[Zz]$", r"(?s)^\1$", fnmatch.translate(pattern).replace("(?>.*?", "(?:.*?"))


def lookup(rows: DataFrame, entries: DataFrame, key: Column, domain: str | None = None, kind: str = "string", target: str = "value") -> DataFrame:
    """Rows with ``target``, the memoised value, and ``_cached``, whether there is an entry, be its value null.

    Without a domain an entry of any domain counts, the last of them; of several at one moment that of the greatest domain. The entries may
    be all that were put or those in force, which give the same.
    """
    own = entries if domain is None else entries.filter(F.col("domain") == domain)
    values = own.groupBy(F.col("key").alias("_key")).agg(F.max_by(F.struct("value", "present"), F.struct("updated_at", "domain", (~F.col("present")).alias("none"), "value")).alias("_hit"))
    joined = rows.withColumn("_key", key).join(values, "_key", "left")
    value = F.when(F.col("_hit.present"), F.col("_hit.value"))
    value = value if kind == "string" else F.from_json(value, kind) if kind.startswith(("array", "struct", "map")) else value.try_cast(kind)
    return joined.withColumn(target, value).withColumn("_cached", F.col("_hit").isNotNull()).drop("_key", "_hit")


def upsert(entries: DataFrame, new: DataFrame) -> DataFrame:
    return latest(entries.unionByName(new))


_SCOPE = r"^([^(]*)"


def scope_of(key: str) -> str | None:
    """The scope of a key, or of a pattern whose scope has no wild card."""
    scope, bracket, _ = key.partition("(")
    return scope if bracket and not re.search(r"[*?\[]", scope) else None


class MemoStore:
    """The table of a workspace."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        return exists(self.spark, self.path)

    def _parts(self) -> list[str]:
        """The folders of all puts. They are read by their names: Spark takes scans of one path for equal whatever was added."""
        if not self._exists():
            return []
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
        return sorted(x.getPath().toString() for x in found if x.isDirectory() and x.getPath().getName().startswith("put="))

    def _new_part(self) -> str:
        return f"{self.path}/put={uuid.uuid4().hex}"

    def entries(self, scope: str | None = None) -> DataFrame:
        """All entries in force, or those of one scope, the folders of which alone are read."""
        return latest(self._all(scope)) if self._parts() else self._all(scope)

    def _all(self, scope: str | None = None) -> DataFrame:
        """All entries that were put."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        everything = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(*parts)
        return everything if scope is None else everything.filter(F.col("scope") == scope)

    def put(self, rows: DataFrame) -> None:
        """Append rows (key, domain, value); the last to be put counts. Null values are kept as such."""
        scope = F.regexp_extract("key", _SCOPE, 1)
        now = rows.select(scope.alias("scope"), "key", F.col("domain").cast("string").alias("domain"), F.col("value").isNotNull().alias("present"), F.col("value").cast("string").alias("value"), F.current_timestamp().alias("updated_at"))
        now.write.partitionBy("scope").parquet(self._new_part())

    def put_one(self, key: str, value: str | None, domain: str | None = None) -> None:
        self.put(self.spark.createDataFrame([(key, domain, value)], "key string, domain string, value string"))

    def get(self, key: str, domain: str | None = None) -> str | None:
        found = self.entries(scope_of(key)).filter(F.col("key") == key)
        found = found if domain is None else found.filter(F.col("domain") == domain)
        row = found.orderBy(F.desc("updated_at")).first()
        return row.value if row else None

    def has(self, key: str, domain: str | None = None) -> bool:
        found = self.entries(scope_of(key)).filter(F.col("key") == key)
        return not (found if domain is None else found.filter(F.col("domain") == domain)).isEmpty()

    def list(self, pattern: str = "*", domain: str | None = None) -> DataFrame:
        return matching(self.entries(scope_of(pattern)), pattern, domain)

    def count(self, pattern: str = "*", domain: str | None = None) -> int:
        return self.list(pattern, domain).count()

    def clear(self, pattern: str = "*", domain: str | None = None) -> int:
        """Delete matching entries, of all domains unless one is named; gives how many."""
        everything = self.entries()
        gone = matching(everything, pattern, domain)
        n = gone.count()
        if n:
            self._rewrite(everything.join(gone.select("key", "domain"), everything["key"].eqNullSafe(gone["key"]) & everything["domain"].eqNullSafe(gone["domain"]), "left_anti"))
        return n

    def compact(self) -> None:
        """Rewrite the table with only the entries in force."""
        self._rewrite(self.entries())

    def _rewrite(self, rows: DataFrame) -> None:
        old = self._parts()
        rows.write.partitionBy("scope").parquet(self._new_part())
        for part in old:
            remove(self.spark, part)

    def import_from(self, other: MemoStore, pattern: str = "*", domain: str | None = None) -> int:
        """Take another store's matching entries; they replace ours."""
        rows = other.list(pattern, domain)
        n = rows.count()
        if n:
            rows.select("scope", "key", "domain", "present", "value", F.current_timestamp().alias("updated_at")).write.partitionBy("scope").parquet(self._new_part())
        return n

    def drop(self) -> bool:
        """Delete the table; whether there was one."""
        if not self._exists():
            return False
        remove(self.spark, self.path)
        return True

    def fill(self, rows: DataFrame, key: Column, work: Callable[[DataFrame], DataFrame], target: str, kind: str = "string", domain: str | None = None, scope: str | None = None) -> DataFrame:
        """Rows with ``target`` from the store, where ``work`` first works out the keys that lack.

        ``work`` takes one row a missing key, with ``_key``, and gives (_key, value). Results are in the store before they
        are used, so a lost executor or a second action calls no model again; with nothing missing no model is loaded. Of a
        scope, that of all the keys, only its own folders are read.
        """
        found = lookup(rows, self._all(scope), key, domain, kind, target)
        lacking = found.filter(~F.col("_cached")).drop(target, "_cached") if self._has(scope) else rows
        if not lacking.isEmpty():  # of rows, as their keys need a pass over all to tell apart
            misses = lacking.withColumn("_key", key).dropDuplicates(["_key"])
            self.put(work(misses).select(F.col("_key").alias("key"), F.lit(domain).cast("string").alias("domain"), "value"))
            found = lookup(rows, self._all(scope), key, domain, kind, target)
        return found.drop("_cached")

    def _has(self, scope: str | None) -> bool:
        """Whether there may be entries, of the scope or of any."""
        return any(scope is None or not re.fullmatch(r"[A-Za-z0-9._-]+", scope) or exists(self.spark, f"{p}/scope={scope}") for p in self._parts())
