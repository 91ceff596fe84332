"""People's decisions: filters, tags and captions. What is undecided is exported, and decisions come back as rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.frame import prop
from framewright.functions import tags as T
from framewright.functions.keys import memo_key_column
from framewright.plans.operator import Abort, Operator
from framewright.sources.memo import lookup

TAG_RECORD = "struct<version:int,tags:array<string>,rejected:boolean>"
CAPTION_RECORD = "struct<version:int,caption:string>"
KINDS = {"humanfilter": "boolean", "humantag": TAG_RECORD, "humancaption": CAPTION_RECORD}


def acceptance_stats(df: DataFrame, verdict: str = "passed_human_filter") -> DataFrame:
    """One row (total, decided, accepted, percent of the decided)."""
    passed = F.col(verdict)
    sums = df.agg(F.count("*").alias("total"), F.count(passed).alias("decided"), F.coalesce(F.sum(F.when(passed, 1).otherwise(0)), F.lit(0)).alias("accepted"))
    return sums.withColumn("percent", F.round(100.0 * F.col("accepted") / F.nullif(F.col("decided"), F.lit(0)), 2))


def keep_passed(verdict: Column, skip_ui: bool) -> Column:
    return F.coalesce(verdict, F.lit(skip_ui))


class _Reviewed(Operator):
    """Looks decisions up by content and domain; what lacks one can be exported and imported."""

    scope = ""

    def __init__(self, domain: str = "default", skip_ui: bool = False):
        super().__init__()
        self.domain, self.skip_ui = domain, skip_ui

    def attach(self, dataset: DataFrame, target: str) -> DataFrame:
        return lookup(dataset, self.workspace.memo.entries(self.scope), memo_key_column(self.scope, F.col("objectid")), self.domain, KINDS[self.scope], target)

    def undecided(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError

    def pending_path(self) -> str:
        return self.workspace.resolve(f"pending/{self.scope}-{self.domain}")

    def demand(self, pending: DataFrame) -> None:
        """Export what is undecided, then stop the run."""
        waiting = pending.dropDuplicates(["objectid"])
        n = waiting.count()
        if n:
            waiting.select([c for c in waiting.columns if not c.startswith("_")]).write.mode("overwrite").parquet(self.pending_path())
            raise Abort(f"{n} images wait for decisions in {self.pending_path()}")


def import_decisions(workspace, scope: str, decisions: DataFrame, domain: str = "default", vocabulary: Iterable[str] | None = None) -> int:
    """Store decisions; gives how many.

    Rows for ``humanfilter``: (objectid, passed); ``humantag``: (objectid, version, tags, rejected); ``humancaption``: (objectid,
    version, caption). A missing id or decision, or a tag outside the vocabulary, refuses the lot.
    """
    if scope not in KINDS:
        raise ValueError(f"no such decisions: {scope}")
    need = {"humanfilter": ["objectid", "passed"], "humantag": ["objectid", "version", "tags"], "humancaption": ["objectid", "version", "caption"]}[scope]
    lacking = [c for c in need if c not in decisions.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    if not decisions.filter(" or ".join(f"{c} is null" for c in need)).isEmpty():
        raise ValueError("a decision lacks a value")
    if scope == "humantag" and vocabulary is not None and not decisions.filter(F.size(F.array_except("tags", F.array(*map(F.lit, vocabulary)))) > 0).isEmpty():
        raise ValueError("a tag is not in the vocabulary")
    if scope == "humanfilter":
        value = F.col("passed").cast("boolean").cast("string")
    elif scope == "humantag":
        rejected = F.coalesce("rejected", F.lit(False)) if "rejected" in decisions.columns else F.lit(False)
        value = F.to_json(F.struct(F.col("version").cast("int").alias("version"), "tags", rejected.alias("rejected")))
    else:
        value = F.to_json(F.struct(F.col("version").cast("int").alias("version"), "caption"))
    rows = decisions.select(memo_key_column(scope, F.col("objectid")).alias("key"), F.lit(domain).alias("domain"), value.alias("value"))
    n = rows.count()
    workspace.memo.put(rows)
    return n


class HumanFilter(_Reviewed):
    """Keep what people passed; with ``skip_ui`` also what they have not seen. Else the undecided are exported and the run stops."""

    scope = "humanfilter"

    def eval(self, dataset: DataFrame) -> DataFrame:
        seen = self.attach(dataset, "passed_human_filter").drop("_cached")
        if not self.skip_ui:
            self.demand(seen.filter("passed_human_filter is null"))
        return seen.filter(keep_passed(F.col("passed_human_filter"), self.skip_ui))


def flat_vocabulary(tags: Iterable[str | Iterable[str]]) -> list[str]:
    """Tags of a vocabulary given flat or as rows of a layout."""
    out: list[str] = []
    for t in tags:
        out += [t] if isinstance(t, str) else list(t)
    return list(dict.fromkeys(out))


def apply_tag_records(df: DataFrame, version: int, vocabulary: Iterable[str], target: str = "tags", record: str = "human_tags", keep_rejected: bool = False) -> DataFrame:
    """Tags of the record replace those of the vocabulary and join the others; rejected rows go."""
    names = list(vocabulary)
    df = prop(df, target, "array<string>")
    done = F.coalesce(F.col(f"{record}.version") == version, F.lit(False))
    out = df.withColumn(target, T.merge_reviewed(F.col(target), F.col(f"{record}.tags"), names)).withColumn("_reviewed", done)
    return out if keep_rejected else out.filter(~F.coalesce(F.col(f"{record}.rejected"), F.lit(False)))


class HumanTag(_Reviewed):
    scope = "humantag"

    def __init__(self, domain: str = "default", version: int = 1, tags: Iterable[str | Iterable[str]] = (), target_prop: str = "tags", skip_ui: bool = False):
        super().__init__(domain, skip_ui)
        self.version, self.vocabulary, self.target = version, flat_vocabulary(tags), target_prop
        if not self.vocabulary:
            raise ValueError("tags must name a vocabulary")

    def eval(self, dataset: DataFrame) -> DataFrame:
        seen = self.attach(dataset, "human_tags").drop("_cached")
        todo = seen.filter(~F.coalesce(F.col("human_tags.version") == self.version, F.lit(False)))
        waiting = not todo.isEmpty()
        if waiting and not self.skip_ui:
            self.demand(todo)
        return apply_tag_records(seen, self.version, self.vocabulary, self.target, keep_rejected=waiting).drop("_reviewed")


def apply_captions(df: DataFrame, source: str = "caption", target: str = "caption", record: str = "human_caption") -> DataFrame:
    """The caption of the record, of any version, unless it is empty; else the source's."""
    df = prop(df, source, "string")
    return df.withColumn(target, F.coalesce(F.nullif(F.col(f"{record}.caption"), F.lit("")), F.col(source)))


class HumanCaption(_Reviewed):
    scope = "humancaption"

    def __init__(self, source_prop: str = "caption", target_prop: str = "caption", domain: str = "default", version: int = 1, skip_ui: bool = False):
        super().__init__(domain, skip_ui)
        self.source, self.target, self.version = source_prop, target_prop, version

    def eval(self, dataset: DataFrame) -> DataFrame:
        seen = self.attach(prop(dataset, self.source, "string"), "human_caption").drop("_cached")
        if not self.skip_ui:
            self.demand(seen.filter(~F.coalesce(F.col("human_caption.version") == self.version, F.lit(False))))
        return apply_captions(seen, self.source, self.target)
