"""A workspace: a folder with the memo store and the objects, and the operators of a pipeline."""

from __future__ import annotations

import logging
import re
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from framewright.plans.operator import Abort

if TYPE_CHECKING:
    from framewright.plans.operator import Operator

log = logging.getLogger("framewright")


class Workspace:
    """``with Workspace(spark, folder) as w: Load("in") >> Save(); w.run()``.

    The folder can be any path that Spark reads and writes. Workspaces nest; operators belong to the innermost. With ``sharing``, a
    dataset that several operators read is kept until the workspace closes; a result that outlives it needs it off.
    """

    _stack: list[Workspace] = []

    def __init__(self, spark: SparkSession | None = None, path: str | None = None, observing: bool = False, sharing: bool = True):
        from framewright.sources.downloads import DownloadCache
        from framewright.sources.memo import MemoStore
        from framewright.sources.objects import ObjectStore
        from framewright.storage import new_path

        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self.path = path or new_path(self.spark, "workspace")
        self.operators: list[Operator] = []
        self.results: dict[Operator, DataFrame] = {}
        self.persisted: list[DataFrame] = []
        self.observing, self.sharing = observing, sharing
        self.observations: dict = {}
        self.memo = MemoStore(self.spark, f"{self.path}/memo")
        self.downloads = DownloadCache(self.spark, f"{self.path}/downloads")
        self.objects = ObjectStore(self.spark, f"{self.path}/objects")

    def resolve(self, path: str) -> str:
        """A path relative to the workspace."""
        return path if Path(path).is_absolute() or re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else f"{self.path}/{path}"

    @classmethod
    def current(cls) -> Workspace:
        if not cls._stack:
            raise Abort("no workspace is open")
        return cls._stack[-1]

    def __enter__(self) -> Workspace:
        Workspace._stack.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Workspace._stack.remove(self)
        self.release()

    def release(self) -> None:
        for df in self.persisted:
            df.unpersist()
        self.persisted.clear()
        self.results.clear()

    def run(self) -> list[DataFrame]:
        """Work out every operator without a sink in the order they were made. Abort stops the rest and is logged."""
        out = []
        try:
            for op in self.operators:
                if not op.sinks:
                    out.append(op.dataset())
        except Abort as stop:
            log.error("stopped: %s", stop)
        return out

    def metrics(self) -> list[tuple[str, int, float]]:
        """(operator, rows, seconds to plan) of the operators that an action has run, with ``observing`` set."""
        return [(op.name, seen.get["rows"], s) for op, (seen, s) in self.observations.items()]
