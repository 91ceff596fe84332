"""The pipeline language: operators joined by ``>>`` and ``<<`` into a graph of lazy DataFrames."""

from __future__ import annotations

import inspect
import time
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Abort(Exception):
    """Stops a run under control."""


def _instance(x: Any) -> Operator:
    return x() if isinstance(x, type) else x


class OperatorMeta(type):
    """Lets classes without parameters be joined without being called."""

    def __rshift__(cls, other: Any) -> Operator:
        return cls() >> other

    def __lshift__(cls, other: Any) -> Operator:
        return cls() << other


class Operator(metaclass=OperatorMeta):
    """A dataset-to-dataset function in a graph.

    Subclasses define ``eval(self)``, ``eval(self, dataset)`` or ``eval(self, datasets)``; the argument's name says how
    many sources it takes. Results are DataFrames, so every consumer sees an unchanged copy.
    """

    def __init__(self) -> None:
        from framewright.plans.workspace import Workspace

        self.sources: list[Operator] = []
        self.sinks: list[Operator] = []
        self.workspace = Workspace.current()
        self.workspace.operators.append(self)

    def __rshift__(self, other: Any) -> Operator:
        other = _instance(other)
        other._join(self)
        return other

    def __lshift__(self, other: Any) -> Operator:
        self._join(_instance(other))
        return self

    def _join(self, source: Operator) -> None:
        self.sources.append(source)
        source.sinks.append(self)

    def dataset(self) -> DataFrame:
        """The operator's result; worked out once, and kept where more than one sink reads it."""
        done = self.workspace.results
        if self not in done:
            takes = list(inspect.signature(self.eval).parameters)
            inputs = [s.dataset() for s in self.sources]
            start = time.monotonic()
            if not takes:
                if inputs:
                    raise Abort(f"{self.name} takes no source")
                out = self.eval()
            elif takes[0] == "datasets":
                out = self.eval(inputs)
            else:
                if len(inputs) != 1:
                    raise Abort(f"{self.name} takes one source, not {len(inputs)}")
                out = self.eval(inputs[0])
            if not isinstance(out, DataFrame):
                raise Abort(f"{self.name} gave no dataset")
            if self.workspace.observing:
                seen = Observation(f"{self.name}-{len(done)}")
                out = out.observe(seen, F.count(F.lit(1)).alias("rows"))
                self.workspace.observations[self] = (seen, time.monotonic() - start)
            if len(self.sinks) > 1 and self.workspace.sharing:
                out = out.persist()
                self.workspace.persisted.append(out)
            done[self] = out
        return done[self]

    @property
    def name(self) -> str:
        return type(self).__name__

    def eval(self, dataset: DataFrame) -> DataFrame:
        raise NotImplementedError

    def apply(self, dataset: DataFrame) -> DataFrame:
        """Use the operator as a plain function of one DataFrame."""
        return self.eval(dataset)
