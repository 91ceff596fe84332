"""Models behind operators: a backend is opened once a worker and sees batches; results go through the memo store."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame

log = logging.getLogger("framewright")


class Backend:
    """Something that works out a value for each item, a dict of the columns that the operator reads.

    Backends are sent to the workers, so they hold settings only; what is costly belongs in ``open``, which runs once a
    worker's partition, and ``close``. ``run`` gives one result an item: a value that JSON can hold, None for a refusal, or
    an exception, which is not kept, so the item is tried again by the next run.
    """

    retries = 0
    wait = 2.0

    def open(self) -> None:
        pass

    def run(self, items: list[dict[str, Any]]) -> list[Any]:
        raise NotImplementedError

    def close(self) -> None:
        pass

    def attempt(self, items: list[dict[str, Any]], retries: int = 0, wait: float | None = None) -> list[Any]:
        """``run``, again after waits that double where it raises; then item by item."""
        most, first = max(self.retries, retries), self.wait if wait is None or self.retries >= retries else wait
        for k in range(most + 1):
            try:
                return list(self.run(items))
            except Exception as problem:
                failure = problem
                if k < most:
                    time.sleep(first * 2**k)
        return [failure] if len(items) == 1 else [self.attempt([x], retries, wait)[0] for x in items]


class FunctionBackend(Backend):
    """A Python function of one item."""

    def __init__(self, function):
        self.function = function

    def run(self, items: list[dict[str, Any]]) -> list[Any]:
        return [self.function(x) for x in items]


class EchoBackend(Backend):
    """A stand-in without a model: the prompt and the item's identity, the same every time."""

    def run(self, items: list[dict[str, Any]]) -> list[Any]:
        return [f"{x.get('prompt') or ''} [{(x.get('objectid') or '')[:8]}]".strip() for x in items]


_backends: dict[str, Backend] = {}


def register(scope: str, backend: Backend) -> None:
    """Use a backend wherever an operator of this scope is given none."""
    _backends[scope] = backend


def backend_of(scope: str, backend: Backend | None) -> Backend:
    from framewright.plans.operator import Abort

    found = backend or _backends.get(scope)
    if found is None:
        raise Abort(f"no model is registered for {scope}")
    return found


def infer(misses: DataFrame, backend: Backend, inputs: dict[str, Column], batch_size: int, text: bool = True, retries: int = 0, wait: float | None = None) -> DataFrame:
    """Rows (_key, value) of what the backend gives for each row; failures are left out."""
    items = misses.select("_key", *(c.alias(n) for n, c in inputs.items()))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = False
        try:
            for frame in frames:
                for a in range(0, len(frame), batch_size):
                    part = frame.iloc[a : a + batch_size]
                    if not opened:
                        backend.open()
                        opened = True
                    out = backend.attempt(part.drop(columns="_key").to_dict("records"), retries, wait)
                    kept = [(k, v) for k, v in zip(part["_key"], out, strict=True) if not isinstance(v, Exception)]
                    for v in (v for v in out if isinstance(v, Exception)):
                        log.warning("a result failed: %s", v)
                    yield pd.DataFrame({"_key": [k for k, _ in kept], "value": [v if v is None or (text and isinstance(v, str)) else json.dumps(v) for _, v in kept]}, dtype=object)
        finally:
            if opened:
                backend.close()

    return items.mapInPandas(work, "_key string, value string")
