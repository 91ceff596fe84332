"""Keys of memoised results: ``scope(segment,segment)``, each segment canonical JSON with '=' between name and value."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def memo_key(scope: str, *segments: Any) -> str:
    if not segments:
        return scope
    return scope + "(" + ",".join(json.dumps(s, sort_keys=True, separators=(",", "=")) for s in segments) + ")"


def quoted(value: Column) -> Column:
    """A string column as JSON. Non-ASCII characters stay as they are."""
    return F.concat(F.lit('"'), reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")), value), F.lit('"'))


def memo_key_column(scope: str, *segments: Any) -> Column:
    """The same over columns: segments that are columns are quoted strings, others are constants."""
    parts = [quoted(s) if isinstance(s, Column) else F.lit(json.dumps(s, sort_keys=True, separators=(",", "="))) for s in segments]
    if not parts:
        return F.lit(scope)
    return F.concat(F.lit(scope + "("), F.concat_ws(",", *parts), F.lit(")"))
