"""Tags: sorted arrays of distinct strings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(tags: str | Iterable[str]) -> list[str]:
    return [tags] if isinstance(tags, str) else list(tags)


def _array(tags: Iterable[str]) -> Column:
    return F.array(*map(F.lit, tags)).cast("array<string>")


def add_tags(tags: Column, new: str | Iterable[str]) -> Column:
    return F.array_sort(F.array_union(F.coalesce(tags, _array([])), _array(_list(new))))


def remove_tags(tags: Column, gone: str | Iterable[str]) -> Column:
    """Null stays null."""
    return F.array_sort(F.array_except(tags, _array(_list(gone))))


def rewrite_tags(tags: Column, mapping: Mapping[str, str]) -> Column:
    """Replace tags; those that become equal merge."""
    if not mapping:
        return F.array_sort(F.array_distinct(tags))
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.try_element_at(table, t), t))))


def merge_reviewed(existing: Column, reviewed: Column, vocabulary: Iterable[str]) -> Column:
    """Tags outside the vocabulary stay and the reviewed ones join them."""
    kept = F.array_except(F.coalesce(existing, _array([])), _array(vocabulary))
    return F.array_sort(F.array_union(kept, F.coalesce(reviewed, _array([]))))
