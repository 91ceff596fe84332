"""Predicates on detections, arrays of structs (class, score, box)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXPOSED = ("BUTTOCKS_EXPOSED", "FEMALE_BREAST_EXPOSED", "FEMALE_GENITALIA_EXPOSED", "ANUS_EXPOSED", "MALE_GENITALIA_EXPOSED")


def has_any(detections: Column, labels: Iterable[str], threshold: float) -> Column:
    """Whether a detection of one of the labels scores at least the threshold; false where there are none."""
    names = list(labels)
    return F.coalesce(F.exists(detections, lambda d: d["class"].isin(names) & (d["score"] >= F.lit(float(threshold)))), F.lit(False))


def has_label(detections: Column, label: str, threshold: float) -> Column:
    return has_any(detections, [label], threshold)


def has_prefix(detections: Column, prefixes: Iterable[str], threshold: float) -> Column:
    parts = list(prefixes)

    def match(d: Column) -> Column:
        hit = F.lit(False)
        for p in parts:
            hit = hit | d["class"].startswith(p)
        return hit & (d["score"] >= F.lit(float(threshold)))

    return F.coalesce(F.exists(detections, match), F.lit(False))


def has_nudity(detections: Column, threshold: float = 0.5) -> Column:
    return has_any(detections, EXPOSED, threshold)


def has_male(detections: Column, threshold: float = 0.5) -> Column:
    return has_prefix(detections, ("MALE_", "FACE_MALE"), threshold)


def has_female(detections: Column, threshold: float = 0.5) -> Column:
    return has_prefix(detections, ("FEMALE_", "FACE_FEMALE"), threshold)
