"""Sizes and boxes as column expressions. All divisions are of doubles, rounding is ``floor``, and the order of
multiplications is fixed, so results agree to the pixel with the same SQL elsewhere."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(float(c))).cast("double")


def _whole(c: Column) -> Column:
    return F.floor(c).cast("int")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often f reads it; as plain columns it would be copied to each place."""
    return F.transform(F.array(value), f)[0]


def nearest_ratio(width: Column, height: Column, ratios: Iterable[float]) -> Column:
    """The ratio nearest to width / height, the smaller of two as near."""
    own = _d(width) / F.nullif(_d(height), F.lit(0.0))
    return F.array_min(F.array(*(F.struct(F.abs(own - F.lit(r)).alias("d"), F.lit(r).alias("r")) for r in sorted(map(float, ratios)))))["r"]


def crop_to_ratio(width: Column, height: Column, ratio: Column) -> Column:
    """Struct (width, height, left, top) of the centred crop to a ratio."""
    wide = ratio > _d(width) / F.nullif(_d(height), F.lit(0.0))
    w = F.when(wide, width.cast("int")).otherwise(_whole(_d(height) * ratio))
    h = F.when(wide, _whole(_d(width) / ratio)).otherwise(height.cast("int"))
    return F.struct(w.alias("width"), h.alias("height"), _whole((width - w) / 2).alias("left"), _whole((height - h) / 2).alias("top"))


def fit_max_edge(width: Column, height: Column, bound: int) -> Column:
    """Struct (width, height): the longer side at most the bound."""
    long, b = F.greatest(width, height), F.lit(int(bound))
    scale = _d(b) / _d(long)
    small = long <= b
    return F.struct(
        F.when(small, width).when(width == long, b).otherwise(_whole(scale * _d(width))).cast("int").alias("width"),
        F.when(small, height).when(height == long, b).otherwise(_whole(scale * _d(height))).cast("int").alias("height"),
    )


def fit_min_edge(width: Column, height: Column, bound: int) -> Column:
    """Struct (width, height): the shorter side at most the bound, both scaled by it."""
    short = F.least(width, height)
    scale = _d(F.lit(int(bound))) / _d(short)
    small = short <= F.lit(int(bound))
    return F.struct(*(F.when(small, c).otherwise(_whole(_d(c) * scale)).cast("int").alias(n) for c, n in ((width, "width"), (height, "height"))))


def grow_min_edge(width: Column, height: Column, bound: int) -> Column:
    """Struct (width, height): the shorter side at least the bound."""
    short, b = F.least(width, height), F.lit(int(bound))
    scale = _d(b) / _d(short)
    large = short >= b
    return F.struct(
        F.when(large, width).when(width == short, b).otherwise(_whole(scale * _d(width))).cast("int").alias("width"),
        F.when(large, height).when(height == short, b).otherwise(_whole(scale * _d(height))).cast("int").alias("height"),
    )


def edge_crop(width: Column, height: Column, boxes: Column, max_share: float = 0.15, strict: float = 0.05) -> Column:
    """Struct (left, top, right, bottom, modified): the cut at one edge that removes the marks along it.

    ``boxes``: array of structs (x1, y1, x2, y2). Boxes that come near an edge and lie wholly in a margin count; each
    votes for every margin it reaches into, an edge takes its deepest vote and the edge of the least depth is cut.
    Equal depths: left, right, top, bottom.
    """
    mx, my = _whole(_d(width) * max_share), _whole(_d(height) * max_share)
    sx, sy = _whole(_d(width) * strict), _whole(_d(height) * strict)
    i = lambda b, k: b[k].cast("int")  # noqa: E731 - the cast cuts towards zero

    def counts(b: Column) -> Column:
        x1, y1, x2, y2 = (i(b, k) for k in ("x1", "y1", "x2", "y2"))
        near = (x1 <= sx) | (x2 >= width - sx) | (y1 <= sy) | (y2 >= height - sy)
        inside = ((x1 <= mx) & (x2 <= mx)) | ((x1 >= width - mx) & (x2 >= width - mx)) | ((y1 <= my) & (y2 <= my)) | ((y1 >= height - my) & (y2 >= height - my))
        return near & inside

    def depths(kept: Column) -> Column:
        depth = lambda test, size: F.array_max(F.transform(F.filter(kept, test), size))
        left = depth(lambda b: i(b, "x1") <= mx, lambda b: i(b, "x2"))
        right = depth(lambda b: i(b, "x2") >= width - mx, lambda b: width - i(b, "x1"))
        top = depth(lambda b: i(b, "y1") <= my, lambda b: i(b, "y2"))
        bottom = depth(lambda b: i(b, "y2") >= height - my, lambda b: height - i(b, "y1"))
        return F.array_min(F.transform(F.array(*(F.struct(c.alias("size"), F.lit(k).alias("edge")) for k, c in enumerate((left, right, top, bottom)))), lambda v: F.when(v["size"].isNotNull(), v)))

    def cut(best: Column) -> Column:
        size, edge, zero = best["size"], F.coalesce(best["edge"], F.lit(-1)), F.lit(0)
        return F.struct(
            F.when(edge == 0, size).otherwise(zero).alias("left"), F.when(edge == 2, size).otherwise(zero).alias("top"),
            F.when(edge == 1, width - size).otherwise(width).alias("right"), F.when(edge == 3, height - size).otherwise(height).alias("bottom"),
            best.isNotNull().alias("modified"),
        )

    return once(once(F.filter(boxes, counts), depths), cut)


def scale_box(box: Column, scale: float, width: Column, height: Column) -> Column:
    """A face's box (x1, y1, x2, y2) grown about its centre and clipped to the image."""
    x1, y1, x2, y2 = (box[k].cast("int") for k in ("x1", "y1", "x2", "y2"))
    dx, dy = (((b - a).cast("double") * F.lit(scale - 1.0) / F.lit(2.0)).cast("int") for a, b in ((x1, x2), (y1, y2)))
    return F.struct(
        F.greatest(F.lit(0), x1 - dx).alias("x1"), F.greatest(F.lit(0), y1 - dy).alias("y1"),
        F.least(width - 1, x2 + dx).alias("x2"), F.least(height - 1, y2 + dy).alias("y2"),
    )
