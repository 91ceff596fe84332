"""Columns that models derive from pixels: embeddings, scores, detections, and edits of what they find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from framewright.functions import detections as D
from framewright.functions import geometry as G
from framewright.functions.keys import memo_key_column
from framewright.models.codec import apply_pixels
from framewright.models.runner import Backend, backend_of, infer
from framewright.plans.operator import Operator

DETECTIONS = "array<struct<class:string,score:double,box:array<int>>>"
BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>"
TOGETHER = 64  # boxes of a group, up to which groups are suppressed many at a time
METHODS = ("blur", "solid", "none", "mosaic")


class _Derived(Operator):
    scope, kind, batch_size = "", "string", 128

    def __init__(self, backend: Backend | None = None, batch_size: int | None = None):
        super().__init__()
        self.backend, self.batch = backend, batch_size or type(self).batch_size

    def derive(self, dataset: DataFrame, target: str, *segments) -> DataFrame:
        inputs = {c: F.col(c) for c in ("objectid", "content", "original_path") if c in dataset.columns}
        key = memo_key_column(self.scope, *segments, F.col("objectid"))
        return self.workspace.memo.fill(dataset, key, lambda m: infer(m, backend_of(self.scope, self.backend), inputs, self.batch, text=False), target, self.kind, scope=self.scope)


class ClipEmbed(_Derived):
    """An embedding of each image, not normalised."""

    scope, kind = "clip_embedding", "array<float>"

    def __init__(self, batch_size: int = 128, target_prop: str = "clip", model: str = "default", backend: Backend | None = None):
        super().__init__(backend, batch_size)
        self.target, self.model = target_prop, model

    def eval(self, dataset: DataFrame) -> DataFrame:
        return self.derive(dataset, self.target, self.model)


class AestheticScore(_Derived):
    scope, kind, batch_size = "aesthetic_score", "double", 256

    def __init__(self, batch_size: int = 256, backend: Backend | None = None):
        super().__init__(backend, batch_size)

    def eval(self, dataset: DataFrame) -> DataFrame:
        return self.derive(dataset, "aesthetic_score", "v1")


def linear_score(vector, weights: list[float], bias: float = 0.0):
    """A linear head over embeddings, as a column."""
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, weights)), lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda s, x: s + x)


class NudeNet(_Derived):
    """Detections, and what they say at a threshold, which is no part of the memo key: another one asks no model again."""

    scope, kind = "nudenet", DETECTIONS

    def __init__(self, threshold: float = 0.5, backend: Backend | None = None):
        super().__init__(backend)
        self.threshold = threshold

    def eval(self, dataset: DataFrame) -> DataFrame:
        found, d = self.derive(dataset, "nudenet"), F.col("nudenet")
        return found.withColumns({"has_nudity": D.has_nudity(d, self.threshold), "has_male": D.has_male(d, self.threshold), "has_female": D.has_female(d, self.threshold)})

    def has(self, label: str):
        return D.has_label(F.col("nudenet"), label, self.threshold)


class EdgeWatermarkRemoval(_Derived):
    """Cut the one edge at which the detected marks take the least depth; what has none passes unchanged."""

    scope, kind = "watermark_removal", "array<struct<x1:double,y1:double,x2:double,y2:double,label:string>>"

    def __init__(self, max_crop_percent: float = 0.15, preview_crop: bool = False, backend: Backend | None = None):
        super().__init__(backend)
        self.share, self.preview = max_crop_percent, preview_crop

    def eval(self, dataset: DataFrame) -> DataFrame:
        found = self.derive(dataset, "_marks", "v2", self.share, self.preview)
        cut = found.withColumn("_cut", G.edge_crop(F.col("width"), F.col("height"), F.coalesce("_marks", F.array().cast(self.kind)), self.share))
        labels = F.transform("_marks", lambda m: m["label"])
        w, h = F.col("_cut.right") - F.col("_cut.left"), F.col("_cut.bottom") - F.col("_cut.top")
        cut = cut.withColumn("watermark_info", F.struct(F.col("_cut.modified").alias("did_modify"), F.lit(self.preview).alias("preview_mode"), w.alias("width"), h.alias("height"), F.col("_marks").alias("bboxes"), labels.alias("labels")))
        go = F.col("_cut.modified") & F.lit(not self.preview)
        out = cut.withColumn("format", F.when(go, "PNG").otherwise(F.col("format"))) if "format" in cut.columns else cut
        if "content" in out.columns:
            facts = F.struct(F.col("_cut.left").alias("left"), F.col("_cut.top").alias("top"), w.alias("width"), h.alias("height"))
            out = apply_pixels(out, lambda codec, pixels, d: codec.crop(pixels, **d), facts, go)
        return out.withColumn("width", F.when(go, w).otherwise(F.col("width"))).withColumn("height", F.when(go, h).otherwise(F.col("height"))).drop("_marks", "_cut")


def decode_heatmap(heat: np.ndarray, scale: np.ndarray, offset: np.ndarray, width: int, height: int, threshold: float, stride: int = 4) -> np.ndarray:
    """Boxes (x1, y1, x2, y2, score) of a face detector's maps: heat (h, w), log sizes and offsets (2, h, w), rows before columns."""
    y, x = np.nonzero(heat > threshold)
    sh, sw = np.exp(scale[0, y, x]) * stride, np.exp(scale[1, y, x]) * stride
    x1 = np.clip((x + offset[1, y, x] + 0.5) * stride - sw / 2, 0, width)
    y1 = np.clip((y + offset[0, y, x] + 0.5) * stride - sh / 2, 0, height)
    return np.stack([x1, y1, np.minimum(x1 + sw, width), np.minimum(y1 + sh, height), heat[y, x]], axis=1) if len(y) else np.zeros((0, 5))


def suppress(boxes: np.ndarray, limit: float = 0.3) -> np.ndarray:
    """Indices, ascending, of what greedy suppression keeps: best score first (of equal ones the first), gone what overlaps a kept one by ``limit``."""
    order, gone = np.argsort(-boxes[:, 4], kind="stable"), np.zeros(len(boxes), bool)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for n, i in enumerate(order):
        if gone[i]:
            continue
        rest = order[n + 1 :]
        w = np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0])
        h = np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        whole = area[i] + area[rest] - both
        gone[rest[(whole > 0) & (both >= limit * whole)]] = True  # boxes without area overlap none
    return np.flatnonzero(~gone)


def suppress_equal(boxes: np.ndarray, limit: float = 0.3) -> np.ndarray:
    """Which boxes ``suppress`` keeps, of groups (groups, boxes, 5) of one size, all groups at a time."""
    order = np.argsort(-boxes[:, :, 4], axis=1, kind="stable")
    x1, y1, x2, y2 = (np.take_along_axis(boxes[:, :, k], order, 1) for k in range(4))
    area, gone = (x2 - x1) * (y2 - y1), np.zeros(order.shape, bool)
    for n in range(order.shape[1] - 1):
        one, rest = slice(n, n + 1), slice(n + 1, None)
        w = np.minimum(x2[:, one], x2[:, rest]) - np.maximum(x1[:, one], x1[:, rest])
        h = np.minimum(y2[:, one], y2[:, rest]) - np.maximum(y1[:, one], y1[:, rest])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        whole = area[:, one] + area[:, rest] - both
        gone[:, rest] |= ~gone[:, one] & (whole > 0) & (both >= limit * whole)
    kept = np.empty_like(gone)
    np.put_along_axis(kept, order, ~gone, 1)
    return kept


def suppressed(faces: Column | str) -> Column:
    """``suppress`` over a column of boxes; null stays null."""
    return F.arrow_udf(_suppressed, BOXES)(faces)


def _suppressed(faces: pa.Array) -> pa.Array:
    found, sizes = faces.flatten(), pc.fill_null(pc.list_value_length(faces), 0).to_numpy()
    boxes = np.stack([found.field(k).to_numpy(zero_copy_only=False) for k in ("x1", "y1", "x2", "y2", "score")], axis=1)
    keep, starts = np.ones(len(boxes), bool), np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 1]):
        at = starts[sizes == size]
        if size > TOGETHER:
            for a in at:
                keep[a : a + size] = False
                keep[a + suppress(boxes[a : a + size])] = True
        else:
            rows = at[:, None] + np.arange(size)
            keep[rows] = suppress_equal(boxes[rows])
    total = np.concatenate([[0], np.cumsum(keep)])
    offsets = total[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
    rows = np.flatnonzero(keep)
    return pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(rows)), mask=faces.is_null())


def box_mean(part: np.ndarray, high: int, wide: int) -> np.ndarray:
    """Means over a window of so many pixels about each, the picture mirrored at its edges."""
    out = part.astype(np.float64)
    for axis, size in ((0, max(1, high)), (1, max(1, wide))):
        before = size // 2
        pads = [(before, size - 1 - before) if k == axis else (0, 0) for k in range(out.ndim)]
        total = np.cumsum(np.insert(np.pad(out, pads, mode="reflect" if out.shape[axis] > size else "symmetric"), 0, 0, axis=axis), axis=axis)
        n = out.shape[axis]
        out = (np.take(total, np.arange(n) + size, axis) - np.take(total, np.arange(n), axis)) / size
    return np.rint(out).astype(part.dtype)


def cover(pixels: np.ndarray, boxes: list, method: str, ellipse: bool, mosaic: int) -> np.ndarray:
    """Pixels with the boxes (x1, y1, x2, y2) blurred, blackened or in mosaic. An ellipse bounds only what is blurred."""
    out = pixels.copy()
    for b in boxes:
        x1, y1, x2, y2 = (int(b[k]) for k in ("x1", "y1", "x2", "y2"))
        if method == "solid":
            out[y1 : y2 + 1, x1 : x2 + 1] = 0
        elif method == "mosaic":
            for y in range(y1, y2, mosaic):
                for x in range(x1, x2, mosaic):
                    out[y : min(y2, y + mosaic - 1) + 1, x : min(x2, x + mosaic - 1) + 1] = out[y, x].copy()
        elif method == "blur" and x2 > x1 and y2 > y1:
            part = out[y1:y2, x1:x2]
            h, w = part.shape[:2]
            new = box_mean(part, h // 2, w // 2)
            if ellipse:
                ry, rx = max(h // 2, 1), max(w // 2, 1)
                inside = ((np.arange(w) - w // 2) / rx) ** 2 + (((np.arange(h) - h // 2) / ry) ** 2)[:, None] < 1
                part[inside] = new[inside]
            else:
                out[y1:y2, x1:x2] = new
    return out


class Anonymize(_Derived):
    """Faces found by a backend, suppressed, scaled about their centres and covered. The backend gives boxes with scores."""

    scope, kind = "anonymize", BOXES

    def __init__(self, method: str = "blur", threshold: float = 0.4, mask_scale: float = 1.0, ellipse: bool = True, mosaic_size: int = 20, backend: Backend | None = None):
        super().__init__(backend)
        if method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}")
        self.method, self.threshold, self.scale, self.ellipse, self.mosaic = method, threshold, mask_scale, ellipse, mosaic_size

    def eval(self, dataset: DataFrame) -> DataFrame:
        found = self.derive(dataset, "_faces", "v1", self.method, self.threshold, self.scale, self.ellipse, self.mosaic)
        threshold, scale = self.threshold, self.scale
        sure = F.filter(suppressed("_faces"), lambda d: d["score"] > threshold)
        found = found.withColumn("faces", F.transform(sure, lambda d: G.scale_box(d, scale, F.col("width"), F.col("height"))))
        if "content" not in found.columns:
            return found.drop("_faces")
        method, ellipse, mosaic = self.method, self.ellipse, self.mosaic

        def change(codec, pixels: np.ndarray, d: dict) -> np.ndarray:
            boxes = [b.asDict() if isinstance(b, Row) else b for b in d["faces"]]
            return cover(pixels, boxes, method, ellipse, mosaic)

        go = F.coalesce(F.size("faces") > 0, F.lit(False))
        out = found.withColumn("format", F.when(go, "PNG").otherwise(F.col("format"))) if "format" in found.columns else found
        return apply_pixels(out, change, F.struct("faces"), go).drop("_faces")
