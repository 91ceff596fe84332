"""Cropping, scaling and converting images: what becomes of sizes and formats as columns; pixels by a codec where there are contents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.models.codec import transformed
from framewright.plans.operator import Operator

UPSCALERS = ("PIL", "ESRGAN", "SWINIR")
ALPHA = ("PNG", "WEBP", "GIF", "TIFF")


def crop_to_aspect(df: DataFrame, ratios: Iterable[float]) -> DataFrame:
    """The crop to the nearest ratio, the smaller of two as near; what WEBP held becomes PNG."""
    ratio = G.nearest_ratio(F.col("width"), F.col("height"), ratios)
    with_ratio = df.withColumn("crop_target_ratio", ratio)
    crop = G.crop_to_ratio(F.col("width"), F.col("height"), F.col("crop_target_ratio"))
    out = with_ratio.withColumn("_crop", crop).withColumn("crop_original_width", F.col("width")).withColumn("crop_original_height", F.col("height"))
    out = out.withColumn("width", F.col("_crop.width")).withColumn("height", F.col("_crop.height"))
    return out.withColumn("format", F.when(F.col("format") == "WEBP", "PNG").otherwise(F.col("format"))) if "format" in df.columns else out


class CropToAspect(Operator):
    def __init__(self, aspect_ratios: Iterable[float]):
        super().__init__()
        self.ratios = sorted(map(float, aspect_ratios))
        if not self.ratios or self.ratios[0] <= 0:
            raise ValueError("aspect_ratios must name a positive ratio")

    def eval(self, dataset: DataFrame) -> DataFrame:
        out = crop_to_aspect(dataset, self.ratios)
        return transformed(out, "crop", F.struct("_crop.left", "_crop.top", "width", "height"), F.lit(True)).drop("_crop")


def _scaled(df: DataFrame, size, info: str, method: str, edge: str, bound: int, form: str) -> DataFrame:
    out = df.withColumn("_size", size)
    changed = (F.col("_size.width") != F.col("width")) | (F.col("_size.height") != F.col("height"))
    facts = F.struct(F.lit(method).alias("method"), F.lit(edge).alias("edge"), F.lit(bound).alias("bound"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), F.col("_size.width").alias("scaled_width"), F.col("_size.height").alias("scaled_height"))
    out = out.withColumn("_changed", F.coalesce(changed, F.lit(False))).withColumn(info, F.when(F.col("_changed"), facts))
    out = out.withColumn("width", F.col("_size.width")).withColumn("height", F.col("_size.height"))
    return out.withColumn("format", F.when(F.col("_changed"), form).otherwise(F.col("format"))) if "format" in df.columns else out


def downscale(df: DataFrame, max_edge: int | None = None, min_edge: int | None = None, form: str = "PNG", method: str = "PIL") -> DataFrame:
    """Sizes with the longer side at most ``max_edge``, or the shorter at most ``min_edge``; smaller images stay as they are."""
    if (max_edge is None) == (min_edge is None):
        raise ValueError("give max_edge or min_edge")
    w, h = F.col("width"), F.col("height")
    size, edge, bound = (G.fit_max_edge(w, h, max_edge), "max", max_edge) if max_edge is not None else (G.fit_min_edge(w, h, min_edge), "min", min_edge)
    return _scaled(df, size, "downscale_info", method, edge, bound, form)


class Downscale(Operator):
    def __init__(self, method: str = "PIL", max_edge: int | None = None, min_edge: int | None = None, format: str = "PNG"):
        super().__init__()
        if (max_edge is None) == (min_edge is None):
            raise ValueError("give max_edge or min_edge")
        self.args = (max_edge, min_edge, format, method)

    def eval(self, dataset: DataFrame) -> DataFrame:
        out = downscale(dataset, *self.args)
        return transformed(out, "resize", F.struct("width", "height"), F.col("_changed")).drop("_size", "_changed")


def upscale(df: DataFrame, min_edge: int = 1024, form: str = "PNG", method: str = "PIL") -> DataFrame:
    """Sizes with the shorter side at least ``min_edge``; larger images stay as they are."""
    return _scaled(df, G.grow_min_edge(F.col("width"), F.col("height"), min_edge), "upscale_info", method, "min", min_edge, form)


class Upscale(Operator):
    """All methods resize by interpolation unless a codec with the named model is registered."""

    def __init__(self, method: str = "PIL", min_edge: int = 1024, format: str = "PNG"):
        super().__init__()
        if method not in UPSCALERS:
            raise ValueError(f"method must be one of {UPSCALERS}")
        self.args = (min_edge, format, method)

    def eval(self, dataset: DataFrame) -> DataFrame:
        out = upscale(dataset, *self.args)
        return transformed(out, "resize", F.struct("width", "height"), F.col("_changed")).drop("_size", "_changed")


def convert_format(df: DataFrame, form: str) -> DataFrame:
    """The format, and how pixels are carried over: flattened on white where the target knows no transparency."""
    mode = "RGBA" if form in ALPHA else "RGB"
    same = F.col("format").eqNullSafe(F.lit(form))
    return df.withColumn("convert_mode", F.when(~same, mode)).withColumn("_changed", ~same).withColumn("format", F.lit(form))


class ConvertFormat(Operator):
    """Images of that format already, by its exact name, are passed over."""

    def __init__(self, format: str):
        super().__init__()
        self.format = format

    def eval(self, dataset: DataFrame) -> DataFrame:
        out = convert_format(dataset, self.format)
        return transformed(out, "convert", F.struct(F.lit(self.format).alias("format")), F.col("_changed")).drop("_changed", "convert_mode")
