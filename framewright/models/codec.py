"""Pixels. PNG of 8 bits a channel is read and written here; other formats need a codec registered with ``use``."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGN = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of an array (height, width, channels) of bytes."""
    h, w, c = pixels.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    lines = np.zeros((h, 1 + w * c), np.uint8)
    lines[:, 1:] = pixels.reshape(h, w * c)
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    if raw[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    while at + 8 <= len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        part = raw[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("a kind of PNG that needs a codec")
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + w * c)
    out, last = np.zeros((h, w, c), np.int64), np.zeros((w, c), np.int64)
    for y in range(h):
        kind, line = int(lines[y, 0]), lines[y, 1:].reshape(w, c).astype(np.int64)
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + last) & 255
        elif kind in (3, 4):
            row = np.zeros(c, np.int64)
            corner = np.zeros(c, np.int64)
            for x in range(w):
                up = last[x]
                if kind == 3:
                    guess = (row + up) // 2
                else:
                    p = row + up - corner
                    a, b, d = abs(p - row), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), row, np.where(b <= d, up, corner))
                row = (line[x] + guess) & 255
                line[x] = row
                corner = up
        out[y] = last = line
    return out.astype(np.uint8)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, averaging over the area where it shrinks."""
    out = pixels.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        scale = n / size
        reach = max(1.0, scale)
        centre = (np.arange(size) + 0.5) * scale - 0.5
        weights = np.maximum(0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / reach)
        weights /= weights.sum(axis=1, keepdims=True)
        out = np.moveaxis(np.tensordot(weights, out, axes=(1, axis)), 0, axis)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def flatten(pixels: np.ndarray) -> np.ndarray:
    """Without transparency, on white."""
    if pixels.shape[2] not in (2, 4):
        return pixels
    alpha = pixels[..., -1:].astype(np.float64) / 255
    return np.rint(pixels[..., :-1] * alpha + 255 * (1 - alpha)).astype(np.uint8)


class Codec:
    """Reads and writes pixels. A subclass may know more formats, or better ways to scale."""

    def decode(self, raw: bytes) -> np.ndarray:
        return decode_png(raw)

    def encode(self, pixels: np.ndarray, form: str) -> bytes:
        if form != "PNG":
            raise ValueError(f"no codec for {form}")
        return encode_png(pixels)

    def crop(self, pixels: np.ndarray, left: int, top: int, width: int, height: int) -> np.ndarray:
        return pixels[top : top + height, left : left + width]

    def resize(self, pixels: np.ndarray, width: int, height: int) -> np.ndarray:
        return resize(pixels, width, height)

    def convert(self, pixels: np.ndarray, format: str) -> np.ndarray:
        return flatten(pixels) if format in ("JPEG", "BMP") else pixels


_codec = Codec()


def use(codec: Codec) -> None:
    global _codec
    _codec = codec


def apply_pixels(df: DataFrame, change: Callable[[Any, np.ndarray, dict], np.ndarray], facts: Column, changed: Column) -> DataFrame:
    """Rows whose ``content`` is changed by ``change(codec, pixels, facts)``, with their new objectid; ``error`` says why one stayed as it was."""
    codec = _codec

    @F.pandas_udf("content binary, error string")
    def work(parts: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, detail, form, go in parts:
            out = []
            for raw, d, f, yes in zip(content, detail.to_dict("records"), form, go, strict=True):
                if raw is None or not yes:
                    out.append((raw, None))
                    continue
                try:
                    out.append((codec.encode(change(codec, codec.decode(bytes(raw)), d), f or "PNG"), None))
                except Exception as problem:
                    out.append((raw, str(problem)))
            yield pd.DataFrame(out, columns=["content", "error"])

    form = F.col("format") if "format" in df.columns else F.lit("PNG")
    done = df.withColumn("_done", work("content", facts, form, changed))
    done = done.withColumn("content", F.col("_done.content")).withColumn("error", F.col("_done.error")).drop("_done")
    return done.withColumn("objectid", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).otherwise(F.col("objectid"))) if "objectid" in df.columns else done


def transformed(df: DataFrame, method: str, facts: Column, changed: Column) -> DataFrame:
    """The codec's ``method`` on contents, where the dataset has them; else only what its columns say changes."""
    if "content" not in df.columns:
        return df
    return apply_pixels(df, lambda codec, pixels, d: getattr(codec, method)(pixels, **d), facts, changed)
