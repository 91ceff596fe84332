"""Images as a source: files, their hashes and what their headers say."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.frame import with_positions
from framewright.functions.strings import extension
from framewright.sources.files import list_files, read_files, spread
from framewright.storage import materialise

EXTENSIONS = (".jpg", ".png", ".webp")


def _jpeg(raw: bytes) -> tuple[int, int] | None:
    i = 2
    while i + 9 <= len(raw):
        if raw[i] != 0xFF:
            return None
        mark = raw[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark in (0x01, *range(0xD0, 0xD9)):
            i += 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[i + 5 : i + 9])
            return w, h
        i += 2 + struct.unpack(">H", raw[i + 2 : i + 4])[0]
    return None


def _webp(raw: bytes) -> tuple[int, int] | None:
    kind = raw[12:16]
    if kind == b"VP8X" and len(raw) >= 30:
        return 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little")
    if kind == b"VP8L" and len(raw) >= 25:
        bits = int.from_bytes(raw[21:25], "little")
        return (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1
    if kind == b"VP8 " and len(raw) >= 30:
        w, h = struct.unpack("<HH", raw[26:30])
        return w & 0x3FFF, h & 0x3FFF
    return None


def _tiff(raw: bytes) -> tuple[int, int] | None:
    e = "<" if raw[:2] == b"II" else ">"
    (at,) = struct.unpack(e + "I", raw[4:8])
    (n,) = struct.unpack(e + "H", raw[at : at + 2])
    size = {}
    for k in range(n):
        tag, kind, _ = struct.unpack(e + "HHI", raw[at + 2 + 12 * k : at + 10 + 12 * k])
        if tag in (256, 257):
            size[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), raw[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])[0]
    return (size[256], size[257]) if len(size) == 2 else None


def read_header(raw: bytes | None) -> tuple[int, int, str] | None:
    """(width, height, format) of an image file's bytes; None where they are no image."""
    if not raw:
        return None
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n" and raw[12:16] == b"IHDR":
            found, kind = struct.unpack(">II", raw[16:24]), "PNG"
        elif raw[:3] == b"\xff\xd8\xff":
            found, kind = _jpeg(raw), "JPEG"
        elif raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            found, kind = _webp(raw), "WEBP"
        elif raw[:6] in (b"GIF87a", b"GIF89a"):
            found, kind = struct.unpack("<HH", raw[6:10]), "GIF"
        elif raw[:2] == b"BM":
            w, h = struct.unpack("<ii", raw[18:26])
            found, kind = (w, abs(h)), "BMP"
        elif raw[:4] in (b"II*\0", b"MM\0*"):
            found, kind = _tiff(raw), "TIFF"
        else:
            return None
    except struct.error:
        return None
    return (found[0], found[1], kind) if found and min(found) > 0 else None


FACTS = "struct<objectid:string,width:int,height:int,format:string>"


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Rows (original_path) of the files that are named as images. No content is read."""
    return list_files(spark, path).filter(F.lower(F.col("path")).rlike(r"\.(jpg|png|webp)$")).withColumnRenamed("path", "original_path")


def read_facts(misses: DataFrame) -> DataFrame:
    """Rows (_key, value) of files (_key, original_path): what they hold, as JSON, null for what is no image."""
    files = materialise(misses.select("_key", "original_path"), "files")
    found = read_files(spread(files, files.count()), "original_path", read_header)
    return found.select("_key", F.when(F.col("format").isNotNull(), F.to_json(F.struct("objectid", "width", "height", "format"))).alias("value"))


def read_images(spark: SparkSession, path: str, keep_content: bool = False) -> DataFrame:
    """All images below a folder, ordered by path; files that are no images are passed over."""
    files = list_images(spark, path)
    images = read_files(spread(files, files.count()), "original_path", read_header, keep_content).filter("format is not null")
    return with_positions(images.select("original_path", "objectid", extension(F.col("original_path")).alias("ext"), "width", "height", "format", *(["content"] if keep_content else [])), "original_path")
