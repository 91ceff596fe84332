"""String and array helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorten_path(path: Column, longest: int = 60) -> Column:
    """The path with its middle left out where it is longer."""
    if longest < 5:
        raise ValueError("longest must be 5 or more")
    back = (longest - 3) // 2
    front = longest - 3 - back
    return F.when(F.length(path) <= longest, path).otherwise(F.concat(F.substring(path, 1, front), F.lit("..."), F.right(path, F.lit(back))))


def base_name(path: Column) -> Column:
    """The last part of a path without its extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.[^.]*$|^\.+[^.]*$"), F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def extension(path: Column) -> Column:
    """The extension with its dot, as written."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1)


def save_stem(path: Column, objectid: Column) -> Column:
    return F.concat(F.substring(base_name(path), 1, 80), F.lit("_"), objectid)


def clean_caption(caption: Column) -> Column:
    """White space off both ends, then exclamation marks off the right."""
    return F.regexp_replace(F.trim(F.regexp_replace(caption, r"^\s+|\s+$", "")), r"!+$", "")


def elide(values: Column, longest: int, shown: int = 25) -> Column:
    """An array as strings, its middle replaced by one ellipsis where it is longer."""
    text = F.transform(values, lambda v: v.cast("string"))
    return F.when(F.size(values) > longest, F.concat(F.slice(text, 1, shown), F.array(F.lit("...")), F.slice(text, -shown, shown))).otherwise(text)
