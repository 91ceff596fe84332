"""Files from the web, each fetched once into a folder that all executors share."""

from __future__ import annotations

import hashlib
import uuid
from pathlib import PurePosixPath
from urllib.parse import urlparse
from urllib.request import urlopen

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from framewright.storage import filesystem, qualified

PIECE = 1 << 20


class DownloadCache:
    """``fetch`` gives the path of a URL's content; what is there is not fetched again.

    A file appears under its name only when it is whole: it is written beside and moved, so a fetch that breaks off leaves nothing to be read,
    and of two at a time either gives the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = qualified(spark, path)

    def named(self, url: str) -> str:
        """A path of the URL's own: a hash of it, with its file's ending."""
        return f"{self.path}/{hashlib.sha256(url.encode()).hexdigest()}{PurePosixPath(urlparse(url).path).suffix}"

    def fetch(self, url: str, name: str | None = None) -> str:
        target = f"{self.path}/{name}" if name else self.named(url)
        fs, at = filesystem(target)
        if fs.get_file_info(at).type is pafs.FileType.File:
            return target
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        beside = f"{at}.{uuid.uuid4().hex}"
        try:
            with urlopen(url) as source, fs.open_output_stream(beside) as out:
                while piece := source.read(PIECE):
                    out.write(piece)
            fs.move(beside, at)
        finally:
            if fs.get_file_info(beside).type is pafs.FileType.File:
                fs.delete_file(beside)
        return target
