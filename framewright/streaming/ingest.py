"""Images as a stream: each new file once, by its content.

The workers list the folder; the names that are new are added to a table in the checkpoint, and that table is what is streamed. So the
driver holds the names of a few files of the table, and not those of all images that it ever saw.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.strings import extension
from framewright.sources.files import read_files, spread
from framewright.sources.images import list_images, read_header
from framewright.storage import exists

NAMES = "original_path string"


def add_names(spark: SparkSession, path: str, names: str) -> int:
    """Add the images below a folder that a table of names lacks; gives how many."""
    files = list_images(spark, path)
    if exists(spark, names):
        files = files.join(spark.read.schema(NAMES).parquet(names), "original_path", "left_anti")
    n = files.count()
    if n:
        spread(files, n).write.mode("append").parquet(names)
    return n


def stream_images(spark: SparkSession, names: str, late: str | None = None) -> DataFrame:
    """A stream of the images of a table of names, the first file of each content.

    With ``late``, contents are remembered only that long by modification time, which bounds the state.
    """
    files = read_files(spark.readStream.schema(NAMES).parquet(names), "original_path", read_header)
    images = files.filter("format is not null").select("original_path", "objectid", extension(F.col("original_path")).alias("ext"), "width", "height", "format", F.col("modified").alias("modificationTime"))
    if late is None:
        return images.dropDuplicates(["objectid"])
    return images.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["objectid"])


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, late: str | None = None) -> None:
    """Add the files that came since the last call to a Parquet table, and return."""
    names = f"{checkpoint}/names"
    if not add_names(spark, path, names) and not exists(spark, names):
        return
    query = stream_images(spark, names, late).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start()
    query.awaitTermination()
