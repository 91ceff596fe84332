"""Tag operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.frame import prop
from framewright.functions import tags as T
from framewright.plans.operator import Operator


class _Tags(Operator):
    def __init__(self, tags):
        super().__init__()
        self.tags = tags

    change = None

    def eval(self, dataset: DataFrame) -> DataFrame:
        dataset = prop(dataset, "tags", "array<string>")
        return dataset.withColumn("tags", type(self).change(F.col("tags"), self.tags))


class AddTags(_Tags):
    """Add a tag or several; where there were none the tags are these."""

    change = staticmethod(T.add_tags)

    def __init__(self, tags: str | Iterable[str]):
        super().__init__(tags)


class RemoveTags(_Tags):
    change = staticmethod(T.remove_tags)

    def __init__(self, tags: str | Iterable[str]):
        super().__init__(tags)


class RewriteTags(_Tags):
    change = staticmethod(T.rewrite_tags)

    def __init__(self, mapping: Mapping[str, str]):
        super().__init__(mapping)


def tag_frequencies(records: DataFrame, vocabulary: Iterable[str], tags: str = "tags") -> DataFrame:
    """Rows (tag, n) of every tag of the vocabulary, unseen ones with 0."""
    names = sorted(set(vocabulary))
    seen = records.select(F.explode(F.array_distinct(tags)).alias("tag")).filter(F.col("tag").isin(names)).groupBy("tag").count()
    known = records.sparkSession.createDataFrame([(t,) for t in names], "tag string")
    return known.join(F.broadcast(seen), "tag", "left").select("tag", F.coalesce("count", F.lit(0)).cast("long").alias("n"))
