"""A filter that learns people's verdicts from embeddings and passes them on to what nobody has seen."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.keys import memo_key_column
from framewright.operators.decisions import HumanFilter, keep_passed
from framewright.plans.operator import Abort
from framewright.sources.memo import lookup
from framewright.storage import exists


def verdict(probability: Column, min_confidence: float) -> Column:
    """True or false where the likelier class is surer than ``min_confidence``, else null."""
    return F.when(F.greatest(probability, 1 - probability) > min_confidence, probability > 0.5)


def combine(human: Column, smart: Column, when_uncertain: str = "reject") -> Column:
    """Kept: what people passed; else what the model passed of what they have not seen; else, with ``accept``, the undecided."""
    return F.coalesce(human, smart, F.lit(when_uncertain.strip() == "accept"))


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows (label, rejected, accepted, unknown): how verdicts fall, unknown being those below the confidence."""
    p = F.col(predicted)
    return df.groupBy(label).agg(F.count_if(~p).alias("rejected"), F.count_if(p).alias("accepted"), F.count_if(p.isNull()).alias("unknown"))


def in_training(share: float = 0.8) -> Column:
    """Whether an image is trained on, by its id: the split is made before the rarer class is weighted up."""
    return F.pmod(F.xxhash64("objectid"), F.lit(1000)) < int(share * 1000)


class SmartHumanFilter(HumanFilter):
    """A fitted model is kept in the workspace by its settings and the decisions it was fitted on, and used again while those stay.

    ``learning_rate``, ``patience`` and ``dropout`` are part of the model's key; the solver used here has no such settings.
    """

    def __init__(self, domain: str = "default", model_version: str = "v1", min_images: int = 5000, min_per_class: int = 1000, learning_rate: float = 1e-3, batch_size: int = 128, epochs: int = 500, patience: int = 20, dropout: float = 0.5, min_confidence: float = 0.7, min_accuracy: float = 0.9, when_uncertain: str = "reject", vector: str = "clip"):
        super().__init__(domain, True)
        if when_uncertain.strip() not in ("accept", "reject", "human"):
            raise Abort("when_uncertain must be accept, reject or human")
        self.min_images, self.min_per_class, self.batch_size, self.epochs = min_images, min_per_class, batch_size, epochs
        self.min_confidence, self.min_accuracy, self.when_uncertain, self.vector = min_confidence, min_accuracy, when_uncertain.strip(), vector
        self.facts = {"model_version": model_version, "min_per_class": min_per_class, "learning_rate": learning_rate, "batch_size": batch_size, "epochs": epochs, "patience": patience, "dropout": dropout}

    def key(self) -> Column:
        return memo_key_column("smartfilter", json.dumps(self.facts, sort_keys=True), F.col("objectid"))

    def model_path(self, decided: DataFrame) -> str:
        """Where the model of these decisions lies: they are told apart by the sums of their hashes, in any order."""
        n, total = decided.agg(F.count("*"), F.sum(F.xxhash64("objectid", "passed_human_filter", self.vector).cast("decimal(38,0)"))).first()
        facts = json.dumps([self.facts, self.domain, self.vector, self.epochs, n, str(total)], sort_keys=True)
        return f"{self.workspace.path}/models/smartfilter-{hashlib.sha256(facts.encode()).hexdigest()}"

    def train(self, seen: DataFrame):
        decided = seen.filter("passed_human_filter is not null").withColumn("label", F.col("passed_human_filter").cast("double")).withColumn("features", array_to_vector(F.col(self.vector).cast("array<double>")))
        counts = {bool(r.passed_human_filter): r["count"] for r in decided.groupBy("passed_human_filter").count().collect()}
        if min(counts.get(True, 0), counts.get(False, 0)) < self.min_per_class:
            raise Abort(f"{self.min_per_class} decisions of each kind are needed")
        split = decided.withColumn("_train", in_training())
        train, held = split.filter("_train"), split.filter("not _train")
        rare, ratio = (counts[True] < counts[False]), max(counts.values()) / min(counts.values())
        more = train.filter(F.col("passed_human_filter") == rare).sample(True, ratio - 1, 17) if ratio > 1 else train.limit(0)
        width = len(decided.first()[self.vector])
        path = self.model_path(decided)
        if exists(self.workspace.spark, path):
            model = MultilayerPerceptronClassificationModel.load(path)
        else:
            model = MultilayerPerceptronClassifier(layers=[width, 128, 64, 32, 2], maxIter=self.epochs, blockSize=self.batch_size, seed=17).fit(train.unionByName(more).select("features", "label"))
            model.write().overwrite().save(path)
        hit = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
        if hit < self.min_accuracy:
            raise Abort(f"the filter is right in {hit:.1%} of held-out decisions; {self.min_accuracy:.1%} are asked for")
        return model

    def eval(self, dataset: DataFrame) -> DataFrame:
        if self.vector not in dataset.columns or not dataset.filter(F.col(self.vector).isNull()).isEmpty():
            raise Abort(f"SmartHumanFilter needs {self.vector} on all images")
        if dataset.count() < self.min_images:
            raise Abort(f"SmartHumanFilter needs {self.min_images} images")
        seen = self.attach(dataset, "passed_human_filter").drop("_cached")
        found = lookup(seen, self.workspace.memo.entries("smartfilter"), self.key(), self.domain, "boolean", "passed_smart_filter")
        todo = found.filter("passed_human_filter is null and not _cached").dropDuplicates(["objectid"])
        if not todo.isEmpty():
            scored = self.train(seen).transform(todo.withColumn("features", array_to_vector(F.col(self.vector).cast("array<double>"))))
            sure = scored.withColumn("_v", verdict(vector_to_array("probability")[1], self.min_confidence)).filter("_v is not null")
            self.workspace.memo.put(sure.select(self.key().alias("key"), F.lit(self.domain).alias("domain"), F.col("_v").cast("string").alias("value")))
            found = lookup(seen, self.workspace.memo.entries("smartfilter"), self.key(), self.domain, "boolean", "passed_smart_filter")
        found = found.drop("_cached")
        if self.when_uncertain == "human":
            self.demand(found.filter("passed_human_filter is null and passed_smart_filter is null"))
        return found.filter(combine(F.col("passed_human_filter"), F.col("passed_smart_filter"), self.when_uncertain))


__all__ = ["SmartHumanFilter", "combine", "confusion", "in_training", "keep_passed", "verdict"]
