"""The ensemble as a forest of trees, learned from labelled documents.

A document's vector has four numbers of each metric, metrics by name: its three
probabilities and its confidence; a failed metric counts as undecided without
confidence. Without labels of both classes there is no model, and the calibrated
ensemble's probability stands."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

NAMES = sorted(fixed.METRICS)


def vector(p: Column) -> Column:
    """The numbers of an array of judged metrics."""

    def four(name: str) -> list[Column]:
        m = F.get(F.filter(p, lambda x: (x["metric"] == name) & x["error"].isNull()), F.lit(0))
        return [F.coalesce(m[k], F.lit(d)) for k, d in (("ai", 0.5), ("human", 0.5), ("mixed", 0.0), ("confidence", 0.0))]

    return array_to_vector(F.array(*[c for n in NAMES for c in four(n)]))


def fit(judged: DataFrame, labels: DataFrame, trees: int = 50, depth: int = 6, seed: int = 7) -> RandomForestClassificationModel | None:
    """A forest of judged rows (doc_id, p) with labels (doc_id, y: 1 for generated), or
    None where one of the classes is missing. Rows are put in order first, so that
    reruns draw the same samples."""
    rows = judged.join(labels.where("y is not null").select("doc_id", F.col("y").cast("double").alias("label")), "doc_id")
    rows = rows.select("label", vector(F.col("p")).alias("features"), F.xxhash64("doc_id").alias("h"), "doc_id")
    if rows.agg(F.count_distinct("label")).first()[0] != 2:
        return None
    parts = int(judged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "h").sortWithinPartitions("h", "doc_id", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(rows)


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def score(judged: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """doc_id, ai_probability, human_probability, method of judged rows (doc_id, p, verdict)."""
    if model is None:
        return judged.select("doc_id", F.col("verdict.ai_probability").alias("ai_probability"), F.col("verdict.human_probability").alias("human_probability"), F.lit("confidence_calibrated").alias("method"))
    out = model.transform(judged.select("doc_id", vector(F.col("p")).alias("features")))
    ai = F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)
    return out.select("doc_id", ai.alias("ai_probability"), F.round(1 - ai, 6).alias("human_probability"), F.lit("ml_ensemble").alias("method"))
