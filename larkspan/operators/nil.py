"""Mentions without an entry: thresholds, sweeps, clusters, a classifier."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.ranking import batch_ids

#: Thresholds of the sweep, in natural order.
SWEEP = (-14.0, -12.0, -11.5, -11.0, -10.5, -10.0)


def threshold(predictions: DataFrame, t) -> DataFrame:
    """Below ``t`` the entity becomes null, and so does its title."""
    below = F.col("score") < t
    return predictions.withColumns({"entity_id": F.when(~below, F.col("entity_id")), "title": F.when(~below, F.col("title"))})


def sweep(predictions: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """All predictions under each threshold, in a column ``threshold``: one explode, no join."""
    each = predictions.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return threshold(each, F.col("threshold"))


def cluster_ids(df: DataFrame, key: str, order: str, group: str | None = None) -> DataFrame:
    """Adds nil_id: NIL0001 and on, by the first appearance of a key, anew in each group.

    Keys are numbered within ranges of their first appearance and by the ranges' sizes,
    so no task sorts them all; a group's own keys are numbered together.
    """
    on = [group, key] if group else [key]
    first = df.groupBy(*on).agg(F.min(order).alias("_first"))
    if group:
        numbered = first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_first", key)))
    else:
        numbered = batch_ids(first.withColumn("_at", F.struct("_first", key)), "_at", 1).select(key, "_first", (F.col("batch") + 1).alias("_n"))
    return df.join(numbered.withColumn("nil_id", F.format_string("NIL%04d", "_n")).drop("_first", "_n"), on)


def wiki_only(predictions: DataFrame, nil: str = "NIL") -> DataFrame:
    """An id that begins with ``nil`` becomes null; the title stays, and no score is looked at."""
    return predictions.withColumn("kb_id", F.when(~F.startswith("kb_id", F.lit(nil)), F.col("kb_id")))


def classifier(train: DataFrame, features: list[str], label: str, variance: float = 1.0):
    """Logistic regression with a Gaussian prior over standardised features; a fitted pipeline's transform."""
    gather = VectorAssembler(inputCols=features, outputCol="_raw")
    scaler = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True).fit(gather.transform(train))
    ready = scaler.transform(gather.transform(train)).cache()
    rows = max(1, ready.count())
    model = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (variance * rows), elasticNetParam=0.0, maxIter=50, probabilityCol="probability", predictionCol="prediction").fit(ready)
    ready.unpersist()
    return lambda df: model.transform(scaler.transform(gather.transform(df))).drop("_raw", "_features", "rawPrediction")
