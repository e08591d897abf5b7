"""Accuracy, average precision, rank distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linking_accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: accuracy on all mentions, on those with and without an entry, and of the decision alone.

    ``gold``: (mention_id, entries array, empty for none); ``predicted``: (mention_id,
    entity_id, null for none). A mention without a prediction is wrong, but counts as
    none for the decision.
    """
    j = gold.join(predicted.select("mention_id", "entity_id", F.lit(True).alias("given")), "mention_id", "left")
    none = F.size("entries") == 0
    right = F.coalesce(F.when(none, F.col("given") & F.col("entity_id").isNull()).otherwise(F.array_contains("entries", F.col("entity_id"))), F.lit(False)).cast("double")
    decision = (none == F.col("entity_id").isNull()).cast("double")
    return j.agg(F.count("*").alias("n"), F.avg(right).alias("acc_all"), F.avg(F.when(~none, right)).alias("acc_linked"), F.avg(F.when(none, right)).alias("acc_nil"), F.avg(decision).alias("acc_decision"))


def average_precision(run: DataFrame, qrels: DataFrame, key: str = "entity_id") -> DataFrame:
    """(mention_id, ap, p1) of mentions with relevant entries; those not retrieved count in the denominator."""
    total = qrels.groupBy("mention_id").agg(F.count("*").alias("relevant"))
    hits = run.join(qrels.withColumn("hit", F.lit(1)), ["mention_id", key], "left").fillna(0, ["hit"])
    so_far = F.sum("hit").over(Window.partitionBy("mention_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    points = hits.withColumn("precision", so_far / F.col("rank")).groupBy("mention_id").agg(F.sum(F.col("precision") * F.col("hit")).alias("s"), F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("first"))
    return total.join(points, "mention_id", "left").select("mention_id", (F.coalesce("s", F.lit(0.0)) / F.col("relevant")).alias("ap"), F.coalesce("first", F.lit(0)).cast("double").alias("p1"))


def answer_ranks(mentions: DataFrame, run: DataFrame, qrels: DataFrame, key: str = "entity_id") -> DataFrame:
    """(mention_id, rank1, idx0): place of the first true entry, from 1 and from 0; -1 where there is none."""
    best = run.join(qrels, ["mention_id", key]).groupBy("mention_id").agg(F.min("rank").alias("rank1"))
    return mentions.select("mention_id").join(best, "mention_id", "left").select("mention_id", F.coalesce("rank1", F.lit(-1)).cast("long").alias("rank1"), F.coalesce(F.col("rank1") - 1, F.lit(-1)).cast("long").alias("idx0"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share): no second pass over the rows."""
    g = df.groupBy(column).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def paired_t(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, mean difference, t of the paired test; null with fewer than two pairs or no spread."""
    g = pairs.agg(F.count("*").alias("n"), F.avg(F.col(a) - F.col(b)).alias("mean_diff"), F.stddev_samp(F.col(a) - F.col(b)).alias("sd"))
    return g.select("n", "mean_diff", F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def predictions(mentions: DataFrame, run: DataFrame, ids: DataFrame, key: str = "entity_id") -> DataFrame:
    """(mention_id, kb_id): the best result's first id by an id map (key, ids comma-separated); null without results or ids."""
    best = run.where("rank = 1").join(ids, key, "left").select("mention_id", F.nullif(F.split("ids", ",")[0], F.lit("")).alias("kb_id"))
    return mentions.select("mention_id").join(best, "mention_id", "left")
