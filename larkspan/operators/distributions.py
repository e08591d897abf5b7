"""Probability distributions as rows (group, elem, p)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.ranking import top_k


def normalise(df: DataFrame, group: str, p: str = "p") -> DataFrame:
    """p divided by the group's sum; 0 where that is 0."""
    total = F.sum(p).over(Window.partitionBy(group))
    return df.withColumn(p, F.when(total == 0, 0.0).otherwise(F.col(p) / total))


def mix(parts: DataFrame, weights: DataFrame, source: str, elem: str, p: str = "p", weight: str = "weight") -> DataFrame:
    """(elem, p): sum over sources of normalised weight times p. ``weights``: (source, weight)."""
    total = weights.agg(F.sum(weight)).first()[0] or 1.0
    return parts.join(weights, source).groupBy(elem).agg(F.sum(F.col(p) * F.col(weight) / F.lit(float(total))).alias(p))


def argmax(df: DataFrame, group: str, elem: str, p: str = "p", zero: str | None = None) -> DataFrame:
    """(group, best, mean, marginal, size): ``zero`` stands for the implicit entries of weight 0 and wins over negative ones."""
    best = F.max_by(elem, F.struct(F.col(p), F.expr(f"struct(-hash({elem}))"))) if zero is None else F.when(F.max(p) < 0, F.lit(zero)).otherwise(F.max_by(elem, F.col(p)))
    return df.groupBy(group).agg(best.alias("best"), F.avg(p).alias("mean"), F.sum(p).alias("marginal"), F.count("*").alias("size"))


def draw(df: DataFrame, group: str, elem: str, r: Column, p: str = "p") -> DataFrame:
    """(group, elem): the first element, in order, whose cumulative sum exceeds ``r``; the last one at the boundary."""
    order = Window.partitionBy(group).orderBy(elem)
    run = df.withColumn("_sum", F.sum(p).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(group).agg(F.coalesce(F.min(F.when(F.round(F.col("_sum"), 9) > r, F.col(elem))), F.max(elem)).alias(elem))


def expected_counts(df: DataFrame, p: str, draw: Column) -> DataFrame:
    """Adds expected: the whole part of p, and one more where ``draw`` is below its fraction."""
    whole = F.floor(p)
    return df.withColumn("expected", whole + F.when(draw < F.col(p) - whole, 1).otherwise(0))


def check(df: DataFrame, group: str, elem: str) -> DataFrame:
    """``df``, or an error if a group lists an element twice."""
    n = F.count("*").over(Window.partitionBy(group, elem))
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("an element is listed twice")).cast("boolean")).otherwise(True)).drop("_n")


def with_universe(df: DataFrame, universe: DataFrame, groups: DataFrame, group: str, elem: str, unseen: float = 0.0, p: str = "p") -> DataFrame:
    """(group, elem, p) over every element of ``universe`` (elem) for each of ``groups`` (group); duplicate keys are summed, unseen ones get ``unseen``.

    The universe is a bounded list of elements; it goes with each group as one array.
    """
    known = df.groupBy(group, elem).agg(F.sum(p).alias(p))
    elems = universe.select(elem).distinct().agg(F.collect_list(elem).alias("_all"))
    every = groups.select(group).distinct().join(elems, F.lit(True), "left").select(group, F.explode("_all").alias(elem))
    return every.join(known, [group, elem], "left").fillna(unseen, [p])


def top_k_filled(df: DataFrame, universe: DataFrame, groups: DataFrame, group: str, elem: str, k: int, p: str = "p") -> DataFrame:
    """(group, elem, p, rank): the k greatest of each group; elements without weight fill up what is left."""
    return top_k(with_universe(df, universe, groups, group, elem, 0.0, p), group, [F.desc(F.round(p, 9)), F.asc(elem)], k)


def logarithm(p: Column) -> Column:
    """ln p; null for 0."""
    return F.when(p > 0, F.log(p))
