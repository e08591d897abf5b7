"""Top-k, keep-first and the like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1.

    Spark cuts each task's rows to k a group before the shuffle (WindowGroupLimit),
    so a hot group sends k rows a task at most.
    """
    group = [group] if isinstance(group, str) else list(group)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return top_k(df, key, order, 1, "_first").drop("_first")


def last_of(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """(key, value with the greatest order): an aggregate, no sort."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def batch_ids(df: DataFrame, key: str, size: int, parts: int = 64) -> DataFrame:
    """Adds batch: rows in the order of a unique key, ``size`` to a batch.

    Rows are numbered in two steps, within ranges of the key and by the ranges' sizes
    (``parts`` rows), so no task sorts the whole table.
    """
    spread = df.repartitionByRange(parts, key).withColumn("_range", F.spark_partition_id())
    spread = spread.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    sizes = spread.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).drop("_n")
    return spread.join(starts, "_range").withColumn("batch", F.floor((F.col("_before") + F.col("_in") - 1) / size)).drop("_range", "_in", "_before")


def merge_intervals(df: DataFrame, key: str, begin: str = "begin", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of a key in one (key, begin, end)."""
    order = Window.partitionBy(key).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_new", F.when(F.col(begin) <= before, 0).otherwise(1))
    run = new.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return run.groupBy(key, "_run").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_run")


def sum_maps(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, entry, total): the maps of a key added entry by entry."""
    return df.select(key, F.explode(column).alias("entry", "v")).groupBy(key, "entry").agg(F.sum("v").alias("total"))


def islands(df: DataFrame, group: Sequence[str], order: str, label: str) -> DataFrame:
    """Adds island: a number for each maximal run of one label within a group."""
    w = Window.partitionBy(*group).orderBy(order)
    changed = F.when(F.col(label).eqNullSafe(F.lag(label).over(w)), 0).otherwise(1)
    return df.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_c")


def merge_lists(df: DataFrame, key: str, lists: str) -> DataFrame:
    """(key, lists): the arrays of a key in one, sorted."""
    return df.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(lists))).alias(lists))


def last_or_max(x: Column, k: int) -> Column:
    """Element k (from 0) of an array, or its last one; null for an empty array."""
    return F.when(F.size(x) > 0, F.element_at(x, F.least(F.lit(k + 1), F.size(x))))


def inner_product(x: DataFrame, weights: DataFrame, key: list[str], name: str = "feature", value: str = "value", weight: str = "weight") -> DataFrame:
    """(key, product) of rows (key, name, value) and (name, weight); names on one side only add nothing."""
    return x.join(weights.select(name, weight), name, "left").groupBy(*key).agg(F.sum(F.coalesce(F.col(value) * F.col(weight), F.lit(0))).alias("product"))
