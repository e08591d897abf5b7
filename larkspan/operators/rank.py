"""Feature vectors, tree ensembles, re-ranking, splits."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.logs import sound
from larkspan.operators.evaluate import average_precision
from larkspan.operators.ranking import batch_ids, top_k


def domain(features: DataFrame, name: str = "feature") -> dict[str, int]:
    """Feature names to dense ids from 0, in order of name. Names follow the code, not the data."""
    return {r[0]: i for i, r in enumerate(features.select(name).distinct().orderBy(name).collect())}


def domain_rows(features: DataFrame, name: str = "feature") -> DataFrame:
    """(name, id): the same as a table, numbered in two steps and never collected."""
    return batch_ids(features.select(name).distinct(), name, 1).withColumnRenamed("batch", "id")


def stored(features: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stored features (mention_id, candidates: array of structs) of the asked mentions, a row each candidate; what was never stored is absent."""
    return features.join(mentions.select("mention_id").distinct(), "mention_id", "left_semi").select("mention_id", F.explode("candidates").alias("c")).select("mention_id", "c.*")


def train(rows: DataFrame, vector: str = "vector", label: str = "label", seed: int = 42, trees: int = 20):
    """Pointwise gradient-boosted trees on four fifths of the mentions, chosen by their id; returns the model and its MAP on the others.

    ``rows``: (mention_id, entity_id, vector, label); a mention's rows stay on one side.
    """
    ready = rows.withColumn("_v", array_to_vector(F.col(vector))).withColumn("_side", F.pmod(F.xxhash64(F.lit(seed), "mention_id"), F.lit(5)))
    model = GBTRegressor(featuresCol="_v", labelCol=label, maxIter=trees, maxDepth=4, seed=seed, predictionCol="prediction").fit(ready.where("_side > 0"))
    judged = model.transform(ready.where("_side = 0"))
    run = top_k(judged, "mention_id", [F.desc("prediction"), F.asc("entity_id")], 2**31 - 1).select("mention_id", "entity_id", "rank")
    true = judged.where(F.col(label) > 0).select("mention_id", "entity_id")
    return model, average_precision(run, true).agg(F.avg("ap")).first()[0]


def assemble(df: DataFrame, names: Sequence[str], rank: str = "rank", score: str = "score") -> DataFrame:
    """Adds vector: the named columns (null: 0), then 1 / (rank + 1) and the score. NaN or infinity is an error."""
    cells = [F.coalesce(sound(F.col(n).cast("double")), F.lit(0.0)) for n in names]
    return df.withColumn("vector", F.array(*cells, 1.0 / (F.col(rank) + 1.0), F.col(score)))


def binary_names(name: Column, value: Column) -> Column:
    """The one-hot name of a feature's value; NaN or infinity is an error."""
    return F.concat_ws("=", name, sound(value.cast("double")).cast("string"))


def svm_line(target: Column, query: Column, vector: Column, comment: Column, digits: int = 6) -> Column:
    """``target qid:query 1:v ... # comment``."""
    cells = F.transform(vector, lambda v, i: F.concat((i + 1).cast("string"), F.lit(":"), F.format_string(f"%.{digits}f", v)))
    return F.concat_ws(" ", target.cast("string"), F.concat(F.lit("qid:"), query.cast("string")), F.array_join(cells, " "), F.lit("#"), comment)


class Ensemble:
    """Regression trees as flat arrays: feature (from 1; 0 for a leaf), threshold, left, right, output."""

    def __init__(self, trees: list[tuple[float, list[tuple[int, float, int, int, float]]]]) -> None:
        self.trees = [(w, *(np.array(c) for c in zip(*nodes, strict=True))) for w, nodes in trees]

    @staticmethod
    def read(path: str) -> Ensemble:
        """From XML: ensemble / tree[@weight] / split, with ``feature`` and ``threshold`` and two splits, or ``output``."""
        trees = []
        for tree in ET.parse(path).getroot().iter("tree"):
            nodes: list = []

            def add(split, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append(None)
                out = split.find("output")
                if out is not None:
                    nodes[at] = (0, 0.0, at, at, float(out.text))
                else:
                    sides = {s.get("pos"): s for s in split.findall("split")}
                    nodes[at] = (int(split.find("feature").text), float(split.find("threshold").text), add(sides["left"]), add(sides["right"]), 0.0)
                return at

            add(tree.find("split"))
            trees.append((float(tree.get("weight", "1")), nodes))
        return Ensemble(trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Left if the value is at most the threshold; both are compared as 32-bit floats."""
        x = x.astype(np.float32)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for w, feature, threshold, left, right, output in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            cut = threshold.astype(np.float32)
            while (feature[at] > 0).any():
                f = feature[at]
                at = np.where(f == 0, at, np.where(x[rows, np.maximum(f - 1, 0)] <= cut[at], left[at], right[at]))
            total += w * output[at]
        return total

    def column(self, vector: str = "vector") -> Column:
        """The score of a vector column, by Arrow batches; the model goes with the function."""
        model = self

        @F.pandas_udf("double")
        def run(v: pd.Series) -> pd.Series:
            return pd.Series(model.score(np.stack(v.to_numpy())) if len(v) else [], dtype="float64")

        return run(F.col(vector))

    def expression(self, vector: str = "vector") -> Column:
        """The same as nested conditions, for small models: it stays in generated code."""

        def node(tree, at: int) -> Column:
            _, feature, threshold, left, right, output = tree
            if feature[at] == 0:
                return F.lit(float(output[at]))
            return F.when(F.col(vector)[int(feature[at]) - 1].cast("float") <= F.lit(float(threshold[at])).cast("float"), node(tree, int(left[at]))).otherwise(node(tree, int(right[at])))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + F.lit(float(t[0])) * node(t, 0)
        return total


def rerank(df: DataFrame, score: Column, group: str = "mention_id", rank: str = "rank") -> DataFrame:
    """Ranks anew by score, ties by the old rank; the old one is kept as ``old_rank``."""
    scored = df.withColumnRenamed(rank, "old_rank").withColumn("model_score", F.round(score, 6))
    return top_k(scored, group, [F.desc("model_score"), F.asc("old_rank")], 2**31 - 1, rank)


def numeric_id(mention: Column) -> Column:
    """The number in a mention's id."""
    return F.regexp_replace(mention.cast("string"), "[^0-9]", "").cast("long")


def odd_even(df: DataFrame, mention: str = "mention_id") -> DataFrame:
    """Adds split: train for odd ids, test for even ones."""
    return df.withColumn("split", F.when(numeric_id(F.col(mention)) % 2 == 1, "train").otherwise("test"))
