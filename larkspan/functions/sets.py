"""Overlap measures of two sets, from their sizes n1, n2 and the size i of their intersection.

Taking sizes rather than arrays, they serve array columns (``of_arrays``) and sets
that are rows alike (``of_rows``: one equi-join on the element, no giant arrays).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(i: Column, n1: Column, n2: Column) -> Column:
    return n1 - i + n2 - i


def approximate_pmi(i: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(1000.0 * i / (n1.cast("double") * n2))


def pmi(i: Column, n1: Column, n2: Column, total: Column) -> Column:
    """A ratio, without logarithm."""
    return F.when((n1 == 0) | (n2 == 0), 0.0).otherwise((i / total) / ((n1 / total) * (n2 / total)))


def dice(i: Column, n1: Column, n2: Column) -> Column:
    return F.when(n1 + n2 == 0, 0.0).otherwise(2.0 * i / (n1 + n2))


def jaccard(i: Column, n1: Column, n2: Column) -> Column:
    return F.when(n1 + n2 - i == 0, 0.0).otherwise(i / (n1 + n2 - i))


def google_similarity(i: Column, n1: Column, n2: Column, total: Column) -> Column:
    """1 - normalised Google distance; 0 if a size is 0 or the smaller set holds everything."""
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    below = F.log(total) - F.log(low)
    return F.when((n1 == 0) | (n2 == 0) | (i == 0) | (below == 0), 0.0).otherwise(1 - (F.log(high) - F.log(i)) / below)


def cosine(i: Column, n1: Column, n2: Column) -> Column:
    return F.when((n1 == 0) | (n2 == 0) | (i == 0), 0.0).otherwise(i / F.sqrt(n1.cast("double") * n2))


def measures(i: Column, n1: Column, n2: Column, total: Column | None = None) -> dict[str, Column]:
    """All measures by name; those that need a universe only with ``total``."""
    out = {"intersect": i.cast("long"), "missing": missing(i, n1, n2).cast("long"), "approx_pmi": approximate_pmi(i, n1, n2), "dice": dice(i, n1, n2), "jaccard": jaccard(i, n1, n2), "cosine": cosine(i, n1, n2)}
    if total is not None:
        out |= {"pmi": pmi(i, n1, n2, total), "google": google_similarity(i, n1, n2, total)}
    return out


def of_arrays(a: Column, b: Column, total: Column | None = None) -> dict[str, Column]:
    """``measures`` of two arrays of distinct elements."""
    return measures(F.size(F.array_intersect(a, b)), F.size(a), F.size(b), total)


def of_rows(sets: DataFrame, pairs: DataFrame, key: str, element: str, a: str, b: str) -> DataFrame:
    """``pairs`` with i, n1, n2 of the sets of ``a`` and ``b``; ``sets`` holds distinct (key, element) rows.

    Sizes come from one aggregation; the intersection from joining the pairs' left
    elements with the right ones, so only elements of listed pairs meet.
    """
    sizes = sets.groupBy(key).agg(F.count("*").alias("_n"))
    left = pairs.join(sets.withColumnsRenamed({key: a, element: "_e"}), a)
    both = left.join(sets.withColumnsRenamed({key: b, element: "_e"}), [b, "_e"]).groupBy(a, b).agg(F.count("*").alias("i"))
    out = pairs.join(both, [a, b], "left")
    for side, name in ((a, "n1"), (b, "n2")):
        out = out.join(sizes.withColumnsRenamed({key: side, "_n": name}), side, "left")
    return out.fillna(0, ["i", "n1", "n2"])
