"""TF-IDF and language-model similarities of listed pairs of texts.

Both sides come as term counts (id, term, tf). Pairs meet term by term, so the
work follows the texts of listed pairs and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def idf(docs: Column, df: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5))."""
    return F.log((docs - df + 0.5) / (df + 0.5))


def sides(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, term, m, e): counts of both sides of each pair over the union of their terms."""
    x = pairs.join(left.withColumnRenamed("tf", "m"), a).select(a, b, "term", "m", F.lit(0).cast("long").alias("e"))
    y = pairs.join(right.withColumnRenamed("tf", "e"), b).select(a, b, "term", F.lit(0).cast("long").alias("m"), "e")
    return x.unionByName(y).groupBy(a, b, "term").agg(F.sum("m").alias("m"), F.sum("e").alias("e"))


def tfidf(both: DataFrame, stats: DataFrame, a: str, b: str) -> DataFrame:
    """score, cosine_shared, tanimoto, cosine of each pair.

    ``stats``: (term, idf). The first three use shared terms only: score is the sum of
    idf*m*e; cosine_shared has a numerator without idf over norms with it; tanimoto is
    ip / (n1 + n2 - ip) without idf. ``cosine`` is the ordinary one over all terms.
    """
    j = both.join(stats, "term")
    m, e, w = F.col("m").cast("double"), F.col("e").cast("double"), F.col("idf")
    shared = (F.col("m") > 0) & (F.col("e") > 0)
    on = lambda x: F.sum(F.when(shared, x).otherwise(0.0))
    g = j.groupBy(a, b).agg(
        on(w * m * e).alias("score"), on(m * e).alias("ip"), on(w * m * w * m).alias("s1"), on(w * e * w * e).alias("s2"), on(m * m).alias("n1"), on(e * e).alias("n2"),
        F.sum(w * m * w * e).alias("wip"), F.sum(w * m * w * m).alias("w1"), F.sum(w * e * w * e).alias("w2"),
    )
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    return g.select(
        a, b, "score",
        ratio(F.col("ip"), F.sqrt("s1") * F.sqrt("s2")).alias("cosine_shared"),
        F.when(F.col("ip") == 0, 0.0).otherwise(F.col("ip") / (F.col("n1") + F.col("n2") - F.col("ip"))).alias("tanimoto"),
        ratio(F.col("wip"), F.sqrt("w1") * F.sqrt("w2")).alias("cosine"),
    )


def divergences(both: DataFrame, background: DataFrame, tokens: float, a: str, b: str, mu: float = 2000.0, most: float = 100.0) -> DataFrame:
    """kl, js, jaccard, cosine of the language models of each pair, the divergences at most ``most``.

    kl: of the left model from the right one, smoothed with ``mu`` of the background
    (term, cf); a term that the background lacks counts once there. js: of the plain
    models. ``tokens``: length of the background.
    """
    lens = both.groupBy(a, b).agg(F.sum("m").alias("lm"), F.sum("e").alias("le"))
    j = both.join(background, "term", "left").join(lens, [a, b])
    p = F.col("m") / F.col("lm")
    q = F.when(F.col("le") > 0, F.col("e") / F.col("le")).otherwise(0.0)
    smooth = (F.col("e") + mu * F.coalesce("cf", F.lit(1)) / tokens) / (F.col("le") + mu)
    mid = (p + q) / 2
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    g = j.groupBy(a, b).agg(
        F.sum(part(p, smooth)).alias("kl"),
        F.sum(part(p, mid) / 2 + part(q, mid) / 2).alias("js"),
        F.sum(F.when((F.col("m") > 0) & (F.col("e") > 0), 1).otherwise(0)).alias("i"),
        F.count("*").alias("u"),
        *(F.sum(x.cast("double") * y).alias(n) for n, x, y in (("me", F.col("m"), F.col("e")), ("mm", F.col("m"), F.col("m")), ("ee", F.col("e"), F.col("e")))),
    )
    cosine = F.when(F.col("mm") * F.col("ee") == 0, 0.0).otherwise(F.col("me") / (F.sqrt("mm") * F.sqrt("ee")))
    return g.select(a, b, F.least("kl", F.lit(most)).alias("kl"), F.least("js", F.lit(most)).alias("js"), (F.col("i") / F.col("u")).alias("jaccard"), cosine.alias("cosine"))
