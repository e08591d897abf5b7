"""Names and neighbours of entries from the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators.ranking import top_k


def name_counts(fields: DataFrame) -> DataFrame:
    """(entity, field, value, n) from (entity, field, value)."""
    return fields.groupBy("entity", "field", "value").agg(F.count("*").alias("n"))


def name_probability(counts: DataFrame) -> DataFrame:
    """Adds total (of the value in its field, all entities) and p = n / (total + 0.5); 1 where that exceeds it."""
    total = counts.groupBy("field", "value").agg(F.sum("n").alias("total"))
    over = F.col("total") + 0.5
    return counts.join(total, ["field", "value"]).withColumn("p", F.when(over <= F.col("n"), 1.0).otherwise(F.col("n") / over))


def weighted_names(counts: DataFrame, weights: dict[str, float], k: int = 10) -> DataFrame:
    """(entity, value, weight, rank): probabilities weighted by field and summed over normalised values, the k best."""
    by_field = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    p = name_probability(counts).withColumn("value", text.normalize("value")).where("value <> ''")
    summed = p.groupBy("entity", "value").agg(F.round(F.sum(F.col("p") * by_field[F.col("field")]), 6).alias("weight"))
    return top_k(summed, "entity", [F.desc("weight"), F.asc("value")], k)


def alternative_names(fields: DataFrame, titles: DataFrame) -> DataFrame:
    """(entity, value), distinct: values that aren't empty and not contained in the entity's title."""
    v = fields.withColumn("value", text.normalize("value")).select("entity", "value").distinct()
    return v.join(titles, "entity").where((F.col("value") != "") & ~F.contains(F.col("title"), F.col("value"))).select("entity", "value")


def shared_sources(links: DataFrame) -> DataFrame:
    """(entity, dest, shared) of the pairs of distinct links (entity, dest): how many others link to both; pairs without any aren't listed.

    Each pair meets the sources of its entity; a source that links to the pair's other end
    too is one more.
    """
    pairs = links.select("entity", "dest")
    of_entity = pairs.join(pairs.select(F.col("dest").alias("entity"), F.col("entity").alias("source")), "entity")
    both = of_entity.join(pairs.select(F.col("entity").alias("source"), "dest"), ["source", "dest"])
    return both.groupBy("entity", "dest").agg(F.count("*").cast("double").alias("shared"))


def passage_counts(links: DataFrame, paragraphs: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, dest, links, passages): links to each destination, and paragraphs that hold an anchor of one.

    ``links``: (key, dest, anchor); ``paragraphs``: (key, par, text). Both meet by page.
    """
    counts = links.groupBy(key, "dest").agg(F.count("*").alias("links"))
    held = paragraphs.join(links.select(key, "dest", "anchor").distinct(), key).where(F.contains("text", F.col("anchor"))).groupBy(key, "dest").agg(F.count_distinct("par").alias("passages"))
    return counts.join(held, [key, "dest"], "left").fillna(0, ["passages"])


def external_names(counts: DataFrame, k: int = 100, least: int = 3) -> DataFrame:
    """(entity, value, weight) of (entity, value, p): no spam, the k best, normalised, longer than ``least``, duplicates summed."""
    kept = top_k(counts.where(~text.spam_anchor(F.col("value"))), "entity", [F.desc("p"), F.asc("value")], k)
    return kept.withColumn("value", text.normalize("value")).where(F.length("value") > least).groupBy("entity", "value").agg(F.sum("p").alias("weight"))


def link_sets(links: DataFrame) -> DataFrame:
    """(kind, k, e), distinct: the out-, in- and all link partners of each entity of (entity, dest)."""
    out = links.select(F.lit("out").alias("kind"), F.col("entity").alias("k"), F.col("dest").alias("e"))
    into = links.select(F.lit("in").alias("kind"), F.col("dest").alias("k"), F.col("entity").alias("e"))
    both = out.unionByName(into)
    return both.unionByName(both.withColumn("kind", F.lit("all"))).distinct()


def neighbors(links: DataFrame, near: int = 10, k: int = 10, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> DataFrame:
    """(entity, dest, score, rank): the k best neighbours of each entity.

    ``links``: (entity, dest, pos). Four features, each divided by its sum over the
    entity's neighbours (0 where that is 0): place (1 near the top, else 0.1), number
    of links, whether the neighbour links back, and how many entities link to both. For
    the last, links meet on their source, but only those whose ends are a listed pair.
    """
    own = links.where("dest <> entity").groupBy("entity", "dest").agg(F.max(F.when(F.col("pos") < near, 1.0).otherwise(0.1)).alias("place"), F.count("*").cast("double").alias("anchors"))
    back = own.select(F.col("dest").alias("entity"), F.col("entity").alias("dest"), F.lit(1.0).alias("back"))
    f = own.join(back, ["entity", "dest"], "left").join(shared_sources(own), ["entity", "dest"], "left").fillna(0.0, ["back", "shared"])
    w = Window.partitionBy("entity")
    score = F.lit(0.0)
    for name, weight in zip(("place", "anchors", "back", "shared"), weights, strict=True):
        total = F.sum(name).over(w)
        score = score + weight * F.when(total == 0, 0.0).otherwise(F.col(name) / total)
    return top_k(f.select("entity", "dest", F.round(score, 6).alias("score")), "entity", [F.desc("score"), F.asc("dest")], k)


def popularity(links: DataFrame) -> DataFrame:
    """(dest, inlinks, log_inlinks = ln(max(1, inlinks)))."""
    g = links.groupBy("dest").agg(F.count("*").alias("inlinks"))
    return g.withColumn("log_inlinks", F.log(F.greatest(F.lit(1), F.col("inlinks")).cast("double")))


def link_probability(links: DataFrame) -> DataFrame:
    """(dest, anchor, n, total, link_prob): n / (total + 0.5) of an exact anchor; if that sum is below n, n / inlinks."""
    n = links.groupBy("dest", "anchor").agg(F.count("*").alias("n"))
    total = n.groupBy("anchor").agg(F.sum("n").alias("total"))
    joined = n.join(total, "anchor").join(popularity(links), "dest")
    over = F.col("total") + 0.5
    return joined.select("dest", "anchor", "n", "total", F.when(F.col("anchor") == "", 0.0).when(over < F.col("n"), F.col("n") / F.greatest(F.lit(1), F.col("inlinks"))).otherwise(F.col("n") / over).alias("link_prob"))


def mask(pos: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """(key, pos, new_pos, term): the words within an entity's windows, numbered anew.

    ``windows``: (key, begin, end), half-open; overlapping ones count once.
    """
    inside = pos.join(windows, [key]).where("pos >= begin and pos < end").select(key, "pos", "term").distinct()
    return inside.withColumn("new_pos", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long"))


def clip(tags: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Tags (key, name, first, last) cut to an entity's windows (key, begin, end), half-open; what lies outside goes."""
    j = tags.join(windows, key).where("last >= begin and first < end")
    return j.select(key, "name", F.greatest("first", "begin").alias("first"), F.least("last", F.col("end") - 1).alias("last"))


def neighborhood(links: DataFrame) -> DataFrame:
    """(entity, dest, out, in, shared) of linked pairs, self links and ignored titles apart: whether the pair is linked either way, and by how many others to both."""
    own = links.where((F.col("dest") != F.col("entity")) & ~text.ignored_title(F.col("dest")) & ~text.ignored_title(F.col("entity"))).select("entity", "dest").distinct()
    back = own.select(F.col("dest").alias("entity"), F.col("entity").alias("dest"))
    both = own.withColumns({"out": F.lit(1), "in": F.lit(0)}).unionByName(back.withColumns({"out": F.lit(0), "in": F.lit(1)})).groupBy("entity", "dest").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    return both.join(shared_sources(own).withColumn("shared", F.col("shared").cast("long")), ["entity", "dest"], "left").fillna(0, ["shared"])
