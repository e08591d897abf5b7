"""The driver's tables seen as an entity-linking collection.

``documents`` stand for knowledge-base articles, ``benchmark`` for mentions,
``pages`` for the link graph. Each view is a lazy plan that reads only the
columns it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.plans import store

LINK = r'<a href="/([^"]*)">([^<]*)</a>'
#: Characters of a mention's text that mark an article as its true one. The tables name no true
#: entries, so the judgements are made up from texts; this prefix is their definition, no shortcut.
EVIDENCE = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kb_index(spark: SparkSession, sf_dir: str) -> store.Index:
    """The stored index of the articles."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "lang", "source", "text")
    return store.stored(spark, sf_dir, d, shape=articles)


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, title, lang, source, terms, len of the stored articles."""
    return kb_index(spark, sf_dir).articles


def articles(docs: DataFrame) -> DataFrame:
    """entity_id, title (first three words), lang, source, terms of (entity_id, lang, source, text)."""
    d = docs.select("entity_id", "lang", "source", text.tokens("text").alias("terms"))
    return d.select("entity_id", F.array_join(F.slice("terms", 1, 3), " ").alias("title"), "lang", "source", "terms")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mention_id, name (first three words), terms, full_text."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("mention_id"), text.tokens("text").alias("terms"), F.col("text").alias("full_text"))
    return d.select("mention_id", F.array_join(F.slice("terms", 1, 3), " ").alias("name"), "terms", "full_text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, entity_id): the article's text holds the first EVIDENCE characters of the mention's.

    Instead of trying every pair, three whole words from the middle of the evidence
    are looked up among the articles' word triples; what meets is verified. Stored once.
    """
    ix = kb_index(spark, sf_dir)
    return ix.keep("qrels", lambda: _qrels(spark, sf_dir, ix))


def _qrels(spark: SparkSession, sf_dir: str, ix: store.Index) -> DataFrame:
    m = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("mention_id"), F.left("text", F.lit(EVIDENCE)).alias("evidence"))
    w = F.split("evidence", " ")
    m = m.where(F.size(w) >= 5).select("mention_id", "evidence", *(w[i].alias(f"w{i}") for i in (1, 2, 3)))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity_id"), "text")
    # the shifted words side by side; a text's last two triples lack words and meet nothing
    words = d.select("entity_id", F.split("text", " ").alias("w1"))
    later = lambda i: F.slice("w1", F.lit(i), F.size("w1")).alias(f"w{i}")
    triples = words.select("entity_id", "w1", later(2), later(3)).select("entity_id", F.inline(F.arrays_zip("w1", "w2", "w3")).alias("w1", "w2", "w3"))
    # what meets is little and is written first, so that the texts needn't be shuffled to it
    met = ix.small(triples.join(m, ["w1", "w2", "w3"]).select("mention_id", "entity_id", "evidence").distinct())
    return met.join(d, "entity_id").where(F.contains("text", "evidence")).select("mention_id", "entity_id").distinct()


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, pos (from 0), dest (blanks to '_'), anchor: the links of pages, but for empty ones."""
    p = table(spark, sf_dir, "pages")
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("dest"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("anchor"))
    e = p.select("page_id", F.posexplode(pairs).alias("pos", "l"))
    return e.select("page_id", "pos", F.replace("l.dest", F.lit(" "), F.lit("_")).alias("dest"), F.replace("l.anchor", F.lit(","), F.lit("_")).alias("anchor")).where("dest <> '' and anchor <> ''")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, par (from 0), text: the paragraphs of pages, markup removed."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("par", "body"))
    return p.select("page_id", "par", F.regexp_replace("body", "<[^>]*>", "").alias("text"))


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id, a, b: each part's name and that of the part with the next key."""
    p = table(spark, sf_dir, "part")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.select("p_partkey", F.col("p_name").alias("a")).join(nxt, "p_partkey").withColumnRenamed("p_partkey", "part_id")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, brand), distinct: the brands that a customer has bought."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_brand").alias("brand"))
    return line.join(o, "k").join(part, "p").select("customer", "brand").distinct()
