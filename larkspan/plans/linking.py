"""Whole linking flows: mentions to decisions, each one lazy plan.

``link`` retrieves, extracts features, re-ranks and applies the NIL threshold.
``second_pass`` adds evidence from the first pass's links of neighbouring mentions.
``reverse`` goes from an entry to the documents about it. Tables come as DataFrames
of the shapes in ``views.py``, so any source serves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text
from larkspan.operators import index, nil, rank, retrieve

NAME_FEATURES = ("char_dice", "word_dice", "exact", "first_letter", "suffix")


def candidates(mentions: DataFrame, kb: DataFrame, k: int = 10, mu: float = 2000.0) -> DataFrame:
    """(mention_id, entity_id, score, rank) by the mention's name."""
    q = retrieve.query(mentions, F.slice("terms", 1, 3))
    post = index.postings(kb, only=q)
    tokens = float(index.collection_stats(kb).first()["tokens"] or 0)
    return retrieve.best(retrieve.dirichlet(q, post, index.term_stats(post), index.lengths(kb), tokens, mu), k)


def with_features(run: DataFrame, mentions: DataFrame, kb: DataFrame) -> DataFrame:
    """A run with titles and name features. Article texts don't take part in the join."""
    r = run.join(mentions.select("mention_id", "name"), "mention_id").join(kb.select("entity_id", "title"), "entity_id")
    a, b = F.col("name"), F.col("title")
    return r.withColumns(
        {
            "char_dice": text.dice(text.chars(a), text.chars(b)),
            "word_dice": text.dice(text.words(a), text.words(b)),
            "exact": text.exact_match(a, b),
            "first_letter": text.first_letter_match(a, b),
            "suffix": text.suffix_of(a, F.right(b, F.lit(2))),
        }
    )


def link(mentions: DataFrame, kb: DataFrame, model: rank.Ensemble | None = None, threshold: float = -10.0, k: int = 10) -> DataFrame:
    """(mention_id, entity_id, title, score): the best entry of each mention, null below the threshold, and null for mentions without candidates."""
    run = with_features(candidates(mentions, kb, k), mentions, kb)
    if model is None:
        best = run.where("rank = 1").select("mention_id", "entity_id", "title", "score")
    else:
        ranked = rank.rerank(rank.assemble(run, NAME_FEATURES), model.column())
        best = ranked.where("rank = 1").select("mention_id", "entity_id", "title", F.col("model_score").alias("score"))
    return mentions.select("mention_id").join(nil.threshold(best, threshold), "mention_id", "left")


def second_pass(run: DataFrame, first: DataFrame, pairs: DataFrame, overlap: DataFrame, score: Column) -> DataFrame:
    """Re-ranks a run with its entries' best overlap with first-pass links of neighbouring mentions.

    ``pairs``: (mention_id, neighbor); ``overlap``: (a, b, value) of entries; ``score``: of
    the columns score and evidence.
    """
    near = pairs.join(first.where("entity_id is not null").select(F.col("mention_id").alias("neighbor"), F.col("entity_id").alias("b")), "neighbor")
    evidence = run.select("mention_id", F.col("entity_id").alias("a")).join(near, "mention_id").join(overlap, ["a", "b"]).groupBy("mention_id", F.col("a").alias("entity_id")).agg(F.max("value").alias("evidence"))
    return rank.rerank(run.join(evidence, ["mention_id", "entity_id"], "left").fillna(0.0, ["evidence"]), score)


def reverse(entries: DataFrame, docs: DataFrame, k: int = 10, mu: float = 2000.0) -> DataFrame:
    """(mention_id, entity_id, score, rank): the k best documents of each entry, asked by its weighted names.

    ``entries``: (mention_id, names array<struct<name, weight>>).
    """
    n = entries.select("mention_id", F.explode("names").alias("n")).select("mention_id", "n.weight", text.tokens("n.name").alias("t"))
    q = n.select("mention_id", (F.col("weight") / F.size("t")).alias("w"), F.explode("t").alias("term")).groupBy("mention_id", "term").agg(F.sum("w").alias("weight"))
    post = index.postings(docs, only=q)
    tokens = float(index.collection_stats(docs).first()["tokens"] or 0)
    return retrieve.best(retrieve.dirichlet(q, post, index.term_stats(post), index.lengths(docs), tokens, mu), k)
