"""What stands around a mention: names, sentences, neighbours."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larkspan.functions import text
from larkspan.functions.text import STOP_WORDS
from larkspan.operators.ranking import islands, top_k

_STOP = frozenset(STOP_WORDS)


def fallback_names(df: DataFrame, key: str, body: str, longest: int = 6) -> DataFrame:
    """Fallback recogniser: (key, name, begin, end) of runs of capitalised words, common words allowed inside, in one sentence.

    A run is trimmed to begin and end with a capitalised word that is no stop word and
    has at most ``longest`` words; words of one sign are passed over. Runs are islands of
    the words of a sentence.
    """
    by = [key, "sentence"]
    s = df.select(key, F.posexplode(F.split(body, r"\.", -1)).alias("sentence", "piece"))
    size = F.length("piece") + 1
    s = s.withColumn("base", F.sum(size).over(Window.partitionBy(key).orderBy("sentence").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size)
    common = text.is_stop(F.lower("token"))
    t = token_offsets(s, by, "piece").withColumns({"proper": F.col("token").rlike(r"^\p{Lu}") & ~common, "pos": F.row_number().over(Window.partitionBy(*by).orderBy("begin"))})
    inside = t.where(F.col("proper") | common)
    run = inside.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    at = lambda x: F.when(F.col("proper"), x)
    ends = run.groupBy(*by, "run").agg(F.min(at(F.col("begin"))).alias("a"), F.max(at(F.col("begin") + F.length("token"))).alias("b"), (F.max(at(F.col("pos"))) - F.min(at(F.col("pos"))) + 1).alias("n"))
    j = ends.where(F.col("a").isNotNull() & (F.col("n") <= longest)).join(s, by)
    return j.select(key, F.substring("piece", F.col("a").cast("int") + 1, (F.col("b") - F.col("a")).cast("int")).alias("name"), (F.col("base") + F.col("a")).alias("begin"), (F.col("base") + F.col("b")).alias("end"))


def variants_of(name: str, others: list[str]) -> list[str]:
    """Name variants among neighbours: expansions of an acronym, longer names that hold the name, the name without marks."""
    plain = " ".join(re.sub(r"[^A-Za-z0-9]", " ", name).split())
    low = plain.lower().replace(" ", "")
    found = set()
    for o in others:
        for seq in re.findall(r"[A-Z][^\s]*(?:\s+(?:[A-Z][^\s]*|(?:%s)\b))*" % "|".join(STOP_WORDS), o):
            seq = seq.strip(" .,;:!?")
            ws = [w for w in seq.split() if w.lower() not in _STOP]
            initials = "".join(w[0] for w in ws).lower()
            if len(low) > 1 and (at := initials.find(low)) >= 0:
                found.add(" ".join(ws[at : at + len(low)]))
            if len(name) > 3 and name.lower() in seq.lower() and seq.lower() != name.lower():
                found.add(seq)
    if plain and plain != name:
        found.add(plain)
    return sorted(found)


@F.pandas_udf(ArrayType(StringType()))
def name_variants(name: pd.Series, others: pd.Series) -> pd.Series:
    return pd.Series([variants_of(n, list(o)) if n is not None and o is not None else [] for n, o in zip(name, others, strict=True)])


def label_runs(tokens: DataFrame, group: list[str], order: str = "pos", label: str = "label", none: str = "O") -> DataFrame:
    """Maximal runs of one label other than ``none``: (group, label, first, last, words)."""
    i = islands(tokens, group, order, label).where(F.col(label) != none)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda x: x["word"]), " ")
    return i.groupBy(*group, "island", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), ordered.alias("words")).drop("island")


def word_offsets(df: DataFrame, key: str, body: str, separator: str = " ") -> DataFrame:
    """(key, word, begin): words between single separators with their character offsets, from summed lengths."""
    w = df.select(key, F.posexplode(F.split(body, re.escape(separator), -1)).alias("pos", "word"))
    size = F.length("word") + len(separator)
    before = F.sum(size).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    return w.select(key, "word", before.alias("begin"))


def token_offsets(df: DataFrame, key: list[str], body: str, least: int = 2) -> DataFrame:
    """(key, token, begin): runs of letters and digits, ``least`` signs and longer, with their offsets."""
    w = df.select(*key, F.posexplode(F.split(body, r"[^\p{L}\p{Nd}]", -1)).alias("pos", "token"))
    size = F.length("token") + 1
    before = F.sum(size).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    return w.select(*key, "token", before.alias("begin")).where(F.length("token") >= least)


def local_weights(names: DataFrame, key: str) -> DataFrame:
    """(key, name, n, weight, one): relative frequency of each normalised name among a document's, and the trivial weight."""
    counts = names.select(key, text.normalize("name").alias("name")).where("name <> ''").groupBy(key, "name").agg(F.count("*").alias("n"))
    return counts.select(key, "name", "n", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("weight"), F.lit(1.0).alias("one"))


def alternative_names(names: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, name), distinct: a document's other names that hold the target's, or whose initials are the target's.

    ``names``: (key, name); ``targets``: (key, target), one a document.
    """
    n, t = text.normalize("name"), text.normalize("target")
    holds = F.contains(F.concat(F.lit(" "), n, F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))) & (n != t)
    return names.join(targets, key).where((t != "") & (holds | (text.acronym_match(F.col("target"), F.col("name")) > 0) & (n != t))).select(key, n.alias("name")).distinct()


def find_types(names: DataFrame, types: DataFrame) -> DataFrame:
    """(name, type, level) of distinct names: from (known, type) by the name as it is (1), without regard to case (2), with '_' for blanks (3), normalised (4), or else UNK (0)."""
    listed = lambda forms: F.array(*(F.struct(F.lit(i).alias("level"), f.alias("form")) for i, f in enumerate(forms, 1)))
    n, low = F.col("name"), F.lower("known")
    forms = listed((n, F.lower(n), F.replace(F.lower(n), F.lit("_"), F.lit(" ")), text.normalize(n)))
    known = listed((F.col("known"), low, low, text.normalize("known")))
    left = names.select("name").distinct().select("name", F.explode(forms).alias("f")).select("name", "f.*")
    right = types.select("type", F.explode(known).alias("f")).select("type", "f.*").groupBy("level", "form").agg(F.min("type").alias("type"))
    best = left.join(right, ["level", "form"]).groupBy("name").agg(F.min(F.struct("level", "type")).alias("b"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("b.type", F.lit("UNK")).alias("type"), F.coalesce("b.level", F.lit(0)).alias("level"))


def chains(names: DataFrame, key: str) -> DataFrame:
    """(key, name, n, type, singleton): names that a document repeats, with their most frequent type, and all others as chains of one."""
    n = names.select(key, text.normalize("name").alias("name"), "type").where("name <> ''")
    counts = n.groupBy(key, "name", "type").agg(F.count("*").alias("n"))
    return counts.groupBy(key, "name").agg(F.sum("n").alias("n"), F.max(F.struct("n", "type")).alias("t")).select(key, "name", "n", F.col("t.type").alias("type"), (F.col("n") == 1).alias("singleton"))


def reverse_matches(names: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, level, name): how a document speaks of its target: by a name that equals it when normalised (1), that holds or is held by it (2), or that shares a word (3).

    Of the names at the best level, the one that shares most words, then the longest,
    then the first in order stands for them. ``targets``: (key, target).
    """
    j = names.select(key, "name").distinct().join(targets, key).withColumns({"n": text.normalize("name"), "t": text.normalize("target")}).where("n <> '' and t <> ''")
    shared = F.size(F.array_intersect(text.words(F.col("n")), text.words(F.col("t"))))
    inside = F.contains(F.col("n"), F.col("t")) | F.contains(F.col("t"), F.col("n"))
    level = F.when(F.col("n") == F.col("t"), 1).when(inside, 2).when(shared > 0, 3)
    found = j.withColumns({"level": level, "shared": shared}).where("level is not null")
    return top_k(found, key, [F.asc("level"), F.desc("shared"), F.desc(F.length("name")), F.asc("name")], 1).select(key, "level", "name")


def feedback_names(run: DataFrame, grams: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """(mention_id, name, weight, rank): names weighted by the feedback documents.

    Sum over the documents of a run of the posterior (softmax of the score) times the
    name's share of the document's n-grams; the k best above 0. ``grams``: (entity_id,
    gram, p); ``names``: (mention_id, name).
    """
    w = Window.partitionBy("mention_id")
    posterior = run.select("mention_id", "entity_id", (F.exp(F.col("score") - F.max("score").over(w))).alias("x")).select("mention_id", "entity_id", (F.col("x") / F.sum("x").over(w)).alias("posterior"))
    met = posterior.join(names.distinct(), "mention_id").join(grams.withColumnRenamed("gram", "name"), ["entity_id", "name"])
    summed = met.groupBy("mention_id", "name").agg(F.round(F.sum(F.col("posterior") * F.col("p")), 6).alias("weight")).where("weight > 0")
    return top_k(summed, "mention_id", [F.desc("weight"), F.asc("name")], k)


def occurrences(df: DataFrame, key: str, body: str, phrase: str) -> DataFrame:
    """(key, begin): starts of all non-overlapping occurrences of a phrase."""
    pieces = word_offsets(df, key, body, phrase)
    return pieces.select(key, (F.col("begin") - len(phrase)).alias("begin")).where("begin >= 0")


def nearest_neighbors(hits: DataFrame, targets: DataFrame, key: str, k: int) -> DataFrame:
    """(key, name, distance, rank): names of a document by distance in characters to its nearest target.

    ``hits``: (key, name, begin); ``targets``: (key, begin). The nearest target comes
    from the running last and next target of the merged, sorted offsets: no pairs.
    """
    both = hits.select(key, "name", "begin").unionByName(targets.select(key, F.lit(None).cast("string").alias("name"), "begin"))
    w = Window.partitionBy(key).orderBy("begin")
    at = F.when(F.col("name").isNull(), F.col("begin"))
    before = F.last(at, True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(at, True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = both.withColumn("distance", F.least(F.col("begin") - before, after - F.col("begin"))).where("name is not null and distance is not null")
    least = near.groupBy(key, F.lower("name").alias("name")).agg(F.min("distance").alias("distance"))
    return top_k(least, key, [F.asc("distance"), F.asc("name")], k)


def sentences(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, sentence from 1, text)."""
    return df.select(key, F.posexplode(text.sentences(F.col(body))).alias("sentence", "text")).withColumn("sentence", F.col("sentence") + 1)


def uniform(df: DataFrame, group: str) -> Column:
    """1 / n within a group."""
    return 1.0 / F.count("*").over(Window.partitionBy(group))


def sentence_of(body: Column, begin: Column) -> Column:
    """Number, from 1, of the sentence that an offset lies in: the full stops before it."""
    before = F.substring(body, F.lit(1), begin)
    return F.length(before) - F.length(F.replace(before, F.lit("."), F.lit(""))) + 1


def sentence_names(sentences: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, name, n): capitalised words of the sentences that hold the target, without the target's own.

    ``sentences``: (key, text); ``targets``: (key, target).
    """
    held = sentences.join(targets, key).where(F.contains("text", F.col("target")))
    names = held.select(key, "target", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("name"))
    return names.where(~F.contains("target", F.col("name"))).groupBy(key, "name").agg(F.count("*").alias("n"))


def linked_match(names: DataFrame, targets: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first mention of each target among a document's names: equal when normalised, or one holds the other without regard to case."""
    j = names.join(targets, key)
    n, t = text.normalize("name"), text.normalize("target")
    a, b = F.lower("name"), F.lower("target")
    return top_k(j.where((n == t) | F.contains(a, b) | F.contains(b, a)), key, order, 1).drop("rank")
