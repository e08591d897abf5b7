"""Postings and term statistics: an inverted index as tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch of word lists by rows and bytes, unless the session has lower bounds; they stay, as results are lazy."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each word and the words of a column of word lists."""
    return np.asarray(pc.list_parent_indices(lists)), pc.list_flatten(lists)


def batch_grams(lists: pa.Array, n: int, least: int = 1) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Rows, grams and counts of the runs of k words, for k from 1 to n, that a row of a batch holds ``least`` times and more."""
    row, words = flat(lists)
    coded = words.dictionary_encode()
    code, vocabulary = np.asarray(coded.indices.fill_null(len(coded.dictionary)), dtype=np.int64), coded.dictionary
    at, gram = np.arange(len(code)), code
    for k in range(1, n + 1):
        if k > 1:  # gram: a number for each run of k - 1 words that begin at ``at``
            more = np.flatnonzero(at + k - 1 < len(row))
            more = more[row[at[more] + k - 1] == row[at[more]]]
            at = at[more]
            gram = np.asarray(pa.array(gram[more] * (len(vocabulary) + 1) + code[at + k - 1]).dictionary_encode().indices, dtype=np.int64)
        if not len(at):
            return
        size = int(gram.max()) + 1
        counted = pc.value_counts(pa.array(row[at] * size + gram))
        found, count = np.asarray(counted.field(0)), np.asarray(counted.field(1))
        found, count = found[count >= least], count[count >= least]
        first = np.empty(size, dtype=np.int64)  # a place where each gram stands
        first[gram[::-1]] = at[::-1]
        start = first[found % size]
        parts = [vocabulary.take(pa.array(code[start + i], mask=code[start + i] == len(vocabulary))) for i in range(k)]
        yield found // size, pc.binary_join_element_wise(*parts, " ", null_handling="skip") if k > 1 else parts[0], count


def gram_counts(docs: DataFrame, n: int = 1, key: str = "entity_id", least: int = 1) -> DataFrame:
    """(key, gram, count, total): the runs of 1 to n words that a row's ``terms`` hold ``least`` times and more; total is the number of all its runs.

    A row's words are counted where it lies, in Arrow batches, so no word is shuffled. Rows of
    one key aren't added up.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("gram", T.StringType()), T.StructField("count", T.LongType()), T.StructField("total", T.LongType())])

    def run(batches):
        for b in batches:
            lists = b.column(1)
            size = np.asarray(pc.list_value_length(lists).fill_null(0), dtype=np.int64)
            total = sum(np.maximum(size - i, 0) for i in range(n))
            for row, gram, count in batch_grams(lists, n, least):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), gram, pa.array(count, pa.int64()), pa.array(total[row], pa.int64())], [key, "gram", "count", "total"])

    return docs.select(key, "terms").mapInArrow(run, schema)


def postings(docs: DataFrame, key: str = "entity_id", only: DataFrame | None = None) -> DataFrame:
    """(key, term, tf). ``only``: (term) rows to which terms are cut before the shuffle."""
    every = docs.select(key, F.explode("terms").alias("term"))
    if only is not None:
        every = every.join(only.select("term").distinct(), "term", "left_semi")
    return every.groupBy(key, "term").agg(F.count("*").alias("tf"))


def positions(docs: DataFrame, key: str = "entity_id", only: DataFrame | None = None) -> DataFrame:
    """(key, pos from 0, term), cut to the terms of ``only``."""
    every = docs.select(key, F.posexplode("terms").alias("pos", "term"))
    return every if only is None else every.join(only.select("term").distinct(), "term", "left_semi")


def lengths(docs: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, len): no shuffle."""
    return docs.select(key, F.size("terms").cast("long").alias("len"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, cf, df) from postings."""
    return post.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: tokens, docs."""
    return docs.agg(F.sum(F.size("terms")).cast("long").alias("tokens"), F.count("*").alias("docs"))


def language_model(docs: DataFrame, n: int = 1, key: str = "entity_id", least: int = 1) -> DataFrame:
    """(key, gram, count, p) over all runs of 1 to n words that a row holds ``least`` times and more; p is the relative frequency among all runs."""
    return gram_counts(docs, n, key, least).select(key, "gram", "count", (F.col("count") / F.col("total")).alias("p"))
