"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
SQL can't express the stages (fitted model, Aho-Corasick, byte-level BPE), so
ORACLE_SQL is None; tests/llm/test_texts.py holds run() against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bpe, packing, passages, quality, secrets, simhash
from larkspan.llm.common import forget, fresh, materialise, passing, quoted


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash within 3 bits, or five-word shingles alike at 0.8 or more."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat from an earlier one; n_chars follows the text."""
    counts = fresh(docs, "n_words", "n_removed")
    kept = passages.remove_repeats(docs, layout=True, counts=counts)
    return kept.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(quoted, docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the text."""
    (changed,) = fresh(docs, "changed")
    masked = secrets.redact(docs, changed=changed)
    return masked.withColumn("n_chars", F.when(F.col(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack_documents(docs, bpe.public_path("byte_bpe_50k.json"), bpe.public_pattern())


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", passage_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES[:-1]:
        with passing(spark) as stays:
            docs, path = materialise(stage(spark, docs, sf_dir))
            stays.append(path)
        forget(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
