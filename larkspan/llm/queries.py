"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame.

Each applies its operator to the whole intended table. None has DuckDB SQL (see
the README); tests/llm holds each against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bpe, packing, passages, pii, pivots, quality, secrets, simhash, spotsigs, wrappers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"), bpe.public_pattern())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "score", (F.col("score") >= quality.KEEP).alias("accepted"))


def op4_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_words", "n_removed"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_multi_50k.tiktoken"), bpe.public_pattern())


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.adjacent(table(spark, sf_dir, "documents"))


def near_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints are alike at 0.8: length partitions and pruned Jaccard."""
    return spotsigs.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith(("op", "near_")) and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
