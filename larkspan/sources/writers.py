"""Writers: run files, feature lines, predictions, linked-mention XML, repacked corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lines(query: Column, doc: Column, rank: Column, score: Column, tag: str) -> Column:
    """``query Q0 doc rank score tag``, the score with eight decimals."""
    return F.format_string("%s Q0 %s %d %.8f %s", query.cast("string"), doc.cast("string"), rank, score, F.lit(tag))


def confidence(score: Column, top: Column, low: float = 5.0) -> Column:
    """(score + low) / (top + low), at least 0.001."""
    return F.greatest((score + low) / (top + low), F.lit(0.001))


def prediction_lines(df: DataFrame, low: float = 5.0) -> DataFrame:
    """``mention <tab> id <tab> confidence`` of (mention_id, kb_id, score); the greatest score comes from one aggregate."""
    top = df.agg(F.max("score").alias("_top"))
    lined = df.join(top, F.lit(True), "left")  # one row
    return lined.select(F.concat_ws("\t", F.col("mention_id").cast("string"), "kb_id", F.format_string("%.6f", confidence(F.col("score"), F.col("_top"), low))).alias("value"))


def component_lines(df: DataFrame, sources: list[str]) -> DataFrame:
    """``1/0 qid:query i:score ... # result`` from (query, result, source, score, relevant); sources in the given order."""
    p = df.groupBy("query", "result", "relevant").pivot("source", sources).agg(F.first("score"))
    cells = [F.concat(F.lit(f"{i + 1}:"), F.format_string("%.6f", F.coalesce(F.col(f"`{s}`"), F.lit(0.0)))) for i, s in enumerate(sources)]
    return p.select(F.concat_ws(" ", F.col("relevant").cast("int").cast("string"), F.concat(F.lit("qid:"), F.col("query").cast("string")), *cells, F.lit("#"), F.col("result").cast("string")).alias("value"))


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(df.columns[0]).alias("value")).write.mode(mode).text(path)


def write_features(df: DataFrame, path: str, partition: str = "set") -> None:
    """Parquet by query set; what is there already stays."""
    df.write.partitionBy(partition).mode("ignore").parquet(path)


def write_linked(df: DataFrame, path: str) -> None:
    """Linked mentions with their candidates as XML, one ``mention`` element a row."""
    df.write.format("xml").option("rootTag", "mentions").option("rowTag", "mention").mode("overwrite").save(path)


def write_table(df: DataFrame, path: str) -> None:
    """Rankings, answer distributions, accuracies: tab-separated with a header line."""
    df.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


def linked(run: DataFrame, names: DataFrame) -> DataFrame:
    """(mention_id, name, candidate: best first, raw: all ids) for ``write_linked``."""
    held = run.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("entity_id").alias("id"), "score"))).alias("candidate"))
    return names.select("mention_id", "name").join(held, "mention_id", "left").withColumn("raw", F.transform("candidate", lambda c: c["id"]))


def corpus_files(df: DataFrame, suffixes: tuple[str, ...] = ("sgm", "giga"), path: str = "path") -> DataFrame:
    """The files of a listing whose name has one of the suffixes."""
    return df.where(F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*suffixes))


def repack(df: DataFrame, path: str, files: int = 10_000) -> None:
    """Documents of a corpus, ``files`` to an output file."""
    df.write.option("maxRecordsPerFile", files).mode("overwrite").text(path)


def term_counts(stats: DataFrame, path: str) -> None:
    """term, cf, df with cf > 1, tab-separated."""
    stats.where("cf > 1").select("term", "cf", "df").write.option("sep", "\t").mode("overwrite").csv(path)


def first_appearance(key: str, order: str) -> Column:
    """Position of a key's first row."""
    return F.min(order).over(Window.partitionBy(key))
