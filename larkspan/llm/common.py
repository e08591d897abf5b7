"""Shared plumbing: scratch tables, Arrow mapping, connected components.

Scratch tables live in the shared folder named by ``spark.checkpoint.dir``, so
they outlive any executor. Only where that setting is absent and the session is a
local one (tests) is a folder of our own chosen; on a cluster that is an error.
Tables that no later step reads are deleted at once, the others when Python ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_OWN: list[str] = []
_WRITTEN: dict[str, SparkSession] = {}
#: Tables written within the innermost ``passing`` of this thread.
_PASSING: ContextVar[list[str] | None] = ContextVar("_PASSING", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="larkspan-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def quoted(name: str) -> Column:
    """The column of this very name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores before them until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return tuple(out)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns can't clash with them."""
    return F.struct(*map(quoted, df.columns))


def unpacked(df: DataFrame, like: DataFrame, row: str = "row") -> DataFrame:
    """The columns of ``like`` from the struct that ``packed`` made of them."""
    return df.select(*(F.col(row)[c].alias(c) for c in like.columns))


def materialise(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the scratch folder; returns it reread, and its path.

    Cuts the lineage: a later stage that loses an executor rereads the files.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/larkspan-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    if (inner := _PASSING.get()) is not None:
        inner.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no plan reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        _WRITTEN.pop(path, None)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the scratch tables that are written within, but those whose paths are put into the list.

    What leaves the block may read nothing but what was there before and what is in the list.
    """
    inner, stays = [], []
    token = _PASSING.set(inner)
    try:
        yield stays
    finally:
        _PASSING.reset(token)
        forget(spark, *(p for p in inner if p in _WRITTEN and p not in stays))
        if (outer := _PASSING.get()) is not None:
            outer += stays


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that are no longer held.

    It does so once the driver's collector has found their handles, which after a few large
    steps would be too late.
    """
    gc.collect()
    spark._jvm.System.gc()


@atexit.register
def _forget_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            forget(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch of texts by rows and bytes, unless the session has lower bounds.

    Results are lazy, so the bounds stay with the session.
    """
    for name, most in (("maxRecordsPerBatch", 500), ("maxBytesPerBatch", 8 << 20)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def map_columns(df: DataFrame, schema: str | T.StructType, fn: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Arrow map over a partition's batches.

    ``fn`` takes an iterator of tuples of column lists and yields tuples of column
    lists in the order of ``schema``.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        columns = (tuple(c.to_pylist() for c in b.columns) for b in batches if b.num_rows)
        for made in fn(columns):
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(made, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def groups(names: tuple[str, ...], least: int, work: Callable[[dict[str, list]], Iterator[tuple]]):
    """An Arrow map over rows sorted by their first column, key: ``work`` gets whole groups, several at a time."""

    def run(frames):
        held: dict[str, list] = {k: [] for k in names}
        for columns in frames:
            for name, values in zip(names, columns, strict=True):
                held[name] += values
            key = held[names[0]]
            if len(key) >= least:
                whole = int(np.searchsorted(np.array(key, dtype=np.int64), key[-1]))
                if whole:
                    yield from work({k: v[:whole] for k, v in held.items()})
                    held = {k: v[whole:] for k, v in held.items()}
        if held[names[0]]:
            yield from work(held)

    return run


def runs(key: list[int]) -> Iterator[tuple[int, int]]:
    k = np.array(key, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True)


def facing(side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows of a group are held against which: a chunk against itself, or one against the other."""
    lower, upper, whole = (np.flatnonzero(side == x) for x in (0, 1, 2))
    return [(a, b) for a, b in ((whole, whole), (lower, upper)) if len(a) and len(b)]


def dealt_out(rows: DataFrame, node: str, block: int) -> DataFrame:
    """Rows with a ``list`` get the key of each group that they meet others in, and their side there; sorted by key.

    A list of m rows is dealt to round(sqrt(m) / 8) chunks, and to more where these would be
    longer than ``block``; each pair of chunks is a group, so that a hot list is spread.
    """
    sizes = rows.groupBy("list").agg(F.count("*").alias("m")).where("m > 1")
    met = rows.join(sizes, "list").withColumn("c", F.greatest(F.lit(1), F.ceil(F.col("m") / block), F.round(F.sqrt("m") / 8)).cast("int")).withColumn("i", F.pmod(F.xxhash64(node), F.col("c")).cast("int"))
    dealt = met.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    key = F.when(F.col("c") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("i", "j"), F.greatest("i", "j")))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") > F.col("j"), 1).otherwise(0)
    return dealt.select(key.alias("key"), side.alias("side"), *rows.columns).repartition("key").sortWithinPartitions("key")


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components of an undirected edge list of longs: (node, component).

    Alternating large-star and small-star (Kiveris et al. 2014): each step is a
    ``min`` with map-side combine and an equi-join that AQE may split, so a star
    with very many leaves never meets in one task. Only the edge count and a
    checksum reach the driver. Nodes without an edge aren't listed.
    """
    spark = edges.sparkSession
    # both ends are taken once; loops go
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = materialise(e)

    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(e)
    for _ in range(most):
        if not seen[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        # large star: every larger neighbour is tied to the least one
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the node and its smaller neighbours are tied to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u")
        e = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e, path2 = materialise(e)
        forget(spark, path)
        path, now = path2, mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    # every edge now leads from a node to the least node of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
