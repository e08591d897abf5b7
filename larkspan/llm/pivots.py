"""Near-duplicate vectors by a pivot-permutation index (operator 4).

Pivots are reference points from a bounded sample of the distinct vectors (``POOL`` for
each pivot, those with the least hashes), none within twice the angle of the
threshold of another, so a large group of near copies gives few pivots and its
members are told apart by pivots outside it. Their number grows with the square
root of the number of vectors, up to ``MOST``.

A vector is described by its ``DEPTH`` nearest pivots, nearest first. It stands in the
inverted list of each pair of them, kept apart by label: vectors that meet there
share ``SHARED`` pivots. There are about as many pairs of pivots as vectors, so lists stay
short and candidates grow as the vectors do, not as their square (beyond ``MOST``
pivots lists grow in proportion).

Retrieval has two rounds. In the first, lists hold 64-bit sketches (signs of fixed
random projections) instead of vectors: a row stays if some other in its list differs in
at most ``BITS`` signs (a pair at 0.98 differs in about 4, one in a million pairs in
more than that). In the second, vectors of the rows that stay are verified by their
cosine in double precision; a pair that meets in several lists is judged in
that of the least pivots it shares, so it is counted once.

Equal vectors (by two 64-bit hashes) are merged first and carry their number, so copies
never meet. A long list is dealt to chunks by hash (of ``BLOCK`` rows at most) and each
pair of chunks is a task group of its own; a row is copied once for each chunk of its own list.
What leaves a task is one row per vector (its links found there) and a union-find
forest, never all pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and
rows with a null label, link with nothing. Repeated rows with different ids are
copies of each other and link; rows that repeat an id are one vector. Rows with a
null id are returned with no links and a null component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import components, dealt_out, facing, groups, map_columns, materialise, quoted, runs, small_batches
from larkspan.llm.simhash import Forest, least_labels

#: Least and greatest number of pivots; between them twice the square root of the number of vectors.
LEAST, MOST = 64, 4096
DEPTH, SHARED, BITS, BLOCK = 5, 2, 18, 8192
#: Sampled vectors for each pivot.
POOL = 16
_PAIRS = np.array(list(combinations(range(DEPTH), SHARED)))


def pivot_number(vectors: int) -> int:
    return int(min(MOST, max(LEAST, np.ceil(2 * np.sqrt(vectors)))))


def pivot_sample(vectors: DataFrame, most: int, threshold: float = 0.98) -> np.ndarray:
    """At most ``most`` distinct vectors, least hashes first, scaled to length one, spread out.

    One that lies within twice the angle of ``threshold`` of a vector taken before is
    left out: near copies as pivots would rank each other by noise alone. The bound
    holds at every size: ``most`` x ``POOL`` rows reach the driver.
    """
    rows = vectors.select("vector", "h1").orderBy("h1", "node").limit(most * POOL).select("vector").collect()
    if not rows:
        return np.zeros((0, 0))
    size = max(len(r[0]) for r in rows)
    m = np.array([r[0] for r in rows if len(r[0]) == size], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    taken, nearest = [], np.full(len(m), -np.inf)
    for i in range(len(m)):
        if len(taken) < most and nearest[i] < 2 * threshold * threshold - 1:
            taken.append(i)
            nearest = np.maximum(nearest, m @ m[i])
    # the first is taken whatever the threshold
    return m[taken or [0]]


def sketches(m: np.ndarray) -> np.ndarray:
    """64 signs of fixed random projections of each row."""
    planes = np.random.default_rng(7).normal(size=(m.shape[1], 64))
    return np.packbits(m @ planes > 0, axis=1, bitorder="little").view("<u8").ravel()


def permutations(m: np.ndarray, pivots: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The ``depth`` nearest pivots of each row, nearest first; -1 where there are fewer."""
    near = m @ pivots.T / np.linalg.norm(m, axis=1, keepdims=True)
    k = min(depth, len(pivots))
    part = np.argpartition(-near, k - 1, axis=1)[:, :k]
    order = np.take_along_axis(part, np.lexsort((part, -np.take_along_axis(near, part, axis=1)), axis=1), axis=1)
    return np.concatenate([order, np.full((len(m), depth - k), -1)], axis=1).astype(np.int64)


def lists(perms: np.ndarray) -> np.ndarray:
    """Of each row, the numbers of its lists, one for each pair of its pivots; -1 for none. A pivot that is alone makes a list of its own."""
    pairs = np.sort(perms[:, _PAIRS], axis=2)
    if (perms[:, 1:] < 0).all():
        return np.where(np.arange(len(_PAIRS)) == 0, perms[:, :1] * (MOST + 1), -1)
    return np.where(pairs[:, :, 0] >= 0, pairs[:, :, 0] * MOST + pairs[:, :, 1], -1)


def _staying(c: dict[str, list]) -> Iterator[tuple]:
    """(list, node) of the rows whose sketch is near another's of the group."""
    key, node, side, where = (np.array(c[k], dtype=np.int64) for k in ("key", "node", "side", "list"))
    code = np.array(c["code"], dtype=np.int64).view(np.uint64)
    stays = np.zeros(len(key), dtype=bool)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    # short groups all at once: each row against the j-th after it
    short = np.repeat((sizes <= 64) & np.logical_and.reduceat(side == 2, starts), sizes)
    j = 1
    while j < len(key) and (same := short[j:] & (key[j:] == key[:-j])).any():
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(code[at] ^ code[at + j]) <= BITS]
        stays[at] = stays[at + j] = True
        j += 1
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if short[a]:
            continue
        for left, right in facing(side[a : a + n]):
            for i in range(0, len(left), 512):
                p, q = left[i : i + 512] + a, right + a
                near = (np.bitwise_count(code[p][:, None] ^ code[q][None, :]) <= BITS) & (p[:, None] != q[None, :])
                stays[p] |= near.any(axis=1)
                stays[q] |= near.any(axis=0)
    yield where[stays], node[stays]


def linked(unit: np.ndarray, node: np.ndarray, perms: np.ndarray, first: int, second: int, threshold: float, met: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at the threshold whose two least shared pivots are ``first`` and ``second``."""
    # pivots below the second that a pair shares besides the first make another list the one that counts
    small = [(v, np.flatnonzero((perms == v).any(axis=1))) for v in np.unique(perms[(perms >= 0) & (perms < second) & (perms != first)]).tolist()]
    has = np.zeros((len(unit), len(small)), dtype=np.float32)
    for k, (_, at) in enumerate(small):
        has[at, k] = 1
    for left, right in met:
        for i in range(0, len(left), 512):
            part = left[i : i + 512]
            ok = unit[part] @ unit[right].T >= threshold
            # within one chunk each pair is taken once
            ok &= node[part][:, None] < node[right][None, :] if left is right else True
            if ok.any():
                if small:
                    ok &= has[part] @ has[right].T == 0
                p, q = np.nonzero(ok)
                yield part[p], right[q]


def _verified(threshold: float):
    def work(c: dict[str, list]) -> Iterator[tuple]:
        forest, counts = Forest(), {}
        for a, b in runs(c["key"]):
            if b - a < 2:
                continue
            node, n, side = (np.array(c[k][a:b]) for k in ("node", "n", "side"))
            x, perms = np.array(c["vector"][a:b], dtype=np.float64), np.array(c["perm"][a:b], dtype=np.int64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            first, second = divmod(c["number"][a], MOST)
            found = list(linked(unit, node, perms, first, second, threshold, facing(side)))
            i, j = (np.concatenate(p) for p in zip((np.zeros(0, dtype=np.int64),) * 2, *found, strict=True))
            total = np.bincount(i, weights=n[j], minlength=b - a) + np.bincount(j, weights=n[i], minlength=b - a)
            least = least_labels(b - a, [(i, j)])
            for y in np.flatnonzero(total).tolist():
                v = int(node[y])
                counts[v] = counts.get(v, 0) + int(total[y])
                forest.join(v, int(node[least[y]]))
        v = list(counts)
        yield v, [counts[y] for y in v], [forest.root(y) for y in v]

    return work


def near_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", threshold: float = 0.98, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per row: key, n_links, component_id, kept. ``pivots``: their number, else ``pivot_number``."""
    small_batches(df.sparkSession)
    own = df.schema[vector].dataType.elementType.simpleString()
    kept = own if own in ("float", "double") else "double"
    rows = df.select(quoted(key).alias("id"), quoted(label).alias("label"), quoted(vector).cast(f"array<{kept}>").alias("vector"))
    sound = F.col("vector").isNotNull() & F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") > 0) & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("vector", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    good = rows.where(sound).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kept)))
    good = good.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(2), "label", "vector")})
    ids = good.select("id", "h1", "h2").distinct()
    counts = ids.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    vectors = good.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes, _ = materialise(vectors.join(counts, ["h1", "h2"]))
    chosen = pivot_sample(classes, pivots or pivot_number(classes.count()), threshold)
    if len(chosen):
        found = _links(classes, chosen, threshold, block)
    else:
        found = classes.select("node", F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component_id"))
    judged = classes.select("h1", "h2", "node", "n").join(found, "node", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "node").alias("component_id"))
    per_id = ids.join(judged, ["h1", "h2"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("id").join(per_id, "id", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("component_id", "id") == F.col("id")).alias("kept"))


def _links(classes: DataFrame, chosen: np.ndarray, threshold: float, block: int) -> DataFrame:
    size = chosen.shape[1]

    def describe(batches):
        for vectors, nodes in batches:
            # vectors of another length than the pivots are described as if cut or padded with zeros
            m = np.array([(v + [0.0] * size)[:size] for v in vectors])
            m[~m.any(axis=1)] = 1.0
            perms = permutations(m, chosen)
            yield nodes, perms.tolist(), sketches(m).view(np.int64).tolist(), lists(perms).tolist()

    described = map_columns(classes.select("vector", "node"), "node long, perm array<int>, code long, numbers array<long>", describe)
    described, _ = materialise(described.join(classes.select("node", "n", F.xxhash64("label", F.size("vector")).alias("kind")), "node"))
    listed = described.select("node", "code", "kind", F.explode(F.array_distinct("numbers")).alias("number")).where("number >= 0").select(F.xxhash64("kind", "number").alias("list"), "node", "code")
    near = dealt_out(listed, "node", block).select("key", "side", "list", "node", "code")
    stays, _ = materialise(map_columns(near, "list long, node long", groups(("key", "side", "list", "node", "code"), 8192, _staying)).distinct())
    rows = described.select("node", "n", "perm", "kind", F.explode(F.array_distinct("numbers")).alias("number")).withColumn("list", F.xxhash64("kind", "number"))
    rows = stays.join(rows, ["node", "list"]).join(classes.select("node", "vector"), "node").select("list", "number", "node", "n", "perm", "vector")
    dealt = dealt_out(rows, "node", block).select("key", "side", "number", "node", "n", "perm", "vector")
    found, _ = materialise(map_columns(dealt, "node long, links long, root long", groups(("key", "side", "number", "node", "n", "perm", "vector"), 2048, _verified(threshold))))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    return totals.join(joined, "node", "left").select("node", "n_links", F.coalesce("component", "node").alias("component_id"))
