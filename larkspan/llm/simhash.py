"""SimHash near-duplicates by bit-sliced comparison (operator 5).

Fingerprints are per-document (one Arrow pass). Distinct fingerprints are then
dealt to tables: the 64 bits form five blocks, and two fingerprints that differ
in at most three bits agree on at least two whole blocks, so each pair within
the radius meets under one of the ten pairs of blocks.

Within a table the rows are sorted by key and compared by bit planes: plane k
holds bit k of every row of the run, one bit a row. ``plane ^ (plane >> j)`` is
bit k of the difference of every row to the j-th after it; the planes are
summed by carry-save counters that saturate above the radius, and a lag is
abandoned as soon as all pairs of one key exceed it.

A key with more than ``BLOCK`` distinct fingerprints is split: its rows are
dealt to chunks by hash and each pair of chunks is a task group of its own, so
no task ever holds a whole hot key. Copies never enter: equal fingerprints were
merged before. Only union-find forests leave a task, never all pairs.

Texts that are null count as empty; texts without words have fingerprint zero
and link like any other; repeated rows share a fingerprint and a component. A
row with a null id gets a fingerprint, but stands for no node: its component is
that of its fingerprint, null if no row with an id has it.

``keep_one`` also links texts whose sets of five-word shingles have a Jaccard
coefficient of ``ALIKE`` or more, since three bits reach only the closest of those.
Candidates share one of ``BANDS`` hashes of ``ROWS`` least shingle hashes each (at 0.8
a pair shares none with a chance of 3 in 100,000) and are verified on the sets
themselves. In each bucket the texts are held against the least one first; then
those that are not yet of one component are held against each other, so a large
group of near copies isn't compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import components, dealt_out, facing, free_shuffles, groups, map_columns, materialise, packed, passing, quoted, runs, small_batches, unpacked

#: The five blocks of bits (first bit, width), and the radius that they serve.
BLOCKS, RADIUS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 3
#: Distinct fingerprints of one key that are compared in one go.
BLOCK = 2048
#: Near copies in ``keep_one``: words of a shingle, least Jaccard coefficient, bands and least hashes in each.
WIDE, ALIKE, BANDS, ROWS = 5, 0.8, 20, 4
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of ASCII-lower-cased word shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        shingles = [b" ".join(words)]
    elif size == 3:
        shingles = [b"%b %b %b" % w for w in zip(words, words[1:], words[2:], strict=False)]
    else:
        shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    ones, n = np.zeros(64, dtype=np.int64), len(shingles)
    for i in range(0, n, 1 << 14):
        h = np.array([digest(s, seed) for s in shingles[i : i + (1 << 14)]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _bits(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def close_pairs(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group whose fingerprints differ in at most ``radius`` (1 to 3) bits.

    ``group`` is sorted. One pair of index arrays for each lag.
    """
    n = len(prints)
    if n < 2:
        return
    rows = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    planes = [_bits(rows[:, k]) for k in range(64)]
    most = int(np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])).max())
    for j in range(1, most):
        same = _bits(group[j:] == group[:-j])
        low, high, over = 0, 0, 0
        for p in planes:
            x = p ^ (p >> j)
            carry = low & x
            low ^= x
            over |= high & carry
            high ^= carry
            if radius < 3:
                over |= high & low if radius == 2 else high
            if not same & ~over:
                break
        else:
            ok = (same & ~over).to_bytes((n + 7) // 8, "little")
            i = np.flatnonzero(np.unpackbits(np.frombuffer(ok, dtype=np.uint8), bitorder="little"))
            yield i, i + j


def least_labels(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows, the least row index reachable by the pairs."""
    label = np.arange(n)
    if pairs:
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


class Forest:
    """Union-find over the ids of one task's run; the least id is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for y in path:
            up[y] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up)]


def _compare(radius: int):
    def run(batches):
        keys, prints, nodes, held, last = [], [], [], 0, None

        def flush(upto: int) -> list[tuple[int, int]]:
            k, p, v = (np.concatenate(x) for x in (keys, prints, nodes))
            forest = Forest()
            least = least_labels(upto, list(close_pairs(p[:upto], k[:upto], radius)))
            for i in np.flatnonzero(least != np.arange(upto)).tolist():
                forest.join(int(v[i]), int(v[least[i]]))
            keys[:], prints[:], nodes[:] = [k[upto:]], [p[upto:]], [v[upto:]]
            return forest.edges()

        for ks, ps, vs in batches:
            k = np.array(ks, dtype=np.int64)
            keys.append(k)
            prints.append(np.array(ps, dtype=np.int64).view(np.uint64))
            nodes.append(np.array(vs, dtype=np.int64))
            held += len(k)
            if held >= 8192:  # all groups but the last are whole
                whole = int(np.searchsorted(np.concatenate(keys), k[-1]))
                if whole and (found := flush(whole)):
                    yield tuple(map(list, zip(*found, strict=True)))
                held -= whole
        if held and (found := flush(held)):
            yield tuple(map(list, zip(*found, strict=True)))

    return run


def links(prints: DataFrame, fp: str = "fp", node: str = "node", radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Forest edges (a, b) over distinct fingerprints that differ in at most ``radius`` bits."""
    keys = []
    for t, pair in enumerate(combinations(BLOCKS, 2)):
        mask = sum(((1 << w) - 1) << s for s, w in pair)
        # table and block bits make one long: its bits are the masked ones, hashed with the table
        keys.append(F.xxhash64(F.lit(t), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    rows = prints.select(F.explode(F.array(*keys)).alias("key"), F.col(fp).alias("fp"), F.col(node).alias("node"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    met = rows.join(sizes, "key").select("key", "fp", "node", chunks.alias("c"), mine.alias("i"))
    dealt = met.select("key", "fp", "node", "i", "c", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j")).select(
        F.when(F.col("c") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).alias("key"), "fp", "node"
    )
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return map_columns(dealt, "a long, b long", _compare(radius)).distinct()


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row; fp is the fingerprint as a signed long."""
    small_batches(df.sparkSession)

    def run(batches):
        for keys, texts in batches:
            yield keys, np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64).tolist()

    return map_columns(df.select(quoted(key).cast("long"), quoted(text).cast("string")), f"`{key}` long, fp long", run)


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id."""
    prints, _ = materialise(fingerprints(df, text, key))
    nodes = prints.groupBy("fp").agg(F.min(key).alias("node"))
    found = components(links(nodes.where("node is not null"), radius=radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_shingles(text: str | None, size: int = WIDE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ASCII-lower-cased words; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))], dtype=np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """A hash for each band of least hashes; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 1 << 12):
        h = shingles[i : i + (1 << 12), None] * _FACTORS
        # the low bits of a product depend on the low bits alone
        h ^= h >> np.uint64(32)
        np.minimum(least, (h * np.uint64(0x9E3779B97F4A7C15)).min(axis=0), out=least)
    least = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(least)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard coefficient of two sorted sets, 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verify(pairs: DataFrame, held: DataFrame, alike: float) -> DataFrame:
    """Those of the pairs (a, b) of hashes whose sets of shingles (h, s) are alike."""
    both = pairs.join(held.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(held.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for a, b, sa, sb in batches:
            ok = [i for i in range(len(a)) if jaccard(np.frombuffer(sa[i], dtype="<u8"), np.frombuffer(sb[i], dtype="<u8")) >= alike]
            yield [a[i] for i in ok], [b[i] for i in ok]

    found, _ = materialise(map_columns(both.select("a", "b", "sa", "sb"), "a long, b long", run))
    return found


def alike_links(prints: DataFrame, texts: DataFrame, alike: float = ALIKE, block: int = 1024) -> DataFrame:
    """Edges (a, b) over texts whose Jaccard coefficient is ``alike`` or more, from (h, bands) and (h, t).

    The texts are read, and shuffled, once: for the sets of those that share a bucket.
    """
    rows = prints.groupBy("h").agg(F.min("bands").alias("bands")).select("h", F.explode("bands").alias("key"))
    first = rows.groupBy("key").agg(F.min("h").alias("first"), F.max("h").alias("last")).where("first < last").select("key", "first")
    met, _ = materialise(rows.join(first, "key"))

    def described(batches):
        for hs, ts in batches:
            yield hs, [wide_shingles(t).tobytes() for t in ts]

    used = texts.join(met.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("t").alias("t"))
    held, _ = materialise(map_columns(used, "h long, s binary", described))
    star, _ = materialise(met.where("h <> first").select(F.col("first").alias("a"), F.col("h").alias("b")).distinct())
    found = _verify(star, held, alike)
    # of each bucket, the texts that are not yet of one component
    part = met.join(components(found), met["h"] == F.col("node"), "left").select("key", "h", F.coalesce("component", "h").alias("part"))
    part, _ = materialise(part)
    open_ = part.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    left, _ = materialise(part.join(open_, "key"))
    dealt = dealt_out(left.withColumnRenamed("key", "list"), "h", block).join(held, "h").select("key", "side", "h", "part", "s")
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    more = map_columns(dealt, "a long, b long", groups(("key", "side", "h", "part", "s"), 512, _alike(alike)))
    return found.union(more.distinct())


def overlaps(sets: list[np.ndarray], rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``rows``, the sizes of its intersections with all sets, through the lists of sets that hold an element."""
    sizes = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(len(sets)), sizes)[np.argsort(element, kind="stable")]
    counts = np.bincount(element)
    starts, first = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    for i in rows.tolist():
        own = element[first[i] : first[i] + sizes[i]]
        n = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        yield i, np.bincount(of[at], minlength=len(sets))


def _alike(alike: float):
    def work(c: dict[str, list]) -> Iterator[tuple]:
        forest = Forest()
        for a, b in runs(c["key"]):
            part, side = (np.array(c[k][a:b], dtype=np.int64) for k in ("part", "side"))
            if b - a < 2 or (part == part[0]).all():
                continue
            sets = [np.frombuffer(x, dtype="<u8") for x in c["s"][a:b]]
            sizes = np.array([len(s) for s in sets])
            pairs = []
            for left, right in facing(side):
                ok = np.zeros(b - a, dtype=bool)
                ok[right] = True
                for i, both in overlaps(sets, left):
                    j = np.flatnonzero(ok & (both >= alike * (sizes + sizes[i] - both)) & (part != part[i]))
                    pairs.append((np.full(len(j), i), j))
            least = least_labels(b - a, pairs)
            for y in np.flatnonzero(least != np.arange(b - a)).tolist():
                forest.join(c["h"][a + y], c["h"][a + int(least[y])])
        made = forest.edges()
        yield [x for x, _ in made], [y for _, y in made]

    return work


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, alike: float = ALIKE) -> DataFrame:
    """The rows of ``df``, all columns, of which one of each component stays: the least id, then the least hash of the text.

    Texts are linked within ``radius`` bits or at a likeness of ``alike``; rows without an
    id link like any other, and stay only if no row of the component has one.
    """
    keyed = df.select(packed(df).alias("row"), quoted(key).cast("long").alias("id"), F.xxhash64(quoted(text)).alias("h"), quoted(text).cast("string").alias("t"))
    small_batches(df.sparkSession)

    def run(batches):
        for keys, hashes, texts in batches:
            yield keys, hashes, np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64).tolist(), [bands(wide_shingles(t)) for t in texts]

    # only the choice outlives the step: what it was made from is deleted before the rows are read again
    with passing(df.sparkSession) as stays:
        prints, _ = materialise(map_columns(keyed.select("id", "h", "t"), "id long, h long, fp long, bands array<long>", run))
        nodes = prints.groupBy("fp").agg(F.min("h").alias("node"))
        equal = prints.select("h", "fp").distinct().join(nodes, "fp").where("h <> node").select(F.col("h").alias("a"), F.col("node").alias("b"))
        near = alike_links(prints.select("h", "bands"), keyed.select("h", "t"), alike)
        found = components(links(nodes, radius=radius).union(equal).union(near))
        first = prints.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("f"))
        best = first.join(found, first["h"] == found["node"], "left").groupBy(F.coalesce("component", "h").alias("group")).agg(F.min("f").alias("f")).select(F.col("f.id").alias("id"), F.col("f.h").alias("h"))
        # rows that repeat an id and a text: one stays
        again = prints.groupBy("id", "h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.lit(True).alias("again"))
        best = best.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left").select("id", "h", "again")
        best, path = materialise(best)
        stays.append(path)
    free_shuffles(df.sparkSession)
    rows = keyed.select("row", "id", "h")
    chosen = rows.join(best, rows["id"].eqNullSafe(best["id"]) & (rows["h"] == best["h"])).select("row", rows["id"], rows["h"], "again")
    once = chosen.where("again").dropDuplicates(["id", "h"])
    return unpacked(chosen.where("again is null").select("row").union(once.select("row")), df)
