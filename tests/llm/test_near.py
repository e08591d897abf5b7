"""Operators 4, 5 and 9 against brute force, on odd rows and on a driver table."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from larkspan.llm import common, passages, pivots, simhash
from larkspan.llm.common import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.ODD, brute.SCHEMA)


def documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = brute.roots({x for p in pairs for x in p}, pairs)
    assert got == {k: v for k, v in want.items() if any(k in p for p in pairs if p[0] != p[1])}


def test_close_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    p = np.concatenate([base, *(base ^ np.uint64(x) for x in (1, 3, 7, 15, 1 << 63))])
    for radius in (1, 2, 3):
        want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if bin(int(p[i] ^ p[j])).count("1") <= radius}
        got = {(int(a), int(b)) for i, j in simhash.close_pairs(p, np.zeros(len(p), dtype=int), radius) for a, b in zip(i, j)}
        assert got == want


def test_simhash(spark, odd):
    d, rows = documents(spark)
    got = simhash.near_duplicates(d)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == brute.simhash_components(rows)
    rows = sorted(set((r[0], r[1]) for r in brute.ODD if r[0]))
    assert sorted({tuple(r) for r in simhash.near_duplicates(odd.withColumns({"fp": F.lit(1), "key": F.lit(2)})).where("doc_id is not null").collect()}) == brute.simhash_components(rows)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_simhash_hot_key(spark):
    rng = random.Random(5)
    prints = {0xABCDEF0123456789 ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (0, 1, 2, 3, 4, 5, 6) for _ in range(60)}
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(signed, "fp long, node long")
    got = {r.node: r.component for r in components(simhash.links(df, block=16)).collect()}
    a = sorted(prints)
    pairs = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(a[i] ^ a[j]).count("1") <= 3]
    want = brute.roots(range(len(a)), pairs)
    assert {i: got.get(i, i) for i in range(len(a))} == want


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    for i, n in simhash.overlaps(sets, np.arange(30)):
        assert n.tolist() == [len(np.intersect1d(sets[i], s)) for s in sets]


@pytest.mark.parametrize("block", [1024, 16])
def test_alike_in_blocks(spark, block):
    """One bucket for very many texts of which few are alike: links between any two are found, in blocks too."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(70):
        w = list(base)
        for i in rnd.sample(range(60), rnd.choice((0, 1, 3, 6))):
            w[i] = f"x{rnd.randint(0, 9)}"
        rows.append((k, " ".join(w)))
    sets = {h: {tuple(t.split()[i : i + 5]) for i in range(56)} for h, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    texts = spark.createDataFrame(rows, "h long, t string")
    prints = texts.select("h", F.array(F.lit(7), F.col("h") % 3).cast("array<long>").alias("bands"))
    got = {r.node: r.component for r in components(simhash.alike_links(prints, texts, block=block)).collect()}
    assert {h: got.get(h, h) for h in sets} == brute.roots(sets, pairs)
    assert len(pairs) < 70 * 69 / 2


def test_keep_one_alike(spark):
    rnd = random.Random(8)
    rows = []
    for g in range(40):
        w = [f"g{g}x{rnd.randint(0, 10**6)}" for _ in range(200)]
        rows.append((len(rows), " ".join(w)))
        for edits in (3, 6, 20):  # Jaccard about 0.86 and 0.74, then 0.4
            v = list(w)
            for i in range(edits):
                v[10 + i * (180 // edits)] = f"e{rnd.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(v)))
    w = [f"h{i}" for i in range(200)]  # a chain: each is like the next only, and all are in few buckets
    for _ in range(12):
        rows.append((len(rows), " ".join(w)))
        w[rnd.randrange(200)] = f"h{rnd.randint(1000, 10**6)}"
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(196)} for d, t in rows}
    prints = {d: brute.simhash(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) or (prints[a] ^ prints[b]).bit_count() <= 3)]
    want = set(brute.roots(sets, pairs).values())
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(want) < len(rows) - 40
    clashing = {c: F.col("doc_id") for c in ("_id", "_h", "id", "h", "row", "t", "again", "a.b")}
    more = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing)
    kept = simhash.keep_one(more)
    assert kept.columns == more.columns
    kept = kept.collect()
    assert {r.doc_id for r in kept} == want and all(r[c] == r.doc_id for r in kept for c in clashing)
    nameless = spark.createDataFrame([(None, t) for _, t in rows[:2]], "doc_id long, text string")
    assert simhash.keep_one(nameless).count() == 1


def test_keep_one_leaves_its_choice_only(spark):
    """Near-dedup reads the texts twice and the rows once, and leaves one scratch table of ids and hashes, so that later stages have the disk."""
    rnd = random.Random(9)
    rows = []
    for _ in range(30):
        w = [f"x{rnd.randint(0, 10**6)}" for _ in range(120)]
        rows += [(len(rows) + i, " ".join([*w[:60], f"y{i}", *w[60:]])) for i in range(3)]
    rows += [rows[0], rows[0], (len(rows), "alone")]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(seen, "doc_id long, text string")
    before, limit = set(common._WRITTEN), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one(docs)
        assert read.value == 2 * len(rows)
        left = set(common._WRITTEN) - before
        assert [set(spark.read.parquet(p).columns) for p in left] == [{"id", "h", "again"}]
        for _ in range(2):
            assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 90, 3), rows[-1][0]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(14):
            rows.append((len(rows), [float(x) for x in np.float32(centre + rng.normal(size=16) * 0.09)], c % 3))
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] + [1.0] * 15, 1), (1004, [], 1), (1005, rows[0][1], None), (1006, rows[0][1], 0), (1007, rows[0][1], 0), (1008, [1.0, 2.0], 0), (1009, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("x"))
    got = pivots.near_vectors(df, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = sorted(map(tuple, got.collect())), brute.vector_components(rows)
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) > 0
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert pivots.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [3000, 9000])
def test_vectors_recall(spark, n):
    """More vectors than pivots, many pairs just above the threshold: recall, and candidates that grow as the vectors."""
    rng = np.random.default_rng(n)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    a = unit(rng.normal(size=(n // 2, 32)))
    w = rng.normal(size=a.shape)
    w = unit(w - (w * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.975, 0.99, size=(n // 2, 1))
    m = np.float32(np.vstack([a, cos * a + np.sqrt(1 - cos**2) * w]))
    d = m.astype(np.float64)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    want = np.zeros(n, dtype=int)
    for i in range(0, n, 1000):
        want[i : i + 1000] = (d[i : i + 1000] @ d.T >= 0.98).sum(axis=1) - 1
    assert pivots.pivot_number(n) < n / 10
    got = pivots.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>, label int"))
    got = np.array([r.n_links for r in got.orderBy("vec_id").collect()])
    assert (got <= want).all()
    print(n, "recall", got.sum() / want.sum(), want.sum())
    assert got.sum() >= 0.97 * want.sum() > 0.3 * n
    keys = np.sort(pivots.lists(pivots.permutations(d, d[: pivots.pivot_number(n)])), axis=None)
    sizes = np.diff(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]))
    assert (sizes * (sizes - 1) // 2).sum() < 200 * n


def crowded(n=900, share=3, size=64, seed=4):
    """One row in ``share`` is a near copy of one vector (pairwise cosine about 0.985); of the others, some have a near copy."""
    rng = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    group = unit(rng.normal(size=size)) + unit(rng.normal(size=(n // share, size))) * 0.123
    rest = unit(rng.normal(size=(n - n // share, size)))
    rest[:50] = rest[50:100] + unit(rng.normal(size=(50, size))) * 0.15
    return [(i, v, 0) for i, v in enumerate(np.float32(np.vstack([group, rest])).tolist())]


def test_vectors_crowd(spark):
    rows = crowded()
    got = sorted(map(tuple, pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    want = brute.vector_components(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    for part in (slice(0, 300), slice(300, None)):
        assert sum(g[1] for g in got[part]) >= 0.9 * sum(w[1] for w in want[part]) > 0


def test_vectors_driver_table(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [tuple(r) for r in d.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, pivots.near_vectors(d).collect())) == brute.vector_components(rows)


def result9(df):
    k = passages.remove_repeats(df, counts=("n_words", "n_removed"))
    return sorted(map(tuple, k.select("doc_id", "n_words", "n_removed", F.sha2("text", 256)).collect()), key=repr)


def test_passages(spark, odd):
    d, rows = documents(spark)
    assert result9(d) == brute.repeats(rows)
    clashing = {c: F.col("doc_id") for c in ("_spots", "_id", "_hash", "_n_words", "shard", "first", "row", "id", "t", "a.b")}
    more = odd.withColumns(clashing)
    assert result9(more) == brute.repeats([(r[0], r[1]) for r in brute.ODD])
    assert passages.remove_repeats(odd.limit(0)).count() == 0
    kept = passages.remove_repeats(more)
    assert kept.columns == more.columns
    assert all(r[c] == r["doc_id"] for r in kept.collect() for c in clashing)
    with pytest.raises(ValueError):
        passages.remove_repeats(more, counts=("_n_words", "n"))


def test_passages_are_found_by_the_automaton():
    """Only what the automaton finds is covered."""
    p = passages.Phrases()
    own = [b"w%d" % i for i in range(200)]
    texts = passages.Words(pa.array([b"x " + b"\t".join(own) + b" ", b"", b" ".join(own[:90])]))
    covered = lambda key: {i: np.flatnonzero(m).tolist() for i, m in p.covered(texts, texts.hashes(), [key] * 3).items()}
    p.add(b" ".join(own[20:80]), 3, None)
    p.add(b" ".join(own[100:160]), 5, [0, 10])
    assert covered(6) == {0: [*range(21, 81), *range(101, 161)], 2: [*range(20, 80)]}
    assert covered(5) == {0: [*range(21, 81)], 2: [*range(20, 80)]}
    assert covered(3) == covered(None) == {}
    p.first.clear()
    assert covered(6) == {}


def test_passages_random(spark):
    rnd = random.Random(11)
    pool = [[f"p{k}x{i}" for i in range(rnd.randint(40, 160))] for k in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rnd.randint(1, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) // 2)
            w += p[a : a + rnd.randint(30, 120)]
            if rnd.random() < 0.5:
                w += [f"u{rnd.randint(0, 3)}" for _ in range(rnd.randint(0, 60))]
        rows.append((d, " ".join(w)))
    assert result9(spark.createDataFrame(rows, "doc_id long, text string")) == brute.repeats(rows)
