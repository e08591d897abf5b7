"""Quality classifier from weak labels (operator 3).

``LABELLERS`` are overlapping heuristics that each vote good (1), bad (-1) or
nothing (0) on a text. Their votes are counted by pattern over all documents (at
most 3 ** len(LABELLERS) rows, whatever the input), and expectation-maximisation
on that table estimates how each labeller votes on good and on bad documents
(Dawid and Skene 1979) and the share of good ones. The posterior of a
pattern is the soft label that trains a hashed linear scorer (logistic
regression on word shapes, common words and repetition) on at most ``SAMPLE``
documents, chosen by the hash of their text. The scorer then judges every
document. Hand-made labels are never used; they measure accuracy in the tests.

Only the pattern counts and the bounded sample's features reach the driver. No
shuffle but that of the counts.

Null, empty and blank texts have score 0 and are rejected; equal texts have equal
scores; an empty table gives an empty result; all other columns are kept.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache, partial
from operator import and_, eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspan.llm.common import fresh, map_columns, quoted, small_batches
from larkspan.llm.spotsigs import ANCHORS

#: Documents that the scorer is fitted on, at most; buckets of the hashed features.
SAMPLE, BUCKETS = 20_000, 1 << 14
#: Documents with this score and more are accepted.
KEEP = 0.5
LABELLERS = ("symbols", "capitals", "repeats", "runs", "variety", "bare marks", "common words", "sentences", "word length")
#: Marks of ordinary prose; all other marks are symbols.
_PROSE = ".,;:!?'\"()-–—«»„“”‘’¿¡/@_"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """A byte for each code point: A, a, 0, a blank, or the mark (beyond ASCII: ~ for prose, ^ for symbols)."""
    out = np.full(0x110000, ord("^"), dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 65 if c.isupper() else 97
        elif c.isspace():
            out[i] = 32
        elif c.isdigit():
            out[i] = 48
        elif i < 128:
            out[i] = i if i > 32 else 94
        elif c in _PROSE:
            out[i] = 126
    return out


_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter or digit, 2 symbol, 3 stop mark, 4 blank
_KIND[list(b"Aa0")] = 1
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in _PROSE + "~"]] = 2
_KIND[list(b".!?")] = 3
_KIND[32] = 4


def shapes(text: str) -> tuple[Counter, int, int, int, int]:
    """Word shapes with their numbers; letters, capitals, symbols and stop marks of the text.

    A shape has runs of letters and digits as one sign each and marks as they are.
    """
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    raw = c.tobytes()
    kinds = raw.translate(_KIND.tobytes())
    keep = np.frombuffer(kinds, dtype=np.uint8) != 1
    keep[1:] |= c[1:] != c[:-1]
    keep[:1] = True
    n = [kinds.count(k) for k in (1, 2, 3)]
    return Counter(c[keep].tobytes().split()), n[0] - raw.count(b"0"), raw.count(b"A"), n[1], n[2]


def _vote(x: float, bad: float, good: float) -> int:
    """Bad beyond ``bad``, good up to ``good`` (bad > good), or the other way round."""
    return (-1 if x > bad else 1 if x <= good else 0) if bad > good else (-1 if x < bad else 1 if x >= good else 0)


def describe(text: str) -> tuple[list[int], Counter, int]:
    """Votes, counts of features, words."""
    words = text.lower().split()
    n = len(words)
    counts = Counter(words)
    same = list(map(eq, words, words[1:]))
    repeats = sum(same)
    # three times the same word on end, and more
    runs = sum(map(and_, same, same[1:])) if repeats > 1 else 0
    found, letters, capitals, symbols, stops = shapes(text)
    features: Counter = Counter()
    bare = 0
    for s, v in found.items():
        features[s[:12].decode()] += v
        if s[0] not in b"Aa0" and not any(x in s for x in (b"A", b"a", b"0")):
            bare += v
    common = 0
    for w in ANCHORS & counts.keys():
        common += counts[w]
        features[f"={w}"] = counts[w]
    features["<again>"], features["<run>"] = repeats, runs
    # a share of new words that falls with length even in good texts
    variety = len(counts) / n**0.8
    features["<few words>"] = n if variety < 0.4 and n >= 20 else 0
    votes = [
        _vote(symbols / n, 0.25, 0.02),
        _vote(capitals / max(1, letters), 0.4, 0.12),
        _vote(repeats / n, 0.15, 0.03) if n >= 5 else 0,
        _vote(runs / n, 0.1, 0.01) if n >= 5 else 0,
        _vote(variety, 0.4, 0.7) if n >= 20 else 0,
        _vote(bare / n, 0.15, 0.02),
        _vote(common / n, 0.04, 0.12) if n >= 20 else 0,
        _vote(stops / n, 0.6, 0.4) if n >= 5 else 0,
        _vote(letters / n, 14, 9) if n >= 5 else 0,
    ]
    return votes, features, n


@lru_cache(maxsize=100_000)
def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature)


def hashed(features: Counter, n: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for f, v in features.items():
        if not v:
            continue
        h = _hash(f)
        i = h % BUCKETS
        out[i] = out.get(i, 0.0) + (1 if h >> 31 else -1) * (v / n) ** 0.5
    return out


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the estimated accuracy of each labeller.

    patterns: rows of votes. A vote that isn't given says nothing. Labellers look for
    different faults, so the start takes a text for bad that any of them calls bad.
    """
    post = np.where((patterns < 0).any(axis=1), 0.1, np.where((patterns > 0).any(axis=1), 0.95, 0.5))
    one_hot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(float)  # pattern, labeller, vote
    weight = counts / counts.sum()
    for _ in range(rounds):
        prior = np.clip((weight * post).sum(), 0.02, 0.98)
        table = []
        for w in (weight * post, weight * (1 - post)):
            t = np.einsum("p,pjv->jv", w, one_hot) + 1e-4
            table.append(t / t.sum(axis=1, keepdims=True))
        odds = np.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", one_hot, np.log(table[0]) - np.log(table[1]))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-7:
            break
        post = new
    right = np.einsum("p,pj->j", weight * post, patterns == 1) + np.einsum("p,pj->j", weight * (1 - post), patterns == -1)
    voted = np.einsum("p,pj->j", weight, patterns != 0)
    return post, right / np.maximum(voted, 1e-12)


def fit_scorer(rows: list[dict[int, float]], labels: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated full gradients with a small L2 term."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.array([i for r in rows for i in r], dtype=np.int64)
    val = np.array([v for r in rows for v in r.values()])
    w, bias, vw, vb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0
    n = max(1, len(rows))
    for _ in range(rounds):
        z = np.bincount(at, weights=val * (w + 0.9 * vw)[col], minlength=len(rows)) + bias + 0.9 * vb
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        vw = 0.9 * vw - 2.0 * (np.bincount(col, weights=val * g[at], minlength=BUCKETS) / n + 1e-5 * w)
        vb = 0.9 * vb - 2.0 * g.mean()
        w, bias = w + vw, bias + vb
    return w, bias


class Model:
    def __init__(self, weights: np.ndarray, bias: float, accuracy: dict[str, float]) -> None:
        self.weights, self.bias, self.accuracy = weights, bias, accuracy

    def score(self, text: str | None) -> float:
        if not text or text.isspace():
            return 0.0
        _, features, n = describe(text)
        z = self.bias + sum(v * self.weights[i] for i, v in sorted(hashed(features, n).items()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model | None:
    """None where there is nothing to fit on."""
    small_batches(df.sparkSession)
    texts = df.select(quoted(text).cast("string").alias("t")).where("trim(t) <> ''")

    def vote(batches):
        for (ts,) in batches:
            yield ([",".join(map(str, describe(t)[0])) for t in ts if not t.isspace()],)

    counted = map_columns(texts, "votes string", vote).groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not counted:
        return None
    patterns = np.array([[int(v) for v in r.votes.split(",")] for r in counted])
    counts = np.array([r.n for r in counted], dtype=float)
    post, accuracy = fit_labellers(patterns, counts)
    soft = {r.votes: p for r, p in zip(counted, post.tolist(), strict=True)}
    share = min(1.0, sample / counts.sum())
    # equal texts have equal hashes: the sample is one of texts, bounded by its share and, for heaps of copies, by one row a text
    chosen = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1))

    def features(batches):
        for (ts,) in batches:
            made = [(t, *describe(t)) for t in ts if not t.isspace()]
            hs = [sorted(hashed(f, n).items()) for _, _, f, n in made]
            yield [",".join(map(str, v)) for _, v, _, _ in made], [xxhash.xxh64_intdigest(t) >> 1 for t, *_ in made], [[i for i, _ in h] for h in hs], [[v for _, v in h] for h in hs]

    described = map_columns(chosen, "votes string, h long, i array<int>, v array<double>", features)
    rows = described.groupBy("h").agg(F.first("votes").alias("votes"), F.first("i").alias("i"), F.first("v").alias("v")).orderBy("h").limit(sample).collect()
    w, bias = fit_scorer([dict(zip(r.i, r.v, strict=True)) for r in rows], np.array([soft[r.votes] for r in rows]))
    return Model(w, bias, dict(zip(LABELLERS, accuracy.tolist(), strict=True)))


def _score(batches, model: Model | None, text: int, schema: pa.Schema):
    for b in batches:
        scores = [model.score(t) if model else 0.0 for t in b.columns[text].to_pylist()]
        made = [*b.columns, pa.array(scores, type=pa.float64())]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def scored(df: DataFrame, text: str = "text", sample: int = SAMPLE, name: str = "score") -> DataFrame:
    """All columns of ``df``, then ``name``: the probability that the text is good."""
    if name in df.columns:
        raise ValueError(f"column exists: {name}")
    model = fit(df, text, sample)
    out = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    # by place, so that any name will do
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.mapInArrow(partial(_score, model=model, text=df.columns.index(text), schema=to_arrow_schema(out)), out)


def accepted(df: DataFrame, text: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``df`` whose text is scored ``least`` or more."""
    (name,) = fresh(df, "score")
    return scored(df, text, name=name).where(F.col(name) >= least).select(*map(quoted, df.columns))
