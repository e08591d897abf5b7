"""Edit distances that Spark lacks, as Arrow UDFs.

All pairs of a batch are walked together: each step of the dynamic program is a few
operations on whole columns. Use them on distinct pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, a row each, and their numbers."""
    n = np.array(list(map(len, texts)), dtype=np.int64)
    out = np.full((len(texts), int(n.max(initial=1))), fill, dtype=np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = list(map(ord, t))
    return out, n


def damerau_all(a: list[str], b: list[str]) -> np.ndarray:
    """Unrestricted edit distances with transpositions (Lowrance and Wagner 1975) of the pairs."""
    x, n = _padded(a, -1)
    y, m = _padded(b, -2)
    rows = np.arange(len(a))
    far = x.shape[1] + y.shape[1] + 1
    # d[:, i + 1, j + 1]: first i signs against first j; the borders are out of reach
    d = np.full((len(a), x.shape[1] + 2, y.shape[1] + 2), far, dtype=np.int64)
    d[:, 1:, 1] = np.arange(x.shape[1] + 1)
    d[:, 1, 1:] = np.arange(y.shape[1] + 1)
    seen = np.zeros((len(a), y.shape[1]), dtype=np.int64)  # where the sign b[j] last stood in a
    for i in range(1, x.shape[1] + 1):
        last = np.zeros(len(a), dtype=np.int64)  # where a[i] last stood in b
        for j in range(1, y.shape[1] + 1):
            same = x[:, i - 1] == y[:, j - 1]
            k = seen[:, j - 1]
            swap = d[rows, k, last] + (i - k - 1) + 1 + (j - last - 1)
            d[:, i + 1, j + 1] = np.minimum(np.minimum(d[:, i, j] + ~same, np.minimum(d[:, i + 1, j], d[:, i, j + 1]) + 1), swap)
            last = np.where(same, j, last)
        seen = np.where(x[:, i - 1 : i] == y, i, seen)
    return d[rows, n + 1, m + 1]


def damerau(a: str, b: str) -> int:
    return int(damerau_all([a], [b])[0])


def jaro_winkler_all(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarities: prefix of 4 at most, scale 0.1, only above 0.7."""
    x, n = _padded(a, -1)
    y, m = _padded(b, -2)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    at = np.arange(y.shape[1])
    used = np.zeros(y.shape, dtype=bool)
    mine = np.zeros(x.shape, dtype=bool)
    for i in range(x.shape[1]):
        ok = (y == x[:, i : i + 1]) & ~used & (np.abs(at - i) <= reach[:, None])
        hit = np.flatnonzero(ok.any(axis=1))
        used[hit, ok[hit].argmax(axis=1)] = True
        mine[hit, i] = True
    found = mine.sum(axis=1)
    # matched signs of both, in order, moved to the front
    front = lambda z, keep: np.take_along_axis(np.where(keep, z, 0), np.argsort(~keep, axis=1, kind="stable"), axis=1)
    width = min(x.shape[1], y.shape[1])
    swaps = (front(x, mine)[:, :width] != front(y, used)[:, :width]).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(found > 0, (found / n + found / m + (found - swaps) / found) / 3, 0.0)
    prefix = np.cumprod(x[:, : min(4, width)] == y[:, : min(4, width)], axis=1).sum(axis=1) if width else np.zeros(len(a))
    out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where((n == 0) & (m == 0), 1.0, out)


def jaro_winkler(a: str, b: str) -> float:
    return float(jaro_winkler_all([a], [b])[0])


def _pairs(a: pd.Series, b: pd.Series, f, kind: str) -> pd.Series:
    out = pd.Series([None] * len(a), dtype=kind)
    ok = (a.notna() & b.notna()).to_numpy()
    # pairs of like length are walked together
    order = np.flatnonzero(ok)[np.argsort((a[ok].str.len() + b[ok].str.len()).to_numpy(), kind="stable")]
    for i in range(0, len(order), 1000):
        at = order[i : i + 1000]
        out.iloc[at] = f(a.iloc[at].tolist(), b.iloc[at].tolist())
    return out


@pandas_udf(LongType())
def damerau_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(a, b, damerau_all, "Int64")


@pandas_udf(DoubleType())
def jaro_winkler_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - similarity."""
    return 1 - _pairs(a, b, jaro_winkler_all, "float64")
