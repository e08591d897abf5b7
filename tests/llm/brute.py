"""Plain versions that the operators are held against, and a table of odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, "one two three", "en", "s", 13),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "one two three", "en", "s", 13),
    (4, "one two three", "en", "s", 13),
    (5, " \t\n", "en", "s", 3),
    (6, " ".join(f"w{i}" for i in range(120)), "en", "s", 1),
    (7, "x " + " ".join(f"w{i}" for i in range(30, 110)) + " y", "en", "s", 1),
    (8, " ".join(f"w{i}" for i in range(49)), "en", "s", 1),
    (None, " ".join(f"w{i}" for i in range(120)), "en", "s", 1),
    (10, "a" * 70000 + " " + "b é 中 😀 " * 3000, "en", "s", 1),
    (11, "the cat. " * 4000, "en", "s", 1),
    (12, "the cat. " * 4000 + "end", "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_components(rows):
    f = {d: simhash(t) for d, t in rows}
    ids = sorted(f)
    a = np.array([f[i] for i in ids], dtype=np.uint64)
    pairs = []
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3):
            pairs.append((ids[i], ids[i + 1 + j]))
    r = roots(ids, pairs)
    return sorted((d, f"{f[d]:016x}", r[d]) for d in ids)


def near_firsts(rows, size=5, alike=0.8):
    """The least ids of groups linked within 3 bits, or by a Jaccard coefficient of word shingles."""
    sets, at = {}, defaultdict(list)
    for d, t in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        for s in sets[d]:
            at[s].append(d)
    met = {(a, b) for own in at.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    pairs = [(a, b) for a, b in met if len(sets[a] & sets[b]) >= alike * len(sets[a] | sets[b])]
    pairs += [(d, c) for d, _, c in simhash_components(rows) if d != c]
    return set(roots(sets, pairs).values())


def vector_components(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, dtype=np.float64))
    n, pairs, ids = defaultdict(int), [], sorted(good)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            (la, a), (lb, b) = good[ids[x]], good[ids[y]]
            if la == lb and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                pairs.append((ids[x], ids[y]))
                n[ids[x]] += 1
                n[ids[y]] += 1
    r = roots([i for i, _, _ in rows], pairs)
    return sorted((i, n[i], r[i], r[i] == i) for i, _, _ in rows)


def repeats(rows, size=50):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - size + 1):
                if first[tuple(w[i : i + size])] < d:
                    gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)
