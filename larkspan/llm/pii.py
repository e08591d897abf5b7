"""Personal data by a semi-Markov conditional random field (operator 7).

Base spans (email, ip, card, phone) follow fixed patterns with checks. The model
adds spans that the patterns miss, such as telephone numbers without a plus sign
or mail addresses written with "at" and "dot".

A region is a run of tokens around something that could be personal data: digit
groups with their separators, or an at sign or the word for it, with ``AROUND``
words on both sides. A segmentation of its tokens into labelled spans of at most
``LONGEST`` tokens and single other tokens is scored by the sum of whole-span
features (digits, groups, checks, length, words before). The bounded length keeps
the dynamic program linear in the region; it chooses boundaries and types jointly.
Weights come from the conditional likelihood (forward-backward) over regions
generated from a fixed seed, on the driver, once for a query: the tables carry no
marks of personal data to learn from. A span is added only where the best
segmentation holds it, its share of the forward-backward sum is at least ``SURE``,
and it touches no base span.

Every whole text is searched: mail addresses are found from their at sign, and what
is taken already by binary search, so the time is about linear. No shuffle. Null and empty texts have no spans; repeated rows give
repeated rows; rows with a null id are scanned like any other; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from larkspan.llm.common import map_columns, quoted, small_batches

KINDS = ("email", "ip", "card", "phone")
LONGEST, AROUND, SURE = 16, 3, 0.8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses: each at sign, its local part leftward, its domain rightward."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > low and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at)):
            out.append((0, a, m.end()))
            low = m.end()
            at = text.find("@", low)
        else:
            # a later address can't begin before this sign
            low = at + 1
            at = text.find("@", low)
    return out


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind, then start."""
    out = emails(text) if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return out


# --- the model -------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|\d+|_|[^\w\s]|\s+")
_NUMBER = re.compile(r"(?<![\w.])[(]?\d[\d().\-/ ]{6,40}\d(?!\w)")
_SPELLED = re.compile(r"(?:[(\[{]\s?at\s?[)\]}]|\sat\s)\s?[\w-]{1,64}\s?(?:[(\[{]\s?dot\s?[)\]}]|\sdot\s)", re.I)
_LAST_WORDS = re.compile(r"(?:\S+\s+){0,%d}\S*$" % AROUND)
_HINTS = ({"mail", "email", "contact", "write"}, {"ip", "host", "server", "address"}, {"card", "visa", "credit", "pay", "number"}, {"phone", "tel", "call", "fax", "mobile", "telephone"})
_AT, _DOT = re.compile(r"@|[(\[{ ]\s?at\s?[)\]} ]", re.I), re.compile(r"\.|[(\[{ ]\s?dot\s?[)\]} ]", re.I)
#: A mail address, and the ways to write its signs in words.
_ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_SAID_AT, _SAID_DOT = re.compile(r"\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s", re.I), re.compile(r"\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s", re.I)
N_FEATURES = 29


def features(tokens: list[tuple[str, int]], a: int, b: int) -> list[float]:
    """Whole-span features of tokens a to b (end exclusive)."""
    span = "".join(t for t, _ in tokens[a:b])
    groups = _DIGITS.findall(span)
    digits = "".join(groups)
    n, letters = len(digits), sum(map(str.isalpha, span))
    before = {t.lower() for t, _ in tokens[max(0, a - 2 * AROUND) : a] if t[0].isalpha()}
    marks = set(span) - set("0123456789") if not letters else set()
    ats, dots = len(_AT.findall(span)), len(_DOT.findall(span))
    edge = span[0].isspace() or span[-1].isspace() or span[-1] in "-.,;:!?(/" or span[0] in "-.,;:!?)/"
    ends_free = (b == len(tokens) or not tokens[b][0][0].isdigit()) and (a == 0 or not tokens[a - 1][0][0].isdigit())
    sizes = [len(g) for g in groups]
    return [
        1.0,
        float(edge),
        float(letters > 0),
        float(n == 0),
        float(7 <= n <= 15),
        float(9 <= n <= 11),
        float(n >= 13 and luhn(digits)),
        float(13 <= n <= 19),
        float(n > 19),
        float(len(groups) == 4 and all(int(g) <= 255 for g in groups) and span.count(".") == 3 and letters == 0),
        float(bool(marks & set("()"))),
        float(marks <= set(" -().+") and len(groups) >= 3 and n > 0),
        float(sizes[:3] in ([3, 3, 4], [3, 4], [3, 4, 4])),
        float(len(sizes) == 3 and sizes[0] == 4 and sizes[1:] == [2, 2]),
        float("/" in span),
        float("." in marks),
        float(len(groups) == 1 and n == len(span)),
        float(ats == 1 and letters > 2 and dots >= 1),
        float(ats != 1 or dots == 0),
        float(ends_free),
        float((a == 0 or tokens[a - 1][0][0].isspace()) and (b == len(tokens) or tokens[b][0][0] in " \t\n.,;:!?)")),
        float(ats == 1 and dots >= 1 and span[0].isalnum() and span[-1].isalnum()),
        float(0 < n < 7),
        float(ats == 1 and bool(_ADDRESS.fullmatch(_SAID_DOT.sub(".", _SAID_AT.sub("@", span))))),
        float(letters == 0 and sizes in ([3, 3, 4], [3, 4, 4]) and ends_free),
        *(float(bool(before & h)) for h in _HINTS),
    ]


def tokens_of(text: str, a: int, b: int) -> list[tuple[str, int]]:
    return [(m[0], m.start()) for m in _TOKEN.finditer(text, a, b)]


def potentials(tokens: list[tuple[str, int]], w: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """All spans up to ``LONGEST`` tokens, their features, and their scores by kind."""
    spans = [(a, b) for a in range(len(tokens)) if not tokens[a][0].isspace() for b in range(a + 1, min(len(tokens), a + LONGEST) + 1)]
    phi = np.array([features(tokens, a, b) for a, b in spans]).reshape(len(spans), N_FEATURES)
    return spans, phi, phi @ w.T


def forward_backward(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log of the sum over segmentations, and each labelled span's share of it. A token outside spans scores 0."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for i, (_, b) in enumerate(spans):
        into[b].append(i)
    best = np.logaddexp.reduce(scores, axis=1) if len(spans) else np.zeros(0)
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for p in range(1, n + 1):
        alpha[p] = np.logaddexp.reduce([alpha[p - 1], *(alpha[spans[i][0]] + best[i] for i in into[p])])
    for p in range(n, 0, -1):
        beta[p - 1] = np.logaddexp(beta[p - 1], beta[p])
        for i in into[p]:
            beta[spans[i][0]] = np.logaddexp(beta[spans[i][0]], best[i] + beta[p])
    a, b = (np.array(x, dtype=int) for x in zip(*spans, strict=True)) if spans else (np.zeros(0, int),) * 2
    return alpha[n], np.exp(alpha[a][:, None] + scores + beta[b][:, None] - alpha[n])


def best_path(n: int, spans: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(span, kind) of the best segmentation."""
    into: list[list[int]] = [[] for _ in range(n + 1)]
    for i, (_, b) in enumerate(spans):
        into[b].append(i)
    value, back = [0.0] * (n + 1), [None] * (n + 1)
    for p in range(1, n + 1):
        value[p] = value[p - 1]
        for i in into[p]:
            k = int(scores[i].argmax())
            if (v := value[spans[i][0]] + scores[i, k]) > value[p]:
                value[p], back[p] = v, (i, k)
    out, p = [], n
    while p:
        if back[p] is None:
            p -= 1
        else:
            out.append(back[p])
            p = spans[back[p][0]][0]
    return out[::-1]


def _generated(rnd: random.Random) -> tuple[str, list[Span]]:
    """A region and its personal data."""
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuv") for _ in range(rnd.randint(2, 8)))

    def card() -> str:
        x = rnd.choice("3456") + d(14)
        x += next(c for c in "0123456789" if luhn(x + c))
        return rnd.choice([x, f"{x[:4]} {x[4:8]} {x[8:12]} {x[12:]}", f"{x[:4]}-{x[4:8]}-{x[8:12]}-{x[12:]}", f"{x[:4]}.{x[4:8]}.{x[8:12]}.{x[12:]}"])

    phone = lambda: rnd.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}"])
    at, dot = rnd.choice([(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", ".")])
    email = lambda: f"{word()}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net'])}"
    ip = lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    other = lambda: rnd.choice([f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", d(rnd.randint(7, 20)), f"{d(1)}.{d(2)}.{d(3)}", f"{d(3)},{d(3)},{d(3)}", f"{d(4)} {d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{word()} at {word()}. {word()}", f"{d(5)}-{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"])
    k = rnd.randrange(8)
    value = (email, ip, card, phone)[k]() if k < 4 else other()
    hint = rnd.choice(sorted(_HINTS[k])) + " " if k < 4 and rnd.random() < 0.3 else ""
    left = " ".join(word() for _ in range(rnd.randint(0, AROUND)))
    left = f"{left} {hint}".lstrip()
    text = f"{left}{value}{rnd.choice(['', '.', ',', ''])} {word()} {word()}"
    return text, [(k, len(left), len(left) + len(value))] if k < 4 else []


@lru_cache(maxsize=1)
def train(seed: int = 7, regions: int = 320, epochs: int = 40) -> np.ndarray:
    """Weights (kind, feature) by AdaGrad on the conditional log-likelihood; the same for every run."""
    rnd, w = random.Random(seed), np.zeros((len(KINDS), N_FEATURES))
    squares = np.full_like(w, 1e-2)
    made = []
    for _ in range(regions):
        text, gold = _generated(rnd)
        tokens = tokens_of(text, 0, len(text))
        starts = {s: i for i, (_, s) in enumerate(tokens)}
        ends = {s + len(t): i + 1 for i, (t, s) in enumerate(tokens)}
        spans, phi, _ = potentials(tokens, w)
        index = {s: i for i, s in enumerate(spans)}
        target = [(index[x], k) for k, a, b in gold if (x := (starts.get(a), ends.get(b))) in index]
        if len(target) == len(gold):
            made.append((len(tokens), spans, phi, target))
    for _ in range(epochs):
        for n, spans, phi, target in made:
            _, share = forward_backward(n, spans, phi @ w.T)
            g = -(share.T @ phi)
            for i, k in target:
                g[k] += phi[i]
            g -= 1e-3 * w
            squares += g * g
            w += 0.5 * g / np.sqrt(squares)
    return w


def added_spans(text: str, base: list[Span], w: np.ndarray) -> list[Span]:
    """Spans of the model that touch no base span."""
    out: list[Span] = []
    # what is taken, without overlaps, so that both ends are sorted
    begins: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            begins.append(a)
            ends.append(b)
    regions = [m.span() for m in _NUMBER.finditer(text)] + [m.span() for m in _SPELLED.finditer(text)]
    for start, end in sorted(regions):
        i = bisect_right(ends, start)  # those before i end at or before the region
        if i < len(begins) and begins[i] < end:
            continue
        low = max(0, start - 80)
        lo = max(low + _LAST_WORDS.search(text[low:start]).start(), ends[i - 1] if i else 0)
        hi = min(len(text), end + 30, begins[i] if i < len(begins) else len(text))
        tokens = tokens_of(text, lo, hi)
        spans, _, scores = potentials(tokens, w)
        _, share = forward_backward(len(tokens), spans, scores)
        for x, k in best_path(len(tokens), spans, scores):
            if share[x, k] >= SURE:
                a, b = spans[x]
                s, e = tokens[a][1], tokens[b - 1][1] + len(tokens[b - 1][0])
                j = bisect_right(ends, s)
                if j == len(begins) or begins[j] >= e:
                    begins.insert(j, s)
                    ends.insert(j, e)
                    out.append((k, s, e))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts of the base kinds, base_sha256, spans."""
    small_batches(df.sparkSession)
    w = train()

    def run(batches):
        for keys, texts in batches:
            bases = [base_spans(t) if t else [] for t in texts]
            every = [b + added_spans(t, b, w) if t else [] for t, b in zip(texts, bases, strict=True)]
            counts = [[sum(s[0] == k for s in b) for b in bases] for k in range(len(KINDS))]
            yield keys, *counts, [hashlib.sha256(written(b).encode()).hexdigest() for b in bases], [written(s) for s in every]

    return map_columns(df.select(quoted(key).cast("long"), quoted(text).cast("string")), f"`{key}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", run)
