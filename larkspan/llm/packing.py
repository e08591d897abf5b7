"""Packing documents into fixed windows (operator 2).

Method: order-preserving dynamic programming. Cuts may fall at document ends
(free), sentence ends (a small penalty) and, so that no long stretch is without
one, at least every ``STRIDE`` ids (a larger penalty). The cost of a window is
its padding plus the penalty of its cut plus ``OPEN`` for being one more window:

    f(p) = pen(p) + OPEN + 1024 - p + min over q in [p-1024, p) of (f(q) + q)

The minimum slides with p, so a monotone queue gives each transition in
amortised constant time. A window of exactly a power of two isn't padded, which
is a second, unpadded transition. What is left at the end of a partition is cut
into powers of two, so that it needs no padding.

Ids are those of the library ``tokenizers`` for its file of the vocabulary. Texts
that hold an added token are encoded by it; for all others the vocabulary is read
from the same file and applied by the word-remembering coder of ``bpe``, which
gives equal ids at half the cost (the tests compare them).

Each task packs the documents of its own input split in the order they are
stored: no shuffle, and no state but one buffer of about ``BUFFER`` ids (or one
document). Input splits are fixed by the files, so a rerun task packs alike.

Null and empty texts are the one id 0; repeated rows are packed each on its own;
a null id is kept as null; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from larkspan.llm.bpe import Coder as WordCoder
from larkspan.llm.common import map_columns, quoted, small_batches

WINDOW, STRIDE, BUFFER = 1024, 64, 1 << 16
SENTENCE, ANYWHERE, OPEN = 2, 12, 4


class Coder:
    """Encodes by a byte-level vocabulary file of ``tokenizers``."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("|".join(map(re.escape, added.values())) or "(?!)")
        # in the file's notation, a printable byte is its own sign; the others are the signs from U+0100 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(map(signs.__getitem__, t)): i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if i not in added}
        self.words = WordCoder(ranks, pattern)
        self.ids = max([*ranks.values(), *added]) + 1

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if text and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.words.encode(text)


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def sentence_ends(c: Coder) -> np.ndarray:
    """Whether an id ends a sentence: its bytes end in a stop mark or hold a line end."""
    out = np.zeros(c.ids, dtype=bool)
    for i, b in c.words.raw.items():
        out[i] = b.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or b"\n" in b
    return out


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of possible cuts, the buffer's ends included, and their penalties."""
    pen = np.full(len(ids) + 1, -1, dtype=np.int64)
    at = np.flatnonzero(ends[ids]) + 1
    pen[at] = SENTENCE
    pen[doc_ends] = 0
    pen[0] = 0
    known = np.flatnonzero(pen >= 0)
    gaps = np.diff(known)
    for i in np.flatnonzero(gaps > STRIDE):
        fill = np.arange(known[i] + STRIDE, known[i + 1], STRIDE)
        pen[fill] = ANYWHERE
    pos = np.flatnonzero(pen >= 0)
    return pos, pen[pos]


def cut(pos: list[int], pen: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest cuts from pos[0] to pos[-1]; any two neighbours are at most ``window`` apart."""
    n = len(pos)
    cost, back = [0] * n, [0] * n
    index = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(5, window.bit_length() - 1)]
    queue: deque[int] = deque([0])
    key = [pos[0]] + [0] * (n - 1)
    for i in range(1, n):
        p = pos[i]
        low = p - window
        while pos[queue[0]] < low:
            queue.popleft()
        j = queue[0]
        best, frm = key[j] + window - p, j
        for w in powers:
            if (k := index.get(p - w)) is not None and cost[k] < best:
                best, frm = cost[k], k
        best += pen[i] + OPEN
        cost[i], back[i] = best, frm
        v = key[i] = best + p
        while queue and key[queue[-1]] >= v:
            queue.pop()
        queue.append(i)
    out, i = [], n - 1
    while i:
        out.append(pos[i])
        i = back[i]
    return [pos[0], *out[::-1]]


def padding(length: int, window: int = WINDOW) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def pack(docs: Iterable[tuple], ends: np.ndarray, window: int = WINDOW, buffer: int = BUFFER) -> Iterator[tuple]:
    """Pieces of (key, ids) documents: key, start, length, crc32, doc_tokens, sequence, offset."""
    segments: list[tuple] = []  # key, first id's place in its document, ids, ids of the document
    held, sequence = 0, 0

    def flush(last: bool) -> Iterator[tuple]:
        nonlocal segments, held, sequence
        ids = np.concatenate([s[2] for s in segments])
        doc_ends = np.cumsum([len(s[2]) for s in segments])
        cuts = cut(*(x.tolist() for x in candidates(ids, doc_ends, ends)), window)
        if last:
            a, b = cuts[-2:]
            if padding(b - a, window):
                cuts.pop()
                while left := b - a:
                    a += 1 << (left.bit_length() - 1)
                    cuts.append(a)
        else:
            cuts.pop()  # the last window goes on in the next buffer
        starts = doc_ends - [len(s[2]) for s in segments]
        s = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = a
            while at < b:
                while doc_ends[s] <= at:
                    s += 1
                key, first, own, total = segments[s]
                to = min(b, int(doc_ends[s]))
                lo = at - int(starts[s])
                yield key, first + lo, to - at, zlib.crc32(own[lo : lo + to - at].tobytes()), total, sequence, at - a
                at = to
            sequence += 1
        rest, at = [], cuts[-1]
        for (key, first, own, total), st, en in zip(segments, starts, doc_ends, strict=True):
            if en > at:
                lo = max(0, at - int(st))
                rest.append((key, first + lo, own[lo:], total))
        segments, held = rest, len(ids) - at

    for key, ids in docs:
        segments.append((key, 0, ids, len(ids)))
        held += len(ids)
        if held >= buffer:
            yield from flush(False)
    if segments:
        yield from flush(True)


def pack_documents(df: DataFrame, file: str, pattern: str, text: str = "text", key: str = "doc_id", end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Pack all rows of ``df``; one row per piece.

    ``file``: a byte-level vocabulary of ``tokenizers``; ``pattern``: its pre-tokens. ``end_id`` closes each document. sequence_id holds
    the input split in its upper bits and a running number in the lower 32.
    """
    small_batches(df.sparkSession)

    def run(batches):
        c = coder(file, pattern)
        ends = sentence_ends(c)
        close = np.array([end_id], dtype="<u4").tobytes()
        high = TaskContext.get().partitionId() << 32
        docs = ((k, np.frombuffer(c.encode(t) + close, dtype="<u4")) for keys, texts in batches for k, t in zip(keys, texts, strict=True))
        rows = []
        for k, start, length, crc, total, seq, off in pack(docs, ends, window):
            rows.append((k, start, length, crc, total, high | seq, off))
            if len(rows) >= 5000:
                yield tuple(map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield tuple(map(list, zip(*rows, strict=True)))

    return map_columns(df.select(quoted(key).cast("long"), quoted(text).cast("string")), f'`{key}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long', run)
