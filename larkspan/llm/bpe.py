"""Byte-level BPE: chunked pre-tokenisation, encoding and decoding (operator 6).

Method: a long text is cut into overlapping chunks that are pre-tokenised on
their own; neighbours are stitched at the first pre-token boundary that both
find in their overlap, and the pieces are encoded one by one. The pattern has no
look-behind, so once two streams share a boundary they agree from there on; a
match that ends short of the chunk's end has seen all that decides it. Where no
boundary is shared (one huge run), the chunk simply grows. Decoding concatenates
the raw bytes of the ids.

Inside a piece, a word with its leading space is always whole pre-tokens, so its
ids are remembered and looked up when the word comes again.

Null and empty texts have no ids; repeated rows give repeated rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame

from larkspan.llm.common import map_columns, quoted, small_batches

#: Characters of a chunk and of what two chunks share.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: Words remembered by a worker, the first so many that it meets; frequent ones come early.
REMEMBERED = 600_000
_TWO_SPACES = re.compile(r"\s\s")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Coder:
    """Encodes and decodes by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.raw = {b: a for a, b in ranks.items()}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(self.raw) + 1, dtype=np.int64)
        for i, x in self.raw.items():
            self.length[i] = len(x)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens of text[start:end], matched as if nothing followed."""
        return [m.end() for m in self.pattern.finditer(text, start, end)]

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """Cut a text where pre-tokens end, by overlapping chunks."""
        if len(text) <= chunk:
            return [text]
        cuts, start = [0], 0
        while start + chunk < len(text):
            end, shared = start + chunk, overlap
            while True:
                # what the left chunk finds in the overlap; its last characters lack their context
                left = self.boundaries(text, self.resync(text, start, end - shared), end)
                sure = {p for p in left if end - shared <= p <= end - 4 and not text[p - 1].isspace()}
                right = self.boundaries(text, end - shared, min(len(text), end + overlap))
                if met := next((p for p in right if p in sure), None):
                    break
                if shared >= end - start:  # one run fills the chunk: the left chunk grows
                    end = min(len(text), end + chunk)
                    if end == len(text):
                        break
                shared = min(end - start, shared * 2)
            if met is None:
                break
            cuts.append(met)
            start = met
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]

    def resync(self, text: str, start: int, at: int) -> int:
        """A boundary of the chunk that begins at ``start``, at or before ``at``.

        A single space between two non-spaces always begins a pre-token, so the
        left stream can be taken up there instead of at the chunk's start.
        """
        p = at
        while (p := text.rfind(" ", start + 1, p)) > start:
            if not text[p - 1].isspace() and not text[p + 1 : p + 2].isspace():
                return p
        return start

    def encode_piece(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(text) < 64 or _TWO_SPACES.search(text) or text[0].isspace() or text[-1] == " ":
            return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()
        known = self.known
        words = text.split(" ")
        words[0] = "\0" + words[0]  # it has no space before it, so it isn't the word that is remembered
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        if len(missing) > 1:
            new = [words[i] for i in missing[1:]]
            # one call for all new words; their ids are told apart by the bytes they stand for
            joined = " " + " ".join(new)
            ids = np.array(self.encoding.encode_ordinary(joined), dtype="<u4")
            ends = np.cumsum(self.length[ids])
            sizes = [len(w) for w in new] if joined.isascii() else [len(w.encode()) for w in new]
            cuts = (np.searchsorted(ends, np.cumsum(sizes) + np.arange(1, len(new) + 1)) + 1).tolist()
            raw, a = ids.tobytes(), 0
            learn = len(known) < REMEMBERED
            for i, w, b in zip(missing[1:], new, cuts, strict=True):
                out[i] = x = raw[4 * a : 4 * b]
                if learn:
                    known[w] = x
                a = b
        out[0] = np.array(self.encoding.encode_ordinary(words[0][1:]), dtype="<u4").tobytes()
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.encode_piece, self.pieces(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> Coder:
    """The coder of a file of ranks."""
    with open(path, "rb") as f:
        return Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_decode(df: DataFrame, file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256.

    The ids are decoded again in the same pass, so the round trip is checked on
    every row. No shuffle.
    """
    small_batches(df.sparkSession)

    def run(batches):
        c = coder(file, pattern)
        for keys, texts in batches:
            ids = [c.encode(t) for t in texts]
            yield keys, [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]

    return map_columns(df.select(quoted(key).cast("long"), quoted(text).cast("string")), f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
