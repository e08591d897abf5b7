"""Removal of passages that repeat across documents (operator 9).

A window is ``SIZE`` = 50 consecutive words. A word goes if a window that covers
it also starts in a document with a smaller id.

Method: repeated-phrase automata.

1. Candidates. Of the word ``GRAM``-grams in a window, the one with the least hash
   is its anchor (winnowing), so equal windows have equal anchors. The windows of
   one anchor are neighbours and make one span of words, known by its anchor and a
   hash of its content. Documents are dealt to shards by their id; spans are
   counted by shard, anchor and content (least and largest id, combined
   map-side), so copies of a text are a row a shard. Anchors of one document only go.
2. Confirmation. The first document of each span that is left is read again and
   gives its words. A span with a later document is a phrase. Where an anchor has
   several contents, those can still share single windows (where a passage begins or
   ends, or in an edited copy): the windows of the first document of each content
   are compared, and a window with a later document is a phrase too.
3. Location. Each shard gets the phrases, as words of their first document, that a
   later document of the shard may hold: once a shard, not once a copy. They are
   compiled to an Aho-Corasick automaton over the shard's word codes, and all
   documents of the shard are streamed through it. What it finds, and nothing else,
   decides: a hit whose first document is smaller than the document's own id is
   covered. Hashes only choose which phrases a shard is sent.

A shard holds some 1 / (``SHARDS`` x spark.sql.shuffle.partitions) of the documents,
so its automaton is bounded as the partitions are. Every step is linear in the
input; counts are pre-aggregated before each shuffle, and the joins that follow can
be split where an anchor is hot. Texts are read three times and shuffled twice.

Null and empty texts have no words. Repeated rows with the same id are one
document for the order (an id isn't smaller than itself). Rows with a null id are
before and after nothing: they are kept whole. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkspan.llm.common import forget, free_shuffles, materialise, packed, quoted, small_batches

SIZE, GRAM = 50, 13
#: Shards for each shuffle partition.
SHARDS = 8
_BLANKS = re.compile("([\x20\x09-\x0d]+)")
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray, m: int) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(m)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a batch of texts, as places in their bytes; all by whole arrays.

    starts, ends: of each word; first: number of the first word of each text, and of all words.
    """

    def __init__(self, texts: pa.Array) -> None:
        kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, dtype=np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, dtype=np.uint8)
        self.bounds = bounds = bounds - bounds[0]
        n = len(self.data)
        self.blank = blank = _IS_BLANK[self.data]
        # a blank, or the edge of a text, stands before or after
        before, after = np.r_[True, blank[:-1]][:n], np.r_[blank[1:], True][:n]
        before[bounds[:-1][bounds[:-1] < n]] = True
        after[bounds[1:][bounds[1:] > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """Of each word: of its length and its bytes, eight at a time."""
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.ndarray(shape=(len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.ends - self.starts
        h = _mix(size.astype(np.uint64) * np.uint64(_M2) + (eight[self.starts] & _LOW[np.minimum(size, 8)]), _M1)
        at, k = np.flatnonzero(size > 8), 8
        while len(at):
            h[at] = _mix(h[at] * np.uint64(_M2) + (eight[self.starts[at] + k] & _LOW[np.minimum(size[at] - k, 8)]), _M1)
            k += 8
            at = at[size[at] > k]
        return h

    def text(self, a: int, b: int) -> bytes:
        """Words a to b (end exclusive) and the blanks between them."""
        return self.data[self.starts[a] : self.ends[b - 1]].tobytes()


def _grams(h: np.ndarray, sizes: tuple[int, ...], m: int = _M1) -> list[np.ndarray]:
    """Hashes of all word n-grams, for each n of ``sizes``, by doubling."""
    levels = {1: h}
    n = 1
    while n * 2 <= max(sizes):
        a = levels[n]
        levels[n * 2] = _mix(a[:-n] * np.uint64(m) + a[n:], m) if len(a) > n else a[:0]
        n *= 2
    out = []
    for size in sizes:
        count = max(0, len(h) - size + 1)
        acc, at = np.zeros(count, dtype=np.uint64), 0
        for n in sorted(levels, reverse=True):
            if size - at >= n:
                acc = _mix(acc * np.uint64(m) + levels[n][at : at + count], m)
                at += n
        out.append(acc)
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``."""
    n = 1
    while n * 2 <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


class Spans:
    """The spans of a batch: text, anchor and content hash, first and last window (numbers of words)."""

    def __init__(self, words: Words) -> None:
        h, first = words.hashes(), words.first
        self.hashes = h
        n = len(h) - SIZE + 1
        if n < 1:
            self.text = self.a = self.b = np.zeros(0, dtype=np.int64)
            self.anchor = self.content = self.window = np.zeros(0, dtype=np.uint64)
            return
        gram, self.window = _grams(h, (GRAM, SIZE))
        # the place breaks ties to the left
        places = np.uint64((1 << int(len(h)).bit_length()) - 1)
        at = (_least((gram & ~places) | np.arange(len(gram), dtype=np.uint64), SIZE - GRAM + 1) & places).astype(np.int64)
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.arange(n) + SIZE <= first[1:][text[:n]]
        new = np.r_[True, (at[1:] != at[:-1]) | (text[1:n] != text[: n - 1])]
        self.a = a = np.flatnonzero(new & inside)
        stops = np.r_[np.flatnonzero(new | ~inside), n]
        self.b = b = stops[np.searchsorted(stops, a, "right")] - 1
        self.text, self.anchor = text[a], gram[at[a]]
        shape = ((b - a) * 64 + at[a] - a).astype(np.uint64)
        self.content = _mix(_mix(self.window[a] + shape, _M2) + self.window[b], _M2)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


_FOUND = pa.schema([("id", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64())])


def _anchors(batches):
    for b in batches:
        if b.num_rows:
            s = Spans(Words(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s.text)), pa.array(_signed(s.anchor)), pa.array(_signed(s.content))], schema=_FOUND)


_PHRASE = pa.schema([("id", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("words", pa.binary()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64()))])


def _phrases(batches):
    """Words of the wanted spans of each document; of mixed ones also the hashes of their windows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        words = Words(batch.column(1))
        s = Spans(words)
        lists, wants = batch.column(2), batch.column(2).flatten()
        anchor, content, mixed = (wants.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        key = lambda t, x, y: _mix(_mix(t.astype(np.uint64) * np.uint64(_M2) + x.astype(np.int64).view(np.uint64), _M1) + y.astype(np.int64).view(np.uint64), _M1)
        wanted, own = key(of, anchor, content), key(s.text, _signed(s.anchor), _signed(s.content))
        order = np.argsort(wanted)
        place = order[np.minimum(np.searchsorted(wanted, own, sorter=order), max(0, len(order) - 1))] if len(order) else np.zeros(len(own), dtype=np.int64)
        hit = np.flatnonzero(wanted[place] == own) if len(order) else np.zeros(0, dtype=np.int64)
        _, once = np.unique(own[hit], return_index=True)
        hit = hit[once]
        w1 = w2 = None
        if mixed[place[hit]].any():
            w1, (w2,) = _signed(s.window), _grams(_mix(s.hashes, 0xFF51AFD7ED558CCD), (SIZE,), 0xC4CEB9FE1A85EC53)
            w2 = _signed(w2)
        a, b, m = s.a[hit].tolist(), s.b[hit].tolist(), mixed[place[hit]].tolist()
        made = [[words.text(x, y + SIZE) for x, y in zip(a, b, strict=True)], *([w[x : y + 1] if z else None for x, y, z in zip(a, b, m, strict=True)] for w in (w1, w2))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(s.text[hit])), pa.array(_signed(s.anchor[hit])), pa.array(_signed(s.content[hit])), *(pa.array(x, type=t.type) for x, t in zip(made, list(_PHRASE)[3:], strict=True))], schema=_PHRASE)


def delivered(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, first, words, offs): phrases for the documents (id, t) of each shard.

    ``offs``: the phrases are the windows at these places of ``words``; null: all words are one phrase.
    """
    spark = docs.sparkSession
    found = docs.select("id", "t").mapInArrow(_anchors, "id long, anchor long, content long")
    counted, all_path = materialise(found.groupBy(_shard(F.col("id"), shards).alias("shard"), "anchor", "content").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    again = counted.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.min("content") < F.max("content")).alias("mixed")).where("lo < hi").select("anchor", "mixed")
    # a table of its own: both sides of the join come straight from exchanges, so a hot anchor can be split
    again, again_path = materialise(again)
    rec, rec_path = materialise(counted.join(again, "anchor"))
    forget(spark, all_path, again_path)
    free_shuffles(spark)
    classes = rec.groupBy("anchor", "content", "mixed").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    wanted = classes.groupBy("first").agg(F.collect_list(F.struct("anchor", "content", "mixed")).alias("want"))
    read = docs.join(wanted, docs["id"] == wanted["first"]).select("id", "t", "want")
    made = read.mapInArrow(_phrases, "id long, anchor long, content long, words binary, w1 array<long>, w2 array<long>")
    # rows that repeat an id and a text give the same phrases
    made = made.groupBy("anchor", "content").agg(F.min("id").alias("first"), F.first("words").alias("words"), F.first("w1").alias("w1"), F.first("w2").alias("w2"))
    made, made_path = materialise(made)
    free_shuffles(spark)
    words = made.select("anchor", "content", "first", "words")
    whole = rec.join(words, ["anchor", "content"]).where("hi > first").select("shard", "first", "words", F.lit(None).cast("array<int>").alias("offs"))

    windows = made.where("w1 is not null").select("first", "anchor", "content", F.posexplode(F.arrays_zip("w1", "w2")).alias("off", "w")).select("first", "anchor", "content", "off", "w.w1", "w.w2")
    shared, shared_path = materialise(windows.groupBy("w1", "w2").agg(F.min("first").alias("f"), F.max("first").alias("l")).where("f < l").drop("l"))
    met, met_path = materialise(windows.join(shared, ["w1", "w2"]))
    forget(spark, shared_path)
    free_shuffles(spark)
    later = met.where("first > f").select("w1", "w2", "anchor", "content", "first")
    needed = later.join(rec.select("shard", "anchor", "content", F.col("lo").alias("first")), ["anchor", "content", "first"]).select("shard", "w1", "w2").distinct()
    home = met.where("first = f").groupBy("w1", "w2").agg(F.min(F.struct("anchor", "content", "off")).alias("at")).select("w1", "w2", "at.*")
    single = needed.join(home, ["w1", "w2"]).groupBy("shard", "anchor", "content").agg(F.collect_set("off").alias("offs")).join(words, ["anchor", "content"]).select("shard", "first", "words", "offs")
    sent, _ = materialise(whole.union(single))
    forget(spark, rec_path, made_path, met_path)
    free_shuffles(spark)
    return sent


def _shard(x, shards: int):
    return F.pmod(F.xxhash64(x), F.lit(shards)).cast("int")


class Phrases:
    """The phrases of a shard, and their automaton.

    A word is written as two signs, each of an alphabet of its own, so that no node
    has more followers than the square root of the number of words.
    """

    def __init__(self) -> None:
        self.first: dict[bytes, int] = {}
        self.code: dict[bytes, int] | None = None

    def add(self, words: bytes, first: int, offs: list[int] | None) -> None:
        own = words.split()
        for p in [own] if offs is None else [own[i : i + SIZE] for i in offs]:
            p = b" ".join(p)
            self.first[p] = min(first, self.first.get(p, first))
        self.code = None

    def written(self, codes: np.ndarray) -> str:
        return np.stack((codes // self.radix + 0x10000, codes % self.radix + (0x10000 + self.radix)), axis=1).astype("<u4").tobytes().decode("utf-32-le")

    def compile(self) -> None:
        code: dict[bytes, int] = {}
        phrases = [(np.array([code.setdefault(w, len(code)) for w in p.split()], dtype=np.int64), first) for p, first in self.first.items()]
        self.radix = int(len(code) ** 0.5) + 1
        self.automaton = ahocorasick.Automaton()
        for codes, first in phrases:
            self.automaton.add_word(self.written(codes), (first, len(codes)))
        self.automaton.make_automaton()
        # by the first bits of a word's hash, whether it may be a word of a phrase
        self.shift = np.uint64(64 - min(24, 6 + len(code).bit_length()))
        self.may_be = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.may_be[Words(pa.array([b" ".join(code)])).hashes() >> self.shift] = True
        self.code = code

    def covered(self, words: Words, hashes: np.ndarray, keys: list[int | None]) -> dict[int, np.ndarray]:
        """Which words of each text of a batch a phrase with an earlier document covers; texts without any aren't listed."""
        out: dict[int, np.ndarray] = {}
        if not self.first or not len(hashes):
            return out
        if self.code is None:
            self.compile()
        # a phrase lies within a run of words that phrases have; most words are passed over as whole arrays
        maybe = self.may_be[hashes >> self.shift]
        cuts = np.zeros(len(maybe) + 1, dtype=bool)
        cuts[words.first] = True
        begins = np.flatnonzero(maybe & (cuts[:-1] | np.r_[True, ~maybe[:-1]]))
        ends = np.flatnonzero(maybe & (cuts[1:] | np.r_[~maybe[1:], True])) + 1
        long = ends - begins >= SIZE
        texts = np.searchsorted(words.first, begins[long], "right") - 1
        for i, a, b in zip(texts.tolist(), begins[long].tolist(), ends[long].tolist(), strict=True):
            if keys[i] is not None and len(hit := self.search(words.text(a, b).split(), keys[i])):
                low, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
                marks = out.setdefault(i, np.zeros(n + 1, dtype=np.int64))
                np.add.at(marks, hit[:, 0] + (a - low), 1)
                np.add.at(marks, hit[:, 1] + (a - low), -1)
        return {i: np.cumsum(m[:-1]) > 0 for i, m in out.items()}

    def search(self, words: list[bytes], key: int) -> np.ndarray:
        """Places (first word, end) of the phrases with an earlier document, as the automaton finds them."""
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        edges = np.flatnonzero(np.diff(np.r_[False, codes >= 0, False]))
        found = []
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= SIZE:
                found += [(a + end // 2 + 1 - n, a + end // 2 + 1) for end, (first, n) in self.automaton.iter(self.written(codes[a:b])) if first < key]
        return np.array(found, dtype=np.int64).reshape(-1, 2)


def _cut(text: str, gone: np.ndarray) -> str:
    """``text`` without some words and the blanks after them."""
    parts = _BLANKS.split(text)
    first = 0 if parts[0] else 2  # a text can begin with blanks
    gone = gone.tolist()
    out = [] if first == 0 else parts[1:2]
    for i, at in enumerate(range(first, first + 2 * len(gone), 2)):
        if not gone[i]:
            out += parts[at : at + 2]
    return "".join(out)


def _remove(batches, text: int, schema: pa.Schema, layout: bool, counts: int):
    shard, phrases = None, Phrases()
    for b in batches:
        shards = b.column(0).to_numpy()
        is_doc = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        edges = np.r_[0, np.flatnonzero((shards[1:] != shards[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1, len(shards)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if i == j:
                continue
            if shards[i] != shard:
                shard, phrases = shards[i], Phrases()
            part = b.slice(i, j - i)
            if not is_doc[i]:
                for first, words, offs in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    phrases.add(words, first, offs)
                continue
            columns = part.column(5).flatten()
            words = Words(columns[text])
            gone = phrases.covered(words, words.hashes(), part.column(4).to_pylist())
            n_words = np.diff(words.first)
            n_gone = np.zeros(len(n_words), dtype=np.int64)
            texts = columns[text].to_pylist()
            if not layout:
                blanks = np.diff(np.r_[0, np.cumsum(words.blank)][words.bounds])
                odd = np.diff(np.r_[0, np.cumsum(words.blank & (words.data != 32))][words.bounds])
                for k in np.flatnonzero((blanks != n_words - 1) | (odd > 0)).tolist():
                    texts[k] = b" ".join((texts[k] or "").encode().split()).decode()
            for k, g in gone.items():
                n_gone[k] = g.sum()
                texts[k] = _cut(texts[k], g) if layout else b" ".join([x for x, y in zip(texts[k].encode().split(), g.tolist(), strict=True) if not y]).decode()
            columns[text] = pa.array(texts, type=schema.field(text).type)
            made = [*columns, *(pa.array(x, type=pa.int64()) for x in (n_words, n_gone)[:counts])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema, strict=True)], schema=schema)


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", layout: bool = False, counts: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``df`` with the kept words in ``text``, then the ``counts``.

    Words are joined by one space; with ``layout`` they keep the blanks after them, and
    texts that lose nothing stay as they are (null too). ``counts``: names of added
    columns for the number of words and of removed words.
    """
    if clash := set(counts) & set(df.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    spark = df.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS * parts
    sound = df.select(quoted(key).cast("long").alias("id"), quoted(text).cast("string").alias("t")).where("id is not null and t is not null")
    sent = delivered(sound, shards)
    # rows without an id are spread by their place
    ident = quoted(key).cast("long")
    docs = df.select(F.coalesce(F.when(ident.isNotNull(), _shard(ident, shards)), _shard(F.monotonically_increasing_id(), shards)).alias("shard"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("binary").alias("words"), F.lit(None).cast("array<int>").alias("offs"), ident.alias("id"), packed(df).alias("row"))
    sent = sent.select("shard", "first", "words", "offs", F.lit(None).cast("long").alias("id"), F.lit(None).cast(docs.schema["row"].dataType).alias("row"))
    dealt = docs.union(sent).repartitionById(parts, F.pmod("shard", F.lit(parts))).sortWithinPartitions("shard", F.col("row").isNotNull())
    fields = [T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema]
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in counts)])
    return dealt.mapInArrow(partial(_remove, text=df.columns.index(text), schema=to_arrow_schema(out), layout=layout, counts=len(counts)), out)
