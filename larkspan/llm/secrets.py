"""Secret scan with a randomness test battery (operator 10), in DataFrame functions only.

Base kinds (assign, access, hex) are leftmost matches of fixed patterns. The
method adds spans of the kind ``random``: strings of 20 and more characters of a
key's alphabet that mix digits and letters and can't be told from random ones.

For each such string the encoding is inferred (hex, base32, base62, base64), and
three tests ask whether its symbols could be uniform draws: chi-squared over the
encoding's alphabet, runs above and below its middle, and lag-one serial
correlation. The least of the three p-values, corrected for being the least of
three, is about uniform for random strings and near zero for words and names.

False discoveries are controlled by length: over all documents, distinct strings are
counted by length band and p-value bin (at most ``BANDS`` x ``BINS`` rows). The
upper half of the bins gives the level of random strings; what a bin has beyond
that level are others. In each band the least p-value is found from which on at
most ``FDR`` of the strings are others, or their excess is within ``NOISE`` standard
deviations of none; strings below it are left alone. The
``BANDS`` limits at most are gathered and stand in the plan as literals.

Strings that a base span covers aren't tested: assignments are blanked out first, and
access keys and hex strings lie within one string. The battery runs once: what it says
is written to the shared scratch folder with what the result needs, the limits are
counted there, and the spans are read from there.

Positions come from splitting at the matches and summing the lengths, in code
points. Running sums and maxima go by blocks, so a text with very many matches costs little
more than linear time. No shuffle but that of the counts.

Null and empty texts have no spans; repeated rows give repeated rows; rows with a
null id are scanned like any other; other columns of the input are ignored or, for
``redact``, kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import materialise, packed, quoted

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
BANDS, BINS, FDR, NOISE = 8, 20, 0.05, 2.0
MASK = "[secret]"
_BLOCK = 64


def _running(a: Column, start: int, op) -> Column:
    """``op`` of each element of an array of ints and all before it, by blocks."""

    def running(x: Column) -> Column:
        zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(start).alias("now"))
        step = lambda acc, v: F.struct(F.array_append(acc["out"], op(acc["now"], v)).alias("out"), op(acc["now"], v).alias("now"))
        return F.aggregate(x, zero, step)["out"]

    starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int"))
    blocks = F.transform(starts, lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
    totals = F.concat(F.array(F.lit(start)), running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), op))))
    large = F.flatten(F.zip_with(F.transform(blocks, running), F.slice(totals, 1, F.size(blocks)), lambda b, base: F.transform(b, lambda v: op(v, base))))
    return F.when(F.size(a) == 0, F.array().cast("array<int>")).when(F.size(a) <= _BLOCK, running(a)).otherwise(large)


def _prefix_sums(a: Column) -> Column:
    return _running(a, 0, lambda x, y: x + y)


def _found(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: array of (start, end, value) of the matches; value is group 1 or the match."""
    grouped = pattern == ASSIGN
    df = df.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumns(
        {
            "_v": F.when(F.size("_m") > 0, F.regexp_extract_all(text, F.lit(pattern), F.lit(1))) if grouped else F.col("_m"),
            # lengths of what stands before each match, and of the match
            "_l": F.when(F.size("_m") > 0, F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size("_m")), "_m", lambda a, b: F.length(a) + F.length(b))),
        }
    )
    df = df.withColumn("_e", F.when(F.size("_m") > 0, _prefix_sums(F.col("_l"))))
    # nothing stands for no match, so that most rows skip all of this
    spans = F.zip_with(F.zip_with("_e", "_m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))), "_v", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")))
    return df.withColumn(name, F.when(F.size("_m") > 0, spans)).drop("_m", "_v", "_l", "_e")


def _normal(z: Column) -> Column:
    """Upper tail of the normal distribution, within 2e-4."""
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _tests(value: Column) -> Column:
    """p-value of the battery; ``value`` is an element of an array, without its padding."""
    x = F.translate(value, "-_", "+/")
    hexed, upper = value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), value.rlike("^[A-Z2-7]+$")
    wide = value.rlike("[+/_-]")
    alphabet = (
        F.when(hexed, F.lit("0123456789abcdef"))
        .when(upper, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        .when(wide, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
        .otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    )
    x = F.when(hexed, F.lower(x)).otherwise(x)
    n, k = F.length(x).cast("double"), F.length(alphabet).cast("double")
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(x, c, F.lit(""))), F.lit(2.0)))
    chi, df = squares * k / n - n, k - 1
    p_chi = _normal((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    values = F.transform(chars, lambda c: F.position(c, alphabet).cast("double") - 0.5 - k / 2)
    zero = F.struct(F.lit(None).cast("double").alias("prev"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("cross"), F.lit(0.0).alias("square"))
    walked = F.aggregate(
        values,
        zero,
        lambda a, v: F.struct(
            v.alias("prev"),
            (a["turns"] + F.coalesce(F.when(a["prev"] * v < 0, 1.0), F.lit(0.0))).alias("turns"),
            (a["cross"] + F.coalesce(a["prev"] * v, F.lit(0.0))).alias("cross"),
            (a["square"] + v * v).alias("square"),
        ),
    )
    p_runs = 2 * _normal(F.abs(walked["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    p_serial = 2 * _normal(F.abs(walked["cross"] / walked["square"]) * F.sqrt(n))
    least = F.least(F.lit(1.0), p_chi, p_runs, p_serial)
    return 1 - F.pow(1 - least, F.lit(3.0))


def _band(n: Column) -> Column:
    """Length bands, each half as long again as the one before."""
    return F.least(F.lit(BANDS - 1), F.floor(F.log(n / 20.0) / F.log(F.lit(1.5)))).cast("int")


def blanked(text: str, assign: str) -> Column:
    """The text with the assignments (base spans) turned to blanks of the same length."""
    pieces, m = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    fill = F.zip_with(m, assign, lambda x, s: F.when(F.length(s["value"]) >= 6, F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, 1, F.size(m)), fill, lambda a, b: F.concat(a, b)), ""), F.element_at(pieces, -1))
    return F.when(F.size(assign) > 0, joined).otherwise(F.col(text))


def candidates(df: DataFrame, text: str, name: str = "random") -> DataFrame:
    """Adds ``name``: array of (start, end, band, bin, hash) of the strings that the battery tests; null for none."""
    df = _found(df, text, "_c", CANDIDATE)
    tested = lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~c["value"].rlike(HEX) & ~c["value"].rlike(ACCESS)
    df = df.withColumn("_c", F.when(F.size("_c") > 0, F.filter("_c", tested)))
    df = df.withColumn("_p", F.when(F.size("_c") > 0, F.transform("_c", lambda c: _tests(c["value"]))))
    made = F.zip_with("_c", "_p", lambda c, p: F.struct(c["start"].alias("start"), c["end"].alias("end"), _band(F.length(c["value"])).alias("band"), F.least(F.lit(BINS - 1), F.floor(p * BINS)).cast("int").alias("bin"), F.xxhash64(c["value"]).alias("hash")))
    return df.withColumn(name, F.when(F.size("_c") > 0, made)).drop("_c", "_p")


def limits(counts: DataFrame) -> DataFrame:
    """(band, least bin that is flagged) from (band, bin, n), over all documents."""
    every = counts.select("band").distinct().select("band", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    full = every.join(counts, ["band", "bin"], "left").fillna(0, "n")  # BANDS x BINS rows at most
    level = full.where(F.col("bin") >= BINS // 2).groupBy("band").agg((F.sum("n") / (BINS // 2)).alias("level"))
    held = full.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("all")).join(level, "band")
    above = lambda b: F.aggregate(F.filter("all", lambda x: x["bin"] >= b), F.lit(0).cast("double"), lambda s, x: s + x["n"])
    # the excess if all are random: its variance is that of the bins below the upper half, and of the level times their number
    half = BINS // 2
    noise = lambda b: NOISE * F.sqrt((F.greatest(half - b, F.lit(0)) * (1 + F.greatest(half - b, F.lit(0)) / half) + F.when(b > half, (BINS - b) * (b - half) / half).otherwise(0)) * (F.col("level") + 1 / half))
    good = F.filter(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda b: (above(b) > 0) & ((above(b) - (BINS - b) * F.col("level")) <= FDR * above(b) + noise(b)))
    return held.select("band", F.coalesce(F.array_min(good), F.lit(BINS)).alias("least"))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, base, spans) of each row: a struct of the columns ``keep`` (all), and sorted arrays of (start, kind, end), kind a place in KINDS."""
    row = packed(df if keep is None else df.select(*map(quoted, keep)))
    found = df.select(row.alias("row"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        found = _found(found, "text", name, pattern)
    found = candidates(found.withColumn("rest", blanked("text", "assign")), "rest")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def kind(name: str, k: int, ok) -> Column:
        return F.when(F.size(name) > 0, F.transform(F.filter(name, ok), lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))).otherwise(none)

    base = F.array_sort(F.concat(kind("assign", 0, lambda s: F.length(s["value"]) >= 6), kind("access", 1, lambda s: F.lit(True)), kind("hex", 2, lambda s: F.lit(True))))
    found, _ = materialise(found.select("row", base.alias("base"), "random"))
    counts = found.where("random is not null").select(F.explode("random").alias("c")).select("c.band", "c.bin", "c.hash").distinct().groupBy("band", "bin").agg(F.count("*").alias("n"))
    counts, _ = materialise(counts)  # read three times
    # at most BANDS rows
    least = F.create_map(*(F.lit(int(x)) for r in limits(counts).orderBy("band").collect() for x in r), F.lit(-1), F.lit(BINS))
    extra = kind("random", 3, lambda s: s["bin"] >= F.coalesce(least[s["band"]], F.lit(BINS)))
    return found.select("row", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digest(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts of the base kinds, base_sha256, spans."""
    found = scan(df, text, [key])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(F.col("row")[key].alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by ``MASK``; overlapping spans by one. Spans are sorted by their start."""
    ends = _running(F.transform(spans, lambda s: s["end"]), 0, lambda x, y: F.greatest(x, y))
    # of each span: where the ones before it end, or null if it overlaps them
    open_ = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), spans, lambda e, s: F.when((e <= s["start"]), F.struct(e.alias("a"), s["start"].alias("b"))))
    chars = F.split(text, "", -1)
    pieces = F.transform(F.filter(open_, lambda p: p.isNotNull()), lambda p: F.concat(F.array_join(F.slice(chars, p["a"] + 1, p["b"] - p["a"]), ""), F.lit(MASK)))
    last = F.element_at(ends, -1)
    return F.concat(F.array_join(pieces, ""), F.array_join(F.slice(chars, last + 1, F.greatest(F.lit(0), F.size(chars) - last)), ""))


def redact(df: DataFrame, text: str = "text", changed: str | None = None) -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``MASK``; overlapping spans by one.

    ``changed``: adds a column of that name, whether the text has changed.
    """
    if changed in df.columns:
        raise ValueError(f"column exists: {changed}")
    found = scan(df, text)
    some = F.size("spans") > 0
    own = [F.when(some, masked(F.col("row")[c], F.col("spans"))).otherwise(F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns]
    return found.select(*own, *([some.alias(changed)] if changed else []))
