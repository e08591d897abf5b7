"""Text normalisation and name similarity as column expressions.

Everything is a built-in expression, so it stays in whole-stage codegen and is
visible to the optimizer. Only the two edit distances that Spark lacks are Arrow
UDFs (``edits.py``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A small English stop list.
STOP_WORDS = tuple(
    """a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    just like may me more most my no not of on one only or other our out over she so some such than that the their them then there these
    they this to up was we were what when which who will with would you your""".split()
)
#: Words that mark an anchor text as useless for a name.
SPAM_WORDS = (
    "http", "link", "here", "web", "site", "view", "click", "provided", "source", "original", "download", "website", "live", "article", "read", "wiki", "quelle", "background",
    "artikel", "encyclopedia", "mehr", "german", "french", "english", "address",
)
#: Titles that name no entity.
IGNORED_TITLE = "^(Category:|File:|List of )"
#: Names of days, months, times and news agencies.
CALENDAR = tuple(
    """weekend qmorning evening afternoon night weekend tomorrow tonight utc gmt jan feb mar apr jun jul aug sept sep oct nov dec january february march april may june
    july august september october november december sunday monday tuesday wednesday thursday friday saturday sunday spring summer fall winter autumn sun mon tue tues wed
    thu thur thurs fri sat xinhua afp""".split()
)
#: Abbreviations of places; a name stands for all abbreviations before it.
PLACES = """al Alabama ak Alaska az ariz Arizona ar Arkansas ca calif cal California co colo Colorado ct conn Connecticut de del Deleware dc District_of_Columbia fl fla Florida
ga Georgia hi Hawaii id Idaho il ill Illinois in ind Indiana ia Iowa ks kan kans Kansas ky Kentucky la Louisiana me Maine md Maryland ma mass Massachusetts mi mich Michigan
mn minn Minnesota ms miss Mississippi mo Missouri mt mont Montana ne Nebraska nv Nevada nh New_Hampshire nj New_Jersey nm New_Mexico ny New_York nyc New_York_City
nc North_Carolina nd North_Dakota oh Ohio ok okla Oklahoma or ore Oregon pa penn Pennsylvania ri Rhode_Island sc South_Carolina sd South_Dakota tn tenn Tennessee tx Texas
ut Utah vt Vermont va Virginia wa Washington_(state) wv w_va West_Virginia wi wis wisc Wisconsin wy wyo Wyoming pr Puerto_Rico us United_States"""


def places() -> dict[str, str]:
    """Abbreviation to name."""
    out, held = {}, []
    for w in PLACES.split():
        if w[0].isupper():
            out |= {x.replace("_", " "): w for x in held}
            held = []
        else:
            held.append(w)
    return out


def normalize(x: Column | str) -> Column:
    """Lower case, each run of signs other than ASCII letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def tokens(x: Column | str) -> Column:
    """Words of the normalised text; none for an empty one. The text is cut once, in generated code."""
    return F.array_remove(F.split(F.lower(x), "[^a-z0-9]+"), "")


def is_stop(w: Column) -> Column:
    return w.isin(*STOP_WORDS)


def content_tokens(x: Column | str) -> Column:
    """Normalised words without stop words."""
    return F.filter(tokens(x), lambda w: ~is_stop(w))


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def exact_match(a: Column, b: Column) -> Column:
    return flag(a == b)


def prefix_of(a: Column, b: Column) -> Column:
    """1 if ``a`` isn't empty and starts with ``b``."""
    return flag((a != "") & F.startswith(a, b))


def suffix_of(a: Column, b: Column) -> Column:
    return flag((a != "") & F.endswith(a, b))


def first_letter_match(a: Column, b: Column) -> Column:
    """Case counts; an empty side gives 0."""
    return flag((a != "") & (b != "") & (F.substring(a, 1, 1) == F.substring(b, 1, 1)))


def acronym(x: Column) -> Column:
    """Initials of the words that are no stop words, normalised."""
    return F.array_join(F.transform(content_tokens(x), lambda w: F.substring(w, 1, 1)), "")


def acronym_match(short: Column, long: Column) -> Column:
    """Whether the initials of ``long`` are ``short``."""
    return flag((normalize(short) != "") & (normalize(short) == acronym(long)))


def is_acronym(x: Column) -> Column:
    """All characters are capital letters; so is an empty text."""
    return flag(x.rlike(r"^\p{Lu}*$"))


def chars(x: Column) -> Column:
    """Distinct characters."""
    return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))


def words(x: Column) -> Column:
    """Distinct words between single blanks."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda c: c != ""))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct elements; 0 if both are empty."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def aligned_dice_chars(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Dice over characters of both texts cut to the shorter length: from the left, from the right, and the larger."""
    n = F.least(F.length(a), F.length(b))
    lefts = dice(chars(F.left(a, n)), chars(F.left(b, n)))
    rights = dice(chars(F.right(a, n)), chars(F.right(b, n)))
    return lefts, rights, F.greatest(lefts, rights)


def aligned_dice_words(a: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y = (F.filter(F.split(c, " "), lambda w: w != "") for c in (a, b))
    n = F.least(F.size(x), F.size(y))
    lefts = dice(F.array_distinct(F.slice(x, F.lit(1), n)), F.array_distinct(F.slice(y, F.lit(1), n)))
    right = lambda z: F.array_distinct(F.slice(z, F.size(z) - n + 1, n))
    rights = F.when(n == 0, 0.0).otherwise(dice(right(x), right(y)))
    return lefts, rights, F.greatest(lefts, rights)


def strip_parentheses(x: Column, opening: str = "(", closing: str = ")") -> Column:
    """Without parenthesised spans, nested to any depth.

    A sign stays while the openings up to it and the closings before it are equally
    many: what an open parenthesis begins goes up to the end, and so does what follows a
    closing one too many. Only pieces between parentheses are walked, not signs.
    """
    both = f"\\{opening}\\{closing}"
    zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece == opening, 1).otherwise(0)
        return F.struct((depth - F.when(piece == closing, 1).otherwise(0)).alias("depth"), F.when(depth == 0, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(F.regexp_extract_all(x, F.lit(f"[^{both}]+|[{both}]"), F.lit(0)), zero, step)
    return F.when(F.contains(x, F.lit(opening)) | F.contains(x, F.lit(closing)), F.array_join(walked["out"], "")).otherwise(x)


def title_to_name(x: Column) -> Column:
    return strip_parentheses(F.replace(x, F.lit("_"), F.lit(" ")))


def ignored_title(x: Column) -> Column:
    return x.rlike(IGNORED_TITLE)


def spam_anchor(x: Column) -> Column:
    return F.lower(x).rlike("|".join(SPAM_WORDS))


def stem(w: Column) -> Column:
    """A light stem: common English endings go, if three letters stay."""
    return F.regexp_replace(w, "^(.{3,}?)(?:ings?|ed|es|s)$", "$1")


def place_name(x: Column) -> Column:
    """The place that an abbreviation stands for, null for none."""
    return F.create_map(*(F.lit(v) for pair in places().items() for v in pair))[F.regexp_replace(F.lower(x), r"\.", "")]


def calendar_word(x: Column) -> Column:
    return F.lower(x).isin(*CALENDAR)


def neighbor_name(x: Column) -> Column:
    """Whether a name may stand for a neighbour: no day, month or address, two signs at least."""
    return ~calendar_word(x) & ~F.startswith(F.lower(x), F.lit("http")) & (F.length(x) >= 2)


def clean_text(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9]", " ")


def sentences(x: Column) -> Column:
    """Pieces between full stops, trimmed, each with its stop again."""
    return F.transform(F.filter(F.transform(F.split(x, r"\."), lambda s: F.trim(s)), lambda s: s != ""), lambda s: F.concat(s, F.lit(".")))


def safe_file_name(x: Column) -> Column:
    """A name that any file system takes: other characters to '_', no leading dot or dash, at most 255 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]", "_"), "^[.-]", "_"), F.lit(255))


def log_tf(f: Column) -> Column:
    """0 below 0.01, else 1 + ln f."""
    return F.when(f < 0.01, 0.0).otherwise(1 + F.log(f))


def let(x: Column, f) -> Column:
    """f(x) with x computed once: an expression used inside a lambda would be computed anew for each element."""
    return F.transform(F.array(x), f)[0]


def ngrams(terms: Column, n: int) -> Column:
    """All runs of n terms, blank-joined."""
    if n == 1:
        return terms
    none = F.array().cast("array<string>")
    return let(terms, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(none))
