"""Main text of web pages by inferred wrappers (operator 1).

Method: union-free regular-expression inference. A page is read as a stream of
block tags and texts, nested as in a browser (implied ends of paragraphs, stray
end tags ignored). The streams of one host are aligned, one after the other:
blocks that match are merged, others become optional groups, labels that recur
become repeated groups of optional parts, texts become slots that know how much
text they hold, how much of it in links, and whether all pages have the same. The
result is a wrapper: a regular expression without unions, kept as a tree, since
tags nest. A label is the tag with the first word of its class and its id.

The wrapper of the host decides for every page. A page is followed from the root: as long
as one of its blocks holds, by the host's mean, more than ``HEAVY`` of the text
outside links, frame and slots that never change, that block is entered; where no block does, the
article has been found. ``article`` and ``main`` count ``PRIOR`` times. Tags and roles of
menus, headers, footers and sidebars make a block part of the frame; so do forms and words
of class and id (notices, adverts, readers' comments and such), unless the block holds more
than half of the host's text and no article stands outside it. Slots that never change
and lists of links are left out too.

Scale: pages of one structure add up (sums only, so the order and the splits of
the input don't matter): a task gives one row for each host and structure, a hot
host a few for each task. The structures of a host are then aligned in the order of
their notation, in two rounds, the first in ``SALTS`` shares, as sorted streams of
which a task holds one at a time. The table of rules is small (paths of labels, no
texts); Spark broadcasts it where its size allows, else it is joined, and the join
can be split at a hot host.

A null page is empty; a null or odd URL belongs to the host ''; repeated rows give
repeated rows; blocks nested deeper than ``DEPTH`` are read as part of the block
around them; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import map_columns, materialise, quoted, small_batches

DEPTH, SALTS, HELD = 60, 16, 500
#: Share of the text that a block is entered for; weight of an article's or main block's text in this.
HEAVY, PRIOR = 0.6, 3

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("br hr wbr img input meta link area base col embed param source track".split())
#: Read as raw text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside dialog menu search fieldset".split())
#: Dropped though they are no blocks.
INLINE_DROPPED = frozenset("button select option svg math object canvas audio video template datalist".split())
FRAME = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidenav comment comments reply replies disqus respond
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations
    breadcrumb breadcrumbs menu nav navbar navigation topbar header masthead footer login search pager pagination copyright disclaimer toolbar widget widgets""".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|([^\s=/"'>]+)""")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'|[\"'].*", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A block of a page: tag, kind (see kind_of), label, and in order its blocks and texts (text, characters in links)."""

    __slots__ = ("tag", "kind", "label", "kids")

    def __init__(self, tag: str, kind: str = "", name: str = "") -> None:
        self.tag, self.kind, self.label, self.kids = tag, kind, tag + name + kind, []


def name_of(attributes: str) -> str:
    """First word of the class, and the id; digits count as one."""
    found = {}
    if "=" in attributes:
        for name, value, _ in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id") and (words := value.strip("\"'").split()):
                found[name.lower()] = re.sub(r"\d+", "0", re.sub(r"[^\w-]", "", words[0]))
    return "".join(f"{mark}{found[x]}" for x, mark in (("class", "."), ("id", "#")) if found.get(x))


def kind_of(tag: str, attributes: str) -> str:
    """'!' for the frame by tag or role, '~' for what class or id call so, '!!' for hidden, '*' for what looks like the article, else ''."""
    bad, good, named, held = tag in DROPPED, tag in ("article", "main"), tag == "form", ""  # a form can hold a whole page
    if attributes and not attributes.isspace():
        for name, value, bare in _ATTRIBUTE.findall(attributes):
            name, value = (name or bare).lower(), value.strip("\"'")
            if name in ("class", "id"):
                words = {w.lower() for w in _WORDS.findall(value)}
                named |= tag not in ("html", "body", "main", "article") and not words.isdisjoint(FRAME)
            elif name == "role":
                bad |= value.lower() in ROLES
                good |= value.lower() in ("main", "article")
            elif name == "itemprop" and value.lower() == "articlebody":
                good = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                held = "!!"
    if held:
        return held
    return "!" if bad else "~" if named else "*" if good else ""


def _quotes(html: str, at: int) -> list[tuple[int, int]]:
    """Places of the quoted parts after ``at``, as a tag would read them; the last may be open."""
    return [(m.start(), m.end() if m.end() - m.start() > 1 else len(html)) for m in _QUOTED.finditer(html, at)]


def _outside(quotes: list[tuple[int, int]], at: int) -> bool:
    """Whether a tag at ``at`` would meet the same quotes, and so not end either."""
    i = bisect_right(quotes, (at, len(quotes))) - 1
    return i < 0 or quotes[i][1] <= at


def parse(html: str) -> Block:
    """The blocks of a page, in time linear in its length."""
    root = Block("")
    stack: list[tuple[str, Block | None, int]] = [("", root, 0)]  # tag, block (None: dropped or too deep), links open before it
    texts: list[str] = []
    in_links, links, inline_dropped = 0, 0, ""
    n, at = len(html), 0
    broken: list[list[tuple[int, int]]] = []

    def flush() -> None:
        nonlocal in_links
        if texts:
            text = " ".join(entities.unescape("".join(texts)).split())
            texts.clear()
            if text:
                home = next(b for _, b, _ in reversed(stack) if b is not None)
                home.kids.append((text, in_links))
        in_links = 0

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            if not inline_dropped:
                texts.append(html[at:lt])
                if links:
                    in_links += lt - at
            at = lt
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = None if any(_outside(x, at) for x in broken) else _TAG.match(html, at)
        if not m and html[at + 1 : at + 2].isalpha() | (html[at + 1 : at + 2] == "/"):
            if m := _PLAIN_TAG.match(html, at):  # a quote that isn't closed: the tag ends at the next sign
                if not any(_outside(x, at) for x in broken):
                    broken.append(_quotes(html, at))
            elif html.find(">", at) < 0:
                break  # a tag that never ends
            elif html[at + 1] == "/":
                at = html.find(">", at) + 1  # "</" and no name is a comment
                continue
        if not m:
            if not inline_dropped:
                texts.append("<")
            at += 1
            continue
        at, close, tag = m.end(), m[1], m[2].lower()
        if close:
            if inline_dropped:
                if tag == inline_dropped:
                    inline_dropped = ""
                elif tag not in BLOCKS:
                    continue
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        flush()
                        links = 0
                        inline_dropped = ""
                        del stack[i:]
                        break
                else:
                    if tag == "p":
                        flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
            at = n if end is None else end.end()
            continue
        if inline_dropped and tag not in ("p", "article", "main", "section", "table"):
            continue
        if tag in BLOCKS:
            flush()
            links, inline_dropped = 0, ""
            top = stack[-1][0]
            if top == "p" or tag == top and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                stack.pop()
            elif top in ("td", "th") and tag in ("td", "th", "tr") or top in ("dd", "dt") and tag in ("dd", "dt"):
                stack.pop()
                if tag == "tr" and stack[-1][0] == "tr":
                    stack.pop()
            if len(stack) > DEPTH:
                stack.append((tag, None, 0))
                continue
            home = next(b for _, b, _ in reversed(stack) if b is not None)
            block = Block(tag, kind_of(tag, m[3]), name_of(m[3]))
            home.kids.append(block)
            stack.append((tag, block, 0))
        elif tag == "br" or tag == "hr":
            texts.append(" ")
        elif tag == "a":
            links = 1
        elif tag in INLINE_DROPPED and not m[3].endswith("/"):
            inline_dropped = tag
        elif tag not in VOID and kind_of(tag, m[3])[:1] in ("!", "~") and not m[3].endswith("/") and tag in ("span", "ins", "label"):
            inline_dropped = tag
    flush()
    return root


# --- wrappers ----------------------------------------------------------------


class Wrapper:
    """A part of a wrapper: a block, a text slot ('#') or a repeated group ('()').

    n: pages that have it; same: hash of the slot's text if it never changes, else 0;
    mass, linked: characters of the slot, and of them in links.
    """

    __slots__ = ("label", "kids", "repeated", "optional", "n", "same", "mass", "linked")

    def __init__(self, label: str, kids: list, repeated=False, optional=False, n=1, same=0, mass=0, linked=0) -> None:
        self.label, self.kids, self.repeated, self.optional = label, kids, bool(repeated), bool(optional)
        self.n, self.same, self.mass, self.linked = n, same, mass, linked

    def labels(self) -> tuple[str, ...]:
        return tuple(k.label for k in self.kids) if self.label == "()" else (self.label,)

    def notation(self) -> str:
        """The regular expression."""
        inner = " ".join(k.notation() for k in self.kids)
        return f"({inner})+" if self.label == "()" else self.label + (f"[{inner}]" if self.kids else "") + "+" * self.repeated + "?" * self.optional

    def pack(self) -> list:
        return [self.label, [k.pack() for k in self.kids], int(self.repeated), int(self.optional), self.n, self.same, self.mass, self.linked]

    @staticmethod
    def unpack(x: list) -> Wrapper:
        return Wrapper(x[0], [Wrapper.unpack(k) for k in x[1]], *x[2:])


def generalise(block: Block) -> Wrapper:
    """The wrapper of one page or block; recursion is bounded by DEPTH."""
    kids = []
    for k in block.kids:
        if isinstance(k, tuple):
            kids.append(Wrapper("#", [], same=xxhash.xxh64_intdigest(k[0]) | 1, mass=len(k[0]), linked=min(k[1], len(k[0]))))
        elif k.kind == "!!":
            kids.append(Wrapper(k.label, []))
        else:
            kids.append(generalise(k))
    nodes: dict[str, Wrapper] = {}
    for k in kids:
        nodes[k.label] = merge(nodes[k.label], k, False) if k.label in nodes else k
    return Wrapper(block.label, arrange([(k.label,) for k in kids], nodes))


def parts(kids: list[Wrapper]) -> dict[str, Wrapper]:
    """The blocks and slots of a list, those in its groups too; no label comes twice."""
    return {p.label: p for k in kids for p in (k.kids if k.label == "()" else [k])}


def arrange(order: list[tuple[str, ...]], nodes: dict[str, Wrapper]) -> list[Wrapper]:
    """A list in which each label stands once: neighbours of one label are one repeated
    block; from the first to the last place of a label that recurs, all is one repeated
    group of optional parts.
    """
    runs = []
    for labels in order:
        if runs and runs[-1] == labels:
            nodes[labels[0]].repeated |= len(labels) == 1
        else:
            runs.append(labels)
    last = {x: i for i, labels in enumerate(runs) for x in labels}
    out, i = [], 0
    while i < len(runs):
        end, j, held = i, i, set()
        while j <= end:
            held.update(runs[j])
            end = max(end, *(last[x] for x in runs[j]))
            j += 1
        if len(held) == 1 and end == i:
            out.append(nodes[runs[i][0]])
        else:
            own = [nodes[x] for x in sorted(held)]
            for k in own:
                k.optional = True
            out.append(own[0] if len(own) == 1 else Wrapper("()", own, repeated=True, n=max(k.n for k in own)))
            out[-1].repeated = True
        i = end + 1
    return out


def merge(a: Wrapper, b: Wrapper, pages: bool) -> Wrapper:
    """Both in one; ``pages``: of different pages, else repeats within one."""
    return Wrapper(
        a.label,
        align(a.kids, b.kids, pages),
        a.repeated or b.repeated or not pages,
        a.optional or b.optional,
        a.n + b.n if pages else max(a.n, b.n),
        a.same if a.same == b.same and pages else 0,
        a.mass + b.mass,
        a.linked + b.linked,
    )


def align(a: list[Wrapper], b: list[Wrapper], pages: bool) -> list[Wrapper]:
    """Longest common subsequence of two lists; what doesn't match becomes optional, what crosses a repeated group."""
    pa, pb = parts(a), parts(b)
    nodes = {}
    for label in [*pa, *(x for x in pb if x not in pa)]:
        if label in pa and label in pb:
            nodes[label] = merge(pa[label], pb[label], pages)
        else:
            nodes[label] = pa.get(label) or pb[label]
            nodes[label].optional = True
        if not pages:  # each side's own repeats are known already
            nodes[label].repeated = (label in pa and pa[label].repeated) or (label in pb and pb[label].repeated)
    la, lb = [k.labels() for k in a], [k.labels() for k in b]
    if la == lb:
        return arrange(la, nodes)
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] == lb[j] else max(best[i + 1][j], best[i][j + 1])
    order, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and la[i] == lb[j]:
            order.append(la[i])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            order.append(la[i])
            i += 1
        else:
            order.append(lb[j])
            j += 1
    # one label on either side of a match isn't a repeat within a page, but it can't be told apart: it becomes one
    return arrange(order, nodes)


#: A wrapper's advice on a path of labels: mean text for a page that has it, and flags.
Rule = dict[str, tuple[int, str]]


def rule_of(whole: Wrapper) -> Rule:
    """Of each path: characters of own text for a page that has it; flags: 'f' frame, 'x' a slot that is left out, 'r' repeated."""
    steady = sum(x.mass for x in _slots(whole) if x.same and x.n > 1)
    # where most text never changes, as on a host of copies, that says nothing
    constants = 2 * steady < sum(x.mass for x in _slots(whole))
    out: Rule = {}

    def own(x: Wrapper) -> int:
        if x.label == "#":
            return 0 if constants and x.same and x.n > 1 else x.mass - x.linked
        return sum(own(k) for k in x.kids)

    def articles(x: Wrapper) -> int:
        return x.label.endswith("*") + sum(articles(k) for k in x.kids)

    total = own(whole)

    def walk(x: Wrapper, path: str) -> int:
        """Text of x outside its frame."""
        text = 0
        for k in x.kids:
            if k.label == "()":
                text += walk(k, path)
                continue
            at = f"{path}/{k.label}"
            if k.label == "#":
                left_out = constants and k.same and k.n > 1 or 2 * k.linked > k.mass
                mine, flag = own(k), "x" if left_out else ""
            elif k.label.endswith("!") or k.label.endswith("~") and (2 * own(k) <= total or articles(whole) > articles(k)):
                walk(k, at)
                mine, flag = 0, "f"
            else:
                mine, flag = walk(k, at), ""
            out[at] = (mine // max(1, k.n), flag + "r" * k.repeated)
            text += mine
        return text

    walk(whole, "")
    return out


def _slots(w: Wrapper) -> Iterator[Wrapper]:
    """All text slots but those of blocks that look like the frame."""
    todo = [w]
    while todo:
        x = todo.pop()
        if x.label == "#":
            yield x
        elif not x.label.endswith(("!", "~")):
            todo += x.kids


_SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
_NONE = (0, "")


def texts_by(root: Block, rule: Rule) -> list[str]:
    """Texts of the article of a page, by the rule of its host."""
    block, path, heading = root, "", None
    while True:
        kids = [k for k in block.kids if isinstance(k, Block)]
        held: dict[str, list[Block]] = {}
        for k in kids:
            if "f" not in rule.get(f"{path}/{k.label}", _NONE)[1]:
                held.setdefault(k.label, []).append(k)
        weights = {x: rule.get(f"{path}/{x}", _NONE)[0] * (PRIOR if own[0].kind == "*" else 1) for x, own in held.items()}
        if not weights:
            break
        best = max(weights, key=weights.get)
        rest = sum(weights.values()) + (rule.get(f"{path}/#", _NONE)[0] if len(kids) < len(block.kids) else 0)
        chosen = held[best][0]
        if len(held[best]) > 1 or chosen.tag in _SINGLE or weights[best] <= HEAVY * rest or weights[best] == 0:
            break
        first = [k for own in held.values() for k in own if k.tag == "h1"]
        if len(first) == 1 and kids.index(first[0]) < kids.index(chosen):
            heading = (first[0], f"{path}/{first[0].label}")
        block, path = chosen, f"{path}/{best}"
    out = list(_texts(block, path, rule))
    if heading and not any(b.tag == "h1" for b in _blocks(block)):
        out = [*_texts(*heading, rule), *out]
    return out


def _blocks(block: Block) -> Iterator[Block]:
    todo = [block]
    while todo:
        b = todo.pop()
        yield b
        todo += [k for k in b.kids if isinstance(k, Block) and k.kind != "!!"]


def _texts(block: Block, path: str, rule: Rule) -> Iterator[str]:
    """Texts of a block in page order, without the frame; of an article's header, the headings are kept."""
    todo: list[tuple] = [(k, path, False) for k in reversed(block.kids)]
    while todo:
        k, at, headings = todo.pop()
        if isinstance(k, tuple):
            if not headings and "x" not in rule.get(f"{at}/#", _NONE)[1]:
                yield k[0]
            continue
        at = f"{at}/{k.label}"
        if "f" in rule.get(at, _NONE)[1]:
            if k.tag != "header" or k.kind == "!!":
                continue
            headings = True
        elif headings and k.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"):
            headings = False
        todo += [(x, at, headings) for x in reversed(k.kids)]


def main_text(html: str | None, rule: Rule | None = None) -> str:
    """Main text of a page by the rule of its host; without one the page is its own wrapper."""
    if not html:
        return ""
    root = parse(html)
    return "\n".join(texts_by(root, rule_of(generalise(root)) if rule is None else rule))


def _structures(batches) -> Iterator[tuple]:
    """Pages added up by host and structure; a task that meets very many gives some of them in parts."""
    held: dict[tuple[str, str], Wrapper] = {}

    def out() -> tuple:
        rows = [(h, xxhash.xxh64_intdigest(s) % SALTS, s, json.dumps(w.pack())) for (h, s), w in held.items()]
        return tuple(map(list, zip(*rows, strict=True)))

    for hosts, pages in batches:
        for host, html in zip(hosts, pages, strict=True):
            if not html:
                continue
            w = generalise(parse(html))
            at = (host, w.notation())
            held[at] = merge(held[at], w, True) if at in held else w
        if len(held) > HELD:
            yield out()
            held.clear()
    if held:
        yield out()


def _fold_sorted(batches: Iterable[tuple]) -> Iterator[tuple]:
    """Rows sorted by host, salt and notation: those that follow each other with one host and salt are aligned."""
    now, w = None, None
    for hosts, salts, notations, packed in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for h, s, t, p in zip(hosts, salts, notations, packed, strict=True):
            x = Wrapper.unpack(json.loads(p))
            if (h, s) == now:
                w = merge(w, x, True)
                continue
            if now is not None:
                for o, v in zip(out, (*now, w.notation(), json.dumps(w.pack())), strict=True):
                    o.append(v)
            now, w = (h, s), x
        yield out
    if now is not None:
        yield [now[0]], [now[1]], [w.notation()], [json.dumps(w.pack())]


_WRAPPED = "host string, salt int, notation string, wrapper string"


def host_of(url: str):
    return F.coalesce(F.lower(F.regexp_extract(quoted(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, notation, wrapper) of each host."""
    small_batches(df.sparkSession)
    part = map_columns(df.select(host_of(url).alias("host"), quoted(html).cast("string").alias("html")), _WRAPPED, _structures)
    # rows of one structure are equal but for sums, so it doesn't matter which comes first
    part = map_columns(part.repartition("host", "salt").sortWithinPartitions("host", "salt", "notation"), _WRAPPED, _fold_sorted)
    part = part.withColumns({"order": F.col("salt"), "salt": F.lit(0)}).repartition("host").sortWithinPartitions("host", "order").drop("order")
    return map_columns(part, _WRAPPED, _fold_sorted).drop("salt")


def _rules(batches):
    for hosts, packed in batches:
        yield hosts, [json.dumps(rule_of(Wrapper.unpack(json.loads(p)))) for p in packed]


def extract(df: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per page: key, url, text, n_chars."""
    rules, _ = materialise(map_columns(wrappers(df, html, url).select("host", "wrapper"), "host string, rule string", _rules))
    pages = df.select(quoted(key).alias("id"), quoted(url).alias("url"), quoted(html).cast("string").alias("html"))
    ruled = pages.withColumn("host", host_of("url")).join(rules, "host", "left").select("id", "url", "html", "rule")

    def run(batches):
        known: dict[str, Rule] = {}
        for ids, urls, pages, found in batches:
            texts = []
            for h, r in zip(pages, found, strict=True):
                if r is not None and r not in known:
                    if len(known) >= HELD:
                        known.clear()
                    known[r] = json.loads(r)
                texts.append(main_text(h, known.get(r)))
            yield ids, urls, texts, [len(t) for t in texts]

    return map_columns(ruled, f"`{key}` {df.schema[key].dataType.simpleString()}, url string, text string, n_chars long", run)
