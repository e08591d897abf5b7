"""Operators 1, 2, 3, 6, 7, 8 and the pipeline against brute force, exact round trips and labels."""

import hashlib
import random
import re
import sys
import time
import zlib
from collections import defaultdict
from html import unescape
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

import corpus_pipeline
from larkspan.llm import bpe, packing, pii, quality, queries, spotsigs, wrappers

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.ODD, brute.SCHEMA).withColumns({"key": F.lit(1), "_text": F.lit(2)})


def test_wrappers_driver_pages(spark):
    got = {r.page_id: r for r in queries.op1_wrappers(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


PAGE = '<html><body><div id="top-menu"><ul><li><a href=x>Home</a></li></ul></div><h1>Title {0}</h1><div class=wrap><div class="content"><p>First para {0} &eacute; that is long enough<p>Second &amp; para {0}<script>var a="<p>no</p>"</script></div><div class="sidebar"><p>side</p></div></div><p>The same on all pages</p><div class=comments><p>reader</p></div></body></html>'


def test_wrappers_odd_pages(spark):
    rows = [(i, "http://h.example/x", PAGE.format(i)) for i in range(5)]
    rows += [(10, None, None), (11, "odd url", ""), (12, "http://a.example", "<p>a<p>b  c<br>d"), (13, "http://a.example", "<div " * 5000), (14, "http://b.example", '<a "' * 5000), (14, "http://b.example", "<!-- open"), (15, "http://c.example", "<form><article><header><h1>T</h1><p>by</p></header><p>x</article></form>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "text": F.lit(3)})
    got = sorted((r.page_id, r.text) for r in wrappers.extract(df).collect())
    assert got[2] == (2, "Title 2\nFirst para 2 é that is long enough\nSecond & para 2")
    assert got[5:] == [(10, ""), (11, ""), (12, "a\nb c d"), (13, ""), (14, ""), (14, ""), (15, "T\nx")]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrapper_alignment():
    w = None
    for body in ("<div><p>a</div>", "<div><p>a<p>b</div>", "<div><ul><li>x</ul><p>a</div>"):
        x = wrappers.generalise(wrappers.parse(body))
        w = x if w is None else wrappers.merge(w, x, True)
    assert w.notation() == "[div[ul[li[#]]? p[#]+]]"
    x = wrappers.generalise(wrappers.parse("<p>a<h2>b</h2><p>c<h2>d</h2><p>e<ul></ul>"))
    assert x.notation() == "[(h2[#]+? p[#]+?)+ ul]"


LAYOUTS = (
    # no article tags, and classes that say nothing: only the host's other pages tell what is text
    ("http://one.example/{0}", '<body><div class="a1"><a href=/>Home</a> <a href=/x>All</a></div><div class="b2"><h1>Title {0}</h1><div class="k">{1}</div><div class="z9">Read more on one.example, the page of all pages, every day and every night of the week, at no cost</div></div><div class="c3">One Media since 1999, all rights reserved</div></body>'),
    ("http://two.example/{0}", "<body><table><tr><td><ul><li><a href=1>x</a><li><a href=2>yy</a></ul></td><td><h1>Title {0}</h1>{1}</td></tr></table><p>Printed by two.example every day</p></body>"),
    # the words of the class speak of the frame, but it holds the text
    ("http://three.example/{0}", '<body><nav><p>menu</p></nav><div class="content widget"><h1>Title {0}</h1>{1}</div><div class="widget">win {0}</div></body>'),
    # a teaser in an article tag, and the text in main
    ("http://four.example/{0}", '<body><main><h1>Title {0}</h1>{1}<aside><article><h2>Teaser {0}</h2></article></aside></main><footer>f {0}</footer></body>'),
    ("http://four.example/{0}", '<body><div id="x{0}"><h1>Title {0}</h1>{1}</div><footer>f {0}</footer></body>'),
)


def test_wrappers_layouts(spark):
    rows, want = [], {}
    for n, (url, page) in enumerate(LAYOUTS):
        for i in range(12):
            body = [f"Paragraph {j} of text {i} that goes on for some {i * j} words." for j in range(2 + i % 4)]
            k = 100 * n + i
            rows.append((k, url.format(i), page.format(k, "".join(f"<p>{x}</p>" for x in body))))
            want[k] = "\n".join([f"Title {k}", *body])
    schema = "page_id long, url string, html string"
    results = []
    for parts in (1, 4, 211):
        df = spark.createDataFrame(rows if parts == 1 else rows[::-1], schema).repartition(parts)
        results.append({r.page_id: r.text for r in wrappers.extract(df).collect()})
    assert results[0] == want
    assert results[0] == results[1] == results[2]
    plain = {r[0]: wrappers.main_text(r[2]) for r in rows}
    assert any(plain[k] != want[k] for k in want)  # a page of its own can't tell


def test_wrappers_long_lists_and_quotes():
    body = "".join(f"<p>text {i} is here</p>" + "<ul><li>a</ul>" * (i % 2) for i in range(300))
    w = wrappers.generalise(wrappers.parse(f"<div>{body}</div>"))
    assert w.notation() == "[div[(p[#]+? ul[li[#]]+?)+]]"
    assert wrappers.main_text("""<div><p>three</p><a href="x>one</a> two<p title='a>b'>five</p></div>""") == "three\none two\nfive"


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    marks = [(40, "one <|endoftext|> two"), (41, "word " * 40 + "<|endoftext|>" + " word" * 40), (42, "a\u00a0b " * 30 + "x"), (43, "don't it's we're " * 9 + "end"), (44, "tab\tline\n " * 20)]
    for df in (spark.createDataFrame(marks, "doc_id long, text string"), odd, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        pieces, seqs = defaultdict(list), defaultdict(list)
        for r in packing.pack_documents(df, bpe.public_path("byte_bpe_50k.json"), bpe.public_pattern()).collect():
            pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
            seqs[r.sequence_id].append((r.offset, r.length))
        want = defaultdict(list)
        for d, x in texts:
            want[d].append(np.array([*t.encode(x, add_special_tokens=False).ids, 0], dtype="<u4"))
        padded = total = 0
        for own in seqs.values():
            at = 0
            for o, n in sorted(own):
                assert o == at
                at += n
            assert at <= 1024
            padded, total = padded + packing.padding(at), total + at
        assert padded < 0.05 * total
        for d, docs in want.items():
            assert sum(p[1] for p in pieces[d]) == sum(map(len, docs))
            if len(docs) == 1:
                for start, n, crc, tokens in pieces[d]:
                    assert tokens == len(docs[0]) and zlib.crc32(docs[0][start : start + n].tobytes()) == crc
    assert packing.pack_documents(odd.limit(0), bpe.public_path("byte_bpe_50k.json"), bpe.public_pattern()).count() == 0


def test_cut_is_cheapest():
    rng = np.random.default_rng(4)
    for _ in range(20):
        pos = [0, *np.cumsum(rng.integers(1, 12, 14)).tolist()]
        pen = [0, *rng.integers(0, 9, len(pos) - 1).tolist()]
        cost = [0] + [10**9] * (len(pos) - 1)
        for i in range(1, len(pos)):
            for j in range(i):
                if pos[i] - pos[j] <= 16:
                    cost[i] = min(cost[i], cost[j] + 16 - pos[i] + pos[j] + pen[i] + packing.OPEN)
        at = {p: k for k, p in enumerate(pos)}
        cuts = packing.cut(pos, pen, 16)
        assert sum(16 - b + a + pen[at[b]] + packing.OPEN for a, b in zip(cuts, cuts[1:])) == cost[-1]


def test_bpe(spark, odd):
    c = bpe.coder(bpe.public_path("byte_bpe_multi_50k.tiktoken"), bpe.public_pattern())
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = np.array(c.encoding.encode_ordinary(r.text or ""), dtype="<u4")
            want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = bpe.encode_decode(df, bpe.public_path("byte_bpe_multi_50k.tiktoken"), bpe.public_pattern())
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    for text in ("a  b\n\n c" * 400, "x" * 3000, "é中 " * 900, " " * 2000 + "y"):
        assert b"".join(p.encode() for p in c.pieces(text, 256, 32)) == text.encode()
        assert b"".join(np.array(c.encoding.encode_ordinary(p), dtype="<u4").tobytes() for p in c.pieces(text, 256, 32)) == np.array(c.encoding.encode_ordinary(text), dtype="<u4").tobytes()


def base_pii(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return out


def test_pii(spark, odd):
    more = spark.createDataFrame([(30, "a@b.c a.@b-.d.e @x 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +49 (30) 1234-5678 +1", "en", "s", 1), (31, "call (212) 555-0187 or mail john at example dot com today", "en", "s", 1)], brute.SCHEMA)
    for df in (odd.select(more.columns).union(more), spark.read.parquet(f"{SF2}/documents.parquet")):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(base_pii(r.text or ""))
        for r in pii.find(df).collect():
            ok = [b for b in texts[r.doc_id] if hashlib.sha256(pii.written(b).encode()).hexdigest() == r.base_sha256]
            assert ok, r
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in ok[0]) for k in range(4))
            assert set(filter(None, pii.written(ok[0]).split(","))) <= set(r.spans.split(","))
    assert pii.find(odd.limit(0)).count() == 0


def test_pii_forward_backward():
    text = "call (212) 555-0187 now"
    tokens = pii.tokens_of(text, 0, len(text))
    spans, _, scores = pii.potentials(tokens, pii.train())
    _, share = pii.forward_backward(len(tokens), spans, scores)
    covering = np.zeros(len(tokens))
    for (a, b), s in zip(spans, share.sum(axis=1)):
        covering[a:b] += s
    assert (covering < 1 + 1e-9).all()
    assert "phone" in pii.written(pii.added_spans(text, [], pii.train()))


def test_pii_best_path_is_best():
    rng = np.random.default_rng(6)
    for n in (1, 3, 6):
        spans = [(a, b) for a in range(n) for b in range(a + 1, min(n, a + 3) + 1)]
        scores = rng.normal(size=(len(spans), 2)) * 2

        def ways(p):
            """All segmentations from p on, as (score, ...spans)."""
            if p == n:
                return [(0.0, ())]
            out = [(v, x) for v, x in ways(p + 1)]
            for i, (a, b) in enumerate(spans):
                if a == p:
                    out += [(v + scores[i, k], ((i, k), *x)) for v, x in ways(b) for k in range(2)]
            return out

        every = ways(0)
        best = max(every, key=lambda x: x[0])
        assert tuple(pii.best_path(n, spans, scores)) == best[1]
        total, share = pii.forward_backward(n, spans, scores)
        assert np.isclose(total, np.log(sum(np.exp(v) for v, _ in every)))
        for i in range(len(spans)):
            for k in range(2):
                assert np.isclose(share[i, k], sum(np.exp(v) for v, x in every if (i, k) in x) / np.exp(total))


def test_pii_held_out():
    """Precision and recall of added spans on regions that the weights haven't seen, between other text."""
    rnd, w = random.Random(99), pii.train()
    right = wrong = missed = 0
    for _ in range(400):
        region, gold = pii._generated(rnd)
        text = f"und so weiter. {region} und so fort"
        base = pii.base_spans(text)
        want = {(k, a + 15, b + 15) for k, a, b in gold if not any(x < b + 15 and a + 15 < y for _, x, y in base)}
        got = set(pii.added_spans(text, base, w))
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    print("precision", right / (right + wrong), "recall", right / (right + missed), right)
    assert right > 0.9 * (right + wrong) and right > 0.75 * (right + missed)


def test_pii_many_candidates():
    """Very many numbers in one text; words for the signs in any case."""
    began = time.process_time()
    text = " ".join(f"({200 + i % 700}) 555-{i % 10000:04d} or a@b{i}.org," for i in range(1500))
    base, w = pii.base_spans(text), pii.train()
    many = pii.added_spans(text, base, w)
    assert len(many) > 1400 and time.process_time() - began < 60
    assert pii.written(pii.added_spans("mail john At example Dot com today", [], w)).startswith("email:")


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    content = [(i, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    chains = {(w, *[c for j, c in content if j > i][:2]) for i, w in enumerate(words) if w in spotsigs.ANCHORS}
    chains = {c for c in chains if len(c) == 3}
    return chains | ({("start", *([c for _, c in content[:2]] or words or [text]))} if text else set())


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs(spark, odd):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: -r[0] if r[0] is not None else 10**9)
        result = spotsigs.adjacent(df).collect()
        got = {(r.doc_id, r.n_chars, r.edited_sha256): (round(r.near_edited, 9), round(r.near_next, 9), r.fingerprint, r.edited_fingerprint) for r in result}
        assert len(result) == len(rows)
        ids, prints = [r[0] for r in rows], {}
        plain = [plain_signatures(t) if len(t) < 40000 else None for _, t in rows]
        for i, (d, t) in enumerate(rows):
            after = rows[(i + 1) % len(rows)]
            if ids.count(after[0]) > 1 and len({x for y, x in rows if y == after[0]}) > 1:
                continue  # which of the rows of one id comes first isn't told
            n = len(t)
            edited = t[: n - n // 2] + after[1][: n // 2]
            found = got[d, n, hashlib.sha256(edited.encode()).hexdigest()]
            assert found[2] == spotsigs.written(spotsigs.signatures(t)) and found[3] == spotsigs.written(spotsigs.signatures(edited))
            assert prints.setdefault(t, found[2]) == found[2]
            own, other = plain[i], plain[(i + 1) % len(rows)]
            if own is not None and other is not None and len(edited) < 40000:
                assert found[:2] == (round(likeness(own, plain_signatures(edited)), 9), round(likeness(own, other), 9))
    assert spotsigs.adjacent(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [256, 4])
def test_spotsigs_near_duplicates(spark, block):
    """Length partitions, prefixes and pruned Jaccard against all pairs."""
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        base = [x for _ in range(rnd.randint(3, 60)) for x in ("the", *rnd.sample(words, 2))]
        for edits in (0, 0, 1, 2, 5, 9):
            v = list(base)
            for _ in range(edits):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            rows.append((len(rows), " ".join(v)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, "the"), (1003, "the")]
    sets = {d: set(spotsigs.signatures(t)) for d, t in rows if d is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and likeness(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == brute.roots(sets, pairs) and len(set(got.values())) < len(got) - 30
    for a, b in pairs[:200]:
        x, y = sorted(sets[a]), sorted(sets[b])
        assert spotsigs.jaccard(x, y, 0.8) == spotsigs.jaccard(x, y)


def test_spotsigs_frequent(spark):
    """Many texts that share a long passage and little else: its signatures are told apart, and links are those of all pairs."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(20000)]
    some = lambda n: [x for _ in range(n) for x in ("the", *rnd.sample(words, 2))]
    shared, rows = some(30), []
    for i in range(120):
        base = some(30) + shared
        for edits in (0, 1)[: 1 + (i % 4 == 0)]:
            rows.append((len(rows), " ".join([*base, *(["the", "w1", "w2"] * edits)])))
    df = spark.createDataFrame([(spotsigs.written(spotsigs.signatures(t)),) for _, t in rows], "fp string")
    counts = spotsigs._frequent(df)
    passage = [s for s in spotsigs.signatures(" ".join(shared)) if all(s in spotsigs.signatures(t) for _, t in rows[:5])]
    assert len(passage) >= 28 and min(counts[s % spotsigs.CELLS] for s in passage) >= 120
    assert (counts > 0).sum() < 0.1 * len({s for _, t in rows for s in spotsigs.signatures(t)})
    sets = {d: set(spotsigs.signatures(t)) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and likeness(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.component_id for r in spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert len(pairs) == 30 and got == brute.roots(sets, pairs)


def test_quality(spark, odd):
    got = {r.doc_id: r for r in queries.op3_quality(spark, SF2).collect()}
    labels = spark.read.parquet(f"{SF2}/labels.parquet").collect()
    right = sum(got[r.doc_id].accepted == (r.quality == 1) for r in labels)
    assert right >= 0.97 * len(labels)
    assert all(got[r.doc_id].accepted for r in labels if r.quality == 1)
    more = odd.withColumns({"_score": F.col("doc_id"), "a.b": F.col("doc_id")})
    s = quality.scored(more, name="score")
    assert s.columns == [*more.columns, "score"] and s.count() == odd.count()
    assert all(r.score == 0 for r in s.where("text is null or trim(text) = ''").collect())
    kept = quality.accepted(more)
    assert kept.columns == more.columns and all(r["_score"] == r["a.b"] == r.doc_id for r in kept.collect())
    assert quality.scored(odd.limit(0)).count() == 0


def test_quality_plain_em():
    """Posteriors and accuracies against EM over documents, one at a time."""
    rng = np.random.default_rng(8)
    truth = rng.random(600) < 0.8
    votes = np.stack([np.where(rng.random(600) < 0.3, 0, np.where(rng.random(600) < right, 1, -1) * np.where(truth, 1, -1)) for right in (0.95, 0.9, 0.8, 0.7)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, accuracy = quality.fit_labellers(patterns, counts.astype(float))
    p = [0.1 if -1 in v else 0.95 if 1 in v else 0.5 for v in votes.tolist()]
    for _ in range(200):
        prior = min(0.98, max(0.02, sum(p) / len(p)))
        shares = []
        for weight in (p, [1 - x for x in p]):
            for j in range(4):
                up = sum(x for x, v in zip(weight, votes) if v[j] == 1) / len(p) + 1e-4
                down = sum(x for x, v in zip(weight, votes) if v[j] == -1) / len(p) + 1e-4
                shares.append({1: up / (up + down), -1: down / (up + down), 0: 1.0})
        new = []
        for v in votes.tolist():
            good, bad = prior, 1 - prior
            for j in range(4):
                good, bad = good * shares[j][v[j]], bad * shares[4 + j][v[j]]
            new.append(good / (good + bad))
        p = new
    assert np.allclose(post[inverse.ravel()], p, atol=1e-4)
    assert np.mean((post[inverse.ravel()] > 0.5) == truth) > 0.95
    assert (np.diff(accuracy) < 0).all()


def test_quality_plain_scorer():
    """The scorer against plain gradient descent on the same loss."""
    rng = np.random.default_rng(9)
    rows = [{int(i): float(v) for i, v in zip(rng.choice(40, 5, replace=False), rng.normal(size=5))} for _ in range(200)]
    labels = np.array([1 / (1 + np.exp(-sum(v * (i % 5 - 2) for i, v in r.items()))) for r in rows])
    w, bias = quality.fit_scorer(rows, labels)
    x = np.zeros((200, 40))
    for k, r in enumerate(rows):
        x[k, list(r)] = list(r.values())
    v, b = np.zeros(40), 0.0
    for _ in range(20000):
        g = 1 / (1 + np.exp(-(x @ v + b))) - labels
        v, b = v - 1.0 * (x.T @ g / 200 + 1e-5 * v), b - 1.0 * g.mean()
    assert np.abs(w[:40] - v).max() < 0.1 and abs(bias - b) < 0.05 and not w[40:].any()
    assert np.abs(1 / (1 + np.exp(-(x @ w[:40] + bias))) - labels).max() < 0.05


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text").collect()
    good = {r.doc_id for r in queries.op3_quality(spark, SF2).where("accepted").collect()}
    kept = [(r.doc_id, r.text) for r in docs if r.doc_id in good]
    firsts = brute.near_firsts(kept)
    kept = [(d, t) for d, t in kept if d in firsts]
    from larkspan.llm import passages, secrets

    text = passages.remove_repeats(spark.createDataFrame(kept, "doc_id long, text string"), layout=True, counts=("n_words", "n_removed"))
    removed = {d: n for d, _, n, _ in brute.repeats(kept)}
    assert {r.doc_id: r.n_removed for r in text.collect()} == removed
    masked = {r.doc_id: r.text for r in secrets.redact(text.select("doc_id", "text")).collect()}
    from tokenizers import Tokenizer

    c = Tokenizer.from_file(bpe.public_path("byte_bpe_50k.json"))
    want = {d: len(c.encode(t, add_special_tokens=False).ids) + 1 for d, t in masked.items()}
    got, lengths = {}, defaultdict(int)
    for r in corpus_pipeline.run(spark, SF2).collect():
        got[r.doc_id] = r.doc_tokens
        lengths[r.doc_id] += r.length
    assert got == want == lengths


def test_stages_keep_columns(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF).count() == 0
