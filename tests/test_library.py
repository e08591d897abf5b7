"""Functions, readers and flows on hand-checked values."""

import math
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.functions import edits, logs, sets, text
from larkspan.operators import context, distributions, index, nil, rank, ranking, retrieve
from larkspan.plans import linking, store, views
from larkspan.sources import readers, writers
from larkspan.streaming.mentions import link_stream

SF = "/root/testdata/sf0.001"


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_text(spark):
    got = one(
        spark, norm=text.normalize(F.lit("D.C.")), strip=text.strip_parentheses(F.lit("Paris (a (b) c) X")), acronym=text.acronym_match(F.lit("ACLU"), F.lit("American Civil Liberties Union")),
        upper=text.is_acronym(F.lit("")), grams=text.ngrams(F.array(*map(F.lit, "abc")), 2), low=text.log_tf(F.lit(0.005)), one=text.log_tf(F.lit(1.0)), empty=text.dice(text.chars(F.lit("")), text.chars(F.lit(""))),
    )
    assert got == {"norm": "d c", "strip": "Paris  X", "acronym": 1.0, "upper": 1.0, "grams": ["a b", "b c"], "low": 0.0, "one": 1.0, "empty": 0.0}


def test_sets(spark):
    m = sets.of_arrays(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde")), F.lit(100.0))
    got = one(spark, **m)
    assert (got["intersect"], got["missing"]) == (2, 3)
    assert got["dice"] == pytest.approx(4 / 7) and got["jaccard"] == pytest.approx(2 / 5) and got["cosine"] == pytest.approx(2 / math.sqrt(12))
    assert got["approx_pmi"] == pytest.approx(1000 * 2 / 12) and got["google"] == pytest.approx(1 - (math.log(4) - math.log(2)) / (math.log(100) - math.log(3)))
    none = F.array().cast("array<string>")
    empty = one(spark, **sets.of_arrays(none, F.array(F.lit("a")), F.lit(100.0)))
    assert empty["missing"] == 1 and all(empty[k] == 0 for k in ("dice", "jaccard", "cosine", "pmi", "google"))


def test_edits():
    assert [edits.damerau(*p) for p in (("ca", "abc"), ("", "ab"), ("abcd", "acbd"), ("x", "x"))] == [2, 2, 1, 0]
    assert edits.jaro_winkler("dwayne", "duane") == pytest.approx(0.84) and edits.jaro_winkler("abcd", "axyz") == pytest.approx(0.5)


def test_logs(spark):
    p = [0.1, 0.02, 0.08, 0.45, 0.05, 0.3]
    df = spark.createDataFrame([(1, i, math.log(x)) for i, x in enumerate(p)], "g int, i int, x double")
    got = df.select("i", logs.posterior(F.col("x"), Window.partitionBy("g")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == pytest.approx(p)
    with pytest.raises(Exception, match="NaN or infinite"):
        spark.range(1).select(logs.sound(F.lit(float("nan")))).collect()


def test_ranking(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 5), ("a", 5, 6), ("a", 8, 9), ("b", 1, 1)], "k string, begin int, end int")
    assert sorted(map(tuple, ranking.merge_intervals(df, "k").collect())) == [("a", 1, 6), ("a", 8, 9), ("b", 1, 1)]
    keys = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, "z")], "n int, key string")
    assert [r.nil_id for r in nil.cluster_ids(keys, "key", "n").orderBy("n").collect()] == ["NIL0001", "NIL0002", "NIL0001", "NIL0003"]
    assert {(r.id, r.batch) for r in ranking.batch_ids(spark.range(10), "id", 4, 3).collect()} == {(i, i // 4) for i in range(10)}
    with pytest.raises(Exception, match="listed twice"):
        distributions.check(keys, "key", "key").collect()


def plain_names(doc, longest=6):
    """One document, word by word."""
    out, run, last = [], [], 0
    stop = set(text.STOP_WORDS)
    proper = lambda m: m[0][0].isupper() and m[0].lower() not in stop

    def close():
        while run and not proper(run[-1]):
            run.pop()
        if run and len(run) <= longest:
            out.append((doc[run[0].start() : run[-1].end()], run[0].start(), run[-1].end()))
        run.clear()

    for m in re.finditer(r"[^\W_]{2,}", doc):
        if "." in doc[last : m.start()]:
            close()
        if proper(m) or run and m[0].lower() in stop:
            run.append(m)
        else:
            close()
        last = m.end()
    close()
    return out


def test_names(spark):
    docs = ["the Bank of England said. Then London rose", "In A of The West. X", "", "One Two Three Four Five Six Seven", "Old York.New York of", None]
    docs += [r.text for r in views.table(spark, SF, "conversations").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, t string")
    got = sorted((r.k, r.name, r.begin, r.end) for r in context.fallback_names(df, "k", "t").collect())
    assert got == sorted((k, *n) for k, d in enumerate(docs) if d for n in plain_names(d))
    assert ("Bank of England" in {g[1] for g in got}) and len(got) > 50
    assert context.variants_of("ACLU", ["American Civil Liberties Union"]) == ["American Civil Liberties Union"]
    assert context.variants_of("D.C. Park", ["Old D.C. Park East"]) == ["D C Park", "Old D.C. Park East"]


def test_readers(spark, tmp_path):
    def put(name, body):
        (tmp_path / name).write_text(body)
        return str(tmp_path / name)

    q = put("q.xml", "<queries><query id='E1'><name>A b</name><docid>d1</docid></query><query id='E2'><name>C</name><docid>d2</docid><nodeid>N2</nodeid></query></queries>")
    a = put("a.tab", "E1\tN1\tPER\nE2\tN9\tORG\n")
    got = {r.mention_id: (r.node, r.type) for r in readers.mention_queries(spark, q, readers.annotations(spark, a)).collect()}
    assert got == {"E1": ("N1", "PER"), "E2": ("N2", "ORG")}
    s = put("s.sgm", '<DOC><DOCID> d1 </DOCID><DOCTYPE SOURCE="web">x</DOCTYPE><HEADLINE>Head</HEADLINE><TEXT><POSTER>me</POSTER>Body <P>one</P></TEXT></DOC>')
    assert tuple(readers.source_documents(spark, s).first()) == ("d1", "web", "Head Body one")
    r = put("run.txt", "q1 Q0 d1 1 0.5 t\nq1 Q0 d2 2 0.4 t\n")
    assert [(x.doc, x.score) for x in readers.run_file(spark, r, 1).collect()] == [("d1", 0.5)]
    with pytest.raises(Exception, match="not six columns"):
        readers.run_file(spark, put("bad.txt", "q1 Q0 d1\n")).collect()
    n = put("ner.txt", "1\tIn\tIn\tIN\tO\t0\t2\n2\tNew\tNew\tNNP\tLOC\t3\t6\n3\tYork\tYork\tNNP\tLOC\t7\t11\nbad\tline\n\n1\tBob\tBob\tNNP\tPER\t0\t3\n")
    runs = context.label_runs(readers.ner_lines(spark, n), ["file", "sentence"])
    assert sorted((x.label, x.words) for x in runs.collect()) == [("LOC", "New York"), ("PER", "Bob")]
    m = put("ids.tsv", "1\tA b\tAb\tE1\tPER\n2\tC\tC\tE2\tORG\n3\tC\tC\tE3\tORG\n")
    found = readers.lookup(spark.createDataFrame([("A_b",), ("C",), ("?",)], "t string"), readers.id_map(spark, m), "t", "wiki_title", "wiki_id", -1)
    assert {x.t: x.wiki_id for x in found.collect()} == {"A_b": 1, "C": 3, "?": -1}
    nlp = put("nlp.xml", '<root><document><sentences><sentence id="1"><tokens><token id="1"><word>Bob</word><NER>PERSON</NER></token><token id="2"><word>-LRB-</word><NER>O</NER></token></tokens><basic-dependencies><dep><governor idx="1">x</governor><dependent idx="2">y</dependent></dep></basic-dependencies></sentence></sentences></document></root>')
    assert [x.word for x in readers.nlp_tokens(spark, nlp).orderBy("pos").collect()] == ["Bob", "("]
    assert {(x.idx, x.is_root, x.is_leaf) for x in readers.vertices(readers.dependencies(spark, nlp)).collect()} == {(1, True, False), (2, False, True)}
    body = one(spark, l=readers.article_links(F.lit("<paragraph>x <link><target>New York</target><part>NY, US</part></link></paragraph><list><link><target></target></link><link>")))["l"]
    assert [(x.dest, x.anchor, x.par) for x in body] == [("New_York", "NY_ US", 0)]


def test_writers_and_model(spark, tmp_path):
    df = spark.createDataFrame([("m1", "E1", 0.0), ("m2", "NIL0001", -5.0), ("m3", "E3", 5.0)], "mention_id string, kb_id string, score double")
    writers.write_lines(writers.prediction_lines(df), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["m1\tE1\t0.500000", "m2\tNIL0001\t0.001000", "m3\tE3\t1.000000"]
    xml = '<ensemble><tree id="1" weight="0.5"><split><feature>1</feature><threshold>0.3</threshold><split pos="left"><output>-2</output></split><split pos="right"><output>4</output></split></split></tree></ensemble>'
    (tmp_path / "m.xml").write_text(xml)
    model = rank.Ensemble.read(str(tmp_path / "m.xml"))
    v = spark.createDataFrame([([0.3],), ([0.31],)], "vector array<double>")
    assert [tuple(r) for r in v.select(model.column(), model.expression()).collect()] == [(-1.0, -1.0), (2.0, 2.0)]


def test_flows(spark, tmp_path):
    kb, m = views.kb(spark, SF), views.mentions(spark, SF)
    linked = linking.link(m, kb, threshold=-11.0)
    assert linked.count() == m.count() and linked.columns == ["mention_id", "entity_id", "title", "score"]
    views.table(spark, SF, "benchmark").selectExpr("item_id AS mention_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("mention_id long, text string").parquet(str(tmp_path / "in"))
    link_stream(stream, kb, str(tmp_path / "out"), str(tmp_path / "ck"), threshold=-11.0).awaitTermination(240)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, linked.collect()))
    names = spark.createDataFrame([(1, [("the of", 1.0)])], "mention_id long, names array<struct<name:string,weight:double>>")
    assert linking.reverse(names, kb, 3).count() == 3


def test_entry_imports_without_a_session():
    """The driver imports the entry file before it makes a session."""
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)


def test_more_text(spark):
    got = one(
        spark, deep=text.strip_parentheses(F.lit("a (b (c (d (e (f) g) h) i) j) k")), open=text.strip_parentheses(F.lit("a (b")), stray=text.strip_parentheses(F.lit("a) b (c) d")), none=text.strip_parentheses(F.lit("abc")),
        place=text.place_name(F.lit("N.Y.")), nowhere=text.place_name(F.lit("zz")), stem=text.stem(F.lit("linking")), short=text.stem(F.lit("red")), spam=text.spam_anchor(F.lit("Quelle hier")), day=text.neighbor_name(F.lit("Monday")),
    )
    assert got == {"deep": "a  k", "open": "a ", "stray": "a)(c)", "none": "abc", "place": "New_York", "nowhere": None, "stem": "link", "short": "red", "spam": True, "day": False}
    assert len(text.SPAM_WORDS) == 25 and len(text.places()) == 78


def test_edits_walk_batches_like_pairs():
    import random

    rnd = random.Random(2)
    words = ["".join(rnd.choices("abc", k=rnd.randint(0, 7))) for _ in range(120)]
    a, b = words, words[::-1]

    def plain(x, y):
        last, far = {}, len(x) + len(y)
        d = {(-1, -1): far}
        for i in range(len(x) + 1):
            d[i, -1], d[i, 0] = far, i
        for j in range(len(y) + 1):
            d[-1, j], d[0, j] = far, j
        for i in range(1, len(x) + 1):
            row = 0
            for j in range(1, len(y) + 1):
                k, m = last.get(y[j - 1], 0), row
                same = x[i - 1] == y[j - 1]
                d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
                row = j if same else row
            last[x[i - 1]] = i
        return d[len(x), len(y)]

    assert edits.damerau_all(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert [edits.jaro_winkler(x, y) for x, y in zip(a, b)] == pytest.approx(edits.jaro_winkler_all(a, b).tolist())


def test_settings_and_providers(spark, tmp_path):
    from larkspan.sources.config import Providers, Settings

    (tmp_path / "default.properties").write_text("mu = 1000\n")
    (tmp_path / "ann.properties").write_text("# own\nmu = 96400  # large\ncandidates = 7\n")
    assert Settings.read(str(tmp_path), "bob", "h1") == Settings(mu=1000.0)
    own = Settings.read(str(tmp_path), "ann", "h1")
    assert (own.mu, own.candidates, own.nil_threshold) == (96400.0, 7, -10.0)
    own.apply(spark)
    assert spark.conf.get("larkspan.candidates") == "7"
    (tmp_path / "bob.properties").write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        Settings.read(str(tmp_path), "bob", "h1")
    opened = []
    p = Providers(kb=lambda: opened.append(1) or spark.range(3), default=lambda: spark.range(1))
    assert (p["kb"].count(), p["kb"].count(), p["other"].count(), len(opened)) == (3, 3, 1, 1)
    p.views()
    assert spark.sql("SELECT count(*) FROM kb").first()[0] == 3


def test_documents_by_id(spark):
    from larkspan.operators import retrieve

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (9,)], "doc_id long")
    assert [r.text for r in retrieve.fetch(docs, ids).collect()] == ["b"]
    with pytest.raises(Exception, match="no such document: 9"):
        retrieve.fetch(docs, ids, missing="error").collect()
    light = retrieve.without_payload(docs, "text")
    assert light.columns == ["doc_id"] and retrieve.with_payload(light.where("doc_id = 1"), docs, "doc_id", "text").first().text == "a"


def test_index_is_written_once(spark):
    ix = views.kb_index(spark, SF)
    assert views.kb_index(spark, SF) is ix
    assert ix.articles.select(F.sum("len")).first()[0] == ix.stats.select(F.sum("cf")).first()[0] == ix.collection[0]
    calls = []
    for _ in range(2):
        ix.keep("probe", lambda: calls.append(1) or spark.range(2))
    assert len(calls) == 1


def test_training(spark):
    import random

    rnd = random.Random(1)
    rows = [(m, e, [float(e == m % 5), rnd.random()], float(e == m % 5)) for m in range(60) for e in range(5)]
    model, mean = rank.train(spark.createDataFrame(rows, "mention_id long, entity_id long, vector array<double>, label double"), trees=3)
    assert mean > 0.95 and model.getNumTrees == 3


def test_more_readers_and_writers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "d1.txt.gz", "wt") as f:
        f.write("plain text")
    assert [tuple(r) for r in readers.plain_documents(spark, str(tmp_path / "d1.txt.gz")).collect()] == [("d1", "plain text")]
    got = one(spark, words=readers.paragraph_tokens(F.lit("<p>One <b>two</b><p>three")), strict=readers.strict_paragraph_text(F.lit("<d><p>a  b</p><p>c</p></d>")), f=readers.exact_fields(F.lit("a\tb"), 2))
    assert got == {"words": ["one", "two", "three"], "strict": ["a b", "c"], "f": ["a", "b"]}
    with pytest.raises(Exception, match="not 3 fields"):
        one(spark, f=readers.exact_fields(F.lit("a\tb"), 3))
    features = spark.createDataFrame([("m1", 1), ("m2", 2)], "mention_id string, x int").withColumn("set", F.lit("s"))
    writers.write_features(features, str(tmp_path / "f"))
    asked = spark.createDataFrame([("m2",), ("m9",)], "mention_id string")
    assert [r.x for r in readers.features(spark, str(tmp_path / "f"), asked).collect()] == [2]
    files = spark.createDataFrame([("a/b.sgm",), ("a/c.xml",), ("d.giga",)], "path string")
    assert {r.path for r in writers.corpus_files(files).collect()} == {"a/b.sgm", "d.giga"}
    run = spark.createDataFrame([("m1", 2, 2, 0.5), ("m1", 1, 1, 0.9)], "mention_id string, entity_id long, rank int, score double")
    linked = writers.linked(run, spark.createDataFrame([("m1", "A"), ("m2", "B")], "mention_id string, name string"))
    assert {r.mention_id: r.raw for r in linked.collect()} == {"m1": [1, 2], "m2": None}
    writers.write_linked(linked.drop("raw"), str(tmp_path / "x"))
    writers.write_table(run, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 2
    assert one(spark, b=rank.binary_names(F.lit("f"), F.lit(1)))["b"] == "f=1.0"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_articles(spark, n=60, words=12):
    import random

    rnd = random.Random(7)
    rows = [(i, [f"w{rnd.randrange(words)}" for _ in range(rnd.choice((0, 1, 3, 30, 140)))]) for i in range(n)] + [(n, None)]
    return rows, spark.createDataFrame(rows, "entity_id long, terms array<string>")


def test_grams_are_counted_where_they_lie(spark):
    rows, docs = some_articles(spark)
    for n, least in ((1, 1), (2, 3), (3, 2)):
        found = index.gram_counts(docs, n, least=least)
        assert "Exchange" not in plan_of(found)
        want = set()
        for i, w in rows:
            grams = [" ".join(w[j : j + k]) for k in range(1, n + 1) for j in range(len(w) - k + 1)] if w else []
            want |= {(i, g, grams.count(g), len(grams)) for g in grams if grams.count(g) >= least}
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_index_of_repeated_ids(spark):
    """Rows of one id are added up."""
    docs = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (2, ["b", "b"])], "entity_id long, terms array<string>").selectExpr("*", "'' AS title", "'' AS lang", "'' AS source")
    ix = store.Index(spark, "repeated", docs)
    assert sorted(map(tuple, ix.postings.distinct().collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 2)]
    assert sorted(map(tuple, ix.stats.collect())) == [("a", 2, 1), ("b", 3, 2)]


def test_scores_stay_in_their_buckets(spark):
    """Nothing but the best of each bucket is shuffled for a run, and a second pass scores the first one's entries only."""
    from larkspan.catalogue import retrieval

    m = views.mentions(spark, SF)
    scored = retrieval.score(spark, SF, retrieve.query(m, F.slice("terms", 1, 3)))
    assert "Exchange hashpartitioning" not in plan_of(scored) and scored.count() > 400
    own = retrieval.unigram_lm_topk(spark, SF)
    assert "Exchange hashpartitioning" not in plan_of(own) and own.count() > 400


def test_tokens_are_cut_in_generated_code(spark):
    texts = ["", " ", "..", "A-b  C9", "\u00c9t\u00e9 x\n\ty.", "no", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize("t").alias("n"), text.tokens("t").alias("w"))
    assert "lambda" not in plan_of(df)
    plain = [None if t is None else re.sub(r"[^a-z0-9]", " ", t.lower()).split() for t in texts]
    assert [(r.n, r.w) for r in df.collect()] == [(w and " ".join(w) if w is None or w else "", w) for w in plain]


def test_dependence_postings(spark):
    rows, docs = some_articles(spark)
    pairs = [("w0", "w1"), ("w1", "w0"), ("w2", "w2"), ("w3", "none")]
    found = retrieve.dependence_postings(docs, spark.createDataFrame([("w0",), ("w5",), ("w0",)], "term string"), spark.createDataFrame(pairs, "a string, b string"))
    assert "Exchange" not in plan_of(found)
    want = set()
    for i, w in rows:
        w = w or []
        counts = {f"0:{x}": w.count(x) for x in ("w0", "w5")}
        for a, b in pairs:
            counts[f"1:{a} {b}"] = sum(x == a and y == b for x, y in zip(w, w[1:]))
            counts[f"2:{a} {b}"] = sum(w[p] == a and w[r] == b for p in range(len(w)) for r in range(max(0, p - 7), min(len(w), p + 8)) if p != r)
        want |= {(i, k, n, len(w)) for k, n in counts.items() if n}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    one_word = retrieve.dependence_postings(docs, spark.createDataFrame([("w0",)], "term string"), spark.createDataFrame([], "a string, b string"))
    assert one_word.count() == sum("w0" in (w or []) for _, w in rows)


def test_best_passages(spark):
    rows, docs = some_articles(spark)
    asked = [(1, "w0", 0.5, 0.1), (1, "w1", 0.5, 0.2), (2, "w1", 1.0, 0.2), (3, "none", 1.0, 0.1)]
    found = retrieve.best_passages(docs, spark.createDataFrame(asked, "mention_id long, term string, weight double, p double"), 20.0)
    assert "Exchange" not in plan_of(found)
    want = {}
    for i, w in rows:
        for begin in range(0, len(w or []), 25):
            held = w[begin : begin + 50]
            for m in (1, 2, 3):
                own = [(t, x, p) for q, t, x, p in asked if q == m and t in held]
                if own:
                    want.setdefault((m, i), []).append((-round(sum(x * math.log(1 + held.count(t) / (20.0 * p)) for t, x, p in own), 6), begin))
    got = {(r.mention_id, r.entity_id): (-round(r.score, 6), r.begin) for r in found.collect()}
    assert got == {k: min(v) for k, v in want.items()}


def test_evidence_is_looked_up_in_generated_code(spark):
    plan = plan_of(views._qrels(spark, SF, views.kb_index(spark, SF)))
    assert "lambda" not in plan and "hashpartitioning(entity_id" not in plan
    docs = {r.doc_id: r.text for r in views.table(spark, SF, "documents").collect()}
    asked = {r.item_id: r.text[:60] for r in views.table(spark, SF, "benchmark").collect()}
    want = {(m, d) for m, e in asked.items() for d, t in docs.items() if e in t and len(e.split(" ")) >= 5}
    assert want and set(map(tuple, views.qrels(spark, SF).collect())) == want


def test_second_pass_scores_listed_entries_only(spark):
    from larkspan.catalogue import entities

    plan = plan_of(entities.two_pass_feedback(spark, SF))
    assert "LeftSemi" in plan and plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(mention_id")


def test_frequent_grams_are_cut_where_they_lie(spark):
    """What an article holds less than three times doesn't leave it."""
    from larkspan.catalogue import retrieval

    assert "Exchange" not in plan_of(retrieval.document_ngram_lm(spark, SF))
