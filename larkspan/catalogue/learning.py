"""Features of (mention, entry), vectors, scoring, re-ranking, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspan.catalogue import MENTION, QREL, RUN, query, r6
from larkspan.catalogue.retrieval import run
from larkspan.catalogue.strings import _chars, _dice
from larkspan.functions import logs, sets, text
from larkspan.operators import rank, ranking
from larkspan.plans import views
from larkspan.sources import writers

FEATURES = ("char_dice", "word_dice", "exact", "first_letter", "suffix", "log_len")
#: A small fixed ensemble for the registered queries; features count from 1.
TOY = rank.Ensemble(
    [
        (0.1, [(1, 0.5, 1, 2, 0.0), (0, 0.0, 1, 1, -1.0), (7, 0.25, 3, 4, 0.0), (0, 0.0, 3, 3, 0.5), (0, 0.0, 4, 4, 2.0)]),
        (0.1, [(8, -9.0, 1, 2, 0.0), (0, 0.0, 1, 1, -0.5), (0, 0.0, 2, 2, 1.5)]),
        (0.1, [(4, 0.5, 1, 2, 0.0), (0, 0.0, 1, 1, 0.0), (2, 0.1, 3, 4, 0.0), (0, 0.0, 3, 3, 0.25), (0, 0.0, 4, 4, 1.0)]),
    ]
)


def name_feature_rows(spark, d):
    """The run with the features of the mention's name against the entry's title."""
    r = run(spark, d).join(views.mentions(spark, d).select("mention_id", "name"), "mention_id").join(views.kb(spark, d).select("entity_id", "title"), "entity_id")
    a, b = F.col("name"), F.col("title")
    return r.select(
        "mention_id", "entity_id", "score", "rank", "title",
        r6(text.dice(text.chars(a), text.chars(b))).alias("char_dice"), r6(text.dice(text.words(a), text.words(b))).alias("word_dice"), text.exact_match(a, b).alias("exact"),
        text.first_letter_match(a, b).alias("first_letter"), text.suffix_of(a, F.right(b, F.lit(2))).alias("suffix"), r6(F.log(F.greatest(F.lit(1.0), F.length(b).cast("double")))).alias("log_len"),
    )


_W = lambda x: f"list_distinct(list_filter(string_split({x},' '), lambda c: c<>''))"
_FEATURES = f"""{RUN}, ft AS (SELECT r.mention_id, r.entity_id, r.score, r.rank, title, round({_dice(_chars('name'), _chars('title'))},6)::DOUBLE AS char_dice, round({_dice(_W('name'), _W('title'))},6)::DOUBLE AS word_dice, (name=title)::INT::DOUBLE AS exact,
(name<>'' AND title<>'' AND left(name,1)=left(title,1))::INT::DOUBLE AS first_letter, (name<>'' AND ends_with(name,right(title,2)))::INT::DOUBLE AS suffix, round(ln(greatest(1.0,length(title))),6)::DOUBLE AS log_len FROM run r JOIN ment USING (mention_id) JOIN kb USING (entity_id))"""


@query(f"WITH {_FEATURES} SELECT mention_id, entity_id, rank, char_dice, word_dice, exact, first_letter, suffix, log_len FROM ft")
def name_features(spark, d):
    return name_feature_rows(spark, d).select("mention_id", "entity_id", "rank", *FEATURES)


@query(f"""WITH {RUN}, v AS (SELECT mention_id, name AS variant FROM ment UNION SELECT mention_id, terms[1] FROM ment UNION SELECT mention_id, terms[1]||' '||terms[2] FROM ment), f AS (SELECT r.mention_id, r.entity_id, {_dice(_chars('variant'), _chars('title'))}::DOUBLE AS x FROM run r JOIN v USING (mention_id) JOIN kb USING (entity_id))
SELECT mention_id, entity_id, round(min(x),6) AS dice_min, round(max(x),6) AS dice_max, round(avg(x),6) AS dice_avg, count(*) AS n FROM f GROUP BY ALL""")
def variant_minmaxavg(spark, d):
    m = views.mentions(spark, d).select("mention_id", F.explode(F.array_distinct(F.array("name", F.try_element_at("terms", F.lit(1)), F.array_join(F.slice("terms", 1, 2), " ")))).alias("variant"))
    r = run(spark, d).select("mention_id", "entity_id").join(m, "mention_id").join(views.kb(spark, d).select("entity_id", "title"), "entity_id")
    x = text.dice(text.chars(F.col("variant")), text.chars(F.col("title")))
    return r.withColumn("x", x).groupBy("mention_id", "entity_id").agg(r6(F.min("x")).alias("dice_min"), r6(F.max("x")).alias("dice_max"), r6(F.avg("x")).alias("dice_avg"), F.count("*").alias("n"))


@query(f"""WITH {RUN}, c AS (SELECT DISTINCT mention_id, unnest(terms[4:]) AS term FROM ment) SELECT r.mention_id, r.entity_id, round(count(p.term)/count(c.term),6) AS share FROM run r JOIN c USING (mention_id) LEFT JOIN post p ON p.entity_id=r.entity_id AND p.term=c.term GROUP BY ALL""")
def context_share(spark, d):
    """Share of a mention's context words that the entry's text holds."""
    c = views.mentions(spark, d).select("mention_id", F.explode(F.array_distinct(F.slice("terms", F.lit(4), F.size("terms")))).alias("term"))
    post = views.kb_index(spark, d).of(c).select("entity_id", "term", F.lit(1).alias("hit"))
    j = run(spark, d).select("mention_id", "entity_id").join(c, "mention_id").join(post, ["entity_id", "term"], "left")
    return j.groupBy("mention_id", "entity_id").agg(r6(F.count("hit") / F.count("*")).alias("share"))


@query(f"""WITH {RUN}, top1 AS (SELECT mention_id, entity_id FROM run WHERE rank=1), nb AS (SELECT r.mention_id, r.entity_id AS a, t.entity_id AS b FROM run r JOIN top1 t ON t.mention_id IN (r.mention_id+1, r.mention_id+2)),
pr AS (SELECT DISTINCT a, b FROM nb), i AS (SELECT a, b, count(*) AS i FROM pr JOIN post x ON x.entity_id=a JOIN post y ON y.entity_id=b AND y.term=x.term GROUP BY ALL), n AS (SELECT entity_id, count(*) AS n FROM post GROUP BY 1),
f AS (SELECT a, b, coalesce(i,0) AS i, n1.n AS n1, n2.n AS n2 FROM pr LEFT JOIN i USING (a,b) JOIN n n1 ON n1.entity_id=a JOIN n n2 ON n2.entity_id=b),
g AS (SELECT mention_id, a AS entity_id, (a=b)::INT AS same, i/(n1+n2-i) AS jac, 2.0*i/(n1+n2) AS dice FROM nb JOIN f USING (a,b))
SELECT mention_id, entity_id, count(*) AS neighbors, sum(same)::BIGINT AS same, round(min(jac),6) AS jaccard_min, round(max(jac),6) AS jaccard_max, round(avg(jac),6) AS jaccard_avg, round(sum(dice),6) AS dice_sum FROM g GROUP BY ALL""")
def e2e_features(spark, d):
    """Overlap of each candidate with the best entries of the two next mentions, aggregated over these."""
    r = run(spark, d).select("mention_id", F.col("entity_id").alias("a"), "rank")
    top = r.where("rank = 1").select(F.explode(F.array(F.col("mention_id") - 1, F.col("mention_id") - 2)).alias("mention_id"), F.col("a").alias("b"))
    near = r.drop("rank").join(top, "mention_id")
    listed = near.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    own = views.kb_index(spark, d).postings.join(listed, "entity_id", "left_semi").select(F.col("entity_id").alias("k"), "term")
    f = sets.of_rows(own, near.select("a", "b").distinct(), "k", "term", "a", "b")
    m = sets.measures(F.col("i"), F.col("n1"), F.col("n2"))
    g = near.join(f.select("a", "b", m["jaccard"].alias("jac"), m["dice"].alias("dice")), ["a", "b"])
    return g.groupBy("mention_id", F.col("a").alias("entity_id")).agg(
        F.count("*").alias("neighbors"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("same"), r6(F.min("jac")).alias("jaccard_min"), r6(F.max("jac")).alias("jaccard_max"), r6(F.avg("jac")).alias("jaccard_avg"), r6(F.sum("dice")).alias("dice_sum")
    )


@query(f"""WITH {RUN}, e AS (SELECT *, max(score) OVER w AS top, sum(exp(score)) OVER w AS z FROM run WINDOW w AS (PARTITION BY mention_id)) SELECT mention_id, entity_id, round(exp(score),9) AS exp_score, round(exp(top)/z,6) AS norm_top, round(exp(score)/z,6) AS softmax, round(ln(z),6) AS lse FROM e""")
def score_softmax(spark, d):
    w = Window.partitionBy("mention_id")
    s = F.col("score")
    lse = logs.log_sum_exp(s, w)
    return run(spark, d).select("mention_id", "entity_id", F.round(F.exp(s), 9).alias("exp_score"), r6(F.exp(F.max(s).over(w) - lse)).alias("norm_top"), r6(logs.posterior(s, w)).alias("softmax"), r6(lse).alias("lse"))


_VEC = "[" + ",".join(FEATURES) + ", 1.0/(rank+1), score]"
_LINE = f"array_to_string(list_transform(range(1,9), lambda i: i||':'||printf('%.6f', v[i])),' ')"


@query(f"WITH {_FEATURES}, {QREL}, vv AS (SELECT ft.*, {_VEC} AS v, (q.entity_id IS NOT NULL)::INT AS t FROM ft LEFT JOIN qrel q USING (mention_id, entity_id)) SELECT mention_id, entity_id, t||' qid:'||mention_id||' '||{_LINE}||' # '||title AS line FROM vv")
def svm_lines(spark, d):
    truth = views.qrels(spark, d).withColumn("t", F.lit(1))
    v = rank.assemble(name_feature_rows(spark, d), FEATURES).join(truth, ["mention_id", "entity_id"], "left")
    return v.select("mention_id", "entity_id", rank.svm_line(F.coalesce("t", F.lit(0)), F.col("mention_id"), F.col("vector"), F.col("title")).alias("line"))


@query(f"""WITH {_FEATURES}, n AS (SELECT DISTINCT feature FROM (UNPIVOT (SELECT mention_id, entity_id, {",".join(f"{f}::DOUBLE AS {f}" for f in FEATURES)} FROM ft) ON {",".join(FEATURES)} INTO NAME feature VALUE value) WHERE value<>0)
SELECT 'name.'||feature AS feature, (row_number() OVER (ORDER BY feature)-1)::BIGINT AS id FROM n""")
def domain_map(spark, d):
    """Dense ids of the features that some row has, in order of their names."""
    parts = F.array(*(F.struct(F.lit(f"name.{f}").alias("feature"), F.col(f).alias("value")) for f in FEATURES))
    names = name_feature_rows(spark, d).select(F.explode(parts).alias("p")).select("p.*").where("value <> 0").select("feature")
    return rank.domain_rows(names)


_F = "::FLOAT"
_TOY = f"round(0.1*(CASE WHEN v[1]{_F}<=0.5{_F} THEN -1.0 WHEN v[7]{_F}<=0.25{_F} THEN 0.5 ELSE 2.0 END)+0.1*(CASE WHEN v[8]{_F}<=(-9.0){_F} THEN -0.5 ELSE 1.5 END)+0.1*(CASE WHEN v[4]{_F}<=0.5{_F} THEN 0.0 WHEN v[2]{_F}<=0.1{_F} THEN 0.25 ELSE 1.0 END),6)::DOUBLE"


@query(f"WITH {_FEATURES}, vv AS (SELECT *, {_VEC} AS v FROM ft) SELECT mention_id, entity_id, {_TOY} AS model_score FROM vv")
def ltr_score(spark, d):
    return rank.assemble(name_feature_rows(spark, d), FEATURES).select("mention_id", "entity_id", r6(TOY.column()).alias("model_score"))


@query(f"WITH {_FEATURES}, vv AS (SELECT *, {_VEC} AS v FROM ft), sc AS (SELECT mention_id, entity_id, rank AS old_rank, {_TOY} AS model_score FROM vv) SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY model_score DESC, old_rank) AS rank FROM sc")
def rerank(spark, d):
    v = rank.assemble(name_feature_rows(spark, d), FEATURES)
    return rank.rerank(v, TOY.expression()).select("mention_id", "entity_id", "old_rank", "model_score", "rank")


#: Presets of weights of score components, by the queries that the components come from.
PRESETS = {
    "query_only": {"raw": 1.0},
    "query_nv": {"raw": 0.42, "nv": 0.58},
    "query_prf": {"raw": 0.489, "nv": 0.511},
    "query_local": {"raw": 0.4, "all_local_ner": 0.6},
    "query_nv_prf": {"raw": 0.370, "nv": 0.336, "all_prfweight_ner": 0.294},
    "query_nv_local": {"raw": 0.308, "nv": 0.380, "all_local_ner": 0.3126},
    "query_nv_sent": {"raw": 0.332, "nv": 0.396, "sent": 0.273},
    "query_nv_uniform": {"raw": 0.310, "nv": 0.382, "all_uniform_ner": 0.308},
    "query_nv_uniform_sent": {"raw": 0.3366, "nv": 0.405, "all_uniform_ner": 0.2260, "sent": -0.0325},
    "query_nv_local_sent": {"raw": 0.30, "nv": 0.37, "all_local_ner": 0.264, "sent": -0.0655},
    "query_nv_prf_sent": {"raw": 0.321, "nv": 0.293, "all_prfweight_ner": 0.230, "sent": 0.155},
    "all": {"raw": 0.293, "nv": 0.22736, "all_prfweight_ner": 0.144, "sent": 0.0732, "all_prfentites_ner": 0.0733, "all_local_ner": 0.0981, "all_uniform_ner": 0.0914},
}
#: Which of the run's scores stand for the components.
COMPONENTS = {"raw": "score", "nv": "char_dice", "all_local_ner": "word_dice", "all_uniform_ner": "exact", "sent": "first_letter", "all_prfweight_ner": "suffix", "all_prfentites_ner": "log_len"}
_WEIGHTS = ",".join(f"('{p}','{c}',{w})" for p, own in PRESETS.items() for c, w in own.items())


@query(f"""WITH {_FEATURES}, w(preset, source, weight) AS (VALUES {_WEIGHTS}), c AS (UNPIVOT (SELECT mention_id, entity_id, {",".join(f"{v}::DOUBLE AS {k}" for k, v in COMPONENTS.items())} FROM ft) ON {",".join(COMPONENTS)} INTO NAME source VALUE value)
SELECT preset, mention_id, entity_id, sum(value::DECIMAL(18,6)*weight::DECIMAL(9,5))::DOUBLE AS combined FROM c JOIN w USING (source) GROUP BY ALL""")
def linear_reweight(spark, d):
    """Score components under each preset; sums are of decimals, so the order of additions doesn't show."""
    weights = spark.createDataFrame([(p, c, w) for p, own in PRESETS.items() for c, w in own.items()], "preset string, feature string, weight double").withColumn("weight", F.col("weight").cast("decimal(9,5)"))
    parts = F.array(*(F.struct(F.lit(k).alias("feature"), F.col(v).cast("decimal(18,6)").alias("value")) for k, v in COMPONENTS.items()))
    rows = name_feature_rows(spark, d).select("mention_id", "entity_id", F.explode(parts).alias("p")).select("mention_id", "entity_id", "p.*")
    every = rows.join(weights, "feature")
    return every.groupBy("preset", "mention_id", "entity_id").agg(F.sum(F.col("value") * F.col("weight")).cast("double").alias("combined"))


@query(f"WITH {MENTION}, {QREL} SELECT mention_id, CASE WHEN mention_id%2=1 THEN 'train' ELSE 'test' END AS split, mention_id NOT IN (SELECT mention_id FROM qrel) AS is_nil FROM ment")
def odd_even_split(spark, d):
    m = rank.odd_even(views.mentions(spark, d).select("mention_id"))
    return m.join(views.qrels(spark, d).select("mention_id").distinct().withColumn("linked", F.lit(True)), "mention_id", "left").select("mention_id", "split", F.col("linked").isNull().alias("is_nil"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id)-1)//100)::BIGINT AS batch, ((row_number() OVER (ORDER BY doc_id)-1)%5)::BIGINT AS fold FROM documents")
def cv_folds(spark, d):
    ids = views.table(spark, d, "documents").select("doc_id")
    numbered = ranking.batch_ids(ids, "doc_id", 1).withColumnRenamed("batch", "n")
    return numbered.select("doc_id", F.floor(F.col("n") / 100).alias("batch"), (F.col("n") % 5).alias("fold"))


@query(f"WITH {RUN} SELECT mention_id||' Q0 '||entity_id||' '||rank||' '||printf('%.8f',score)||' larkspan' AS line FROM run")
def trec_run_lines(spark, d):
    return run(spark, d).select(writers.run_lines(F.col("mention_id"), F.col("entity_id"), F.col("rank"), F.col("score"), "larkspan").alias("line"))


@query(f"WITH {RUN}, t AS (SELECT mention_id, entity_id, score, max(score) OVER () AS top FROM run WHERE rank=1) SELECT mention_id||chr(9)||'E'||entity_id||chr(9)||printf('%.6f',greatest((score+20)/(top+20),0.001)) AS value FROM t")
def prediction_lines(spark, d):
    best = run(spark, d).where("rank = 1").select("mention_id", F.concat(F.lit("E"), F.col("entity_id").cast("string")).alias("kb_id"), F.col("score"))
    return writers.prediction_lines(best, low=20.0)
