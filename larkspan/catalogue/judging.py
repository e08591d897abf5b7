"""NIL decisions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import KB, MENTION, QREL, RUN, query, r6
from larkspan.catalogue.retrieval import run
from larkspan.operators import evaluate, nil
from larkspan.operators.ranking import keep_first
from larkspan.plans import views

_SW = "[" + ",".join(map(str, nil.SWEEP)) + "]"
_TOP = "top1 AS (SELECT r.mention_id, r.entity_id, r.score, k.title FROM run r JOIN kb k USING (entity_id) WHERE rank=1)"


def top_predictions(spark, d):
    """(mention_id, entity_id, score, title): the best entry of each mention."""
    return run(spark, d).where("rank = 1").join(views.kb(spark, d).select("entity_id", "title"), "entity_id").select("mention_id", "entity_id", "score", "title")


def gold(spark, d):
    """(mention_id, entries): the true entries of each mention, none for a NIL one."""
    true = views.qrels(spark, d).groupBy("mention_id").agg(F.collect_list("entity_id").alias("entries"))
    return views.mentions(spark, d).select("mention_id").join(true, "mention_id", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<bigint>")))


@query(f"""WITH {RUN}, {_TOP}, {QREL}, s AS (SELECT *, unnest({_SW})::DOUBLE AS threshold FROM top1), p AS (SELECT mention_id, threshold, CASE WHEN score<threshold THEN NULL ELSE entity_id END AS entity_id FROM s)
SELECT threshold, count(*) AS n, count(p.entity_id) AS linked, sum(CASE WHEN q.entity_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS correct FROM p LEFT JOIN qrel q ON q.mention_id=p.mention_id AND q.entity_id=p.entity_id GROUP BY 1""")
def nil_threshold_sweep(spark, d):
    p = nil.sweep(top_predictions(spark, d))
    true = views.qrels(spark, d).withColumn("hit", F.lit(1))
    return p.join(true, ["mention_id", "entity_id"], "left").groupBy("threshold").agg(F.count("*").alias("n"), F.count("entity_id").alias("linked"), F.sum(F.coalesce("hit", F.lit(0))).alias("correct"))


@query(f"""WITH {RUN}, {_TOP}, k AS (SELECT mention_id, CASE WHEN score>=-11 THEN '##'||title ELSE '--'||mention_id END AS cluster FROM top1), f AS (SELECT cluster, min(mention_id) AS first FROM k GROUP BY 1), n AS (SELECT cluster, row_number() OVER (ORDER BY first, cluster) AS i FROM f)
SELECT mention_id, cluster, 'NIL'||lpad(i::VARCHAR,4,'0') AS nil_id FROM k JOIN n USING (cluster)""")
def nil_clusters(spark, d):
    p = top_predictions(spark, d).select("mention_id", F.when(F.col("score") >= -11, F.concat(F.lit("##"), "title")).otherwise(F.concat(F.lit("--"), F.col("mention_id").cast("string"))).alias("cluster"))
    return nil.cluster_ids(p, "cluster", "mention_id").select("mention_id", "cluster", "nil_id")


@query()
def nil_classifier(spark, d):
    """Predicted quality of labelled documents from lengths; no SQL, as the weights are fitted."""
    docs = views.table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"), (F.length(F.regexp_replace("text", r"[\p{L}\s]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("marks"))
    labelled = views.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).join(docs, "doc_id")
    predict = nil.classifier(labelled, ["chars", "words", "marks"], "label")
    return predict(labelled).select("doc_id", "label", "prediction")


@query(f"""WITH {RUN}, {_TOP}, {QREL}, g AS (SELECT m.mention_id, (SELECT count(*) FROM qrel q WHERE q.mention_id=m.mention_id) AS n_true FROM ment m), p AS (SELECT mention_id, CASE WHEN score>=-11 THEN entity_id END AS entity_id FROM top1),
j AS (SELECT g.mention_id, n_true, p.mention_id IS NOT NULL AS given, p.entity_id, EXISTS (SELECT 1 FROM qrel q WHERE q.mention_id=g.mention_id AND q.entity_id=p.entity_id) AS hit FROM g LEFT JOIN p USING (mention_id)),
c AS (SELECT *, CASE WHEN n_true=0 THEN (given AND entity_id IS NULL)::INT ELSE hit::INT END AS ok, ((n_true=0)=(entity_id IS NULL))::INT AS dec FROM j)
SELECT count(*) AS n, round(avg(ok),6) AS acc_all, round(avg(CASE WHEN n_true>0 THEN ok END),6) AS acc_linked, round(avg(CASE WHEN n_true=0 THEN ok END),6) AS acc_nil, round(avg(dec),6) AS acc_decision FROM c""")
def micro_accuracy(spark, d):
    p = nil.threshold(top_predictions(spark, d), -11.0)
    a = evaluate.linking_accuracy(gold(spark, d), p)
    return a.select("n", *(r6(c).alias(c) for c in a.columns[1:]))


_AP = f"""{RUN}, {QREL}, h AS (SELECT r.*, (q.entity_id IS NOT NULL)::INT AS hit FROM run r LEFT JOIN qrel q USING (mention_id, entity_id)), c AS (SELECT *, sum(hit) OVER (PARTITION BY mention_id ORDER BY rank)/rank AS pr FROM h),
pt AS (SELECT mention_id, sum(pr*hit) AS s, max(CASE WHEN rank=1 THEN hit END) AS f FROM c GROUP BY 1), tt AS (SELECT mention_id, count(*) AS relevant FROM qrel GROUP BY 1),
ap AS (SELECT mention_id, coalesce(s,0)/relevant AS ap, coalesce(f,0)::DOUBLE AS p1 FROM tt LEFT JOIN pt USING (mention_id))"""


@query(f"WITH {_AP} SELECT mention_id, round(ap,6) AS ap, p1 FROM ap UNION ALL SELECT -1, round(avg(ap),6), round(avg(p1),6) FROM ap")
def map_p1(spark, d):
    """Average precision and precision at 1 of each mention, and over all (mention_id -1)."""
    ap = evaluate.average_precision(run(spark, d), views.qrels(spark, d))
    both = ap.unionByName(ap.agg(F.lit(-1).cast("long").alias("mention_id"), F.avg("ap").alias("ap"), F.avg("p1").alias("p1")))
    return both.select("mention_id", r6("ap").alias("ap"), r6("p1").alias("p1"))


_RANKS = f"{RUN}, {QREL}, b AS (SELECT mention_id, min(rank) AS r FROM run JOIN qrel USING (mention_id, entity_id) GROUP BY 1), rk AS (SELECT mention_id, coalesce(r,-1)::BIGINT AS rank1, coalesce(r-1,-1)::BIGINT AS idx0 FROM ment LEFT JOIN b USING (mention_id))"


@query(f"WITH {_RANKS} SELECT idx0, count(*) AS n, round(count(*)/(SELECT count(*) FROM rk),6) AS share FROM rk GROUP BY 1")
def rank_distribution(spark, d):
    r = evaluate.answer_ranks(views.mentions(spark, d), run(spark, d), views.qrels(spark, d))
    return evaluate.distribution(r, "idx0").withColumn("share", r6("share"))


@query(f"WITH {_RANKS}, t AS (SELECT DISTINCT mention_id FROM qrel), k AS (SELECT unnest([1,3,5,10])::BIGINT AS k) SELECT k, count(*) AS n, round(avg((rank1 BETWEEN 1 AND k)::INT),6) AS recall FROM rk SEMI JOIN t USING (mention_id), k GROUP BY 1")
def candidate_recall(spark, d):
    q = views.qrels(spark, d)
    r = evaluate.answer_ranks(q.select("mention_id").distinct(), run(spark, d), q)
    each = r.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 3, 5, 10)))))
    return each.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg((F.col("rank1").between(1, F.col("k"))).cast("double"))).alias("recall"))


@query(f"WITH {KB} SELECT lang, count(*) AS n, round(count(*)/(SELECT count(*) FROM kb),6) AS share FROM kb GROUP BY 1")
def type_distribution(spark, d):
    return evaluate.distribution(views.table(spark, d, "documents").select("lang"), "lang").withColumn("share", r6("share"))


@query(f"""WITH {KB}, {MENTION}, t AS (SELECT entity_id, title FROM kb WHERE len(terms)>0), m AS (SELECT mention_id, name, terms[1]||' '||terms[2] AS head FROM ment WHERE len(terms)>1)
SELECT m.mention_id, t.entity_id, (m.name=t.title) AS exact FROM m JOIN t ON m.name=t.title OR contains(' '||t.title||' ', ' '||m.head||' ')""")
def mention_match(spark, d):
    """Entries whose title is the mention's name, or holds its first two words: by an equi-join on the titles' word pairs."""
    t = views.kb(spark, d).where(F.size("terms") > 0).select("entity_id", "title", F.slice("terms", 1, 3).alias("w"))
    pair = lambda i: F.array_join(F.slice("w", i, 2), " ")
    t = t.select("entity_id", "title", F.explode(F.array_distinct(F.when(F.size("w") > 2, F.array(pair(1), pair(2))).otherwise(F.array(pair(1))))).alias("head"))
    m = views.mentions(spark, d).where(F.size("terms") > 1).select("mention_id", "name", F.array_join(F.slice("terms", 1, 2), " ").alias("head"))
    met = m.join(t, "head").select("mention_id", "entity_id", (F.col("name") == F.col("title")).alias("exact"))
    return keep_first(met.withColumn("k", F.struct("mention_id", "entity_id")), "k", [F.desc("exact")]).drop("k")


@query(f"WITH {_AP}, o AS (SELECT mention_id, ap, p1 FROM ap) SELECT count(*) AS n, round(avg(ap-p1),6) AS mean_diff, round(CASE WHEN stddev_samp(ap-p1)>0 THEN avg(ap-p1)/(stddev_samp(ap-p1)/sqrt(count(*))) END,6) AS t FROM o")
def paired_significance(spark, d):
    t = evaluate.paired_t(evaluate.average_precision(run(spark, d), views.qrels(spark, d)), "ap", "p1")
    return t.select("n", r6("mean_diff").alias("mean_diff"), r6("t").alias("t"))
