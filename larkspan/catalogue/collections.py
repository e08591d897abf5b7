"""Collections, intervals, distributions, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import query, r6, stops
from larkspan.functions import logs
from larkspan.operators import context, distributions, ranking
from larkspan.plans import views


def _events(spark, d):
    return views.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("begin"))


@query("""WITH s AS (SELECT user_id, floor(epoch(ts))::BIGINT AS begin_at, floor(epoch(ts))::BIGINT+floor(value*60)::BIGINT AS end_at FROM events), m AS (SELECT *, max(end_at) OVER (PARTITION BY user_id ORDER BY begin_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s),
r AS (SELECT *, sum(CASE WHEN begin_at<=b THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY begin_at, end_at ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(begin_at) AS begin_at, max(end_at) AS end_at FROM r GROUP BY user_id, g""")
def interval_merge(spark, d):
    e = _events(spark, d).select("user_id", F.col("begin").alias("begin_at"), (F.col("begin") + F.floor(F.col("value") * 60)).alias("end_at"))
    return ranking.merge_intervals(e, "user_id", "begin_at", "end_at")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def keep_first(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "event_id", F.struct("user_id", "event_type").alias("k"))
    return ranking.keep_first(e, "k", [F.asc("event_id")]).drop("k")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def group_last(spark, d):
    return ranking.last_of(_events(spark, d), "user_id", "event_type", F.col("event_id"))


@query("SELECT * FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank<=3")
def topk_group(spark, d):
    return ranking.top_k(_events(spark, d).select("user_id", "event_id", "value"), "user_id", [F.desc("value"), F.asc("event_id")], 3)


@query("SELECT user_id, event_type AS entry, round(sum(value),4) AS total FROM events GROUP BY ALL")
def sum_maps(spark, d):
    e = _events(spark, d).select("user_id", F.create_map("event_type", "value").alias("m"))
    return ranking.sum_maps(e, "user_id", "m").withColumn("total", F.round("total", 4))


@query("WITH a AS (SELECT user_id, count(*) AS clicks FROM events WHERE event_type='click' GROUP BY 1), b AS (SELECT user_id, count(*) AS views FROM events WHERE event_type='view' GROUP BY 1) SELECT * FROM a JOIN b USING (user_id)")
def align_inner(spark, d):
    e = _events(spark, d)
    count = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias(name))
    return count("click", "clicks").join(count("view", "views"), "user_id")


_DIST = "c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL), p AS (SELECT user_id, event_type, n/sum(n) OVER (PARTITION BY user_id) AS p FROM c)"


def _dist(spark, d):
    c = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("p"))
    return distributions.normalise(c, "user_id")


@query(f"WITH {_DIST}, w AS (SELECT c_custkey AS user_id, greatest(c_acctbal,0) AS w FROM customer WHERE c_custkey IN (SELECT user_id FROM p)) SELECT event_type, round(sum(p*w/(SELECT sum(w) FROM w)),6) AS p FROM p JOIN w USING (user_id) GROUP BY 1")
def dist_mix(spark, d):
    p = _dist(spark, d)
    w = views.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("weight")).join(p, "user_id", "left_semi")
    return distributions.mix(p, w, "user_id", "event_type").withColumn("p", r6("p"))


@query(f"WITH {_DIST}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p,9) DESC, event_type) AS k FROM p) SELECT user_id, max(CASE WHEN k=1 THEN event_type END) AS best, round(avg(p),6) AS mean, round(sum(p),6) AS marginal, count(*) AS size FROM r GROUP BY 1")
def dist_argmax(spark, d):
    p = _dist(spark, d)
    best = ranking.top_k(p, "user_id", [F.desc(F.round("p", 9)), F.asc("event_type")], 1).select("user_id", F.col("event_type").alias("best"))
    rest = distributions.argmax(p, "user_id", "event_type").select("user_id", r6("mean").alias("mean"), r6("marginal").alias("marginal"), "size")
    return best.join(rest, "user_id")


@query(f"WITH {_DIST}, s AS (SELECT *, round(sum(p) OVER (PARTITION BY user_id ORDER BY event_type ROWS UNBOUNDED PRECEDING),9) AS c FROM p) SELECT user_id, coalesce(min(CASE WHEN c>(user_id%10)/10.0+0.05 THEN event_type END), max(event_type)) AS event_type FROM s GROUP BY 1")
def dist_cumulative_draw(spark, d):
    return distributions.draw(_dist(spark, d), "user_id", "event_type", (F.col("user_id") % 10) / 10.0 + 0.05)


@query(f"WITH {_DIST} SELECT user_id, event_type, (floor(p*20)+CASE WHEN (user_id%7)/7.0 < p*20-floor(p*20) THEN 1 ELSE 0 END)::BIGINT AS expected FROM (SELECT user_id, event_type, round(p,9) AS p FROM p)")
def expected_counts(spark, d):
    p = _dist(spark, d).withColumn("p", F.round("p", 9) * 20)
    return distributions.expected_counts(p, "p", (F.col("user_id") % 7) / 7.0).select("user_id", "event_type", "expected")


@query("WITH m AS (SELECT user_id, ln(max(value)+1) AS a, ln(min(value)+1) AS b FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN a<>b THEN a+ln(1-exp(b-a)) END,6) AS diff FROM m")
def logdiffexp(spark, d):
    m = _events(spark, d).groupBy("user_id").agg(F.log(F.max("value") + 1).alias("a"), F.log(F.min("value") + 1).alias("b"))
    return m.select("user_id", r6(logs.log_diff_exp(F.col("a"), F.col("b"))).alias("diff"))


_TOK = """tk AS (SELECT conv_id, turn, pos, word, CASE WHEN regexp_matches(word,'^[A-Z]') THEN 'CAP' ELSE 'O' END AS label FROM (SELECT conv_id, turn, unnest(range(1,len(w)+1)) AS pos, unnest(w) AS word FROM (SELECT conv_id, turn, string_split(text,' ') AS w FROM conversations)))"""


@query(f"""WITH {_TOK}, l AS (SELECT *, lag(label) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS prev FROM tk), i AS (SELECT *, sum(CASE WHEN label IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT conv_id, turn, label, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, string_agg(word,' ' ORDER BY pos) AS words FROM i WHERE label<>'O' GROUP BY conv_id, turn, g, label""")
def ner_islands(spark, d):
    t = views.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    t = t.withColumns({"pos": (F.col("pos") + 1).cast("long"), "label": F.when(F.col("word").rlike("^[A-Z]"), "CAP").otherwise("O")})
    return context.label_runs(t, ["conv_id", "turn"])


@query("""WITH w AS (SELECT doc_id, unnest(range(1,len(x)+1)) AS i, unnest(x) AS word FROM (SELECT doc_id, string_split(text,' ') AS x FROM documents)), o AS (SELECT doc_id, word, sum(length(word)+1) OVER (PARTITION BY doc_id ORDER BY i)-length(word)-1 AS b FROM w),
t AS (SELECT doc_id, word, b, max(CASE WHEN word='the' THEN b END) OVER (PARTITION BY doc_id ORDER BY b) AS lo, min(CASE WHEN word='the' THEN b END) OVER (PARTITION BY doc_id ORDER BY b DESC) AS hi FROM o),
g AS (SELECT doc_id, lower(word) AS name, min(least(b-lo, hi-b))::BIGINT AS distance FROM t WHERE regexp_matches(word,'^[A-Z][a-z]+$') AND (lo IS NOT NULL OR hi IS NOT NULL) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, name) AS rank FROM g) WHERE rank<=5""")
def offset_neighbors(spark, d):
    """The five capitalised words nearest to an occurrence of a word, by characters."""
    words = context.word_offsets(views.table(spark, d, "documents"), "doc_id", "text")
    hits = words.where(F.col("word").rlike("^[A-Z][a-z]+$")).select("doc_id", F.col("word").alias("name"), "begin")
    return context.nearest_neighbors(hits, words.where("word = 'the'").select("doc_id", "begin"), "doc_id", 5)


@query("""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text,'.'), lambda x: trim(x)), lambda x: x<>''), lambda x: x||'.') AS s FROM documents), e AS (SELECT doc_id, unnest(range(1,len(s)+1))::BIGINT AS sentence, unnest(s) AS t FROM s)
SELECT doc_id, count(*) AS n, min(sentence) AS first FROM e WHERE contains(t,' the ') AND regexp_matches(t,'[A-Z]') GROUP BY 1""")
def sentence_filter(spark, d):
    """Sentences that hold a name."""
    s = context.sentences(views.table(spark, d, "documents"), "doc_id", "text")
    return s.where(F.contains("text", F.lit(" the ")) & F.col("text").rlike("[A-Z]")).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("sentence").cast("long").alias("first"))


@query(rf"""WITH c AS (SELECT conv_id||':'||turn AS id, string_split(text,'.') AS p FROM conversations), s AS (SELECT id, sentence, piece, sum(length(piece)+1) OVER (PARTITION BY id ORDER BY sentence)-length(piece)-1 AS base FROM (SELECT id, unnest(range(0,len(p))) AS sentence, unnest(p) AS piece FROM c)),
w AS (SELECT id, sentence, unnest(range(1,len(t)+1)) AS i, unnest(t) AS token FROM (SELECT id, sentence, regexp_split_to_array(piece,'[^\p{{L}}\p{{Nd}}]') AS t FROM s)), o AS (SELECT *, sum(length(token)+1) OVER (PARTITION BY id, sentence ORDER BY i)-length(token)-1 AS b FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY id, sentence ORDER BY b) AS pos, lower(token) IN {stops()} AS common, regexp_matches(token,'^\p{{Lu}}') AND lower(token) NOT IN {stops()} AS proper FROM o WHERE length(token)>=2),
r AS (SELECT *, pos-row_number() OVER (PARTITION BY id, sentence ORDER BY pos) AS run FROM t WHERE proper OR common), e AS (SELECT id, sentence, run, min(CASE WHEN proper THEN b END) AS x, max(CASE WHEN proper THEN b+length(token) END) AS y, max(CASE WHEN proper THEN pos END)-min(CASE WHEN proper THEN pos END)+1 AS n FROM r GROUP BY ALL)
SELECT id, substr(piece, x::INT+1, (y-x)::INT) AS name, (base+x)::BIGINT AS "begin", (base+y)::BIGINT AS "end" FROM e JOIN s USING (id, sentence) WHERE n<=6""")
def fallback_ner(spark, d):
    c = views.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return context.fallback_names(c, "id", "text")


@query()
def name_variants(spark, d):
    """Variants of each conversation's first name among the other names of the conversation."""
    c = views.table(spark, d, "conversations")
    found = context.fallback_names(c.select("conv_id", "text"), "conv_id", "text")
    g = found.groupBy("conv_id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("name")).alias("others"))
    return g.select("conv_id", "name", F.array_join(context.name_variants("name", "others"), "|").alias("variants"))


@query("SELECT item_id, round(1.0/count(*) OVER (PARTITION BY left(text,1)),6) AS weight FROM benchmark")
def uniform_weights(spark, d):
    b = views.table(spark, d, "benchmark").select("item_id", F.left("text", F.lit(1)).alias("g"))
    return b.select("item_id", r6(context.uniform(b, "g")).alias("weight"))
