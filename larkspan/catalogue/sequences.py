"""Collection and distribution helpers over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import query, r6
from larkspan.catalogue.collections import _DIST, _dist, _events
from larkspan.operators import distributions, ranking


@query("SELECT (user_id%7)::BIGINT AS bucket, count(*) AS n, round(sum(value),4) AS total, max(value) AS top FROM events GROUP BY 1")
def seq_group_by_mapped_key(spark, d):
    e = _events(spark, d)
    return e.groupBy((F.col("user_id") % 7).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("top"))


@query("SELECT user_id, array_to_string(list_sort(list(event_type)),',') AS types FROM events GROUP BY 1")
def seq_group_by_key(spark, d):
    """Lists of a key: a user's events, bounded by the user's own."""
    return _events(spark, d).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list("event_type")), ",").alias("types"))


@query("SELECT event_id, try_cast(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events WHERE try_cast(regexp_extract(props,'([0-9]+)',1) AS BIGINT) IS NOT NULL")
def seq_filter_by_type(spark, d):
    """Rows whose property is a number."""
    from larkspan.plans import views

    e = views.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.select("event_id", k.alias("k")).where("k is not null")


@query("SELECT user_id, event_type AS entry, round(count(*)*0.5,4) AS half FROM events GROUP BY ALL")
def seq_map_values(spark, d):
    c = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.explode(F.transform_values("m", lambda k, v: v.cast("double") * 0.5)).alias("entry", "half"))


@query("SELECT event_type, round(sum(value),4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def seq_sum(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


@query("WITH a AS (SELECT user_id, event_type, list(event_id) AS ids FROM events GROUP BY ALL) SELECT user_id, array_to_string(list_sort(flatten(list(ids))),',') AS ids FROM a GROUP BY 1")
def seq_merge_maps(spark, d):
    a = _events(spark, d).groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("ids"))
    return ranking.merge_lists(a, "user_id", "ids").select("user_id", F.array_join("ids", ",").alias("ids"))


@query("WITH a AS (SELECT user_id, list_sort(list(event_id)) AS ids FROM events GROUP BY 1) SELECT user_id, ids[least(4, len(ids))] AS event_id FROM a")
def seq_last_or_max(spark, d):
    a = _events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return a.select("user_id", ranking.last_or_max(F.col("ids"), 3).alias("event_id"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY ALL")
def keep_last(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "event_id", F.struct("user_id", "event_type").alias("k"))
    return ranking.keep_first(e, "k", [F.desc("event_id")]).drop("k")


_EVERY = "u AS (SELECT DISTINCT event_type FROM events UNION SELECT 'none'), k AS (SELECT user_id, event_type, coalesce(p.p,0.0) AS p FROM (SELECT DISTINCT user_id FROM p) g CROSS JOIN u LEFT JOIN p USING (user_id, event_type))"


def _universe(spark, d):
    return _events(spark, d).select("event_type").distinct().union(spark.range(1).select(F.lit("none")))


@query(f"WITH {_DIST}, {_EVERY} SELECT user_id, event_type, round(p,6) AS p, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p,9) DESC, event_type) AS rank FROM k) WHERE rank<=4")
def dist_topk(spark, d):
    p = _dist(spark, d)
    return distributions.top_k_filled(p, _universe(spark, d), p, "user_id", "event_type", 4).select("user_id", "event_type", r6("p").alias("p"), "rank")


@query(f"WITH {_DIST}, {_EVERY} SELECT user_id, event_type, round(CASE WHEN p=0 THEN 0.001 ELSE p END,6) AS p FROM k")
def dist_universe(spark, d):
    p = _dist(spark, d)
    return distributions.with_universe(p, _universe(spark, d), p, "user_id", "event_type", 0.001).select("user_id", "event_type", r6("p").alias("p"))


@query(f"WITH {_DIST} SELECT user_id, event_type, round(ln(p),6) AS log_p FROM p")
def dist_log(spark, d):
    return _dist(spark, d).select("user_id", "event_type", r6(distributions.logarithm(F.col("p"))).alias("log_p"))
