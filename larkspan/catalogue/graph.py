"""Links, names and neighbours of entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import KB, LINKS, RUN, norm, query, r6
from larkspan.catalogue.retrieval import run
from larkspan.functions import text
from larkspan.operators import links
from larkspan.operators.index import positions
from larkspan.plans import views


def _fields(spark, d):
    """Anchors of link targets and titles of pages, as (entity, field, value)."""
    a = views.links(spark, d).select(F.col("dest").alias("entity"), F.lit("anchor").alias("field"), F.col("anchor").alias("value"))
    t = views.table(spark, d, "pages").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("entity"), F.lit("title").alias("field"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("value"))
    return a.unionByName(t)


_FIELDS = f"{LINKS}, fl AS (SELECT dest AS entity, 'anchor' AS field, anchor AS value FROM lk UNION ALL SELECT 'page:'||page_id, 'title', regexp_extract(html,'<title>([^<]*)</title>',1) FROM pages), nc AS (SELECT entity, field, value, count(*) AS n FROM fl GROUP BY ALL), np AS (SELECT *, sum(n) OVER (PARTITION BY field, value) AS total FROM nc), pr AS (SELECT entity, field, value, n, total::BIGINT AS total, CASE WHEN total+0.5<=n THEN 1.0 ELSE n/(total+0.5) END AS p FROM np)"


@query(f"WITH {LINKS} SELECT page_id, pos::BIGINT AS pos, dest, anchor FROM lk")
def link_extract(spark, d):
    return views.links(spark, d).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {_FIELDS} SELECT entity, field, value, n, total, round(p,6) AS p FROM pr")
def anchor_prob(spark, d):
    return links.name_probability(links.name_counts(_fields(spark, d))).select("entity", "field", "value", "n", "total", r6("p").alias("p"))


@query(f"WITH {_FIELDS}, s AS (SELECT entity, {norm('value')} AS value, round(sum(p*CASE field WHEN 'title' THEN 1.0 ELSE 0.5 END),6) AS weight FROM pr WHERE {norm('value')}<>'' GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, value) AS rank FROM s) WHERE rank<=10")
def weighted_names(spark, d):
    return links.weighted_names(links.name_counts(_fields(spark, d)), {"title": 1.0, "anchor": 0.5})


_NAMED = f"""{LINKS}, src0 AS (SELECT page_id, min_by(dest, pos) AS entity FROM lk GROUP BY 1), nm AS (SELECT dest AS entity, anchor AS value FROM lk UNION ALL SELECT s.entity, regexp_extract(p.html,'<title>([^<]*)</title>',1) FROM src0 s JOIN pages p USING (page_id))"""


def _names(spark, d):
    """(entity, value): anchors of links to an entity, and titles of the pages that stand for it."""
    anchors = views.links(spark, d).select(F.col("dest").alias("entity"), F.col("anchor").alias("value"))
    first = views.links(spark, d).groupBy("page_id").agg(F.min_by("dest", "pos").alias("entity"))
    titles = views.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("value"))
    return anchors.unionByName(first.join(titles, "page_id").select("entity", "value"))


@query(f"WITH {_NAMED} SELECT DISTINCT entity, {norm('value')} AS value FROM nm WHERE {norm('value')}<>'' AND NOT contains({norm('entity')}, {norm('value')})")
def alternative_names(spark, d):
    names = _names(spark, d)
    return links.alternative_names(names, names.select("entity").distinct().select("entity", text.normalize("entity").alias("title")))


_WORDLINKS = f"{LINKS}, src AS (SELECT page_id, min_by(dest, pos) AS entity FROM lk GROUP BY 1), wl AS (SELECT s.entity, l.dest, l.pos FROM lk l JOIN src s USING (page_id))"


def _word_links(spark, d):
    """Links between words: each page stands for its first target."""
    every = views.links(spark, d)
    first = every.groupBy("page_id").agg(F.min_by("dest", "pos").alias("entity"))
    return every.join(first, "page_id").select("entity", "dest", "pos")


@query(f"""WITH {_WORDLINKS}, o AS (SELECT entity, dest, max(CASE WHEN pos<3 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END) AS place, count(*)::DOUBLE AS anchors FROM wl WHERE dest<>entity GROUP BY ALL), deg AS (SELECT p.entity, p.dest, count(*)::DOUBLE AS shared FROM o p JOIN o a ON a.dest=p.entity JOIN o b ON b.entity=a.entity AND b.dest=p.dest GROUP BY ALL),
f AS (SELECT o.*, CASE WHEN b.entity IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS back, coalesce(shared,0.0::DOUBLE) AS shared FROM o LEFT JOIN o b ON b.entity=o.dest AND b.dest=o.entity LEFT JOIN deg ON deg.entity=o.entity AND deg.dest=o.dest),
t AS (SELECT *, sum(place) OVER w AS tp, sum(anchors) OVER w AS ta, sum(back) OVER w AS tb, sum(shared) OVER w AS ts FROM f WINDOW w AS (PARTITION BY entity)),
s AS (SELECT entity, dest, round(0.25*(CASE WHEN tp=0 THEN 0 ELSE place/tp END)+0.25*(CASE WHEN ta=0 THEN 0 ELSE anchors/ta END)+0.25*(CASE WHEN tb=0 THEN 0 ELSE back/tb END)+0.25*(CASE WHEN ts=0 THEN 0 ELSE shared/ts END),6) AS score FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, dest) AS rank FROM s) WHERE rank<=10""")
def neighbor_score(spark, d):
    return links.neighbors(_word_links(spark, d), near=3)


@query(f"WITH {LINKS} SELECT dest, count(*) AS inlinks, round(ln(greatest(1,count(*))),6) AS log_inlinks FROM lk GROUP BY 1")
def link_popularity(spark, d):
    return links.popularity(views.links(spark, d)).withColumn("log_inlinks", r6("log_inlinks"))


@query(f"WITH {LINKS}, n AS (SELECT dest, anchor, count(*) AS n FROM lk GROUP BY ALL), t AS (SELECT anchor, sum(n)::BIGINT AS total FROM n GROUP BY 1), i AS (SELECT dest, count(*) AS inl FROM lk GROUP BY 1) SELECT dest, anchor, n, total, round(CASE WHEN total+0.5<n THEN n/greatest(1,inl) ELSE n/(total+0.5) END,6) AS link_prob FROM n JOIN t USING (anchor) JOIN i USING (dest)")
def link_probability(spark, d):
    return links.link_probability(views.links(spark, d)).withColumn("link_prob", r6("link_prob"))


@query(f"""WITH {RUN}, kf AS (SELECT entity_id, 'title' AS field, title AS value FROM kb UNION ALL SELECT entity_id, 'head', terms[1] FROM kb UNION ALL SELECT entity_id, 'second', terms[2] FROM kb),
mv AS (SELECT mention_id, name AS value FROM ment UNION SELECT mention_id, terms[1] FROM ment), h AS (SELECT r.mention_id, r.entity_id, count(*) AS n, count(DISTINCT field) AS nf FROM run r JOIN mv USING (mention_id) JOIN kf ON kf.entity_id=r.entity_id AND kf.value=mv.value GROUP BY ALL)
SELECT mention_id, entity_id, coalesce(n,0) AS n_match, coalesce(nf,0) AS n_fields, round(CASE WHEN coalesce(n,0)=0 THEN 0 ELSE 1+ln(n) END,6) AS log_match FROM run LEFT JOIN h USING (mention_id, entity_id)""")
def exact_field_match(spark, d):
    kb, m, r = views.kb(spark, d), views.mentions(spark, d), run(spark, d).select("mention_id", "entity_id")
    field = lambda name, c: F.struct(F.lit(name).alias("field"), c.alias("value"))
    word = lambda i: F.try_element_at("terms", F.lit(i))
    fields = kb.join(r.select("entity_id").distinct(), "entity_id", "left_semi").select("entity_id", F.explode(F.array(field("title", F.col("title")), field("head", word(1)), field("second", word(2)))).alias("f")).select("entity_id", "f.*")
    names = m.select("mention_id", F.explode(F.array_distinct(F.array(F.col("name"), word(1)))).alias("value"))
    hits = r.join(names, "mention_id").join(fields, ["entity_id", "value"]).groupBy("mention_id", "entity_id").agg(F.count("*").alias("n_match"), F.count_distinct("field").alias("n_fields"))
    return r.join(hits, ["mention_id", "entity_id"], "left").fillna(0, ["n_match", "n_fields"]).withColumn("log_match", r6(text.log_tf(F.col("n_match"))))


@query(f"WITH {KB}, t AS (SELECT entity_id, unnest(range(0,len(terms))) AS pos, unnest(terms) AS term FROM kb) SELECT entity_id, count(*) AS n, string_agg(term,' ' ORDER BY pos) AS masked, max(pos)::BIGINT AS last_pos, (count(*)-1)::BIGINT AS last_new FROM t WHERE (pos>=10 AND pos<20) OR (pos>=15 AND pos<30) GROUP BY 1")
def passage_mask(spark, d):
    kb = views.kb(spark, d)
    windows = kb.select("entity_id", F.explode(F.array(F.struct(F.lit(10).alias("begin"), F.lit(20).alias("end")), F.struct(F.lit(15).alias("begin"), F.lit(30).alias("end")))).alias("w")).select("entity_id", "w.*")
    m = links.mask(positions(kb), windows, "entity_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]), " ")
    return m.groupBy("entity_id").agg(F.count("*").alias("n"), joined.alias("masked"), F.max("pos").cast("long").alias("last_pos"), F.max("new_pos").alias("last_new"))
