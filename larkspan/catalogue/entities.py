"""Entities, contexts and second passes: names, types, chains, link sets, expanded queries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from larkspan.catalogue import KB, LINKS, MENTION, MU, NAME_QUERY, POST, QREL, RUN, dirichlet_sql, norm, query, r6, stops, top_sql
from larkspan.catalogue.collections import _TOK
from larkspan.catalogue.graph import _FIELDS, _WORDLINKS, _fields, _word_links
from larkspan.catalogue.judging import _AP, gold, top_predictions
from larkspan.catalogue.retrieval import _PARTS, run, score
from larkspan.catalogue.strings import _chars, _dice, _ws
from larkspan.functions import edits, sets, text
from larkspan.operators import context, evaluate, index, links, nil, rank, retrieve, similarity
from larkspan.operators.ranking import top_k
from larkspan.plans import views

# --- names in conversations --------------------------------------------------

_CAP = f"""{_TOK}, l AS (SELECT *, lag(label) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS prev FROM tk), i AS (SELECT *, sum(CASE WHEN label IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM l),
cap AS (SELECT conv_id, turn, min(pos) AS first, string_agg(word,' ' ORDER BY pos) AS name FROM i WHERE label<>'O' GROUP BY conv_id, turn, g),
tgt AS (SELECT conv_id, first(name ORDER BY turn, first) AS target FROM cap GROUP BY 1), nm AS (SELECT conv_id, {norm('name')} AS name FROM cap)"""


def _names(spark, d):
    """(conv_id, turn, first, name): runs of capitalised words."""
    t = views.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    t = t.withColumns({"pos": (F.col("pos") + 1).cast("long"), "label": F.when(F.col("word").rlike("^[A-Z]"), "CAP").otherwise("O")})
    return context.label_runs(t, ["conv_id", "turn"]).select("conv_id", "turn", "first", F.col("words").alias("name"))


def _targets(names):
    """(conv_id, target): the first name of a conversation."""
    return names.groupBy("conv_id").agg(F.min_by("name", F.struct("turn", "first")).alias("target"))


@query(f"WITH {_CAP}, c AS (SELECT conv_id, name, count(*) AS n FROM nm WHERE name<>'' GROUP BY ALL) SELECT conv_id, name, n, round(n/sum(n) OVER (PARTITION BY conv_id),6) AS weight, 1.0::DOUBLE AS one FROM c")
def local_weights(spark, d):
    return context.local_weights(_names(spark, d), "conv_id").withColumn("weight", r6("weight"))


@query(f"WITH {_CAP} SELECT DISTINCT n.conv_id, n.name FROM nm n JOIN (SELECT conv_id, {norm('target')} AS t, {norm('target')} AS a FROM tgt) t USING (conv_id) WHERE t<>'' AND n.name<>t AND (contains(' '||n.name||' ', ' '||t||' ') OR a = array_to_string(list_transform(list_filter(string_split(n.name,' '), lambda w: w<>'' AND w NOT IN {stops()}), lambda w: left(w,1)),''))")
def alternative_mentions(spark, d):
    """Other names of a conversation that hold its first name, or abbreviate to it."""
    n = _names(spark, d)
    return context.alternative_names(n, _targets(n), "conv_id")


@query(f"WITH {_CAP} SELECT c.conv_id, c.turn, c.first::BIGINT AS first, c.name FROM cap c JOIN tgt USING (conv_id) WHERE {norm('c.name')}={norm('target')}")
def same_name_mentions(spark, d):
    """The chain of a mention: places where a conversation's first name comes again, by an equi-join."""
    n = _names(spark, d)
    t = _targets(n).select("conv_id", text.normalize("target").alias("norm"))
    return n.withColumn("norm", text.normalize("name")).join(t, ["conv_id", "norm"]).select("conv_id", "turn", "first", "name")


@query(f"WITH {_CAP}, t AS (SELECT conv_id, {norm('name')} AS name, CASE WHEN contains(name,' ') THEN 'MULTI' ELSE 'SINGLE' END AS type FROM cap), c AS (SELECT conv_id, name, type, count(*) AS n FROM t WHERE name<>'' GROUP BY ALL) SELECT conv_id, name, sum(n)::BIGINT AS n, first(type ORDER BY n DESC, type DESC) AS type, sum(n)=1 AS singleton FROM c GROUP BY ALL")
def chains_with_types(spark, d):
    n = _names(spark, d).withColumn("type", F.when(F.contains("name", F.lit(" ")), "MULTI").otherwise("SINGLE"))
    return context.chains(n, "conv_id")


@query(f"""WITH {_CAP}, d AS (SELECT DISTINCT conv_id, name FROM cap), j AS (SELECT conv_id, d.name, {norm('d.name')} AS n, {norm("target||' '||'tail'")} AS t FROM d JOIN tgt USING (conv_id)),
k AS (SELECT *, len(list_intersect({_chars('n')},{_chars('n')})) AS dummy, len(list_intersect(list_distinct({_ws('n')}),list_distinct({_ws('t')}))) AS shared FROM j WHERE n<>'' AND t<>''),
f AS (SELECT *, CASE WHEN n=t THEN 1 WHEN contains(n,t) OR contains(t,n) THEN 2 WHEN shared>0 THEN 3 END AS level FROM k)
SELECT conv_id, level, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level, shared DESC, length(name) DESC, name) AS r FROM f WHERE level IS NOT NULL) WHERE r=1""")
def reverse_match(spark, d):
    """How each conversation speaks of a target: its first name with a word that it lacks."""
    n = _names(spark, d)
    t = _targets(n).withColumn("target", F.concat_ws(" ", "target", F.lit("tail")))
    return context.reverse_matches(n, t, "conv_id")


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(range(1,len(p)+1)) AS i, unnest(p) AS token FROM (SELECT conv_id, turn, regexp_split_to_array(text,'[^\p{L}\p{Nd}]') AS p FROM conversations))
SELECT conv_id, turn, token, begin_at FROM (SELECT *, (sum(length(token)+1) OVER (PARTITION BY conv_id, turn ORDER BY i)-length(token)-1)::BIGINT AS begin_at FROM w) WHERE length(token)>=2""")
def token_offsets(spark, d):
    return context.token_offsets(views.table(spark, d, "conversations"), ["conv_id", "turn"], "text").withColumnRenamed("begin", "begin_at")


_CAL = "(" + ",".join(f"'{w}'" for w in text.CALENDAR) + ")"


@query(f"WITH {_CAP} SELECT conv_id, count(*) AS n, count(DISTINCT name) AS n_names FROM cap WHERE lower(name) NOT IN {_CAL} AND NOT starts_with(lower(name),'http') AND length(name)>=2 GROUP BY 1")
def neighbor_filter(spark, d):
    n = _names(spark, d).where(text.neighbor_name(F.col("name")))
    return n.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


_PLACES = ",".join(f"('{k}','{v}')" for k, v in text.places().items())


@query(f"WITH p(abbr, place) AS (VALUES {_PLACES}) SELECT c_custkey, place FROM customer LEFT JOIN p ON abbr=lower(chr(65+(c_custkey%26)::INT)||chr(65+(c_custkey%23)::INT))")
def place_names(spark, d):
    code = F.concat(*(F.char((F.lit(65) + F.col("c_custkey") % m).cast("int")) for m in (26, 23)))
    return views.table(spark, d, "customer").select("c_custkey", text.place_name(F.concat_ws(".", F.substring(code, 1, 1), F.substring(code, 2, 1))).alias("place"))


_KNOWN = "known AS (SELECT n_name AS known, 'NATION' AS type FROM nation UNION ALL SELECT r_name, 'REGION' FROM region UNION ALL SELECT p_brand, 'BRAND' FROM part)"
_ASKED = """asked AS (SELECT DISTINCT CASE c_custkey%5 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN replace(n_name,' ','_') WHEN 3 THEN n_name||'!' ELSE c_mktsegment END AS name FROM customer JOIN nation ON n_nationkey=c_nationkey)"""


@query(f"""WITH {_KNOWN}, {_ASKED}, f AS (SELECT name, 1 AS level, name AS form FROM asked UNION ALL SELECT name, 2, lower(name) FROM asked UNION ALL SELECT name, 3, replace(lower(name),'_',' ') FROM asked UNION ALL SELECT name, 4, {norm('name')} FROM asked),
k AS (SELECT level, form, min(type) AS type FROM (SELECT 1 AS level, known AS form, type FROM known UNION ALL SELECT 2, lower(known), type FROM known UNION ALL SELECT 3, lower(known), type FROM known UNION ALL SELECT 4, {norm('known')}, type FROM known) GROUP BY ALL),
b AS (SELECT name, min(level) AS level, arg_min(type, level) AS type FROM f JOIN k USING (level, form) GROUP BY 1) SELECT name, coalesce(type,'UNK') AS type, coalesce(level,0)::INT AS level FROM asked LEFT JOIN b USING (name)""")
def name_types(spark, d):
    t = lambda name: views.table(spark, d, name)
    known = t("nation").select(F.col("n_name").alias("known"), F.lit("NATION").alias("type")).union(t("region").select("r_name", F.lit("REGION"))).union(t("part").select("p_brand", F.lit("BRAND")))
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    k, n = F.col("c_custkey") % 5, F.col("n_name")
    asked = c.select(F.when(k == 0, n).when(k == 1, F.lower(n)).when(k == 2, F.replace(n, F.lit(" "), F.lit("_"))).when(k == 3, F.concat(n, F.lit("!"))).otherwise(F.col("c_mktsegment")).alias("name"))
    return context.find_types(asked, known)


# --- documents, explanations, expanded queries -------------------------------


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d SEMI JOIN labels USING (doc_id)")
def fetch_documents(spark, d):
    """Documents of the ids in labels: their large column is dropped before and never read."""
    docs = retrieve.without_payload(views.table(spark, d, "documents"), "text")
    return retrieve.fetch(docs, views.table(spark, d, "labels")).select("doc_id", "lang", "n_chars")


@query(f"WITH {RUN} SELECT mention_id, entity_id, rank, title, len FROM run JOIN kb USING (entity_id) JOIN lens USING (entity_id)")
def run_documents(spark, d):
    return retrieve.with_documents(run(spark, d), views.kb(spark, d).select("entity_id", "title", "len")).select("mention_id", "entity_id", "rank", "title", "len")


@query(f"WITH {RUN} SELECT r.mention_id, r.entity_id, r.rank, k.term, coalesce(p.tf,0)::BIGINT AS tf, round(k.weight*ln((coalesce(p.tf,0)+{MU}*k.p)/(l.len+{MU})),6) AS part FROM run r JOIN scored_k k USING (mention_id) JOIN lens l USING (entity_id) LEFT JOIN post p ON p.entity_id=r.entity_id AND p.term=k.term")
def explain_scores(spark, d):
    ix, q = views.kb_index(spark, d), retrieve.query(views.mentions(spark, d), F.slice("terms", 1, 3))
    return retrieve.explain(q, run(spark, d), ix.of(q), ix.stats_of(q), ix.lengths(), ix.collection[0], MU).withColumn("part", r6("part"))


@query(f"""WITH {RUN}, es AS (SELECT mention_id, term, count(*)/any_value(n) AS weight FROM (SELECT mention_id, unnest(t) AS term, len(t) AS n FROM (SELECT mention_id, flatten(list(string_split(title,' ') ORDER BY rank)) AS t FROM run JOIN kb USING (entity_id) WHERE rank<=2 GROUP BY 1)) GROUP BY ALL),
mx AS (SELECT mention_id, term, sum(weight) AS weight FROM (SELECT mention_id, term, 0.6*weight AS weight FROM nq UNION ALL SELECT mention_id, term, 0.4*weight FROM es) GROUP BY ALL), {dirichlet_sql('mx', MU, 'mixed')}, {top_sql('best', 'mixed', 10)} SELECT mention_id, entity_id, score, rank FROM best""")
def entity_set_query(spark, d):
    """The name's query mixed with the names of the two best entries of a first pass: 0.6 and 0.4."""
    first = run(spark, d, 2).join(views.kb(spark, d).select("entity_id", "title"), "entity_id")
    held = first.groupBy("mention_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.split(x["title"], " "))).alias("t"))
    name = retrieve.query(views.mentions(spark, d), F.slice("terms", 1, 3))
    q = retrieve.combine([(0.6, name), (0.4, retrieve.query(held, F.col("t")))])
    return retrieve.best(score(spark, d, q), 10)


_MODES = {"Q": (1.0, 0.0, 0.0, 0.0), "QV": (0.5, 0.5, 0.0, 0.0), "QVS": (0.5, 0.25, 0.25, 0.0), "QVM": (0.4, 0.3, 0.0, 0.3), "QVSM": (0.4, 0.2, 0.2, 0.2)}
_NEAR = """mq0 AS (SELECT DISTINCT item_id AS mention_id, lower(unnest(list_filter(string_split(text,' '), lambda w: regexp_full_match(w,'[A-Z][a-z]+')))) AS term FROM benchmark), mq AS (SELECT mention_id, term, 1.0/count(*) OVER (PARTITION BY mention_id) AS weight FROM mq0 WHERE NOT EXISTS (SELECT 1 FROM nq WHERE nq.mention_id=mq0.mention_id AND nq.term=mq0.term))"""
_MODE_ROWS = ",".join(f"('{m}',{i},{w})" for m, own in _MODES.items() for i, w in enumerate(own) if w)
_REPR = f"""{KB}, {POST}, {MENTION}, {NAME_QUERY}, {_PARTS}, {_NEAR}, pt AS (SELECT part, mention_id, term, weight FROM parts UNION ALL SELECT 3, mention_id, term, weight FROM mq), md(mode, part, w) AS (VALUES {_MODE_ROWS}),
tm AS (SELECT mode, mention_id, sum(w) AS total FROM (SELECT DISTINCT mode, mention_id, part, md.w FROM pt JOIN md USING (part)) GROUP BY ALL), rq AS (SELECT mode, mention_id, term, sum(weight*md.w/total) AS weight FROM pt JOIN md USING (part) JOIN tm USING (mode, mention_id) GROUP BY ALL)"""


def representation(spark, d, mode: str):
    """The query of a mode: name (Q), variants (V), sentence words (S), neighbours (M), weighted and scaled over what a mention has."""
    m = views.mentions(spark, d)
    name = retrieve.query(m, F.slice("terms", 1, 3))
    variants = retrieve.query(m.where(F.length(F.try_element_at("terms", F.lit(1))) > 3), F.slice("terms", 1, 1))
    around = retrieve.query(m, F.filter(F.slice("terms", F.lit(4), F.size("terms")), lambda w: ~text.is_stop(w)))
    capital = m.select("mention_id", F.explode(F.array_distinct(F.transform(F.filter(F.split("full_text", " "), lambda w: w.rlike("^[A-Z][a-z]+$")), lambda w: F.lower(w)))).alias("term"))
    near = capital.join(name, ["mention_id", "term"], "left_anti")
    near = near.withColumn("weight", context.uniform(near, "mention_id"))
    return retrieve.combine(list(zip(_MODES[mode], (name, variants, around, near), strict=True)))


@query(f"WITH {_REPR} SELECT mode, mention_id, term, round(weight,6) AS weight FROM rq")
def representation_modes(spark, d):
    out = None
    for mode in _MODES:
        q = representation(spark, d, mode).select(F.lit(mode).alias("mode"), "mention_id", "term", r6("weight").alias("weight"))
        out = q if out is None else out.unionByName(q)
    return out


@query(f"WITH {_REPR}, fq AS (SELECT mention_id, term, weight FROM rq WHERE mode='QVSM'), {dirichlet_sql('fq')}, {top_sql('best', 'scored', 10)} SELECT mention_id, entity_id, score, rank FROM best")
def neighbor_entity_query(spark, d):
    """Retrieval by all four parts, neighbours included."""
    return retrieve.best(score(spark, d, representation(spark, d, "QVSM")), 10)


_STEM = r"regexp_replace({x},'^(.{{3,}}?)(?:ings?|ed|es|s)$','\1')"


@query(f"""WITH {RUN}, e AS (SELECT mention_id, entity_id, exp(score-max(score) OVER (PARTITION BY mention_id)) AS x, count(*) OVER (PARTITION BY mention_id) AS n FROM run), z AS (SELECT mention_id, sum(x) AS z FROM e GROUP BY 1),
rm AS (SELECT mention_id, term, round(sum(x/z*tf/len/n),6) AS weight FROM e JOIN z USING (mention_id) JOIN post USING (entity_id) JOIN lens USING (entity_id) WHERE term NOT IN {stops()} GROUP BY ALL),
f AS (SELECT rm.* FROM rm WHERE NOT EXISTS (SELECT 1 FROM nq WHERE nq.mention_id=rm.mention_id AND {_STEM.format(x='nq.term')}={_STEM.format(x='rm.term')})),
x5 AS (SELECT mention_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY weight DESC, term) AS r FROM f) WHERE r<=5),
tq AS (SELECT mention_id, term, sum(weight) AS weight FROM (SELECT mention_id, term, 0.5*weight AS weight FROM nq SEMI JOIN run USING (mention_id) UNION ALL SELECT mention_id, term, 0.5*weight/sum(weight) OVER (PARTITION BY mention_id) FROM x5) GROUP BY ALL),
{dirichlet_sql('tq', MU, 'second')}, w AS (SELECT s.* FROM second s SEMI JOIN run USING (mention_id, entity_id)), {top_sql('best', 'w', 10)} SELECT mention_id, entity_id, score, rank FROM best""")
def two_pass_feedback(spark, d):
    """Feedback in two passes: expansion words whose stem no query word has, then the first pass's entries scored by the expanded query."""
    ix, first = views.kb_index(spark, d), run(spark, d).select("mention_id", "entity_id", "score")
    post = ix.postings.join(first.select("entity_id").distinct(), "entity_id", "left_semi")
    terms = retrieve.feedback_terms(first, post.where(~text.is_stop(F.col("term"))), ix.lengths()).withColumn("weight", r6("weight"))
    q = retrieve.query(views.mentions(spark, d), F.slice("terms", 1, 3))
    stems = q.select("mention_id", text.stem(F.col("term")).alias("stem")).distinct()
    fresh = terms.withColumn("stem", text.stem(F.col("term"))).join(stems, ["mention_id", "stem"], "left_anti")
    best = top_k(fresh, "mention_id", [F.desc("weight"), F.asc("term")], 5)
    second = retrieve.two_pass(first, q, best, 0.5)
    # only entries of the first pass are scored
    second = ix.small(second)
    known = ix.small(retrieve.known(second, ix.stats_of(second), ix.collection[0]))
    own = ix.lists.join(ix.small(first.select("entity_id").distinct()), "entity_id", "left_semi")
    return retrieve.best(retrieve.restrict(retrieve.scored(known, own, MU), first), 10)


@query(f"""WITH {RUN}, g AS (SELECT entity_id, unnest(list_concat(terms, list_transform(range(1,greatest(len(terms),1)), lambda i: terms[i]||' '||terms[i+1]))) AS gram FROM kb SEMI JOIN run USING (entity_id)), gn AS (SELECT entity_id, gram, count(*) AS n FROM g GROUP BY ALL), gc AS (SELECT *, sum(n) OVER (PARTITION BY entity_id) AS total FROM gn),
nm AS (SELECT DISTINCT mention_id, unnest(list_concat(terms[4:], list_transform(range(4,greatest(len(terms),4)), lambda i: terms[i]||' '||terms[i+1]))) AS name FROM ment),
e AS (SELECT mention_id, entity_id, exp(score-max(score) OVER (PARTITION BY mention_id)) AS x FROM run), po AS (SELECT mention_id, entity_id, x/sum(x) OVER (PARTITION BY mention_id) AS posterior FROM e),
s AS (SELECT mention_id, name, round(sum(posterior*n/total),6) AS weight FROM po JOIN nm USING (mention_id) JOIN gc ON gc.entity_id=po.entity_id AND gc.gram=nm.name GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY weight DESC, name) AS rank FROM s WHERE weight>0) WHERE rank<=10""")
def feedback_neighbors(spark, d):
    """The ten names around a mention (words and word pairs) that its feedback entries speak of most."""
    first, m = run(spark, d), views.mentions(spark, d)
    grams = index.language_model(views.kb(spark, d).join(first.select("entity_id").distinct(), "entity_id", "left_semi"), 2)
    rest = F.slice("terms", F.lit(4), F.size("terms"))
    names = m.select("mention_id", F.explode(text.let(rest, lambda t: F.concat(t, text.ngrams(t, 2)))).alias("name"))
    return context.feedback_names(first, grams.select("entity_id", "gram", "p"), names)


@query(f"""WITH {RUN}, mp AS (SELECT mention_id, term, count(*) AS m FROM (SELECT mention_id, unnest(terms) AS term FROM ment) GROUP BY ALL),
b0 AS (SELECT mention_id, entity_id, term, m, 0 AS e FROM run JOIN mp USING (mention_id) UNION ALL SELECT mention_id, entity_id, term, 0, tf FROM run JOIN post USING (entity_id)), b AS (SELECT mention_id, entity_id, term, sum(m)::DOUBLE AS m, sum(e)::DOUBLE AS e FROM b0 GROUP BY ALL),
l AS (SELECT mention_id, entity_id, sum(m) AS lm, sum(e) AS le FROM b GROUP BY ALL), j AS (SELECT b.*, m/lm AS p, CASE WHEN le>0 THEN e/le ELSE 0 END AS q, (e+1000.0*coalesce(cf,1)/tokens)/(le+1000.0) AS s FROM b JOIN l USING (mention_id, entity_id) LEFT JOIN stats USING (term), coll)
SELECT mention_id, entity_id, round(least(sum(CASE WHEN p>0 THEN p*ln(p/s) ELSE 0 END),100),6) AS kl, round(least(sum((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0 END)/2+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0 END)/2),100),6) AS js,
round(sum(CASE WHEN m>0 AND e>0 THEN 1 ELSE 0 END)/count(*),6) AS jaccard, round(CASE WHEN sum(m*m)*sum(e*e)=0 THEN 0 ELSE sum(m*e)/(sqrt(sum(m*m))*sqrt(sum(e*e))) END,6) AS cosine FROM j GROUP BY ALL""")
def candidate_similarity(spark, d):
    """Divergences of each mention's text and each of its candidates', smoothed with 1000."""
    ix, pairs = views.kb_index(spark, d), run(spark, d).select("mention_id", "entity_id")
    post = ix.postings.join(pairs.select("entity_id").distinct(), "entity_id", "left_semi")
    both = similarity.sides(pairs, index.postings(views.mentions(spark, d), "mention_id"), post, "mention_id", "entity_id")
    t = similarity.divergences(both, ix.stats.select("term", "cf"), ix.collection[0], "mention_id", "entity_id", 1000.0)
    return t.select("mention_id", "entity_id", *(r6(c).alias(c) for c in t.columns[2:]))


# --- links -------------------------------------------------------------------


@query(rf"""WITH {LINKS}, pg AS (SELECT page_id, unnest(range(0,len(b))) AS par, unnest(b) AS body FROM (SELECT page_id, regexp_extract_all(html,'<p>(.*?)</p>',1,'s') AS b FROM pages)), pt AS (SELECT page_id, par, regexp_replace(body,'<[^>]*>','','g') AS text FROM pg),
h AS (SELECT l.page_id, l.dest, count(DISTINCT p.par) AS passages FROM (SELECT DISTINCT page_id, dest, anchor FROM lk) l JOIN pt p ON p.page_id=l.page_id AND contains(p.text, l.anchor) GROUP BY ALL)
SELECT c.page_id, c.dest, c.links, coalesce(h.passages,0) AS passages FROM (SELECT page_id, dest, count(*) AS links FROM lk GROUP BY ALL) c LEFT JOIN h USING (page_id, dest)""")
def passage_counts(spark, d):
    return links.passage_counts(views.links(spark, d), views.paragraphs(spark, d))


@query(rf"""WITH {_FIELDS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY p DESC, value) AS r FROM pr WHERE field='anchor' AND NOT regexp_matches(lower(value),'{"|".join(text.SPAM_WORDS)}')) WHERE r<=100),
n AS (SELECT entity, {norm('value')} AS value, p FROM k) SELECT entity, value, round(sum(p),6) AS weight FROM n WHERE length(value)>3 GROUP BY ALL""")
def external_names(spark, d):
    p = links.name_probability(links.name_counts(_fields(spark, d).where("field = 'anchor'")))
    return links.external_names(p.select("entity", "value", "p")).withColumn("weight", r6("weight"))


_N = 10000.0


@query(f"""WITH {_WORDLINKS}, e AS (SELECT DISTINCT entity, dest FROM wl WHERE entity<>dest), s0 AS (SELECT 'out' AS kind, entity AS k, dest AS e FROM e UNION SELECT 'in', dest, entity FROM e), s AS (SELECT * FROM s0 UNION SELECT 'all', k, e FROM s0), z AS (SELECT kind, k, count(*) AS n FROM s GROUP BY ALL),
kd AS (SELECT unnest(['out','in','all']) AS kind), pr AS (SELECT kind, entity, dest FROM e, kd), i AS (SELECT pr.kind, entity, dest, count(*) AS i FROM pr JOIN s x ON x.kind=pr.kind AND x.k=entity JOIN s y ON y.kind=pr.kind AND y.k=dest AND y.e=x.e GROUP BY ALL),
m AS (SELECT pr.kind, entity, dest, coalesce(i,0) AS i, coalesce(a.n,0) AS n1, coalesce(b.n,0) AS n2 FROM pr LEFT JOIN i USING (kind, entity, dest) LEFT JOIN z a ON a.kind=pr.kind AND a.k=entity LEFT JOIN z b ON b.kind=pr.kind AND b.k=dest)
SELECT m.kind, m.entity, m.dest, i::BIGINT AS intersect, round(CASE WHEN n1=0 OR n2=0 THEN 0 ELSE 1000.0*i/(n1*n2) END,6) AS approx_pmi, round(CASE WHEN n1=0 OR n2=0 THEN 0 ELSE (i/{_N})/((n1/{_N})*(n2/{_N})) END,6) AS pmi, round(CASE WHEN n1+n2-i=0 THEN 0 ELSE i/(n1+n2-i) END,6) AS jaccard,
round(CASE WHEN n1+n2=0 THEN 0 ELSE 2.0*i/(n1+n2) END,6) AS dice, round(CASE WHEN n1=0 OR n2=0 OR i=0 THEN 0 ELSE 1-(ln(greatest(n1,n2))-ln(i))/(ln({_N})-ln(least(n1,n2))) END,6) AS google, (b.entity IS NOT NULL) AS mutual FROM m LEFT JOIN e b ON b.entity=m.dest AND b.dest=m.entity""")
def link_set_features(spark, d):
    """Overlap of the link partners of every linked pair, by direction, and whether the link goes both ways."""
    own = _word_links(spark, d).where("entity <> dest").select("entity", "dest").distinct()
    tag = lambda c: F.concat_ws("|", "kind", c)
    each = own.withColumn("kind", F.explode(F.array(*map(F.lit, ("out", "in", "all"))))).select("kind", "entity", "dest", tag("entity").alias("a"), tag("dest").alias("b"))
    held = links.link_sets(own).select(tag("k").alias("k"), "e")
    f = sets.of_rows(held, each.select("a", "b"), "k", "e", "a", "b").join(each, ["a", "b"])
    m = sets.measures(F.col("i"), F.col("n1"), F.col("n2"), F.lit(_N))
    back = own.select(F.col("dest").alias("entity"), F.col("entity").alias("dest"), F.lit(True).alias("mutual"))
    return f.join(back, ["entity", "dest"], "left").select("kind", "entity", "dest", m["intersect"].alias("intersect"), *(r6(m[k]).alias(k) for k in ("approx_pmi", "pmi", "jaccard", "dice", "google")), F.coalesce("mutual", F.lit(False)).alias("mutual"))


_NEXT = "top1 AS (SELECT mention_id, entity_id FROM run WHERE rank=1), nb AS (SELECT r.mention_id, r.entity_id AS a, t.entity_id AS b FROM run r JOIN top1 t ON t.mention_id IN (r.mention_id+1, r.mention_id+2))"


def _near(spark, d):
    """(mention_id, a, b): each candidate with the best entries of the two next mentions."""
    r = run(spark, d).select("mention_id", F.col("entity_id").alias("a"), "rank")
    top = r.where("rank = 1").select(F.explode(F.array(F.col("mention_id") - 1, F.col("mention_id") - 2)).alias("mention_id"), F.col("a").alias("b"))
    return r.drop("rank").join(top, "mention_id")


@query(f"""WITH {RUN}, {_NEXT}, t AS (SELECT entity_id, ' '||array_to_string(terms,' ')||' ' AS body, ' '||title||' ' AS title FROM kb SEMI JOIN run USING (entity_id)), f AS (SELECT DISTINCT a, b FROM nb)
SELECT a, b, (contains(x.body,y.title))::INT AS a_holds_b, (contains(y.body,x.title))::INT AS b_holds_a FROM f JOIN t x ON x.entity_id=a JOIN t y ON y.entity_id=b""")
def title_containment(spark, d):
    pairs = _near(spark, d).select("a", "b").distinct()
    listed = pairs.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    t = views.kb(spark, d).join(listed, "entity_id", "left_semi").select("entity_id", F.concat(F.lit(" "), F.array_join("terms", " "), F.lit(" ")).alias("body"), F.concat(F.lit(" "), F.col("title"), F.lit(" ")).alias("title"))
    j = pairs.join(t.withColumnsRenamed({"entity_id": "a", "body": "body_a", "title": "title_a"}), "a").join(t.withColumnsRenamed({"entity_id": "b", "body": "body_b", "title": "title_b"}), "b")
    return j.select("a", "b", F.contains("body_a", "title_b").cast("int").alias("a_holds_b"), F.contains("body_b", "title_a").cast("int").alias("b_holds_a"))


@query(f"""WITH {RUN}, {_NEXT}, c AS (SELECT entity_id, list_distinct([lang, source, left(source,3)]) AS c FROM kb), f AS (SELECT DISTINCT a, b FROM nb), m AS (SELECT a, b, len(list_intersect(x.c,y.c)) AS i, len(x.c) AS n1, len(y.c) AS n2 FROM f JOIN c x ON x.entity_id=a JOIN c y ON y.entity_id=b)
SELECT a, b, i::BIGINT AS intersect, (n1-i+n2-i)::BIGINT AS missing, round(2.0*i/(n1+n2),6) AS dice, round(i/(n1+n2-i),6) AS jaccard, round(i/sqrt(n1*n2),6) AS cosine FROM m""")
def category_overlap(spark, d):
    pairs = _near(spark, d).select("a", "b").distinct()
    c = views.kb(spark, d).select("entity_id", F.array_distinct(F.array("lang", "source", F.left("source", F.lit(3)))).alias("c"))
    j = pairs.join(c.withColumnsRenamed({"entity_id": "a", "c": "x"}), "a").join(c.withColumnsRenamed({"entity_id": "b", "c": "y"}), "b")
    m = sets.of_arrays(F.col("x"), F.col("y"))
    return j.select("a", "b", m["intersect"].alias("intersect"), m["missing"].alias("missing"), *(r6(m[k]).alias(k) for k in ("dice", "jaccard", "cosine")))


# --- the feature table and a model of full size ------------------------------

_AL = lambda side, n: f"{side}({{x}},{n})"
_WD = lambda x: f"list_distinct({_ws(x)})"
_FT = f"""{RUN}, p AS (SELECT r.mention_id, r.entity_id, r.score, r.rank, name AS a, title AS b, least(length(name),length(title)) AS n, {_ws('name')} AS x, {_ws('title')} AS y FROM run r JOIN ment USING (mention_id) JOIN kb USING (entity_id)),
s AS (SELECT *, least(len(x),len(y)) AS k, {_chars('a')} AS ca, {_chars('b')} AS cb, list_distinct(x) AS wa, list_distinct(y) AS wb FROM p),
al AS (SELECT *, {_dice(_chars('left(a,n)'), _chars('left(b,n)'))} AS cl, {_dice(_chars('right(a,n)'), _chars('right(b,n)'))} AS cr, {_dice('list_distinct(x[1:k])', 'list_distinct(y[1:k])')} AS wl, CASE WHEN k=0 THEN 0.0 ELSE {_dice('list_distinct(x[len(x)-k+1:len(x)])', 'list_distinct(y[len(y)-k+1:len(y)])')} END AS wr FROM s),
ft AS (SELECT mention_id, entity_id, score, rank, (regexp_full_match(upper(replace(a,' ','')),'[A-Z]*'))::INT::DOUBLE AS is_acronym, (a<>'' AND b<>'' AND left(a,1)=left(b,1))::INT::DOUBLE AS first_letter,
(a<>'' AND a=array_to_string(list_transform(list_filter(y, lambda w: w NOT IN {stops()}), lambda w: left(w,1)),''))::INT::DOUBLE AS acronym_match, len(list_intersect(wa,wb))::DOUBLE AS word_match, (len(wa)+len(wb)-2*len(list_intersect(wa,wb)))::DOUBLE AS word_misses,
round({_dice('wa','wb')},6)::DOUBLE AS word_dice, round(CASE WHEN len(wa)+len(wb)=0 THEN 0 ELSE len(list_intersect(wa,wb))/(len(wa)+len(wb)-len(list_intersect(wa,wb))) END,6)::DOUBLE AS word_jaccard, round(wl,6)::DOUBLE AS word_left, round(wr,6)::DOUBLE AS word_right, round(greatest(wl,wr),6)::DOUBLE AS word_max,
(a=b)::INT::DOUBLE AS exact, (a<>'' AND ends_with(a,b))::INT::DOUBLE AS prefix, len(list_intersect(ca,cb))::DOUBLE AS char_match, (len(ca)+len(cb)-2*len(list_intersect(ca,cb)))::DOUBLE AS char_misses, round({_dice('ca','cb')},6)::DOUBLE AS char_dice,
round(CASE WHEN len(ca)+len(cb)=0 THEN 0 ELSE len(list_intersect(ca,cb))/(len(ca)+len(cb)-len(list_intersect(ca,cb))) END,6)::DOUBLE AS char_jaccard, round(cl,6)::DOUBLE AS char_left, round(cr,6)::DOUBLE AS char_right, round(greatest(cl,cr),6)::DOUBLE AS char_max, damerau_levenshtein(a,b)::DOUBLE AS edits, round(1-jaro_winkler_similarity(a,b),6)::DOUBLE AS jaro_winkler FROM al)"""
FULL = (
    "is_acronym", "first_letter", "acronym_match", "word_match", "word_misses", "word_dice", "word_jaccard", "word_left", "word_right", "word_max", "exact", "prefix",
    "char_match", "char_misses", "char_dice", "char_jaccard", "char_left", "char_right", "char_max", "edits", "jaro_winkler",
)


def query_features(spark, d):
    """The run with all features of the mention's name against the entry's title; edit distances on distinct pairs."""
    r = run(spark, d).join(views.mentions(spark, d).select("mention_id", F.col("name").alias("a")), "mention_id").join(views.kb(spark, d).select("entity_id", F.col("title").alias("b")), "entity_id")
    a, b = F.col("a"), F.col("b")
    w, c = (sets.of_arrays(f(a), f(b)) for f in (text.words, text.chars))
    wl, wr, wm = text.aligned_dice_words(a, b)
    cl, cr, cm = text.aligned_dice_chars(a, b)
    apart = r.select("a", "b").distinct().select("a", "b", edits.damerau_distance("a", "b").cast("double").alias("edits"), r6(edits.jaro_winkler_distance("a", "b")).alias("jaro_winkler"))
    f = r.select(
        "mention_id", "entity_id", "score", "rank", "a", "b", text.is_acronym(F.upper(F.replace(a, F.lit(" "), F.lit("")))).alias("is_acronym"), text.first_letter_match(a, b).alias("first_letter"), text.acronym_match(a, b).alias("acronym_match"),
        w["intersect"].cast("double").alias("word_match"), w["missing"].cast("double").alias("word_misses"), r6(w["dice"]).alias("word_dice"), r6(w["jaccard"]).alias("word_jaccard"), r6(wl).alias("word_left"), r6(wr).alias("word_right"), r6(wm).alias("word_max"),
        text.exact_match(a, b).alias("exact"), text.suffix_of(a, b).alias("prefix"), c["intersect"].cast("double").alias("char_match"), c["missing"].cast("double").alias("char_misses"), r6(c["dice"]).alias("char_dice"), r6(c["jaccard"]).alias("char_jaccard"),
        r6(cl).alias("char_left"), r6(cr).alias("char_right"), r6(cm).alias("char_max"),
    )
    return f.join(apart, ["a", "b"]).drop("a", "b")


@query(f"WITH {_FT} SELECT mention_id, entity_id, rank, {', '.join(FULL)} FROM ft")
def query_only_features(spark, d):
    return query_features(spark, d).select("mention_id", "entity_id", "rank", *FULL)


@query(f"""WITH {RUN}, v AS (SELECT mention_id, name AS a FROM ment UNION SELECT mention_id, terms[1] FROM ment UNION SELECT mention_id, terms[1]||' '||terms[2] FROM ment), p AS (SELECT r.mention_id, r.entity_id, a, title AS b FROM run r JOIN v USING (mention_id) JOIN kb USING (entity_id)),
f AS (SELECT mention_id, entity_id, unnest([struct_pack(feature := 'char_dice', x := {_dice(_chars('a'), _chars('b'))}::DOUBLE), struct_pack(feature := 'word_dice', x := {_dice(_WD('a'), _WD('b'))}::DOUBLE), struct_pack(feature := 'exact', x := (a=b)::INT::DOUBLE), struct_pack(feature := 'first_letter', x := (a<>'' AND b<>'' AND left(a,1)=left(b,1))::INT::DOUBLE), struct_pack(feature := 'words', x := len(list_intersect({_WD('a')},{_WD('b')}))::DOUBLE)]) AS s FROM p)
SELECT mention_id, entity_id, s.feature AS feature, round(min(s.x),6) AS least, round(max(s.x),6) AS most, round(avg(s.x),6) AS mean FROM f GROUP BY ALL""")
def variant_features(spark, d):
    """Least, greatest and mean of each name feature over a mention's name variants."""
    m = views.mentions(spark, d).select("mention_id", F.explode(F.array_distinct(F.array("name", F.try_element_at("terms", F.lit(1)), F.array_join(F.slice("terms", 1, 2), " ")))).alias("a"))
    r = run(spark, d).select("mention_id", "entity_id").join(m, "mention_id").join(views.kb(spark, d).select("entity_id", F.col("title").alias("b")), "entity_id")
    a, b = F.col("a"), F.col("b")
    values = {"char_dice": text.dice(text.chars(a), text.chars(b)), "word_dice": text.dice(text.words(a), text.words(b)), "exact": text.exact_match(a, b), "first_letter": text.first_letter_match(a, b), "words": F.size(F.array_intersect(text.words(a), text.words(b))).cast("double")}
    rows = r.select("mention_id", "entity_id", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), v.alias("x")) for k, v in values.items()))).alias("s")).select("mention_id", "entity_id", "s.*")
    return rows.groupBy("mention_id", "entity_id", "feature").agg(r6(F.min("x")).alias("least"), r6(F.max("x")).alias("most"), r6(F.avg("x")).alias("mean"))


def _grown(trees: int = 230, leaves: int = 10, seed: int = 5) -> list[tuple[float, list[tuple[int, float, int, int, float]]]]:
    """An ensemble of a full model's size, grown by rule: random splits and outputs from a fixed seed."""
    rnd, out = random.Random(seed), []
    for _ in range(trees):
        nodes = [(0, 0.0, 0, 0, round(rnd.uniform(-2, 2), 3))]
        while (len(nodes) + 1) // 2 < leaves:
            at = rnd.choice([i for i, x in enumerate(nodes) if x[0] == 0])
            k = len(nodes)
            nodes += [(0, 0.0, k + i, k + i, round(rnd.uniform(-2, 2), 3)) for i in range(2)]
            nodes[at] = (rnd.randint(1, len(FULL) + 2), round(rnd.choice((rnd.uniform(0, 1), rnd.uniform(0, 12))), 2), k, k + 1, 0.0)
        out.append((0.1, nodes))
    return out


_TREES = _grown()


def _tree_sql(nodes: list, at: int = 0) -> str:
    f, cut, left, right, output = nodes[at]
    return str(output) if f == 0 else f"(CASE WHEN v[{f}]::FLOAT<={cut}::FLOAT THEN {_tree_sql(nodes, left)} ELSE {_tree_sql(nodes, right)} END)"


_MODEL = "+".join(f"0.1*{_tree_sql(n)}::DOUBLE" for _, n in _TREES)


@query(f"WITH {_FT}, vv AS (SELECT mention_id, entity_id, rank AS old_rank, [{','.join(FULL)}, 1.0/(rank+1), score]::DOUBLE[] AS v FROM ft), sc AS (SELECT mention_id, entity_id, old_rank, round({_MODEL},6) AS model_score FROM vv) SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY model_score DESC, old_rank) AS rank FROM sc")
def full_model_rerank(spark, d):
    """All features, scored by 230 trees of ten leaves in Arrow batches, ranked anew."""
    v = rank.assemble(query_features(spark, d), FULL)
    return rank.rerank(v, rank.Ensemble(_TREES).column()).select("mention_id", "entity_id", "old_rank", "model_score", "rank")


@query(f"WITH {_FT}, w(feature, weight) AS (VALUES {','.join(f"('{f}',{i + 1})" for i, f in enumerate(FULL))}), u AS (UNPIVOT (SELECT mention_id, entity_id, {','.join(FULL)} FROM ft) ON {','.join(FULL)} INTO NAME feature VALUE value) SELECT mention_id, entity_id, sum(value::DECIMAL(18,6)*weight)::DOUBLE AS product FROM u JOIN w USING (feature) GROUP BY ALL")
def inner_product(spark, d):
    """Sparse features times weights, in decimals."""
    from larkspan.operators.ranking import inner_product as product

    weights = spark.createDataFrame([(f, i + 1) for i, f in enumerate(FULL)], "feature string, weight int")
    rows = query_features(spark, d).select("mention_id", "entity_id", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("decimal(18,6)").alias("value")) for f in FULL))).alias("f")).select("mention_id", "entity_id", "f.*")
    return product(rows, weights, ["mention_id", "entity_id"]).withColumn("product", F.col("product").cast("double"))


# --- decisions and reports ---------------------------------------------------


@query(f"WITH {RUN} SELECT mention_id, title, CASE WHEN entity_id%3=0 THEN NULL ELSE 'E'||entity_id END AS kb_id FROM run JOIN kb USING (entity_id) WHERE rank=1")
def wiki_only(spark, d):
    """Best entries by an id map in which every third entry has no id."""
    p = top_predictions(spark, d)
    kb_id = F.when(F.col("entity_id") % 3 == 0, "NIL").otherwise(F.concat(F.lit("E"), F.col("entity_id").cast("string")))
    return nil.wiki_only(p.select("mention_id", "title", kb_id.alias("kb_id"))).select("mention_id", "title", "kb_id")


@query(f"WITH {RUN}, {QREL} SELECT mention_id, entity_id, rank FROM run SEMI JOIN qrel USING (mention_id) JOIN ment USING (mention_id) WHERE contains(name,'an')")
def title_exploration(spark, d):
    """The ten candidates of mentions that have a true entry and whose name holds a string."""
    asked = views.mentions(spark, d).where(F.contains("name", F.lit("an"))).select("mention_id").join(views.qrels(spark, d), "mention_id", "left_semi")
    return run(spark, d).join(asked, "mention_id", "left_semi").select("mention_id", "entity_id", "rank")


_RANKS = f"{RUN}, {QREL}, b AS (SELECT mention_id, min(rank) AS r FROM run JOIN qrel USING (mention_id, entity_id) GROUP BY 1), rk AS (SELECT mention_id, coalesce(r-1,-1)::BIGINT AS idx0 FROM ment LEFT JOIN b USING (mention_id))"


@query(f"WITH {_RANKS}, a AS (SELECT unnest(range(-1,100))::BIGINT AS idx0) SELECT a.idx0, count(rk.mention_id) AS n FROM a LEFT JOIN rk USING (idx0) GROUP BY 1")
def rank_distribution_full(spark, d):
    """How often each place from -1 (absent) to 99 holds the answer, those that never do included."""
    r = evaluate.answer_ranks(views.mentions(spark, d), run(spark, d), views.qrels(spark, d)).groupBy("idx0").agg(F.count("*").alias("n"))
    return spark.range(-1, 100).withColumnRenamed("id", "idx0").join(r, "idx0", "left").fillna(0, ["n"])


@query(f"""WITH {RUN}, {QREL}, top1 AS (SELECT mention_id, entity_id, score FROM run WHERE rank=1), g AS (SELECT m.mention_id, (SELECT count(*) FROM qrel q WHERE q.mention_id=m.mention_id) AS n_true FROM ment m WHERE mention_id%2=0), p AS (SELECT mention_id, CASE WHEN score>=-11 THEN entity_id END AS entity_id FROM top1),
j AS (SELECT g.mention_id, n_true, p.mention_id IS NOT NULL AS given, p.entity_id, EXISTS (SELECT 1 FROM qrel q WHERE q.mention_id=g.mention_id AND q.entity_id=p.entity_id) AS hit FROM g LEFT JOIN p USING (mention_id)), c AS (SELECT *, CASE WHEN n_true=0 THEN (given AND entity_id IS NULL)::INT ELSE hit::INT END AS ok, ((n_true=0)=(entity_id IS NULL))::INT AS dec FROM j)
SELECT count(*) AS n, round(avg(ok),6) AS acc_all, round(avg(CASE WHEN n_true>0 THEN ok END),6) AS acc_linked, round(avg(CASE WHEN n_true=0 THEN ok END),6) AS acc_nil, round(avg(dec),6) AS acc_decision FROM c""")
def even_split_report(spark, d):
    """Accuracies on the test half: mentions with even ids."""
    test = rank.odd_even(gold(spark, d)).where("split = 'test'").drop("split")
    a = evaluate.linking_accuracy(test, nil.threshold(top_predictions(spark, d), -11.0))
    return a.select("n", *(r6(c).alias(c) for c in a.columns[1:]))


@query(f"WITH {_AP} SELECT mention_id%2 AS half, count(*) AS n, round(avg(ap),6) AS map FROM ap GROUP BY 1")
def map_by_half(spark, d):
    ap = evaluate.average_precision(run(spark, d), views.qrels(spark, d))
    return ap.groupBy((F.col("mention_id") % 2).alias("half")).agg(F.count("*").alias("n"), r6(F.avg("ap")).alias("map"))
