"""Clipped tags, sentences, further features, decisions from results."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import KB, LINKS, POST, RUN, norm, query, r6, stops
from larkspan.catalogue.entities import _CAP, _NEXT, _names, _near, _targets
from larkspan.catalogue.graph import _WORDLINKS, _word_links
from larkspan.catalogue.learning import _FEATURES, name_feature_rows
from larkspan.catalogue.retrieval import run
from larkspan.functions import text
from larkspan.operators import context, evaluate, links, rank, similarity
from larkspan.operators.ranking import top_k
from larkspan.plans import views


@query(f"WITH {_CAP}, r AS (SELECT conv_id, turn, min(pos) AS first, max(pos) AS last, string_agg(word,' ' ORDER BY pos) AS name FROM i WHERE label<>'O' GROUP BY conv_id, turn, g) SELECT conv_id||':'||turn AS id, name, greatest(first,3)::BIGINT AS first, least(last,11)::BIGINT AS last FROM r WHERE last>=3 AND first<12")
def clipped_tags(spark, d):
    """Names of each turn, cut to the window of words 3 to 11."""
    t = views.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "word"))
    t = t.withColumns({"pos": (F.col("pos") + 1).cast("long"), "label": F.when(F.col("word").rlike("^[A-Z]"), "CAP").otherwise("O")})
    tags = context.label_runs(t, ["id"]).select("id", F.col("words").alias("name"), "first", "last")
    windows = tags.select("id").distinct().select("id", F.lit(3).cast("long").alias("begin"), F.lit(12).cast("long").alias("end"))
    return links.clip(tags, windows, "id")


@query(r"""WITH w AS (SELECT conv_id, turn, text, unnest(range(1,len(p)+1)) AS i, unnest(p) AS token FROM (SELECT conv_id, turn, text, regexp_split_to_array(text,'[^\p{L}\p{Nd}]') AS p FROM conversations)),
o AS (SELECT conv_id, turn, text, token, (sum(length(token)+1) OVER (PARTITION BY conv_id, turn ORDER BY i)-length(token)-1)::BIGINT AS b FROM w), s AS (SELECT conv_id, turn, length(left(text,b))-length(replace(left(text,b),'.',''))+1 AS sentence FROM o WHERE length(token)>=2)
SELECT conv_id, turn, sentence::INT AS sentence, count(*) AS tokens FROM s GROUP BY ALL""")
def sentence_of_offset(spark, d):
    c = views.table(spark, d, "conversations")
    at = context.token_offsets(c, ["conv_id", "turn"], "text").join(c.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return at.groupBy("conv_id", "turn", context.sentence_of(F.col("text"), F.col("begin").cast("int")).alias("sentence")).agg(F.count("*").alias("tokens"))


@query(f"""WITH {_CAP}, s AS (SELECT conv_id, unnest(list_transform(list_filter(list_transform(string_split(text,'.'), lambda x: trim(x)), lambda x: x<>''), lambda x: x||'.')) AS text FROM conversations), h AS (SELECT conv_id, target, unnest(regexp_extract_all(text,'[A-Z][a-z]+')) AS name FROM s JOIN tgt USING (conv_id) WHERE contains(text, target))
SELECT conv_id, name, count(*) AS n FROM h WHERE NOT contains(target, name) GROUP BY ALL""")
def sentence_names(spark, d):
    """Names that share a sentence with a conversation's first name."""
    s = context.sentences(views.table(spark, d, "conversations"), "conv_id", "text")
    return context.sentence_names(s, _targets(_names(spark, d)), "conv_id")


@query(f"""WITH {_CAP}, f AS (SELECT conv_id, left(target, 4) AS target FROM tgt), m AS (SELECT c.conv_id, c.turn, c.first, c.name FROM cap c JOIN f USING (conv_id) WHERE {norm('name')}={norm('target')} OR contains(lower(name),lower(target)) OR contains(lower(target),lower(name)))
SELECT conv_id, turn, first::BIGINT AS first, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, first) AS r FROM m) WHERE r=1""")
def linked_match(spark, d):
    """The first mention that matches the head of a conversation's first name."""
    n = _names(spark, d)
    t = _targets(n).withColumn("target", F.left("target", F.lit(4)))
    return context.linked_match(n, t, "conv_id", [F.asc("turn"), F.asc("first")]).select("conv_id", "turn", "first", "name")


@query(f"""WITH {_WORDLINKS}, e AS (SELECT DISTINCT entity, dest FROM wl WHERE dest<>entity AND NOT regexp_matches(dest,'^(Category:|File:|List of )') AND NOT regexp_matches(entity,'^(Category:|File:|List of )')),
b AS (SELECT entity, dest, max(o)::INT AS "out", max(i)::INT AS "in" FROM (SELECT entity, dest, 1 AS o, 0 AS i FROM e UNION ALL SELECT dest, entity, 0, 1 FROM e) GROUP BY ALL), s AS (SELECT p.entity, p.dest, count(*) AS shared FROM e p JOIN e a ON a.dest=p.entity JOIN e b ON b.entity=a.entity AND b.dest=p.dest GROUP BY ALL)
SELECT b.*, coalesce(shared,0) AS shared FROM b LEFT JOIN s USING (entity, dest)""")
def neighborhood(spark, d):
    return links.neighborhood(_word_links(spark, d))


@query(f"WITH {KB}, {POST}, t AS (SELECT * FROM (SELECT entity_id, term, tf, row_number() OVER (PARTITION BY entity_id ORDER BY tf DESC, term) AS rank FROM post WHERE term NOT IN {stops()}) WHERE rank<=10) SELECT entity_id, term, rank, round(tf/sum(tf) OVER (PARTITION BY entity_id),6) AS p FROM t")
def entity_terms(spark, d):
    """Ten most frequent words of each entry as a distribution over these ten."""
    from pyspark.sql import Window

    post = views.kb_index(spark, d).postings.where(~text.is_stop(F.col("term")))
    t = top_k(post, "entity_id", [F.desc("tf"), F.asc("term")], 10)
    return t.select("entity_id", "term", "rank", r6(F.col("tf") / F.sum("tf").over(Window.partitionBy("entity_id"))).alias("p"))


@query(f"""WITH {RUN}, q AS (SELECT r.mention_id, r.entity_id, name, terms AS t, k.n FROM run r JOIN (SELECT mention_id, name FROM ment WHERE len(terms)>=3) USING (mention_id) JOIN (SELECT entity_id, terms, len(terms) AS n FROM kb) k USING (entity_id))
SELECT mention_id, entity_id, len(list_filter(range(1,greatest(n-1,1)), lambda i: t[i]||' '||t[i+1]||' '||t[i+2]=name))::BIGINT AS n_phrase, round(len(list_filter(range(1,greatest(n-1,1)), lambda i: t[i]||' '||t[i+1]||' '||t[i+2]=name))/(n+greatest(n-1,0)+greatest(n-2,0)+greatest(n-3,0)+greatest(n-4,0)),9) AS p FROM q""")
def field_phrase_probability(spark, d):
    """Probability of a mention's whole name as an n-gram of the entry's text, over n-grams of up to five words."""
    m = views.mentions(spark, d).where(F.size("terms") >= 3).select("mention_id", "name")
    q = run(spark, d).select("mention_id", "entity_id").join(m, "mention_id").join(views.kb(spark, d).select("entity_id", "terms", "len"), "entity_id")
    hits = F.size(F.filter(text.ngrams(F.col("terms"), 3), lambda g: g == F.col("name"))).cast("long")
    total = sum((F.greatest(F.col("len") - i, F.lit(0)) for i in range(1, 5)), F.col("len"))
    return q.select("mention_id", "entity_id", hits.alias("n_phrase"), F.round(hits / total, 9).alias("p"))


@query(rf"""WITH {LINKS}, pg AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html,'<p>(.*?)</p>',1,'s')),'<[^>]*>','','g') AS text FROM pages), nt AS (SELECT page_id, lower(w) AS term, count(*) AS m FROM (SELECT page_id, unnest(regexp_extract_all(text,'[A-Z][a-z]+')) AS w FROM pg) GROUP BY ALL),
anc AS (SELECT page_id, lower(anchor) AS term, count(*) AS e FROM lk GROUP BY ALL), bg AS (SELECT term, sum(e)::BIGINT AS cf FROM anc GROUP BY 1), tt AS (SELECT sum(cf)::DOUBLE AS tokens FROM bg), pr AS (SELECT page_id FROM nt SEMI JOIN anc USING (page_id) GROUP BY 1),
b0 AS (SELECT page_id, term, m, 0 AS e FROM nt SEMI JOIN pr USING (page_id) UNION ALL SELECT page_id, term, 0, e FROM anc SEMI JOIN pr USING (page_id)), b AS (SELECT page_id, term, sum(m)::DOUBLE AS m, sum(e)::DOUBLE AS e FROM b0 GROUP BY ALL), l AS (SELECT page_id, sum(m) AS lm, sum(e) AS le FROM b GROUP BY 1),
j AS (SELECT b.*, m/lm AS p, CASE WHEN le>0 THEN e/le ELSE 0 END AS q, (e+100.0*coalesce(cf,1)/tokens)/(le+100.0) AS s FROM b JOIN l USING (page_id) LEFT JOIN bg USING (term), tt)
SELECT page_id, round(least(sum(CASE WHEN p>0 THEN p*ln(p/s) ELSE 0 END),100),6) AS kl, round(least(sum((CASE WHEN p>0 THEN p*ln(p/((p+q)/2)) ELSE 0 END)/2+(CASE WHEN q>0 THEN q*ln(q/((p+q)/2)) ELSE 0 END)/2),100),6) AS js, sum((m>0 AND e>0)::INT)::BIGINT AS intersect, sum((m=0 OR e=0)::INT)::BIGINT AS misses, round(sum((m>0 AND e>0)::INT)/count(*),6) AS jaccard FROM j GROUP BY 1""")
def name_link_divergence(spark, d):
    """Names in a page's text against the anchors of its links: divergences (smoothed with 100) and set overlap."""
    names = views.paragraphs(spark, d).select("page_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("w")).groupBy("page_id", F.lower("w").alias("term")).agg(F.count("*").alias("tf"))
    anchors = views.links(spark, d).groupBy("page_id", F.lower("anchor").alias("term")).agg(F.count("*").alias("tf"))
    background = anchors.groupBy("term").agg(F.sum("tf").alias("cf"))
    tokens = float(background.agg(F.sum("cf")).first()[0] or 0)
    pairs = names.select("page_id").distinct().join(anchors.select("page_id").distinct(), "page_id", "left_semi").withColumn("of", F.col("page_id"))
    both = similarity.sides(pairs, names, anchors.withColumnRenamed("page_id", "of"), "page_id", "of")
    t = similarity.divergences(both, background, tokens, "page_id", "of", 100.0)
    hit = (F.col("m") > 0) & (F.col("e") > 0)
    n = both.groupBy("page_id").agg(F.sum(hit.cast("long")).alias("intersect"), F.sum((~hit).cast("long")).alias("misses"))
    return t.join(n, "page_id").select("page_id", r6("kl").alias("kl"), r6("js").alias("js"), "intersect", "misses", r6("jaccard").alias("jaccard"))


@query(f"WITH {RUN} SELECT mention_id, entity_id, score, place FROM (SELECT mention_id, entity_id, score, row_number() OVER (ORDER BY score DESC, mention_id) AS place FROM run WHERE rank=1 AND score>-11.5) WHERE place<=100")
def linked_neighbors(spark, d):
    """The hundred best links of a first pass above a score: neighbours for a second one."""
    top = run(spark, d).where("rank = 1 and score > -11.5").select("mention_id", "entity_id", "score").orderBy(F.desc("score"), F.asc("mention_id")).limit(100)
    return top_k(top.withColumn("_g", F.lit(0)), "_g", [F.desc("score"), F.asc("mention_id")], 100, "place").drop("_g")  # a hundred rows


@query(f"""WITH {RUN}, {_NEXT}, pr AS (SELECT DISTINCT a, b FROM nb), b0 AS (SELECT a, b, term, tf AS m, 0 AS e FROM pr JOIN post ON entity_id=a UNION ALL SELECT a, b, term, 0, tf FROM pr JOIN post ON entity_id=b), bo AS (SELECT a, b, term, sum(m)::DOUBLE AS m, sum(e)::DOUBLE AS e FROM b0 GROUP BY ALL), l AS (SELECT a, b, sum(m) AS lm, sum(e) AS le FROM bo GROUP BY ALL),
j AS (SELECT bo.*, m/lm AS p, e/le AS q, (e+2000.0*coalesce(cf,1)/tokens)/(le+2000.0) AS s FROM bo JOIN l USING (a, b) LEFT JOIN stats USING (term), coll)
SELECT a, b, round(least(sum(CASE WHEN p>0 THEN p*ln(p/s) ELSE 0 END),100),5) AS kl, round(sum(m*e)/(sqrt(sum(m*m))*sqrt(sum(e*e))),6) AS cosine, round(sum(CASE WHEN m>0 AND e>0 THEN 1 ELSE 0 END)/count(*),6) AS jaccard FROM j GROUP BY ALL""")
def neighbor_similarity(spark, d):
    """Texts of each candidate and of the best entries of the next two mentions."""
    ix = views.kb_index(spark, d)
    pairs = _near(spark, d).select("a", "b").distinct()
    listed = pairs.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct()
    post = ix.postings.join(listed, "entity_id", "left_semi")
    both = similarity.sides(pairs, post.withColumnRenamed("entity_id", "a"), post.withColumnRenamed("entity_id", "b"), "a", "b")
    t = similarity.divergences(both, ix.stats.select("term", "cf"), ix.collection[0], "a", "b")
    return t.select("a", "b", F.round("kl", 5).alias("kl"), r6("cosine").alias("cosine"), r6("jaccard").alias("jaccard"))


@query(f"WITH {RUN} SELECT m.mention_id, CASE WHEN entity_id IS NULL OR entity_id%5=0 THEN NULL ELSE 'E'||entity_id END AS kb_id FROM ment m LEFT JOIN (SELECT * FROM run WHERE rank=1) r USING (mention_id)")
def result_predictions(spark, d):
    """The first id of each mention's best result, by an id map that has several for some entries and none for others."""
    e = F.col("entity_id")
    ids = views.kb(spark, d).select("entity_id", F.when(e % 5 == 0, "").otherwise(F.format_string("E%d,X%d", e, e)).alias("ids"))
    return evaluate.predictions(views.mentions(spark, d), run(spark, d), ids)


@query(f"WITH {_FEATURES}, s AS (SELECT mention_id, entity_id, rank AS old_rank, round(char_dice+word_dice,6) AS model_score FROM ft WHERE mention_id%2=1) SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY model_score DESC, old_rank) AS rank FROM s")
def stored_feature_rerank(spark, d):
    """Re-ranking from stored features: of the asked mentions (odd ids), by a semi-join."""
    def build():
        f = name_feature_rows(spark, d)
        return f.groupBy("mention_id").agg(F.collect_list(F.struct("entity_id", "rank", "score", "char_dice", "word_dice")).alias("candidates"))

    kept = views.kb_index(spark, d).keep("features", build)
    asked = views.mentions(spark, d).where("mention_id % 2 = 1")
    return rank.rerank(rank.stored(kept, asked), F.col("char_dice") + F.col("word_dice")).select("mention_id", "entity_id", "old_rank", "model_score", "rank")


@query(f"WITH {_FEATURES}, u AS (UNPIVOT (SELECT mention_id, entity_id, exact, first_letter, suffix FROM ft) ON exact, first_letter, suffix INTO NAME feature VALUE value) SELECT feature||'='||CASE WHEN value=1 THEN '1.0' ELSE '0.0' END AS name, count(*) AS n FROM u GROUP BY 1")
def binary_features(spark, d):
    """How often each value of the yes-or-no features occurs, by its one-hot name."""
    parts = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in ("exact", "first_letter", "suffix")))
    rows = name_feature_rows(spark, d).select(F.explode(parts).alias("p"))
    return rows.groupBy(rank.binary_names(F.col("p.feature"), F.col("p.value")).alias("name")).agg(F.count("*").alias("n"))


_PLAIN = r"regexp_replace(regexp_replace(x,'<[^>]*>',' ','g'),'\s+',' ','g')"


@query(rf"WITH p AS (SELECT page_id, unnest(regexp_extract_all(html,'<p>(.*?)</p>',1,'s')) AS x FROM pages) SELECT page_id, count(*) AS paragraphs, sum(length(trim({_PLAIN})))::BIGINT AS n FROM p GROUP BY 1")
def paragraph_lengths(spark, d):
    """Closed paragraphs of pages and the characters of their texts."""
    p = views.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))).alias("x"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("x", "<[^>]*>", " "), r"\s+", " "))
    return p.groupBy("page_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length(plain)).alias("n"))
