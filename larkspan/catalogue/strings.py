"""Normalisation, string similarity, set measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.catalogue import LINKS, PAIRS, norm, query, r6, stops, toks
from larkspan.functions import edits, sets, text
from larkspan.operators import context
from larkspan.plans import views


def _sides():
    """The two columns of a pair; made in a query, as a column needs a session."""
    return F.col("a"), F.col("b")


def _chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x},''), lambda c: c<>''))"


def _ws(x: str) -> str:
    return f"list_filter(string_split({x},' '), lambda c: c<>'')"


def _dice(a: str, b: str) -> str:
    return f"(CASE WHEN len({a})+len({b})=0 THEN 0.0 ELSE 2.0*len(list_intersect({a},{b}))/(len({a})+len({b})) END)"


@query(f"SELECT doc_id, {norm('text')} AS norm, len(list_filter({toks('text')}, lambda w: w NOT IN {stops()}))::BIGINT AS n_terms FROM documents")
def normalize_text(spark, d):
    n = views.table(spark, d, "documents").select("doc_id", text.normalize("text").alias("norm"))
    # the normalised text is cut again at its blanks only
    return n.select("doc_id", "norm", F.size(F.filter(F.split("norm", " "), lambda w: (w != "") & ~text.is_stop(w))).cast("long").alias("n_terms"))


@query(f"""WITH {PAIRS} SELECT part_id, (a=b)::INT::DOUBLE AS exact, (a<>'' AND starts_with(a,left(b,2)))::INT::DOUBLE AS prefix, (a<>'' AND ends_with(a,right(b,3)))::INT::DOUBLE AS suffix,
(a<>'' AND b<>'' AND left(a,1)=left(b,1))::INT::DOUBLE AS first_letter, regexp_full_match(upper(replace(a,' ','')),'[A-Z]*')::INT::DOUBLE AS acronym_like,
round(CASE WHEN length(a)/10.0 < 0.01 THEN 0.0 ELSE 1+ln(length(a)/10.0) END,6) AS log_len FROM pairs""")
def string_match_flags(spark, d):
    A, B = _sides()
    p = views.name_pairs(spark, d)
    return p.select(
        "part_id", text.exact_match(A, B).alias("exact"), text.prefix_of(A, F.left(B, F.lit(2))).alias("prefix"), text.suffix_of(A, F.right(B, F.lit(3))).alias("suffix"),
        text.first_letter_match(A, B).alias("first_letter"), text.is_acronym(F.upper(F.replace(A, F.lit(" "), F.lit("")))).alias("acronym_like"), r6(text.log_tf(F.length(A) / 10.0)).alias("log_len"),
    )


@query(f"""WITH {PAIRS}, c AS (SELECT *, {_chars('a')} AS ca, {_chars('b')} AS cb, least(length(a),length(b)) AS n FROM pairs),
m AS (SELECT part_id, len(list_intersect(ca,cb)) AS i, len(ca) AS n1, len(cb) AS n2, {_dice(_chars('left(a,n)'), _chars('left(b,n)'))} AS ld, {_dice(_chars('right(a,n)'), _chars('right(b,n)'))} AS rd FROM c)
SELECT part_id, i::BIGINT AS intersect, (n1-i+n2-i)::BIGINT AS missing, round(CASE WHEN n1=0 OR n2=0 THEN 0 ELSE 1000.0*i/(n1*n2) END,6) AS approx_pmi,
round(CASE WHEN n1+n2=0 THEN 0 ELSE 2.0*i/(n1+n2) END,6) AS dice, round(CASE WHEN n1+n2-i=0 THEN 0 ELSE i/(n1+n2-i) END,6) AS jaccard, round(CASE WHEN n1=0 OR n2=0 OR i=0 THEN 0 ELSE i/sqrt(n1*n2) END,6) AS cosine,
round(ld,6) AS left_dice, round(rd,6) AS right_dice, round(greatest(ld,rd),6) AS max_dice FROM m""")
def char_set_similarity(spark, d):
    p = views.name_pairs(spark, d)
    A, B = _sides()
    left, right, most = text.aligned_dice_chars(A, B)
    m = sets.of_arrays(text.chars(A), text.chars(B))
    return p.select("part_id", *((c if k in ("intersect", "missing") else r6(c)).alias(k) for k, c in m.items()), r6(left).alias("left_dice"), r6(right).alias("right_dice"), r6(most).alias("max_dice"))


@query(f"""WITH {PAIRS}, w AS (SELECT part_id, {_ws('a')} AS x, {_ws('b')} AS y FROM (SELECT part_id, a||' '||a AS a, b||' steel' AS b FROM pairs)), n AS (SELECT *, least(len(x),len(y)) AS n, list_distinct(x) AS wa, list_distinct(y) AS wb FROM w),
m AS (SELECT part_id, wa, wb, {_dice('list_distinct(x[1:n])','list_distinct(y[1:n])')} AS ld, {_dice('list_distinct(x[len(x)-n+1:len(x)])','list_distinct(y[len(y)-n+1:len(y)])')} AS rd FROM n)
SELECT part_id, len(list_intersect(wa,wb))::BIGINT AS intersect, (len(wa)+len(wb)-2*len(list_intersect(wa,wb)))::BIGINT AS missing, round({_dice('wa','wb')},6) AS dice, round(ld,6) AS left_dice, round(rd,6) AS right_dice, round(greatest(ld,rd),6) AS max_dice FROM m""")
def word_set_similarity(spark, d):
    A, B = _sides()
    p = views.name_pairs(spark, d).select("part_id", F.concat_ws(" ", "a", "a").alias("a"), F.concat(B, F.lit(" steel")).alias("b"))
    left, right, most = text.aligned_dice_words(A, B)
    m = sets.of_arrays(text.words(A), text.words(B))
    return p.select("part_id", m["intersect"].alias("intersect"), m["missing"].alias("missing"), r6(m["dice"]).alias("dice"), r6(left).alias("left_dice"), r6(right).alias("right_dice"), r6(most).alias("max_dice"))


@query(f"WITH {PAIRS} SELECT DISTINCT a, b, levenshtein(a,b)::BIGINT AS levenshtein, damerau_levenshtein(a,b)::BIGINT AS damerau FROM pairs")
def edit_distance(spark, d):
    p = views.name_pairs(spark, d).select("a", "b").distinct()
    return p.select("a", "b", F.levenshtein("a", "b").cast("long").alias("levenshtein"), edits.damerau_distance("a", "b").alias("damerau"))


@query(f"WITH {PAIRS} SELECT DISTINCT a, b, round(1-jaro_winkler_similarity(a,b),6) AS distance FROM pairs")
def jaro_winkler(spark, d):
    return views.name_pairs(spark, d).select("a", "b").distinct().select("a", "b", r6(edits.jaro_winkler_distance("a", "b")).alias("distance"))


@query(f"""WITH t AS (SELECT item_id, list_filter({toks('text')}, lambda w: w NOT IN {stops()})[1:4] AS w FROM benchmark), s AS (SELECT item_id, array_to_string(list_transform(w, lambda x: left(x,1)),'') AS acronym, array_to_string(w,' ') AS long FROM t)
SELECT item_id, acronym, (acronym<>'' AND acronym = array_to_string(list_transform(list_filter(string_split(long,' '), lambda w: w<>'' AND w NOT IN {stops()}), lambda x: left(x,1)),''))::INT::DOUBLE AS matches, 1.0::DOUBLE AS capital FROM s""")
def acronym_test(spark, d):
    b = views.table(spark, d, "benchmark").select("item_id", F.slice(text.content_tokens("text"), 1, 4).alias("w"))
    b = b.select("item_id", F.array_join("w", " ").alias("long"))
    acronym = text.acronym(F.col("long"))
    return b.select("item_id", acronym.alias("acronym"), text.acronym_match(F.upper(acronym), F.col("long")).alias("matches"), text.is_acronym(F.upper(F.regexp_replace(acronym, "[0-9]", ""))).alias("capital"))


def _strip(x: str) -> str:
    """Pieces at which as many parentheses have opened as closed."""
    return rf"""(SELECT coalesce(string_agg(p, '' ORDER BY i), '') FROM (SELECT i, p, sum(CASE p WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (ORDER BY i) + (CASE p WHEN ')' THEN 1 ELSE 0 END) AS depth FROM
(SELECT unnest(range(1,len(l)+1)) AS i, unnest(l) AS p FROM (SELECT regexp_extract_all({x},'[^()]+|[()]') AS l))) WHERE depth=0)"""


@query(f"SELECT doc_id, sha256(s) AS stripped, length(s)::BIGINT AS n FROM (SELECT doc_id, {_strip('text')} AS s FROM documents WHERE contains(text,'('))")
def strip_parentheses(spark, d):
    s = text.strip_parentheses(F.col("text"))
    return views.table(spark, d, "documents").where(F.contains("text", F.lit("("))).select("doc_id", F.sha2(s, 256).alias("stripped"), F.length(s).cast("long").alias("n"))


@query(rf"""WITH t AS (SELECT page_id, regexp_extract(html,'<title>([^<]*)</title>',1) AS title FROM pages), n AS (SELECT *, replace(title,'_',' ') AS r FROM t) SELECT page_id, regexp_matches(title,'^(Category:|File:|List of )') AS ignored,
regexp_matches(lower(title),'{"|".join(text.SPAM_WORDS)}') AS spam, {_strip('r')} AS name FROM n""")
def title_filters(spark, d):
    p = views.table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", text.ignored_title(F.col("title")).alias("ignored"), text.spam_anchor(F.col("title")).alias("spam"), text.title_to_name(F.col("title")).alias("name"))


@query(r"""WITH s AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text,'.'), lambda x: trim(x)), lambda x: x<>''), lambda x: x||'.') AS s, regexp_replace(text,'[^A-Za-z0-9]',' ','g') AS c FROM documents)
SELECT doc_id, len(s)::BIGINT AS n, coalesce(s[1],'') AS first, sha256(c) AS cleaned FROM s""")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return views.table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.coalesce(F.try_element_at(s, F.lit(1)), F.lit("")).alias("first"), F.sha2(text.clean_text(F.col("text")), 256).alias("cleaned"))


@query("""WITH s AS (SELECT doc_id, string_split(text,'the') AS p FROM documents), l AS (SELECT doc_id, list_transform(p, lambda x: length(x)) AS l FROM s WHERE len(p)>1)
SELECT doc_id, (len(l)-1)::BIGINT AS n, l[1]::BIGINT AS first_at, (list_sum(l[1:len(l)-1])+3*(len(l)-2))::BIGINT AS last_at FROM l""")
def string_occurrences(spark, d):
    o = context.occurrences(views.table(spark, d, "documents"), "doc_id", "text", "the")
    return o.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("begin").alias("first_at"), F.max("begin").alias("last_at"))


@query(r"SELECT page_id, left(regexp_replace(regexp_replace(url,'[^A-Za-z0-9._-]','_','g'),'^[.-]','_'),255) AS name FROM pages")
def safe_file_names(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


_MEASURES = """SELECT {key}, i::BIGINT AS intersect, (n1-i+n2-i)::BIGINT AS missing, round(CASE WHEN n1=0 OR n2=0 THEN 0 ELSE 1000.0*i/(n1*n2) END,6) AS approx_pmi,
round(CASE WHEN n1+n2=0 THEN 0 ELSE 2.0*i/(n1+n2) END,6) AS dice, round(CASE WHEN n1+n2-i=0 THEN 0 ELSE i/(n1+n2-i) END,6) AS jaccard, round(CASE WHEN n1=0 OR n2=0 OR i=0 THEN 0 ELSE i/sqrt(n1*n2) END,6) AS cosine,
round(CASE WHEN n1=0 OR n2=0 THEN 0 ELSE (i/N)/((n1/N)*(n2/N)) END,6) AS pmi, round(CASE WHEN n1=0 OR n2=0 OR i=0 OR ln(N)-ln(least(n1,n2))=0 THEN 0 ELSE 1-(ln(greatest(n1,n2))-ln(i))/(ln(N)-ln(least(n1,n2))) END,6) AS google FROM m"""


def _measures(counted, key: str, total: float):
    c = [F.col(x) for x in ("i", "n1", "n2")]
    return counted.select(key, *((x if k in ("intersect", "missing") else r6(x)).alias(k) for k, x in sets.measures(*c, F.lit(total)).items()))


@query(f"""WITH s AS (SELECT DISTINCT o.o_custkey AS c, p.p_brand AS e FROM lineitem l JOIN orders o ON o.o_orderkey=l.l_orderkey JOIN part p ON p.p_partkey=l.l_partkey),
sz AS (SELECT c, count(*) AS n FROM s GROUP BY c), b AS (SELECT x.c, count(*) AS i FROM s x JOIN s y ON y.c=x.c+1 AND x.e=y.e GROUP BY 1),
m AS (SELECT k.c_custkey AS customer, coalesce(b.i,0) AS i, coalesce(s1.n,0) AS n1, coalesce(s2.n,0) AS n2, 1000.0 AS N FROM customer k LEFT JOIN b ON b.c=k.c_custkey LEFT JOIN sz s1 ON s1.c=k.c_custkey LEFT JOIN sz s2 ON s2.c=k.c_custkey+1) {_MEASURES.format(key='customer')}""")
def set_measures_basket(spark, d):
    pairs = views.table(spark, d, "customer").select(F.col("c_custkey").alias("customer"), (F.col("c_custkey") + 1).alias("other"))
    counted = sets.of_rows(views.baskets(spark, d).withColumnRenamed("customer", "k"), pairs, "k", "brand", "customer", "other")
    return _measures(counted, "customer", 1000.0)


_LINK_SETS = r"""s AS (SELECT DISTINCT page_id AS c, dest AS e FROM lk), sz AS (SELECT c, count(*) AS n FROM s GROUP BY c), b AS (SELECT x.c, count(*) AS i FROM s x JOIN s y ON y.c=x.c+1 AND x.e=y.e GROUP BY 1),
m AS (SELECT k.page_id, coalesce(b.i,0) AS i, coalesce(s1.n,0) AS n1, coalesce(s2.n,0) AS n2, 10000.0 AS N FROM pages k LEFT JOIN b ON b.c=k.page_id LEFT JOIN sz s1 ON s1.c=k.page_id LEFT JOIN sz s2 ON s2.c=k.page_id+1)"""


@query(f"WITH {LINKS}, {_LINK_SETS} {_MEASURES.format(key='page_id')}")
def ngd_pmi_links(spark, d):
    pairs = views.table(spark, d, "pages").select("page_id", (F.col("page_id") + 1).alias("other"))
    own = views.links(spark, d).select(F.col("page_id").alias("k"), "dest").distinct()
    return _measures(sets.of_rows(own, pairs, "k", "dest", "page_id", "other"), "page_id", 10000.0)
