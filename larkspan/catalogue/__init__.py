"""Registered queries by subject. Each has a builder and the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, str], DataFrame]
BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(f: Builder) -> Builder:
        BUILDERS[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str) -> Column:
    """Rounded to six digits, so that the order of additions doesn't show; no negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


# --- pieces of SQL -----------------------------------------------------------


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}),'[^a-z0-9 ]',' ','g'),'\s+',' ','g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)},' '), lambda w: w <> '')"


def stops() -> str:
    from larkspan.functions.text import STOP_WORDS

    return "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"


KB = f"kb0 AS (SELECT doc_id AS entity_id, lang, source, {toks('text')} AS terms FROM documents), kb AS (SELECT *, array_to_string(terms[1:3],' ') AS title FROM kb0)"
POST = "post AS (SELECT entity_id, term, count(*) AS tf FROM (SELECT entity_id, unnest(terms) AS term FROM kb) GROUP BY ALL), stats AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM post GROUP BY term), lens AS (SELECT entity_id, len(terms) AS len FROM kb), coll AS (SELECT sum(len)::DOUBLE AS tokens, count(*)::DOUBLE AS docs FROM lens)"
MENTION = f"ment0 AS (SELECT item_id AS mention_id, text AS full_text, {toks('text')} AS terms FROM benchmark), ment AS (SELECT *, array_to_string(terms[1:3],' ') AS name FROM ment0)"
QREL = "qrel AS (SELECT DISTINCT b.item_id AS mention_id, d.doc_id AS entity_id FROM benchmark b, documents d WHERE contains(d.text, left(b.text, 60)) AND len(string_split(left(b.text,60),' ')) >= 5)"
MU = 2000.0


def dirichlet_sql(queries: str, mu: float = MU, name: str = "scored") -> str:
    """CTEs that score the query rows (mention_id, term, weight) of a CTE."""
    return f"""{name}_k AS (SELECT q.*, s.cf/c.tokens AS p FROM {queries} q JOIN stats s USING (term), coll c),
{name}_b AS (SELECT mention_id, sum(weight*ln(p)) AS base, sum(weight) AS total FROM {name}_k GROUP BY 1),
{name} AS (SELECT m.mention_id, m.entity_id, round(m.own + b.base + b.total*ln({mu}/(l.len+{mu})),6) AS score
 FROM (SELECT k.mention_id, p.entity_id, sum(k.weight*ln(1+p.tf/({mu}*k.p))) AS own FROM post p JOIN {name}_k k USING (term) GROUP BY ALL) m JOIN {name}_b b USING (mention_id) JOIN lens l USING (entity_id))"""


def top_sql(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS rank FROM {source}) WHERE rank <= {k})"


NAME_QUERY = "nq AS (SELECT mention_id, term, count(*)/any_value(n) AS weight FROM (SELECT mention_id, unnest(terms[1:3]) AS term, len(terms[1:3]) AS n FROM ment) GROUP BY ALL)"
#: The run that most later stages start from: ten best entries by the mention's name.
RUN = f"{KB}, {POST}, {MENTION}, {NAME_QUERY}, {dirichlet_sql('nq')}, {top_sql('run', 'scored', 10)}"
LINKS = r"""lk0 AS (SELECT page_id, regexp_extract_all(html,'<a href="/([^"]*)">([^<]*)</a>',1) AS d, regexp_extract_all(html,'<a href="/([^"]*)">([^<]*)</a>',2) AS a FROM pages),
lk AS (SELECT * FROM (SELECT page_id, i-1 AS pos, replace(d[i],' ','_') AS dest, replace(a[i],',','_') AS anchor FROM (SELECT page_id, d, a, unnest(range(1,len(d)+1)) AS i FROM lk0)) WHERE dest<>'' AND anchor<>'')"""
PAIRS = "pairs AS (SELECT a.p_partkey AS part_id, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey+1)"
