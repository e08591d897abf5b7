"""Readers: XML queries, NLP output, tables of ids, runs, judgements, gold standards.

Each returns a lazy DataFrame. Line formats are parsed by built-in expressions;
XML goes through Spark's reader, one row a tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions import text

_QUERY = "_id string, name string, docid string, enttype string, nodeid string, entity string"
_ANNOTATED = """mention array<struct<string:string, TokenBegin:int, TokenEnd:int, CharacterOffsetBegin:int, CharacterOffsetEnd:int, type:string>>,
    token array<struct<word:string>>, entitylink array<struct<mentionId:int, name:string, candidate:array<struct<id:string, rank:int, score:double>>>>,
    rawcandidate array<struct<id:string, rank:int, score:double>>"""
_NLP_SENTENCE = "_id int, tokens struct<token:array<struct<_id:int, word:string, lemma:string, POS:string, NER:string, CharacterOffsetBegin:int, CharacterOffsetEnd:int>>>, `basic-dependencies` struct<dep:array<struct<governor:struct<_idx:int>, dependent:struct<_idx:int>>>>"
_BRACKETS = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}"}


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(T._parse_datatype_string(schema)).load(path)


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), pattern).alias("f"), "value").where("trim(value) <> ''")


def mention_queries(spark: SparkSession, path: str, annotations: DataFrame | None = None) -> DataFrame:
    """mention_id, name, doc_id, type, node from query XML; the node from entity, nodeid, annotation, in that order."""
    q = _xml(spark, path, "query", _QUERY)
    if annotations is not None:
        q = q.join(annotations.select(F.col("mention_id").alias("_id"), F.col("node").alias("_node"), F.col("type").alias("_type")), "_id", "left")
    else:
        q = q.withColumns({"_node": F.lit(None).cast("string"), "_type": F.lit(None).cast("string")})
    return q.select(F.col("_id").alias("mention_id"), "name", F.col("docid").alias("doc_id"), F.coalesce("enttype", "_type", F.lit("")).alias("type"), F.coalesce("entity", "nodeid", "_node", F.lit("")).alias("node"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """mention_id, node, type from a tab-separated file."""
    return spark.read.csv(path, sep="\t", schema="mention_id string, node string, type string")


def query_sets(sets: dict[str, DataFrame], chosen: list[str] | None = None) -> DataFrame:
    """A union of named query sets, with the column ``set``."""
    out = None
    for name, df in sets.items():
        if chosen is None or name in chosen:
            named = df.withColumn("set", F.lit(name))
            out = named if out is None else out.unionByName(named)
    return out


def source_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, doc_type, text (headline, then body without poster and date) from SGML files, one document each."""
    d = spark.read.text(path, wholetext=True)
    one = lambda tag: F.regexp_extract("value", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    body = F.regexp_replace(F.regexp_replace(one("text"), r"(?is)<(poster|postdate)[^>]*>.*?</\1>", " "), "<[^>]*>", " ")
    joined = F.concat_ws(" ", F.when(one("headline") != "", F.trim(one("headline"))), F.trim(body))
    return d.select(F.trim(one("docid")).alias("doc_id"), F.regexp_extract("value", r'(?is)<doctype[^>]*source="([^"]*)"', 1).alias("doc_type"), F.regexp_replace(joined, r"\s+", " ").alias("text"))


def paragraph_text(html: Column) -> Column:
    """Texts of the paragraphs of HTML, markup removed; an unclosed paragraph ends where the next one begins."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|$)"), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " ")))


def paragraph_tokens(html: Column) -> Column:
    """Normalised words of the paragraphs of HTML."""
    return text.tokens(F.array_join(paragraph_text(html), " "))


def strict_paragraph_text(xhtml: Column) -> Column:
    """Texts of the paragraphs of well-formed XHTML; anything else is an error."""
    return F.transform(F.xpath(xhtml, F.lit("//p//text()")), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))


def plain_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (base name before the first dot), text of plain files; those that end in .gz are unpacked by Spark's reader."""
    d = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return d.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("doc_id"), F.col("value").alias("text"))


def exact_fields(line: Column, n: int, pattern: str = "\t") -> Column:
    """The fields of a line, or an error if they aren't ``n``."""
    f = F.split(line, pattern, -1)
    return F.when(F.size(f) == n, f).otherwise(F.raise_error(F.concat(F.lit(f"not {n} fields: "), line)).cast("array<string>"))


def features(spark: SparkSession, path: str, mentions: DataFrame) -> DataFrame:
    """Stored features (Parquet) of the asked mentions; those that were never stored are absent."""
    return spark.read.parquet(path).join(mentions.select("mention_id").distinct(), "mention_id", "left_semi")


def term_vector(x: Column) -> Column:
    return text.content_tokens(x)


def file_map(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (base name before the last dot), path, of all files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return f.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path")


def path_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="doc_id string, path string")


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """wiki_id, wiki_title (blanks to '_'), kb_title, kb_id, kb_type."""
    m = spark.read.csv(path, sep="\t", schema="wiki_id int, wiki_title string, kb_title string, kb_id string, kb_type string")
    return m.withColumn("wiki_title", F.replace("wiki_title", F.lit(" "), F.lit("_"))).withColumn("line", F.monotonically_increasing_id())


def lookup(df: DataFrame, ids: DataFrame, on: str, key: str, value: str, default=None, enabled: bool = True) -> DataFrame:
    """Adds ``value`` by ``df[on] = ids[key]``, the last line of a key; ``default`` where it is unknown, or everywhere if not enabled."""
    if not enabled:
        return df.withColumn(value, F.lit(default))
    last = ids.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, "line").alias(value))
    out = df.join(last, df[on] == last["_key"], "left").drop("_key")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def term_counts(spark: SparkSession, path: str) -> DataFrame:
    """term, cf, df with cf > 1."""
    return spark.read.csv(path, sep="\t", schema="term string, cf long, df long").where("cf > 1")


def _clean(word: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in _BRACKETS.items() for x in kv))[word], word)


def nlp_tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence, pos, word, lemma, tag, label, begin, end of NLP XML."""
    s = _xml(spark, path, "sentence", _NLP_SENTENCE).where("tokens is not null").select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("sentence"), F.explode("tokens.token").alias("t"))
    return s.select("file", "sentence", F.col("t._id").alias("pos"), _clean(F.col("t.word")).alias("word"), F.col("t.lemma").alias("lemma"), F.col("t.POS").alias("tag"), F.col("t.NER").alias("label"), F.col("t.CharacterOffsetBegin").alias("begin"), F.col("t.CharacterOffsetEnd").alias("end"))


def dependencies(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence, governor, dependent. Roots have no governor among the words; leaves govern nothing."""
    s = _xml(spark, path, "sentence", _NLP_SENTENCE).where("tokens is not null").select(F.col("_metadata.file_path").alias("file"), F.col("_id").alias("sentence"), F.explode("basic-dependencies.dep").alias("d"))
    return s.select("file", "sentence", F.col("d.governor._idx").alias("governor"), F.col("d.dependent._idx").alias("dependent"))


def vertices(edges: DataFrame) -> DataFrame:
    """file, sentence, idx, is_root, is_leaf of the words in dependency edges."""
    ends = edges.select("file", "sentence", F.col("governor").alias("idx"), F.lit(1).alias("g"), F.lit(0).alias("d")).union(edges.select("file", "sentence", "dependent", F.lit(0), F.lit(1)))
    return ends.groupBy("file", "sentence", "idx").agg((F.max("d") == 0).alias("is_root"), (F.max("g") == 0).alias("is_leaf"))


def coreference(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """file, chain, representative, sentence, first, last, words: mentions of coreference chains, their words by a range join."""
    # a row a file: the outer element of chains has the same name as a chain, so nested arrays are read as text
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract_all("value", F.lit(r"(?s)<coreference>\s*(<mention.*?)</coreference>"), F.lit(1)).alias("chains"))
    chain = raw.select("file", F.posexplode("chains").alias("chain", "body"))
    m = chain.select("file", "chain", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)(<mention.*?</mention>)"), F.lit(1))).alias("m"))
    num = lambda tag: F.regexp_extract("m", rf"<{tag}>\s*(\d+)\s*</{tag}>", 1).cast("int")
    m = m.select("file", "chain", F.contains(F.col("m"), F.lit('representative="true"')).alias("representative"), num("sentence").alias("sentence"), num("start").alias("first"), (num("end") - 1).alias("last"))
    t = tokens.select("file", "sentence", "pos", "word")
    j = m.join(t, ["file", "sentence"]).where("pos between first and last")
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return j.groupBy("file", "chain", "representative", "sentence", "first", "last").agg(words.alias("words"))


def ner_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, sentence, pos, word, cased, tag, label, begin, end from tab lines; a blank line ends a sentence, lines of another arity are skipped."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "row"))
    w = Window.partitionBy("file").orderBy("line")
    lines = lines.withColumn("sentence", F.sum(F.when(F.trim("row") == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    f = lines.withColumn("f", F.split("row", "\t", -1)).where(F.size("f") == 7)
    return f.select("file", "sentence", F.col("f")[0].cast("int").alias("pos"), F.col("f")[1].alias("word"), F.col("f")[2].alias("cased"), F.col("f")[3].alias("tag"), F.col("f")[4].alias("label"), F.col("f")[5].cast("int").alias("begin"), F.col("f")[6].cast("int").alias("end"))


def annotated(spark: SparkSession, path: str, most: int = 100) -> DataFrame:
    """file, tokens (text), mentions, links (at most ``most`` candidates each), raw candidates of annotated documents."""
    d = _xml(spark, path, "document", _ANNOTATED)
    links = F.transform("entitylink", lambda e: F.struct(e["mentionId"].alias("mention"), e["name"].alias("name"), F.slice(F.array_sort(e["candidate"], lambda a, b: a["rank"] - b["rank"]), 1, most).alias("candidates")))
    return d.select(F.col("_metadata.file_path").alias("file"), F.array_join("token.word", " ").alias("tokens"), F.col("mention").alias("mentions"), links.alias("links"), F.col("rawcandidate").alias("raw"))


def run_file(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """query, doc, rank, score, tag of the first ``most`` lines of each query; a line of another arity is an error."""
    f = _fields(spark, path)
    f = f.withColumn("f", F.when(F.size("f") == 6, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not six columns: "), "value")).cast("array<string>")))
    r = f.select(F.col("f")[0].alias("query"), F.col("f")[2].alias("doc"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("tag"))
    w = Window.partitionBy("query").orderBy("rank", "doc")
    return r.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path)
    return f.select(F.col("f")[0].alias("query"), F.col("f")[2].alias("doc"), F.col("f")[3].cast("int").alias("level"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """mention_id, kb_id, is_nil."""
    f = _fields(spark, path, "\t")
    return f.select(F.col("f")[0].alias("mention_id"), F.col("f")[1].alias("kb_id"), F.startswith(F.col("f")[1], F.lit("NIL")).alias("is_nil"))


def score_components(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path, "\t")
    return f.select(F.col("f")[0].alias("source"), F.col("f")[1].alias("query"), F.col("f")[2].alias("result"), F.col("f")[3].cast("double").alias("score"))


def domain_map(spark: SparkSession, path: str) -> dict[str, int]:
    """Feature name to id; the file has one line a feature of the code."""
    return {r[0]: int(r[1]) for r in spark.read.csv(path, sep="\t", schema="name string, id int").collect()}


def article_links(body: Column) -> Column:
    """array of (dest, anchor, par): links of an article's XML by paragraph or list; self and empty links are the caller's to drop.

    Texts are matched tag by tag, so a malformed body gives what it holds.
    """
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<(?:paragraph|list)[^>]*>(.*?)</(?:paragraph|list)>"), F.lit(1))

    def one(b: Column, i: Column) -> Column:
        links = F.regexp_extract_all(b, F.lit(r"(?s)(<link.*?</link>)"), F.lit(1))
        target = lambda x: F.trim(F.regexp_extract(x, r"(?s)<target>(.*?)</target>", 1))
        part = lambda x: F.trim(F.regexp_extract(x, r"(?s)<part>(.*?)</part>", 1))
        return F.transform(links, lambda x: F.struct(F.replace(target(x), F.lit(" "), F.lit("_")).alias("dest"), F.replace(F.when(part(x) != "", part(x)).otherwise(target(x)), F.lit(","), F.lit("_")).alias("anchor"), i.alias("par")))

    return F.array_distinct(F.filter(F.flatten(F.transform(blocks, one)), lambda x: (x["dest"] != "") & (x["anchor"] != "")))


def article_text(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)<text>(.*?)</text>", 1)
