"""Named queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.functions import text as fx
from folium.operators import annotate, corpora, details, index, layout, lexicon, lsa, search
from folium.plans.query import Query
from folium.session import new_folder
from folium.sources import bib

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_R = "[ \\n\\t''\\\\/()\\[\\]{}:.;,!?]"
_T = "[.;,!?] |[ \\n\\t''\"/\u2014()\\[\\]{}:]"
_STOP = ", ".join(f"'{w}'" for w in fx.DEFAULT_STOP_WORDS)


def _terms_sql(source: str, text: str = "text", more: str = "") -> str:
    """Analyzed terms ``t`` and, with null for stop words, their places ``p``."""
    found = f"list_transform(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+(?:[''.][\\p{{L}}\\p{{N}}]+)*'), lambda x: CASE WHEN x IN ({_STOP}) OR length(x) > 255 THEN NULL ELSE x END)"
    return f"(SELECT *, list_filter(p, lambda x: x IS NOT NULL) AS t FROM (SELECT *{more}, {found} AS p FROM {source}))"


_FIELDS = ", 'A' || (doc_id % 7) || ' ' || source AS author, source || ' Letters ' || (doc_id % 5) AS journal, CASE doc_id % 3 WHEN 0 THEN 'review' ELSE 'research-article' END AS type"
_WORDS = f"w AS (SELECT doc_id, lang, source, author, journal, type, p, t FROM {_terms_sql('documents', more=_FIELDS)})"
_SPREAD = f"s AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{_R}')) AS word FROM documents)"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang", "source").alias("corpora"))


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with bibliographic fields made from their numbers; an order's date gives the year."""
    years = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM").alias("year"))
    number = lambda n: (F.col("doc_id") % n).cast("string")
    fields = {
        "corpora": F.array("lang", "source"),
        "author": F.concat(F.lit("A"), number(7), F.lit(" "), F.col("source")),
        "journal": F.concat(F.col("source"), F.lit(" Letters "), number(5)),
        "type": F.when(F.col("doc_id") % 3 == 0, "review").otherwise("research-article"),
        "accession": F.concat(F.lit(" PMID:"), F.col("doc_id").cast("string"), F.lit(" WBPaper"), (F.col("doc_id") * 3).cast("string")),
    }
    return _t(spark, sf_dir, "documents").select("doc_id", "text", *(c.alias(n) for n, c in fields.items())).join(years, "doc_id", "left")


def _collection(spark: SparkSession, sf_dir: str, mode: str = "ci", kind: str = "document") -> index.Collection:
    """The stored index of a folder's documents in a case mode, built by the first query of a session that needs it; a
    kind of search that no query asked for costs nothing."""
    known = spark.sparkContext.__dict__.setdefault("_folium_collections", {})
    if (sf_dir, mode) not in known:
        made = index.Collection(spark, new_folder(spark, "collection"), modes=[mode], kinds=[kind])
        made.build(_papers(spark, sf_dir))
        known[sf_dir, mode] = made
    known[sf_dir, mode].extend(kind)
    return known[sf_dir, mode]


# --- words and text -------------------------------------------------------------------------------------------------


@query(f"WITH {_SPREAD} SELECT doc_id, word, count(*) AS tf FROM s WHERE word <> '' GROUP BY doc_id, word")
def word_split_counts(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(fx.terms(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


_F1 = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<.+?>', '', 'gs'), '</.+?>', '', 'gs'), '(?m)<_pdf[^>]+$', '', 'g'), '(?m)^[^ \\t]+/>', '', 'g')"


@query(f"SELECT page_id, md5({_F1}) AS h FROM pages")
def strip_tags(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(fx.strip_tags(F.col("html"))).alias("h"))


@query(f"SELECT page_id, md5(regexp_replace(regexp_replace({_F1}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS h FROM pages")
def strip_tags_newlines(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(fx.collapse_space(fx.strip_tags(F.col("html")))).alias("h"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(html, '<.+?>', '', 'gs'), '</.+?>', '', 'gs')) AS h, length(regexp_replace(html, '<_pdf.+?/>', '', 'gs')) AS n FROM pages")
def strip_simple_tags(spark, sf_dir):
    h = F.col("html")
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(fx.strip_simple_tags(h)).alias("h"), F.length(fx.strip_layout_tags(h)).cast("long").alias("n"))


@query("SELECT page_id, md5(regexp_replace(html, '[^\\x09-\\x0d\\x20-\\x7e]', ' ', 'g')) AS plain, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def printable_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.md5(fx.printable(F.col("html"))).alias("plain"), fx.file_name(F.col("url")).alias("name"))


@query("SELECT page_id, coalesce(regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS n_links, array_to_string(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), ' ') AS links FROM pages")
def xml_field_extract(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


@query("SELECT page_id, k - 1 AS ord, '' AS content, md5(terms[k]) AS h FROM (SELECT page_id, terms, unnest(range(1, len(terms) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<h1>(.*?)</h1\\s*>', 1, 's') AS terms FROM pages))")
def xml_elements(spark, sf_dir):
    return annotate.xml_elements(_t(spark, sf_dir, "pages"), "h1", "page_id", "html").select("page_id", F.col("ord").cast("long").alias("ord"), "content", F.md5("term").alias("h"))


# --- boundaries ----------------------------------------------------------------------------------------------------

_KEEP = "'([(>\\s](?:[A-Z]|Dr|[Ee]x|[Nn]o|[Vv]s|al|ca|[Ff]ig|[Vv]ol|i\\.e|e\\.g))\\.([\\n\\t <])'"
_MARKED = f"regexp_replace(regexp_replace(text, {_KEEP}, '\\1' || chr(1) || '\\2', 'g'), {_KEEP}, '\\1' || chr(1) || '\\2', 'g')"
_SENTENCES = f"""p AS (SELECT doc_id, regexp_split_to_array({_MARKED}, '[.!?][\\n\\t <]') AS a FROM documents),
q AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS x FROM p),
o AS (SELECT doc_id, k, x, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY k) - 2 AS stop FROM q),
sent AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS sentence_id, CAST(stop - length(x) AS INTEGER) AS "begin", CAST(stop AS INTEGER) AS "end", replace(x, chr(1), '.') AS sentence FROM o WHERE x <> '')"""


@query(f"WITH {_SENTENCES} SELECT * FROM sent")
def sentence_split(spark, sf_dir):
    return annotate.sentences(_t(spark, sf_dir, "documents"))


@query(f"WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_T}') AS a FROM documents), q AS (SELECT doc_id, unnest(a[:-2]) AS content FROM p) SELECT doc_id, content, count(*) AS n FROM q WHERE content <> '' GROUP BY ALL")
def token_counts_raw(spark, sf_dir):
    return annotate.token_spans(_t(spark, sf_dir, "documents"), delimiters=False).groupBy("doc_id", "content").agg(F.count("*").alias("n"))


@query(f"WITH q AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '{_R}') AS a FROM documents)), o AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS stop FROM q) SELECT doc_id, count(*) AS n, CAST(sum(stop - length(word)) AS BIGINT) AS begins, CAST(sum(stop) AS BIGINT) AS ends FROM o WHERE word <> '' GROUP BY doc_id")
def word_offsets(spark, sf_dir):
    return annotate.word_positions(_t(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("begin").alias("begins"), F.sum("end").alias("ends"))


# --- search --------------------------------------------------------------------------------------------------------


def _tf(word: str, t: str = "t") -> str:
    return f"len(list_filter({t}, lambda x: x = '{word}'))"


def _search_sql(leaves: dict[str, str], where: str, scored: list[str], units: str = "w", restrict: str = "lang = 'en'", extra: str = "", more: str = "") -> str:
    tfs = ", ".join(f"{sql} AS {n}" for n, sql in leaves.items())
    dfs = ", ".join(f"count(*) FILTER ({n} > 0) AS df_{n}" for n in scored)
    score = " + ".join(f"CASE WHEN {n} > 0 THEN sqrt({n}::DOUBLE) * pow(1 + ln(nn / (df_{n} + 1)::DOUBLE), 2) / sqrt(l::DOUBLE) ELSE 0 END" for n in scored) or "0"
    return f"WITH {_WORDS}{extra}, c AS (SELECT *, len(t) AS l, {tfs} FROM {units}), f AS (SELECT count(*)::DOUBLE AS nn, {dfs} FROM c), h AS (SELECT c.*, {score}{more} AS score FROM c, f WHERE {restrict} AND ({where})) "


_DOC = "SELECT doc_id AS identifier, round(score, 6) AS score FROM h"


def _hits(q: Query, spark, sf_dir, **kw) -> DataFrame:
    mode = index.CASE_MODES[q.case_sensitive]
    return search.search(q, collection=_collection(spark, sf_dir, mode), **kw).select("identifier", _r("score").alias("score"))


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"]) + _DOC)
def doc_search_tfidf(spark, sf_dir):
    return _hits(Query(keyword="er ing", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"]) + _DOC)
def doc_search_without_index(spark, sf_dir):
    """The same search over plain texts."""
    return search.search(Query(keyword="er the ing", corpora=["en"]), _docs(spark, sf_dir)).select("identifier", _r("score").alias("score"))


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 AND b > 0", ["a", "b"]) + _DOC)
def doc_search_and(spark, sf_dir):
    return _hits(Query(keyword="er AND ing", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("ing"), "b": _tf("tion"), "d": _tf("der")}, "a > 0 OR b > 0 OR d > 0", ["a", "b", "d"], restrict="(lang = 'en' OR lang = 'de')") + _DOC)
def doc_search_or(spark, sf_dir):
    return _hits(Query(keyword="ing OR tion OR der", corpora=["en", "de"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 AND b = 0", ["a"]) + _DOC)
def doc_search_not(spark, sf_dir):
    return _hits(Query(keyword="er -ing", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 AND b = 0", ["a"]) + _DOC)
def doc_search_exclude(spark, sf_dir):
    return _hits(Query(keyword="er", exclude_keyword="ing", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er")}, "a = 0", []) + "SELECT doc_id AS identifier, 1.0::DOUBLE AS score FROM h")
def doc_search_exclude_only(spark, sf_dir):
    return _hits(Query(exclude_keyword="er", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er")}, "a > 0", ["a"]) + _DOC)
def doc_search_stop_words(spark, sf_dir):
    """Stop words are neither found nor excluded: their clauses vanish."""
    return _hits(Query(keyword="the AND er -with", corpora=["en"]), spark, sf_dir)


def _phrase_sql(*places: tuple[int, str]) -> str:
    return f"len(list_filter(range(1, len(p) - {places[-1][0]} + 1), lambda i: " + " AND ".join(f"coalesce(p[i + {k}] = '{w}', false)" for k, w in places) + "))"


@query(_search_sql({"a": _phrase_sql((0, "anea"), (1, "eriner"))}, "a > 0", ["a"]) + _DOC)
def doc_search_phrase(spark, sf_dir):
    return _hits(Query(keyword='"anea eriner"', corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _phrase_sql((0, "attion"), (2, "thanedble"))}, "a > 0", ["a"]) + _DOC)
def doc_search_phrase_with_stop_word(spark, sf_dir):
    return _hits(Query(keyword='"attion to thanedble"', corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": "len(list_filter(t, lambda x: regexp_full_match(x, 'thing.*')))", "b": _tf("er")}, "a > 0 AND b > 0", ["b"], more=" + 1") + _DOC)
def doc_search_wildcard(spark, sf_dir):
    return _hits(Query(keyword="thing* AND er", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("er"), "b": _tf("ing"), "d": _tf("tion")}, "a > 0 AND (b > 0 OR d > 0)", ["a", "b", "d"], more="") + _DOC)
def doc_search_grouped(spark, sf_dir):
    return _hits(Query(keyword="er AND (ing OR tion)", corpora=["en"]), spark, sf_dir)


@query(_search_sql({"a": _tf("Er"), "b": _tf("The")}, "a > 0 OR b > 0", ["a", "b"]).replace("lower(text)", "text") + _DOC)
def doc_search_case_sensitive(spark, sf_dir):
    return _hits(Query(keyword="Er The the", corpora=["en"], case_sensitive=True), spark, sf_dir)


@query(_search_sql({"a": _tf("er")}, "a > 0", ["a"], restrict="lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)") + _DOC)
def doc_search_by_ids(spark, sf_dir):
    return _hits(Query(keyword="er", corpora=["en"]), spark, sf_dir, doc_ids=_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


_DATED = "doc_id IN (SELECT o_orderkey FROM orders WHERE {})"
for _name, _ask, _where in (
    ("year", {"year": "1996"}, _DATED.format("year(o_orderdate) = 1996")),
    ("month", {"year": '"1996-01"'}, _DATED.format("strftime(o_orderdate, '%Y-%m') = '1996-01'")),
    ("accession", {"accession": "WBPaper36 17 wbpaper9 nothing"}, "doc_id IN (12, 17, 3)"),
    ("type", {"paper_type": "review"}, "type = 'review'"),
    ("author", {"author": "a3 OR a5"}, "doc_id % 7 IN (3, 5)"),
    ("exact_author", {"author": '"a3 src3"', "exact_author": True}, "author = 'A3 src3'"),
    ("journal", {"journal": "letters AND 2"}, "doc_id % 5 = 2"),
    ("exact_journal", {"journal": "Src7 Letters 2", "exact_journal": True}, "journal = 'src7 Letters 2'"),
):

    def _by_field(spark, sf_dir, ask=_ask):
        return _hits(Query(keyword="er", corpora=["en"], **ask), spark, sf_dir)

    _by_field.__name__ = f"doc_search_{_name}"
    query(_search_sql({"a": _tf("er")}, "a > 0", ["a"], restrict=f"lang = 'en' AND {_where}") + _DOC)(_by_field)


@query(_search_sql({"a": _tf("er")}, "a > 0", ["a"]) + "SELECT doc_id AS identifier, round(score, 6) AS score, strftime(o_orderdate, '%Y-%m') AS year, row_number() OVER (ORDER BY strftime(o_orderdate, '%Y-%m') DESC NULLS LAST, round(score, 9) DESC, doc_id) AS place FROM h LEFT JOIN orders ON o_orderkey = doc_id")
def doc_search_by_year_sort(spark, sf_dir):
    hits = search.search(Query(keyword="er", corpora=["en"], sort_by_year=True), collection=_collection(spark, sf_dir))
    # the place is shown to compare orders; a column of it needs the rows in one order
    return index.with_ids(hits.withColumn("y", F.coalesce("year", F.lit(""))).withColumn("ny", F.expr("translate(y, '0123456789', '9876543210')")).withColumn("ny", F.when(F.col("year").isNull(), F.lit("~")).otherwise(F.col("ny"))).withColumn("ns", -F.round("score", 9)), ["ny", "ns", "identifier"], 1).select("identifier", _r("score").alias("score"), "year", F.col("id").alias("place"))


_SENT_UNITS = f", {_SENTENCES}, u AS (SELECT doc_id, sentence_id, lang, p, t FROM {_terms_sql('(SELECT sent.*, lang FROM sent JOIN documents USING (doc_id))', 'sentence')})"
_SENT_SQL = _search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"], "u", extra=_SENT_UNITS)


def _sentence_query() -> Query:
    return Query(kind="sentence", keyword="er ing", corpora=["en"])


@query(_SENT_SQL + "SELECT doc_id AS identifier, round(sum(score), 6) AS score, count(*) AS n_sentences, min(sentence_id) AS first_sentence FROM h GROUP BY doc_id")
def sentence_search_grouped(spark, sf_dir):
    h = search.search(_sentence_query(), collection=_collection(spark, sf_dir, kind="sentence"))
    return h.select("identifier", _r("score").alias("score"), F.size("matching_sentences").cast("long").alias("n_sentences"), F.array_min(F.transform("matching_sentences", lambda s: s["sentence_id"])).alias("first_sentence"))


@query(_SENT_SQL + ", g AS (SELECT doc_id, sum(score) AS score, count(*) AS n FROM h GROUP BY doc_id) SELECT count(*) AS n_hits, CAST(sum(n) AS BIGINT) AS n_sentences, round(max(score), 6) AS max_score, round(min(score), 6) AS min_score FROM g")
def score_bounds(spark, sf_dir):
    s = search.summary(search.search(_sentence_query(), collection=_collection(spark, sf_dir, kind="sentence")))
    return s.select("n_hits", "n_sentences", _r("max_score").alias("max_score"), _r("min_score").alias("min_score"))


@query(_search_sql({"a": _tf("er")}, "a > 0", ["a"]) + "SELECT h.doc_id, round(score, 6) AS score, d.source AS journal, '2020' AS year, md5(regexp_replace(regexp_replace(" + _F1.replace("html", "text") + ", '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS text FROM h JOIN documents d USING (doc_id)")
def doc_details(spark, sf_dir):
    h = search.search(Query(keyword="er", corpora=["en"]), collection=_collection(spark, sf_dir))
    d = _t(spark, sf_dir, "documents").withColumnRenamed("source", "journal").withColumn("year", F.lit("2020"))
    return details.details(h, d, include=["text", "journal"], exclude=["abstract"], remove_tags=True, remove_newlines=True).select("doc_id", _r("score").alias("score"), "journal", "year", F.md5("text").alias("text"))


@query(_SENT_SQL + "SELECT h.doc_id, h.sentence_id, round(score, 6) AS score, sentence, \"begin\", \"end\" FROM h JOIN sent USING (doc_id, sentence_id)")
def doc_details_with_sentences(spark, sf_dir):
    stored = _collection(spark, sf_dir, kind="sentence")
    docs, rows = stored.docs(), stored.sentences()
    out = details.details(search.search(_sentence_query(), collection=stored), docs, rows, include=["corpora"])
    return out.select("doc_id", F.explode("matching").alias("m")).select("doc_id", "m.sentence_id", _r("m.score").alias("score"), "m.sentence", "m.begin", "m.end")


@query(_SENT_SQL + "SELECT doc_id, count(*) AS n, CAST(sum(\"end\" - \"begin\") AS BIGINT) AS chars, md5(string_agg(sentence, '|' ORDER BY sentence_id)) AS h FROM sent WHERE doc_id IN (SELECT doc_id FROM h) GROUP BY doc_id")
def doc_all_sentences(spark, sf_dir):
    stored = _collection(spark, sf_dir, kind="sentence")
    docs, rows = stored.docs(), stored.sentences()
    # which of them match isn't shown, so they aren't joined a second time
    out = details.details(search.search(_sentence_query(), collection=stored).drop("matching_sentences"), docs, rows, include=["corpora"], all_sentences=True)
    a = F.col("all_sentences")
    return out.select("doc_id", F.size(a).cast("long").alias("n"), F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]).alias("chars"), F.md5(F.array_join(F.transform(a, lambda x: x["sentence"]), "|")).alias("h"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def field_projection(spark, sf_dir):
    return details.project(_t(spark, sf_dir, "documents"), ["lang", "n_chars", "text"], ["text"], ["doc_id"])


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"], restrict="true") + "SELECT doc_id AS identifier, round(score, 6) AS score, 'main' AS document_type FROM h UNION ALL SELECT conv_id * 1000 + turn, round(score, 6), 'external' FROM h2")
def union_external(spark, sf_dir):
    one = _docs(spark, sf_dir).withColumn("corpora", F.array(F.lit("all")))
    two = _t(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.array(F.lit("all")).alias("corpora"))
    return search.federated(Query(keyword="er ing", corpora=["all"]), one, two).select("identifier", _r("score").alias("score"), "document_type")


_SECOND = _search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"], "w2", "true").split(", c AS", 1)[1]
ORACLES["union_external"] = ORACLES["union_external"].replace(
    "SELECT doc_id AS identifier", f", w2 AS (SELECT conv_id, turn, t FROM {_terms_sql('conversations')}), c2 AS" + _SECOND.replace(" FROM c)", " FROM c2)").replace("f AS (", "f2 AS (").replace("h AS (SELECT c.*", "h2 AS (SELECT c2.*").replace("FROM c, f ", "FROM c2, f2 ").rstrip() + " SELECT doc_id AS identifier", 1
)


@query(f"WITH {_WORDS}, p AS (SELECT unnest(t) AS term, doc_id FROM w), n AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY term) SELECT term, df, tf FROM n")
def postings_stats(spark, sf_dir):
    post = index.postings(_docs(spark, sf_dir))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(_search_sql({"a": _tf("thing"), "b": _tf("thble")}, "a > 0 OR b > 0", ["a", "b"], restrict="true") + "SELECT doc_id, round(score, 6) AS score FROM h")
def index_search(spark, sf_dir):
    q = Query(keyword="thing thble", corpora=["en", "de", "fr", "es"])
    return search.search(q, collection=_collection(spark, sf_dir)).select(F.col("identifier").alias("doc_id"), _r("score").alias("score"))


def _changed_collection(spark, sf_dir, kind: str, modes: list[str]) -> index.Collection:
    """A collection of its own that lost the toxic documents and got the benchmark's passages, some in place of documents."""
    c = index.Collection(spark, new_folder(spark, "changed"), modes=modes, kinds=[kind])
    c.build(_docs(spark, sf_dir))
    c.remove(_t(spark, sf_dir, "labels").where("toxic = 1"))
    c.add(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.array(F.lit("en")).alias("corpora")))
    return c


_CHANGED = "documents AS (SELECT doc_id, text, lang, '' AS source FROM main.documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, text, 'en', '' FROM benchmark)"


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"]).replace("WITH ", f"WITH {_CHANGED}, ", 1) + _DOC)
def changed_index_search(spark, sf_dir):
    q = Query(keyword="er ing", corpora=["en"])
    return search.search(q, collection=_changed_collection(spark, sf_dir, "document", ["ci"])).select("identifier", _r("score").alias("score"))


@query(f"WITH {_CHANGED}, {_SENTENCES} SELECT doc_id, count(*) AS n, md5(string_agg(sentence, '|' ORDER BY sentence_id)) AS h FROM sent GROUP BY doc_id")
def changed_index_sentences(spark, sf_dir):
    c = _changed_collection(spark, sf_dir, "sentence", [])
    c.compact()
    c.vacuum()
    return c.sentences().groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_id", "sentence"))), lambda s: s["sentence"]), "|")).alias("h"))


# --- maintenance ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_document(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return index.delete(d, _t(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT item_id, length(text) FROM benchmark")
def add_document(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "text")
    new = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return index.add(d, new).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT corpus, count(*) AS n FROM (SELECT lang AS corpus FROM documents UNION ALL SELECT source FROM documents) GROUP BY corpus")
def corpus_counts(spark, sf_dir):
    return corpora.counts(_docs(spark, sf_dir))


_KNOWN = ", ".join("('" + n + "')" for n in corpora.known_corpora())


@query(f"WITH c AS (SELECT corpus, count(*) AS n FROM (SELECT lang AS corpus FROM documents UNION ALL SELECT source FROM documents) GROUP BY corpus), k(corpus) AS (VALUES {_KNOWN}) SELECT corpus, coalesce(n, 0) AS n FROM c FULL JOIN k USING (corpus)")
def corpus_counts_all(spark, sf_dir):
    return corpora.all_counts(_docs(spark, sf_dir))


_CLASSES = ", ".join("CASE WHEN regexp_full_match(title, '" + p + "') OR regexp_full_match(url, '" + p + "') THEN '" + n + "' END" for n, p in corpora.RULES.items())


@query(f"WITH p AS (SELECT page_id, url, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS title FROM pages) SELECT page_id, CASE WHEN len(list_filter([{_CLASSES}], lambda x: x IS NOT NULL)) = 0 THEN '{corpora.UNCLASSIFIED}' ELSE array_to_string(list_filter([{_CLASSES}], lambda x: x IS NOT NULL), '|') END AS corpora FROM p")
def corpus_classify(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", F.array_join(corpora.classify(F.col("title"), F.col("url")), "|").alias("corpora"))


# --- dictionary ----------------------------------------------------------------------------------------------------

_LEX_SQL = f"lw AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '{_R}')) AS term FROM benchmark), lx AS (SELECT term, 'len' || (length(term) % 5) AS category FROM lw WHERE length(term) > 4 UNION ALL SELECT term, 'th' FROM lw WHERE length(term) > 4 AND term LIKE 'th%')"


def _lexicon(spark, sf_dir) -> DataFrame:
    w = _t(spark, sf_dir, "benchmark").select(F.explode(fx.words(F.col("text"))).alias("term")).distinct().where("length(term) > 4")
    return w.select("term", F.concat(F.lit("len"), (F.length("term") % 5).cast("string")).alias("category")).unionByName(w.where("term like 'th%'").select("term", F.lit("th").alias("category")))


_PAIR_SQL = f"bp AS (SELECT regexp_split_to_array(text, ' ') AS a FROM benchmark), pr AS (SELECT DISTINCT a[1] || ' ' || a[2] AS term FROM bp WHERE regexp_full_match(a[1] || a[2], '[A-Za-z]+'))"


def _pair_terms(spark, sf_dir) -> DataFrame:
    a = F.split("text", " ")
    return _t(spark, sf_dir, "benchmark").select(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y")).where(F.concat("x", "y").rlike("^[A-Za-z]+$")).select(F.concat_ws(" ", "x", "y").alias("term"), F.lit("pair").alias("category")).distinct()


_MATCH_SQL = f"""{_LEX_SQL}, {_PAIR_SQL},
pc AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '({_T})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS a FROM documents),
pp AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS piece FROM pc),
po AS (SELECT *, regexp_full_match(lag(piece) OVER o, '{_T}') AS starts, lead(piece, 1) OVER o AS n1, lead(piece, 2) OVER o AS n2, lead(piece, 3) OVER o AS n3, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) - length(piece) AS "begin" FROM pp WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
mt AS (SELECT DISTINCT doc_id, "begin", "begin" + length(term) AS "end", term, category FROM (
  SELECT doc_id, "begin", lx.term, category FROM po JOIN lx ON piece = lx.term WHERE starts AND coalesce(regexp_full_match(n1, '{_T}'), true)
  UNION ALL SELECT doc_id, "begin", pr.term, 'pair' FROM po JOIN pr ON piece || n1 || n2 = pr.term WHERE starts AND n1 = ' ' AND coalesce(regexp_full_match(n3, '{_T}'), true)))"""


def _matches(spark, sf_dir) -> DataFrame:
    return lexicon.match(_t(spark, sf_dir, "documents"), _lexicon(spark, sf_dir).unionByName(_pair_terms(spark, sf_dir)))


@query(f'WITH {_MATCH_SQL} SELECT doc_id, "begin", "end", term, category FROM mt')
def lexicon_match(spark, sf_dir):
    return _matches(spark, sf_dir).select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "term", "category")


@query(f"WITH {_MATCH_SQL} SELECT term, category, count(DISTINCT doc_id) AS docs, count(*) AS n FROM mt WHERE term NOT IN (SELECT term FROM lx WHERE term LIKE '%e') GROUP BY term, category")
def lexicon_match_distinct(spark, sf_dir):
    lex = _lexicon(spark, sf_dir)
    stop = lex.where("term like '%e'").select(F.col("term").alias("word")).distinct()
    found = lexicon.match(_t(spark, sf_dir, "documents"), lex.unionByName(_pair_terms(spark, sf_dir)), stop)
    return found.groupBy("term", "category").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


@query(f"WITH {_MATCH_SQL}, ps AS (SELECT doc_id, category, term, string_agg(\"begin\" || ',' || \"end\", '|' ORDER BY \"begin\") AS positions, count(*) AS boost FROM mt GROUP BY doc_id, category, term) SELECT * FROM ps")
def lexical_positions(spark, sf_dir):
    return lexicon.lexical_postings(_matches(spark, sf_dir))


_CATS_SQL = f"{_LEX_SQL}, lc AS (SELECT term, string_agg(category, '|' ORDER BY category) AS cat FROM lx GROUP BY term), cw AS (SELECT doc_id, unnest(range(0, len(a))) AS pos, unnest(a) AS word FROM (SELECT doc_id, regexp_split_to_array(text, '{_R}') AS a FROM documents)), cr AS (SELECT doc_id, pos, word, coalesce(cat, 'NA') AS cat FROM cw LEFT JOIN lc ON word = term WHERE word <> '')"


@query(f"WITH {_CATS_SQL} SELECT doc_id, md5(string_agg(cat, chr(9) ORDER BY pos)) AS cats FROM cr GROUP BY doc_id")
def category_string(spark, sf_dir):
    return lexicon.category_strings(_t(spark, sf_dir, "documents"), _lexicon(spark, sf_dir)).select("doc_id", F.md5("cats").alias("cats"))


@query(f"WITH {_CATS_SQL} SELECT DISTINCT doc_id, word FROM cr WHERE list_contains(string_split(cat, '|'), 'th')")
def category_words(spark, sf_dir):
    return lexicon.words_in_category(_t(spark, sf_dir, "documents"), _lexicon(spark, sf_dir), "th")


def _cat_sql(n: int) -> str:
    return f"WITH {_CATS_SQL}, ch AS (SELECT doc_id, count(DISTINCT category) AS n FROM cr JOIN lx ON word = term WHERE category IN ('len1', 'th') GROUP BY doc_id) SELECT doc_id AS identifier FROM ch JOIN documents USING (doc_id) WHERE n >= {n} AND lang IN ('en', 'fr')"


@query(_cat_sql(2))
def category_search_and(spark, sf_dir):
    q = Query(categories=["len1", "th"], corpora=["en", "fr"])
    return search.search(q, _docs(spark, sf_dir), _lexicon(spark, sf_dir)).select("identifier")


@query(_cat_sql(1))
def category_search_or(spark, sf_dir):
    q = Query(categories=["len1", "th"], categories_and=False, corpora=["en", "fr"])
    return search.search(q, _docs(spark, sf_dir), _lexicon(spark, sf_dir)).select("identifier")


_EDGE_SQL = "e(parent, child) AS (SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'WORLD', r_name FROM region), a(category, ancestor) AS (SELECT child, parent FROM e UNION SELECT a.category, e.parent FROM a JOIN e ON e.child = a.ancestor)"


def _edges(spark, sf_dir) -> DataFrame:
    s, n, r = (_t(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    one = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"))
    two = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return one.union(two).union(r.select(F.lit("WORLD").alias("parent"), F.col("r_name").alias("child")))


@query(f"WITH RECURSIVE {_EDGE_SQL} SELECT DISTINCT category, ancestor FROM a")
def category_ancestors(spark, sf_dir):
    return lexicon.ancestors(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGE_SQL}, b AS (SELECT c_name AS term, n_name AS category FROM customer JOIN nation ON c_nationkey = n_nationkey), l AS (SELECT term, category FROM b UNION SELECT 'no ' || substr(term, 10), category FROM b) SELECT term, category FROM l UNION SELECT term, 'pAaCh' || category FROM l UNION SELECT term, 'pAaCh' || ancestor FROM l JOIN a USING (category)")
def lexicon_expand(spark, sf_dir):
    from folium.sources.files import lexicon_rows

    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("term"), F.concat(F.lit(" no "), F.expr("substring(c_name, 10)"), F.lit(" | ")).alias("lexicalvariations"), F.col("n_name").alias("category"))
    return lexicon.expand(lexicon_rows(rows), lexicon.ancestors(_edges(spark, sf_dir)))


# --- weights and similarity ----------------------------------------------------------------------------------------

_COUNTS = f"x AS (SELECT doc_id, lower(regexp_replace(unnest(regexp_split_to_array(text, '{_R}')), '[^A-Za-z0-9]', '', 'g')) AS v FROM documents), tc AS (SELECT doc_id, 'token:' || v AS term, count(*) AS tf FROM x WHERE v <> '' AND v NOT IN ('the', 'of', 'and') GROUP BY doc_id, v), tw AS (SELECT term, sum(tf)::DOUBLE AS gf, count(*)::DOUBLE AS df, sum(tf * tf)::DOUBLE AS sq, sum(tf * ln(tf::DOUBLE)) AS e FROM tc GROUP BY term), tv AS (SELECT count(*)::DOUBLE AS v FROM tw)"


def _token_counts(spark, sf_dir) -> DataFrame:
    stop = spark.createDataFrame([("the",), ("of",), ("and",)], "word string")
    return lsa.token_counts(_t(spark, sf_dir, "documents"), stop)


@query(f"WITH {_COUNTS} SELECT doc_id, term, tf FROM tc")
def token_counts_normalized(spark, sf_dir):
    return _token_counts(spark, sf_dir)


for _kind, _sql in {"binary": "1.0::DOUBLE", "normal": "1 / sqrt(sq)", "gfidf": "gf / df", "idf": "log2(v / (1 + df))", "entropy": "1 - (e - gf * ln(gf)) / (ln(v) * gf)"}.items():

    def _weights(spark, sf_dir, kind=_kind):
        return lsa.global_weights(_token_counts(spark, sf_dir), kind).select("term", _r("w").alias("w"))

    _weights.__name__ = f"gw_{_kind}"
    query(f"WITH {_COUNTS} SELECT term, round({_sql}, 6) AS w FROM tw, tv")(_weights)


@query(f"WITH {_COUNTS} SELECT doc_id, term, round(ln(tf + 1.0::DOUBLE), 6) AS w, 1.0::DOUBLE AS b FROM tc")
def lw_log(spark, sf_dir):
    return _token_counts(spark, sf_dir).select("doc_id", "term", _r(lsa.local_weight(F.col("tf"))).alias("w"), lsa.local_weight(F.col("tf"), "binary").alias("b"))


_FEATURES = f"{_COUNTS}, fv AS (SELECT doc_id, term, ln(tf + 1.0::DOUBLE) * (1 - (e - gf * ln(gf)) / (ln(v) * gf)) AS w FROM tc JOIN tw USING (term), tv)"


@query(f"WITH {_FEATURES} SELECT doc_id, term, round(w, 6) AS w FROM fv")
def feature_values(spark, sf_dir):
    return lsa.features(_token_counts(spark, sf_dir)).select("doc_id", "term", _r("w").alias("w"))


@query(f"WITH {_FEATURES} SELECT doc_id, count(*) AS n, round(sum(CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0 ELSE w END), 4) AS total FROM fv GROUP BY doc_id")
def excluded_rows(spark, sf_dir):
    f = lsa.without_excluded(lsa.features(_token_counts(spark, sf_dir)), _t(spark, sf_dir, "labels").where("toxic = 1"))
    return f.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("total"))


@query(f"WITH {_SPREAD}, o AS (SELECT word, min(doc_id) AS first FROM s WHERE word <> '' GROUP BY word) SELECT word, row_number() OVER (ORDER BY first, word) - 1 AS id FROM o")
def first_seen_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.explode(fx.terms(F.col("text"))).alias("word"), F.col("doc_id").alias("first"))
    return index.first_seen(d)


_COS = "pr AS (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cos FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), hit AS (SELECT * FROM pr WHERE cos > 0.35)"


def _pairs(spark, sf_dir, threshold: float = 0.35) -> DataFrame:
    return lsa.block_pairs(_t(spark, sf_dir, "embeddings"), threshold)


@query(f"WITH {_COS} SELECT i, j, round(cos, 6) AS cos FROM hit")
def cosine_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("i", "j", _r("cos").alias("cos"))


@query(f"WITH {_COS} SELECT count(*) AS n_pairs, round(avg(cos), 6) AS mean, round(stddev_pop(cos), 6) AS sigma FROM hit")
def pair_stats(spark, sf_dir):
    return lsa.pair_stats(_pairs(spark, sf_dir)).select("n_pairs", _r("mean").alias("mean"), _r("sigma").alias("sigma"))


@query(f"WITH RECURSIVE {_COS}, b AS (SELECT i, j FROM hit UNION ALL SELECT j, i FROM hit), r(node, seen) AS (SELECT DISTINCT i, i FROM b UNION SELECT r.node, b.j FROM r JOIN b ON b.i = r.seen) SELECT node, min(seen) AS component FROM r GROUP BY node")
def similar_components(spark, sf_dir):
    return lsa.components(lsa.block_links(_t(spark, sf_dir, "embeddings"), 0.35))


@query(f"WITH {_COS} SELECT round(cos, 6) AS cos, i, j, 'vector ' || i AS i_name, 'vector ' || j AS j_name FROM hit WHERE cos >= 0.4")
def similar_names(spark, sf_dir):
    names = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("name"))
    return lsa.similar_names(_pairs(spark, sf_dir), names, 0.4).withColumn("cos", _r("cos"))


def _matrix(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))


@query()
def svd_singular_values(spark, sf_dir):
    _, s, _ = lsa.svd(_matrix(spark, sf_dir), 10)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "k int, s double").select("k", _r("s", 4).alias("s"))


@query()
def svd_reconstruction(spark, sf_dir):
    u, s, _ = lsa.svd(_matrix(spark, sf_dir), 10)
    sigma = spark.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "component int, s double")
    return u.join(F.broadcast(sigma), "component").groupBy("row").agg(_r(F.sqrt(F.sum(F.col("value") * F.col("s") * F.col("value") * F.col("s"))), 4).alias("norm"))


@query("SELECT count(DISTINCT vec_id) AS n_rows, CAST(64 AS BIGINT) AS n_cols, sum(len(embedding))::BIGINT AS nnz FROM embeddings")
def matrix_shape(spark, sf_dir):
    return lsa.shape(_matrix(spark, sf_dir), "row", "col")


# --- ids, hashes, records ------------------------------------------------------------------------------------------


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(string_split(text, ''), lambda x: unicode(x)::HUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"SELECT doc_id, lower(lpad(to_hex(CASE WHEN text = '' THEN 14695981039346656037::UBIGINT ELSE CAST({_FNV} AS UBIGINT) END), 16, '0')) AS hash FROM documents")
def fnv_hash(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fx.fnv(F.col("text")).alias("hash"))


_ABC = fx.ALPHABET


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey >= 4096 THEN substr('{_ABC}', CAST(o_orderkey // 4096 AS INT) + 1, 1) ELSE '' END || CASE WHEN o_orderkey >= 64 THEN substr('{_ABC}', CAST(o_orderkey // 64 % 64 AS INT) + 1, 1) ELSE '' END || substr('{_ABC}', CAST(o_orderkey % 64 AS INT) + 1, 1) AS id FROM orders")
def id_encode(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", fx.short_id(F.col("o_orderkey")).alias("id"))


@query("SELECT doc_id, source AS author, ' PMID:' || doc_id AS accession, lang AS type, regexp_replace(text[:40], '[\\n\\r]', ' ', 'g') || '|tail' AS title, '' AS journal, '2016' AS year FROM documents")
def bib_roundtrip(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    record = {f: F.lit("") for f in bib.FIELDS} | {"author": F.concat("source", F.lit("\u00ff")), "accession": F.concat(F.lit(" PMID:"), F.col("doc_id").cast("string")), "type": F.col("lang"), "title": F.concat(F.regexp_replace("text", "[\\n\\r]", " "), F.lit("|tail")), "year": F.lit("2016")}
    lines = d.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.split(bib.bib_text(record), "\n")).alias("value"))
    # whole texts make the round trip, their start and the tail behind them are shown; bib_roundtrip_text compares all of them
    shown = F.expr("concat(substring(title, 1, least(40, length(title) - 5)), substring(title, -5))")
    return bib.parse_lines(lines).select(F.col("path").cast("long").alias("doc_id"), "author", "accession", "type", shown.alias("title"), "journal", "year")


@query("SELECT doc_id, length(t) AS n_chars, md5(t) AS abstract FROM (SELECT doc_id, replace(replace(regexp_replace(coalesce(text, ''), '[\n\r]', ' ', 'g'), '\u00ff', ''), '\\377', '') AS t FROM documents)")
def bib_roundtrip_text(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    record = {f: F.lit("") for f in bib.FIELDS} | {"abstract": F.regexp_replace("text", "[\\n\\r]", " ")}
    lines = d.select(F.col("doc_id").cast("string").alias("path"), F.explode(F.split(bib.bib_text(record), "\n")).alias("value"))
    return bib.parse_lines(lines).select(F.col("path").cast("long").alias("doc_id"), F.length("abstract").cast("long").alias("n_chars"), F.md5("abstract").alias("abstract"))


@query("SELECT doc_id, 'S' || (doc_id % 7) || ' ' || source AS author, lang || ', ' || source AS subject, 'PMID       ' || doc_id AS accession, 'research' AS type, 'V : ' || (doc_id % 50) || ' (3) pp. 1-9' AS citation, '2014' AS year, md5(regexp_replace(text, '\\n', '', 'g')) AS abstract FROM documents WHERE text <> ''")
def article_extract(spark, sf_dir):
    xml = F.concat(
        F.lit('<article article-type="research">\n<article-id pub-id-type="pmid">'), F.col("doc_id").cast("string"), F.lit("</article-id><contrib-group><contrib><surname>S"), (F.col("doc_id") % 7).cast("string"), F.lit("</surname> <given-names>"), F.col("source"),
        F.lit("</given-names></contrib></contrib-group><subject>"), F.col("lang"), F.lit("</subject><subject>"), F.col("source"), F.lit("</subject><volume>"), (F.col("doc_id") % 50).cast("string"),
        F.lit('</volume><issue>3</issue><fpage>1</fpage> <lpage>9</lpage><pub-date pub-type="epub"><month>1</month><year>2014</year> </pub-date><abstract lang="x">'), F.col("text"), F.lit("</abstract></article>"),
    )
    d = _t(spark, sf_dir, "documents").where("text <> ''").select("doc_id", bib.extract(xml).alias("b"))
    return d.select("doc_id", "b.author", "b.subject", "b.accession", "b.type", "b.citation", "b.year", F.md5("b.abstract").alias("abstract"))


# --- page layout over events as a sequence -------------------------------------------------------------------------

_ELEMENTS = "el AS (SELECT CAST(user_id % 50 AS INT) AS page, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS seq, event_type AS font, CAST(floor(value) AS DOUBLE) AS v, event_id FROM events), e2 AS (SELECT page, seq, font, v, event_id, CAST(v % 3 AS DOUBLE) AS x, 0.0::DOUBLE AS y, CASE WHEN v % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS dx FROM el)"


def _elements(spark, sf_dir) -> DataFrame:
    """Events as text elements: a page for each of 50 groups of users, small whole numbers as places."""
    e = _t(spark, sf_dir, "events").withColumn("page", (F.col("user_id") % 50).cast("int")).withColumn("v", F.floor("value").cast("double"))
    e = e.withColumn("seq", F.row_number().over(Window.partitionBy("page").orderBy("ts", "event_id")))
    return e.select("page", "seq", (F.col("v") % 3).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("v") % 2 == 0, 1.0).otherwise(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.col("event_type").alias("font"), F.lit(10.0).alias("font_size"), (F.col("v") % 5 + 1).alias("width"), F.lit(2).alias("n_chars"), F.lit(0).alias("n_spaces"), F.substring("event_type", 1, 2).alias("text"))


_CLUSTERS = f"{_ELEMENTS}, g AS (SELECT *, CASE WHEN x = lag(x + dx) OVER o AND y = lag(y) OVER o THEN 0 ELSE 1 END AS f FROM e2 WINDOW o AS (PARTITION BY page ORDER BY seq)), k AS (SELECT *, sum(f) OVER (PARTITION BY page ORDER BY seq) AS cluster FROM g), ct AS (SELECT page, cluster, arg_min(x, seq) AS start_x, arg_max(x + dx, seq) AS end_x, sum(v % 5 + 1) AS width, 2 * count(*) AS n_chars, CASE WHEN min(font) = max(font) THEN min(font) ELSE 'Various' END AS font, string_agg(substr(font, 1, 2), '' ORDER BY seq) AS text FROM k GROUP BY page, cluster)"


@query(f"WITH {_CLUSTERS} SELECT page, CAST(cluster AS BIGINT) AS cluster, start_x, end_x, width, CAST(n_chars AS BIGINT) AS n_chars, font, text FROM ct")
def cluster_elements(spark, sf_dir):
    return layout.cluster_totals(layout.clusters(_elements(spark, sf_dir))).select("page", "cluster", "start_x", "end_x", "width", "n_chars", "font", "text")


@query(f"WITH {_CLUSTERS} SELECT page, CAST(cluster AS BIGINT) AS cluster, start_x - lag(end_x) OVER o AS gap, coalesce(start_x - lag(end_x) OVER o > width / n_chars / 3, false) AS space, coalesce(start_x - lag(end_x) OVER o < -7 * width / n_chars, false) AS back, font IS DISTINCT FROM lag(font, 1, font) OVER o AS new_font FROM ct WINDOW o AS (PARTITION BY page ORDER BY cluster)")
def reading_gaps(spark, sf_dir):
    t = layout.cluster_tags(layout.cluster_totals(layout.clusters(_elements(spark, sf_dir))))
    return t.select("page", "cluster", "gap", "space", "back", F.exists("tags", lambda x: x.startswith("<_pdf _fnc=")).alias("new_font"))


@query("WITH e AS (SELECT user_id, event_id AS b, event_id + 3 + CAST(floor(value) AS BIGINT) % 40 AS stop, event_type FROM events), t AS (SELECT user_id, b, event_type, max(CASE WHEN event_type = 'error' THEN stop END) OVER (PARTITION BY user_id ORDER BY b) AS blocked FROM e) SELECT user_id, b AS \"begin\" FROM t WHERE event_type <> 'error' AND (blocked IS NULL OR b > blocked)")
def tag_blocking_asof(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("begin"), (F.col("event_id") + 3 + F.floor("value").cast("long") % 40).alias("end"), F.col("event_type").alias("content"))
    return annotate.tokens_outside_tags(e.where("content <> 'error'"), e.where("content = 'error'"), "user_id").select("user_id", "begin")


from folium import registry_more  # noqa: E402, F401  (registers further queries)
