"""More named queries: text functions, page layout, records, files and maintenance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions import text as fx
from folium.operators import annotate, corpora, index, layout, lexicon, lsa, search
from folium.plans.query import Query
from folium.registry import _DOC, _ELEMENTS as _BARE, _WORDS, _collection, _docs, _elements, _hits, _papers, _r, _search_sql, _sentence_query, _SENT_SQL, _t, _tf, query
from folium.session import new_folder
from folium.sources import files

# --- text functions ------------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS} SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS terms FROM w")
def analyzed_terms(spark, sf_dir):
    t = fx.analyzed(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("terms"))


_TAGGED = "concat('x <_pdf _page=', CAST(doc_id AS VARCHAR), '/>', replace(text, 'er ', 'er <_pdf _fsc=+2/>'), '<_pdf _cr/>')"


def _tagged() -> F.Column:
    return F.concat(F.lit("x <_pdf _page="), F.col("doc_id").cast("string"), F.lit("/>"), F.replace("text", F.lit("er "), F.lit("er <_pdf _fsc=+2/>")), F.lit("<_pdf _cr/>"))


@query("SELECT doc_id, md5('x ' || text) AS text FROM documents")
def strip_layout_tags(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(fx.strip_layout_tags(_tagged())).alias("text"))


@query("WITH n AS (SELECT doc_id, CAST((length(text) - length(replace(text, 'er ', ''))) // 3 AS BIGINT) AS n FROM documents) SELECT doc_id, '_page' AS tagtype, CAST(doc_id AS VARCHAR) AS value, 1::BIGINT AS n, 0::BIGINT AS first FROM n UNION ALL SELECT doc_id, '_cr', '', 1, n + 1 FROM n UNION ALL SELECT doc_id, '_fsc', '+2', n, 1 FROM n WHERE n > 0")
def layout_tag_rows(spark, sf_dir):
    rows = annotate.layout_tags(_t(spark, sf_dir, "documents").select("doc_id", _tagged().alias("text")))
    return rows.groupBy("doc_id", "tagtype", "value").agg(F.count("*").alias("n"), F.min("ord").cast("long").alias("first"))


@query("SELECT doc_id, md5(regexp_replace(replace(translate(text, 'àâçèéêëîïôùûüäöáíóúñÉÈÀÊÇÜÄÖÍÓÚÑÁ', 'aaceeeeiiouuuaoaiounEEAECUAOIOUNA'), 'ß', 'ss'), '[^\\x00-\\x7F]', '', 'g')) AS text FROM documents")
def ascii_text(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(fx.ascii_text(F.col("text"))).alias("text"))


@query("SELECT c_custkey, 'BEGIN ' || c_name || ' END' AS anchored, 'a=''' || c_name || ''' b=''' || c_custkey || '''' AS attributes, 'BG' || c_name || 'ED BG' || c_custkey || 'ED' AS encoded, [c_name, CAST(c_custkey AS VARCHAR)] AS decoded, 'x/' || c_custkey AS stem, len(string_split(c_name, '#')) + 1 AS n_tokens FROM customer")
def string_forms(spark, sf_dir):
    c, key = F.col("c_name"), F.col("c_custkey").cast("string")
    encoded = fx.encode_corpora(F.array(c, key))
    tokens = F.size(fx.space_tokens(F.concat(F.replace(c, F.lit("#"), F.lit(" ")), F.lit("  x")))).cast("long")
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", fx.anchored(c).alias("anchored"), fx.attribute_text(F.create_map(F.lit("a"), c, F.lit("b"), key)).alias("attributes"), encoded.alias("encoded"), fx.decode_corpora(encoded).alias("decoded"),
        fx.without_suffixes(F.concat(F.lit("x/"), key, F.lit(".tpcas.gz"))).alias("stem"), tokens.alias("n_tokens"),
    )


@query("SELECT p_partkey, 2.0::DOUBLE * (length(p_name) - length(replace(replace(p_name, 'a', ''), 'e', ''))) + 0.5::DOUBLE * length(replace(replace(p_name, 'a', ''), 'e', '')) AS width, p_size % 2 = 1 AS fixed, (p_size // 2) % 2 = 1 AS serif, p_name LIKE '%italic%' OR p_partkey % 3 = 0 AS italic FROM part")
def string_width_and_font(spark, sf_dir):
    width = fx.string_width(F.col("p_name"), F.create_map(F.lit("a"), F.lit(2.0), F.lit("e"), F.lit(2.0)), F.lit(0.5))
    style = fx.font_style(F.col("p_size").bitwiseAND(F.lit(3)), F.when(F.col("p_partkey") % 3 == 0, -12.0).otherwise(0.0), F.col("p_name"))
    return _t(spark, sf_dir, "part").select("p_partkey", width.alias("width"), style["fixed"].alias("fixed"), style["serif"].alias("serif"), style["italic"].alias("italic"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_neighbours(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", _r(fx.cosine(F.col("embedding"), F.col("other"))).alias("cos"))


# --- search --------------------------------------------------------------------------------------------------------


@query(_search_sql({"a": _tf("er"), "b": _tf("ing")}, "a > 0 OR b > 0", ["a", "b"]) + _DOC + " ORDER BY h.score DESC, doc_id LIMIT 25")
def doc_search_top(spark, sf_dir):
    return _hits(Query(keyword="er ing", corpora=["en"]), spark, sf_dir, limit=25)


@query(_SENT_SQL + "SELECT doc_id AS identifier, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sentence_id) AS place, sentence_id, round(score, 6) AS score FROM h")
def sentence_order(spark, sf_dir):
    h = search.search(_sentence_query(), collection=_collection(spark, sf_dir, kind="sentence"))
    rows = h.select("identifier", F.posexplode("matching_sentences").alias("place", "m"))
    return rows.select("identifier", (F.col("place") + 1).cast("long").alias("place"), "m.sentence_id", _r("m.score").alias("score"))


@query("SELECT doc_id, md5(text) AS text, 'A' || (doc_id % 7) || ' ' || source AS author FROM documents WHERE doc_id = 42")
def document_by_id(spark, sf_dir):
    return _collection(spark, sf_dir).by_id(42).select("doc_id", F.md5("text").alias("text"), "author")


_TWO = _search_sql({"a": _tf("er")}, "a > 0", ["a"]) + "SELECT CAST(count(*) + 2 AS BIGINT) AS n_hits, CAST(count(*) + 7 AS BIGINT) AS n_sentences, greatest(round(max(score), 6), 2.5::DOUBLE) AS max_score, least(round(min(score), 6), 0.25::DOUBLE) AS min_score FROM h"


@query(_TWO)
def merged_summaries(spark, sf_dir):
    one = search.summary(search.search(Query(keyword="er", corpora=["en"]), collection=_collection(spark, sf_dir)))
    two = spark.createDataFrame([(2, 7, 2.5, 0.25)], one.schema)
    return search.merged(one, two).select("n_hits", "n_sentences", _r("max_score").alias("max_score"), _r("min_score").alias("min_score"))


@query("SELECT doc_id, strftime(o_orderdate, '%Y-%m') AS year FROM documents LEFT JOIN orders ON o_orderkey = doc_id")
def document_lookup(spark, sf_dir):
    return _collection(spark, sf_dir).document_lookup()


# --- corpora -------------------------------------------------------------------------------------------------------

_TITLES = ["Biology of the mouse", "Neurosciences", "Trends in zebrafish genetics", "Cancer medicine", "Heart and health", "A dull title", "Fission yeast proteins", "Review of methods", "Virus research", "Black rat nutrition", "Arabidopsis thaliana", "Pediatric immunology"]
_TITLE_LIST = "[" + ", ".join(f"'{t}'" for t in _TITLES) + "]"
_FITS = ", ".join(f"CASE WHEN regexp_full_match(title, '{p}') THEN '{n}' END" for n, p in corpora.RULES.items())


@query(f"WITH d AS (SELECT doc_id, {_TITLE_LIST}[doc_id % {len(_TITLES)} + 1] AS title FROM documents), f AS (SELECT doc_id, list_filter([{_FITS}], lambda x: x IS NOT NULL) AS c FROM d) SELECT doc_id, CASE WHEN len(c) = 0 THEN '{corpora.UNCLASSIFIED}' ELSE array_to_string(c, '|') END AS corpora FROM f")
def corpus_classify_titles(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES) + 1).cast("int"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(corpora.classify(title), "|").alias("corpora"))


@query("SELECT count(*) AS n FROM documents WHERE lang = 'fr'")
def corpus_count_of_one(spark, sf_dir):
    return corpora.count_of(corpora.counts(_docs(spark, sf_dir)), "fr")


@query("SELECT DISTINCT corpus FROM (SELECT lang AS corpus FROM documents UNION ALL SELECT source FROM documents)")
def corpora_beyond_the_known(spark, sf_dir):
    path = new_folder(spark, "counts")
    corpora.save_counts(corpora.counts(_docs(spark, sf_dir)), path)
    return corpora.additional_corpora(corpora.load_counts(spark, path))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'C. elegans Supplementals' WHEN s_suppkey % 3 = 1 THEN 'C. elegans' END AS corpus FROM supplier")
def corpus_by_path(spark, sf_dir):
    path = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "C. elegans Supplementals/").otherwise("C. elegans/"), F.col("s_name"))
    kind = F.when(F.col("s_suppkey") % 3 == 2, "nxml").otherwise("pdf")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", corpora.path_corpus(path, kind).alias("corpus"))


@query("SELECT 'useruploads/u' || s_suppkey || '/' || n_name AS path, 'u' || s_suppkey AS \"user\", r_name AS corpus FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def uploads_by_literature_map(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = new_folder(spark, "literature")
    n.select(F.concat_ws("\t", "n_name", "r_name").alias("value")).write.text(path)
    s = _t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    uploads = s.select(F.concat(F.lit("useruploads/u"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("n_name")).alias("path")).unionByName(s.select(F.col("s_name").alias("path")))
    return files.upload_corpora(uploads, files.read_literature_map(spark, path))


# --- dictionaries --------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS doc_id, p_brand AS term, string_agg(DISTINCT p_type, '|') AS categories FROM part GROUP BY p_partkey, p_brand")
def categories_of_terms(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("term"), F.col("p_type").alias("category"), F.lit(1).alias("begin"))
    return lexicon.category_mapping(rows.unionByName(rows.withColumn("begin", F.lit(9)))).select("doc_id", "term", F.array_join("categories", "|").alias("categories"))


@query("SELECT DISTINCT p_name AS term, p_type AS category FROM part")
def lexicon_file(spark, sf_dir):
    path = new_folder(spark, "lexicon")
    _t(spark, sf_dir, "part").select(F.concat_ws("\t", "p_name", "p_type").alias("value")).write.text(path)
    return files.read_lexicon_tsv(spark, path).distinct()


@query("SELECT DISTINCT lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g')) AS word FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE regexp_replace(w, '[^A-Za-z0-9]', '', 'g') <> ''")
def stop_word_file(spark, sf_dir):
    path = new_folder(spark, "stop")
    _t(spark, sf_dir, "part").select(F.col("p_name").alias("value")).write.text(path)
    return files.read_stop_words(spark, path)


@query("SELECT r_name AS parent, n_name AS child FROM nation JOIN region ON n_regionkey = r_regionkey")
def category_edges(spark, sf_dir):
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    return files.category_edges(rows.union(r.select(F.lit("root").alias("parent"), F.col("r_name").alias("child"))))


@query("SELECT key, count(*) AS n FROM (SELECT unnest(['size', 'brand' || p_size]) AS key FROM part) GROUP BY key")
def attribute_keys(spark, sf_dir):
    size = F.col("p_size").cast("string")
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("Size="), size, F.lit(" none Brand"), size, F.lit("=x")).alias("attributes"))
    return files.attribute_keys(rows.unionByName(rows.select(F.lit("no keys").alias("attributes")))).groupBy("key").agg(F.count("*").alias("n"))


# --- records and files ---------------------------------------------------------------------------------------------


def _annotated(spark, sf_dir) -> DataFrame:
    text = F.concat("text", F.lit("<&\"'>\n\tend"))
    note = F.struct(F.lit("Token").alias("type"), F.lit(0).alias("begin"), F.length(text).alias("end"), F.substring("text", 1, 30).alias("content"), F.lit("a & b").alias("value"), F.lit(None).cast("string").alias("term"), F.col("lang").alias("category"), F.lit(None).cast("string").alias("tagtype"))
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.array(note, note).alias("annotations"))


_XMI = "SELECT doc_id, md5(text || '<&\"''>' || chr(10) || chr(9) || 'end') AS text, length(text) + 10 AS stop, md5(text[:30]) AS content, 'a & b' AS value, lang AS category, CAST(NULL AS VARCHAR) AS term, 2::BIGINT AS n FROM documents"


def _shown(rows: DataFrame) -> DataFrame:
    a = F.get("annotations", 1)
    return rows.select("doc_id", F.md5("text").alias("text"), a["end"].cast("long").alias("stop"), F.md5(F.coalesce(a["content"], F.lit(""))).alias("content"), a["value"].alias("value"), a["category"].alias("category"), a["term"].alias("term"), F.size("annotations").cast("long").alias("n"))


@query(_XMI)
def xmi_roundtrip(spark, sf_dir):
    rows = _annotated(spark, sf_dir)
    return _shown(rows.select("doc_id", files.parse_xmi(files.xmi_text(F.col("text"), F.col("annotations"))).alias("x")).select("doc_id", "x.text", "x.annotations"))


@query("SELECT vec_id AS row, round(list_sum(embedding::DOUBLE[]), 4) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def matrix_file(spark, sf_dir):
    path = new_folder(spark, "matrix")
    files.write_matrix(_t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.col("embedding").alias("values")), path)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return files.read_matrix(spark, path).select("row", _r(total, 4).alias("total"), F.size("values").cast("long").alias("n"))


@query("SELECT coalesce(max(event_id), 0)::BIGINT AS n FROM events")
def largest_annotation_id(spark, sf_dir):
    return annotate.largest_id(_t(spark, sf_dir, "events"), "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('click', 'error')")
def annotations_of_types(spark, sf_dir):
    return annotate.of_types(_t(spark, sf_dir, "events").withColumnRenamed("event_type", "type"), ["click", "error"]).select("event_id", "user_id")


@query("WITH a AS (SELECT event_id, user_id, CAST(event_id % 997 AS BIGINT) AS b, CAST(event_id % 997 + 5 + user_id % 11 AS BIGINT) AS e FROM events), r AS (SELECT u AS user_id, k * 20 AS lo, k * 20 + 1 + (u + k) % 12 AS hi FROM (SELECT DISTINCT user_id AS u FROM events), range(0, 55) t(k)), m AS (SELECT event_id, b, e, coalesce(sum(least(greatest(b - lo, 0), hi - lo)), 0) AS gb, coalesce(sum(least(greatest(e - lo, 0), hi - lo)), 0) AS ge FROM a LEFT JOIN r USING (user_id) GROUP BY event_id, b, e) SELECT event_id, CAST(b - gb AS INT) AS \"begin\", CAST(e - ge AS INT) AS \"end\" FROM m")
def offsets_without_spans(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    notes = e.select("event_id", "user_id", (F.col("event_id") % 997).cast("int").alias("begin"), (F.col("event_id") % 997 + 5 + F.col("user_id") % 11).cast("int").alias("end"))
    spans = e.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(54))).alias("k"))
    spans = spans.select("user_id", (F.col("k") * 20).cast("int").alias("begin"), (F.col("k") * 20 + 1 + (F.col("user_id") + F.col("k")) % 12).cast("int").alias("end"))
    return annotate.without_spans(notes, spans, "user_id").select("event_id", "begin", "end")


# --- similarity ----------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_pairs, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS sigma FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)")
def all_pair_stats(spark, sf_dir):
    return lsa.pair_stats(lsa.block_pairs(_t(spark, sf_dir, "embeddings"), -2.0)).select("n_pairs", _r("mean", 5).alias("mean"), _r("sigma", 5).alias("sigma"))


@query("WITH RECURSIVE h AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4), b AS (SELECT i, j FROM h UNION ALL SELECT j, i FROM h), r(node, seen) AS (SELECT DISTINCT i, i FROM b UNION SELECT r.node, b.j FROM r JOIN b ON b.i = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node) SELECT component, count(*) AS size, array_to_string(list_sort(list('v' || node)), '|') AS names FROM c GROUP BY component")
def similar_sets(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    names = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"))
    found = lsa.component_sets(lsa.components(lsa.block_links(e, 0.4)), names)
    return found.select("component", "size", F.array_join("names", "|").alias("names"))


# --- page layout ---------------------------------------------------------------------------------------------------

_ELEMENTS = f"{_BARE}, e3 AS (SELECT *, CAST(v % 5 + 1 AS DOUBLE) AS width, substr(font, 1, 2) AS text FROM e2)"


@query(f"WITH {_ELEMENTS}, r AS (SELECT page, seq, row_number() OVER (PARTITION BY page ORDER BY floor(x * 7 % 5 + 0.5) DESC, width, seq) AS ordinal FROM e3) SELECT page, seq, CAST(ordinal AS INT) AS ordinal FROM r")
def sorted_chain(spark, sf_dir):
    e = _elements(spark, sf_dir).withColumn("y", F.col("x") * 7 % 5).withColumn("x", F.col("width"))
    return layout.sorted_chain(e).select("page", "seq", "ordinal")


_PLACED = f"{_ELEMENTS}, pl AS (SELECT page, seq, width, CAST(seq % 40 AS DOUBLE) AS x, CAST(seq * 7 % 300 AS DOUBLE) AS y, text FROM e3)"


def _placed(spark, sf_dir) -> DataFrame:
    return _elements(spark, sf_dir).withColumn("x", (F.col("seq") % 40).cast("double")).withColumn("y", (F.col("seq") * 7 % 300).cast("double"))


@query(f"WITH {_PLACED}, br AS (SELECT DISTINCT page, y FROM pl WHERE x + width > 20 AND x < 20 AND width > 4) SELECT page, seq FROM pl WHERE EXISTS (SELECT 1 FROM br WHERE br.page = pl.page AND abs(br.y - pl.y) < 2)")
def near_column_bridge(spark, sf_dir):
    e = _placed(spark, sf_dir)
    return layout.near_bridge(e, layout.bridges(e.where("width > 4"), 20.0), 2.0).select("page", "seq")


_LINKS = "li AS (SELECT n_nationkey AS page, n_name AS uri, CAST(n_nationkey AS DOUBLE) AS l, CAST(n_nationkey * 3 AS DOUBLE) AS b, 9.0::DOUBLE AS w, 40.0::DOUBLE AS h FROM nation)"


@query(f"WITH {_PLACED}, {_LINKS} SELECT li.page, uri, string_agg(text, '' ORDER BY seq) AS text FROM li JOIN pl ON li.page = pl.page AND x + 0.5 >= l AND x + 0.5 < l + w AND y >= b AND y <= b + h GROUP BY li.page, uri")
def link_texts(spark, sf_dir):
    n = F.col("n_nationkey")
    links = _t(spark, sf_dir, "nation").select(n.cast("int").alias("page"), F.col("n_name").alias("uri"), n.cast("double").alias("left"), (n * 3).cast("double").alias("bottom"), F.lit(9.0).alias("width"), F.lit(40.0).alias("height"))
    return layout.link_texts(links, _placed(spark, sf_dir).withColumn("dx", F.lit(1.0)).withColumn("dy", F.lit(0.0)))


@query("SELECT event_id, round(coalesce(sum(((user_id % 9) / 2.0::DOUBLE - CAST(floor(value) AS BIGINT) % 50 / 1000.0::DOUBLE) * 10 * 1.5::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS x FROM events")
def cursor_advance(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    shown = e.select("event_id", F.col("user_id").alias("line"), F.col("event_id").alias("seq"), ((F.col("user_id") % 9) / 2.0).alias("w"), (F.floor("value") % 50).cast("double").alias("tj"), F.lit(10.0).alias("size"), F.lit(0.0).alias("charsp"), F.lit(0.0).alias("wordsp"), F.lit(1.5).alias("hscale"))
    return layout.advance(shown).select("event_id", _r("x", 4).alias("x"))


@query(f"WITH {_ELEMENTS}, k AS (SELECT page, seq, seq // 6 AS cluster, x, width FROM e3), s AS (SELECT *, sum(width) OVER (PARTITION BY page, cluster) / sum(2) OVER (PARTITION BY page, cluster) / 3 AS third, lag(x * 4 - width) OVER (PARTITION BY page, cluster ORDER BY seq) AS rest FROM k) SELECT page, seq, coalesce(rest > third, false) AS space_before FROM s")
def inner_spaces(spark, sf_dir):
    e = _elements(spark, sf_dir).withColumn("cluster", F.floor(F.col("seq") / 6)).withColumn("dx", F.col("x") * 4)
    return layout.inner_spaces(e).select("page", "seq", "space_before")


@query("WITH t AS (SELECT event_id, CAST(user_id % 50 AS INT) AS page, CAST(event_id % 6 AS DOUBLE) * 20 AS x, CAST(event_id // 6 % 9 AS DOUBLE) * 3 AS y FROM events), l AS (SELECT *, coalesce(x - lag(x + 10) OVER o < -14, false) AS back, coalesce(x - lag(x + 10) OVER o > 2 / 3.0::DOUBLE, false) AS space, lag(x) OVER o IS NOT NULL AS has FROM t WINDOW o AS (PARTITION BY page ORDER BY event_id)) SELECT page, sum(CASE WHEN back THEN 1 ELSE 0 END)::BIGINT AS backs, sum(CASE WHEN space THEN 1 ELSE 0 END)::BIGINT AS spaces, sum(CASE WHEN back AND NOT space THEN 1 ELSE 0 END)::BIGINT AS breaks FROM l GROUP BY page")
def line_breaks(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    x, y = (F.col("event_id") % 6).cast("double") * 20, (F.floor(F.col("event_id") / 6) % 9).cast("double") * 3
    totals = e.select((F.col("user_id") % 50).cast("int").alias("page"), F.col("event_id").alias("cluster"), x.alias("start_x"), y.alias("start_y"), (x + 10).alias("end_x"), y.alias("end_y"), F.lit(10.0).alias("width"), F.lit(5).alias("n_chars"), F.lit(0).alias("n_spaces"), F.lit("f").alias("font"), F.lit(9.0).alias("font_size"), F.lit("t").alias("text"))
    t = layout.cluster_tags(totals)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return t.groupBy("page").agg(n(F.col("back")).alias("backs"), n(F.col("space")).alias("spaces"), n(F.array_contains("tags", "<_pdf _cr/>")).alias("breaks"))


@query(f"WITH {_ELEMENTS} SELECT page, '<_pdf _page=' || page || '/>' || chr(10) || string_agg(text, '' ORDER BY seq) AS text FROM e3 GROUP BY page")
def whole_page_texts(spark, sf_dir):
    e = _elements(spark, sf_dir)
    joined = e.select("page", F.col("seq").alias("cluster"), "text", F.lit(False).alias("space"), F.lit(False).alias("back"))
    pages = layout.page_text(joined).withColumn("path", F.col("page").cast("string"))
    return layout.whole_text(pages).select(F.col("path").cast("int").alias("page"), "text")


# --- maintenance ---------------------------------------------------------------------------------------------------


@query(f"WITH {_WORDS}, p AS (SELECT unnest(t) AS term, doc_id FROM w) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY term")
def stored_term_stats(spark, sf_dir):
    post = _collection(spark, sf_dir).postings()
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 99 AS id FROM documents")
def numbered_documents(spark, sf_dir):
    return index.with_ids(_t(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 100)


@query("SELECT doc_id, sentence_id, strftime(o_orderdate, '%Y-%m') AS year FROM (WITH " + _SENT_SQL.split("WITH ", 1)[1].split(", u AS", 1)[0] + " SELECT doc_id, sentence_id FROM sent) s LEFT JOIN orders ON o_orderkey = s.doc_id")
def sentence_lookup(spark, sf_dir):
    return _collection(spark, sf_dir, kind="sentence").sentence_lookup()


@query(_search_sql({"a": _tf("er")}, "a > 0", ["a"], restrict="true", units="(SELECT * FROM w WHERE lang = 'en')") + "SELECT doc_id AS identifier, round(score, 6) AS score, 'main' AS document_type FROM h UNION ALL SELECT identifier, score, 'external' FROM (" + _search_sql({"a": _tf("er")}, "a > 0", ["a"], restrict="true", units="(SELECT * FROM w WHERE lang = 'de')") + _DOC + ")")
def attached_collection_search(spark, sf_dir):
    parts = []
    for lang in ("en", "de"):
        c = index.Collection(spark, new_folder(spark, "part"), modes=["ci"], kinds=["document"])
        c.build(_papers(spark, sf_dir).where(F.array_contains("corpora", lang)))
        parts.append(c)
    parts[0].attach(parts[1])
    return parts[0].search(Query(keyword="er", corpora=["en", "de"])).select("identifier", _r("score").alias("score"), "document_type")
