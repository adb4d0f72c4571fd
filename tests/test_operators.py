"""Operators on small literals: boundaries, dictionaries, search, records, layout, similarity, maintenance."""

import gzip

import pytest
from pyspark.sql import functions as F

from folium.functions import text as fx
from folium.operators import annotate, corpora, details, index, layout, lexicon, lsa, search
from folium.plans.query import Query, QueryError, parse
from folium.sources import bib, files
from folium.streaming import incremental


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


# --- text


def test_text_functions(spark):
    assert one(spark, "a <b>c</b>\nd <_pdf _cr", fx.strip_tags) == "a c\nd "
    assert one(spark, "  a \n\t b ", fx.collapse_space) == "a b"
    assert one(spark, "it's a (test)", fx.words) == ["it", "s", "a", "", "test", ""]
    assert one(spark, "Ab-1é.", fx.normalized) == "ab1"
    assert one(spark, "ﬁne ±2 µm", fx.ascii_text) == "fine plus/minus2 microm"
    assert one(spark, "a| b ||c ", fx.variations) == ["a", "b", "c"]
    assert one(spark, "/x/y/paper.tpcas.gz", fx.parent_name) == "y"
    assert one(spark, "<_pdf _fsc=+2/>", fx.layout_tag).asDict() == {"tagtype": "_fsc", "value": "+2"}
    assert one(spark, "12#paper12345.x#the text", files.unframed).asDict() == {"filename": "paper12345.x", "text": "the text"}
    assert one(spark, "", fx.fnv) == "cbf29ce484222325" and one(spark, "a", fx.fnv) == "af63dc4c8601ec8c"
    assert one(spark, None, fx.fnv) is None


# --- boundaries


def sentences_of(spark, text, **kw):
    rows = annotate.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).orderBy("sentence_id").collect()
    assert [r["sentence_id"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(text[r["begin"] : r["end"]] == r["sentence"] for r in rows)
    return [r["sentence"] for r in rows]


def test_sentences(spark):
    assert sentences_of(spark, "One. Two! Three? Four") == ["One", "Two", "Three", "Four"]
    assert sentences_of(spark, "One. Two! Three? Four", emit_tail=False) == ["One", "Two", "Three"]
    assert sentences_of(spark, "By A. Smith et al. in Fig. 2. Next.\nLine") == ["By A. Smith et al. in Fig. 2", "Next", "Line"]
    assert sentences_of(spark, "End.<tag here. x") == ["End", "tag here", "x"]
    assert sentences_of(spark, "") == []


def test_tokens_and_tags(spark):
    docs = spark.createDataFrame([(1, "ab, cd ef.")], "doc_id long, text string")
    rows = annotate.token_spans(docs).orderBy("begin").collect()
    assert [(r["begin"], r["end"], r["content"]) for r in rows] == [(0, 2, "ab"), (2, 4, ", "), (4, 6, "cd"), (6, 7, " ")]
    assert [r["content"] for r in annotate.token_spans(docs, emit_tail=True, delimiters=False).orderBy("begin").collect()] == ["ab", "cd", "ef."]
    tagged = spark.createDataFrame([(1, "x <_pdf _page=3/> y <_pdf _cr/>")], "doc_id long, text string")
    assert [(r["tagtype"], r["value"]) for r in annotate.layout_tags(tagged).orderBy("ord").collect()] == [("_page", "3"), ("_cr", "")]
    spans = "doc_id long, begin int, end int, content string"
    tokens, tags = spark.createDataFrame([(1, 0, 2, "a"), (1, 5, 7, "b"), (1, 9, 12, "c"), (2, 1, 2, "d")], spans), spark.createDataFrame([(1, 3, 8, "t")], spans)
    assert sorted(r["content"] for r in annotate.tokens_outside_tags(tokens, tags).collect()) == ["a", "c", "d"]


# --- dictionaries


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "red fish and red fish eggs (fish) blue fish")], "doc_id long, text string")
    lex = spark.createDataFrame([("fish", "animal"), ("red fish", "animal"), ("fish eggs", "food"), ("fish", "meal"), ("blue", "colour"), ("is", "x")], "term string, category string")
    hits = sorted((r["begin"], r["end"], r["term"], r["category"]) for r in lexicon.match(docs, lex).collect())
    assert hits == [(4, 8, "fish", "animal"), (4, 8, "fish", "meal"), (13, 21, "red fish", "animal"), (17, 21, "fish", "animal"), (17, 21, "fish", "meal"), (17, 26, "fish eggs", "food"), (28, 32, "fish", "animal"), (28, 32, "fish", "meal"), (34, 38, "blue", "colour"), (39, 43, "fish", "animal"), (39, 43, "fish", "meal")]
    assert lexicon.match(docs, lex, at_start=True).where("term = 'red fish' and begin = 0").count() == 1
    stop = spark.createDataFrame([("fish",)], "word string")
    assert {r["term"] for r in lexicon.match(docs, lex, stop).collect()} == {"red fish", "fish eggs", "blue"}
    assert lexicon.match(docs, lex.limit(0)).isEmpty()


def test_ancestors_survive_cycles_and_two_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c"), ("c", "a")], "parent string, child string")
    got = {(r[0], r[1]) for r in lexicon.ancestors(edges).collect()}
    assert got == {(c, a) for c in "abc" for a in "abcx"}
    rows = files.lexicon_rows(spark.createDataFrame([("t", " u |v", "c")], "term string, lexicalvariations string, category string"))
    full = lexicon.expand(rows, lexicon.ancestors(edges))
    assert {r["term"] for r in full.collect()} == {"t", "u", "v"}
    assert {r["category"] for r in full.where("term = 'u'").collect()} == {"c", "pAaChc", "pAaCha", "pAaChb", "pAaChx"}


def test_ancestors_of_a_deep_hierarchy(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "parent int, child int")
    assert {(r[0], r[1]) for r in lexicon.ancestors(edges).collect()} == {(c, a) for c in range(n + 1) for a in range(c)}


# --- search


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        (1, "DNA binding of DYN-1 in worms. Dna again.", ["C. elegans"], "2000-08", "Smith J; Jones A", "WBPaper00046156", "research", "Cell"),
        (2, "Nothing to see here. Binding sites.", ["C. elegans"], "2014-10-30", "Jones A", "PMID:24058849", "review", "Cell Reports"),
        (3, "dna in yeast.", ["S. cerevisiae"], "2016", "Smith J", "x", "research", "Cell"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, corpora array<string>, year string, author string, accession string, type string, journal string")


@pytest.mark.parametrize(
    "ask, found",
    [
        ({"keyword": "dna"}, [1]),
        ({"keyword": "DNA AND Binding:2 OR DYN-1"}, []),
        ({"keyword": "dna OR binding"}, [1, 2]),
        ({"keyword": "binding -dna"}, [2]),
        ({"keyword": "binding NOT dna"}, [2]),
        ({"keyword": '"dna binding"'}, [1]),
        ({"keyword": '"binding dna"'}, []),
        ({"keyword": "bind*"}, [1, 2]),
        ({"keyword": "d?a"}, [1]),
        ({"keyword": "Dna", "case_sensitive": True}, [1]),
        ({"keyword": "dna", "case_sensitive": True}, []),
        ({"keyword": "binding", "exclude_keyword": "worms"}, [2]),
        ({"accession": "WBPaper00046156 24058849"}, [1, 2]),
        ({"author": "jones", "year": "2000-08"}, [1]),
        ({"journal": "Cell", "exact_journal": True}, [1]),
        ({"journal": "Cell"}, [1, 2]),
        ({"paper_type": "review"}, [2]),
        ({"keyword": "dna", "corpora": ["C. elegans", "S. cerevisiae"]}, [1, 3]),
        ({"kind": "sentence", "keyword": "dna"}, [1]),
    ],
)
def test_requests(papers, ask, found):
    hits = search.search(Query(**({"corpora": ["C. elegans"]} | ask)), papers).collect()
    assert sorted(r["identifier"] for r in hits) == found
    assert [r["score"] for r in hits] == sorted((r["score"] for r in hits), reverse=True)


def test_sentence_hits_and_summary(papers):
    hits = search.search(Query(kind="sentence", keyword="dna binding", corpora=["C. elegans"]), papers)
    by_id = {r["identifier"]: r for r in hits.collect()}
    assert [s["sentence_id"] for s in by_id[1]["matching_sentences"]] == [1, 2] and len(by_id[2]["matching_sentences"]) == 1
    assert by_id[1]["score"] == pytest.approx(sum(s["score"] for s in by_id[1]["matching_sentences"]))
    s = search.summary(hits).first()
    assert (s["n_hits"], s["n_sentences"]) == (2, 3) and s["max_score"] >= s["min_score"]
    none = search.summary(search.search(Query(keyword="absent", corpora=["C. elegans"]), papers)).first()
    assert (none["n_hits"], none["max_score"]) == (0, None)


def test_a_search_returns_all_hits_unless_asked_for_the_first(spark, papers):
    n = 1_000_003
    many = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("fish").alias("text"), F.array(F.lit("en")).alias("corpora"))
    assert search.summary(search.search(Query(keyword="fish", corpora=["en"]), many)).first()["n_hits"] == n
    q = Query(keyword="dna binding", corpora=["C. elegans"])
    every = [r["identifier"] for r in search.search(q, papers).collect()]
    assert len(every) == 2 and [r["identifier"] for r in search.search(q, papers, limit=1).collect()] == every[:1]
    assert search.federated(q, papers, papers, limit=1).count() == 1 and search.federated(q, papers, papers).count() == 4


def test_scores_are_sql_s_to_the_last_bit(spark):
    """Equal scores in SQL are equal here, so that ties are broken alike."""
    import duckdb

    rows = [(i, " ".join(["fish"] * (i % 7) + ["bird"] * (i % 3) + ["x"] * (i % 29 + 1)), ["en"]) for i in range(200)]
    hits = search.search(Query(keyword="fish bird", corpora=["en"]), spark.createDataFrame(rows, "doc_id long, text string, corpora array<string>")).collect()
    values = ", ".join(f"({i}, {i % 7}, {i % 3}, {i % 7 + i % 3 + i % 29 + 1})" for i in range(200))
    part = lambda n: f"CASE WHEN {n} > 0 THEN sqrt({n}::DOUBLE) * pow(1 + ln(200::DOUBLE / ((SELECT count(*) FROM c WHERE {n} > 0) + 1)::DOUBLE), 2) / sqrt(l::DOUBLE) ELSE 0 END"
    expected = duckdb.execute(f"WITH c(i, a, b, l) AS (VALUES {values}) SELECT i, {part('a')} + {part('b')} AS score FROM c WHERE a > 0 OR b > 0 ORDER BY score DESC, i").fetchall()
    assert [(r["identifier"], r["score"]) for r in hits] == expected


def test_order_by_year(papers):
    q = Query(keyword="dna binding", corpora=["C. elegans", "S. cerevisiae"], sort_by_year=True)
    assert [r["year"] for r in search.search(q, papers).collect()] == ["2016", "2014-10-30", "2000-08"]


@pytest.mark.parametrize("text", ["(a", "a)", "AND a"])
def test_text_that_does_not_parse(text):
    with pytest.raises(QueryError):
        parse(text)


def test_empty_requests():
    for q in (Query(keyword="a"), Query(corpora=["c"])):
        with pytest.raises(QueryError):
            q.check()


def test_compat_binds_the_first_word_only(papers):
    q = Query(keyword="binding", exclude_keyword="worms sites", corpora=["C. elegans"])
    assert search.search(q, papers).isEmpty()
    q.compat = True
    assert [r["identifier"] for r in search.search(q, papers).collect()] == [2]


# --- maintenance


def test_collection(spark, papers, tmp_path):
    a, b = index.Collection(spark, f"file://{tmp_path}/a"), index.Collection(spark, f"file://{tmp_path}/b")
    a.build(papers.where("doc_id < 3"))
    b.build(papers.where("doc_id = 3"))
    q = Query(keyword="dna", corpora=["C. elegans", "S. cerevisiae"])
    assert [r["identifier"] for r in a.search(q).collect()] == [1]
    a.attach(b)
    assert {(r["identifier"], r["document_type"]) for r in a.search(q).collect()} == {(1, "main"), (3, "external")}
    a.detach()
    assert not a.remove([99]) and a.remove([1]) and a.docs().count() == 1
    assert a.search(q).isEmpty() and a.postings().where("doc_id = 1").isEmpty() and a.sentence_lookup().where("doc_id = 1").isEmpty()
    a.add(papers.where("doc_id = 1"))
    assert [r["identifier"] for r in a.search(q).collect()] == [1]
    a.add(papers.where("doc_id = 1").withColumn("text", F.lit("now about worms only.")))
    assert a.search(q).isEmpty() and [r["identifier"] for r in a.search(Query(keyword="worms", corpora=["C. elegans"])).collect()] == [1]
    before = sorted(map(tuple, a.postings().select("doc_id", "term", "tf").collect()))
    a.compact()
    a.vacuum()
    assert sorted(map(tuple, a.postings().select("doc_id", "term", "tf").collect())) == before and len(a.log()) == 1
    assert len(list((tmp_path / "a" / "docs").glob("segment=*"))) == 1
    with pytest.raises(ValueError):
        index.Collection(spark, f"file://{tmp_path}/none").docs()


def test_two_writers_of_one_number(spark, papers, tmp_path, monkeypatch):
    c = index.Collection(spark, f"file://{tmp_path}/c", modes=["ci"])
    c.build(papers)
    old = c.log()
    c.remove([1])
    monkeypatch.setattr(c, "log", lambda: old)
    with pytest.raises(Exception, match="exists"):
        c._commit("s0", adds=False, hides=True)


@pytest.mark.parametrize(
    "ask",
    [
        {"keyword": "dna binding"}, {"keyword": "DNA AND Binding"}, {"keyword": '"binding of dyn"'}, {"keyword": "bind* OR yeast"}, {"keyword": "dna -yeast"}, {"exclude_keyword": "yeast"}, {"keyword": "DNA", "case_sensitive": True},
        {"keyword": "the of"}, {"keyword": "dna", "exclude_keyword": "the"}, {"keyword": "(dna OR worms) AND NOT again"}, {"keyword": "DYN-1"}, {"keyword": "dna", "kind": "sentence"}, {"exclude_keyword": "dna", "kind": "sentence"}, {"keyword": "dna again", "coord": True},
    ],
)
def test_stored_and_plain_search_agree(spark, papers, tmp_path_factory, ask):
    c = index.Collection(spark, "file://" + str(tmp_path_factory.getbasetemp() / "stored"))
    if not c.log():
        c.build(papers)
    q = Query(**({"corpora": ["C. elegans", "S. cerevisiae"]} | ask))
    rows = lambda hits: [(r["identifier"], round(r["score"], 9), r["year"], [x["sentence_id"] for x in r["matching_sentences"]] if q.kind == "sentence" else None) for r in hits.collect()]
    stored = rows(search.search(q, collection=c))
    assert stored == rows(search.search(q, papers))
    assert bool(stored) == (q.keyword != "the of")


def test_term_filters_reach_the_files(spark, papers, tmp_path):
    c = index.Collection(spark, f"file://{tmp_path}/i")
    c.build(papers)
    hits = search.search(Query(keyword="dna OR bind*", corpora=["C. elegans"]), collection=c)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    scans = [p for p in plan.split("\n\n") if "Scan parquet" in p]
    terms = [p for p in scans if "positions" in p or "tf:int" in p]
    assert terms and all("EqualTo(term,dna)" in p and "StringStartsWith(term,bind)" in p and "PartitionFilters: [isnotnull(granularity" in p for p in terms)
    assert not any("text:string" in p for p in scans)
    assert c.sentence_lookup().count() == 5


def test_lists_in_blocks_are_the_postings_and_shuffle_nothing(spark):
    rows = [(1, "The fish of a Fish, the end."), (2, ""), (3, None), (4, "end x" + "y" * 300 + " fish it's 3.5"), (5, "the of"), (6, "fish fish")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for mode in index.CASE_MODES:
        expected = sorted(map(tuple, index.postings(docs, case_mode=mode).select("term", "doc_id", "tf", "positions").collect()))
        for block in (1, 30, index.BLOCK):
            lists = index.posting_lists(index.units(docs), mode, block=block)
            assert "Exchange" not in spark.sparkContext._jvm.PythonSQLUtils.explainString(index.posting_lists(index.units(spark.range(9).selectExpr("id doc_id", "'a b' text")), mode)._jdf.queryExecution(), "simple")
            e = lists.select("term", F.explode("entries").alias("e")).select("term", "e.*").collect()
            assert sorted((r["term"], r["doc_id"], r["tf"], r["positions"]) for r in e if r["term"]) == expected
            lengths = {r["doc_id"]: r["n_terms"] for r in index.unit_lengths(docs, case_mode=mode).collect()}
            assert {r["doc_id"]: r["n_terms"] for r in e if not r["term"]} == lengths and all(r["n_terms"] == lengths[r["doc_id"]] for r in e)


def test_texts_split_in_blocks_have_the_words_of_the_regular_expression(spark):
    """Marks at edges of texts, letters of all lengths in UTF-8, letters that Python and the JVM don't agree on, bytes that are no text."""
    texts = ["a.b", ".b", "a.", "'", "x''y it's.ok. a.'b", "İstanbul Straße 3.5 x", "é", "é.é'", "𐐀𝔘 x.𐐀", "日本.語 한", "a\u0301b \u0660\u00b2\u2167", "x\u00a0y\u2028z\x00w", "", None, "𞤀\U0001e5d0\U00016d40.ꟊ\U0001f600", "the.the the", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.sql("select 99L doc_id, cast(x'6bc3622ee9' as string) text")).coalesce(1)
    for mode in index.CASE_MODES:
        lists = index.posting_lists(index.units(rows), mode).select("term", F.explode("entries").alias("e")).where("term <> ''")
        expected = index.postings(rows, case_mode=mode).where("doc_id < 99").select("term", "doc_id", "positions").collect()
        assert sorted(map(tuple, lists.where("e.doc_id < 99").select("term", "e.doc_id", "e.positions").collect())) == sorted(map(tuple, expected))
        assert [tuple(r) for r in lists.where("e.doc_id = 99").select("term", "e.n_terms").orderBy("term").collect()] == [("b", 2), ("k", 2)]


def test_texts_and_not_arrays_of_words_are_handed_over_when_indexing(spark):
    lists = index.posting_lists(index.units(spark.range(9).selectExpr("id doc_id", "'a b' text")))
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(lists._jdf.queryExecution(), "formatted")
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan


def test_packed_lists_are_the_lists(spark, monkeypatch):
    """Ids of all kinds and sizes, none at all, units without a text, long lists and places far apart."""
    far = " the" * 20000 + " x fish"
    texts = ["The fish of a Fish, the end.", "", None, "fish" + far, "the of", "x " * 300, "fish fish"]
    ids = {"bigint": [5, -(2**63), 2**63 - 1, None, 0, -1, 7], "tinyint": [5, -128, 127, None, 0, -1, 7], "string": ["b", "a", "", None, "\u00e9", "zz", "b"]}
    for kind, own in ids.items():
        rows = spark.createDataFrame([(str(i) if i is not None else None, k - 3 if k % 2 else None, x) for k, (i, x) in enumerate(zip(own, texts, strict=True))], "doc_id string, sentence_id int, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).coalesce(1)
        for block in (1, index.BLOCK):
            for most in (1, 1 << 22):
                monkeypatch.setattr(index, "UNPACKED", most)
                e = index.posting_lists(rows, block=block).select("term", F.explode("entries").alias("e")).select("term", "e.*")
                got = index.unpacked(index.posting_lists(rows, block=block, packed=True))
                assert got.schema == e.select(got.columns).schema and set(got.columns) == set(e.columns)
                assert sorted(map(repr, got.select(e.columns).collect())) == sorted(map(repr, e.collect()))
    assert index.unpacked(index.posting_lists(rows.limit(0), packed=True)).count() == 0


def test_numbers_come_back_from_bytes():
    import numpy as np

    coded, decoded, signed, unsigned = index._coders()
    edges = np.array([s * (2**k) + d for k in range(62) for s in (1, -1) for d in (-1, 0, 1)] + [2**63 - 1, -(2**63)], np.int64)
    for v in (edges, edges[:0], np.zeros(3, np.int64), np.arange(-200, 200)):
        data, at = coded(signed(v))
        back, ends = decoded(data)
        assert (unsigned(back) == v).all() and (ends == at[1:]).all()


def test_stored_lists_have_no_nested_values(spark, papers, tmp_path):
    """A value of a nested column cost as much as a whole list does in bytes."""
    c = index.Collection(spark, f"file://{tmp_path}/p", modes=["ci"])
    c.build(papers)
    stored = dict(spark.read.parquet(f"{c.path}/postings").dtypes)
    assert stored.pop("term") == "string" and stored.pop("doc_id") == "bigint"
    assert {stored[n] for n in ("units", "positions")} == {"binary"} and not any(x.startswith("array") for x in stored.values())


def test_an_index_is_built_by_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    """Files were packed to about one task a core, and the one left over ran alone."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    monkeypatch.setattr(index, "SPLIT", 1 << 16)
    docs = spark.range(4000).selectExpr("id doc_id", "concat_ws(' ', transform(sequence(1, 40), k -> sha2(concat(id, ':', k), 256))) text").coalesce(2)
    c = index.Collection(spark, f"file://{tmp_path}/s", modes=["ci"], kinds=["document"])
    c.build(docs)
    assert len(list((tmp_path / "s" / "postings").rglob("part-*.parquet"))) > 16 and spark.conf.get(key) == before
    assert c.lengths().agg(F.count("*"), F.sum("n_terms")).first()[:] == (4000, 160000)


def test_details_are_cleaned_once_and_in_order(spark, papers):
    """Below the sort, texts were cleaned for its sample of rows and then again."""
    hits = search.search(Query(keyword="dna OR binding", corpora=["C. elegans", "S. cerevisiae"]), papers)
    docs = papers.withColumn("text", F.concat(F.lit("<b> "), "text", F.lit("\n </b>")))
    got = details.details(hits, docs, include=["text"], remove_tags=True, remove_newlines=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_replace") < plan.index("Sort [")
    scores = [(-r["score"], r["doc_id"]) for r in got.collect()]
    assert scores == sorted(scores) and {r["doc_id"]: r["text"] for r in got.collect()} == {r["doc_id"]: r["text"] for r in papers.collect()}


def test_sentence_breaks_are_those_of_the_pattern_that_looks_back_everywhere(spark):
    plain = "(?:(?<![(>\\s][A-Z])(?<![(>\\s](?:Dr|[Ee]x|[Nn]o|[Vv]s|al|ca))(?<![(>\\s](?:[Ff]ig|[Vv]ol|i\\.e|e\\.g))\\.|[!?])[\\n\\t <]"
    texts = ["(A. b", "A. b", " Dr. x! Ex. y? z. <", " i.e. a. b e.g. c al. d (Fig. 3. Vol.\n x", ">ca. x.. y .! z", " A. b \x0bA. c", "", ".", ". ", "A!. b A?. c", " No! vs? \U0001d400. A. \U0001d400. x", "x. A. B. y.\tz"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string")
    assert rows.where(~F.split("text", plain, -1).eqNullSafe(F.split("text", fx.SENTENCE_BREAK, -1))).isEmpty()
    assert fx.SENTENCE_BREAK.startswith("[.!?]")  # a pattern that starts with a look-back tries it at every character


def test_stored_files_are_small(spark, papers, tmp_path):
    c = index.Collection(spark, f"file://{tmp_path}/z", modes=["ci"])
    c.build(papers)
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "z").rglob("part-*"))


def test_a_kind_is_indexed_when_asked_for(spark, papers, tmp_path):
    c = index.Collection(spark, f"file://{tmp_path}/k", modes=["ci"], kinds=["document"])
    c.build(papers)
    q = {"keyword": "dna", "corpora": ["C. elegans"]}
    assert [r["identifier"] for r in search.search(Query(**q), collection=c).collect()] == [1] and not (tmp_path / "k" / "sentences").exists()
    with pytest.raises(ValueError, match="sentence"):
        search.search(Query(kind="sentence", **q), collection=c)
    c.remove([2])
    c.extend("sentence")
    assert [len(r["matching_sentences"]) for r in search.search(Query(kind="sentence", **q), collection=c).collect()] == [2]
    assert c.sentences().where("doc_id = 2").isEmpty() and c.lengths("sentence").count() == 3


def test_compaction_copies_stored_sentences(spark, papers, tmp_path, monkeypatch):
    c = index.Collection(spark, f"file://{tmp_path}/t", modes=[], kinds=["sentence"])
    c.build(papers)
    c.remove([1])
    monkeypatch.setattr(index, "sentences", lambda docs: pytest.fail("split again"))
    c.compact()
    c.vacuum()
    assert sorted(r["doc_id"] for r in c.sentences().collect()) == [2, 2, 3] and not (tmp_path / "t" / "postings").exists()


def test_a_sentence_search_reads_no_row_of_other_sentences(spark, papers, tmp_path):
    """A row per unit, small in a file and large in memory, was a join's side and could be broadcast."""
    c = index.Collection(spark, f"file://{tmp_path}/n", modes=["ci"])
    c.build(papers.unionByName(papers.limit(1).withColumn("doc_id", F.lit(9).cast("long")).withColumn("text", F.lit(None).cast("string"))))
    hits = search.search(Query(kind="sentence", keyword="dna", corpora=["C. elegans"]), collection=c)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(hits._jdf.queryExecution(), "formatted")
    assert not any("/lengths/" in p and "n_terms" in p for p in plan.split("\n\n") if "Scan parquet" in p)
    # a document without a text is in no answer, also not by what it lacks
    assert [r["identifier"] for r in search.search(Query(exclude_keyword="dna", corpora=["C. elegans"]), collection=c).collect()] == [2]


def test_stream_keeps_the_newest(spark, tmp_path):
    schema, source, out = "doc_id long, text string", f"{tmp_path}/in", f"{tmp_path}/out"
    for batch in ([(1, "old text."), (2, "two.")], [(1, "new text. More.")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.index_stream(incremental.watch(spark, source, schema), out, f"{tmp_path}/ck").awaitTermination()
    assert {(r["doc_id"], r["text"]) for r in incremental.latest(spark, out).collect()} == {(1, "new text. More."), (2, "two.")}
    assert incremental.latest(spark, out, "sentences").count() == 3
    assert incremental.latest(spark, out, "postings").where("term = 'old'").isEmpty()


def test_corpora(spark, papers):
    counted = corpora.all_counts(papers)
    assert corpora.count_of(counted, "C. elegans").first()["n"] == 2
    assert corpora.count_of(counted, "unheard of").first()["n"] == 0
    assert {r["corpus"] for r in corpora.additional_corpora(counted).collect()} == {"S. cerevisiae"}
    assert len(corpora.known_corpora()) == 42
    assert one(spark, "none of these", corpora.classify) == [corpora.UNCLASSIFIED]


# --- records and files


def test_bib_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "p.bib").write_bytes("year|2007-05\nauthor|A; B\nabstract|one | two\ntitle|<italic>T</italic>\n".encode())
    r = bib.read_bib(spark, str(tmp_path)).first()
    assert (r["author"], r["year"], r["abstract"], r["title"], r["journal"]) == ("A; B", "2007-05", "one | two", "<italic>T</italic>", "")
    bib.write_bib(bib.read_bib(spark, str(tmp_path)), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 8


def test_article_fields(spark):
    xml = '<article article-type="review"><article-id pub-id-type="pmc">77</article-id><article-title>T</article-title><contrib-group><surname>A</surname> <given-names>B</given-names><surname>C</surname> <given-names>D</given-names></contrib-group><volume>4</volume><abstract x="1">\nText</abstract></article>'
    r = one(spark, xml, bib.extract)
    assert (r["author"], r["accession"], r["type"], r["title"], r["citation"], r["abstract"], r["year"]) == ("A B, C D", "PMC       77", "review", "T", "V : 4 ", "Text", "")


def test_small_files(spark, tmp_path):
    (tmp_path / "lex").write_text("C. elegans\torganism\tx\nno tab\n")
    assert [tuple(r) for r in files.read_lexicon_tsv(spark, f"{tmp_path}/lex").collect()] == [("C. elegans", "organism\tx")]
    (tmp_path / "stop").write_text("The of\nAND, of\n")
    assert {r["word"] for r in files.read_stop_words(spark, f"{tmp_path}/stop").collect()} == {"the", "of", "and"}
    (tmp_path / "m").write_text("0 1.5 3 2\n")
    assert [tuple(r)[1:] for r in files.sparse_matrix(files.read_matrix(spark, f"{tmp_path}/m")).collect()] == [(0, 1.5), (3, 2.0)]
    folder = tmp_path / "cas" / "C. elegans" / "P1"
    folder.mkdir(parents=True)
    xmi = '<xmi:XMI><t:token xmi:id="1" begin="0" end="2" content="ab"/><cas:Sofa sofaString="ab cd"/></xmi:XMI>'
    (folder / "P1.tpcas.gz").write_bytes(gzip.compress(xmi.encode()))
    assert [(r["paper"], r["corpus"].replace("%20", " ")) for r in files.list_annotated(spark, f"{tmp_path}/cas").collect()] == [("P1", "C. elegans")]
    r = files.read_xmi(spark, f"{tmp_path}/cas").first()
    assert r["text"] == "ab cd" and [(a["type"], a["begin"], a["end"], a["content"]) for a in r["annotations"]] == [("token", 0, 2, "ab")]
    edges = spark.createDataFrame([("root", "a"), ("a", "b")], "parent string, child string")
    assert [tuple(r) for r in files.category_edges(edges).collect()] == [("a", "b")]
    keys = files.attribute_keys(spark.createDataFrame([("Type=x dir=y",), ("none",)], "attributes string"))
    assert sorted(r["key"] for r in keys.collect()) == ["dir", "type"]
    with pytest.raises(ValueError):
        files.read_jdbc(spark, "jdbc:x", "t; drop table t", ["a"])


# --- layout


def test_page_layout(spark):
    rows = [(1, 1, 0.0, 9.0, 4.0, 0.0, "F", 10.0, 4.0, 2, 0, "He"), (1, 2, 4.0, 9.0, 6.0, 0.0, "F", 10.0, 6.0, 3, 0, "llo"), (1, 3, 14.0, 9.0, 6.0, 0.0, "F", 10.0, 6.0, 3, 0, "you"), (1, 4, 0.0, 4.0, 6.0, 0.0, "G", 12.0, 6.0, 3, 0, "low")]
    e = spark.createDataFrame(rows, "page int, seq int, x double, y double, dx double, dy double, font string, font_size double, width double, n_chars int, n_spaces int, text string")
    tagged = layout.cluster_tags(layout.cluster_totals(layout.clusters(e)))
    assert layout.page_text(tagged).first()["text"] == "Hello you\nlow"
    assert any("_fnc=G" in t for r in tagged.collect() for t in r["tags"])
    links = spark.createDataFrame([(1, "u", 0.0, 8.0, 11.0, 2.0)], "page int, uri string, left double, bottom double, width double, height double")
    assert layout.link_texts(links, e).first()["text"] == "Hello"
    assert [r["seq"] for r in layout.sorted_chain(e).orderBy("ordinal").collect()] == [1, 2, 3, 4]
    assert sorted(r["seq"] for r in layout.reading_order(e, 100.0, 50.0).collect()) == [1, 2, 3, 4]
    near = layout.near_bridge(e, spark.createDataFrame([(1, 7.0)], "page int, y double"))
    assert sorted(r["seq"] for r in near.collect()) == [1, 2, 3, 4]
    assert layout.near_bridge(e, spark.createDataFrame([(1, 13.9)], "page int, y double")).count() == 3


# --- similarity


def test_pairs_components_and_svd(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "vec_id long, embedding array<double>")
    half = 2**-0.5
    got = {(r["i"], r["j"]): r["cos"] for r in lsa.block_pairs(v, 0.5, rows_per_block=2).collect()}
    assert got == pytest.approx({(1, 2): half, (2, 4): half})
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "i long, j long")
    labels = {r["node"]: r["component"] for r in lsa.components(chain).collect()}
    assert labels == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}
    m = spark.createDataFrame([(0, 0, 3.0), (1, 1, -2.0)], "row long, col long, value double")
    _, s, _ = lsa.svd(m, 5)
    assert s.tolist() == pytest.approx([3.0, 2.0])
    assert sorted(lsa.symmetric_eigen(m, 2)[0].tolist()) == pytest.approx([-2.0, 3.0])


def test_links_connect_what_pairs_do_and_are_few(spark):
    import numpy as np

    r = np.random.default_rng(3)
    near = [(int(k), (r.normal(size=3) + (5.0 * (k % 4 == 0))).tolist()) for k in r.permutation(2300)]
    far = [(9000 + k, [0.0] * (3 + k) + [1.0] + [0.0] * (8 - k)) for k in range(5)]  # on their own, and a zero vector
    rows = [(k, [float(x) for x in v] + [0.0] * 9) for k, v in near] + [(k, v) for k, v in far] + [(9100, [0.0] * 12)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    m = np.array([x for _, x in rows], np.float32).astype(float)
    norm = np.sqrt((m * m).sum(1))
    unit, ids = m / np.where(norm > 0, norm, 1)[:, None], np.array([k for k, _ in rows])
    x, y = np.nonzero(np.triu(unit @ unit.T > 0.99999, 1))
    expected = {(min(a, b), max(a, b)) for a, b in zip(ids[x].tolist(), ids[y].tolist(), strict=True)}
    for size in (300, 700, 16384):  # 8, 4 and 2 blocks
        pairs = lsa.block_pairs(v, 0.99999, rows_per_block=size).collect()
        assert {(p["i"], p["j"]) for p in pairs} == expected and len(pairs) == len(expected)
        links = lsa.block_links(v, 0.99999, rows_per_block=size)
        assert links.count() < len(rows) * 8
        of = lambda pairs: {q["node"]: q["component"] for q in lsa.components(pairs).collect()}
        assert of(links) == of(spark.createDataFrame(sorted(expected), "i long, j long"))


def test_xmi_files_keep_text_and_offsets(spark, tmp_path):
    text = "a & b < c > \"d\" 'e'\n\tend \U0001f600"
    note = ("Token", 0, len(text), "a & b", "x\ny", None, "c<d", None)
    kinds = "name string, text string, annotations array<struct<type:string,begin:int,end:int,content:string,value:string,term:string,category:string,tagtype:string>>"
    files.write_xmi(spark.createDataFrame([("one", text, [note, note]), ("two", "", [])], kinds), f"file://{tmp_path}/x")
    got = {r["path"].split("/")[-2]: r for r in files.read_xmi(spark, f"file://{tmp_path}/x").collect()}
    assert got["name=one"]["text"] == text and [tuple(a) for a in got["name=one"]["annotations"]] == [note, note]
    assert got["name=two"]["text"] == "" and got["name=two"]["annotations"] == []
    odd = spark.createDataFrame([("&#x1F600;&amp;lt; &nope; & &#65;&#10;&#99999999;",)], "t string").select(fx.decoded_entities(F.col("t"))).first()[0]
    assert odd == "\U0001f600&lt; &nope; & A\n&#99999999;"


def test_matrix_rows_are_numbered_through_splits(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for k in range(3):
        (tmp_path / "m" / f"{k}.txt").write_text("".join(f"{k * 400 + i} 1.5\n" for i in range(400)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        rows = files.read_matrix(spark, f"file://{tmp_path}/m").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["row"], r["values"]) for r in rows) == [(i, [float(i), 1.5]) for i in range(1200)]


def test_hash_against_a_plain_loop(spark):
    texts = ["", "a", "dna", "ß\U0001f600x", "long " * 300, None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(fx.fnv(F.col("t"))).collect()]
    for t, h in zip(texts, got, strict=True):
        if t is None:
            assert h is None
            continue
        value, data = 0xCBF29CE484222325, t.encode("utf-16-le")
        for i in range(0, len(data), 2):
            value = (value ^ int.from_bytes(data[i : i + 2], "little")) * 0x100000001B3 % 2**64
        assert h == f"{value:016x}"


def test_a_folder_that_is_not_shared_is_an_error_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from folium.session import shared_root

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="yarn", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_stream_batch_with_one_id_twice(spark, tmp_path):
    rows = [(1, f"version {k}.") for k in range(20)]
    kept = set()
    for name, own in (("a", rows), ("b", rows[::-1])):
        spark.createDataFrame(own, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/{name}/in")
        incremental.index_stream(incremental.watch(spark, f"{tmp_path}/{name}/in", "doc_id long, text string"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/ck").awaitTermination()
        kept |= {r["text"] for r in incremental.latest(spark, f"{tmp_path}/{name}/out").collect()}
    assert len(kept) == 1


def test_analysis_by_command_line(spark, tmp_path):
    import numpy as np

    from folium import lsa_cli

    texts = {"a": "worm gene worm", "b": "worm gene", "c": "yeast cell", "d": "yeast cell cell", "e": ""}
    spark.createDataFrame(list(texts.items()), "name string, text string").repartition(3).write.parquet(f"file://{tmp_path}/docs")
    folder = f"{tmp_path}/out"
    lsa_cli.main([f"file://{folder}", "-c", "a", "--docs", f"file://{tmp_path}/docs", "-r", "2", "-t", "-1", "-u", "-s", "-v"], spark)
    lines = lambda kind: [r[0] for r in spark.read.text(f"file://{folder}/{kind}").collect()]
    assert sorted(lines("DOC2ID")) == [f"{n}\t{i}" for i, n in enumerate("abcde")]
    ids = dict(x.split("\t") for x in lines("WD2ID"))
    m = np.zeros((5, len(ids)))
    for i, t in enumerate(texts.values()):
        for w in t.split():
            m[i, int(ids["token:" + w])] += 1
    gf, n = m.sum(axis=0), len(ids)
    e = np.where(m > 0, m * np.log(np.maximum(m, 1)), 0).sum(axis=0)
    f = np.log1p(m) * (1 - (e - gf * np.log(gf)) / (np.log(n) * gf))
    assert sorted(map(float, lines("S")), reverse=True) == pytest.approx(np.linalg.svd(f, compute_uv=False)[:2].tolist(), abs=1e-5)
    cos = {tuple(map(int, x.split()[:2])): float(x.split()[2]) for x in lines("SCA")}
    assert cos[0, 1] == pytest.approx(1, abs=1e-3) and abs(cos[0, 2]) < 1e-3 and len(lines("U")) == 4 and len(lines("V")) == n
    lsa_cli.main([f"file://{folder}", "-c", "sd", "-t", "0.9"], spark)
    assert sorted(lines("SIM")) == ["a\tb", "c\td"] and sorted(lines("SET")) == ["0\ta", "0\tb", "2\tc", "2\td"]
    (tmp_path / "out" / "EXC").mkdir()
    (tmp_path / "out" / "EXC" / "names.txt").write_text("b d\n")
    lsa_cli.main([f"file://{folder}", "-c", "c", "-r", "2", "-t", "0.9", "-e"], spark)
    assert lines("SCA") == []
