"""Dictionaries: category hierarchy, expansion, matching in text, category strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.text import TOKEN_BREAK, words
from folium.session import shared_root

OWN_PREFIX = "pAaCh"


def ancestors(edges: DataFrame) -> DataFrame:
    """``category, ancestor``: the transitive closure of ``parent, child``, without duplicates and safe on cycles.

    A round joins the pairs found last with all found and keeps what is new, so paths double until nothing is new;
    rounds are cut by checkpoints.
    """
    spark = edges.sparkSession
    shared_root(spark)
    step = edges.select(F.col("child").alias("category"), F.col("parent").alias("ancestor")).distinct()
    found = fresh = step.checkpoint()
    while True:
        onward = found.select(F.col("category").alias("ancestor"), F.col("ancestor").alias("above"))
        grown = fresh.join(onward, "ancestor").select("category", F.col("above").alias("ancestor")).distinct()
        fresh = grown.join(found, ["category", "ancestor"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh).checkpoint()


def expand(lexicon: DataFrame, closure: DataFrame) -> DataFrame:
    """Terms under their category, under its own-parent mark, and under the marks of all ancestors."""
    mark = lambda c: F.concat(F.lit(OWN_PREFIX), c)
    own = lexicon.select("term", mark(F.col("category")).alias("category"))
    above = lexicon.join(closure, "category").select("term", mark(F.col("ancestor")).alias("category"))
    return lexicon.select("term", "category").unionByName(own).unionByName(above).distinct()


def match(docs: DataFrame, lexicon: DataFrame, stop_words: DataFrame | None = None, key: str = "doc_id", text: str = "text", at_start: bool = False) -> DataFrame:
    """Every place where a term stands between token breaks: ``key, begin, end, term, category``.

    Texts are cut at token breaks that are kept as pieces; a term of n pieces can only be n pieces in a row. For each
    piece count that occurs in the lexicon the runs of that many pieces are joined with the terms; Spark broadcasts the
    lexicon if it is small. A term right at the start is found only with ``at_start``, as matching starts behind a
    break. Matches that equal a stop word are left out. Runs and offsets are made within the row, for a batch of rows at
    once in Arrow: before the join nothing is shuffled.
    """
    marked = lambda c: F.filter(F.split(F.regexp_replace(c, f"({TOKEN_BREAK})", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    lex = lexicon.select("term", "category").where("term <> ''").distinct().withColumn("pieces", F.size(marked(F.col("term"))))
    # a handful of numbers: how many pieces terms have
    lengths = sorted(r[0] for r in lex.select("pieces").distinct().collect())

    @F.arrow_udf("array<struct<pieces:int,begin:int,term:string>>")
    def runs(v):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        edges = v.offsets.to_numpy().astype(np.int64)
        pieces = v.values.slice(edges[0], edges[-1] - edges[0])
        edges = edges - edges[0]
        n, doc = len(pieces), np.repeat(np.arange(len(v)), np.diff(edges))
        coded, place = pieces.dictionary_encode(), np.arange(n)
        mark = pc.match_substring_regex(coded.dictionary, f"^(?:{TOKEN_BREAK})$").to_numpy(zero_copy_only=False)[coded.indices.to_numpy()] if n else np.zeros(0, bool)
        length = pc.utf8_length(pieces).to_numpy().astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        begin = before[:-1] - before[edges[:-1]][doc]
        stop = edges[1:][doc]
        starts = np.where(place == edges[:-1][doc], at_start, mark[place - 1])
        rows = [(np.zeros(0, np.int64), 0, pa.array([], pieces.type))]
        for k in lengths:
            ends = (place + k == stop) | (place + k < stop) & mark[np.minimum(place + k, max(n - 1, 0))]
            at = np.flatnonzero(starts & ends)
            parts = [pieces.take(pa.array(at + j)) for j in range(k)]
            rows.append((at, k, parts[0] if k == 1 else pc.binary_join_element_wise(*parts, "")))
        at = np.concatenate([r[0] for r in rows])
        order = np.argsort(doc[at], kind="stable")
        count = np.concatenate([np.full(len(r[0]), r[1]) for r in rows])[order]
        terms = pa.concat_arrays([r[2].cast(pa.string()) for r in rows]).take(pa.array(order))
        found = pa.StructArray.from_arrays([pa.array(count, pa.int32()), pa.array(begin[at[order]], pa.int32()), terms], names=["pieces", "begin", "term"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=len(v)))]), pa.int32()), found)

    found = docs.select(key, F.explode(runs(marked(F.coalesce(F.col(text), F.lit(""))))).alias("r")).select(key, "r.pieces", "r.begin", "r.term")
    out = found.join(lex, ["pieces", "term"])
    if stop_words is not None:
        out = out.join(stop_words.select(F.col("word").alias("term")), "term", "left_anti")
    return out.select(key, "begin", (F.col("begin") + F.length("term")).alias("end"), "term", "category").distinct()


def category_rows(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every non-empty word with its categories, sorted and joined by ``|``, ``NA`` where it has none. Single words only, case matters."""
    per_term = lexicon.groupBy("term").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("cat"))
    found = docs.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).where("word <> ''")
    return found.join(per_term, found["word"] == per_term["term"], "left").select(key, "pos", "word", F.coalesce("cat", F.lit("NA")).alias("cat"))


def category_strings(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, cats``: the words' categories in order, joined by tabs."""
    rows = category_rows(docs, lexicon, key, text)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "cat"))), lambda s: s["cat"]), "\t").alias("cats"))


def words_in_category(docs: DataFrame, lexicon: DataFrame, category: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, word``: distinct words of each document that carry the category."""
    own = lexicon.where(F.col("category") == category).select(F.col("term").alias("word")).distinct()
    return docs.select(key, F.explode(words(F.col(text))).alias("word")).join(own, "word", "left_semi").select(key, "word").distinct()


def category_mapping(annotations: DataFrame) -> DataFrame:
    """Distinct categories of each term of a document, in the order they first appear."""
    first = annotations.groupBy("doc_id", "term", "category").agg(F.min("begin").alias("begin"))
    return first.groupBy("doc_id", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("begin", "category"))), lambda s: s["category"]).alias("categories"))


def lexical_postings(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document, category and term the places ``b,e|b,e`` and their number, the boost."""
    place = F.concat_ws(",", F.col("begin").cast("string"), F.col("end").cast("string"))
    return matches.groupBy(key, "category", "term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "end", place.alias("s")))), lambda s: s["s"]), "|").alias("positions"), F.count("*").alias("boost"))


def with_categories(docs: DataFrame, lexicon: DataFrame, categories: list[str], match_all: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with words of all, or any, of the categories: ``key, n_categories``."""
    own = lexicon.where(F.col("category").isin(categories)).select("term", "category").distinct()
    hits = docs.select(key, F.explode(words(F.col(text))).alias("term")).join(own, "term").groupBy(key).agg(F.countDistinct("category").alias("n_categories"))
    return hits.where(F.col("n_categories") >= (len(set(categories)) if match_all else 1))
