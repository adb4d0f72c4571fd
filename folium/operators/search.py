"""Ranked boolean search over documents or sentences.

A search analyzes its words as texts are analyzed: tokens of letters and digits, lower case unless asked otherwise,
without stop words. It runs over a stored ``Collection``, where the filter on terms reaches the files of postings and
only units with one of the words are looked at, or over plain texts, which it splits as it reads them; both give the
same rows. Predicates and scores work on one row per unit with the counts of the query's leaves; document frequencies are
a one-row aggregate over them.

Score of a unit: the sum over matching leaves of ``sqrt(tf) * idf^2 / sqrt(length)`` with ``idf = 1 + ln(N / (df + 1))``,
``N`` the units searched in and ``length`` the unit's terms; a wildcard adds 1. ``coord`` multiplies by the share of
leaves that match. Ties go by ``doc_id``. All hits are returned unless a caller asks for the first ``limit`` of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import DEFAULT_STOP_WORDS, analyzed, analyzed_places
from folium.operators.annotate import sentences
from folium.plans.query import Group, Leaf, Query, analyzed_tree, parse


def _phrase_count(t: Column, leaf: Leaf) -> Column:
    """Places where the words stand as far apart as asked. The array is not named inside a lambda: a filter pushed below
    its projection would then split the text again for every word."""
    is_word = lambda word: lambda w: F.coalesce(w == word, F.lit(False))
    hits = F.transform(t, is_word(leaf.words[0]))
    for k, word in zip(leaf.steps()[1:], leaf.words[1:], strict=True):
        later = F.transform(F.slice(t, k + 1, F.size(t)), is_word(word))
        hits = F.zip_with(hits, later, lambda a, b: a & F.coalesce(b, F.lit(False)))
    return F.size(F.filter(hits, lambda hit: hit))


def leaf_count(t: Column, leaf: Leaf) -> Column:
    """How often a leaf stands in an array of terms."""
    if leaf.wildcard:
        return F.size(F.filter(t, lambda w: w.rlike(leaf.pattern())))
    if len(leaf.words) == 1:
        return F.size(F.filter(t, lambda w: w == leaf.words[0]))
    return _phrase_count(t, leaf)


def posting_count(leaf: Leaf) -> Column:
    """The same from the postings of one unit, as an aggregate."""
    if leaf.wildcard:
        return F.sum(F.when(F.col("term").rlike(leaf.pattern()), F.col("tf")).otherwise(0))
    if len(leaf.words) == 1:
        return F.sum(F.when(F.col("term") == leaf.words[0], F.col("tf")).otherwise(0))

    def moved(word: str, step: int) -> Column:
        places = F.coalesce(F.max(F.when(F.col("term") == word, F.col("positions"))), F.array().cast("array<int>"))
        return F.transform(places, lambda p: p - step)

    return F.size(reduce(F.array_intersect, (moved(w, k) for w, k in zip(leaf.words, leaf.steps(), strict=True))))


def posting_filter(leaves: list[Leaf]) -> Column:
    """A condition that every posting a leaf counts meets and that file statistics can prune by; counts do the rest."""
    words, patterns = sorted({w for leaf in leaves if not leaf.wildcard for w in leaf.words}), [leaf for leaf in leaves if leaf.wildcard]
    if any(not leaf.prefix() for leaf in patterns):
        return F.lit(True)
    wanted = [*([F.col("term").isin(words)] if words else []), *(F.col("term").startswith(leaf.prefix()) for leaf in patterns)]
    return reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False)


def holds_for_none(tree: Group) -> bool:
    """Whether a unit with none of the leaves matches."""
    one = lambda n: holds_for_none(n) if isinstance(n, Group) else False
    if any(not one(n) for n in tree.required) or any(one(n) for n in tree.excluded):
        return False
    return bool(tree.required) or not tree.optional or any(map(one, tree.optional))


def holds(tree: Group, count: dict[Leaf, Column]) -> Column:
    one = lambda n: holds(n, count) if isinstance(n, Group) else count[n] > 0
    parts = [one(n) for n in tree.required] + [~one(n) for n in tree.excluded]
    if not tree.required and tree.optional:
        parts.append(reduce(lambda a, b: a | b, map(one, tree.optional)))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _names(trees: list[Group]) -> dict[Leaf, str]:
    return {leaf: f"_tf{i}" for i, leaf in enumerate(dict.fromkeys(x for tree in trees for x in tree.leaves(False)))}


def counted_texts(units: DataFrame, names: dict[Leaf, str], case_sensitive: bool, stop_words: list[str]) -> DataFrame:
    """``units(*keys, text)`` with ``_len`` and the counts of the leaves in place of the text, which is split once."""
    t = analyzed_places(F.col("text"), stop_words, case_sensitive)
    split = units.select(*units.columns, t.alias("_t"))
    return split.select(*(F.col(k) for k in units.columns if k != "text"), F.size(F.array_compact("_t")).alias("_len"), *(leaf_count(F.col("_t"), leaf).alias(n) for leaf, n in names.items()))


def counted_postings(post: DataFrame, lengths: DataFrame, keys: list[str], names: dict[Leaf, str], every_unit: bool) -> DataFrame:
    """``keys, _len`` and the counts of the leaves for units with any of them, or for every unit that has a text."""
    found = post.where(posting_filter(list(names)) if names else F.lit(False)).groupBy(*keys).agg(F.max("n_terms").alias("_len"), *(posting_count(leaf).cast("int").alias(n) for leaf, n in names.items()))
    if not every_unit:
        return found  # lengths are in the postings: a join would read, and may broadcast, a row per unit
    own = lengths.select(*keys, F.col("n_terms").alias("_len")).where("_len is not null")
    return own.join(found.drop("_len"), keys, "left").fillna(0, list(names.values()))


def squared_idf(n: Column, df: Column) -> Column:
    """``idf^2`` of a word, for one row a search. By the C library, as in SQL engines: the JVM's logarithm can differ in its
    last bit, and products in another order do, which puts sums that are equal in one engine apart in the other."""

    @F.udf("double")
    def run(n, df):
        import math

        return math.pow(1 + math.log(n / (df + 1)), 2) if n else None

    return run(n, df)


def scored(tree: Group, names: dict[Leaf, str], coord: bool = False) -> Column:
    """Score by a unit's counts and the words' squared idf beside them."""
    leaves, total = tree.leaves(), F.lit(0.0)
    for leaf in leaves:
        tf = F.col(names[leaf])
        total = total + (F.when(tf > 0, F.lit(1.0)).otherwise(0.0) if leaf.wildcard else F.when(tf > 0, F.sqrt(tf.cast("double")) * F.col(f"{names[leaf]}_idf2") / F.sqrt(F.col("_len").cast("double"))).otherwise(0.0))
    if coord and leaves:
        total = total * reduce(lambda a, b: a + b, [(F.col(names[leaf]) > 0).cast("int") for leaf in leaves]) / len(leaves)
    return total


def _says(c: Column, value: str, q: Query, stop_words: list[str]) -> Column:
    """A bibliographic field matches a value in the query language."""
    tree = analyzed_tree(parse(value, q.case_sensitive), stop_words)
    t = analyzed_places(F.coalesce(c, F.lit("")), stop_words, q.case_sensitive)
    return holds(tree, {leaf: leaf_count(t, leaf) for leaf in tree.leaves(False)})


def _is(c: Column, value: str, q: Query, stop_words: list[str]) -> Column:
    """The field is the value, word by word; quotes around it don't count."""
    said = lambda x: analyzed(x, stop_words, q.case_sensitive)
    return said(F.coalesce(c, F.lit(""))) == said(F.lit(value.strip().strip('"')))


def document_predicate(q: Query, stop_words: list[str] = DEFAULT_STOP_WORDS) -> Column:
    """Corpus, year, accession, type, author and journal of a request."""
    wanted = [F.arrays_overlap("corpora", F.array(*map(F.lit, q.corpora)))]
    if q.year:
        wanted.append(_says(F.col("year"), q.year, q, stop_words))
    if q.accession:
        asked = F.array(*(F.lit(a if q.case_sensitive else a.lower()) for a in q.accession.split()))
        wanted.append(F.arrays_overlap(F.filter(F.split(F.col("accession") if q.case_sensitive else F.lower("accession"), "[\\s:]+"), lambda w: w != ""), asked))
    if q.paper_type:
        wanted.append(_says(F.col("type"), q.paper_type, q, stop_words))
    if q.author:
        wanted.append(_is(F.col("author"), q.author, q, stop_words) if q.exact_author else _says(F.col("author"), q.author, q, stop_words))
    if q.journal:
        wanted.append(_is(F.col("journal"), q.journal, q, stop_words) if q.exact_journal else _says(F.col("journal"), q.journal, q, stop_words))
    return reduce(lambda a, b: a & b, wanted)


def search(q: Query, docs: DataFrame | None = None, lexicon: DataFrame | None = None, doc_ids: DataFrame | None = None, sentence_rows: DataFrame | None = None, limit: int | None = None, document_type: str = "main", collection=None, stop_words: list[str] | None = None) -> DataFrame:
    """Hits of a request over ``docs(doc_id, text, corpora, year, ...)`` or a stored ``collection``: ``identifier, score, year, document_type``.

    Sentence requests group their sentences by document: the score is their sum, ``matching_sentences`` lists them by
    falling score. ``doc_ids(doc_id)`` restricts the search; ``sentence_rows`` may bring sentences made before; ``limit`` keeps the first hits only.
    """
    q.check()
    if collection is not None:
        docs, stop_words = collection.docs(), collection.stop_words
        sentence_rows = collection.sentences() if q.kind == "sentence" else None
    stop_words = DEFAULT_STOP_WORDS if stop_words is None else stop_words
    docs = docs if "year" in docs.columns else docs.withColumn("year", F.lit(None).cast("string"))
    # documents that a hit may be in; restrictions don't change what frequencies count
    allowed = docs.where(document_predicate(q, stop_words)).select("doc_id", "year")
    if doc_ids is not None:
        allowed = allowed.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    keys = ["doc_id", "sentence_id"] if q.kind == "sentence" else ["doc_id"]

    def units() -> DataFrame:
        if q.kind != "sentence":
            return docs.select("doc_id", "text")
        own = sentence_rows if sentence_rows is not None else sentences(docs.select("doc_id", "text"))
        return own.select("doc_id", "sentence_id", F.col("sentence").alias("text"))

    keyword, exclude = q.keyword, q.exclude_keyword
    if q.compat and exclude:  # only the first bare word is excluded, the others are alternatives
        first, *others = exclude.split()
        keyword, exclude = " ".join([keyword, *others]).strip(), first
    tree, without = (analyzed_tree(parse(x, q.case_sensitive), stop_words) if x else Group() for x in (keyword, exclude))
    if keyword and not tree.leaves(False):  # stop words alone match nothing
        allowed = allowed.limit(0)
    names = _names([tree, without])
    if collection is not None:
        lengths = collection.lengths(q.kind, q.case_sensitive)
        every = holds_for_none(tree)
        counted = counted_postings(collection.postings(q.kind, q.case_sensitive, posting_filter(list(names)) if names else F.lit(False)), lengths, keys, names, every)
        n_units = lengths.agg(F.count("*").alias("_n"))
    else:
        counted = counted_texts(units(), names, q.case_sensitive, stop_words)
        n_units = counted.agg(F.count("*").alias("_n"))
    # one row each
    words = [names[leaf] for leaf in tree.leaves()]
    facts = n_units.crossJoin(counted.agg(F.lit(1).alias("_one"), *(F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in words)))
    facts = facts.select(*(squared_idf(F.col("_n"), F.col(f"{n}_df")).alias(f"{n}_idf2") for n in words))
    count = {leaf: F.col(n) for leaf, n in names.items()}
    kept = counted.where(holds(tree, count)).where(~holds(without, count)) if without.leaves(False) else counted.where(holds(tree, count))
    kept = kept.join(allowed, "doc_id")
    if q.categories:
        from folium.operators.lexicon import with_categories

        if lexicon is None:
            raise ValueError("a category search needs a lexicon")
        tagged = units().join(allowed.select("doc_id"), "doc_id", "left_semi").withColumn("_unit", F.struct(*keys))
        own = with_categories(tagged, lexicon, q.categories, q.categories_and, key="_unit").select(*(F.col(f"_unit.{k}").alias(k) for k in keys))
        kept = kept.join(own.distinct(), keys, "left_semi")
    if keyword:
        hits = kept.crossJoin(F.broadcast(facts)).select(*keys, "year", scored(tree, names, q.coord).alias("score"))
    else:
        hits = kept.select(*keys, "year", F.lit(1.0).alias("score"))
    if q.kind == "sentence":
        one = F.struct("sentence_id", "score")
        order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["sentence_id"] < b["sentence_id"], -1).otherwise(1)
        hits = hits.groupBy("doc_id", "year").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(one), order).alias("matching_sentences"))
    shown = hits.select(F.col("doc_id").alias("identifier"), "score", "year", F.lit(document_type).alias("document_type"), *(["matching_sentences"] if q.kind == "sentence" else []))
    return in_order(shown, q.sort_by_year, limit)


def in_order(hits: DataFrame, by_year: bool = False, limit: int | None = None) -> DataFrame:
    ordered = hits.orderBy(*([F.desc_nulls_last("year")] if by_year else []), F.desc("score"), "identifier")
    return ordered if limit is None else ordered.limit(limit)


def federated(q: Query, main, external, limit: int | None = None, **kwargs) -> DataFrame:
    """Hits of two collections, stored or of plain texts, in one order, each marked with where it is from; ``limit`` holds for both together."""
    source = lambda x: {"docs": x} if isinstance(x, DataFrame) else {"collection": x}
    return in_order(search(q, **source(main), limit=limit, **kwargs).unionByName(search(q, **source(external), limit=limit, document_type="external", **kwargs)), q.sort_by_year, limit)


def summary(hits: DataFrame) -> DataFrame:
    """One row: hits, sentences, largest and smallest score; of no hits zero and nulls."""
    n = F.sum(F.size("matching_sentences")) if "matching_sentences" in hits.columns else F.count("*")
    return hits.agg(F.count("*").alias("n_hits"), F.coalesce(n, F.lit(0)).alias("n_sentences"), F.max("score").alias("max_score"), F.min("score").alias("min_score"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two summaries as one."""
    return a.unionByName(b).agg(F.sum("n_hits").alias("n_hits"), F.sum("n_sentences").alias("n_sentences"), F.max("max_score").alias("max_score"), F.min("min_score").alias("min_score"))
