"""Tokens, sentences, tags and dictionary terms as stand-off rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import SENTENCE_BREAK, TOKEN_BREAK, running, words
from folium.session import shared_root

LAYOUT_TAGS = ["_image", "_sbr", "_hbr", "_fsc", "_fnc", "_ydiff", "_cr", "_page"]


def spans(docs: DataFrame, pattern: str, width: Column | int, emit_tail: bool, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans between matches of ``pattern``: ``key, ord, begin, end, content``; empty ones go, and the text after the last match unless ``emit_tail``.

    ``width`` is the length of a match. Offsets count characters; ``ord`` counts the spans that stay, from 1. Both come from
    running sums within the row, so nothing is shuffled.
    """
    step = width if isinstance(width, Column) else F.lit(width)
    parts = docs.select(key, F.split(text, pattern, -1).alias("s"))
    placed = parts.select(key, "s", running(F.transform("s", lambda x: F.length(x) + step)).alias("stop"), running(F.transform("s", lambda x: (x != "").cast("int"))).alias("ord"))
    kept = placed if emit_tail else placed.select(key, *(F.slice(c, 1, F.greatest(F.size("s") - 1, F.lit(0))).alias(c) for c in ("s", "stop", "ord")))
    rows = kept.select(key, F.explode(F.arrays_zip("s", "stop", "ord")).alias("x")).where("x.s <> ''")
    end = F.col("x.stop") - step
    return rows.select(key, "x.ord", (end - F.length("x.s")).cast("int").alias("begin"), end.cast("int").alias("end"), F.col("x.s").alias("content"))


def sentences(docs: DataFrame, emit_tail: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sentence_id, begin, end, sentence``: ids count from 1 in document order."""
    return spans(docs, SENTENCE_BREAK, 2, emit_tail, key, text).select(key, F.col("ord").alias("sentence_id"), "begin", "end", F.col("content").alias("sentence"))


def token_spans(docs: DataFrame, emit_tail: bool = False, key: str = "doc_id", text: str = "text", delimiters: bool = True) -> DataFrame:
    """Tokens and, if asked, the delimiters between them: ``key, begin, end, content``."""
    marked = docs.select(key, F.split(text, TOKEN_BREAK, -1).alias("s"), F.regexp_extract_all(text, F.lit(TOKEN_BREAK), F.lit(0)).alias("d"))
    pieces = F.flatten(F.zip_with("s", "d", lambda s, d: F.array(s, d)))  # ends with a null, as there is one delimiter less
    placed = marked.select(key, pieces.alias("s")).select(key, "s", running(F.transform("s", lambda x: F.length(F.coalesce(x, F.lit(""))))).alias("stop"))
    rows = placed.select(key, F.size("s").alias("n"), F.posexplode(F.arrays_zip("s", "stop")).alias("pos", "x")).where("x.s <> ''")
    if not emit_tail:
        rows = rows.where("pos < n - 2")
    if not delimiters:
        rows = rows.where("pos % 2 = 0")
    return rows.select(key, (F.col("x.stop") - F.length("x.s")).alias("begin"), F.col("x.stop").alias("end"), F.col("x.s").alias("content"))


def word_positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its ordinal and offsets, by running length plus one break each."""
    placed = docs.select(key, words(F.col(text)).alias("s")).select(key, "s", running(F.transform("s", lambda x: F.length(x) + 1)).alias("stop"))
    rows = placed.select(key, F.posexplode(F.arrays_zip("s", "stop")).alias("pos", "x")).where("x.s <> ''")
    return rows.select(key, "pos", (F.col("x.stop") - 1 - F.length("x.s")).alias("begin"), (F.col("x.stop") - 1).alias("end"), F.col("x.s").alias("word"))


def layout_tags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Layout tags in order: ``key, ord, tag, tagtype, value``."""
    from folium.functions.text import layout_tag

    found = F.regexp_extract_all(text, F.lit("(?s)<_pdf (?:" + "|".join(LAYOUT_TAGS) + ").*?/>"), F.lit(0))
    return docs.select(key, F.posexplode(found).alias("ord", "tag")).withColumn("p", layout_tag(F.col("tag"))).select(key, "ord", "tag", "p.tagtype", "p.value")


def xml_elements(docs: DataFrame, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Elements called exactly ``name`` (a blank or the tag's end follows): attributes and inner text."""
    pattern = f"(?s)<{name}((?:\\s[^>]*)?)>(.*?)</{name}\\s*>"
    rows = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("attributes"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("term"))
    return docs.select(key, F.posexplode(rows).alias("ord", "x")).select(key, "ord", F.lit(name).alias("value"), F.trim("x.attributes").alias("content"), "x.term")


def tokens_outside_tags(tokens: DataFrame, tags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens that begin behind every tag that starts before them: the latest tag end is carried along.

    One pass over both inputs by a running maximum, instead of a range join.
    """
    both = tokens.select(key, "begin", "end", "content", F.lit(1).alias("kind")).unionByName(tags.select(key, "begin", "end", F.lit(None).cast("string").alias("content"), F.lit(0).alias("kind")))
    order = Window.partitionBy(key).orderBy("begin", "kind").rowsBetween(Window.unboundedPreceding, 0)
    blocked = F.max(F.when(F.col("kind") == 0, F.col("end"))).over(order)
    return both.withColumn("blocked_until", blocked).where("kind = 1 and (blocked_until is null or begin > blocked_until)").select(key, "begin", "end", "content")


def without_spans(annotations: DataFrame, removed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Annotations in a text from which spans (apart from each other) are cut: ``begin, end`` move left by what goes before them.

    Offsets inside a span move to its start. One pass over starts and ends by running sums, instead of a range join.
    """
    marks = removed.select(key, F.col("begin").alias("at"), F.lit(0).alias("kind"), F.col("begin").alias("open"), (F.col("end") - F.col("begin")).alias("size"))
    shared_root(annotations.sparkSession)
    rows = annotations.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    ends = rows.select(key, F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("kind")), F.struct(F.col("end").alias("at"), F.lit(2).alias("kind")))).alias("x"), "_row").select(key, "x.at", "x.kind", "_row")
    both = marks.withColumn("_row", F.lit(None).cast("long")).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = F.last(F.when(F.col("kind") == 0, F.struct("open", "size")), ignorenulls=True).over(order)
    inside = F.coalesce(F.greatest(last["open"] + last["size"] - F.col("at"), F.lit(0)), F.lit(0))
    placed = both.withColumn("to", F.col("at") - gone + inside).where("kind > 0")
    moved = placed.groupBy("_row").agg(F.max(F.when(F.col("kind") == 1, F.col("to"))).cast("int").alias("begin"), F.max(F.when(F.col("kind") == 2, F.col("to"))).cast("int").alias("end"))
    return rows.drop("begin", "end").join(moved, "_row").drop("_row").select(annotations.columns)


def largest_id(annotations: DataFrame, column: str = "aid") -> DataFrame:
    """One row, ``n``: the largest annotation id, 0 if there is none; new ones go on from it."""
    return annotations.agg(F.coalesce(F.max(column), F.lit(0)).cast("long").alias("n"))


def of_types(annotations: DataFrame, types: list[str]) -> DataFrame:
    """Annotations of the named types; with files partitioned by ``type`` the others aren't read."""
    return annotations.where(F.col("type").isin(types))
