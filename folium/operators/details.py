"""Details of hits: chosen columns, matching sentences, all sentences, clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.text import cleaned_details

DOCUMENT_FIELDS = ["filepath", "text", "author", "accession", "type", "title", "journal", "citation", "year", "abstract", "corpora"]
SENTENCE_FIELDS = ["sentence", "begin", "end"]
REQUIRED = ["doc_id", "year"]


def chosen_fields(include: list[str], exclude: list[str], required: list[str] = REQUIRED) -> list[str]:
    """Included fields less the excluded ones, and always the required."""
    return sorted((set(include) - set(exclude)) | set(required))


def project(docs: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, required: list[str] = REQUIRED) -> DataFrame:
    wanted = chosen_fields(include if include is not None else DOCUMENT_FIELDS, exclude or [], required)
    return docs.select(*(c for c in wanted if c in docs.columns))


def details(hits: DataFrame, docs: DataFrame, sentence_rows: DataFrame | None = None, include: list[str] | None = None, exclude: list[str] | None = None, sentence_fields: list[str] | None = None, all_sentences: bool = False, remove_tags: bool = False, remove_newlines: bool = False, by_year: bool = False) -> DataFrame:
    """Hits with document columns, with their matching sentences and, if asked, all sentences as arrays of structs.

    Three equi-joins and two grouped lists; nothing is fetched by batches of ids.
    """
    wanted = project(docs, include, exclude)
    fields = sentence_fields or SENTENCE_FIELDS
    out = hits.drop("year").withColumnRenamed("identifier", "doc_id").join(wanted, "doc_id")
    texts = [c for c in ("abstract", "text") if c in wanted.columns]
    if "matching_sentences" in hits.columns and sentence_rows is not None:
        matched = hits.select(F.col("identifier").alias("doc_id"), F.explode("matching_sentences").alias("m")).select("doc_id", "m.sentence_id", F.col("m.score").alias("score"))
        rows = matched.join(sentence_rows, ["doc_id", "sentence_id"])
        lists = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", "score", *fields))).alias("matching"))
        out = out.drop("matching_sentences").join(lists, "doc_id", "left")
        texts.append("matching")
    if all_sentences and sentence_rows is not None:
        own = sentence_rows.join(hits.select(F.col("identifier").alias("doc_id")), "doc_id", "left_semi")
        out = out.join(own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence_id", *fields))).alias("all_sentences")), "doc_id", "left")
        texts.append("all_sentences")
    out = out.orderBy(*([F.desc_nulls_last("year")] if by_year else []), F.desc("score"), "doc_id")
    # above the sort: below it, texts are cleaned for the sample of rows that it takes, and then again
    return cleaned_details(out, texts, remove_tags, remove_newlines) if remove_tags or remove_newlines else out


def one(docs: DataFrame, doc_id, include: list[str] | None = None) -> DataFrame:
    """At most one row: the document with this id."""
    return project(docs.where(F.col("doc_id") == doc_id), include).limit(1)
