"""From raw documents to packed sequences: quality, exact and near duplicates, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``. Decisions are made on row numbers and
small columns; a text is moved once per stage, to meet its decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm import exact, mixing, packing, quality, simhash
from folium.llm._io import materialize, table, text_column
from folium.llm.tokens import tokenizer_file

KEEP_SCORE = 0.7


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents in shared storage, each row with a number of its own that stays the same however often it is read."""
    row = _free(docs, "row_number")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, KEEP_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    rows, row = _numbered(docs)
    kept = exact.deduplicate(rows, row=row).where("kept").select(F.col("rid").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    rows, row = _numbered(docs)
    found = simhash.near_duplicates(rows, row=row)
    single = found.where("component_size = 1").select("rid")
    # the first of a group by id and row: partial minima, no group in one task
    first = found.where("component_size > 1").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid")))["rid"].alias("rid"))
    return rows.join(single.unionByName(first.select("rid")).withColumnRenamed("rid", row), row, "left_semi").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows, row = _numbered(docs)
    times = _free(docs, "times")
    sized = rows.select("doc_id", "source", mixing.word_count(text_column()).alias("size"), F.xxhash64(text_column()).alias("tie"), F.col(row).alias("rid"))
    taken = mixing.copies(sized).where("copies > 0").select(F.col("rid").alias(row), F.expr("sequence(1, copies)").alias(times))
    return rows.join(taken, row).withColumn(times, F.explode(times)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier is trained, so SQL can't express the rows; tests hold the stages against brute force.
ORACLE_SQL = None
