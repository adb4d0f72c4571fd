"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row for each distinct text ever added. A batch is reduced to
one row per digest first (with partial sums, so a group of copies is no hot key), then deduplicated against the index
by a sort-merge anti-join in which the index isn't shuffled, and its new digests are appended.

Texts are equal when identical after lower-casing A-Z only. Of equal rows the one with the largest ``doc_id`` stays.

Defined results: null text reads as empty; a null ``doc_id`` is smaller than any other; of repeated rows with the same
``doc_id`` and text one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm._io import drop_folder, materialize, new_folder, text_column

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; a text of one byte per character goes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A persistent set of digests, ``digest binary, doc_id long``, bucketed and sorted by ``digest``.

    A new index has as many buckets as a shuffle has partitions, so a batch reduced by digest meets it as it lies.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or new_folder(spark, "index")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, doc_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the table and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_folder(self.spark, self.path)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch``, one for each digest, whose digest the index lacks."""
        return batch.hint("merge").join(self.table().select("digest"), "digest", "left_anti")

    def add(self, batch: DataFrame) -> None:
        """Append ``batch(digest, doc_id)``; it holds each digest once and none that is in the index."""
        batch.select("digest", "doc_id").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, row: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, digest, keep_id, group_size, kept``, and ``rid`` if ``row`` names a column of row numbers.

    With an ``index``, a text it holds already is kept by no row of the batch and ``keep_id`` is the index's; new
    digests are appended to it.
    """
    spark = docs.sparkSession
    rid = F.col(row) if row else F.monotonically_increasing_id()
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(text_column()).alias("digest"), rid.alias("rid")), "digests")
    own = index is None
    index = DigestIndex(spark) if own else index
    # the row that stays: largest doc_id, of repeated rows the last
    groups = rows.groupBy("digest").agg(F.max("doc_id").alias("doc_id"), F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), F.col("rid")))["rid"].alias("keep_rid"), F.count("*").alias("group_size"))
    fresh = materialize(index.fresh(groups), "fresh")
    held = index.table().select(F.col("digest"), F.col("doc_id")).join(groups.select("digest", "group_size"), "digest", "inner")
    known = fresh.select("digest", F.col("doc_id").alias("keep_id"), "keep_rid", "group_size").unionByName(held.select("digest", F.col("doc_id").alias("keep_id"), F.lit(None).cast("long").alias("keep_rid"), "group_size"))
    known = materialize(known, "known")
    index.add(fresh)
    if own:  # an index for this call alone
        index.drop()
    out = rows.join(known, "digest").select("doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept"), "rid")
    return out if row else out.drop("rid")


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
