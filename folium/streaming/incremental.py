"""Index maintenance from a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.operators.index import postings
from folium.operators.annotate import sentences


def watch(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_stream(docs: DataFrame, path: str, checkpoint: str):
    """Adds each batch's documents, sentences and postings below ``path``; a batch that runs again replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        # of one id's rows in a batch, which has no order, the one with the least hash
        columns = [F.col(c) for c in batch.columns]
        once = batch.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*").persist()
        for name, rows in (("docs", once), ("sentences", sentences(once)), ("postings", postings(once))):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        once.unpersist()

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, name: str = "docs") -> DataFrame:
    """The table as of the last batch: of a document added again, its newest rows."""
    rows = spark.read.parquet(f"{path}/{name}")
    newest = spark.read.parquet(f"{path}/docs").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["doc_id", "batch"], "left_semi").drop("batch")
