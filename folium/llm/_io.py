"""Shared storage helpers: everything that one job hands to another goes through Spark's own readers and writers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.session import new_folder, ship


def drop_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in shared storage and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = path or new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a list of strings into runs of about ``limit`` characters; a longer string is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text)
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about ``limit`` bytes of a column; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def trim() -> None:
    """Gives memory that a worker doesn't use back to the machine, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def text_column(name: str = "text"):
    """A text with null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
