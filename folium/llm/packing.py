"""Packing documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows and one remaining piece. Remaining pieces differ only by length, so the
whole packing follows from a histogram of at most ``capacity - 1`` counts: for the longest length left, a subset-sum
dynamic program over bitsets finds the multiset of remaining lengths that fills the window closest to capacity, and
that pattern is used as often as the counts allow. The plan, a bounded table of length intervals, is made on the
driver; pieces find their sequence by their rank among those of equal length.

Defined results: null text reads as empty; a document has at least the end id, so every row yields a piece; repeated
rows are packed one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm._io import materialize, portions, text_column, trim
from folium.llm.tokens import SLICE, encoder
from folium.session import ship

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
ROWS_A_GROUP = 50_000


def fill(counts: dict[int, int], capacity: int, seed: int) -> dict[int, int]:
    """The multiset with ``seed`` in it whose sum is nearest to ``capacity``: subset sums as bits of an integer."""
    room, full = capacity - seed, (1 << (capacity - seed + 1)) - 1
    reach, trail = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == seed), room // length if length else 0)
        if left <= 0:
            continue
        step = 1
        while left > 0:
            take = min(step, left)
            grown = (reach | reach << take * length) & full
            if grown != reach:
                trail.append((length, take, reach))
                reach = grown
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows ``(length, first rank, end rank, first sequence, pieces of it per sequence, first offset)`` and the sequences used."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    taken: dict[int, int] = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while counts:
        used = fill(counts, capacity, max(counts))
        times = min(counts[k] // n for k, n in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, taken[length], taken[length] + n * times, sequence, n, offset))
            taken[length] += n * times
            offset += n * length
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows, sequence


def _cutter(model, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(model.value)
        for part in portions(batches, limit=SLICE):
            flat, counts = enc.encode(part.column("text").to_pylist())
            counts = counts + 1
            ids = np.insert(flat, np.cumsum(counts - 1), end_id).astype("<u4")
            doc, start, length, at = cuts(counts, capacity)
            data = memoryview(ids.tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(doc)), *(pa.array(c, pa.int64()) for c in (start, length, crc, counts[doc]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PIECES)
        trim()

    return run


def cuts(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Full windows and the remaining piece of each document of so many ids: document, start, length, place among all ids."""
    n = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * capacity
    return doc, start, np.minimum(capacity, counts[doc] - start), (np.cumsum(counts) - counts)[doc] + start


def _placer(rows: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    lengths, first = table[:, 0], table[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for v in np.unique(length):
                lo, hi = np.searchsorted(lengths, [v, v + 1])
                own = length == v
                at[own] = lo + np.searchsorted(first[lo:hi], rank[own], side="right") - 1
            row = table[at]
            k = rank - row[:, 1]
            cols = [b.column(n) for n in _PIECES.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)], names=[*_PIECES.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_json: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer_json)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(_cutter(model, end_id, capacity), _PIECE)
    pieces = materialize(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    # at most ``capacity`` rows, here and where they are broadcast
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # ranks within a length, in groups of a length and a share, so that a common length is many groups
    shares = spark.createDataFrame([(k, -(-n // ROWS_A_GROUP)) for k, n in sorted(histogram.items())], "length long, shares long")
    salted = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")))
    sizes = materialize(salted.groupBy("length", "share").agg(F.count("*").alias("n")), "sizes")
    rows, _ = plan(histogram, capacity)
    before = sizes.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "share").orderBy("doc_id", "start", "row")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(before, ["length", "share"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    return ranked.select(*_PIECES.names, "rank").mapInArrow(_placer(rows), f"{_PIECE}, sequence_id long, offset long")
