"""Document fingerprints by winnowing.

Hashes of all runs of ``K`` code points, the least hash of every window of ``W`` of them (of equal ones the rightmost)
and its position: two texts that share a run of ``K + W - 1`` code points share a selected hash, and the positions say
where. A text with fewer runs than a window has one window; one shorter than ``K`` is a single run; an empty one has none.

``fingerprint_pairs`` pairs every document with the next one in falling ``doc_id`` order. Rows are dealt to ranges of
ids by binary search in a worker, each range also gets the first row of the next, so one shuffle of the texts suffices
and no task sees more than its ranges. Ranges are made for the input's size; the rows of one id are one range.

Defined results: null text reads as empty; null ``doc_id`` comes last in falling order; rows with one id go by text; a single row is
followed by itself; two empty fingerprints have likeness 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm._io import text_column
from folium.session import ship

K, W = 16, 32
RANGE_BYTES, MOST_RANGES = 1 << 24, 200_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_NO_ID = -(2**63)


def _run_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the ``k`` (a power of two) values from each place on; the last ``k - 1`` mean nothing."""
    h = (c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    factor, reach = 0x100000001B3, 1
    while reach < k:
        nxt = h * np.uint64(factor)
        nxt[:-reach] += h[reach:]
        h, factor, reach = nxt, factor * factor & 0xFFFFFFFFFFFFFFFF, reach * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def winnow(texts: list[str], k: int = K, w: int = W) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the selected hashes (uint64 below 2^32) and their positions, in order of position. ``k``, ``w``: powers of two."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    pad = np.zeros(k + w, np.uint32)
    c = np.concatenate([np.frombuffer(data, np.uint32), pad])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.cumsum(sizes) - sizes
    key = _run_hashes(c, k) << np.uint64(32) | (_LOW - np.arange(len(c), dtype=np.uint64))
    least, reach = key.copy(), 1
    while reach < w:
        nxt = least.copy()
        np.minimum(least[:-reach], least[reach:], out=nxt[:-reach])
        least, reach = nxt, reach * 2
    out = []
    for s, n in zip(start.tolist(), sizes.tolist(), strict=True):
        if n >= k + w - 1:
            m = least[s : s + n - k - w + 2]
            m = m[np.concatenate([[True], m[1:] != m[:-1]])]
        elif n >= k:
            m = key[s : s + n - k + 1].min(keepdims=True)
        elif n:
            own = np.zeros(k, np.uint32)
            own[:n] = c[s : s + n]
            own[-1] ^= np.uint32(n << 24)
            m = _run_hashes(np.concatenate([own, own]), k)[:1] << np.uint64(32) | (_LOW - np.uint64(s))
        else:
            m = np.empty(0, np.uint64)
        out.append((m >> np.uint64(32), (_LOW - (m & _LOW)).astype(np.int64) - s))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """A fingerprint's hashes and positions as 32 hex digits."""
    return hashlib.md5(hashes.astype("<u4").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_selected", pa.int64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_selected long"


def _compared(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    marks = winnow([*texts, *changed, *(f for i, f in enumerate(following) if i + 1 == len(texts) or f is not texts[i + 1])])
    sets = [np.unique(h) for h, _ in marks]
    n, extra, rows = len(texts), 2 * len(texts), []
    for i in range(n):
        if i + 1 < n and following[i] is texts[i + 1]:
            nxt = sets[i + 1]
        else:
            nxt, extra = sets[extra], extra + 1
        rows.append((ids[i], len(texts[i]), hashlib.sha256(changed[i].encode("utf-8", "surrogatepass")).hexdigest(), digest(*marks[i]), digest(*marks[n + i]), likeness(sets[i], sets[n + i]), likeness(sets[i], nxt), len(marks[i][0])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)


def _pairs(batches):
    """Rows ``range, extra, doc_id, text`` by range, own rows before the extra one, in falling order of id."""
    held, ids, texts, following, size = None, [], [], [], 0
    for b in batches:
        for at, extra, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held is not None and held[0] == at:
                ids.append(held[1])
                texts.append(held[2])
                following.append(text)
                size += len(text) + len(held[2])
                if size > 1 << 19:
                    yield _compared(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
            held = None if extra else (at, key, text)
    if ids:
        yield _compared(ids, texts, following)


def _ranges(rows: DataFrame) -> int:
    """Ranges for about ``RANGE_BYTES`` of input each, by the optimizer's size of the plan, and some for each task."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 55  # without statistics it is about 2^63
    return max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // RANGE_BYTES, MOST_RANGES) if known else 0)


def fingerprint_pairs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text, with their likeness."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), text_column().alias("text"))
    ranges = ranges or _ranges(rows)
    edges = np.array(sorted({int(q) for q in rows.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges)}) if ranges > 1 else [], np.int64)

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(-np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32))

    placed = rows.withColumn("at", range_of("key"))
    # one row for each range
    tops = sorted(tuple(r) for r in placed.groupBy("at").agg(F.max("key")).collect())
    first = np.array(sorted((top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)), np.int64).reshape(-1, 2)

    @F.pandas_udf("array<int>")
    def ranges_of(key):
        """The range of a row, and where it is the first of its range also the one before."""
        import pandas as pd

        k = key.to_numpy()
        own = -np.searchsorted(edges, k, side="right")
        at = np.minimum(np.searchsorted(first[:, 0], k), len(first) - 1)
        return pd.Series([[o, f] if hit else [o] for o, f, hit in zip(own.tolist(), first[at, 1].tolist(), (first[at, 0] == k).tolist(), strict=True)])

    dealt = rows.withColumn("to", ranges_of("key")).select(F.posexplode("to").alias("extra", "at"), "key", "text")
    dealt = dealt.repartition(-(-ranges // 4), "at").sortWithinPartitions("at", "extra", F.desc("key"), "text")
    return dealt.select("at", F.col("extra") > 0, F.when(F.col("key") > _NO_ID, F.col("key")).alias("doc_id"), "text").mapInArrow(_pairs, _OUT_SQL)
