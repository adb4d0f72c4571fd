"""SimHash near-duplicates through an inverted index of byte positions with a count filter.

Two 64-bit fingerprints at most 3 bits apart agree in at least 5 of 8 bytes, so in at least 4 of the first 7. The index
posts every distinct fingerprint under each choice of 4 of these 7 positions with the bytes found there (35 postings), so
any pair to be linked meets in some list. Within a list the bytes that a pair shares over all 8 positions are tallied,
pairs with fewer than 5 are rejected, and the rest are verified by their differing bits. Only a spanning forest of what
is verified goes on: links are never expanded into all pairs of a group.

A list of more than ``LONG`` entries isn't held in memory: its entries are posted again under a fifth position each,
which any pair that passes the tally shares. Such a list holds distinct fingerprints that differ in 3 bytes, so it has
at most 2^24 entries; long ones are linked by probing the 2324 values within 3 bits of each entry in a bitmap.

Components come from alternating large-star and small-star steps on distinct fingerprints, each step a checkpointed
table in shared storage.

Defined results: null text reads as empty; a text without words has fingerprint zero and links like any other; a null
``doc_id`` is a document but no candidate for the smallest id; repeated rows share a component; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm._io import materialize, text_column
from folium.session import ship

MAX_BITS = 3
LEAST_SHARED = 8 - MAX_BITS  # bytes that a pair to be linked shares at least
SHINGLE = 3
INDEXED = 7  # positions in the index, of which such a pair shares one less than LEAST_SHARED
CHOICES = list(combinations(range(INDEXED), LEAST_SHARED - 1))
LONG_CHOICES = list(combinations(range(8), LEAST_SHARED))
LONG = 3000
_REST_BITS = 8 * MAX_BITS


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each the majority among the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    k = n - shingle + 1
    if k <= 1:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: k - 1] + 1]).tolist()
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, k)
    votes = np.zeros(64, np.int64)
    for at in range(0, k, 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > k, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            fp = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=[*b.schema.names[:-1], "fp"])

    return run


def _key(fp: np.ndarray, choice: int, positions: tuple[int, ...]) -> np.ndarray:
    key = np.full(len(fp), choice, np.uint64)
    for p in positions:
        key = key << np.uint64(8) | (fp >> np.uint64(8 * p)) & np.uint64(255)
    return key.view(np.int64)


def _postings(batches):
    """A row for every choice of positions: the choice and its bytes as one number, and the fingerprint."""
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(fp), 50_000):
            own = fp[i : i + 50_000]
            keys = [_key(own.view(np.uint64), c, positions) for c, positions in enumerate(CHOICES)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(own, len(CHOICES)))], names=["key", "fp"])


def shared_bytes(diff: np.ndarray) -> np.ndarray:
    """The tally of a pair: positions at which its bytes are equal."""
    return 8 - np.count_nonzero(diff.view(np.uint8).reshape(-1, 8), axis=1)


def passing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the pairs that the tally lets through and whose bits then verify."""
    diff = a ^ b
    counted = np.flatnonzero(shared_bytes(diff) >= LEAST_SHARED)
    return counted[np.bitwise_count(diff[counted]) <= MAX_BITS]


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that links ``a, b`` reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while ((up := label[label]) != label).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _forest(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links between values as stars, one for each component."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _least(len(values), at[: len(a)], at[len(a) :])
    own = np.flatnonzero(label != np.arange(len(values)))
    return _found(np.zeros(len(own), np.int64), values[label[own]], values[own])


_FOUND = pa.schema([("again", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _found(again: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(again), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=_FOUND)


def _again(choice: int, fp: np.ndarray) -> pa.RecordBatch:
    """Entries of a list too long to hold, under each choice of one more position."""
    wider = [(i, p) for i, p in enumerate(LONG_CHOICES) if set(CHOICES[choice]) < set(p)]
    keys = np.concatenate([_key(fp, i + 1, p) for i, p in wider])
    values = np.tile(fp, len(wider))
    return _found(keys, values, values)


def near_in_lists(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs near each other among the values ``v`` of equal key; keys rise."""
    edges = np.concatenate([np.flatnonzero(np.diff(k)) + 1, [len(k)]])
    end = np.repeat(edges, np.diff(np.concatenate([[0], edges])))
    i, lag, left, right = np.arange(len(k)), 1, [], []
    while len(i := i[i + lag < end[i]]):
        ok = i[passing(v[i], v[i + lag])]
        left.append(v[ok])
        right.append(v[ok + lag])
        lag += 1
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _lists(batches):
    """Rows by key: complete lists, as ``key, fp`` of many; and of lists too long to hold, rows as they come."""
    k, v, long = np.empty(0, np.int64), np.empty(0, np.uint64), None
    for b in batches:
        if not b.num_rows:
            continue
        new_k, new_v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if long is not None and (n := int(np.searchsorted(new_k, long, side="right"))):
            yield True, new_k[:n], new_v[:n]
            new_k, new_v = new_k[n:], new_v[n:]
        k, v = np.concatenate([k, new_k]), np.concatenate([v, new_v])
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last:
            starts = np.concatenate([[0], np.flatnonzero(np.diff(k[:last])) + 1, [last]])
            size = np.diff(starts)
            for j in np.flatnonzero(size > LONG).tolist():
                yield True, k[starts[j] : starts[j + 1]], v[starts[j] : starts[j + 1]]
            held = np.repeat((size > 1) & (size <= LONG), size)
            yield False, k[:last][held], v[:last][held]
        k, v = k[last:], v[last:]
        if len(k) > LONG:
            yield True, k, v
            long, k, v = int(k[0]), k[:0], v[:0]
    if len(k):
        yield False, k, v


def _links(batches):
    """Rows sorted by key come in; links go out with ``again`` 0, entries of long lists with the key of another list."""
    for long, k, v in _lists(batches):
        if long:
            yield _again(int(k[0]) >> 8 * (LEAST_SHARED - 1), v)
        elif len(k):
            yield _forest(*near_in_lists(k, v))


def _probes() -> np.ndarray:
    one = [1 << i for i in range(_REST_BITS)]
    return np.array([*one, *(a | b for a, b in combinations(one, 2)), *(a | b | c for a, b, c in combinations(one, 3))], np.int64)


def _long_links(batches):
    """The same for lists whose entries share five bytes; a list has at most 2^24 entries and is held."""
    key, parts = None, []

    def settled() -> pa.RecordBatch:
        v = np.unique(np.concatenate(parts))
        if len(v) <= LONG:
            return _forest(*near_in_lists(np.zeros(len(v), np.int64), v))
        rest = [p for p in range(8) if p not in LONG_CHOICES[(key >> 8 * LEAST_SHARED) - 1]]
        short = sum(((v >> np.uint64(8 * p) & np.uint64(255)) << np.uint64(8 * i)) for i, p in enumerate(rest)).astype(np.int64)
        place, label = np.full(1 << _REST_BITS, -1, np.int32), np.arange(len(v))
        place[short] = np.arange(len(v))
        for probe in _probes().tolist():
            found = place[short ^ probe]
            i = np.flatnonzero(found >= 0)
            i = i[label[i] != label[found[i]]]
            if len(i):
                label = _least(len(v), np.concatenate([np.arange(len(v)), i]), np.concatenate([label, found[i]]))
                if not label.any():
                    break
        return _forest(v, v[label])

    for b in batches:
        k, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, z in pairwise(edges):
            if a < z:
                if parts and int(k[a]) != key:
                    yield settled()
                    parts.clear()
                key = int(k[a])
                parts.append(v[a:z])
    if parts:
        yield settled()


def links_of(fps: DataFrame) -> DataFrame:
    """``fps(fp)``, distinct, to links ``a, b`` that connect whatever lies within 3 bits."""
    posted = fps.mapInArrow(_postings, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = materialize(posted.mapInArrow(_links, "again long, a long, b long"), "links")
    again = found.where("again <> 0").select("again", "a").distinct()
    more = again.repartition("again").sortWithinPartitions("again").mapInArrow(_long_links, "again long, a long, b long")
    return found.where("again = 0").unionByName(more).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``a, b`` links to ``node, root`` for every linked node; ``root`` is the least node of its component (unsigned order is not used)."""
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def facts(e: DataFrame):
        return e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()

    state = facts(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of a node links to the node's least neighbour
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "large")
        # small star: a node and its smaller neighbours link to the least of them
        least = materialize(large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m")), "least")
        joined = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "small")
        now = facts(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, fp, component_id, component_size, root``, and ``rid`` if ``row`` names a column of row numbers.

    ``fp`` is the fingerprint as a signed long; ``component_id`` the smallest ``doc_id`` that links reach,
    which null or repeated ids leave null or give to several components; ``root``, a fingerprint, is a component's own.
    """
    ship(docs.sparkSession)
    own = ["rid"] if row else []
    number = [F.col(row).alias("rid")] if row else []
    kinds = "doc_id long, " + "rid long, " * bool(own) + "fp long"
    fps = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *number, text_column()).mapInArrow(_fingerprints(shingle), kinds), "fps")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    found = components(links_of(classes.select("fp")))
    rooted = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    totals = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    named = materialize(rooted.select("fp", "root").join(totals, "root").select("fp", "component_id", "component_size", "root"), "named")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "component_size", "root", *own)
