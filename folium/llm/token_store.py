"""Content-addressed token store.

Every text becomes a stream of ids. A rolling hash over the ids cuts the stream into chunks whose edges depend on
content alone, so passages shared by documents give equal chunks. A chunk is stored once under its digest; a document
is a recipe, the list of its chunk digests; recipes lie in ascending ``doc_id`` order with the number of ids before
each document; a Merkle tree over the documents' roots covers the whole.

Layout of a store, all Parquet::

    chunks/   digest binary(16), payload binary (little-endian ids, 2 bytes each where the vocabulary allows, else 4)
    recipes/  idx, doc_id, start, n_tokens, leaves array<binary>, after array<long> (ids behind each chunk), root
    merkle/   level, node, root (nodes of up to 1024 children; the single node of the last level covers all)
    format/   id_bytes, end_id, mean_chunk, documents (their number)

Defined results: null text reads as empty; every document has at least the end id; null ``doc_id`` sorts first;
repeated rows are documents of their own; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm._io import drop_folder, materialize, new_folder, portions, text_column, trim
from folium.llm.tokens import SLICE, encoder
from folium.session import ship

_RAW = "doc_id long, n_tokens long, leaves array<binary>, after array<long>, root binary, digest binary, payload binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("leaves", pa.list_(pa.binary())), ("after", pa.list_(pa.int64())), ("root", pa.binary()), ("digest", pa.binary()), ("payload", pa.binary())])
_REACH = 16
_FAN = 1024


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """Hash of the ``_REACH`` ids that end at each place, by doubling; wraps at 32 bits."""
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1) ^ (ids.astype(np.uint32) >> np.uint32(7)) * np.uint32(0x85EBCA77)
    factor, reach = 0x01000193, 1
    while reach < _REACH:
        nxt = h.copy()
        nxt[reach:] += h[:-reach] * np.uint32(factor)
        h, factor, reach = nxt, factor * factor & 0xFFFFFFFF, reach * 2
    return h ^ (h >> np.uint32(15))


def cut_points(n: int, candidates: np.ndarray, low: int, high: int) -> list[int]:
    """Ends of chunks: hashed candidates at least ``low`` ids apart, and never more than ``high``."""
    ends, last = [], 0
    for c in candidates.tolist():
        while c - last > high:
            last += high
            ends.append(last)
        if c - last >= low and c < n:
            ends.append(c)
            last = c
    while n - last > high:
        last += high
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def _ends_of(counts: np.ndarray, candidates: np.ndarray, mean: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks of all documents, as places among all ids, and how many chunks each document has."""
    low, high = mean // 4, mean * 4
    last = np.cumsum(counts)
    first = last - counts
    short = counts <= low  # one chunk, without a look at candidates
    ends, n = [last[short]], np.ones(len(counts), np.int64)
    lo, hi = np.searchsorted(candidates, first, side="right"), np.searchsorted(candidates, last)
    for j in np.flatnonzero(~short).tolist():
        own = cut_points(int(counts[j]), candidates[lo[j] : hi[j]] - first[j], low, high)
        n[j] = len(own)
        ends.append(np.array(own, np.int64) + first[j])
    return np.sort(np.concatenate(ends)), n


def _lists(values: pa.Array, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)


def _chunker(model, end_id: int, wide: bool, mean: int):
    def run(batches):
        enc, seen, mask = encoder(model.value), set(), np.uint32(mean - 1)
        kind, width = ("<u4", 4) if wide else ("<u2", 2)
        for part in portions(batches, limit=SLICE):
            flat, counts = enc.encode(part.column("text").to_pylist())
            ids = np.insert(flat, np.cumsum(counts), end_id)
            counts = counts + 1
            # a chunk is longer than the hash reaches back, so edges don't depend on the text before
            candidates = np.flatnonzero((rolling_hash(ids) & mask) == 0) + 1
            ends, n = _ends_of(counts, candidates, mean)
            data = memoryview(ids.astype(kind).tobytes())
            at = (np.concatenate([[0], ends]) * width).tolist()
            leaves = [hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in pairwise(at)]
            fresh = []
            for i, d in enumerate(leaves):
                if d not in seen:
                    seen.add(d)
                    fresh.append(i)
            bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
            roots = [digest_of(b"".join(leaves[a:z])) for a, z in pairwise(bounds)]
            after = np.repeat(np.cumsum(counts), n) - ends
            docs = [part.column("doc_id"), pa.array(counts), _lists(pa.array(leaves, pa.binary()), n), _lists(pa.array(after), n), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays([*docs, *(pa.nulls(len(counts), pa.binary()) for _ in range(2))], schema=_ARROW)
            chunks = [pa.array([leaves[i] for i in fresh], pa.binary()), pa.array([bytes(data[at[i] : at[i + 1]]) for i in fresh], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(fresh), t) for t in _ARROW.types[:5]), *chunks], schema=_ARROW)
            if len(seen) > 300_000:
                seen.clear()
        trim()

    return run


def _numbered(batches):
    """Adds to rows in order their place and the ids before them, counted from the partition's first row."""
    row = total = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy(zero_copy_only=False)
        ends = total + np.cumsum(n)
        cols = {"row": pa.array(row + np.arange(len(n))), "local": pa.array(ends - n)}
        row += len(n)
        total = int(ends[-1]) if len(n) else total
        for k, v in cols.items():
            b = b.append_column(k, v)
        yield b


def write_store(docs: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None, mean_chunk: int = 256) -> str:
    """Encode ``docs(doc_id, text)`` and write a store; returns its path.

    ``mean_chunk`` is the expected chunk length in ids, a power of two; chunks have between a quarter and four times that.
    """
    ship(docs.sparkSession)
    import json

    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    wide = max(json.loads(tokenizer_json)["model"]["vocab"].values()) > 0xFFFF or end_id > 0xFFFF
    model = spark.sparkContext.broadcast(tokenizer_json)
    raw_path = new_folder(spark, "raw")
    raw = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).mapInArrow(_chunker(model, end_id, wide, mean_chunk), _RAW), "raw", raw_path)
    raw.where("digest is not null").groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/chunks")

    ordered = raw.where("digest is null").select("doc_id", "n_tokens", "leaves", "after", "root").repartitionByRange(F.col("doc_id").asc(), F.col("root").asc()).sortWithinPartitions("doc_id", "root")
    kinds = "doc_id long, n_tokens long, leaves array<binary>, after array<long>, root binary, row long, local long"
    local = materialize(ordered.mapInArrow(_numbered, kinds).withColumn("part", F.spark_partition_id()), "local")
    drop_folder(spark, raw_path)
    # one row for each partition: as many as there are tasks
    totals = sorted(local.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect())
    offsets, rows, ids = [], 0, 0
    for part, n, t in totals:
        offsets.append((part, rows, ids))
        rows, ids = rows + n, ids + t
    base = spark.createDataFrame(offsets, "part int, rows long, ids long")
    local.join(F.broadcast(base), "part").select((F.col("rows") + F.col("row")).alias("idx"), "doc_id", (F.col("ids") + F.col("local")).alias("start"), "n_tokens", "leaves", "after", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    nodes = _documents_as_nodes(spark.read.parquet(f"{path}/recipes"))
    for level in range(1, _levels(rows) + 1):
        _parents(nodes).write.mode("append").parquet(f"{path}/merkle")
        nodes = spark.read.parquet(f"{path}/merkle").where(F.col("level") == level)
    spark.createDataFrame([(4 if wide else 2, end_id, mean_chunk, rows)], "id_bytes int, end_id long, mean_chunk int, documents long").coalesce(1).write.parquet(f"{path}/format")
    return path


def _levels(documents: int) -> int:
    """Levels of the tree above so many documents."""
    n, levels = documents, 0
    while n > 1 or n and not levels:
        n, levels = -(-n // _FAN), levels + 1
    return levels


def _documents_as_nodes(recipes: DataFrame) -> DataFrame:
    return recipes.select(F.lit(0).alias("level"), F.col("idx").alias("node"), "root")


def _parents(nodes: DataFrame) -> DataFrame:
    """``level, node, root`` to the nodes one level up."""
    joined = nodes.groupBy((F.col("level") + 1).alias("level"), F.expr(f"node div {_FAN}").alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "root"))).alias("below"))
    return joined.select("level", "node", F.unhex(F.sha2(F.expr("unhex(array_join(transform(below, x -> hex(x.root)), ''))"), 256)).alias("root"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, by element."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    out = np.zeros(np.broadcast(a, b).shape, np.uint64)
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(i)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ np.uint64(0xEDB88320), b >> np.uint64(1))
    return out


def shifted_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a part's CRC-32 contributes to that of a whole in which ``n_bytes`` follow; contributions add by xor."""
    out, power = crc.astype(np.uint64), np.array([1 << 23], np.uint64)  # x^8
    left = n_bytes.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], power)
        power = _times(power, power)
        left >>= np.uint64(1)
    return out


def _chunk_facts(kind: str):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64()), ("sound", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = []
            for d, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(data, kind)
                rows.append((d, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), digest_of(data) == d))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema.types, strict=True)], schema=schema)

    return run


def _kind(spark: SparkSession, path: str) -> str:
    return f"<u{spark.read.parquet(f'{path}/format').first()['id_bytes']}"


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Read a store back: per document ``doc_id, start, n_tokens, ids_crc32, chunks, sound``.

    The CRC of a document's ids (little-endian, 4 bytes each) is joined from those of its stored chunks, so payloads
    are read once and never shuffled. ``sound``: every chunk has the digest it is filed under, lengths add up, the
    recipe's leaves in their order give its root, the roots of the up to 1024 documents below a node give the node's, and
    the store is whole: it has as many documents as it was written with, and its nodes give each other up to the top. A
    document that is gone thus makes all others unsound; with every document gone there is no row to say so, an error.
    """
    ship(spark)
    documents = spark.read.parquet(f"{path}/format").first()["documents"]
    recipes = spark.read.parquet(f"{path}/recipes")
    left = recipes.count()
    if documents and not left:
        raise ValueError(f"all {documents} documents of the store are gone")
    nodes = "level int, node long, root binary"
    tree = spark.read.schema(nodes).parquet(f"{path}/merkle") if documents else spark.createDataFrame([], nodes)
    proved = _parents(_documents_as_nodes(recipes)).join(tree, ["level", "node", "root"], "left_semi").select("node")
    # nodes above the first level as their children give them and as they are filed: every one has to stand in both
    given, filed = _parents(tree.where(F.col("level") < _levels(documents))).withColumn("n", F.lit(1)), tree.where("level > 1").withColumn("n", F.lit(-1))
    whole = left == documents and tree.where("level = 1").count() == -(-documents // _FAN) and given.unionByName(filed).groupBy("level", "node", "root").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()
    facts = spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(_chunk_facts(_kind(spark, path)), "digest binary, n long, crc long, sound boolean")

    @F.pandas_udf("long")
    def placed(crc, after):
        import pandas as pd

        return pd.Series(shifted_crc(crc.to_numpy(), after.to_numpy() * 4).astype(np.int64))

    @F.pandas_udf("binary")
    def root_of(leaves):
        import pandas as pd

        return pd.Series([digest_of(b"".join(x)) for x in leaves])

    rooted = recipes.withColumn("rooted", F.coalesce(root_of("leaves") == F.col("root"), F.lit(False)))
    used = rooted.select("idx", "doc_id", "start", "n_tokens", "rooted", F.explode_outer(F.arrays_zip("leaves", "after")).alias("x"))
    used = used.select("idx", "doc_id", "start", "n_tokens", "rooted", F.col("x.leaves").alias("digest"), F.coalesce("x.after", F.lit(0)).alias("after"))
    joined = used.join(facts, "digest", "left").withColumn("placed", placed(F.coalesce("crc", F.lit(0)), "after"))
    docs = joined.groupBy("idx", "doc_id", "start", "n_tokens", "rooted").agg(F.expr("bit_xor(placed)").alias("ids_crc32"), F.count("digest").alias("chunks"), F.expr("bool_and(coalesce(sound, false))").alias("sound"), F.sum("n").alias("n"))
    docs = docs.withColumn("node", F.expr(f"idx div {_FAN}")).join(proved.withColumn("proved", F.lit(True)), "node", "left")
    sound = F.col("sound") & (F.coalesce("n", F.lit(0)) == F.col("n_tokens")) & F.col("rooted") & F.coalesce("proved", F.lit(False)) & F.lit(whole)
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32", "chunks", sound.alias("sound"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents themselves: ``doc_id, start, ids array<int>``, put together from chunks."""
    ship(spark)
    kind = _kind(spark, path)

    @F.pandas_udf("array<long>")
    def joined(parts):
        import pandas as pd

        return pd.Series([np.frombuffer(b"".join(p), kind).astype(np.int64) for p in parts])

    recipes = spark.read.parquet(f"{path}/recipes").select("idx", "doc_id", "start", F.posexplode("leaves").alias("pos", "digest"))
    found = recipes.join(spark.read.parquet(f"{path}/chunks"), "digest")
    parts = found.groupBy("idx", "doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("p"))
    return parts.select("doc_id", "start", joined(F.expr("transform(p, x -> x.payload)")).alias("ids"))


def merkle_root(spark: SparkSession, path: str) -> str | None:
    """Hex root over all documents of a store; None for an empty one."""
    try:
        top = spark.read.parquet(f"{path}/merkle").orderBy(F.desc("level")).select(F.lower(F.hex("root"))).first()
    except Exception:  # an empty store has no tree
        return None
    return top[0] if top else None
