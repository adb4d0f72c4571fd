"""The index as tables: postings, unit lengths, side lookups, adding and deleting documents."""

from __future__ import annotations

import contextlib
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folium.functions.text import DEFAULT_STOP_WORDS, LONGEST, analyzed, analyzed_places
from folium.operators.annotate import sentences
from folium.session import shared_root

GRANULARITIES = {"document": "fulltext", "sentence": "sentence"}
CASE_MODES = ["ci", "cs"]
#: Words and units that become lists together: about 150 MB in a worker.
BLOCK = 1 << 20
#: Bytes of packed lists that are unpacked together.
UNPACKED = 1 << 22
#: Bytes of stored texts that a task inverts at most: else there are hardly more tasks than cores, and the last runs alone.
SPLIT = 1 << 24


def units(docs: DataFrame, granularity: str = "fulltext", sentence_rows: DataFrame | None = None) -> DataFrame:
    """What is searched in: ``doc_id, sentence_id, text`` of documents or of their sentences."""
    if granularity == "sentence":
        rows = sentence_rows if sentence_rows is not None else sentences(docs.select("doc_id", "text"))
        return rows.select("doc_id", "sentence_id", F.col("sentence").alias("text"))
    return docs.select("doc_id", F.lit(None).cast("int").alias("sentence_id"), "text")


def postings(docs: DataFrame, granularity: str = "fulltext", case_mode: str = "ci", sentence_rows: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """``granularity, case_mode, field, term, doc_id, sentence_id, tf, positions`` of ``docs(doc_id, text)``, analyzed."""
    places = analyzed_places(F.col("text"), stop_words, case_mode == "cs")
    spread = units(docs, granularity, sentence_rows).select("doc_id", "sentence_id", F.posexplode(places).alias("pos", "term")).where("term is not null")
    grouped = spread.groupBy("term", "doc_id", "sentence_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select(F.lit(granularity).alias("granularity"), F.lit(case_mode).alias("case_mode"), F.lit("text").alias("field"), "term", "doc_id", "sentence_id", "tf", "positions")


def unit_lengths(docs: DataFrame, granularity: str = "fulltext", case_mode: str = "ci", sentence_rows: DataFrame | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """``doc_id, sentence_id, n_terms`` of every unit, those without terms too."""
    return units(docs, granularity, sentence_rows).select("doc_id", "sentence_id", F.size(analyzed(F.col("text"), stop_words, case_mode == "cs")).alias("n_terms"))


def _letters(spark: SparkSession) -> bytes:
    """Which code points are letters or digits, as the regular expressions of the JVM have it: bits, compressed. Python's tables are of another Unicode version."""
    import numpy as np

    sc = spark.sparkContext
    if not hasattr(sc, "_folium_letters"):
        every = np.array([*range(0xD800), *range(0xE000, 0x110000)], np.uint32)
        kept = sc._jvm.java.util.regex.Pattern.compile("[^\\p{L}\\p{N}]").matcher(every.tobytes().decode("utf-32-le")).replaceAll(" ")
        table = np.zeros(0x110000, bool)
        table[every] = np.frombuffer(kept.encode("utf-32-le"), np.uint32) != 32
        sc._folium_letters = zlib.compress(np.packbits(table).tobytes())
    return sc._folium_letters


def _coders():
    """Whole numbers as runs of 7 bits, lowest first, and back; all of an array in a few passes."""
    import numpy as np

    def coded(v):
        """Bytes of unsigned numbers, and where each begins, with the end."""
        most = int(v.max(initial=0))
        v = v.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)
        sizes = np.ones(len(v), np.uint8)
        for k in range(1, 10):
            if most >> 7 * k:
                sizes += v >= 1 << 7 * k
        at = np.zeros(len(v) + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        out, to = np.empty(at[-1], np.uint8), at[:-1]
        out[to] = v.astype(np.uint8) & 127
        more = np.flatnonzero(sizes > 1)
        while len(more):
            v, sizes, to = v[more] >> 7, sizes[more] - 1, to[more]
            out[to] |= 128
            to = to + 1
            out[to] = v.astype(np.uint8) & 127
            more = np.flatnonzero(sizes > 1)
        return out, at

    def decoded(b):
        """Unsigned numbers of bytes, and the byte behind each."""
        ends = np.flatnonzero(b < 128) + 1
        begins = np.append(0, ends[:-1])[: len(ends)]
        v, sizes, own = b[begins].astype(np.uint64) & np.uint64(127), ends - begins, np.arange(len(ends))
        for k in range(1, int(sizes.max(initial=0))):
            own = own[sizes[own] > k]
            v[own] |= (b[begins[own] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
        return v, ends

    # small numbers of either sign stay small; differences wrap around, so that every 64-bit id comes back
    signed = lambda v: (v << 1 ^ v >> 63).view(np.uint64)
    unsigned = lambda v: (v >> np.uint64(1)).view(np.int64) ^ -(v & np.uint64(1)).view(np.int64)
    return coded, decoded, signed, unsigned


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def posting_lists(rows: DataFrame, case_mode: str = "ci", stop_words: list[str] | None = None, block: int = BLOCK, packed: bool = False) -> DataFrame:
    """``term, entries`` of ``rows(doc_id, sentence_id, text)``; an entry is ``doc_id, sentence_id, n_terms, tf, positions``.

    ``packed`` gives ``term, doc_id, units, positions`` instead, as bytes that ``unpacked`` reads: nested values went through
    the JVM one by one, which took most of the time of an index. In ``units`` are, for each of the list's entries, ``tf`` with
    three bits for nulls, then ``doc_id`` less the one before, ``sentence_id`` and ``n_terms``; ``doc_id`` is the list's first.
    Ids that are no whole numbers are all there, in an array.

    A task inverts its units in blocks, as they come: a block has a row for each of its terms, sorted by term, so that
    pages of a file cover few terms, and nothing is shuffled. The empty term comes first and lists every unit of the block.
    Texts cross to Python whole and are split there as ``found_words`` splits them, all bytes of a block at once: an array
    of words costs several times as much to hand over.
    """
    stop = list(DEFAULT_STOP_WORDS if stop_words is None else stop_words)
    longest, int_list, letter_bits = LONGEST, T.ArrayType(T.IntegerType()), _letters(rows.sparkSession)
    entry = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("sentence_id", T.IntegerType()), T.StructField("n_terms", T.IntegerType()), T.StructField("tf", T.IntegerType()), T.StructField("positions", int_list)])
    own, (coded, _, signed, _) = entry["doc_id"].dataType, _coders()
    whole = _whole(own)
    if packed:
        lists = [T.StructField("doc_id", own if whole else T.ArrayType(own)), T.StructField("units", T.BinaryType()), T.StructField("positions", T.BinaryType())]
    else:
        lists = [T.StructField("entries", T.ArrayType(entry))]
    schema = T.StructType([T.StructField("term", T.StringType()), *lists])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        letters = np.unpackbits(np.frombuffer(zlib.decompress(letter_bits), np.uint8)).view(bool)
        ascii_letters = np.append(letters[:128], np.zeros(128, bool))

        def split(texts):
            """Words of texts, one after the other, and how many each text has: runs of letters and digits, joined by single ``'`` and ``.`` between two of them."""
            bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
            data = texts.buffers()[2]
            b = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
            bounds = bounds - bounds[0]
            word = ascii_letters[b]
            lead = np.flatnonzero(b >= 0xC0)
            if len(lead):
                first = b[lead]
                more = 1 + (first >= 0xE0) + (first >= 0xF0)
                code = (first & (0x3F >> more)).astype(np.int32)
                for k in (1, 2, 3):
                    has = more >= k
                    code[has] = code[has] << 6 | (b[lead[has] + k] & 0x3F)
                good = letters[code]
                word[lead] = good
                for k in (1, 2, 3):
                    has = more >= k
                    word[lead[has] + k] = good[has]
            edge = np.zeros(len(b) + 1, bool)  # a text begins here
            edge[bounds] = True
            mark = np.flatnonzero((b == 39) | (b == 46))
            mark = mark[(mark > 0) & (mark < len(b) - 1)]
            mark = mark[word[mark - 1] & word[mark + 1] & ~edge[mark] & ~edge[mark + 1]]
            word[mark] = True
            begins, ends = word.copy(), word.copy()
            begins[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
            begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
            offsets = np.zeros(len(begins) + 1, np.int32)
            np.cumsum(ends - begins, out=offsets[1:])
            words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(b[word]))
            return words, np.diff(np.searchsorted(begins, bounds))

        def starts(*keys):
            """Where one of the sorted keys changes, and the end."""
            new = np.zeros(len(keys[0]), bool)
            new[:1] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            return np.append(np.flatnonzero(new), len(new)).astype(np.int32)

        def listed(terms, bounds, doc, sentence, n_terms, tf, at, places):
            positions = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(places, pa.int32()))
            entries = pa.StructArray.from_arrays([doc, sentence, n_terms, pa.array(tf, pa.int32()), positions], ["doc_id", "sentence_id", "n_terms", "tf", "positions"])
            return pa.RecordBatch.from_arrays([terms, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)], ["term", "entries"])

        def bytes_of(values, bounds):
            """An array of bytes with the numbers between bounds in each."""
            data, begins = coded(values)
            offsets = begins[bounds].astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

        def packed_lists(terms, bounds, doc, sentence, n_terms, tf, at, places):
            bounds, places = np.asarray(bounds, np.int64), np.asarray(places, np.int64)
            sizes = np.diff(bounds)
            codes = np.zeros(4 * bounds[-1], np.uint64)
            to = np.arange(bounds[-1]) + np.repeat(3 * bounds[:-1], sizes)  # a list's four columns stand one after the other
            step = np.repeat(sizes, sizes)
            head = np.asarray(tf).astype(np.uint64) << np.uint64(3)
            for k, x in enumerate((doc, sentence, n_terms)):
                if x.null_count:
                    head |= x.is_null().to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(k)
                if x.null_count < len(x) and (k or whole):
                    v = x.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                    if not k:
                        v = v - np.append(v[:1], v[:-1])
                        v[bounds[:-1]] = 0
                    codes[to + (k + 1) * step] = signed(v)
            codes[to] = head
            apart = places - np.append(places[:1], places[:-1])
            first = at[:-1][np.diff(at) > 0]
            apart[first] = places[first]
            ids = doc.take(pa.array(bounds[:-1])) if whole else pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), doc)
            return pa.RecordBatch.from_arrays([terms, ids, bytes_of(codes, 4 * bounds), bytes_of(apart.view(np.uint64), np.asarray(at)[bounds])], ["term", "doc_id", "units", "positions"])

        form = packed_lists if packed else listed

        def inverted(held):
            doc, sentence, texts = [pa.concat_arrays([b.column(k) for b in held]) for k in range(3)]
            found, sizes = split(texts.cast(pa.string()))
            n, coded = len(doc), found.dictionary_encode()
            words = coded.dictionary
            dropped = pc.or_(pc.is_in(words, value_set=pa.array(stop, words.type)), pc.greater(pc.utf8_length(words), longest)).to_numpy(zero_copy_only=False)
            order = pc.sort_indices(words).to_numpy()
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            rank[dropped] = -1
            term = rank[coded.indices.to_numpy()]
            row = np.repeat(np.arange(n, dtype=np.int32), sizes)
            place = (np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            kept = term >= 0
            term, row, place = term[kept], row[kept], place[kept]
            n_terms = np.bincount(row, minlength=n).astype(np.int32)
            yield form(pa.array([""]), [0, n], doc, sentence, pa.array(n_terms, mask=texts.is_null().to_numpy(zero_copy_only=False)), np.zeros(n), np.zeros(n + 1, np.int32), [])
            if len(term):
                key = term.astype(np.int64) << 32 | np.arange(len(term))
                key.sort()  # by term, then as they stand
                sort, term = key & 0xFFFFFFFF, (key >> 32).astype(np.int32)
                row, place = row[sort], place[sort]
                at = starts(term, row)
                own = row[at[:-1]]
                bounds = starts(term[at[:-1]])
                yield form(words.take(pa.array(order[term[at[:-1]][bounds[:-1]]])), bounds, doc.take(pa.array(own)), sentence.take(pa.array(own)), pa.array(n_terms[own]), np.diff(at), at, place)

        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows + b.nbytes // 6
            if size >= block:
                yield from inverted(held)
                held, size = [], 0
        if held:
            yield from inverted(held)

    text = F.col("text") if case_mode == "cs" else F.lower("text")
    # bytes that are no UTF-8 become U+FFFD, which is in no word
    return rows.select("doc_id", "sentence_id", F.make_valid_utf8(text).alias("text")).mapInArrow(run, schema)


def unpacked(lists: DataFrame) -> DataFrame:
    """Entries of packed ``lists(*others, doc_id, units, positions)``, one a row: ``*others, doc_id, sentence_id, n_terms, tf, positions``."""
    others = [f for f in lists.schema.fields if f.name not in ("doc_id", "units", "positions")]
    stored, (_, decoded, _, unsigned) = lists.schema["doc_id"].dataType, _coders()
    whole = not isinstance(stored, T.ArrayType)
    doc_type = stored if whole else stored.elementType
    ints = [T.StructField(n, T.IntegerType()) for n in ("sentence_id", "n_terms", "tf")]
    schema = T.StructType([*others, T.StructField("doc_id", doc_type), *ints, T.StructField("positions", T.ArrayType(T.IntegerType()))])
    names, most = [f.name for f in others], UNPACKED

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def numbers(column):
            """The numbers of all rows, and where each row's begin, with the end."""
            column = column.cast(pa.binary())
            bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            v, ends = decoded(np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8))
            return v, np.searchsorted(ends, bounds - bounds[0], side="right")

        def totals(v, begins, sizes):
            """Running sums that start anew where something begins."""
            sums = np.append(0, np.cumsum(v))
            return sums[1:] - np.repeat(sums[begins], sizes)

        def entries(b):
            codes, bounds = numbers(b.column("units"))
            sizes = np.diff(bounds) // 4
            begins = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) + np.repeat(3 * begins, sizes)
            step = np.repeat(sizes, sizes)
            head = codes[at]
            tf = (head >> np.uint64(3)).astype(np.int32)
            missing = [(head >> np.uint64(k) & np.uint64(1)).astype(bool) for k in range(3)]
            doc, sentence, n_terms = (unsigned(codes[at + (k + 1) * step]) for k in range(3))
            if whole:
                first = b.column("doc_id")
                ids = totals(doc, begins, sizes) + np.repeat(first.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), sizes)
                docs = pa.array(ids, mask=missing[0]).cast(first.type)
            else:
                docs = b.column("doc_id").flatten()
            ints = [pa.array(v.astype(np.int32), mask=m) for v, m in ((sentence, missing[1]), (n_terms, missing[2]))]
            apart, _ = numbers(b.column("positions"))
            to = np.append(0, np.cumsum(tf)).astype(np.int32)
            positions = pa.ListArray.from_arrays(pa.array(to), pa.array(totals(apart.view(np.int64), to[:-1], tf).astype(np.int32)))
            row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            return pa.RecordBatch.from_arrays([*(b.column(n).take(row) for n in names), docs, *ints, pa.array(tf), positions], [*names, "doc_id", "sentence_id", "n_terms", "tf", "positions"])

        for b in batches:
            begin, size = 0, np.cumsum(sum(pc.binary_length(b.column(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("units", "positions")))
            while begin < b.num_rows:
                end = max(begin + 1, int(np.searchsorted(size, most + (size[begin - 1] if begin else 0), side="right")))
                yield entries(b.slice(begin, end - begin))
                begin = end

    return lists.mapInArrow(run, schema)


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("granularity", "case_mode", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def with_ids(docs: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Dense ids from ``start`` in a fixed order, by counts of range partitions: no task sees all rows."""
    ranged = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    shared_root(docs.sparkSession)
    numbered = ranged.withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_m", 33)
    sizes = sorted(tuple(r) for r in numbered.groupBy(part.alias("p")).agg(F.count("*")).collect())
    at, offsets = start, {}
    for p, n in sizes:
        offsets[p] = at
        at += n
    base = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv)) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(start))
    return numbered.withColumn("id", (base[part] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_m")


def first_seen(words: DataFrame, key: str = "word", order: str = "first") -> DataFrame:
    """Dense ids of distinct words by where they first stand: ``word, id``."""
    return with_ids(words.groupBy(key).agg(F.min(order).alias("_o")), ["_o", key]).select(key, "id")


def add(docs: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the new ones added; one that is there already is replaced."""
    return docs.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(docs: DataFrame, ids: list | DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without those ids; unknown ids change nothing. Sentences and lookups go by the same call."""
    if isinstance(ids, DataFrame):
        return docs.join(ids.select(key).distinct(), key, "left_anti")
    return docs.where(~F.coalesce(F.col(key).isin(*ids), F.lit(False))) if ids else docs


class Collection:
    """Documents, sentences, postings and unit lengths in a folder, with an external collection that may be attached.

    Every change writes only what is new, as a segment of its own, and then one numbered entry of the log, made
    exclusively: readers see all of a change or nothing, and of two writers for one number the later one fails. Deleted
    and replaced ids are rows that hide older segments' rows when those are read; ``compact`` rewrites what is left as one
    segment and ``vacuum`` removes what no entry needs. Postings are lists in order of terms, so a filter on terms skips
    most of them; each entry has its unit's length.

    :param modes: case modes that are indexed, ``ci`` and ``cs``; of none, texts and sentences are only kept
    :param kinds: what is searched for, ``document`` and ``sentence``; sentences are kept for the latter
    """

    TABLES = ["docs", "sentences", "postings", "lengths", "deleted"]

    def __init__(self, spark: SparkSession, path: str, stop_words: list[str] | None = None, modes: list[str] | None = None, kinds: list[str] | None = None):
        self.spark, self.path, self.external = spark, path.rstrip("/"), None
        self.stop_words = DEFAULT_STOP_WORDS if stop_words is None else stop_words
        self.modes = CASE_MODES if modes is None else modes
        self.kinds = list(GRANULARITIES) if kinds is None else list(kinds)

    # --- the log

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def log(self) -> list[dict]:
        """Entries from the last one that starts anew: ``n, segment, adds, hides``."""
        fs, folder = self._folder("log")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.schema("n int, segment string, adds boolean, hides boolean, anew boolean").json(f"{self.path}/log").orderBy("n").collect()
        first = max((i for i, r in enumerate(rows) if r["anew"]), default=0)
        return [r.asDict() for r in rows[first:]]

    def _commit(self, segment: str, adds: bool, hides: bool, anew: bool = False) -> None:
        import json

        entries = self.log()
        n = entries[-1]["n"] + 1 if entries else 1
        fs, file = self._folder(f"log/{n:08d}.json")
        out = fs.create(file, False)  # fails if another writer has made it
        out.write(bytearray(json.dumps({"n": n, "segment": segment, "adds": adds, "hides": hides, "anew": anew}).encode() + b"\n"))
        out.close()

    # --- reading

    def _table(self, name: str, shown=lambda rows: rows) -> DataFrame:
        """Rows of a table that no later change hides; ``shown`` makes them, with ``segment`` and ``doc_id``, of what is stored."""
        entries = self.log()
        added = {e["segment"]: e["n"] for e in entries if e["adds"]}
        if not added:
            raise ValueError(f"nothing was added to {self.path}")
        read = lambda t, segments: self.spark.read.option("basePath", f"{self.path}/{t}").parquet(*(f"{self.path}/{t}/segment={s}" for s in segments))
        rows = shown(read(name, added))
        hiding = {e["segment"]: e["n"] for e in entries if e["hides"]}
        if hiding:
            number = lambda of: F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("segment")]
            hidden = read("deleted", hiding).groupBy("doc_id").agg(F.max(number(hiding)).alias("_upto"))
            rows = rows.withColumn("_n", number(added))
            rows = rows.join(hidden, rows["doc_id"].eqNullSafe(hidden["doc_id"]) & (rows["_n"] < hidden["_upto"]), "left_anti").drop("_n")
        return rows.drop("segment")

    def docs(self) -> DataFrame:
        return self._table("docs")

    def sentences(self) -> DataFrame:
        self._has(kind="sentence")
        return self._table("sentences")

    def _has(self, kind: str, mode: str | None = None) -> None:
        if kind not in self.kinds:
            raise ValueError(f"the collection keeps no {kind} rows")
        if mode is not None and mode not in self.modes:
            raise ValueError(f"the collection has no index for case mode {mode}")

    def _wanted(self, kind: str, case_sensitive: bool) -> Column:
        mode = CASE_MODES[case_sensitive]
        self._has(kind, mode)
        return (F.col("granularity") == GRANULARITIES[kind]) & (F.col("case_mode") == mode)

    def postings(self, kind: str = "document", case_sensitive: bool = False, terms: Column | None = None) -> DataFrame:
        """``term, doc_id, sentence_id, n_terms, tf, positions`` of one index of those built; the others' folders aren't read.

        ``terms`` is a condition on ``term`` that is met before lists are unpacked, and that reaches the files.
        """
        wanted = self._wanted(kind, case_sensitive) & (F.col("term") != "")
        wanted = wanted if terms is None else wanted & terms
        return self._table("postings", lambda t: unpacked(t.where(wanted).drop("granularity", "case_mode")))

    def lengths(self, kind: str = "document", case_sensitive: bool = False) -> DataFrame:
        wanted = self._wanted(kind, case_sensitive)
        return self._table("lengths", lambda t: t.where(wanted).drop("granularity", "case_mode"))

    def sentence_lookup(self) -> DataFrame:
        """Sentence to document and year."""
        return self.sentences().select("doc_id", "sentence_id").join(self.document_lookup(), "doc_id")

    def document_lookup(self) -> DataFrame:
        docs = self.docs()
        return docs.select("doc_id", "year" if "year" in docs.columns else F.lit(None).cast("string").alias("year"))

    def by_path(self, path: str) -> DataFrame:
        return self.docs().where(F.col("filepath") == path).limit(1)

    def by_id(self, doc_id) -> DataFrame:
        return self.docs().where(F.col("doc_id") == doc_id).limit(1)

    # --- changing

    def _store(self, rows: DataFrame, place: str, group: int = 1 << 27) -> None:
        rows.write.option("compression", "zstd").option("parquet.block.size", group).parquet(f"{self.path}/{place}")  # a third less than by default

    @contextlib.contextmanager
    def _small_splits(self):
        """Files are read in parts of ``SPLIT`` at most."""
        key, conf = "spark.sql.files.maxPartitionBytes", self.spark.conf
        before, most = conf.get(key), self.spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
        conf.set(key, str(min(most, SPLIT)))
        try:
            yield
        finally:
            conf.set(key, before)

    def _write(self, docs: DataFrame, segment: str, sentence_rows: DataFrame | None = None) -> None:
        self._store(docs, f"docs/segment={segment}", 2 * SPLIT)
        for kind in self.kinds:
            self._write_kind(kind, segment, sentence_rows)

    def _write_kind(self, kind: str, segment: str, sentence_rows: DataFrame | None = None) -> None:
        """Sentences, for their kind, and the indexes of one kind, from a segment's stored texts."""
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}")
        rows = None
        if kind == "sentence":
            made = sentence_rows if sentence_rows is not None else sentences(read(f"docs/segment={segment}").select("doc_id", "text"))
            self._store(made, f"sentences/segment={segment}")
            rows = read(f"sentences/segment={segment}")
        granularity = GRANULARITIES[kind]
        for mode in self.modes:
            own = f"segment={segment}/granularity={granularity}/case_mode={mode}"
            with self._small_splits():
                self._store(posting_lists(units(read(f"docs/segment={segment}"), granularity, rows), mode, self.stop_words, packed=True), f"postings/{own}")
            every = unpacked(read(f"postings/{own}").where("term = ''"))
            self._store(every.select("doc_id", "sentence_id", "n_terms"), f"lengths/{own}")

    def extend(self, kind: str) -> None:
        """Brings what a further kind of search needs to the segments in use. No writer may be at work."""
        if kind not in self.kinds:
            for entry in self.log():
                if entry["adds"]:
                    self._write_kind(kind, entry["segment"])
            self.kinds.append(kind)

    def build(self, docs: DataFrame) -> None:
        """Starts anew with these documents."""
        segment = f"s{uuid.uuid4().hex}"
        self._write(docs, segment)
        self._commit(segment, adds=True, hides=False, anew=True)

    def add(self, new: DataFrame) -> None:
        """Adds documents; ones that are there already are replaced."""
        segment, there = f"s{uuid.uuid4().hex}", any(e["adds"] for e in self.log())
        self._write(new, segment)
        if there:
            self.spark.read.parquet(f"{self.path}/docs/segment={segment}").select("doc_id").distinct().write.parquet(f"{self.path}/deleted/segment={segment}")
        self._commit(segment, adds=True, hides=there)

    def remove(self, ids: list | DataFrame) -> bool:
        """Whether any of the ids was there; their sentences, postings and lengths go with them."""
        asked = ids.select("doc_id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "doc_id long")
        found = self.docs().select("doc_id").join(asked, "doc_id", "left_semi").distinct()
        segment = f"s{uuid.uuid4().hex}"
        found.write.parquet(f"{self.path}/deleted/segment={segment}")
        if self.spark.read.parquet(f"{self.path}/deleted/segment={segment}").isEmpty():
            return False
        self._commit(segment, adds=False, hides=True)
        return True

    def compact(self) -> None:
        """What is left as one segment; stored sentences are copied, not made again."""
        segment = f"s{uuid.uuid4().hex}"
        self._write(self.docs(), segment, self.sentences() if "sentence" in self.kinds else None)
        self._commit(segment, adds=True, hides=False, anew=True)

    def vacuum(self) -> None:
        """Deletes the files of segments that no entry in use names. No writer or older reader may be at work."""
        kept = {f"segment={e['segment']}" for e in self.log()}
        for name in self.TABLES:
            fs, folder = self._folder(name)
            for found in fs.listStatus(folder) if fs.exists(folder) else []:
                if found.getPath().getName() not in kept:
                    fs.delete(found.getPath(), True)

    # --- searching

    def attach(self, other: Collection) -> None:
        self.external = other

    def detach(self) -> None:
        self.external = None

    def has_external(self) -> bool:
        return self.external is not None

    def search(self, query, matches_only: bool = False, **kwargs) -> DataFrame:
        """Hits here and in the attached collection; ``matches_only`` leaves out what details bring later."""
        from folium.operators.search import federated, search

        hits = federated(query, self, self.external, **kwargs) if self.external else search(query, collection=self, **kwargs)
        return hits.drop("year") if matches_only else hits


def ordinals(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Ordinal of rows within their document, from 1."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)))
