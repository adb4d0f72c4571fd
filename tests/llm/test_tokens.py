"""Encoding, the token store and packing against the tokenizers library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from folium.llm import packing, queries, token_store, tokens

EDGES = [(1, None), (2, ""), (3, "One two."), (3, "One two."), (None, "null id"), (5, " \t\n"), (6, "word, " * 3000), (7, "İstanbul é é <|endoftext|> 中文 🙂\x00\x01\x02")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, digest string, row int, length string")


def library(name):
    t = Tokenizer.from_str(tokens.tokenizer_file(name))
    t.encode_special_tokens = True
    return lambda text, end: [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("max_words", [500_000, 300])
def test_encoder_gives_the_library_s_ids(name, max_words):
    rng = random.Random(5)
    bits = ["a", "B", "é", "ß", "İ", "Σ", " ", "  ", "\n", "\t", ".", ",", "'", "'s", "don't", "...", "1", "23", "\xa0", "　", "<|endoftext|>", "</w>", "中", "🙂", "\x00", "\x01", "\x02", "\x1c", "é", "ǆ", "ﬁ", "\r\n", "I'LL", "foo", "Bar", "-", "_", "!?"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", ".", " ", "a.", "a .", "é.", "foo,\nbar."]
    encode, encoder = library(name), tokens.WordEncoder(tokens.tokenizer_file(name), max_words)
    for a in range(0, len(texts), 500):
        flat, counts = encoder.encode(texts[a : a + 500])
        ends = np.cumsum(counts)
        for t, e, n in zip(texts[a : a + 500], ends.tolist(), counts.tolist(), strict=True):
            assert flat[e - n : e].tolist() == encode(t, 0)[:-1], t
    assert [x.tolist() for x in encoder.encode([])] == [[], []]


def test_store_query(spark, sf_dir):
    encode, start = library("word_bpe_49k.json"), 0
    got = {r["doc_id"]: r for r in queries.op1_token_store(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, r = encode(d["text"], 1), got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["sound"]) == (start, len(ids), crc(ids), True)
        start += len(ids)


def test_store_edges_and_reading_back(spark):
    docs = frame(spark, EDGES)
    path = token_store.write_store(docs, tokens.tokenizer_file("word_bpe_49k.json"), 1)
    encode, read = library("word_bpe_49k.json"), token_store.read_ids(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in read] == [None, 1, 2, 3, 3, 5, 6, 7]
    texts = dict(EDGES)
    for r in read:
        assert list(r["ids"]) == encode(texts[r["doc_id"]], 1)
    starts = np.cumsum([0, *(len(r["ids"]) for r in read)])
    assert [r["start"] for r in read] == starts[:-1].tolist()
    assert token_store.verify_store(spark, path).where("not sound").isEmpty()
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    # the same rows in another order have the same tree
    again = token_store.write_store(docs.orderBy("text"), tokens.tokenizer_file("word_bpe_49k.json"), 1)
    assert token_store.merkle_root(spark, path) == token_store.merkle_root(spark, again)
    empty = token_store.write_store(docs.limit(0), tokens.tokenizer_file("word_bpe_49k.json"), 1)
    assert token_store.verify_store(spark, empty).isEmpty() and token_store.merkle_root(spark, empty) is None


def test_tampered_and_lost_recipes_are_not_sound(spark, tmp_path):
    import shutil

    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["fish", "tree", "stone", "river", "and", "one"]) for _ in range(2000 if i == 7 else 3))) for i in range(1100)]
    token_store.write_store(frame(spark, rows), tokens.tokenizer_file("word_bpe_49k.json"), 1, f"file://{tmp_path}/store")
    recipes = spark.read.parquet(f"file://{tmp_path}/store/recipes")

    def unsound(name, changed, part="recipes"):
        for other in {"chunks", "recipes", "merkle", "format"} - {part}:
            shutil.copytree(tmp_path / "store" / other, tmp_path / name / other)
        changed.write.parquet(f"file://{tmp_path}/{name}/{part}")
        got = token_store.verify_store(spark, f"file://{tmp_path}/{name}").collect()
        return len(got), {r["doc_id"] for r in got if not r["sound"]}

    of = lambda key, then, other: F.when(F.col("doc_id") == key, then).otherwise(other)
    assert unsound("healthy", recipes) == (1100, set())
    assert unsound("reordered", recipes.withColumn("leaves", of(7, F.reverse("leaves"), F.col("leaves")))) == (1100, {7})
    assert unsound("no_leaves", recipes.withColumn("leaves", of(7, F.slice("leaves", 1, 0), F.col("leaves")))) == (1100, {7})
    assert unsound("other_root", recipes.withColumn("root", of(1050, F.unhex(F.lit("00" * 16)), F.col("root")))) == (1100, set(range(1024, 1100)))
    assert unsound("lost", recipes.where("doc_id < 1024")) == (1024, set(range(1024)))
    tree = spark.read.parquet(f"file://{tmp_path}/store/merkle")
    assert unsound("cut_tree", tree.where("level = 1"), "merkle") == (1100, set(range(1100)))
    with pytest.raises(ValueError):
        unsound("all_lost", recipes.limit(0))


def test_shared_passages_share_chunks():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 40000, 5000)

    def chunks(ids):
        ends = token_store.cut_points(len(ids), np.flatnonzero((token_store.rolling_hash(ids) & np.uint32(255)) == 0) + 1, 64, 1024)
        assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= 1024
        return {ids[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    a, b = (chunks(np.concatenate([rng.integers(0, 40000, n), passage])) for n in (700, 1333))
    assert len(a & b) > 5


def check_pieces(got, docs, encode, capacity=1024):
    """Every id in one piece, sequences gapless and within capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for key, text in docs.items():
        ids, at = encode(text, 0), 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return len(by_sequence)


def test_packing_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op3_packing(spark, sf_dir).collect()
    used = check_pieces(got, docs, library("byte_bpe_50k.json"))
    assert used <= -(-sum(r["length"] for r in got) // 1024) * 1.02 + 1


def test_packing_edges(spark):
    model, rows = tokens.tokenizer_file("byte_bpe_50k.json"), [e for e in EDGES if e[0] != 3]
    check_pieces(packing.pack(frame(spark, rows), model, 0).collect(), dict(rows), library("byte_bpe_50k.json"))
    twice = packing.pack(frame(spark, EDGES), model, 0).collect()
    assert sum(r["doc_id"] == 3 for r in twice) == 2
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == len(twice)
    assert packing.pack(frame(spark, EDGES).limit(0), model, 0).isEmpty()


def test_fill_is_as_close_as_any_multiset():
    rng = random.Random(2)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        seed, best = max(counts), 0
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n - (k == seed) + 1)}
        best = max(s + seed for s in sums if s + seed <= 40)
        used = packing.fill(counts, 40, seed)
        assert sum(k * n for k, n in used.items()) == best
        assert all(n <= counts[k] for k, n in used.items())
