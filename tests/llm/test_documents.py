"""Quality, mixing, fingerprints, duplicates and the pipeline against brute force."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import corpus_pipeline
from folium.llm import exact, mixing, quality, queries, simhash, winnow

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
EDGES = [(1, None, None), (2, "", "a"), (3, "One two three four", "a"), (3, "One two three four", "a"), (None, "no id here", "b"), (5, " \t\n", "b"), (6, "word word word, " * 5000, None), (7, "one TWO three four", "b"), (8, "ÄÖ one", "ä")]


def frame(spark, rows=EDGES):
    return spark.createDataFrame([(*r, 5, "x", None) for r in rows], "doc_id long, text string, source string, rid int, digest string, level string")


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


# --- quality


def test_quality_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op2_quality(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) and r["held_out"] == quality.held_out_reference(r["doc_id"]) for r in got)
    held = [r["predicted"] == label[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 50 and np.mean(held) >= 0.95


def test_labels_of_held_out_rows_change_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert all(np.array_equal(a.p[k], b.p[k]) for k in a.p)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m, x, n, y = quality.AttentionModel(5, 4, 3), rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m._forward(x, n)[-1]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in m.gradients(x, n, y).items():
        for i in np.ndindex(m.p[k].shape):
            m.p[k][i] += 1e-6
            up = loss()
            m.p[k][i] -= 2e-6
            down = loss()
            m.p[k][i] += 1e-6
            assert abs((up - down) / 2e-6 - g[i]) < 1e-5
    assert np.allclose(np.add.reduceat(m.attention(x, n), [0, 3, 4]), 1)


def test_quality_edges(spark):
    docs = frame(spark)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(3, 0)], "doc_id long, quality int")
    model = quality.train(docs, one)
    assert len(quality.score(docs, model).collect()) == len(EDGES)
    assert quality.score(docs.limit(0), model).isEmpty()
    assert quality.keep(docs, model, 0.7).schema == docs.schema


# --- mixing


def test_mix_comes_near_its_targets(spark, sf_dir):
    got = queries.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["source"] for r in documents(spark, "/root/testdata/sf0.01")}
    taken, target, size = Counter(), {}, {}
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3 * sum(size.values()) or all(abs(target[s] - 3 * size[s]) < 1 for s in size)
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.03 * target[s], 3 * max(r["size"] for r in got if source[r["doc_id"]] == s))


def test_mix_is_the_same_again_and_in_any_order(spark):
    rows = lambda df: sorted(map(str, mixing.mix(df).collect()))
    assert rows(frame(spark)) == rows(frame(spark, EDGES[::-1]).repartition(5))
    got = mixing.mix(frame(spark)).collect()
    assert [r["size"] for r in got if r["doc_id"] in (1, 2, 5)] == [0, 0, 0]
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(frame(spark).limit(0)).isEmpty()


# --- fingerprints


def naive_hash(run):
    """A polynomial over whole numbers, mixed: what the doubling in arrays has to come to."""
    h = 0
    for c in run:
        h = h * 0x100000001B3 + (c + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9
    h %= 2**64
    h = (h ^ h >> 29) * 0x94D049BB133111EB % 2**64
    return h >> 32


def naive_winnow(text, k=winnow.K, w=winnow.W):
    """Least hash per window, rightmost of equal ones, from hashes of the runs one by one."""
    codes = [ord(c) for c in text]
    if not codes:
        return []
    if len(codes) < k:
        short = codes + [0] * (k - len(codes))
        short[-1] ^= len(codes) << 24
        return [(naive_hash(short), 0)]
    h = [naive_hash(codes[i : i + k]) for i in range(len(codes) - k + 1)]
    places = []
    for i in range(max(1, len(h) - w + 1)):
        window = h[i : i + w]
        low = min(window)
        p = i + len(window) - 1 - window[::-1].index(low)
        if not places or places[-1] != p:
            places.append(p)
    return [(h[p], p) for p in places]


def naive_digest(marks):
    return hashlib.md5(b"".join(h.to_bytes(4, "little") for h, _ in marks) + b"".join(p.to_bytes(8, "little") for _, p in marks)).hexdigest()


def test_winnow_against_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé 🙂") for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["a" * 80, "x" * 16, "", "z"]
    for text, (h, p) in zip(texts, winnow.winnow(texts), strict=True):
        assert list(zip(h.tolist(), p.tolist())) == naive_winnow(text)
    shared = "".join(rng.choice("abcdefgh") for _ in range(winnow.K + winnow.W - 1))
    a, b = winnow.winnow(["left part " + shared + " and", "other " + shared])
    assert set(a[0].tolist()) & set(b[0].tolist())


@pytest.mark.parametrize("ranges", [None, 50])
def test_fingerprint_query_against_brute_force(spark, sf_dir, ranges):
    docs = sorted(((r["doc_id"], (r["text"] or "")[:3000]) for r in documents(spark, sf_dir)), reverse=True)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = queries.op5_winnowing(spark, sf_dir) if ranges is None else winnow.fingerprint_pairs(table, ranges)
    if ranges is None:  # whole texts, of which the short ones are checked
        docs = sorted(((r["doc_id"], r["text"] or "") for r in documents(spark, sf_dir)), reverse=True)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == len(docs)
    for i, (key, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(text) + len(following) > 6000:
            continue
        marks = [naive_winnow(t) for t in (text, changed, following)]
        sets = [{h for h, _ in m} for m in marks]
        near = [len(sets[0] & x) / len(sets[0] | x) if sets[0] | x else 1.0 for x in sets[1:]]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (naive_digest(marks[0]), naive_digest(marks[1]))
        assert [r["near_edited"], r["near_next"]] == pytest.approx(near)


def test_fingerprint_edges(spark):
    got = winnow.fingerprint_pairs(frame(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(e[0] for e in EDGES)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[1]["n_chars"] == 0
    assert winnow.fingerprint_pairs(frame(spark).limit(0)).isEmpty()
    (alone,) = winnow.fingerprint_pairs(frame(spark, [(9, "alone in the table", "a")])).collect()
    assert alone["near_next"] == 1.0


# --- exact duplicates


def test_exact_edges_and_a_second_batch(spark):
    index = exact.DigestIndex(spark, buckets=4)
    first = {(r["doc_id"], r["kept"]): r for r in exact.deduplicate(frame(spark), index).collect()}
    assert sorted(k[0] for k in first if k[1] and k[0]) == [2, 5, 6, 7, 8]
    assert first[(3, False)]["keep_id"] == 7 and first[(3, False)]["group_size"] == 3
    assert first[(1, False)]["keep_id"] == 2
    again = exact.deduplicate(frame(spark, [(20, "ONE two three FOUR", "z"), (21, "new", "z"), (22, "NEW", "z")]), index).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in again) == [(20, 7, False), (21, 22, False), (22, 22, True)]
    assert index.table().count() == index.table().select("digest").distinct().count() == 7
    assert exact.deduplicate(frame(spark).limit(0)).isEmpty()


# --- near duplicates


def naive_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps: dict):
    left, out = set(fps), {}
    while left:
        start = min(left)
        group, todo = {start}, [start]
        while todo:
            a = todo.pop()
            new = {b for b in left - group if (fps[a] ^ fps[b]).bit_count() <= 3}
            group |= new
            todo += new
        out |= dict.fromkeys(group, start)
        left -= group
    return out


def test_simhash_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    fps = {r["doc_id"]: naive_fingerprint(r["text"]) for r in documents(spark, sf_dir)}
    expected = naive_components(fps)
    got = queries.op8_simhash(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{fps[k]:016x}", expected[k]) for k in fps}
    assert len(set(expected.values())) < len(fps)


def test_simhash_edges(spark):
    got = simhash.near_duplicates(frame(spark)).collect()
    assert len(got) == len(EDGES)
    assert {r["fp"] for r in got if r["doc_id"] in (1, 2, 5)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 5)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 7)} == {3}
    assert simhash.near_duplicates(frame(spark).limit(0)).isEmpty()


def near_values(rng):
    """Fingerprints in groups: bits flipped anywhere, in three bytes only, and bytes replaced so that pairs share four."""
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(40):
        seed = rng.getrandbits(64)
        low = [rng.randrange(8) * 8 for _ in range(3)]
        for _ in range(12):
            v = seed
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << (rng.choice(low) + rng.randrange(8) if rng.random() < 0.5 else rng.randrange(64))
            values.add(v)
        for _ in range(3):
            kept = rng.sample(range(8), 4)
            values.add(sum((seed if p in kept else rng.getrandbits(64)) & 255 << 8 * p for p in range(8)))
    return sorted(values)


def sorted_batches(rows, size=97):
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    return [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size, c].copy()) for c in (0, 1)], names=["key", "fp"]) for i in range(0, len(rows), size)]


@pytest.mark.parametrize(("long", "seed"), [(5, 4), (3000, 4), (2, 5)])
def test_index_connects_what_lies_near_and_nothing_else(long, seed, monkeypatch):
    monkeypatch.setattr(simhash, "LONG", long)
    values = near_values(random.Random(seed))
    fps = np.array(values, np.uint64).view(np.int64)
    posted = [b for b in simhash._postings([pa.RecordBatch.from_arrays([pa.array(fps)], names=["fp"])])]
    rows = np.stack([np.concatenate([b.column(c).to_numpy() for b in posted]) for c in (0, 1)], axis=1)
    assert len(rows) == 35 * len(values)
    found = pa.Table.from_batches(list(simhash._links(sorted_batches(rows))), schema=simhash._FOUND).to_pydict()
    again = np.array([(k, a) for k, a in zip(found["again"], found["a"], strict=True) if k], np.int64).reshape(-1, 2)
    assert (len(again) > 0) == (long < 3000)
    links = [(a, b) for k, a, b in zip(found["again"], found["a"], found["b"], strict=True) if not k]
    if len(again):
        again = np.unique(again, axis=0)
        more = pa.Table.from_batches(list(simhash._long_links(sorted_batches(again))), schema=simhash._FOUND).to_pydict()
        links += zip(more["a"], more["b"], strict=True)
    group = {v: v for v in fps.tolist()}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        group[max(a, b)] = min(a, b)
    unsigned = {v: v & 2**64 - 1 for v in group}
    expected = naive_components(unsigned)
    by_root = defaultdict(set)
    for v in group:
        by_root[top(v)].add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(sorted(v for v in expected if expected[v] == r) for r in set(expected.values()))
    assert len(by_root) < len(values)


def test_tally_rejects_pairs_before_they_are_verified():
    values = np.array(near_values(random.Random(6)), np.uint64)
    met = set()
    for c, positions in enumerate(simhash.CHOICES):
        lists = defaultdict(list)
        for v, k in zip(values.tolist(), simhash._key(values, c, positions).tolist(), strict=True):
            lists[k].append(v)
        met |= {(a, b) for own in lists.values() for i, a in enumerate(own) for b in own[i + 1 :]}
    a, b = (np.array([p[i] for p in sorted(met)], np.uint64) for i in (0, 1))
    tally = simhash.shared_bytes(a ^ b)
    assert tally.tolist() == [sum(x.to_bytes(8)[i] == y.to_bytes(8)[i] for i in range(8)) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    near = {(x, y) for x in values.tolist() for y in values.tolist() if x < y and (x ^ y).bit_count() <= 3}
    assert near <= met
    assert (tally == 4).sum() > 50 and (tally >= 5).sum() > len(near)
    assert {(int(a[i]), int(b[i])) for i in simhash.passing(a, b)} == near


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400}


# --- pipeline


def test_pipeline_stages(spark, sf_dir):
    from folium.llm._io import materialize, table

    docs, kept = table(spark, sf_dir, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == before.columns
        kept[name] = docs.select("doc_id", "text").collect()
    after = kept["exact_dedup"]
    lowered = [r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for r in after]
    assert len(set(lowered)) == len(lowered)
    last = {}
    for r in kept["quality"]:
        key = r["text"].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in after} == set(last.values())
    roots = naive_components({r["doc_id"]: naive_fingerprint(r["text"]) for r in after})
    assert {r["doc_id"] for r in kept["simhash_near_dedup"]} == set(roots.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = defaultdict(int)
    for r in pieces:
        whole[r["doc_id"]] += r["length"]
    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert max(times.values()) <= 3
    assert all(whole[r["doc_id"]] == r["doc_tokens"] * times[r["doc_id"]] for r in pieces)


def test_near_stage_keeps_one_of_each_group_whatever_the_ids(spark, sf_dir):
    rng = random.Random(9)
    text = {k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for k in "abcd"}
    rows = [(None, text["a"]), (None, text["a"].upper()), (None, text["b"]), (None, text["b"].upper()), (5, text["c"]), (9, text["c"].upper()), (8, text["d"].upper()), (5, text["d"])]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted((r["text"].lower(), r["doc_id"]) for r in kept) == sorted((text[k], key) for k, key in zip("abcd", (None, None, 5, 5), strict=True))


def test_quality_and_packing_stages_on_edges(spark, sf_dir):
    clash = "doc_id long, text string, source string, score double, length long, row long, share int, label int"
    rows = [(*e, 0.5, 7, 8, 9, None) for e in EDGES] + [(9, "word " * 60_000, "s", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, clash)
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r["length"] for r in kept.collect()} <= {7, None}
    # no document has a label: nothing to learn from, nothing is rejected
    assert kept.count() == len(rows)
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), sf_dir).isEmpty()
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r[0] for r in rows)
    assert sum(r["length"] for r in pieces if r["doc_id"] == 9) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == 9) > 60_000
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf_dir).isEmpty()


def test_training_is_the_same_whatever_the_order_of_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i % 40, " ".join(rng.choice(["good", "prose", "###", "$$$"][2 * (i % 2) : 2 * (i % 2) + 2]) for _ in range(30))) for i in range(160)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = [quality.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 2), (rows[::-1], 5))]
    assert all(np.array_equal(models[0].p[k], models[1].p[k]) for k in models[0].p)


def test_mixing_is_the_same_whatever_the_order_of_like_rows(spark):
    rows = [(None if i % 3 else 1, f"five words of text {i}", "s" if i % 4 else None) for i in range(200)]
    taken = []
    for r, n in ((rows, 2), (rows[::-1], 7)):
        docs = spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)
        sized = docs.select("doc_id", "source", "text", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
        taken.append(sorted((x["text"], x["copies"]) for x in mixing.copies(sized).collect()))
    assert taken[0] == taken[1] and len({c for _, c in taken[0]}) > 1


def test_operators_work_first_thing_in_a_session_from_elsewhere(tmp_path):
    """Workers find the package although the driver's folder isn't on their path."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
from folium.llm import html, simhash
pages = spark.createDataFrame([(1, "u", "<article><p>one</p></article>")], "page_id long, url string, html string")
assert html.main_text(pages).first()["text"] == "one"
assert simhash.near_duplicates(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).count() == 1
print("worked")
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "worked" in done.stdout, done.stderr[-2000:]


def test_pipeline_stages_on_edges(spark, sf_dir):
    rows = [(*e, 1, 2, "own") for e in EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row_number long, times int, rid string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and {r["rid"] for r in out.collect()} <= {"own"}, name
        assert stage(spark, docs.limit(0), sf_dir).isEmpty(), name
    assert corpus_pipeline.exact_stage(spark, docs, sf_dir).count() == 6
