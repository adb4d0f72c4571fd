"""Term weights, similarity pairs, components, truncated SVD."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import normalized, words
from folium.session import shared_root


def token_counts(docs: DataFrame, stop_words: DataFrame | None = None, categories: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, term, tf``: normalised words as ``token:<w>`` and, if given, ``categories(key, category)`` as ``category:<c>``."""
    found = docs.select(key, F.explode(F.transform(words(F.col(text)), normalized)).alias("w")).where("w <> ''")
    if stop_words is not None:
        found = found.join(stop_words.select(F.col("word").alias("w")), "w", "left_anti")
    rows = found.select(key, F.concat(F.lit("token:"), "w").alias("term"))
    if categories is not None:
        rows = rows.unionByName(categories.select(key, F.concat(F.lit("category:"), "category").alias("term")))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"))


def global_weights(counts: DataFrame, kind: str = "entropy") -> DataFrame:
    """``term, w``. For ``idf`` and ``entropy`` the collection's size is its number of distinct terms.

    Entropy weights are 1 and more: ``1 - (sum(tf ln tf) - gf ln gf) / (ln V * gf)``.
    """
    tf = F.col("tf").cast("double")
    per = counts.where("tf > 0").groupBy("term").agg(F.sum("tf").alias("gf"), F.count("*").alias("df"), F.sum(tf * tf).alias("sq"), F.sum(tf * F.log(tf)).alias("e"))
    gf, df = F.col("gf").cast("double"), F.col("df").cast("double")
    if kind in ("idf", "entropy"):
        per = per.crossJoin(F.broadcast(per.agg(F.count("*").cast("double").alias("v"))))  # one row
    w: Column = {
        "binary": F.lit(1.0),
        "normal": 1 / F.sqrt("sq"),
        "gfidf": gf / df,
        "idf": F.log2(F.col("v") / (1 + df)) if kind == "idf" else F.lit(None),
        "entropy": 1 - (F.col("e") - gf * F.log(gf)) / (F.log("v") * gf) if kind == "entropy" else F.lit(None),
    }[kind]
    return per.select("term", w.alias("w"))


def local_weight(tf: Column, kind: str = "log") -> Column:
    return {"binary": F.when(tf > 0, 1.0).otherwise(0.0), "tf": tf.cast("double"), "log": F.log1p(tf.cast("double"))}[kind]


def features(counts: DataFrame, local: str = "log", globally: str = "entropy", key: str = "doc_id") -> DataFrame:
    """``key, term, w``: local times global weight."""
    g = global_weights(counts, globally).withColumnRenamed("w", "g")
    return counts.where("tf > 0").join(g, "term").select(key, "term", (local_weight(F.col("tf"), local) * F.col("g")).alias("w"))


def without_excluded(rows: DataFrame, excluded: DataFrame, key: str = "doc_id", value: str = "w") -> DataFrame:
    """Rows of excluded documents stay, with zero for a value."""
    flag = excluded.select(key).distinct().withColumn("_x", F.lit(True))
    return rows.join(flag, key, "left").withColumn(value, F.when(F.col("_x"), F.lit(0.0)).otherwise(F.col(value))).drop("_x")


def shape(rows: DataFrame, row: str, col: str) -> DataFrame:
    """Rows, columns (largest id and one) and non-zeros of a long matrix."""
    return rows.agg(F.countDistinct(row).alias("n_rows"), (F.max(col) + 1).alias("n_cols"), F.count_if(F.lit(True)).alias("nnz"))


def _met_blocks(vectors: DataFrame, key: str, vector: str, rows_per_block: int) -> DataFrame:
    """``b, k, v, b2, k2, v2``: every pair of blocks of rows once, spread evenly. A row is sent to half the blocks in its own type."""
    n = vectors.count()
    blocks = max(1, -(-n // rows_per_block), min(8, n // 1024))
    packed = vectors.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("b"), F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    packed = packed.groupBy("b").agg(F.collect_list(F.struct("k", "v")).alias("e")).select("b", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    other = packed.select(*(F.col(c).alias(f"{c}2") for c in ("b", "k", "v")))
    # a block meets itself and the blocks of half the circle after it; of an even circle's opposite blocks, one meets the other
    steps = F.sequence(F.lit(0), F.lit(blocks // 2) if blocks % 2 else F.when(F.col("b") < blocks // 2, blocks // 2).otherwise(max(0, blocks // 2 - 1))) if blocks > 1 else F.array(F.lit(0))
    sent = packed.withColumn("b2", F.explode(F.transform(steps, lambda d: F.pmod(F.col("b") + d, F.lit(blocks)))))
    tasks = min(4 * blocks, 1000)
    return sent.repartition(tasks, "b2").join(other.repartition(tasks, "b2").hint("merge"), "b2").select("b", "k", "v", "b2", "k2", "v2")


def _block_task(threshold: float, inclusive: bool, links_only: bool, tile: int = 1024):
    """A task over pairs of blocks: all pairs over the threshold, or links that join the same rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(ks, vs, at):
            v = vs[at].values
            k, n = ks[at].values.to_numpy(), len(v)
            m = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            return k, m, np.where(norm > 0, norm, 1.0), ~m.any(axis=1)

        def hits(a, b, own):
            (k, m, s, zero), (k2, m2, s2, zero2) = a, b
            c = m @ m2.T
            # a zero vector's product is taken as it is
            c /= np.where(zero[:, None] | zero2, 1.0, s * s2.T) if zero.any() or zero2.any() else s * s2.T
            hit = c >= threshold if inclusive else c > threshold
            hit &= (k[:, None] < k2[None, :]) if own else (k[:, None] != k2[None, :])
            x, y = np.divmod(np.flatnonzero(hit), len(k2))
            return x, y, c[x, y]

        def merged(label, p, q):
            """Labels after rows labelled p and q are joined; a label is the least row of its set."""
            while (apart := p != q).any():
                p, q = p[apart], q[apart]
                up = np.arange(len(label))
                np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
                while not np.array_equal(far := up[up], up):
                    up = far
                label, p, q = up[label], up[p], up[q]
            return label

        for t in batches:
            b, b2, k, v, k2, v2 = (t.column(c) for c in ("b", "b2", "k", "v", "k2", "v2"))
            for at in range(t.num_rows):
                own = b[at].as_py() == b2[at].as_py()
                one = rows(k, v, at)
                two = one if own else rows(k2, v2, at)
                n, shift = len(one[0]), 0 if own else len(one[0])
                label = np.arange(n + (0 if own else len(two[0])))
                for x0 in range(0, n, tile):
                    # in a block's pair with itself a link is found from its lesser key, which may stand in either tile
                    for y0 in range(0, len(two[0]), tile):
                        xs, ys = slice(x0, x0 + tile), slice(y0, y0 + tile)
                        if links_only:
                            lx, ly = label[xs], label[y0 + shift : min(y0 + tile, len(two[0])) + shift]
                            if (own and y0 < x0) or ((lx == lx[0]).all() and (ly == lx[0]).all()):
                                continue  # found already, or nothing here is apart
                        x, y, c = hits([z[xs] for z in one], [z[ys] for z in two], own and not (links_only and x0 != y0))
                        if links_only:
                            label = merged(label, lx[x], ly[y])
                        elif len(x):
                            i, j = one[0][xs][x], two[0][ys][y]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(c)], ["i", "j", "cos"])
                if links_only:
                    keys = one[0] if own else np.concatenate([one[0], two[0]])
                    node = np.flatnonzero(label != np.arange(len(label)))
                    i, j = keys[label[node]], keys[node]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["i", "j"])

    return run


def block_pairs(vectors: DataFrame, threshold: float, inclusive: bool = False, key: str = "vec_id", vector: str = "embedding", rows_per_block: int = 16384) -> DataFrame:
    """``i, j, cos`` of all pairs i < j over a threshold.

    Vectors are packed into blocks of rows and every pair of blocks meets once in a task, which multiplies tile by tile;
    only pairs over the threshold become rows. All pairs is what is asked for; the work is quadratic, its memory is two
    blocks and a tile, and a row is sent once for every 32768 rows.
    """
    return _met_blocks(vectors, key, vector, rows_per_block).mapInArrow(_block_task(threshold, inclusive, False), "i long, j long, cos double")


def block_links(vectors: DataFrame, threshold: float, inclusive: bool = False, key: str = "vec_id", vector: str = "embedding", rows_per_block: int = 16384) -> DataFrame:
    """``i, j``: of the pairs of ``block_pairs`` as many as connect the same rows, at most one for each row and pair of blocks.

    Every pair that could join two sets is looked at; pairs within a set known to hang together aren't multiplied.
    """
    return _met_blocks(vectors, key, vector, rows_per_block).mapInArrow(_block_task(threshold, inclusive, True), "i long, j long")


def sparse_pairs(rows: DataFrame, threshold: float, key: str = "doc_id", term: str = "term", value: str = "w") -> DataFrame:
    """``i, j, cos`` of documents that share a term, over the inverted list: products meet term by term.

    A term in many documents gives quadratically many products; give it terms worth matching on (weights, stop words).
    """
    norm = rows.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("n"))
    unit = rows.join(norm, key).where("n > 0").select(key, term, (F.col(value) / F.col("n")).alias("u"))
    a, b = unit.select(F.col(key).alias("i"), term, F.col("u").alias("x")), unit.select(F.col(key).alias("j"), term, F.col("u").alias("y"))
    return a.join(b, term).where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("cos")).where(F.col("cos") > threshold)


def pair_stats(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n_pairs"), F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("sigma"))


def symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select("i", "j").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def components(pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` of the pairs ``i, j``: the least node each reaches.

    Labels go to neighbours and then jump to their label's label, so rounds grow with the logarithm of a chain's length;
    each round is checkpointed.
    """
    spark = pairs.sparkSession
    shared_root(spark)
    edges = symmetric(pairs.where("i <> j")).checkpoint()
    labels = edges.groupBy(F.col("i").alias("node")).agg(F.least(F.min("j"), F.col("i")).alias("component")).checkpoint()
    for _ in range(max_rounds):
        near = edges.join(labels, edges["j"] == labels["node"]).groupBy("i").agg(F.min("component").alias("c"))
        moved = labels.join(near, labels["node"] == near["i"]).select("node", F.least("component", "c").alias("component"))
        own = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = moved.join(own, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component")).checkpoint()
        changed = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = new
        if changed:
            return labels
    raise RuntimeError("components did not settle")


def component_sets(found: DataFrame, names: DataFrame) -> DataFrame:
    """``component, size, names`` of ``node, component``: the sets of similar documents by name."""
    listed = found.join(names.select(F.col("id").alias("node"), "name"), "node")
    return listed.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("name")).alias("names"))


def named(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Ids in ``columns`` replaced by their names of ``names(id, name)``."""
    for c in columns:
        rows = rows.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c)
    return rows


def svd(rows: DataFrame, rank: int = 10, row: str = "row", col: str = "col", value: str = "value", n_cols: int | None = None):
    """Truncated SVD of a long matrix: ``(u, s, v)``; ``u`` is ``row, component, value``, ``s`` an array, ``v`` columns by rank.

    The rank is cut to the matrix's. ``u * s`` are the scores and ``v`` the components of a PCA without centring.
    """
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    n = n_cols or rows.agg(F.max(col)).first()[0] + 1
    grouped = rows.where(F.col(value) != 0).groupBy(row).agg(F.sort_array(F.collect_list(F.struct(col, value))).alias("e"))
    # the distributed decomposition takes rows as objects; its left vectors are made again by a join, not row by row
    matrix = IndexedRowMatrix(grouped.rdd.map(lambda r: IndexedRow(r[0], SparseVector(n, [x[0] for x in r[1]], [float(x[1]) for x in r[1]]))), numCols=n)
    found = matrix.computeSVD(min(rank, n, max(1, grouped.count())), computeU=False)
    s, v = found.s.toArray(), found.V.toArray()
    return fold_in(rows.select(F.col(row).alias("row"), F.col(col).alias("col"), F.col(value).alias("value")), s, v), s, v


def pca(rows: DataFrame, rank: int = 10):
    """Scores ``row, component, value`` (left vectors times singular values) and components (right vectors), without centring."""
    u, s, v = svd(rows, rank)
    sigma = rows.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(s)], "component int, s double")
    return u.join(F.broadcast(sigma), "component").select("row", "component", (F.col("value") * F.col("s")).alias("value")), v


def symmetric_eigen(rows: DataFrame, rank: int = 10):
    """Largest eigenvalues by size, and vectors, of a symmetric long matrix ``row, col, value``."""
    import numpy as np

    _, s, v = svd(rows, rank)
    product = rows.join(rows.sparkSession.createDataFrame([(j, k, float(x)) for j, r in enumerate(v) for k, x in enumerate(r)], "col long, component int, x double"), "col")
    rayleigh = product.groupBy("row", "component").agg(F.sum(F.col("value") * F.col("x")).alias("y")).collect()
    sign = np.zeros(len(s))
    for r in rayleigh:
        sign[r["component"]] += r["y"] * v[r["row"]][r["component"]]
    return s * np.sign(sign), v


def fold_in(rows: DataFrame, s, v) -> DataFrame:
    """New documents' coordinates, ``row, component, value``: their rows times V over the singular values."""
    base = rows.sparkSession.createDataFrame([(j, k, float(x / s[k])) for j, r in enumerate(v) for k, x in enumerate(r) if s[k] > 0], "col long, component int, x double")
    return rows.join(base, "col").groupBy("row", "component").agg(F.sum(F.col("value") * F.col("x")).alias("value"))


def similar_names(pairs: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """Pairs of at least a threshold with names, best first."""
    return named(pairs.where(F.col("cos") >= threshold), names, ["i", "j"]).orderBy(F.desc("cos"), "i", "j")


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node, with both directions of a pair."""
    both = pairs.select("i", "j", "cos").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "cos"))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cos"), "j"))).where(F.col("r") <= k)
