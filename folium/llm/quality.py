"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage is encoded by what its bytes are (shares of byte
classes, of pairs of classes, and of distinct 5-grams), mapped to a hidden vector, and weighed by gated attention; the
weighted sum represents the document and is scored by a logistic unit. Document labels alone train all of it, on the
driver, with at most ``max_docs`` labelled documents, the ones with the least hash of their id, and no document of more
than ``max_passages`` passages. Scoring reads every document whole.

Defined results: null or empty text is a bag of one empty passage; labels that are null, conflicting (the
larger quality holds) or held out take no part in training; of repeated ids with different texts the one
with the least hash is learned from; with no label of either class left to learn from,
the score is the labels' mean, 1 if there is none; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm._io import slices, text_column
from folium.session import ship

PASSAGE = 512
_SLOTS = 512


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    marks = b".,!?;:'\"()[]{}<>|/\\#$%&*+-=_@~^`"
    for v in range(256):
        c = chr(v)
        if v >= 128:
            fine[v], coarse[v] = 0, 1 if v >= 192 else 0
        elif c.islower():
            fine[v], coarse[v] = 1 + (v - 97), 0
        elif c.isupper():
            fine[v], coarse[v] = 27, 2
        elif c.isdigit():
            fine[v], coarse[v] = 28, 3
        elif c == " ":
            fine[v], coarse[v] = 29, 4
        elif c.isspace():
            fine[v], coarse[v] = 30, 5
        elif v in marks:
            fine[v], coarse[v] = 31 + marks.index(v), 6 if c in ".,;:!?'\"-" else 7
        else:
            fine[v], coarse[v] = 31 + len(marks), 7
    return fine, coarse


_FINE, _COARSE = _byte_classes()
_N_FINE = int(_FINE.max()) + 1
WIDTH = _N_FINE + 64 + 3


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the number of passages of each text."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    n = np.maximum(1, -(-sizes // PASSAGE))
    raw = np.frombuffer(b"".join(data), np.uint8)
    total, first = int(n.sum()), np.cumsum(n) - n
    own = np.repeat(first, sizes) + (np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // PASSAGE
    length = np.bincount(own, minlength=total)
    scale = 1.0 / np.maximum(1, length)
    x = np.zeros((total, WIDTH), np.float32)
    x[:, :_N_FINE] = np.bincount(own * _N_FINE + _FINE[raw], minlength=total * _N_FINE).reshape(total, -1) * scale[:, None]
    if len(raw) > 4:
        c = _COARSE[raw]
        inside = own[1:] == own[:-1]
        x[:, _N_FINE : _N_FINE + 64] = np.bincount((own[1:] * 64 + c[:-1] * 8 + c[1:])[inside], minlength=total * 64).reshape(total, -1) * scale[:, None]
        r = raw.astype(np.uint32)
        h = r[:-4] * np.uint32(0x9E3779B1)
        for i, m in enumerate((0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1), 1):
            h = (h ^ (h >> np.uint32(13))) * np.uint32(5) + r[i : len(r) - 4 + i] * np.uint32(m)
        inside = own[4:] == own[:-4]
        used = np.zeros(total * _SLOTS, bool)
        used[(own[:-4] * _SLOTS + (h >> np.uint32(16)) % _SLOTS)[inside]] = True
        distinct = used.reshape(total, _SLOTS).sum(axis=1)
        grams = np.maximum(1, np.minimum(length, PASSAGE) - 4)
        x[:, -3] = distinct / (_SLOTS * -np.expm1(-grams / _SLOTS))
    x[:, -2] = np.log1p(length) / 7
    x[:, -1] = np.repeat(np.log1p(sizes) / 12, n)
    return x, n


class AttentionModel:
    """Hidden encoder, gated attention and logistic score; ``hidden`` and ``gate`` are the widths."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.mean, self.spread = np.zeros(width), np.ones(width)
        self.p = {"W": near(width, hidden), "b": np.zeros(hidden), "V": near(hidden, gate), "U": near(hidden, gate), "w": near(gate), "c": near(hidden), "d": np.zeros(1)}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, n: np.ndarray):
        p, start = self.p, np.cumsum(n) - n
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, start), n))
        a = e / np.repeat(np.add.reduceat(e, start), n)
        z = np.add.reduceat(a[:, None] * h, start, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return h, t, g, a, z, y

    def scale(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.full(len(n), self.constant) if self.constant is not None else self._forward(self.scale(x), n)[-1]

    def attention(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The passages' weights; they add up to 1 in each document."""
        return self._forward(self.scale(x), n)[3]

    def gradients(self, x: np.ndarray, n: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, a, z, y = self._forward(x, n)
        dl = (y - label) / len(n)
        dz = np.repeat(dl[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(axis=1)
        start = np.cumsum(n) - n
        ds = a * (da - np.repeat(np.add.reduceat(a * da, start), n))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ dl, "d": np.array([dl.sum()])}

    def fit(self, x: np.ndarray, n: np.ndarray, label: np.ndarray, steps: int = 1500, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
        if len(set(label.tolist())) < 2:
            self.constant = float(label[0]) if len(label) else 1.0
            return self
        self.mean = x.mean(axis=0, dtype=np.float64)
        self.spread = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x, dtype=np.float64) / len(x) - self.mean**2, 0)) + 1e-3
        start = np.cumsum(n) - n
        rng, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for step in range(1, steps + 1):
            pick = rng.choice(len(n), min(batch, len(n)), replace=False)
            rows = np.concatenate([np.arange(start[i], start[i] + n[i]) for i in pick])
            for k, d in self.gradients(self.scale(x[rows]), n[pick], label[pick]).items():
                d = d + decay * self.p[k] * (k not in "bd")
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                self.p[k] = self.p[k] - rate * (1 - 0.9 * step / steps) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _encoded(batches):
    for b in batches:
        y, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        for a, z in slices(texts):
            x, n = encode(texts[a:z])
            ends = np.cumsum(n)
            data = [x[e - k : e].astype(np.float32).tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y[a:z], pa.int32()), pa.array(n), pa.array(data, pa.binary())], names=["y", "n", "x"])


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_passages: int = 64) -> AttentionModel:
    """Learn from ``labels(doc_id, quality)`` that aren't held out and the texts of ``docs(doc_id, text)``.

    At most ``max_docs * max_passages`` passages of 4 * ``WIDTH`` bytes come to the driver (134 MB), which holds up to three copies.
    """
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most ``max_docs`` rows of two numbers: small enough to broadcast whatever the tables' size
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    bags = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text")).join(F.broadcast(chosen), "doc_id")
    bags = bags.where(F.octet_length("text") <= PASSAGE * max_passages).groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = bags.select("quality", "text").mapInArrow(_encoded, "y int, n long, x binary").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    n, y = rows.column("n").to_numpy(), rows.column("y").to_numpy().astype(np.float64)
    # rows come in no fixed order
    start = np.cumsum(n) - n
    order = sorted(range(len(n)), key=lambda i: (int(n[i]), y[i], x[start[i] : start[i] + n[i]].tobytes()))
    x = np.concatenate([x[start[i] : start[i] + n[i]] for i in order]) if order else x
    return AttentionModel().fit(x, n[order] if order else n, y[order] if order else y)


def _scorer(model: AttentionModel):
    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            scores = [model.score(*encode(texts[a:z])) for a, z in slices(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``doc_id, score`` for every row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column()).mapInArrow(_scorer(model), "doc_id long, score double")


def _keeper(model: AttentionModel, least: float):
    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            scores = np.concatenate([model.score(*encode(texts[a:z])) for a, z in slices(texts)]) if texts else np.empty(0)
            yield b.filter(pa.array(scores >= least))

    return run


def keep(docs: DataFrame, model: AttentionModel, least: float) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, with all their columns; texts are never shuffled."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_keeper(model, least), docs.schema)


def held_out_reference(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2
