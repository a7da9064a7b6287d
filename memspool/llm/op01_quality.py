"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Two streams of word n-grams are hashed into one table of weights: of the words
as they stand (lower case, letters and digits), and of their shapes (capitals, small letters,
digits and marks, runs made one, and a mark for a word equal to the one before).  Counts are
damped by a logarithm and each stream is scaled to length one.  Weights are fitted with
FTRL-proximal updates (McMahan et al., 2013), and a score is a sparse dot product.

The fit uses a bounded sample: ``per_label`` documents of each label at most, chosen by a hash of
the id.  Every document is scored, over its whole text.

Defined cases: a null or wordless text has no features and gets the score of the bias; without
labelled rows all scores are 0.5; rows that repeat are scored each; empty tables give an
empty result.  Only the columns named are read, so that others can't clash.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, text_bytes, training_sample

_CACHE_WORDS = 300_000


@dataclass(frozen=True)
class QualityParams:
    buckets: int = 1 << 18
    word_n: int = 2
    shape_n: int = 3
    per_label: int = 1536
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 2e-3
    l2: float = 1e-3


class Featurizer:
    """Sparse features of a text in UTF-8: bucket numbers, ascending, and values."""

    def __init__(self, p: QualityParams) -> None:
        self.p, self.cache = p, {}
        kind = bytearray(range(256))
        for c in range(256):
            b = bytes([c])
            kind[c] = ord("X") if b.isupper() else ord("x") if b.islower() or c >= 0x80 else ord("9") if b.isdigit() else c
        self.kind, self.run, self.mark = bytes(kind), re.compile(rb"(.)\1+", re.S), re.compile(rb"[^0-9a-z\x80-\xff]+")

    def _codes(self, word: bytes) -> int:
        """Hash of the word, and in the upper half the hash of its shape."""
        surface = zlib.crc32(self.mark.sub(b"", word.lower()))
        shape = zlib.crc32(self.run.sub(rb"\1", word.translate(self.kind)), 99)
        return (shape & 0x7FFFFFFF) << 32 | surface

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = raw.split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        get, cache = self.cache.get, self.cache
        codes = [get(w) for w in words]
        for i, c in enumerate(codes):
            if c is None:
                c = cache.get(words[i])
                if c is None:
                    c = cache[words[i]] = self._codes(words[i])
                codes[i] = c
        both = np.array(codes, np.int64)
        surface, shape = (both & 0xFFFFFFFF).astype(np.uint64), (both >> 32).astype(np.uint64)
        shape[1:][both[1:] == both[:-1]] = 7  # equal to the word before
        found, values = [], []
        for stream, most, salt in ((surface, self.p.word_n, 1), (shape, self.p.shape_n, 2)):
            grams, h = [], np.full(len(stream), salt, np.uint64)
            for n in range(min(most, len(stream))):
                h = (h[: len(stream) - n] * np.uint64(0x9E3779B97F4A7C15) + stream[n:]) * np.uint64(0xC2B2AE3D27D4EB4F)
                grams.append((h >> np.uint64(40)).astype(np.int64) % (self.p.buckets // 2) * 2 + (salt - 1))
            k, counts = np.unique(np.concatenate(grams), return_counts=True)
            v = np.log1p(counts).astype(np.float32)
            found.append(k)
            values.append(v / np.linalg.norm(v))
        return np.concatenate(found).astype(np.int32), np.concatenate(values).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Weights that aren't zero, by bucket; the last is the bias."""

    params: QualityParams
    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(self.params.buckets, np.float32)
        w[self.buckets] = self.weights
        return w


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0))))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], p: QualityParams) -> QualityModel:
    """FTRL-proximal over the rows in their order, ``epochs`` times."""
    z, n = np.zeros(p.buckets + 1), np.zeros(p.buckets + 1)

    def weights(k: np.ndarray) -> np.ndarray:
        zk = z[k]
        w = -(zk - np.sign(zk) * p.l1) / ((p.beta + np.sqrt(n[k])) / p.alpha + p.l2)
        w[np.abs(zk) <= p.l1] = 0.0
        return w

    rows = [(np.append(k, p.buckets).astype(np.int64), np.append(v, np.float32(1.0)), y) for k, v, y in rows]
    for _ in range(p.epochs):
        for k, v, y in rows:
            w = weights(k)
            g = (sigmoid(float(w @ v)) - y) * v
            step = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / p.alpha
            z[k] += g - step * w
            n[k] += g * g
    w = weights(np.arange(p.buckets + 1))
    used = np.nonzero(w[:-1])[0]
    return QualityModel(p, used.astype(np.int32), w[used].astype(np.float32), float(w[-1]))


def train_quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a sample of the labelled rows of ``docs``; give only rows to learn from."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    chosen = training_sample(known, "y", "id", p.per_label, ["id", "y"])  # 2 * per_label rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id")

    def prepare():
        f = Featurizer(p)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [f(raw or b"") for raw in text_bytes(batch.column(2))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k.tobytes() for k, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())],
                names=["id", "y", "k", "v"],
            )

        return run

    rows = map_batches(texts.select("id", "y", "t"), None, "id long, y int, k binary, v binary", prepare).toArrow().to_pylist()
    rows.sort(key=lambda r: (zlib.crc32(b"order%d" % r["id"]), r["id"], r["y"], r["k"], r["v"]))
    return fit_ftrl([(np.frombuffer(r["k"], np.int32), np.frombuffer(r["v"], np.float32), r["y"]) for r in rows], p)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: how likely label 1 is."""

    def prepare():
        f, w = Featurizer(model.params), model.dense()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = []
            for raw in text_bytes(batch.column(1)):
                k, v = f(raw or b"")
                scores.append(sigmoid(model.bias + float(w[k] @ v)))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return run

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")), None, "doc_id long, score double", prepare)


def classify_quality(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams(), threshold: float = 0.7, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold and score all."""
    out = crc_mod(F.col("doc_id"), folds) == held_out
    model = train_quality(docs, labels.where(~out), p)
    return score_quality(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
