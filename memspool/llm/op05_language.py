"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are cut into windows.  In each, one recurrent layer reads forwards and one
backwards, and a softmax over both states labels every position with a language.  A document's
probabilities are the mean over all of its positions.  The network is trained here in
numpy by backpropagation through time with Adam.

The fit uses a bounded sample: ``per_lang`` documents of each language at most, chosen by a hash
of the id, and of these ``text_windows`` windows at most, spread over the whole text.  Every document is labelled over its
whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any
row to learn from all are ``und``; rows that repeat are labelled each; an empty table gives
an empty result.  Only the columns named are read, so that others can't clash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, text_bytes, training_sample

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    hidden: int = 8
    window: int = 64
    per_lang: int = 96
    steps: int = 260
    batch: int = 192
    rate: float = 0.02
    seed: int = 5
    #: Windows of one text in the sample at most, evenly spread over the whole text.
    text_windows: int = 64
    #: Windows that are labelled together.
    slab: int = 2048


@dataclass
class Direction:
    """One gated recurrent layer: per byte what enters the gates, and the recurrent weights.

    Rows are update gate, reset gate, candidate, ``hidden`` each.
    """

    table: np.ndarray  # 3H x 256
    recurrent: np.ndarray  # 3H x H


def forward(d: Direction, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte, ``T x H x B``; ``codes`` is ``T x B``.  ``keep`` gets what the way back needs."""
    steps, b = codes.shape
    n = d.recurrent.shape[1]
    table, recurrent = d.table.copy(), d.recurrent.copy()
    table[: 2 * n] *= 0.5  # the gates are (tanh(x / 2) + 1) / 2
    recurrent[: 2 * n] *= 0.5
    h = np.zeros((n, b), np.float32)
    out = np.empty((steps, n, b), np.float32)
    x, r = np.empty((3 * n, b), np.float32), np.empty((3 * n, b), np.float32)
    for t in range(steps):
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        np.matmul(recurrent, h, out=r)
        gates = x[: 2 * n]
        gates += r[: 2 * n]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        update, reset, candidate = x[:n], x[n : 2 * n], x[2 * n :]
        candidate += reset * r[2 * n :]
        np.tanh(candidate, out=candidate)
        new = out[t]
        np.subtract(h, candidate, out=new)
        new *= update
        new += candidate
        if keep is not None:
            keep.append((h, update.copy(), reset.copy(), candidate.copy(), r[2 * n :].copy()))
        h = new
    return out


def backward(d: Direction, codes: np.ndarray, kept: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recurrent weights from those of the states (``T x H x B``)."""
    into = np.empty((len(kept), *d.recurrent.shape[:1], grad.shape[2]), np.float32)
    g_recurrent = np.zeros_like(d.recurrent)
    carry = np.zeros_like(grad[0])
    for t in range(len(kept) - 1, -1, -1):
        h, update, reset, candidate, r = kept[t]
        g = grad[t] + carry
        g_candidate = g * (1 - update) * (1 - candidate * candidate)
        g_update = g * (h - candidate) * update * (1 - update)
        g_reset = g_candidate * r * reset * (1 - reset)
        np.concatenate([g_update, g_reset, g_candidate], out=into[t])
        recur = np.concatenate([g_update, g_reset, g_candidate * reset])
        g_recurrent += recur @ h.T
        carry = g * update + d.recurrent.T @ recur
    flat = codes.ravel()
    g_table = np.stack([np.bincount(flat, into[:, i].ravel(), 256) for i in range(into.shape[1])])
    return g_table.astype(np.float32), g_recurrent


def _softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis but one."""
    e = np.exp(x - x.max(-2, keepdims=True))
    e /= e.sum(-2, keepdims=True)
    return e


@dataclass
class LanguageModel:
    params: LanguageParams
    labels: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # K x 2H
    bias: np.ndarray  # K x 1

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities of each language at each position, ``T x K x B``."""
        n = self.params.hidden
        x = self.out[:, :n] @ forward(self.ahead, codes)
        x += self.out[:, n:] @ forward(self.back, codes[::-1])[::-1]
        x += self.bias
        return _softmax(x)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean probabilities over its positions, and the share of positions that each label has with over half."""
        w, k = self.params.window, len(self.labels)
        sums, votes = np.zeros((len(texts), k)), np.zeros((len(texts), k))
        counts = np.array([-(-len(t) // w) for t in texts])
        # a text's last window is filled with spaces, which don't count
        data = np.frombuffer(b"".join(t.ljust(int(n) * w, b" ") for t, n in zip(texts, counts)), np.uint8).reshape(-1, w)
        owner = np.repeat(np.arange(len(texts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        sizes = np.array([len(t) for t in texts])
        used = np.minimum(w, sizes[owner] - (np.arange(len(owner)) - first[owner]) * w)
        for at in range(0, len(owner), self.params.slab):
            part = slice(at, at + self.params.slab)
            p = self.positions(np.ascontiguousarray(data[part].T))
            p *= (np.arange(w)[:, None, None] < used[part]).astype(np.float32)
            total, voted = p.sum(0), (p > 0.5).sum(0)
            for j in range(k):
                sums[:, j] += np.bincount(owner[part], total[j], len(texts))
                votes[:, j] += np.bincount(owner[part], voted[j], len(texts))
        n = np.maximum(1, sizes)[:, None]
        return sums / n, votes / n


def fit(texts: list[bytes], labels: list[str], p: LanguageParams = LanguageParams()) -> LanguageModel:
    """Train on windows of the texts, as many of each language."""
    names = sorted(set(labels))
    rng = np.random.default_rng(p.seed)
    h, k = p.hidden, len(names)

    def direction() -> Direction:
        return Direction(rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32), rng.normal(0, 0.4 / np.sqrt(h), (3 * h, h)).astype(np.float32))

    m = LanguageModel(p, names, direction(), direction(), rng.normal(0, 0.2, (k, 2 * h)).astype(np.float32), np.zeros((k, 1), np.float32))
    if k < 2:
        return m
    pools = [[t for t, x in zip(texts, labels) if x == name and t] for name in names]
    weights = [m.ahead.table, m.ahead.recurrent, m.back.table, m.back.recurrent, m.out, m.bias]
    first, second = [np.zeros_like(x) for x in weights], [np.zeros_like(x) for x in weights]
    y = np.arange(p.batch) % k
    for step in range(1, p.steps + 1):
        rows = []
        for c in y:
            t = pools[c][rng.integers(len(pools[c]))]
            # windows start where they do when a text is labelled
            at = int(rng.integers(-(-len(t) // p.window))) * p.window
            rows.append(t[at : at + p.window].ljust(p.window, b" "))
        codes = np.ascontiguousarray(np.frombuffer(b"".join(rows), np.uint8).reshape(p.batch, p.window).T)
        kept_a: list = []
        kept_b: list = []
        states = np.concatenate([forward(m.ahead, codes, kept_a), forward(m.back, codes[::-1], kept_b)[::-1]], 1)
        grad = _softmax(m.out @ states + m.bias)
        grad[:, y, np.arange(p.batch)] -= 1
        grad /= grad.shape[0] * p.batch
        g_states = m.out.T @ grad
        grads = [
            *backward(m.ahead, codes, kept_a, g_states[:, :h]),
            *backward(m.back, codes[::-1], kept_b, g_states[::-1, h:]),
            np.einsum("tkb,thb->kh", grad, states, optimize=True), grad.sum((0, 2))[:, None],
        ]
        rate = p.rate * (1 - step / (p.steps + 1))
        for w, g, a, b in zip(weights, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


def spread_windows(raw: bytes, p: LanguageParams) -> bytes:
    """The windows of a text that a sample holds, one after the other."""
    n = -(-len(raw) // p.window)
    if n <= p.text_windows:
        return raw
    at = [i * (n - 1) // (p.text_windows - 1) * p.window for i in range(p.text_windows)]
    return b"".join(raw[a : a + p.window] for a in at)


def train_language(docs: DataFrame, p: LanguageParams = LanguageParams(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a sample of the rows of ``docs`` with a language; give only rows to learn from.

    Windows are cut on the executors, so what the driver gets is bounded in rows and in bytes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    chosen = training_sample(rows.where("lang is not null and id is not null and length(t) > 0"), "lang", "id", p.per_lang, ["id", "lang", "t"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spread_windows(raw, p) for raw in text_bytes(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["id", "lang", "w"])

    sample = map_batches(chosen, cut, "id long, lang string, w binary").collect()
    sample = sorted(sample, key=lambda r: (zlib.crc32(b"%d" % r["id"]), r["id"], bytes(r["w"]), r["lang"]))
    return fit([bytes(r["w"]) for r in sample], [r["lang"] for r in sample], p)


def has_letter(raw: bytes) -> bool:
    if any(c in raw for c in b"etaoinshrdlucmfwypvbgkqjxz"):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, position_share`` of every row.

    ``position_share`` is the share of positions with the document's language as their label.
    """

    def prepare():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [raw or b"" for raw in text_bytes(batch.column(1))]
            known = [bool(model.labels) and has_letter(t) for t in texts]
            p, votes = model.pooled([t if k else b"" for t, k in zip(texts, known)]) if any(known) else (None, None)
            names, scores, shares = [], [], []
            for i, k in enumerate(known):
                j = int(p[i].argmax()) if k else -1
                names.append(model.labels[j] if k else UNKNOWN)
                scores.append(min(1.0, float(p[i][j])) if k else 0.0)
                shares.append(min(1.0, float(votes[i][j])) if k else 0.0)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], names=["doc_id", "lang_pred", "score", "position_share"]
            )

        return run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return map_batches(rows, None, "doc_id long, lang_pred string, score double, position_share double", prepare)


def identify_languages(docs: DataFrame, p: LanguageParams = LanguageParams(), folds: int = 4, held_out: int = 2) -> DataFrame:
    """Train on the rows outside the held-out fold and label all."""
    out = crc_mod(F.col("doc_id"), folds) == held_out
    model = train_language(docs.where(~out), p)
    return label_languages(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "position_share")
