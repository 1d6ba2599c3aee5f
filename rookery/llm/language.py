"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

Texts are cut into windows of ``WINDOW`` bytes that start from a blank state, so thousands of windows advance
together as numpy columns. Every byte position gets a label distribution; a document's is the mean over all its
positions. Gates use the rational curve x / (1 + |x|) in place of tanh, whose cost would be most of the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import ship, thinned

ship(__name__)

WINDOW, HIDDEN, STEPS, BATCH = 64, 8, 260, 384
#: The training sample: at most so many documents of each language, and pieces of so many characters of each.
SAMPLE_DOCS, PIECES, PIECE_CHARS = 400, 4, 96


def soft(x: np.ndarray) -> np.ndarray:
    y = np.abs(x)
    y += 1
    return np.divide(x, y, out=y)


@dataclass
class Network:
    """Per direction: ``table`` (3H x 256) of input terms, ``inner`` (3H x H), ``bias`` (H) of the candidate's inner term; then the output layer."""

    langs: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray  # langs x 2H
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, *self.bias, self.out, self.out_bias]

    def states(self, windows: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """States of direction ``d`` after each byte, (T, H, B), for windows (B, T); ``keep`` gets what training needs."""
        size = self.inner[d].shape[1]
        columns = np.ascontiguousarray(windows.T).astype(np.intp)
        h = np.zeros((size, len(windows)), np.float32)
        found = np.empty((windows.shape[1], *h.shape), np.float32)
        for t in range(len(columns)) if d == 0 else range(len(columns) - 1, -1, -1):
            found[t] = h = self.step(columns[t], h, d, keep, t)
        return found

    def step(self, column: np.ndarray, h: np.ndarray, d: int, keep: list | None = None, t: int = 0) -> np.ndarray:
        """The state after one byte of each window."""
        size = len(h)
        x = np.empty((3 * size, h.shape[1]), np.float32)
        self.table[d].take(column, axis=1, out=x, mode="clip")
        u = self.inner[d] @ h
        pre = u[: 2 * size]
        pre += x[: 2 * size]
        gates = soft(pre)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:size], gates[size:]
        v = u[2 * size :]
        v += self.bias[d][:, None]
        n_pre = r * v
        n_pre += x[2 * size :]
        n = soft(n_pre)
        new = h - n
        new *= z
        new += n
        if keep is not None:
            keep.append((t, h, pre, z, r, v, n_pre, n))
        return new

    def sums(self, windows: np.ndarray, used: np.ndarray) -> np.ndarray:
        """(langs, B): label probabilities of all used positions of each window, summed as they are made."""
        size = self.inner[0].shape[1]
        backward = self.states(windows, 1)
        columns = np.ascontiguousarray(windows.T).astype(np.intp)
        h = np.zeros((size, len(windows)), np.float32)
        total = np.zeros((len(self.langs), len(windows)), np.float32)
        whole = (used == len(columns)).all()
        for t, column in enumerate(columns):
            h = self.step(column, h, 0)
            p = self.out[:, :size] @ h
            p += self.out[:, size:] @ backward[t]
            p += self.out_bias[:, None]
            np.minimum(p, 60, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if not whole:
                p *= t < used
            total += p
        return total

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(B, T, langs) for windows (B, T) of bytes."""
        both = np.concatenate([self.states(windows, 0), self.states(windows, 1)], axis=1)
        logits = np.matmul(self.out, both) + self.out_bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.transpose(2, 0, 1)


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (B, T) of all texts, zero-padded, with the bytes used in each and the index of its text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    rows = -(-lengths // window)
    flat = np.frombuffer(b"".join(t + b"\0" * (-len(t) % window) for t in texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), rows)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return flat.reshape(-1, window), np.minimum(window, lengths[owner] - first * window), owner


def fit(texts: list[str], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, seed: int = 7) -> Network:
    """Adam on the cross entropy of every position, gradients by backpropagation through time. Rows are taken as given."""
    names = sorted(set(langs))
    windows, used, owner = cut([t.encode() for t in texts])
    labels = np.array([names.index(x) for x in langs])[owner]
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = Network(
        names, [drawn(3 * hidden, 256, scale=0.5) for _ in "fb"], [drawn(3 * hidden, hidden, scale=hidden**-0.5) for _ in "fb"],
        [np.zeros(hidden, np.float32) for _ in "fb"], drawn(len(names), 2 * hidden, scale=0.3), np.zeros(len(names), np.float32),
    )
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = rng.integers(len(windows), size=min(batch, len(windows)))
        grads = gradients(net, windows[pick], used[pick], labels[pick])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, s) in zip(net.parameters(), grads, moments):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def gradients(net: Network, windows: np.ndarray, used: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over the used positions, in the order of ``parameters``."""
    size, steps = net.inner[0].shape[1], windows.shape[1]
    kept: list[list] = [[], []]
    both = np.concatenate([net.states(windows, d, kept[d]) for d in (0, 1)], axis=1)
    logits = np.matmul(net.out, both) + net.out_bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    p[:, labels, np.arange(len(labels))] -= 1
    p *= (np.arange(steps)[:, None] < used[None, :])[:, None, :] / np.float32(used.sum())
    d_out, d_out_bias = np.einsum("tlb,thb->lh", p, both), p.sum(axis=(0, 2))
    d_both = np.matmul(net.out.T, p)
    d_table, d_inner, d_bias = [], [], []
    columns = np.ascontiguousarray(windows.T)
    for d in (0, 1):
        inner = net.inner[d]
        g_table, g_inner, g_bias = np.zeros((256, 3 * size), np.float32), np.zeros_like(inner), np.zeros(size, np.float32)
        carry = np.zeros((size, len(windows)), np.float32)
        for t, h, pre, z, r, v, n_pre, n in reversed(kept[d]):
            g = carry + d_both[t, d * size : (d + 1) * size]
            g_n = g * (1 - z) / (1 + np.abs(n_pre)) ** 2
            g_pre = np.concatenate([g * (h - n), g_n * v]) * 0.5 / (1 + np.abs(pre)) ** 2
            g_v = g_n * r
            g_u = np.concatenate([g_pre, g_v])
            g_inner += g_u @ h.T
            g_bias += g_v.sum(axis=1)
            carry = g * z + inner.T @ g_u
            g_x = np.concatenate([g_pre, g_n])
            np.add.at(g_table, columns[t], g_x.T)
        d_table.append(np.ascontiguousarray(g_table.T))
        d_inner.append(g_inner)
        d_bias.append(g_bias)
    return [*d_table, *d_inner, *d_bias, d_out, d_out_bias]


def pooled(net: Network, texts: list[str], block: int = 1024) -> np.ndarray:
    """(texts, langs): mean label probabilities over all byte positions of each whole text; a text of no bytes has zeros."""
    windows, used, owner = cut([t.encode(errors="replace") for t in texts])
    total = np.zeros((len(texts), len(net.langs)))
    for at in range(0, len(windows), block):
        rows = slice(at, at + block)
        np.add.at(total, owner[rows], net.sums(windows[rows], used[rows]).T)
    lengths = np.bincount(owner, weights=used, minlength=len(texts))
    return total / np.maximum(lengths, 1)[:, None]


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> list:
    """Rows (piece, lang): the documents of smallest hash per language among those to learn from, a few pieces of each from hashed places."""
    known = docs.where(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = known.select("lang", "doc_id", F.xxhash64("doc_id", F.lit("sample")).alias("_order"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))
    drawn = thinned(order, "_order", per_lang, "lang").withColumn("_n", first).where(F.col("_n") <= per_lang).select("doc_id").distinct()
    room = F.greatest(F.length("text") - PIECE_CHARS, F.lit(0)) + 1
    pieces = F.array(*[
        F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1).cast("int"), F.lit(PIECE_CHARS)) for k in range(PIECES)
    ])
    # as small as the sample itself, which goes to the driver
    found = known.join(F.broadcast(drawn), "doc_id").select("doc_id", "lang", F.posexplode(pieces).alias("k", "piece"))
    return found.orderBy("lang", "doc_id", "k", "piece").select("lang", "piece").collect()


def predictor(net: Network | None):
    """A column function of texts (null where there is no letter) that gives ``lang_pred`` and ``score``."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), 256):  # bounds the windows held at once
                texts = ["" if t is None else t for t in batch.iloc[at : at + 256]]
                p = pooled(net, texts) if net else np.zeros((len(texts), 1))
                names += [net.langs[k] if net and t else "und" for k, t in zip(p.argmax(axis=1), texts)]
                scores += [float(x) if t else 0.0 for x, t in zip(np.clip(p.max(axis=1), 0, 1), texts)]
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    # the hints are given as objects: the worker looks them up by value
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, "lang_pred string, score double")


def verdict(docs: DataFrame, model_docs: DataFrame | None = None) -> Column:
    """(lang_pred, score) as a column over ``text``, learned from ``model_docs`` (default: ``docs``); other columns stay outside Python."""
    sample = training_sample(docs if model_docs is None else model_docs)
    net = fit([r["piece"] for r in sample], [r["lang"] for r in sample]) if sample else None
    return predictor(net)(F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))


def identify(docs: DataFrame, model_docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row, learned from ``model_docs`` (default: the same table).

    ``und`` with score 0 for a null text, one without a letter, or if there is nothing to learn from. A null id is
    never held out. Repeated rows each get a row; columns other than doc_id, text and lang (training) are not used.
    """
    found = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), verdict(docs, model_docs).alias("v"))
    return found.select("doc_id", "held_out", "v.lang_pred", "v.score")
