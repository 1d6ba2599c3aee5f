"""Toxicity by a classifier chain: categories are predicted one after another, each linear model sees the earlier
categories' probabilities.

Features are 64-bit hashes of a text's distinct words and word beginnings, made natively. Models learn on a bounded
sample of labelled rows; what a later model sees of the sample are out-of-fold probabilities, as it will see
probabilities of unseen rows when it predicts. Prediction is one sparse product per category and batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import let, ship, thinned

ship(__name__)

#: In chain order: unwanted at all, toxic, and toxic with more marker words than half of the toxic rows.
CATEGORIES = ("low_quality", "toxic", "severe")
#: The training sample: at most so many toxic and so many other labelled rows, those of smallest hash.
SAMPLE_ROWS, VOCABULARY, FOLDS = 2_000, 512, 5
THRESHOLD = 0.5


def features(text: Column) -> Column:
    """Sorted distinct hashes of the words of a whole text and of their first four and five letters."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))

    def hashed(w: Column) -> Column:
        whole = F.transform(F.array_remove(w, ""), lambda x: F.xxhash64(x))
        starts = [
            F.transform(F.filter(w, lambda x, n=n: F.length(x) >= n), lambda x, n=n: F.xxhash64(F.substring(x, 1, n), F.lit(n))) for n in (4, 5)
        ]
        return F.array_distinct(F.concat(whole, *starts))

    return let(words, hashed)


@dataclass
class Chain:
    """``keys``: sorted hashes of the vocabulary; per category its ``weights`` over them, over earlier probabilities, and its bias."""

    keys: np.ndarray
    weights: list[np.ndarray]
    earlier: list[np.ndarray]
    bias: list[float]

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, categories) for rows of feature hashes."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, flat), max(0, len(self.keys) - 1))
        known = self.keys[at] == flat if len(self.keys) else np.zeros(len(flat), bool)
        owner = np.repeat(np.arange(len(rows)), sizes)[known]
        found = np.zeros((len(rows), len(self.weights)))
        for c, (w, e, b) in enumerate(zip(self.weights, self.earlier, self.bias)):
            score = np.bincount(owner, weights=w[at[known]], minlength=len(rows)) + found[:, :c] @ e + b
            found[:, c] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        found[sizes == 0] = 0
        return found


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.02, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-penalised logistic regression, classes weighted equally; Nesterov's gradient steps."""
    positive = max(1e-9, y.mean())
    share = np.where(y > 0, 0.5 / positive, 0.5 / max(1e-9, 1 - positive)) / len(y)
    share = share.astype(np.float32)
    w = before = np.zeros(x.shape[1] + 1, np.float32)
    rate = 1.0 / (0.25 * float((share * ((x * x).sum(axis=1) + 1)).sum()) + strength / len(y))
    for k in range(rounds):
        at = w + np.float32(k / (k + 3)) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ at[:-1] + at[-1], -30, 30)))
        g = share * (p - y.astype(np.float32))
        step = np.append(g @ x + np.float32(strength / len(y)) * at[:-1], g.sum())
        before, w = w, (at - rate * step).astype(np.float32)
    return w[:-1], float(w[-1])


def fit(rows: list[np.ndarray], low_quality: np.ndarray, toxic: np.ndarray, folds: np.ndarray) -> Chain:
    """The chain of ``CATEGORIES`` on sampled rows; ``folds`` says which rows are predicted by models that did not see them."""
    keys, counts = np.unique(np.concatenate(rows), return_counts=True)

    def within(y: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys))
        own, n = np.unique(np.concatenate([r for r, t in zip(rows, y) if t] or [keys[:0]]), return_counts=True)
        found[np.searchsorted(keys, own)] = n
        return found

    def telling(y: np.ndarray) -> np.ndarray:
        """The features whose shares in both classes differ most, in standard errors."""
        own, n = within(y), max(1.0, y.sum())
        rest, m = counts - own, max(1.0, len(y) - y.sum())
        share = (counts + 1) / (len(y) + 2)
        z = np.abs(own / n - rest / m) / np.sqrt(share * (1 - share) * (1 / n + 1 / m))
        return np.lexsort((keys, -z))[: VOCABULARY // 2]

    top = np.unique(np.concatenate([telling(low_quality), telling(toxic)]))
    top = top[counts[top] > 1]
    in_toxic, n_toxic = within(toxic), max(1, int(toxic.sum()))
    marker = in_toxic[top] / n_toxic > 20 * (counts[top] - in_toxic[top] + 0.5) / max(1, len(rows) - n_toxic)
    keys = keys[top]
    x = np.zeros((len(rows), len(keys) + len(CATEGORIES) - 1), np.float32)
    for i, r in enumerate(rows):
        x[i, np.flatnonzero(np.isin(keys, r, assume_unique=True))] = 1
    markers = x[:, : len(keys)][:, marker].sum(axis=1)
    middle = np.median(markers[toxic > 0]) if toxic.any() else 0
    targets = (low_quality, toxic, toxic * (markers > middle))
    chain = Chain(keys, [], [], [])
    for c, y in enumerate(targets):
        used = np.concatenate([np.arange(len(keys)), len(keys) + np.arange(c)])
        w, b = logistic(x[:, used], y)
        chain.weights.append(w[: len(keys)])
        chain.earlier.append(w[len(keys) :])
        chain.bias.append(b)
        if c < len(targets) - 1:  # what the next model sees
            for f in np.unique(folds):
                inside = folds == f
                w, b = logistic(x[np.ix_(~inside, used)], y[~inside]) if (~inside).any() else (w * 0, 0.0)
                x[inside, len(keys) + c] = 1 / (1 + np.exp(-np.clip(x[np.ix_(inside, used)] @ w + b, -30, 30)))
    return chain


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """(toxic, quality, fold, hashes) of the labelled rows of smallest hash, up to ``rows`` toxic and ``rows`` others."""
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    drawn = None
    for part in (known.where("toxic > 0"), known.where("toxic = 0")):
        first = thinned(part.withColumn("_order", F.xxhash64("doc_id")), "_order", rows).orderBy("_order", "doc_id").limit(rows).drop("_order")
        drawn = first if drawn is None else drawn.unionByName(first)
    # at most 2 * rows ids, so the broadcast is bounded
    found = docs.where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select(
        "doc_id", "toxic", "quality", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), features(F.col("text")).alias("hashes")
    )
    # of a long text a hashed part of at most 2,000 features is learned from; prediction uses all
    kept = F.slice(F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, F.lit("order")).alias("o"), h.alias("h")))), 1, 2_000)
    return found.dropDuplicates(["doc_id"]).select("doc_id", "toxic", "quality", "fold", F.transform(kept, lambda s: s["h"]).alias("hashes")).orderBy("doc_id").collect()


def predictor(chain: Chain | None):
    """A column function of feature hashes that gives the probability of each category."""

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = chain.probabilities([np.asarray(h, dtype=np.int64) for h in batch]) if chain else np.zeros((len(batch), len(CATEGORIES)))
            yield pd.DataFrame({f"p_{c}": p[:, k] for k, c in enumerate(CATEGORIES)})

    # the hints are given as objects: the worker looks them up by value
    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(predict, ", ".join(f"p_{c} double" for c in CATEGORIES))


def verdict(docs: DataFrame, labels: DataFrame) -> Column:
    """The probabilities as a column over ``text``, learned from labelled rows; other columns stay outside Python."""
    sample = training_sample(docs, labels)
    chain = None
    if sample and any(r["toxic"] for r in sample) and not all(r["toxic"] for r in sample):
        chain = fit(
            [np.array(r["hashes"], dtype=np.int64) for r in sample], np.array([float(r["quality"] == 0) for r in sample]),
            np.array([float(r["toxic"] > 0) for r in sample]), np.array([r["fold"] for r in sample]),
        )
    return predictor(chain)(features(F.col("text")))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_low_quality, p_toxic, p_severe, toxic): one row per input row.

    ``toxic`` says whether ``p_toxic`` reaches ``threshold``. A null or empty text has no features and is not toxic,
    nor is any text if no labelled row can be learned from. Labels of an id that comes twice count as toxic if one is.
    Repeated rows each get a row; other columns are ignored.
    """
    found = docs.select("doc_id", verdict(docs, labels).alias("v")).select("doc_id", "v.*")
    return found.withColumn("toxic", F.col("p_toxic") >= threshold)
