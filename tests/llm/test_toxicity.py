from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rookery.llm import toxicity
from rookery.llm.common import read


def test_chain_feeds_earlier_probabilities():
    """The second target is the first one's opposite where a feature stands; the chain finds both."""
    rng = np.random.default_rng(0)
    rows, low, toxic = [], [], []
    for _ in range(600):
        bad, mark = rng.random() < 0.4, rng.random() < 0.3
        rows.append(np.unique(np.concatenate([rng.integers(100, 160, 20), [1] if bad else [2], [3] if mark else []]).astype(np.int64)))
        low.append(float(bad))
        toxic.append(float(mark))
    chain = toxicity.fit(rows, np.array(low), np.array(toxic), np.arange(600) % 5)
    assert [len(e) for e in chain.earlier] == [0, 1, 2]
    p = chain.probabilities(rows)
    assert np.mean((p[:, 0] >= 0.5) == np.array(low)) > 0.99 and np.mean((p[:, 1] >= 0.5) == np.array(toxic)) > 0.99
    by_hand = chain.weights[1][np.isin(chain.keys, rows[0])].sum() + chain.earlier[1][0] * p[0, 0] + chain.bias[1]
    assert abs(1 / (1 + np.exp(-by_hand)) - p[0, 1]) < 1e-6
    assert (chain.probabilities([np.zeros(0, np.int64)]) == 0).all() and chain.probabilities([]).shape == (0, 3)


def test_held_out_rows(spark):
    """Half of the labels are hidden from training."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    hidden = F.col("doc_id") % 2 == 0
    found = toxicity.score(docs.join(labels.select("doc_id"), "doc_id"), labels.where(~hidden)).join(labels.where(hidden).withColumnRenamed("toxic", "y"), "doc_id")
    rows = found.where("quality = 1").collect()
    assert np.mean([r["toxic"] for r in rows if r["y"]]) > 0.85
    assert np.mean([r["toxic"] for r in rows if not r["y"]]) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 0, 1), (5, 1, 0), (6, 1, 0), (8, 1, 0), (None, 1, 1), (7, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and not any(r["toxic"] for r in rows if r["doc_id"] in (1, 2, 3, 9))
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(odd_docs, labels.limit(0)).where("toxic OR p_toxic > 0").count() == 0
