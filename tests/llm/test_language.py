from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from rookery.llm import language
from rookery.llm.common import read


def test_gradients_equal_differences():
    net = language.fit(["hello there this is", "ça va bien oui"] * 8, ["a", "b"] * 8, hidden=4, steps=1)
    windows, used, _ = language.cut([b"hello there abc", "é other text".encode()], 24)
    labels = np.array([0, 1])

    def loss():
        p = net.probabilities(windows)
        return -sum(np.log(p[b, : used[b], labels[b]]).sum() for b in range(2)) / used.sum()

    for p, g in zip(net.parameters(), language.gradients(net, windows, used, labels)):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, step = p[at], 1e-2
        p[at] = kept + step
        above = loss()
        p[at] = kept - step
        below = loss()
        p[at] = kept
        assert abs((above - below) / (2 * step) - g[at]) < 0.01 * abs(g[at]) + 1e-4


def test_sums_equal_the_label_of_every_position():
    net = language.fit(["abc abc", "xyz xyz"] * 4, ["a", "b"] * 4, hidden=4, steps=2)
    texts = ["", "a", "xyz " * 100, "é" * 40]
    windows, used, owner = language.cut([t.encode() for t in texts])
    p = net.probabilities(windows)
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)
    for i, found in enumerate(language.pooled(net, texts, block=2)):
        own = [p[k, : used[k]] for k in np.flatnonzero(owner == i)]
        assert np.allclose(found, np.concatenate(own).mean(axis=0) if own else 0, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_learns_only_from_rows_to_learn_from(spark, small):
    docs = read(spark, small, "documents")
    wrong = docs.withColumn("lang", F.when(language.is_held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert [tuple(r) for r in language.training_sample(wrong)] == [tuple(r) for r in language.training_sample(docs)]


def test_odd_rows(odd_docs, no_docs):
    rows = language.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r for r in rows}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3, 7, 9)) and found[4]["lang_pred"] != "und"
    assert language.identify(no_docs).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs, no_docs).collect()} == {"und"}
