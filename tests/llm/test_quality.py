from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from rookery.llm import quality
from rookery.llm.common import read


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at: dict[tuple, list[int]] = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(hit)


def check(df, docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    want = sorted(brute(t) for t in texts)
    got = [tuple(r[c] for c in quality.BASE) for r in df.select(*quality.BASE).collect()]
    assert sorted(got) == want


def test_counts_equal_brute_force(spark, small):
    docs = read(spark, small, "documents")
    found = quality.quality_rules(docs)
    check(found, docs)
    for r in found.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_random_repeats(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 30))) + rng.choice(["", "\n", "\nx y\nx y"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(quality.features(docs), docs)


def test_odd_rows(odd_docs, no_docs):
    found = quality.quality_rules(odd_docs)
    check(found, odd_docs)
    assert found.where("doc_id IN (1, 2, 3) AND kept").count() == 0
    assert quality.quality_rules(no_docs).count() == 0


def test_estimation_finds_a_planted_model():
    """Three rules of known quality over two classes: accuracies and posteriors come out near the truth."""
    rng = random.Random(5)
    true = ((0.95, 0.9), (0.9, 0.8), (0.85, 0.7))  # chance of a right vote for good and for bad texts
    counts: dict[tuple, int] = {}
    right = []
    for _ in range(20_000):
        good = rng.random() < 0.8
        vote = tuple(0 if rng.random() < 0.1 else (1 if (rng.random() < (g if good else 1 - b)) else -1) for g, b in true)
        counts[vote] = counts.get(vote, 0) + 1
        right.append((vote, good))
    model = quality.fit_votes(sorted(counts.items()), ("a", "b", "c"))
    assert abs(model.prior - 0.8) < 0.05
    assert sum((model.posterior(v) >= 0.5) == g for v, g in right) / len(right) > 0.92
    accuracy = model.accuracy()
    assert accuracy["a"] > accuracy["b"] > accuracy["c"] > 0.7


def test_column_equals_posterior(spark):
    model = quality.fit_votes([((1, -1), 5), ((1, 1), 20), ((-1, -1), 4), ((0, 0), 1)], ("a", "b"))
    rows = spark.createDataFrame([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)], "vote_a int, vote_b int")
    for r in rows.withColumn("p", model.column()).collect():
        assert abs(r["p"] - model.posterior((r["vote_a"], r["vote_b"]))) < 1e-9


def test_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    found = quality.quality_rules(read(spark, folder, "documents")).join(read(spark, folder, "labels"), "doc_id").where("NOT base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    good = n.get((1, True), 0) / max(1, n.get((1, True), 0) + n.get((1, False), 0))
    assert good > 0.98


def test_texts_that_fail_the_base_test_do_not_shape_the_model(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    found = {r["doc_id"]: r["p_quality"] for r in quality.quality_rules(docs).where("NOT base_failed").collect()}
    alone = quality.quality_rules(docs.where(F.col("doc_id").isin(list(found)))).collect()
    assert 0 < len(found) < docs.count()
    assert all(abs(found[r["doc_id"]] - r["p_quality"]) < 1e-6 for r in alone)
