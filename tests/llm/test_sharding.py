from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rookery.llm import sharding
from rookery.llm.common import read


def check(docs, shards=8, **options):
    rows = sharding.shard(docs, shards, **options).collect()
    texts = [r["text"] for r in docs.select("text").collect()]
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    own = defaultdict(list)
    for r in rows:
        own[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in own.values()) and set(own) <= set(range(shards))
    return rows


def test_sizes_are_near_equal_and_equal_texts_together(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    rows = check(docs)
    for measure in (lambda r: r["size"], lambda r: r["tokens"], lambda r: 1):
        sums = np.bincount([r["shard"] for r in rows], [measure(r) for r in rows])
        assert sums.max() / sums.mean() < 1.03
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    places = defaultdict(set)
    for r in rows:
        places[text[r["doc_id"]]].add(r["shard"])
    counts, whole = Counter(text.values()), np.array([len(rows), sum(r["size"] for r in rows), sum(r["tokens"] for r in rows)]) / 8
    for t, p in places.items():
        share = counts[t] * np.array([1, len(t.encode()) + 1, len(t.split())]) / whole
        assert len(p) == 1 or share.max() > 1 / 16


def test_a_group_of_a_third_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = check(docs, bundles=256)
    sums = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows])
    assert sums.max() / sums.mean() < 1.05


def test_pack_places_by_the_dot_product():
    placed = sharding.pack(np.array([[4.0, 1, 1], [1, 4, 1], [1, 1, 4], [4, 1, 1], [1, 4, 1], [1, 1, 4]]), 2)
    sums = np.array([np.array([[4.0, 1, 1], [1, 4, 1], [1, 1, 4]] * 2)[placed == s].sum(axis=0) for s in (0, 1)])
    assert (sums == 6).all()


def test_odd_rows(odd_docs, no_docs):
    assert len(check(odd_docs)) == odd_docs.count()
    assert check(no_docs) == []
