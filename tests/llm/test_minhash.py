from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import minhash
from rookery.llm.queries import op11_minhash


def brute(rows, shingle=4):
    """Components over all pairs with exact Jaccard >= 0.8 on distinct shingle sets; ids per row as the contract says."""
    sets = {}
    for doc_id, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]
        grams = {" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle, 0) + 1)} if words else set()
        sets[(doc_id, frozenset(grams))] = None
    keys = list(sets)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            a, b = keys[i][1], keys[j][1]
            if not a or not b or 100 * min(len(a), len(b)) < 80 * max(len(a), len(b)):
                continue
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                root[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(keys):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    out = []
    for i, (doc_id, grams) in enumerate(keys):
        component = doc_id if not grams else least.get(find(i))
        out.append((doc_id, len(grams), component, doc_id == component))
    return sorted(out, key=repr)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()) if False else sorted(
        ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr
    )


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_minhash(spark, small)) == brute(rows)


def test_near_copies_and_odd_rows(spark, odd_docs):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100", "changed")  # 4 of 197 shingles differ: Jaccard 193/201
    far = " ".join(f"w{i}" for i in range(120))  # 117 of 197: below 0.8
    extra = spark.createDataFrame([(20, base), (21, near), (22, far), (23, base.upper()), (None, near)], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text", "words", "key", "n", "fp", "_w").unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(minhash.near_duplicates(docs))
    assert found == brute(rows)
    by_id = {r[0]: r for r in found}
    assert by_id[21][2] == by_id[23][2] == 20 and by_id[22][2] == 22
    assert by_id[1] == (1, 0, 1, True) and by_id[2] == (2, 0, 2, True)  # no words: alone
    assert [r for r in found if r[0] == 6] == [(6, 4, 5, False)]  # repeated rows count once, linked to 5
    assert sorted(r[1:] for r in found if r[0] is None) == [(2, None, True), (197, 20, False)]  # a null id joins by its text only


def test_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_crowded_buckets_cut_into_chunks(spark, chunk):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[:30] + [f"x{i}"] + base[30:])) for i in range(40)] + [(100 + i, " ".join(f"v{i}_{j}" for j in range(50))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = docs.transform(minhash.shingle_sets).groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("set").alias("set"), F.any_value("n_shingles").alias("n_shingles"))
    nodes = nodes.withColumn("nid", F.col("least"))
    found = minhash.links(nodes, minhash.signatures(nodes), chunk=chunk).collect()
    root = {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    for a, b in found:
        root[find(a)] = find(b)
    assert {a for a, _ in found} | {b for _, b in found} == set(range(40))  # the 5 others link with nothing
    assert len({find(i) for i in range(40)}) == 1
    if chunk > 1:
        assert len(found) < 40 * 39 / 2  # forests, not all pairs


def test_only_sets_of_bucket_mates_are_written(spark, monkeypatch):
    written = {}
    kept = minhash.stage
    monkeypatch.setattr(minhash, "stage", lambda df, name: written.setdefault(name, kept(df, name)))
    rows = [(i, " ".join(f"a{i}_{j}" for j in range(60))) for i in range(30)]
    near = rows[3][1].split()
    rows += [(100, " ".join(near)), (101, " ".join(near[:-1])), (None, " ".join(near[:-2]))]  # a copy and two near copies
    found = got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert found == brute(rows)
    assert sum(df.count() for df in written.values() if "set" in df.columns) == 3


def test_forest_connects_all_links_and_keeps_to_two_chunks():
    sets = [np.arange(i, i + 100) for i in (0, 5, 10, 15, 500, 505)]
    assert sorted(zip(*minhash.forest(sets, 6, 80))) == [(0, 1), (0, 2), (1, 3), (4, 5)]
    assert sorted(zip(*minhash.forest(sets, 2, 80))) == [(0, 2), (1, 2), (1, 3)]
