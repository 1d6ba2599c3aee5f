from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from rookery.llm import simhash
from rookery.llm.common import read

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return 0
    h = np.array([xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))], np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def classes(prints, bits):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= bits and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_equals_brute_force(spark, small):
    docs = read(spark, small, "documents")
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect()}
    want = classes(prints, 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (format(p, "016x"), want[i]) for i, p in prints.items()}


def test_links_connect_as_all_pairs_do(spark):
    """Dense balls, chains at the limit and strangers; with small chunks so that keys are cut into many tasks."""
    rng = random.Random(2)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(rng.randrange(0, 6)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
        for _ in range(8):  # a chain, four bits apart
            for b in rng.sample(range(64), 4):
                centre ^= 1 << b
            prints.add(centre)
    prints |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = classes({s: s & ((1 << 64) - 1) for s in signed}, 4)
    for chunk in (16, 2048):
        edges = simhash.links(nodes, 4, chunk).collect()
        assert all(((e["fp_a"] ^ e["fp_b"]) & ((1 << 64) - 1)).bit_count() <= 4 for e in edges)
        found = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert {s: found.get(s, s) for s in signed} == want


def test_blocks_follow_the_number_of_nodes():
    sizes = [simhash.blocks_for(n, 4) for n in (0, 10**5, 10**7, 10**9, 10**11, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == sizes[1] == sizes[2] == 6


def test_components_of_a_long_path(spark):
    n = 500
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {(r["node"], r["component"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(n)}


def test_odd_rows(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 10  # the repeated row once
    assert found[1]["fingerprint"] == found[2]["fingerprint"] == found[3]["fingerprint"] == "0" * 16
    assert found[3]["component_id"] == 1 and found[6]["component_id"] == 5 and found[None]["component_id"] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 4, 5, 7, 8, 9, None)))
