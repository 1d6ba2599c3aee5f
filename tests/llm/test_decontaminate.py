from __future__ import annotations

import hashlib
import random
import re

from rookery.llm import decontaminate, queries
from rookery.llm.common import read
from tests.compare import differences

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    grams: dict[tuple, set] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    found = set()
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    own |= grams[g]
        found.add((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return found


def run(spark, docs, items, blocks=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b).drop("_text", "hits").collect()
    assert len(got) == len(set(map(tuple, got)))
    return set(map(tuple, got))


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["Ab", "c", "d9", "é", "ß-x", "f."]) for _ in range(n))
    items = [(i, some(n)) for i, n in enumerate([14, 12, 11, 10, 3, 4, 0, 25])] + [(90, None), (91, "..."), (10, some(14))]
    docs = [(i, some(rng.randrange(0, 40)) + " " + rng.choice(items)[1] if i % 2 and rng.choice(items)[1] else some(12)) if i % 2 == 0 else (i, some(5) + (items[i % 8][1] or "") + some(4)) for i in range(80)]
    docs = [(i, t) for i, t in docs] + [(900, None), (901, ""), (902, "...")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want and any(w[-1] for w in want)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)  # many blocks give the same
    assert run(spark, docs, items) == want


def test_query_equals_sql(spark, con, small):
    assert not differences(queries.op2_decontamination(spark, small), con, queries.ORACLE["op2_decontamination"])


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the same text here"), (None, "no id has"), (3, None)], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.contamination(odd_docs, bench).collect()}
    assert found[5]["n_hit"] == 4 and found[6]["contaminated"] and not found[1]["contaminated"] and not found[None]["contaminated"]
    assert decontaminate.contamination(no_docs, bench).count() == 0
    assert decontaminate.contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3


def test_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "Keep this, then The Bad one! and more."), (2, "clean text"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "the bad one")], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, b, spans=True).collect()}
    assert got == {1: "Keep this, then! and more.", 2: "clean text", 3: None}


def test_texts_do_not_cross_a_shuffle(spark, small):
    docs, bench = read(spark, small, "documents"), read(spark, small, "benchmark")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
