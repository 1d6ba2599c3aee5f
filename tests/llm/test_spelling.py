from __future__ import annotations

import re
import zlib
from collections import Counter

from rookery.llm import spelling
from rookery.llm.queries import op12_spelling


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    i = h % len(run)
                    run = run[:i] + run[i + 1 :]
            counts[run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = (a, b) if len(a) < len(b) else (b, a)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    out = {}
    for w, n in vocab.items():
        mates = [(v, m) for v, m in vocab.items() if near(w, v)]
        best = min(mates, key=lambda x: (-x[1], x[0])) if mates else None
        form = best[0] if best and best[1] >= 10 * n else None
        out[w] = [form, n, len(mates), vocab[form] if form else None]
    result = []
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        result.append((w, form, root, n, n_near, form_n))
    return sorted(result)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_spelling(spark, small)) == brute(rows)


def test_planted_variants_chains_and_odd_rows(spark, odd_docs):
    text = " ".join(["colourful"] * 300 + ["colorful"] * 30 + ["colorfull"] * 3 + ["coloirful"] * 2 + ["Straße"] * 4 + ["Strassee"] * 2 + ["ÀÉÎÕÜxyz"] * 2 + ["àéîõüxyz"] * 2)
    extra = spark.createDataFrame([(30, text), (31, None), (None, "Straße Straße")], "doc_id bigint, text string")
    docs = odd_docs.select("doc_id", "text", "words", "key", "n").unionByName(extra, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(spelling.variants(docs))
    assert found == brute(rows)
    by_word = {r[0]: r for r in found}
    assert by_word["colorful"][1:] == ("colourful", "colourful", 30, 3, 300)
    assert by_word["colorfull"][1:3] == ("colorful", "colourful")  # a chain of forms to its end
    assert by_word["colourful"][1] is None


def test_filter_passes_and_shards(spark, small, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_BYTES", 64)
    monkeypatch.setattr(spelling, "PASS_BYTES", 256)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op12_spelling(spark, small)) == brute(rows)


def test_empty_table(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0


def test_probing_tasks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS_PER_TASK", 50)
    vocabulary = spark.range(2000).selectExpr("concat('wordnumber', id) AS word").coalesce(1)
    parts = spelling.spread(vocabulary, spelling.plan_filters({14: 2000})[14][1]).rdd.glom().map(len).collect()
    assert len(parts) >= 40 and max(parts) <= 150 and sum(parts) == 2000


def test_later_bits_are_looked_up_only_for_those_left(spark):
    import inspect

    assert "_place(" not in inspect.getsource(spelling._probe)
    vocabulary = spark.createDataFrame([("abcdefg", 2), ("abcdefgh", 30), ("xbcdefg", 5), ("zzzzzzzz", 9)], "word string, n long")
    found = sorted((r.word, r.near, r.near_n) for r in spelling.near_pairs(vocabulary).collect())
    assert found == [("abcdefg", "abcdefgh", 30), ("abcdefg", "xbcdefg", 5), ("abcdefgh", "abcdefg", 2), ("xbcdefg", "abcdefg", 2)]
