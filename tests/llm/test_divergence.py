"""Source divergence audit against a brute-force Python version of its contract."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest

from rookery.llm import divergence
from rookery.llm.common import token_table, tokens

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    docs = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)
        sources = sorted({d[1] for d in mine})
        cnt = {s: Counter() for s in sources}
        for _, s, ts in mine:
            cnt[s].update(t for t in ts if t in df and df[t] >= min_docs)
        lang_cnt = sum(cnt.values(), Counter())

        def p(c, n):
            return 1 + (10**9 * (c + 2)) // (n + 2 * v)

        def f(a, b):
            return (a - b) * (a - b) // (a + b)

        ln = sum(lang_cnt[t] for t in kept)
        for s in sources:
            n = sum(cnt[s][t] for t in kept)
            pairs = []
            for o in sources:
                if o == s:
                    continue
                no = sum(cnt[o][t] for t in kept)
                pairs.append((o, sum(f(p(cnt[s][t], n), p(cnt[o][t], no)) for t in kept) if v else 0))
            pairs.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "pair", o, val, i + 1) for i, (o, val) in enumerate(pairs)]
            terms = [(t, f(p(cnt[s][t], n), p(lang_cnt[t], ln))) for t in kept if cnt[s][t] > 0 and p(cnt[s][t], n) > p(lang_cnt[t], ln)]
            terms.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, s, "term", t, val, i + 1) for i, (t, val) in enumerate(terms[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


def test_matches_brute_force(spark):
    words = ["Alpha", "beta", "GAMMA", "delta", "été", "日本", "x", "zeta", "eta", "theta"]
    rows = []
    for i in range(90):
        text = " ".join(words[(i * k + k) % len(words)] for k in range(1, 4 + i % 7)) + ("! 42 " + words[i % 3]) * (i % 4)
        rows.append((text if i % 17 else None, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4]))
    rows += rows[:12]  # repeated rows count as documents
    assert run(spark, rows, min_docs=5) == brute(rows, min_docs=5)
    assert run(spark, rows, min_docs=5, shard_keys=2) == brute(rows, min_docs=5)  # many shards per language


def test_no_kept_terms_gives_zero_pairs(spark):
    rows = [("one two", "en", "a"), ("three", "en", "b"), (None, "en", None)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[4] for r in got} == {0} and all(r[2] == "pair" for r in got)


def test_odd_and_empty_inputs(spark, odd_docs, no_docs):
    got = divergence.audit(odd_docs, min_docs=1).collect()
    rows = [(r.text, r.lang, r.source) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in got) == brute(rows, min_docs=1)
    assert divergence.audit(no_docs).count() == 0


@pytest.mark.parametrize("shard_keys", [1, 3, 4096])
def test_perfect_hash_is_minimal_and_verified(spark, shard_keys):
    rows = [(f"w{i} w{i + 1} common", "en", "s") for i in range(40)] * 2
    assert run(spark, rows, min_docs=2, shard_keys=shard_keys) == brute(rows, min_docs=2)


def test_pairs_are_summed_before_the_shuffle(spark, monkeypatch):
    staged = {}
    kept = divergence.stage
    monkeypatch.setattr(divergence, "stage", lambda df, name: staged.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), kept(df, name)))[1])
    rows = [("en", f"s{i % 3}", " ".join(["alpha"] * (i % 4 + 1) + ["beta"] * (i % 2) + ["gamma"] * (i % 3))) for i in range(60)]
    divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string")).collect()
    plan, pairs = staged["divergence_pairs"]
    assert plan.count("Aggregate [lang") == plan.count("Aggregate") == 1 and "Scan" not in plan.split("Aggregate")[0]
    assert pairs.count() == 6 and staged["divergence_slots"][1].count() == 3


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    plans = []
    kept = divergence.stage

    def staged(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return kept(df, name)

    monkeypatch.setattr(divergence, "stage", staged)
    rows = [("en", f"s{i % 2}", "alpha Beta " * (i % 3) + "gamma") for i in range(30)]
    spark.createDataFrame(rows, "lang string, source string, text string").write.parquet(f"{tmp_path}/docs")
    found = divergence.audit(spark.read.parquet(f"{tmp_path}/docs"))
    assert sorted(tuple(r) for r in found.collect()) == brute([(t, lang, s) for lang, s, t in rows])
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert sum(len(re.findall(r"FileScan parquet \[[^\]]*\btext#", p)) for p in plans) == 1


def plans_of(monkeypatch):
    """The physical plan of every staged table, by name."""
    plans = {}
    kept = divergence.stage

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(divergence, "stage", staged)
    return plans


def test_exploded_slots_are_joined_with_nothing(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    rows = [(" ".join(f"w{(i * k) % 23} own{i % 5}" for k in range(6)), ["en", "de"][i % 2], f"s{i % 5}") for i in range(80)]
    assert run(spark, rows, min_docs=3) == brute(rows, min_docs=3)
    assert plans["divergence_pairs"].count("Generate explode") == 2 and "Join" not in plans["divergence_pairs"]


def test_large_lookup_table_is_not_broadcast(spark, monkeypatch):
    rows = [(f"w{i} w{i + 1} common", "en", f"s{i % 2}") for i in range(40)] * 2
    shapes = []
    for most in (divergence._LOOKUP_BYTES, 0):
        monkeypatch.setattr(divergence, "_LOOKUP_BYTES", most)
        plans = plans_of(monkeypatch)
        assert run(spark, rows, min_docs=2) == brute(rows, min_docs=2)
        shapes.append([plans["divergence_dense"].count(j) for j in ("BroadcastHashJoin", "SortMergeJoin")])
    assert shapes == [[3, 0], [2, 1]]


def test_sources_without_common_terms(spark):
    rows = [(f"{word} {word} shared" if i % 3 else word, "en", source) for source, word in (("a", "one"), ("b", "two"), ("c", "three")) for i in range(6)]
    rows += [("!!", "en", "d"), (None, "en", "e"), ("rare", "en", "f")]
    assert run(spark, rows, min_docs=4) == brute(rows, min_docs=4)
    assert run(spark, rows, min_docs=6) == brute(rows, min_docs=6)


def test_tokens_of_sliced_columns():
    texts = pa.array(["left out", "Ab  cD", None, "", "  ", "é\x00x", "end", "next"]).slice(1)
    for limit in (1, 5, 1 << 20):
        found = []
        for first, last, words, counts in tokens(texts, token_table([9, 32]), limit):
            words = iter(words.to_pylist())
            found += [[next(words).decode() for _ in range(n)] for n in counts]
            assert len(counts) == last - first and next(words, None) is None
        assert found == [["ab", "cd"], [], [], [], ["é\x00x"], ["end"], ["next"]]
