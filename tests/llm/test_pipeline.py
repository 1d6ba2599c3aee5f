from __future__ import annotations

import corpus_pipeline
from rookery.llm import language, simhash, toxicity
from rookery.llm.common import read
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import classes, fingerprint


def test_stages_equal_brute_force(spark, small):
    """Each stage over what the one before it kept; models are taken as they are, what they decide must take effect."""
    docs = read(spark, small, "documents")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    now = docs
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "toxicity", "near_duplicates", "benchmark_decontamination", "sentence_pieces"]

    found = {r["doc_id"]: r for r in language.identify(now).collect()}
    after = stages["language_id"](spark, now, small)
    assert after.columns == docs.columns
    assert ids(after) == [i for i in ids(now) if found[i]["lang_pred"] != "und" and found[i]["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE]
    assert after.count() > 0.97 * now.count()
    now = after

    toxic = {r["doc_id"] for r in toxicity.score(now, read(spark, small, "labels")).where("toxic").collect()}
    after = stages["toxicity"](spark, now, small)
    assert after.columns == docs.columns and ids(after) == [i for i in ids(now) if i not in toxic] and toxic
    now = after

    least = classes({r["doc_id"]: fingerprint(r["text"]) for r in now.collect()}, simhash.MAX_BITS)
    after = stages["near_duplicates"](spark, now, small)
    assert after.columns == docs.columns and ids(after) == sorted(set(least.values()))
    now = after

    bench = [(r["item_id"], r["text"]) for r in read(spark, small, "benchmark").collect()]
    dirty = {r[0] for r in leaks([(r["doc_id"], r["text"]) for r in now.collect()], bench) if r[-1]}
    after = stages["benchmark_decontamination"](spark, now, small)
    assert after.columns == docs.columns and ids(after) == [i for i in ids(now) if i not in dirty]
    now = after

    last = stages["sentence_pieces"](spark, now, small)
    assert ids(last) == ids(now) and last.where("NOT round_trip").count() == 0
    assert ids(corpus_pipeline.run(spark, small)) == ids(now)


def test_odd_rows(spark, small, odd_docs, no_docs):
    now = odd_docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
    assert now.count() > 0 and now.where("NOT round_trip").count() == 0
    now = no_docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small)
    assert now.count() == 0
