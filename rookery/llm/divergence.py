"""Source divergence audit: how far each source of a language drifts from its siblings and from the language.

Method (minimal-perfect-hash recount):

1. Exact frequency filter: the texts are read once. A task cuts them into terms and counts, per (lang, source, term),
   occurrences and document rows; the partial counts are summed before and after one shuffle and staged. A language
   keeps the terms found in at least ``min_docs`` of its rows (V of them).
2. The kept terms of a language are cut into shards of about ``shard_keys`` keys (shard = hash of the term). Each shard
   gets a minimal perfect hash built by hash-and-displace in its own task (``applyInPandas``): keys are put in
   buckets, and each bucket, largest first, gets the smallest displacement ``d`` that sends all its keys to free,
   distinct slots ``pmod(x XOR (x >>> 31), m)`` with ``x = hs XOR (hd >>> 33) * d``. The shard keeps the displacement per bucket and the key stored
   in every slot. A shard's slots follow its predecessors' in the language, so the slots of a language are 0..V-1.
3. Recount: the counts of all terms per (lang, source) are looked up through the displacement of their bucket, kept
   together with the stored keys of the slots that bucket filled, and verified against the stored key of their slot;
   unkept terms fail the check and drop out. What is left are the non-zero dense slots of each group.

Scoring, all in exact integers (decimal(38,0) where a product could pass a long):
``p = 1 + floor(1e9 * (count + 2) / (N + 2V))`` and ``f = floor((p - q)^2 / (p + q))``. The ``pair`` part adds f over
all V terms for each ordered pair of sources of a language. Only terms found in both sources are listed; those of one
alone are all terms of that one, tallied by count, less the ones both have, and those absent from both are counted.
The ``term`` part lists, per group, the kept terms with count > 0 whose p is above the language's, best ten.

Defined edge cases: null text, lang and source read as ''; each row is a document, so repeated rows count twice; a
group without kept terms has N = 0 and still appears in ``pair`` (its p's come from count 0); a language with V = 0
gives value 0 for every pair and no ``term`` rows; a language with one source has no ``pair`` rows; an empty table
gives no rows. Extra input columns are ignored. Ties in value are broken by the item's UTF-8 bytes, ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import ship, token_table, tokens, union_all
from rookery.session import stage

ship(__name__)

# fixed values: the bytes between terms of the contract, the scale of p, the smoothing added to counts
NON_TERMS = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
SCALE = 1000000000
SMOOTH = 2

_PLACED = "lang string, shard long, slot long, term string, bucket long, d long"
_COUNTED = "lang string, source string, term string, cnt long, n_docs long"
_TABLE = token_table(NON_TERMS)
_FIRST_SEARCH, _SEARCH = 32, 4096
_MAX_D = 1 << 24
# about what a kept term takes in a broadcast of the lookup table beside its own bytes, and the most such a table may take
_LOOKUP_ROW, _LOOKUP_BYTES = 100, 32 << 20


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice of rows (lang, source, text): occurrences and rows of each (lang, source, term)."""
    for batch in batches:
        langs, sources = (batch.column(name).dictionary_encode() for name in ("lang", "source"))
        many = len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
        for first, last, words, counts in tokens(batch.column("text"), _TABLE):
            coded = words.dictionary_encode()
            size = len(coded.dictionary)
            if not size:
                continue
            own = np.repeat(np.arange(last - first, dtype=np.int64), counts) * size + coded.indices.to_numpy()
            pairs, times = np.unique(own, return_counts=True)
            row, term = np.divmod(pairs, size)
            key = group[first:last][row] * size + term
            order = np.argsort(key)
            key = key[order]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            of_group, term = np.divmod(key[heads], size)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(of_group // many)), sources.dictionary.take(pa.array(of_group % many)),
                    coded.dictionary.take(pa.array(term)).view(pa.string()),
                    pa.array(np.add.reduceat(times[order], heads)), pa.array(np.diff(np.append(heads, len(key)))),
                ],
                names=["lang", "source", "term", "cnt", "n_docs"],
            )


def _hashes(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("_hb", F.xxhash64("term", F.lit("b")))
        .withColumn("_hs", F.xxhash64("term", F.lit("s")))
        .withColumn("_hd", F.shiftrightunsigned(F.xxhash64("term", F.lit("d")), 33))
        .withColumn("_hh", F.xxhash64("term", F.lit("h")))
    )


def _place(frame: pd.DataFrame) -> pd.DataFrame:
    """Hash-and-displace for the keys of one shard: a slot per key and a displacement per bucket."""
    frame = frame.sort_values("term", kind="stable", ignore_index=True)  # the same tables on every recomputation
    m = len(frame)
    buckets = max(1, (m + 1) // 2)
    bucket = np.mod(frame["_hb"].to_numpy(np.int64), buckets)
    hs = frame["_hs"].to_numpy(np.int64)
    hd = frame["_hd"].to_numpy(np.int64)
    taken = np.zeros(m, dtype=bool)
    slot = np.full(m, -1, dtype=np.int64)
    disp = np.zeros(m, dtype=np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
    groups = np.split(order, starts[1:])
    groups.sort(key=lambda g: (-len(g), bucket[g[0]]))
    for keys in groups:
        first, width = 0, _FIRST_SEARCH  # most keys are placed by one of the first few
        while first < _MAX_D:
            d = np.arange(first, first + width, dtype=np.int64)
            mixed = np.bitwise_xor(hs[keys, None], hd[keys, None] * d[None, :])
            folded = np.bitwise_xor(mixed, (mixed.view(np.uint64) >> np.uint64(31)).view(np.int64))
            cand = np.mod(folded, m)
            ok = ~taken[cand].any(axis=0)
            if len(keys) > 1:
                ordered = np.sort(cand, axis=0)
                ok &= (np.diff(ordered, axis=0) != 0).all(axis=0)
            if ok.any():
                pick = int(np.argmax(ok))
                slot[keys] = cand[:, pick]
                taken[cand[:, pick]] = True
                disp[keys] = d[pick]
                break
            first, width = first + width, min(8 * width, _SEARCH)
        else:
            raise ValueError(f"no displacement found for {len(keys)} keys of a shard of {m}")
    return pd.DataFrame(
        {
            "lang": frame["lang"].to_numpy(),
            "shard": frame["shard"].to_numpy(np.int64),
            "slot": slot,
            "term": frame["term"].to_numpy(),
            "bucket": bucket,
            "d": disp,
        }
    )


def _p(count: Column, total: Column, v: Column) -> Column:
    num = (count.cast("decimal(38,0)") + F.lit(SMOOTH)) * F.lit(SCALE)
    den = (total + v * F.lit(SMOOTH)).cast("decimal(38,0)")
    return F.lit(1).cast("long") + _div(num, den)


def _div(a: Column, b: Column) -> Column:
    """Exact floor division of non-negative integers (Spark's integral ``div``)."""
    return F.call_function("div", a, b).cast("long")


def _f(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def audit(docs: DataFrame, min_docs: int = 10, shard_keys: int = 4096, top: int = 10) -> DataFrame:
    """Rows lang, source, part ('pair' or 'term'), item, value long, rank int; see the module text."""
    base = docs.select(
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"), F.coalesce(F.col("source"), F.lit("")).alias("source"), "text"
    )
    groups = base.groupBy("lang", "source").agg(F.lit(1).alias("_one")).drop("_one")

    # the texts are read and counted once
    counts = base.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(
        F.sum("cnt").alias("cnt"), F.sum("n_docs").alias("n_docs")
    )
    counts = stage(counts, "divergence_counts")

    # exact document frequency per language
    kept = (
        counts.groupBy("lang", "term")
        .agg(F.sum("n_docs").alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
        .select("lang", "term")
    )
    kept = stage(kept, "divergence_kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"))
    langs = stage(langs.withColumn("n_shards", F.floor(F.col("v") / shard_keys).cast("long") + 1), "divergence_langs")
    keyed = _hashes(kept.join(langs, "lang")).withColumn("shard", F.pmod("_hh", F.col("n_shards")))
    placed = keyed.groupBy("lang", "shard").applyInPandas(_place, _PLACED)
    placed = stage(placed, "divergence_placed")
    sizes = placed.groupBy("lang", "shard").agg(F.count("*").alias("m"))
    sizes = sizes.withColumn(
        "offset",
        F.coalesce(F.sum("m").over(Window.partitionBy("lang").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("n_buckets", F.greatest(F.lit(1), F.floor((F.col("m") + 1) / 2)).cast("long"))
    # tables of known size: where they are small the recount is looked up without a shuffle of its own
    sizes = stage(sizes, "divergence_sizes")
    # per bucket its displacement and the stored keys of the slots it filled: a kept term can only lie in one of these
    buckets = placed.join(sizes, ["lang", "shard"]).groupBy("lang", "shard", "bucket").agg(
        F.any_value("d").alias("d"), F.any_value("m").alias("m"), F.any_value("offset").alias("offset"),
        F.map_from_entries(F.collect_list(F.struct("slot", "term"))).alias("stored"),
    )
    buckets = stage(buckets, "divergence_buckets")
    # Spark sizes a staged table by its compressed files; this one is many times that when broadcast
    size = kept.agg(F.sum(F.octet_length("term") + _LOOKUP_ROW)).first()[0] or 0
    if size > _LOOKUP_BYTES:
        buckets = buckets.hint("merge")

    # recount through the perfect hashes, verified against the stored keys
    probe = _hashes(counts.drop("n_docs").join(langs.select("lang", "n_shards"), "lang"))
    probe = probe.withColumn("shard", F.pmod("_hh", F.col("n_shards"))).join(sizes.select("lang", "shard", "n_buckets"), ["lang", "shard"])
    probe = probe.withColumn("bucket", F.pmod("_hb", F.col("n_buckets"))).join(buckets, ["lang", "shard", "bucket"])
    mixed = F.col("_hs").bitwiseXOR(F.col("_hd") * F.col("d"))
    probe = probe.withColumn("slot", F.pmod(mixed.bitwiseXOR(F.shiftrightunsigned(mixed, 31)), F.col("m")))
    dense = (
        probe.where(F.try_element_at("stored", F.col("slot")) == F.col("term"))
        .select("lang", "source", (F.col("offset") + F.col("slot")).alias("gslot"), "term", "cnt")
    )
    dense = stage(dense, "divergence_dense")

    # how many terms a source has with each count; n and k are its occurrences and terms, p0 its p of a term it lacks
    tally = stage(dense.groupBy("lang", "source", "cnt").agg(F.count("*").alias("m")), "divergence_tally")
    totals = tally.groupBy("lang", "source").agg(F.sum(F.col("cnt") * F.col("m")).alias("n"), F.sum("m").alias("k"))
    group_n = groups.join(totals, ["lang", "source"], "left").join(langs.select("lang", "v"), "lang", "left")
    group_n = group_n.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "k", "v")])
    group_n = group_n.withColumn("p0", F.when(F.col("v") > 0, _p(F.lit(0), F.col("n"), F.col("v"))))
    group_n = stage(group_n, "divergence_groups")
    lang_n = group_n.groupBy("lang").agg(F.sum("n").alias("ln"), F.max("v").alias("v"))

    # one row per slot: p of every source that has the term, computed once, and the count of the language
    slots = (
        dense.join(group_n, ["lang", "source"])
        .withColumn("p", _p(F.col("cnt"), F.col("n"), F.col("v")))
        .groupBy("lang", "gslot", "term")
        .agg(F.sum("cnt").alias("lcnt"), F.collect_list(F.struct("source", "p", "p0")).alias("found"))
    )
    slots = stage(slots, "divergence_slots")

    # part term
    tv = (
        slots.join(lang_n, "lang")
        .withColumn("q", _p(F.col("lcnt"), F.col("ln"), F.col("v")))
        .select("lang", F.col("term").alias("item"), "q", F.inline("found"))
        .where(F.col("p") > F.col("q"))
        .withColumn("value", _f(F.col("p"), F.col("q")))
    )
    tw = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.encode("item", "UTF-8").asc())
    term_part = (
        tv.withColumn("rank", F.row_number().over(tw))
        .where(F.col("rank") <= top)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int"))
    )

    # part pair: terms that both have come from one slot each, so nothing is joined to the exploded slots, and are summed
    # per pair before any shuffle
    x, y = F.col("x"), F.col("y")
    both = (
        slots.select("lang", "found", F.explode("found").alias("x"))
        .select("lang", "x", F.explode("found").alias("y"))
        .where(x["source"] != y["source"])
        .select("lang", x["source"].alias("a"), y["source"].alias("b"), _f(x["p"], y["p"]).alias("f"), _f(x["p"], y["p0"]).alias("f0"))
        .groupBy("lang", "a", "b")
        .agg(F.sum("f").alias("f"), F.sum("f0").alias("f0"), F.count("*").alias("u"))
    )
    both = stage(both, "divergence_pairs")
    # terms that a has and b lacks: all terms of a against b's p0, less those that b has; f is symmetric, so the terms
    # that only b has are those of the pair (b, a)
    b_side = group_n.select("lang", F.col("source").alias("b"), F.col("k").alias("kb"), F.col("p0").alias("p0b"))
    tallied = tally.join(group_n.drop("k", "p0"), ["lang", "source"]).select(
        "lang", F.col("source").alias("a"), "m", _p(F.col("cnt"), F.col("n"), F.col("v")).alias("pa")
    )
    one_sided = (
        tallied.join(b_side, "lang")
        .where(F.col("a") != F.col("b"))
        .groupBy("lang", "a", "b")
        .agg(F.sum(F.col("m") * _f(F.col("pa"), F.col("p0b"))).alias("f"))
        .unionByName(both.select("lang", "a", "b", (-F.col("f0")).alias("f")))
        .withColumn("u", F.lit(0).cast("long"))
    )
    other = one_sided.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f", "u")
    present = union_all([both.drop("f0"), one_sided, other]).groupBy("lang", "a", "b").agg(F.sum("f").alias("fs"), F.sum("u").alias("u"))
    a_side = group_n.select("lang", F.col("source").alias("a"), F.col("k").alias("ka"), F.col("p0").alias("p0a"), "v")
    pairs = a_side.join(b_side, "lang").where(F.col("a") != F.col("b"))
    absent = F.col("v") - F.col("ka") - F.col("kb") + F.coalesce("u", F.lit(0))
    pv = pairs.join(present, ["lang", "a", "b"], "left").withColumn(
        "value",
        F.when(F.col("v") == 0, F.lit(0).cast("long")).otherwise(
            F.coalesce("fs", F.lit(0)) + absent * _f(F.col("p0a"), F.col("p0b"))
        ),
    )
    pw = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), F.encode("b", "UTF-8").asc())
    pair_part = pv.select(
        "lang",
        F.col("a").alias("source"),
        F.lit("pair").alias("part"),
        F.col("b").alias("item"),
        F.col("value").cast("long").alias("value"),
        F.row_number().over(pw).cast("int").alias("rank"),
    )
    return pair_part.unionByName(term_part)
