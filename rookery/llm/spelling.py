"""Spelling variants: words one edit apart, found by probing generated edits against broadcast Bloom filters.

Every word of the vocabulary generates all strings one deletion, replacement or insertion away (the alphabet is
that of the words). A string is never built for a probe: its polynomial hash follows from the word's prefix sums, for
all words of one length at once. Probes go to a blocked Bloom filter of the vocabulary words of their own length
(one 512-bit block per probe, ``PROBES`` bits in it). Only positives become strings and shuffle; an exact join with
the vocabulary removes the false ones, so the result is exact: the filter can only say "maybe", never "no" wrongly.

The filters are built in Spark (an OR of bits per block), and their size is known before any of them reaches the
driver: ``BITS_PER_WORD`` bits per word of a length, rounded up to whole blocks. Each length is cut into as many
shards as keep one under ``SHARD_BYTES``, and the shards go out in passes of at most ``PASS_BYTES``; each pass probes
all words again, but only for its own shards. Nothing about the data switches this on or off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import lower_ascii, ship
from rookery.session import stage

# Fixed values of the contract: the letters of a run, the least word length and count, the factor of a form.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR, NOISE_DIVISOR = 7, 2, 10, 31
#: The letters a word may hold once A-Z are lower-cased, and so what an edit may insert or put in.
ALPHABET = np.array([ord(c) for c in "abcdefghijklmnopqrstuvwxyz"] + list(range(0xC0, 0x100)), dtype=np.uint64)

BITS_PER_WORD, PROBES = 24, 5
SHARD_BYTES, PASS_BYTES = 32 << 20, 128 << 20
#: Words whose edits one task probes.
WORDS_PER_TASK = 40_000
ship(__name__)

_BASE = np.uint64(0x100000001B3)  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_BLOCK = 512


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): every run after its noise deletion, counted over all documents; no run is left out here.

    A null text has no runs. With a null id the key ``<id>:<run>`` is null and the run keeps every code point.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), 0)).alias("run")
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), run).withColumn("run", lower_ascii(F.col("run")))
    h = F.crc32(F.encode(F.concat(F.col("_id"), F.lit(":"), F.col("run")), "UTF-8"))
    cut = F.pmod(h, F.length("run")).cast("int")
    dropped = F.concat(F.substr(F.col("run"), F.lit(1), cut), F.substr(F.col("run"), cut + 2))
    word = F.when(F.pmod(h, F.lit(NOISE_DIVISOR)) == 0, dropped).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, element-wise on uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def _codes(batch: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(batch).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64).reshape(len(batch), length)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points."""
    powers = np.ones(codes.shape[1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        if codes.shape[1] > 1:
            powers[1:] = np.cumprod(np.full(codes.shape[1] - 1, _BASE, dtype=np.uint64))
        return (codes * powers).sum(axis=1, dtype=np.uint64)


def _key(h: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h ^ (np.uint64(length) * np.uint64(0x9E3779B97F4A7C15)))


def _place(h: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The key (whose bits choose shard and block) and the bit positions in the block of hashes ``h`` of ``length`` code points."""
    key = _key(h, length)
    second = _mix(key)
    return key, [((second >> np.uint64(9 * j)) & np.uint64(_BLOCK - 1)) for j in range(PROBES)]


def _filter_rows(vocabulary: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """(length, part, block, lane, bits): the set bits of every filter, one row per 64-bit lane that a word touches."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for length, group in batch.groupby(batch["word"].str.len()):
                parts, blocks = plan[length]
                h = _hash(_codes(group["word"].tolist(), length))
                key, bits = _place(h, length)
                part = (key >> np.uint64(16)) % np.uint64(parts)
                block = (key >> np.uint64(32)) % np.uint64(blocks)
                for b in bits:
                    out.append(pd.DataFrame({
                        "length": length, "part": part.astype(np.int64), "block": block.astype(np.int64),
                        "lane": (b >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (b & np.uint64(63))).view(np.int64),
                    }))
            if out:
                yield pd.concat(out, ignore_index=True)

    schema = "length long, part long, block long, lane long, bits long"
    return vocabulary.select("word").mapInPandas(build, schema).groupBy("length", "part", "block", "lane").agg(F.bit_or("bits").alias("bits"))


def _edits(codes: np.ndarray):
    """Hashes of every deletion, replacement and insertion of each row, with how to rebuild the string of one."""
    m, length = codes.shape
    powers = np.ones(length + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(length, _BASE, dtype=np.uint64))
        pre = np.zeros((m, length + 1), dtype=np.uint64)
        pre[:, 1:] = np.cumsum(codes * powers[:length], axis=1, dtype=np.uint64)
        whole = pre[:, -1:]
        deletion = pre[:, :-1] + (whole - pre[:, 1:]) * _INVERSE  # (m, length): drop position p
        replace = whole[:, :, None] + (ALPHABET[None, None, :] - codes[:, :, None]) * powers[None, :length, None]  # (m, length, a)
        insert = pre[:, :, None] + ALPHABET[None, None, :] * powers[None, :, None] + (whole - pre)[:, :, None] * _BASE  # (m, length + 1, a)
    same = ALPHABET[None, None, :] == codes[:, :, None]  # a replacement by the letter itself is the word
    return deletion, replace, same, insert


def _probe(vocabulary: DataFrame, plan: dict[int, tuple[int, int]], shards: list[tuple[int, int]], filters) -> DataFrame:
    """(word, candidate): the edits of each word whose filter says maybe, for the shards of this pass only."""
    wanted = set(shards)

    def test(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes of strings of ``length`` pass the filter of their shard in this pass."""
        flat = h.ravel()
        hit = np.zeros(flat.shape, dtype=bool)
        if length not in plan:
            return hit.reshape(h.shape), hit
        parts, blocks = plan[length]
        key = _key(flat, length)
        part = None if parts == 1 else ((key >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
        for p in range(parts):
            if (length, p) not in wanted:
                continue
            table = filters.value[(length, p)]
            at = None if part is None else np.flatnonzero(part == p)
            own = key if at is None else key[at]
            lane0 = ((own >> np.uint64(32)) % np.uint64(blocks)) << np.uint64(3)
            second = _mix(own)
            # each bit is looked up only for those whose bits before it are set
            for j in range(PROBES):
                b = second >> np.uint64(9 * j)
                lane = table[(lane0 + ((b >> np.uint64(6)) & np.uint64(7))).view(np.int64)]
                left = np.flatnonzero((lane >> (b & np.uint64(63))) & np.uint64(1))
                at = left if at is None else at[left]
                lane0, second = lane0[left], second[left]
            hit[at] = True
        return hit.reshape(h.shape), hit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found_w, found_c = [], []
            for length, group in batch.groupby(batch["word"].str.len()):
                texts = group["word"].tolist()
                for at in range(0, len(texts), max(1, 200_000 // (length * len(ALPHABET)))):
                    chunk = texts[at : at + max(1, 200_000 // (length * len(ALPHABET)))]
                    deletion, replace, same, insert = _edits(_codes(chunk, length))
                    hit, _ = test(deletion, length - 1)
                    for i, p in zip(*np.nonzero(hit)):
                        found_w.append(chunk[i])
                        found_c.append(chunk[i][:p] + chunk[i][p + 1 :])
                    hit, _ = test(replace, length)
                    for i, p, a in zip(*np.nonzero(hit & ~same)):
                        found_w.append(chunk[i])
                        found_c.append(chunk[i][:p] + chr(int(ALPHABET[a])) + chunk[i][p + 1 :])
                    hit, _ = test(insert, length + 1)
                    for i, p, a in zip(*np.nonzero(hit)):
                        found_w.append(chunk[i])
                        found_c.append(chunk[i][:p] + chr(int(ALPHABET[a])) + chunk[i][p:])
            if found_w:
                yield pd.DataFrame({"word": found_w, "candidate": found_c})

    return spread(vocabulary, sum(parts * blocks for parts, blocks in plan.values())).mapInPandas(run, "word string, candidate string")


def spread(vocabulary: DataFrame, blocks: int) -> DataFrame:
    """The words alone, at most about ``WORDS_PER_TASK`` to a task, whose probing is what costs time."""
    tasks = max(vocabulary.sparkSession.sparkContext.defaultParallelism, math.ceil(blocks * _BLOCK / BITS_PER_WORD / WORDS_PER_TASK))
    return vocabulary.select("word").repartition(tasks, "word")


def plan_filters(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """length -> (shards, blocks per shard): ``BITS_PER_WORD`` bits a word, whole blocks, shards under ``SHARD_BYTES``."""
    plan = {}
    for length, count in lengths.items():
        parts = max(1, math.ceil(count * BITS_PER_WORD / 8 / SHARD_BYTES))
        plan[length] = (parts, max(1, math.ceil(count * BITS_PER_WORD / parts / _BLOCK)))
    return plan


def passes(plan: dict[int, tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Shards in groups of at most ``PASS_BYTES`` (a shard is never larger than ``SHARD_BYTES``)."""
    groups, now, size = [], [], 0
    for length in sorted(plan):
        parts, blocks = plan[length]
        for p in range(parts):
            if now and size + blocks * 64 > PASS_BYTES:
                groups.append(now)
                now, size = [], 0
            now.append((length, p))
            size += blocks * 64
    return groups + ([now] if now else [])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of vocabulary words one edit apart, both ways, exactly."""
    spark = vocabulary.sparkSession
    lengths = {r["length"]: r["count"] for r in vocabulary.groupBy(F.length("word").alias("length")).count().collect()}
    plan = plan_filters(lengths)
    bits = stage(_filter_rows(vocabulary, plan), "spelling_filters")
    found = []
    for shards in passes(plan):
        chosen = [length * (1 << 24) + p for length, p in shards]
        rows = bits.where((F.col("length") * (1 << 24) + F.col("part")).isin(chosen)).toPandas()  # at most PASS_BYTES of set lanes
        filters = {}
        for length, p in shards:
            table = np.zeros(plan[length][1] * 8, dtype=np.uint64)
            own = rows[(rows["length"] == length) & (rows["part"] == p)]
            table[own["block"].to_numpy() * 8 + own["lane"].to_numpy()] = own["bits"].to_numpy().view(np.uint64)
            filters[(length, p)] = table
        shared = spark.sparkContext.broadcast(filters)
        found.append(stage(_probe(vocabulary, plan, shards, shared), "spelling_positives"))
    if not found:
        return spark.createDataFrame([], "word string, near string, near_n long")
    positives = found[0]
    for more in found[1:]:
        positives = positives.unionByName(more)
    known = vocabulary.select(F.col("word").alias("candidate"), F.col("n").alias("near_n"))
    return positives.distinct().join(known, "candidate").select("word", F.col("candidate").alias("near"), "near_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least 7 code points seen at least twice.

    ``form`` is the word's near word of largest count (ties: smallest in code-point order) if that count is at least
    ten times its own, else null; ``root`` follows forms to the end (counts grow tenfold at each step, so there is no
    cycle). Null texts add nothing; other columns are ignored; very long runs are words like any other (a run of L
    code points makes about 180 L probes); an empty table or one without such words gives an empty table.
    """
    counted = words(docs.select(id_col, text_col), id_col, text_col)
    vocabulary = stage(counted.where((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT)), "spelling_vocabulary")
    pairs = near_pairs(vocabulary)
    # largest count first, then the smallest word: strings compare by UTF-8 bytes, which is code-point order
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by("near", F.struct(-F.col("near_n"), "near")).alias("_best"), F.max("near_n").alias("_best_n")
    )
    ranked = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "_best", "_best_n")
    formed = ranked.select(
        "word", "n", "n_near",
        F.when(F.col("_best_n") >= FORM_FACTOR * F.col("n"), F.col("_best")).alias("form"),
        F.when(F.col("_best_n") >= FORM_FACTOR * F.col("n"), F.col("_best_n")).alias("form_n"),
    )
    formed = stage(formed, "spelling_forms")
    edges = formed.where(F.col("form").isNotNull()).select(F.col("word").alias("_from"), F.col("form").alias("_to"))
    now = formed.withColumn("root", F.coalesce("form", "word"))
    while True:
        step = now.join(edges, now["root"] == edges["_from"], "left")
        moved = step.where(F.col("_to").isNotNull()).limit(1).count() > 0
        if not moved:
            break
        now = stage(step.withColumn("root", F.coalesce("_to", "root")).drop("_from", "_to"), "spelling_roots")
    return now.select("word", "form", "root", "n", "n_near", "form_n")
