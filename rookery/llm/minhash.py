"""Circulant MinHash near-duplicates: shingle sets, two permutations, banding, exact Jaccard on full sets, components.

C-MinHash (Li and Li, 2021) needs two permutations of the shingle universe, not one per coordinate: ``sigma``
spreads the shingle ids once, and coordinate ``k`` is the least ``pi((sigma(x) + k) mod 2**32)`` over the set, so
``pi`` is shifted circularly by ``k``. The universe is the low 32 bits of a shingle's 64-bit hash; both permutations are
bijections on it (odd multipliers modulo 2**32 and xor-shifts). A task makes a text's set, its digest and its band
keys at once and passes on only the latter two, so no set is written or shuffled before it is known to have mates.

Documents with equal shingle sets are one node from the start; empty sets are nodes of their own and link with
nothing. Nodes are bucketed on every band of ``ROWS`` coordinates. Buckets with the same members are verified once.
The texts of members of shared buckets are read again, and only these go on, as texts. A crowded bucket is cut into
chunks by summed set size; every pair of chunks is one task, which makes the sets and checks pairs on the
full sets (``100 * |A & B| >= 80 * |A | B|``) and returns a spanning forest of its verified links: a pair already
joined in that task is not checked again, and no pair list is ever written. Components are alternating stars.

A pair of Jaccard ``s`` is a candidate with probability ``1 - (1 - s**ROWS)**BANDS``: at 0.8 it is missed with
probability 7e-5, at 0.85 with 8e-7, and a missed pair still joins through any third member linked to both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from rookery.llm.common import ship, token_table, tokens
from rookery.llm.simhash import components
from rookery.session import stage

SHINGLE, LEAST_PERCENT = 4, 80
BANDS, ROWS = 24, 5
#: Shingle hashes of all sets on one side of a verifying task, about 8 MB.
CHUNK_SHINGLES = 1 << 20
ship(__name__)

_MASK = (1 << 32) - 1

# Odd multipliers below 2**31 (Murmur2 and Lowbias32-style constants) and shift widths.
_SIGMA = (0x45D9F3B, 16, 0x2C1B3C6D, 15)
_PI = (0x5BD1E995, 15, 0x27D4EB2F, 13)
# odd multipliers modulo 2**64: words of a shingle, the finish of its hash, coordinates of a band
_WORDS, _FINISH, _KEYS = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC2B2AE3D27D4EB4F
_TABLE = token_table([32, *range(9, 14)])
#: Shingles of a set whose coordinates are made at once.
_AT_ONCE = 2048


def _permute(v: np.ndarray, keys: tuple[int, int, int, int]) -> np.ndarray:
    """A bijection of ``[0, 2**32)`` in place: multiply by an odd number, xor-shift, multiply, xor-shift."""
    first, shift_a, second, shift_b = keys
    v *= np.uint32(first)
    v ^= v >> np.uint32(shift_a)
    v *= np.uint32(second)
    v ^= v >> np.uint32(shift_b)
    return v


def _sets(texts: pa.StringArray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text of a task's batch, empty for no words."""
    for first, last, words, counts in tokens(texts, _TABLE):
        coded = words.dictionary_encode()
        known = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)
        hashed = np.append(known[coded.indices.to_numpy()] | np.uint64(1), np.zeros(shingle, np.uint64))
        ends = np.cumsum(counts)
        left = np.repeat(ends, counts) - np.arange(len(words))  # words from here to the end of the text
        mixed = np.zeros(len(words), np.uint64)
        for k in range(shingle):
            mixed = mixed * np.uint64(_WORDS) + np.where(left > k, hashed[k : k + len(words)], np.uint64(0))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_FINISH)
        mixed = (mixed ^ (mixed >> np.uint64(29))).view(np.int64)
        for end, n in zip(ends.tolist(), counts.tolist()):
            yield np.unique(mixed[end - n : end - min(n, shingle) + 1] if n else mixed[:0])


def _digest(found: np.ndarray) -> bytes | None:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket key per band of ``rows`` circulant MinHash coordinates."""
    low = (found ^ (found.view(np.uint64) >> np.uint64(32)).view(np.int64)).astype(np.uint32)
    spread = _permute(low, _SIGMA)
    shifts = np.arange(bands * rows, dtype=np.uint32)[:, None]
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(spread), _AT_ONCE):
        np.minimum(least, _permute(spread[None, at : at + _AT_ONCE] + shifts, _PI).min(axis=1), out=least)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(_KEYS) + least[r::rows]
    return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays or [np.zeros(0, np.int64)])))


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, set, node) per row: the sorted distinct 64-bit hashes of its word shingles and a key of that set.

    Words are A-Z lower-cased runs between white space of the whole text; fewer words than a shingle make one
    shingle of all; no words (or a null text) make the empty set, whose node is null. ``node`` is a 128-bit digest
    of the set; sets equal in it are taken as equal (a false match needs a 2**-128 collision).
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch.column(1), shingle))
            sizes, nodes = pa.array(map(len, found), pa.int64()), pa.array(map(_digest, found), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, _lists(found), nodes], names=[id_col, "n_shingles", "set", "node"])

    out = StructType([docs.schema[id_col]]).add("n_shingles", LongType()).add("set", ArrayType(LongType())).add("node", BinaryType())
    return docs.select(id_col, text_col).mapInArrow(make, out)


def sketches(
    docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, text_hash, n_shingles, node, keys) per row: as ``shingle_sets``, with the set's band keys in its place."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for found in _sets(batch.column(2), shingle):
                sizes.append(len(found))
                nodes.append(_digest(found))
                keys.append(_band_keys(found, bands, rows) if len(found) else found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), _lists(keys)],
                names=[id_col, "text_hash", "n_shingles", "node", "keys"],
            )

    out = StructType([docs.schema[id_col]]).add("text_hash", LongType()).add("n_shingles", LongType()).add("node", BinaryType()).add("keys", ArrayType(LongType()))
    return docs.select(id_col, F.xxhash64(text_col).alias("text_hash"), text_col).mapInArrow(make, out)


def bucketed(nodes: DataFrame) -> DataFrame:
    """(nid, n_shingles, band, key): one row per node and band."""
    return nodes.select("nid", "n_shingles", F.posexplode("keys").alias("band", "key"))


def signatures(nodes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(nid, n_shingles, band, key) of nodes that carry their ``set``: one bucket key per band of ``rows`` coordinates."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_band_keys(np.asarray(found, np.int64), bands, rows) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(keys)], names=["nid", "n_shingles", "keys"])

    return bucketed(nodes.select("nid", "n_shingles", "set").mapInArrow(make, "nid long, n_shingles long, keys array<long>"))


def forest(sets: list[np.ndarray], cut: int, least_percent: int) -> tuple[list[int], list[int]]:
    """Index pairs of verified links that connect what all verified links among ``sets`` connect.

    With ``cut < len(sets)`` only pairs across ``sets[:cut]`` and ``sets[cut:]`` are candidates (two chunks), else all.
    """
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts, ends = [], []
    for i in range(cut):
        others = np.arange(cut if cut < n else i + 1, n)
        fits = 100 * np.minimum(sizes[i], sizes[others]) >= least_percent * np.maximum(sizes[i], sizes[others])
        for j in others[fits & (label[others] != label[i])].tolist():
            if label[j] == label[i]:
                continue
            common = np.intersect1d(sets[i], sets[j], assume_unique=True).size
            if 100 * common >= least_percent * (sizes[i] + sizes[j] - common):
                label[label == label[j]] = label[i]
                starts.append(i)
                ends.append(j)
    return starts, ends


def shared(buckets: DataFrame) -> DataFrame:
    """(band, key, n, total, nid): the members of every bucket of at least two; buckets with the same members only once."""
    stats = buckets.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.sum(F.xxhash64("nid").bitwiseAND(F.lit(_MASK))).alias("mh"), F.bit_xor(F.xxhash64("nid")).alias("mx")
    ).where("n > 1")
    chosen = stats.groupBy("n", "mh", "mx").agg(F.min(F.struct("band", "key", "total")).alias("c")).select("c.band", "c.key", "c.total", "n")
    return buckets.select("band", "key", "nid").join(chosen, ["band", "key"])


def links(nodes: DataFrame, buckets: DataFrame, least_percent: int = LEAST_PERCENT, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """(a, b) pairs of ``nid``: a spanning forest of the links of at least ``least_percent`` Jaccard among bucket mates."""
    return verified(shared(buckets), nodes.select("nid", "set"), least_percent, chunk)


def verified(members: DataFrame, sets: DataFrame, least_percent: int = LEAST_PERCENT, chunk: int = CHUNK_SHINGLES) -> DataFrame:
    """As ``links``, for the ``members`` of ``shared`` buckets and the (nid, set) of these members."""
    parts = F.least(F.col("n"), F.greatest(F.ceil(F.col("total") / chunk), F.lit(1))).cast("int")
    own = F.pmod(F.xxhash64("nid"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = (
        members.withColumn("parts", parts).withColumn("own", own)
        .select("band", "key", "nid", "own", F.explode(pairs).alias("p"))
        .join(sets, "nid")
    )
    sides = dealt.groupBy("band", "key", "p").agg(
        F.collect_list(F.when(F.col("own") == F.col("p.i"), F.struct("nid", "set"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("p.i"), F.struct("nid", "set"))).alias("right"),
    ).select("left", "right")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found_a, found_b = [], []
            for left, right in zip(batch["left"], batch["right"]):
                every = list(left) + list(right)
                sets = [np.asarray(m["set"], dtype=np.int64) for m in every]
                cut = len(left) if len(left) and len(right) else len(every)
                starts, ends = forest(sets, cut, least_percent)
                found_a += [every[i]["nid"] for i in starts]
                found_b += [every[j]["nid"] for j in ends]
            yield pd.DataFrame({"a": found_a, "b": found_b})

    return sides.mapInPandas(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, least_percent: int = LEAST_PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the smallest id reachable over verified links, and whether it is the row's.

    Rows equal in id and text give one row; an id with several texts gets a row for each distinct set. Null and
    wordless texts have the empty set, link with nothing and are their own component. A null id is no id: its row's
    component is the smallest id of the documents it links with, or null; ``kept`` is ``doc_id <=> component_id``, so
    a null-id row is kept exactly when it links with no id. Very long texts are whole sets; the cost of one is linear
    in its shingles. Other columns are ignored; an empty table gives an empty table.
    """
    rows_ = stage(sketches(docs, shingle, bands, rows, id_col, text_col).dropDuplicates([id_col, "node"]), "minhash_rows")
    grouped = rows_.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min(id_col).alias("least"), F.min(F.struct(id_col, "text_hash")).alias("shown"), F.any_value("keys").alias("keys"), F.any_value("n_shingles").alias("n_shingles")
    )
    # numbered once as they are written; every later step works on the number
    nodes = stage(grouped.withColumn("nid", F.monotonically_increasing_id()), "minhash_nodes")
    members = stage(shared(bucketed(nodes)), "minhash_members")
    # one text of every node with bucket mates; its set is made from it
    shown = nodes.join(members.select("nid"), "nid", "left_semi").select("nid", F.col(f"shown.{id_col}").alias("_id"), F.col("shown.text_hash").alias("_hash"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_hash"))
    texts = docs.select(id_col, text_col).join(shown, same).select("nid", text_col)
    sets = shingle_sets(texts, shingle, "nid", text_col).dropDuplicates(["nid"]).select("nid", "set")
    found = stage(verified(members, stage(sets, "minhash_sets"), least_percent), "minhash_links")
    if found.isEmpty():
        classes = nodes.select("node", F.col("least").alias("component_id"))
    else:
        member = components(found)
        linked = nodes.join(member, nodes["nid"] == member["node"], "left").select(nodes["node"], "least", F.coalesce("component", "nid").alias("component"))
        linked = stage(linked, "minhash_components")
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = linked.join(least, "component").select("node", "component_id")
    own = rows_.join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return own.select(id_col, "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
