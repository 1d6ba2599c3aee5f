"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, connected components.

Fingerprints come from shingles exploded inside the row's own task, summed bit by bit in generated code; only sums
cross the shuffle. Texts with one fingerprint are one node from there on. If two fingerprints differ in at most
``d`` bits and are cut into ``k > d`` blocks, at least ``k - d`` blocks agree, so nodes are joined on every choice
of ``k - d`` blocks. ``k`` follows from the number of nodes alone (about 16 per key or fewer on random
fingerprints), whatever ``k`` is, no pair is lost. A key with many nodes is cut into chunks, each pair of chunks is
a task of bounded size, and it gives back a spanning forest of its verified links, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.common import lower_ascii, ship, space_words
from rookery.session import stage

SHINGLE, MAX_BITS = 4, 4
#: Nodes of a key that one task compares with as many others.
CHUNK = 2048
#: Nodes per key that decide how many blocks are cut.
PER_KEY = 16
ship(__name__)
_LANE = (1 << 32) + 1


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every whole text; a text without words has 0, one of fewer words than a shingle is one shingle.

    Rows equal in id and text count once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), space_words(lower_ascii(text)).alias("_w"))
    n = F.size("_w")
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))),
        lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i + 1, shingle), " ")),
    )
    each = words.withColumn("_h", F.when(n == 0, F.array(F.lit(0).cast("long"))).otherwise(hashes)).select(
        "_id", "_text", F.explode_outer("_h").alias("h")
    )
    # lane i counts bit i below and bit 32 + i above, 32 bits each
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(_LANE)).alias(f"l{i}") for i in range(32)]
    summed = each.groupBy("_id", "_text").agg(F.count("*").alias("n"), *lanes)

    def bit(i: int) -> Column:
        lane = F.col(f"l{i % 32}")
        count = lane.bitwiseAND((1 << 32) - 1) if i < 32 else F.shiftrightunsigned(lane, 32)
        value = (1 << i) if i < 63 else -(1 << 63)
        return F.when(2 * count > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long"))

    value = bit(0)
    for i in range(1, 64):
        value = value.bitwiseOR(bit(i))
    return summed.select(F.col("_id").alias(id_col), value.alias("fp"))


def blocks_for(nodes: int, bits: int) -> int:
    """The fewest blocks, at least two over ``bits``, whose keys leave ``PER_KEY`` random fingerprints or fewer to a key."""
    for k in range(bits + 2, bits + 7):
        if nodes <= PER_KEY << sum(sorted(64 * (i + 1) // k - 64 * i // k for i in range(k))[: k - bits]):
            return k
    return bits + 7


def _keys(nodes: DataFrame, k: int, bits: int) -> DataFrame:
    """One row per node and choice of ``k - bits`` blocks: the choice, the bits in its blocks, the node."""
    edges = [(64 * i // k, 64 * (i + 1) // k) for i in range(k)]
    choices = []
    for number, chosen in enumerate(combinations(edges, k - bits)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        choices.append(F.struct(F.lit(number).alias("block"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return nodes.select("fp", F.explode(F.array(*choices)).alias("b")).select("b.block", "b.key", "fp")


def forest(left: np.ndarray, right: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most ``bits`` bits that connect what all such links inside ``left`` (or between both sides) connect."""
    every = left if right is None else np.concatenate([left, right])
    root = np.arange(len(every))
    starts, ends = [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at in range(0, len(left), 256):
        rows = every[at : at + 256] if right is None else left[at : at + 256]
        columns, shift = (every, 0) if right is None else (right, len(left))
        close = np.bitwise_count(rows[:, None] ^ columns[None, :]) <= bits
        for i in range(len(rows)):
            near = np.flatnonzero(close[i]) + shift
            # one representative of each component that this row still joins
            for j in near[np.unique(root[near], return_index=True)[1]] if len(near) > 1 else near:
                a, b = find(at + i), find(int(j))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    starts.append(at + i)
                    ends.append(int(j))
    return every[starts], every[ends]


def links(nodes: DataFrame, bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(fp_a, fp_b): links that connect exactly the nodes (distinct ``fp``) that all links of at most ``bits`` bits connect."""
    k = blocks_for(nodes.count(), bits)
    keyed = _keys(nodes, k, bits)
    crowded = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(crowded, ["block", "key"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    dealt = members.withColumns({"parts": parts, "own": own}).select("block", "key", "own", "fp", F.explode(pairs).alias("p"))
    sides = dealt.groupBy("block", "key", "p").agg(
        F.collect_list(F.when(F.col("own") == F.col("p.i"), F.col("fp"))).alias("left"),
        F.collect_list(F.when(F.col("own") != F.col("p.i"), F.col("fp"))).alias("right"),
    ).select("left", "right")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found_a, found_b = [], []
            two = [(len(a) + len(b)) == 2 for a, b in zip(batch["left"], batch["right"])]
            if any(two):
                pair = np.array([[*a, *b] for a, b, t in zip(batch["left"], batch["right"], two) if t], dtype=np.int64)
                near = np.bitwise_count((pair[:, 0] ^ pair[:, 1]).view(np.uint64)) <= bits
                found_a.append(pair[near, 0])
                found_b.append(pair[near, 1])
            for a, b, t in zip(batch["left"], batch["right"], two):
                if not t:
                    a, b = (np.asarray(x, dtype=np.int64).view(np.uint64) for x in (a, b))
                    x, y = forest(a if len(a) else b, b if len(a) and len(b) else None, bits)
                    found_a.append(x.view(np.int64))
                    found_b.append(y.view(np.int64))
            yield pd.DataFrame({"fp_a": np.concatenate(found_a or [[]]).astype("int64"), "fp_b": np.concatenate(found_b or [[]]).astype("int64")})

    return sides.mapInPandas(compare, "fp_a long, fp_b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, for the nodes of ``edges`` (a, b).

    Alternates large and small stars (Kiveris et al., 2014); each round is written to the shared folder.
    A node with very many neighbours is never gathered: minima are aggregates and joined back.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.where("a <> b").select("a", "b").distinct(), "stars")
    before = mark(now)
    while True:
        now = stage(small_star(large_star(now)), "stars")
        after = mark(now)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): the smallest id reachable over links of at most ``bits`` bits.

    Null and blank texts share the fingerprint zero and link like any other. Rows equal in id and text give one row;
    an id that comes with several texts gets a row for each of their fingerprints. A null id is no id: its rows get
    a component only through others, else null. Other columns are ignored; an empty table gives an empty table.
    """
    own = stage(fingerprints(docs, shingle, id_col, text_col).distinct(), "fingerprints")
    nodes = stage(own.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprint_nodes")
    found = stage(links(nodes.select("fp"), bits), "fingerprint_links")
    if found.isEmpty():
        classes = nodes.select("fp", F.col("least").alias("component_id"))
    else:
        member = components(found.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")))
        linked = nodes.join(member, nodes["fp"] == member["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
        linked = stage(linked, "fingerprint_components")
        least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
        classes = linked.join(least, "component").select("fp", "component_id")
    return own.join(classes, "fp").select(
        id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Null ids without a component stay."""
    gone = near_duplicates(docs, shingle, bits).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
