"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly, equal texts stay together.

Only sizes and digests leave the text scan. Groups of equal texts that hold a noticeable share of any measure are
placed one by one (there can be only so many of them); the many light groups are dealt by digest into a fixed
number of bundles, and bundles are placed like groups. So the driver places at most
``bundles + 3 / heavy_share`` vectors, whatever the input, and no group is split unless it alone holds more than
``split_share`` of a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.common import SPACES
from rookery.session import stage

SHARDS = 8
MEASURES = ("bytes", "tokens", "rows")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, tokens, crc, digest) per row. A null text has size 1, no tokens, checksum 0, and groups with other nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.when(F.col(text_col).isNotNull(), F.md5(F.col(text_col).cast("binary"))).otherwise(F.lit("null"))
    return docs.select(
        F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(F.concat(F.lit(" "), text), F.lit(rf"{SPACES}(?=[^\x20\x09-\x0D])")).cast("long").alias("tokens"),
        F.crc32(text).cast("long").alias("text_crc32"), digest.alias("digest"),
    )


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector: largest first, each where its dot product with the residual capacity is highest.

    Measures are scaled to the capacity of one shard; ties go to the lower shard.
    """
    capacity = demand.sum(axis=0) / shards
    scaled = demand / np.where(capacity > 0, capacity, 1)
    residual = np.ones((shards, demand.shape[1]))
    placed = np.zeros(len(demand), dtype=np.int64)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        placed[i] = np.argmax(residual @ scaled[i])
        residual[placed[i]] -= scaled[i]
    return placed


def shard(
    docs: DataFrame, shards: int = SHARDS, bundles: int = 4096, heavy_share: float = 1 / 4096, split_share: float = 1 / 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, size, tokens, text_crc32, shard, slot): every row in one shard, slots gapless from 0 inside each.

    A group over ``split_share`` of a shard in any measure is cut into pieces by row, measured before they are placed. Null and empty texts are
    groups of size-1 rows; repeated rows each get a slot; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = stage(measure(docs, id_col, text_col), "shard_sizes")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*[F.coalesce(c, F.lit(0)).alias(m) for c, m in zip(sums, MEASURES)]).first()
    groups = stage(rows.groupBy("digest").agg(*sums), "shard_groups")
    is_heavy = F.greatest(*[F.col(m) / F.lit(float(max(1, total[m]))) for m in MEASURES]) > heavy_share
    heavy = groups.where(is_heavy).orderBy("digest").collect()  # at most 3 / heavy_share
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")
    light = groups.where(~is_heavy).groupBy(bundle.alias("bundle")).agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("bundle").collect()
    capacity = [max(1, total[m]) / shards for m in MEASURES]
    cuts = []
    for g in heavy:
        share = max(g[m] / c for m, c in zip(MEASURES, capacity))
        cuts.append((g["digest"], min(g["rows"], max(1, int(np.ceil(share / split_share))))))
    by_cut = spark.createDataFrame(cuts, "digest string, cut int")
    piece = F.pmod(F.xxhash64(F.col(id_col), F.lit("piece")), F.col("cut")).cast("int")
    parts = rows.join(F.broadcast(by_cut), "digest").groupBy("digest", "cut", piece.alias("piece")).agg(*sums).orderBy("digest", "piece").collect()
    pieces = [("digest", g["digest"], g["piece"], g["cut"]) for g in parts] + [("bundle", str(g["bundle"]), 0, 1) for g in light]
    vectors = [[g[m] for m in MEASURES] for g in [*parts, *light]]
    placed = pack(np.array(vectors, dtype=float).reshape(-1, 3), shards)
    places: dict[str, dict] = {"digest": {}, "bundle": {}}
    for (kind, name, number, cut), s in zip(pieces, placed):
        places[kind].setdefault(name, [0] * cut)[number] = int(s)
    schema = "name string, places array<int>"
    by_digest = spark.createDataFrame(list(places["digest"].items()), schema)
    by_bundle = spark.createDataFrame(list(places["bundle"].items()), schema).select(F.col("name").cast("int").alias("bundle"), F.col("places").alias("b_places"))
    # both tables are bounded by the parameters, so they may be broadcast
    dealt = rows.withColumn("bundle", bundle).join(F.broadcast(by_digest), F.col("digest") == F.col("name"), "left")
    dealt = dealt.join(F.broadcast(by_bundle), "bundle", "left").withColumn("p", F.coalesce("places", "b_places"))
    piece = F.pmod(F.xxhash64(F.col(id_col), F.lit("piece")), F.size("p")).cast("int")
    return slots(dealt.withColumn("shard", F.get("p", piece)).select(id_col, "size", "tokens", "text_crc32", "shard"), id_col)


def slots(rows: DataFrame, id_col: str, per_bucket: int = 20_000) -> DataFrame:
    """``slot``: gapless numbers from 0 inside each ``shard``, without gathering a shard in one task.

    Rows fall into hashed buckets, one more for every ``per_bucket`` rows; a row's slot is its place in the bucket
    after all rows of the shard's earlier buckets.
    """
    rows = stage(rows, "shard_rows")
    buckets = max(64, rows.count() // per_bucket)
    own = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(id_col), F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = own.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(F.col(id_col).asc_nulls_first(), "text_crc32", "size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_bucket", before.alias("_start"))
    return own.withColumn("_place", within).join(starts, ["shard", "_bucket"]).select(
        *rows.columns, (F.col("_start") + F.col("_place") - 1).cast("long").alias("slot")
    )
