"""Runs of equal values along an order, without one task per key.

A key may hold a large part of all rows, so its rows are cut into hourly chunks. Runs are found
inside each chunk; only the first and last run of a chunk can go on in a neighbour, and only those
are put in one window per key. That window sees a few rows per hour, not per game.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of one chunk. A player's games of one hour fit a task many times over; a source with
# denser keys passes a shorter chunk.
CHUNK_SECONDS = 3600

_CHUNK, _RUN = "_chunk", "_run"


def _chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000))


def _local_runs(rows: DataFrame, keys: list[str], value: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Rows with the run number inside their chunk."""
    inside = Window.partitionBy(*keys, _CHUNK).orderBy(ts, tie)
    changed = F.when(F.col(value) != F.lag(value).over(inside), 1).otherwise(0)
    return (
        rows.withColumn(_CHUNK, _chunk(ts, seconds))
        .withColumn("_changed", changed)
        .withColumn(_RUN, F.sum("_changed").over(inside))
    )


def number_streaks(
    rows: DataFrame, keys: list[str], value: str, ts: str, tie: str, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Every row with ``outcome_changed`` (0 or 1) and the running number ``streak_group``.

    Equal to LAG and a running SUM over the whole key. Chunk heads carry what the chunks before
    them add up to.
    """
    local = _local_runs(rows, keys, value, ts, tie, chunk_seconds)
    spot = F.struct(ts, tie)
    heads = local.groupBy(*keys, _CHUNK).agg(
        F.min_by(value, spot).alias("_first"),
        F.max_by(value, spot).alias("_last"),
        F.max(_RUN).alias("_changes"),
        F.min(spot).alias("_head"),
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    joins = F.when(F.col("_first") != F.lag("_last").over(along), 1).otherwise(0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        heads.withColumn("_joint", joins)
        .withColumn("_offset", F.coalesce(F.sum(F.col("_changes") + F.col("_joint")).over(before), F.lit(0)))
        .select(*keys, _CHUNK, "_joint", (F.col("_offset") + F.col("_joint")).alias("_offset"), "_head")
    )
    is_head = spot == F.col("_head")
    # NULL keys are keys like any other, as in a window
    named = heads.select(*[F.col(c).alias(f"_of_{c}") for c in [*keys, _CHUNK]], "_joint", "_offset", "_head")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, _CHUNK]])
    return (
        local.join(named, same)
        .withColumn("outcome_changed", F.when(is_head, F.col("_joint")).otherwise(F.col("_changed")))
        .withColumn("streak_group", F.col("_offset") + F.col(_RUN))
        .drop(_CHUNK, "_changed", _RUN, "_joint", "_offset", "_head", *named.columns[: len(keys) + 1])
    )


def streak_lengths(numbered: DataFrame, keys: list[str], value: str, date: str) -> DataFrame:
    return numbered.groupBy(*keys, value, "streak_group").agg(
        F.count("*").alias("streak_length"),
        F.min(date).alias("streak_start"),
        F.max(date).alias("streak_end"),
    )


def streak_extremes(
    rows: DataFrame, keys: list[str], value: str, ts: str, tie: str, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Longest win and loss run and the run that is still open, per key, in one pass over the rows.

    Chunks reduce to their edge runs and to the longest run between them before anything is
    gathered per key.
    """
    narrow = rows.select(*keys, value, ts, tie)
    runs = (
        _local_runs(narrow, keys, value, ts, tie, chunk_seconds)
        .groupBy(*keys, _CHUNK, _RUN, value)
        .agg(F.count("*").alias("_len"))
    )
    # Of each chunk: the first and last run, and the longest win and loss run between them.
    first = F.min(F.struct(_RUN, value, "_len"))
    last = F.max(F.struct(_RUN, value, "_len"))
    ends = Window.partitionBy(*keys, _CHUNK)
    inner = (F.col(_RUN) > 0) & (F.col(_RUN) < F.col("_last_run"))
    chunks = (
        runs.withColumn("_last_run", F.max(_RUN).over(ends))
        .groupBy(*keys, _CHUNK)
        .agg(
            first.alias("_first"),
            last.alias("_last"),
            F.max(F.when(inner & (F.col(value) == "win"), F.col("_len"))).alias("_inner_win"),
            F.max(F.when(inner & (F.col(value) == "lose"), F.col("_len"))).alias("_inner_lose"),
        )
    )
    edge = F.when(F.col("_first")[_RUN] == F.col("_last")[_RUN], F.array("_first")).otherwise(F.array("_first", "_last"))
    along = Window.partitionBy(*keys).orderBy(_CHUNK, "_at")
    edges = (
        chunks.select(*keys, _CHUNK, "_inner_win", "_inner_lose", F.posexplode(edge).alias("_at", "_edge"))
        .select(*keys, _CHUNK, "_at", "_inner_win", "_inner_lose",
                F.col("_edge")[value].alias(value), F.col("_edge")["_len"].alias("_len"))
        .withColumn("_changed", F.when(F.col(value) != F.lag(value).over(along), 1).otherwise(0))
        # Two edges of one chunk are neighbours only when no run lies between them; the second
        # starts a run of its own in any case, because equal neighbours were one run already
        # or are parted by another value.
        .withColumn("_changed", F.when(F.col("_at") == 1, 1).otherwise(F.col("_changed")))
        .withColumn("streak_group", F.sum("_changed").over(along))
    )
    stitched = edges.groupBy(*keys, "streak_group", value).agg(
        F.sum("_len").alias("_len"),
        F.max("_inner_win").alias("_inner_win"),
        F.max("_inner_lose").alias("_inner_lose"),
    )

    def longest(outcome: str, inner_column: str) -> Column:
        return F.greatest(F.max(F.when(F.col(value) == outcome, F.col("_len"))), F.max(inner_column))

    return stitched.groupBy(*keys).agg(
        longest("win", "_inner_win").alias("longest_win_streak"),
        longest("lose", "_inner_lose").alias("longest_loss_streak"),
        F.max_by(value, "streak_group").alias("current_streak_outcome"),
        F.max_by("_len", "streak_group").alias("current_streak_length"),
    )
