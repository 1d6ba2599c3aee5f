"""Row selection and reshaping: latest version, perspectives, top-k, fixed-category counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_not_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key.

    Spark cuts each task's rows to ``k`` per key before the shuffle, so a key that holds a large
    part of the table costs the shuffle at most ``k`` rows per task.
    """
    position = rank or "_position"
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(position) <= k)
    return kept if rank else kept.drop(position)


def latest_version(raw: DataFrame, key: str = "uuid") -> DataFrame:
    """One row per key: the last upload, then the larger uploader name, then the later end."""
    order = [F.desc("uploaded_at"), F.desc("loaded_by_user"), F.desc("end_time")]
    return top_per_key(raw, [key], order, 1)


def both_colors(games: DataFrame) -> DataFrame:
    """Two rows per game, marked by ``my_color``: one for White, one for Black.

    Only the colour is exploded, so a later column picked with ``mine`` or ``theirs`` is an
    ordinary projection that the scan can prune.
    """
    return games.withColumn("my_color", F.explode(F.array(F.lit("white"), F.lit("black"))))


def mine(column: str) -> Column:
    return F.when(F.col("my_color") == "white", F.col(f"white_{column}")).otherwise(F.col(f"black_{column}"))


def theirs(column: str) -> Column:
    return F.when(F.col("my_color") == "white", F.col(f"black_{column}")).otherwise(F.col(f"white_{column}"))


def value_counts(df: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    return df.groupBy(*keys, value).agg(F.count("*").alias(count))


def pivot_counts(df: DataFrame, keys: list[str], column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of fixed values side by side; a value that never occurs counts 0."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def unfold(df: DataFrame, keys: list[str], names: list[str], rows: list[tuple], types: list[str]) -> DataFrame:
    """Turn one wide row per key into fixed rows; every listed row appears for every key."""
    structs = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast(t).alias(n) for n, v, t in zip(names, row, types)])
        for row in rows
    ]
    return df.select(*keys, F.inline(F.array(*structs)))
