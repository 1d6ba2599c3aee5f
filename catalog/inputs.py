"""Frames that the queries start from, and the last step of every query.

The functions remember the plan they built for a session and folder; no rows are kept.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.functions.calendar import utc_date, utc_wall_clock
from rookery.plans import parsed_games, warehouse
from rookery.sources import order_archive

OWNER = "Player7"
# Players of the seed who load their own games.
SEEDED = tuple(f"Player{i}" for i in range(10))
TODAY = "2025-02-01"
BATCH_SPLIT = 1735690100


@cache
def raw(spark: SparkSession, folder: str) -> DataFrame:
    return order_archive.raw_games(spark, folder)


@cache
def staged(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.staged_games(raw(spark, folder))


@cache
def player_games(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.int_player_games(raw(spark, folder))


@cache
def facts(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.fct_games(player_games(spark, folder))


@cache
def users(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.dim_users(staged(spark, folder), player_games(spark, folder))


@cache
def user_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return warehouse.fct_user_statistics(player_games(spark, folder))


@cache
def parsed(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_games.parse_games(raw(spark, folder))


@cache
def clean(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_games.clean_games(parsed(spark, folder))


@cache
def analysis(spark: SparkSession, folder: str) -> DataFrame:
    return parsed_games.analysis_games(clean(spark, folder))


@cache
def tracked(spark: SparkSession, folder: str) -> DataFrame:
    """Followed players in capitals, with the day of their first load, plus names that never play."""
    loaders = (
        raw(spark, folder)
        .filter(F.col("loaded_by_user").isin(*SEEDED))
        .groupBy(F.upper("loaded_by_user").alias("username"))
        .agg(utc_date(F.unix_seconds(F.min("uploaded_at"))).alias("added_at"))
        .withColumn("notes", F.lit("loads own games"))
    )
    absent = spark.read.parquet(f"{folder}/region.parquet").select(
        F.col("r_name").alias("username"), F.lit(TODAY).cast("date").alias("added_at"), F.lit("no games yet").alias("notes")
    )
    return loaders.unionByName(absent)


def edge(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock times, so that engines compare alike."""
    return df.select(
        *[utc_wall_clock(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
          for f in df.schema]
    )


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return edge(df.withColumns({c: F.round(c, places) for c in columns}))
