"""Files that arrive in the landing folder, merged into the facts as they come.

The cadence is a daily batch. ``availableNow`` gives exactly that: each run takes every
file not seen before, in bounded batches, and stops. The stream's checkpoint remembers the files;
a batch that is replayed after a failure merges to the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery import schema
from rookery.operators import merge
from rookery.plans import refresh, warehouse
from rookery.session import stage


def landing_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.RAW_GAMES)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def refresh_batch(spark: SparkSession, batch: DataFrame, games_path: str, statistics_path: str) -> None:
    """Merge one batch of landed rows into the games, then repair the statistics they touch."""
    changed = stage(warehouse.int_player_games(batch), "changed")
    refresh.merge_games(spark, changed, games_path, staged=True)
    games = spark.read.parquet(games_path)
    refresh.refresh_user_statistics(spark, games, statistics_path, "repair", changed)


def run_available(
    spark: SparkSession,
    landing_path: str,
    games_path: str,
    statistics_path: str,
    checkpoint_path: str,
    files_per_batch: int | None = None,
) -> None:
    """Process what has landed since the last run, then stop."""

    def on_batch(batch: DataFrame, _batch_id: int) -> None:
        if not batch.isEmpty():
            refresh_batch(batch.sparkSession, batch, games_path, statistics_path)

    query = (
        landing_stream(spark, landing_path, files_per_batch)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_event_counts(spark: SparkSession, events_path: str, counts_path: str, checkpoint_path: str) -> None:
    """Daily counts per user and event type kept up to date from an event folder.

    Each batch adds its own counts to the stored ones of the days it touches; the batch number
    kept with every row makes a replayed batch add nothing.
    """
    from pyspark.sql import functions as F

    source = spark.read.parquet(events_path).schema

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        key = ["user_id", "day", "event_type"]
        counted = batch.groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
        if merge.table_exists(spark, counts_path):
            stored = spark.read.parquet(counts_path)
            seen = stored.filter(F.col("batch_id") == batch_id).select(*key)
            prior = stored.select(*key, F.col("n").alias("_before"))
            counted = (
                counted.join(seen, key, "left_anti")
                .join(prior, key, "left")
                .withColumn("n", F.col("n") + F.coalesce("_before", F.lit(0)))
                .drop("_before")
            )
        merge.merge_upsert(
            spark, counts_path, counted.withColumn("batch_id", F.lit(batch_id)), key, ["n", "batch_id"], "day"
        )

    query = (
        spark.readStream.schema(source)
        .parquet(events_path)
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
