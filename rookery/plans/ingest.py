"""Landing the archives of all followed players in one job, with an audit row per player."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import schema
from rookery.operators import merge
from rookery.session import stage
from rookery.sources import landing, sinks


def _empty_landing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schema.RAW_GAMES)


def candidates(archive: DataFrame, marks: DataFrame) -> DataFrame:
    """Archive games from each player's high-water month on; unknown players are taken whole."""
    since = landing.month_number(F.col("max_end_time"))
    keyed = archive.withColumn("player", F.lower("loaded_by_user"))
    return (
        keyed.join(marks.select("player", since.alias("_since")), "player", "left")
        .filter(F.col("_since").isNull() | (F.col("year") * 100 + F.col("month") >= F.col("_since")))
        .drop("_since", "year", "month")
    )


def landed_pairs(raw: DataFrame, since_end_time: int | None = None) -> DataFrame:
    """Distinct (game, player) pairs already landed, from a given game end on."""
    scan = raw if since_end_time is None else raw.filter(F.col("end_time") >= since_end_time)
    players = F.explode(F.array(F.lower("white_username"), F.lower("black_username")))
    return scan.select("uuid", players.alias("player")).distinct()


def first_loader(batch: DataFrame) -> DataFrame:
    """Of a game that several players bring along, the rows of the first player by name.

    Only the (game, player) pairs that lose are gathered; the rows themselves are passed through an
    anti join, which the adaptive planner splits where one game has very many copies.
    """
    pairs = batch.select("uuid", "player").distinct()
    shared = pairs.groupBy("uuid").agg(F.min("player").alias("_first"), F.max("player").alias("_last"))
    shared = shared.filter(F.col("_first") != F.col("_last"))
    losers = pairs.join(shared, "uuid").filter(F.col("player") != F.col("_first")).select("uuid", "player")
    return batch.join(losers, ["uuid", "player"], "left_anti")


def new_games_anti(batch: DataFrame, raw: DataFrame) -> DataFrame:
    """Batch rows whose game is not landed yet for the player who brings it.

    Only landed games that end no earlier than the batch's first are looked at; that bound is one
    number, read once, so that it reaches the scan.
    """
    first_end = batch.agg(F.min("end_time")).head()[0]
    if first_end is None and batch.isEmpty():
        return batch
    return batch.join(landed_pairs(raw, first_end), ["uuid", "player"], "left_anti")


def run_rows(
    fetched: DataFrame, uploaded: DataFrame, tracked: DataFrame, duration: float, triggered_by: str, dry_run: bool,
    run_at: Column, broken: DataFrame | None = None,
) -> DataFrame:
    """One summary row per followed player; one with a month document that cannot be read has failed, whatever else came in."""
    ran = "dry_run" if dry_run else "success"
    unread = tracked.select(F.lower("username").alias("player"), F.lit(0).cast("bigint").alias("n_broken")).distinct()
    if broken is not None:
        counts = broken.groupBy(F.lower("loaded_by_user").alias("player")).agg(F.count("*").alias("n_broken"))
        unread = unread.drop("n_broken").join(counts, "player", "left")
    per_player = (
        tracked.select(F.col("username"), F.lower("username").alias("player"))
        .join(fetched, "player", "left")
        .join(uploaded, "player", "left")
        .join(unread, "player", "left")
    )
    failed = F.coalesce("n_broken", F.lit(0)) > 0
    return per_player.select(
        run_at.alias("run_at"),
        "username",
        F.when(failed, "failed").when(F.coalesce("n_fetched", F.lit(0)) == 0, "skipped").otherwise(ran).alias("status"),
        F.coalesce("n_fetched", F.lit(0)).alias("games_fetched"),
        F.coalesce("n_uploaded", F.lit(0)).alias("games_uploaded"),
        F.lit(float(duration)).alias("duration_seconds"),
        F.when(failed, F.concat(F.col("n_broken").cast("string"), F.lit(" month documents cannot be read"))).alias("error_message"),
        F.lit(triggered_by).alias("triggered_by"),
    )


def ingest(
    spark: SparkSession,
    archive: DataFrame,
    tracked: DataFrame,
    landing_path: str,
    log_path: str,
    triggered_by: str = "local",
    dry_run: bool = False,
    uploaded_at: Column | None = None,
    broken: DataFrame | None = None,
) -> DataFrame:
    """High-water marks, month prune, anti join, append, audit; returns the audit rows.

    ``archive`` has ``game``, ``loaded_by_user``, ``year`` and ``month``; ``broken`` has the documents of
    ``broken_documents``. A dry run appends and logs nothing.
    """
    started = time.time()
    raw = landing.scan_raw_games(spark, landing_path) if merge.table_exists(spark, landing_path) else _empty_landing(spark)
    followed = archive.join(
        tracked.select(F.lower("username").alias("_name")).distinct(),
        F.lower("loaded_by_user") == F.col("_name"),
        "left_semi",
    )
    fetched_games = candidates(followed, landing.high_water_marks(raw))
    fetched = stage(landing.flatten_games(fetched_games, keep=["player", "loaded_by_user"]), "fetched")
    fetched_counts = fetched.groupBy("player").agg(F.count("*").alias("n_fetched"))
    if dry_run:
        uploaded_counts = fetched_counts.select("player", F.lit(0).cast("bigint").alias("n_uploaded"))
    else:
        valid = first_loader(fetched.filter(F.col("uuid").isNotNull()))
        fresh = landing.with_load_metadata(new_games_anti(valid, raw), F.col("loaded_by_user"), uploaded_at)
        staged = stage(fresh, "fresh")
        landing.append_raw_games(staged.drop("player"), landing_path)
        uploaded_counts = staged.groupBy("player").agg(F.count("*").alias("n_uploaded"))
    runs = run_rows(
        fetched_counts, uploaded_counts, tracked, time.time() - started, triggered_by, dry_run,
        F.current_timestamp() if uploaded_at is None else uploaded_at, broken,
    )
    logged = stage(sinks.run_log_rows(runs), "runs")
    if not dry_run:
        logged.write.mode("append").parquet(log_path)
    return logged
