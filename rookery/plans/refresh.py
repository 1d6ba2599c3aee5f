"""Incremental refresh of the facts and of the player history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.functions.calendar import month_start
from rookery.operators import merge
from rookery.plans import warehouse
from rookery.session import stage
from rookery.sources.sinks import MONTH_COLUMN

# The columns a merge may change.
GAME_UPDATES = ["my_accuracy", "opp_accuracy", "outcome", "my_result", "opp_result"]
# When the values of a stored game were uploaded; ``loaded_at`` stays at the first upload.
VALUES_AT = "values_at"
MY_GAME_UPDATES = ["outcome", "my_result", "my_accuracy", "opp_accuracy"]
STATISTICS_UPDATES = [
    "games_played", "wins", "losses", "draws", "avg_accuracy", "avg_rating", "max_rating", "min_rating",
    "closing_rating", "total_games", "total_wins", "current_rating", "highest_rating_ever", "fact_updated_at",
]

# The player columns whose change opens a new version.
SNAPSHOT_CHECKS = ["current_rating", "peak_rating", "total_games", "win_rate", "blitz_games", "rapid_games", "bullet_games"]


def watermark(spark: SparkSession, path: str, column: str):
    """The largest value of a column of a stored table, NULL when the table is absent."""
    if not merge.table_exists(spark, path):
        return None
    return spark.read.parquet(path).agg(F.max(column)).head()[0]


def newer(df: DataFrame, column: str, mark) -> DataFrame:
    """Rows past a watermark; the mark is a literal and so reaches the scan."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def by_month(df: DataFrame, date_column: str) -> DataFrame:
    return df.withColumn(MONTH_COLUMN, month_start(F.col(date_column)))


def refresh_fct_games(spark: SparkSession, raw: DataFrame, path: str, users: DataFrame | None = None) -> None:
    """Merge the games uploaded since the last refresh.

    The watermark goes on the landed rows, before the dedupe: the latest upload of a game is past
    the mark exactly when it is the latest among the uploads past the mark.
    """
    fresh = newer(raw, "uploaded_at", watermark(spark, path, "loaded_at"))
    merge_games(spark, warehouse.int_player_games(fresh), path, users)


def merge_games(spark: SparkSession, player_games: DataFrame, path: str, users: DataFrame | None = None, staged: bool = False) -> None:
    """Of several uploads of a game the latest counts, in whatever order they arrive; ``staged`` as in ``merge_upsert``."""
    rows = by_month(warehouse.fct_games(player_games, users), "game_date").withColumn(VALUES_AT, F.col("loaded_at"))
    merge.merge_upsert(
        spark, path, rows, ["player_game_key"], [*GAME_UPDATES, VALUES_AT], MONTH_COLUMN, cluster_by=["my_username", "time_class"],
        newest=VALUES_AT, staged=staged,
    )


def refresh_my_games(spark: SparkSession, facts: DataFrame, path: str, username: str) -> None:
    fresh = newer(warehouse.my_games(facts, username), "loaded_at", watermark(spark, path, "loaded_at")).drop(VALUES_AT)
    rows = fresh if MONTH_COLUMN in fresh.columns else by_month(fresh, "game_date")
    merge.merge_upsert(spark, path, rows, ["player_game_key"], MY_GAME_UPDATES, MONTH_COLUMN, cluster_by=["time_class", "game_date"])


# -- running totals ------------------------------------------------------------------------


def _carried(stored: DataFrame) -> DataFrame:
    """Totals of the last stored day of each player and class."""
    last = F.max_by(F.struct("total_games", "total_wins", "highest_rating_ever"), "stat_date")
    return stored.groupBy("username", "time_class").agg(last.alias("_carry"))


def _carry_on(daily: DataFrame, carried: DataFrame) -> DataFrame:
    """Running totals that go on from the stored ones."""
    carry = F.col("_carry")
    return (
        warehouse.cumulative_user_stats(daily)
        .join(carried, ["username", "time_class"], "left")
        .withColumns(
            {
                "total_games": F.col("total_games") + F.coalesce(carry["total_games"], F.lit(0)),
                "total_wins": F.col("total_wins") + F.coalesce(carry["total_wins"], F.lit(0)),
                "highest_rating_ever": F.greatest("highest_rating_ever", carry["highest_rating_ever"]),
            }
        )
        .drop("_carry")
    )


def since_day(df: DataFrame, day, column: str = "game_date") -> DataFrame:
    """Rows from a day on; the day is a literal, on the month column too where there is one, and so prunes folders."""
    if day is None:
        return df
    kept = df.filter(F.col(column) >= F.lit(day))
    return kept.filter(F.col(MONTH_COLUMN) >= F.lit(day.replace(day=1))) if MONTH_COLUMN in df.columns else kept


def new_days(player_games: DataFrame, stored: DataFrame, mark) -> DataFrame:
    """Statistics rows of the days after the last stored day of the whole table."""
    daily = warehouse.daily_user_stats(newer(since_day(player_games, mark), "game_date", mark))
    return warehouse.user_statistics_rows(_carry_on(daily, _carried(stored)))


def repaired_days(player_games: DataFrame, stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Statistics rows of every touched player and class from the first touched day on.

    ``changed`` holds the games that are new or uploaded again, on whatever day they were played.
    """
    touched = changed.groupBy(F.col("my_username").alias("username"), "time_class").agg(F.min("game_date").alias("_from"))
    touched = stage(touched, "touched")
    key = ["username", "time_class"]
    again = (
        since_day(player_games, touched.agg(F.min("_from")).head()[0]).withColumnRenamed("my_username", "username")
        .join(touched, key)
        .filter(F.col("game_date") >= F.col("_from"))
        .withColumnRenamed("username", "my_username")
    )
    before = stored.join(touched, key).filter(F.col("stat_date") < F.col("_from"))
    return warehouse.user_statistics_rows(_carry_on(warehouse.daily_user_stats(again), _carried(before)))


def refresh_user_statistics(
    spark: SparkSession, player_games: DataFrame, path: str, mode: str = "repair", changed: DataFrame | None = None
) -> None:
    """Merge statistics rows.

    ``strict`` takes only days after the last stored day, so late games are passed over.
    ``repair`` recomputes what the changed games touch and ends up equal to a full rebuild.
    """
    if not merge.table_exists(spark, path):
        rows = warehouse.fct_user_statistics(player_games)
    else:
        stored = spark.read.parquet(path)
        if mode == "strict":
            rows = new_days(player_games, stored, watermark(spark, path, "stat_date"))
        elif mode == "repair" and changed is not None:
            rows = repaired_days(player_games, stored, changed)
        else:
            raise ValueError("use mode 'strict', or 'repair' with the changed games")
    merge.merge_upsert(
        spark, path, by_month(rows, "stat_date"), ["stat_key"], STATISTICS_UPDATES, MONTH_COLUMN,
        cluster_by=["username", "time_class"],
    )


# -- history -------------------------------------------------------------------------------


def refresh_snapshot(spark: SparkSession, users: DataFrame, path: str, now: Column | None = None) -> None:
    """Bring the version history of the players up to date; run it after the dimension is rebuilt."""
    at = F.current_timestamp() if now is None else now
    if not merge.table_exists(spark, path):
        merge.first_snapshot(users, at).write.mode("overwrite").parquet(path)
        return
    history = spark.read.parquet(path)
    state = merge.snapshot_check(history, users, "user_key", SNAPSHOT_CHECKS, at)
    stage(state, "snapshot").write.mode("overwrite").parquet(path)


def snapshot_current(history: DataFrame) -> DataFrame:
    return history.filter(F.col("valid_to").isNull())


