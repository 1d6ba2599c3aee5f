"""Declared data tests: column tests in one pass per model, and whole-table assertions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.operators import joins

# Words accepted by the declared tests.
ACCEPTED_CLASSES = ("blitz", "rapid", "bullet", "daily", "correspondence")
ACCEPTED_COLORS = ("white", "black")
ACCEPTED_OUTCOMES = ("win", "draw", "lose")


@dataclass(frozen=True)
class ModelTests:
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    accepted: dict[str, tuple[str, ...]] = field(default_factory=dict)


MODEL_TESTS = {
    "raw_games": ModelTests(not_null=("uuid", "uploaded_at")),
    "stg_raw_games": ModelTests(
        not_null=("game_id", "game_end_timestamp", "game_date", "game_year", "time_class",
                  "white_username", "black_username", "uploaded_at"),
        unique=("game_id",),
        accepted={"time_class": ACCEPTED_CLASSES},
    ),
    "int_player_games": ModelTests(
        not_null=("player_game_key", "game_id", "game_date", "my_username", "my_color", "outcome", "username_year"),
        unique=("player_game_key",),
        accepted={"my_color": ACCEPTED_COLORS, "outcome": ACCEPTED_OUTCOMES},
    ),
    "fct_my_games": ModelTests(not_null=("player_game_key",), unique=("player_game_key",)),
    "my_daily_stats": ModelTests(not_null=("game_date", "time_class")),
    "dim_users": ModelTests(not_null=("user_key", "username"), unique=("user_key", "username")),
    "fct_games": ModelTests(
        not_null=("player_game_key", "game_id", "my_username", "game_date", "outcome", "username_year"),
        unique=("player_game_key",),
        accepted={"my_color": ACCEPTED_COLORS, "outcome": ACCEPTED_OUTCOMES},
    ),
    "fct_user_statistics": ModelTests(
        not_null=("stat_key", "username", "stat_date", "time_class", "games_played"),
        unique=("stat_key",),
        accepted={"time_class": ACCEPTED_CLASSES},
    ),
}


def _counts_as_rows(df: DataFrame, counts: dict[str, Column], label: str, value: str) -> DataFrame:
    """One aggregate pass, folded out to a row per count."""
    wide = df.agg(*[c.alias(n) for n, c in counts.items()])
    pairs = [F.struct(F.lit(n).alias(label), F.col(f"`{n}`").cast("bigint").alias(value)) for n in counts]
    return wide.select(F.inline(F.array(*pairs)))


def null_profile(df: DataFrame) -> DataFrame:
    """NULLs of every column, in one pass."""
    return _counts_as_rows(df, {c: F.count_if(F.col(c).isNull()) for c in df.columns}, "column_name", "nulls")


def not_null(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return _counts_as_rows(df, {c: F.count_if(F.col(c).isNull()) for c in columns}, "column_name", "failures")


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
    )


def accepted_values(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Values outside the list, with their number of rows."""
    return (
        df.filter(~F.col(column).isin(*values))
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def model_report(name: str, df: DataFrame) -> DataFrame:
    """Failures of every declared test of one model: the NULL and value tests in one pass, one grouping per unique key."""
    tests = MODEL_TESTS[name]
    counts = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in tests.not_null}
    counts |= {f"accepted_values:{c}": F.count_if(~F.col(c).isin(*v)) for c, v in tests.accepted.items()}
    report = _counts_as_rows(df, counts, "test", "failures")
    for c in tests.unique:
        repeated = unique(df, c).agg(F.count("*").alias("failures")).select(F.lit(f"unique:{c}").alias("test"), "failures")
        report = report.unionByName(repeated)
    return report.select(F.lit(name).alias("model"), "test", "failures")


def no_future_games(staged: DataFrame, today: Column | None = None) -> DataFrame:
    day = F.current_date() if today is None else today
    return staged.filter(F.col("game_date") > day).select(
        "game_id", "game_date", "game_end_timestamp", "white_username", "black_username"
    )


def outcomes_sum_to_total(user_statistics: DataFrame) -> DataFrame:
    total = F.col("wins") + F.col("losses") + F.col("draws")
    return user_statistics.withColumn("wld_sum", total).filter(F.col("wld_sum") != F.col("games_played")).select(
        "username", "stat_date", "time_class", "games_played", "wins", "losses", "draws", "wld_sum"
    )


def tracked_users_present(tracked: DataFrame, facts: DataFrame) -> DataFrame:
    """Followed players without a game; a warning, since a new player has none before the first load."""
    return joins.unmatched(
        tracked, facts, {"_name": F.lower("username")}, {"_name": F.lower("my_username")}
    ).select("username")


def assertion_report(staged: DataFrame, user_statistics: DataFrame, tracked: DataFrame, facts: DataFrame) -> DataFrame:
    """Number of offending rows of the three whole-table assertions, with their severity."""
    checks = {
        ("no_future_games", "error"): no_future_games(staged),
        ("outcomes_sum_to_total", "error"): outcomes_sum_to_total(user_statistics),
        ("tracked_users_present", "warn"): tracked_users_present(tracked, facts),
    }
    report = None
    for (name, severity), offending in checks.items():
        line = offending.agg(F.count("*").alias("failures")).select(
            F.lit(name).alias("test"), F.lit(severity).alias("severity"), "failures"
        )
        report = line if report is None else report.unionByName(line)
    return report


