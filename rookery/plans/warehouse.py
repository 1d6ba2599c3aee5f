"""From landed rows to player games, dimensions, facts and reports, for all players at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions import calendar as cal
from rookery.functions import openings, scoring
from rookery.operators import joins, rows, streaks

REQUIRED = ["uuid", "end_time", "white_username", "black_username"]

# The classes with ratings of their own in reports.
RATED_CLASSES = ("blitz", "rapid", "bullet")
CLASSES = ("blitz", "rapid", "bullet", "daily")

_TIME = ["game_end_timestamp", "game_date", "game_year", "game_month", "game_day", "game_hour",
         "game_day_of_week", "game_weekday_name"]
_STAGED_SIDES = ["username", "rating", "result", "uuid", "accuracy"]
_SIDES = ["username", "rating", "result", "accuracy"]

# Output columns in their order.
PLAYER_GAME_COLUMNS = [
    "player_game_key", "game_id", "game_url", *_TIME,
    "time_class", "raw_time_control", "rules", "rated",
    "my_username", "my_color", "my_rating", "my_result", "my_accuracy", "my_opening", "eco",
    "opp_username", "opp_rating", "opp_result", "opp_accuracy",
    "outcome", "rating_diff", "username_year", "uploaded_at", "loaded_by_user",
]

# Output columns in their order.
FACT_COLUMNS = [
    "player_game_key", "game_id", "game_url", "user_key", "my_username", *_TIME,
    "time_class", "raw_time_control", "rules", "rated",
    "my_color", "my_rating", "my_result", "my_accuracy", "my_opening", "eco",
    "opp_username", "opp_rating", "opp_result", "opp_accuracy",
    "outcome", "rating_diff", "username_year", "loaded_at", "fact_updated_at",
]


# -- staging -------------------------------------------------------------------------------


def null_key_filter(raw: DataFrame) -> DataFrame:
    return raw.filter(rows.all_not_null(REQUIRED))


def deduped(raw: DataFrame) -> DataFrame:
    """Valid rows, the latest upload of each game."""
    return rows.latest_version(null_key_filter(raw))


def _staged(latest: DataFrame, extra: list[str]) -> DataFrame:
    names = {"uuid": "game_id", "url": "game_url", "time_control": "raw_time_control", "fen": "final_fen"}
    time = [c.alias(n) for n, c in cal.calendar_fields(F.col("end_time")).items()]

    def renamed(*columns: str) -> list[Column]:
        return [F.col(c).alias(names.get(c, c)) for c in columns]

    return latest.select(
        *renamed("uuid", "url", "tcn"),
        *time,
        *renamed("time_control", "time_class", "rules", "rated", "fen", "initial_setup", *extra),
        *renamed(*[f"{side}_{f}" for side in ("white", "black") for f in _STAGED_SIDES]),
        *renamed("uploaded_at", "loaded_by_user"),
    )


def stg_raw_games(raw: DataFrame) -> DataFrame:
    """One row per game, renamed and with calendar fields."""
    return _staged(deduped(raw), ["pgn"])


def staged_games(raw: DataFrame) -> DataFrame:
    """``stg_raw_games`` with the opening slug in place of the record text.

    The slug is taken before rows are shuffled for the dedupe, so record texts never travel.
    """
    slim = raw.withColumn("eco_slug", openings.opening_slug(F.col("pgn"))).drop("pgn")
    return _staged(deduped(slim), ["eco_slug"])


# -- player perspective --------------------------------------------------------------------


def player_games_unpivot(staged: DataFrame) -> DataFrame:
    """Two rows per game with ``my_`` and ``opp_`` columns."""
    kept = [c for c in staged.columns if not c.startswith(("white_", "black_"))]
    return rows.both_colors(staged).select(
        *kept,
        "my_color",
        *[rows.mine(f).alias(f"my_{f}") for f in _SIDES],
        *[rows.theirs(f).alias(f"opp_{f}") for f in _SIDES],
    )


def scored(player_rows: DataFrame) -> DataFrame:
    return player_rows.withColumns(
        {
            "outcome": scoring.outcome_class(F.col("my_result")),
            "rating_diff": F.col("my_rating") - F.col("opp_rating"),
        }
    )


def with_openings(player_rows: DataFrame) -> DataFrame:
    """Needs ``eco_slug``."""
    return player_rows.withColumns(
        {
            "eco_slug_raw": openings.slug_or_default(F.col("eco_slug")),
            "eco": openings.opening_family(F.col("eco_slug")),
        }
    ).withColumn("my_opening", openings.my_opening(F.col("eco"), F.col("my_color")))


def username_year(username: str = "my_username", year: str = "game_year") -> Column:
    return F.concat(F.col(username), F.lit("_"), F.col(year).cast("string"))


def int_player_games(raw: DataFrame) -> DataFrame:
    """One row per game and player, all derived columns, no record text."""
    perspective = player_games_unpivot(staged_games(raw)).filter(F.col("my_username").isNotNull())
    full = with_openings(scored(perspective)).withColumns(
        {
            "username_year": username_year(),
            "player_game_key": scoring.surrogate_key(F.col("game_id"), F.col("my_username")),
        }
    )
    return full.select(*PLAYER_GAME_COLUMNS)


# -- dimension -----------------------------------------------------------------------------


def all_usernames(staged: DataFrame) -> DataFrame:
    """Every name on either colour, in one scan."""
    return rows.both_colors(staged).select(rows.mine("username").alias("username")).distinct()


def _rating_by_time() -> Column:
    """The rating of the last game that has one."""
    return F.max_by("my_rating", F.when(F.col("my_rating").isNotNull(), F.col("game_end_timestamp")))


def user_lifetime_stats(player_games: DataFrame) -> DataFrame:
    """Per player: first and last day, active days, games by outcome, ratings, games by class.

    Rolled up from one row per player, day and class, so the count of distinct days needs no
    second pass over the games.
    """
    days = player_games.groupBy(F.col("my_username").alias("username"), "game_date", "time_class").agg(
        F.count("*").alias("games"),
        *[scoring.count_outcome(o).alias(o) for o in scoring.OUTCOMES],
        _rating_by_time().alias("closing"),
        F.max(F.when(F.col("my_rating").isNotNull(), F.col("game_end_timestamp"))).alias("closed_at"),
        F.max("my_rating").alias("peak"),
        F.min("my_rating").alias("low"),
    )

    def games_of(time_class: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("time_class") == time_class, F.col("games"))), F.lit(0))

    return days.groupBy("username").agg(
        F.max("game_date").alias("last_game_date"),
        F.min("game_date").alias("first_game_date"),
        F.count_distinct("game_date").alias("active_days"),
        F.sum("games").alias("total_games"),
        F.sum("win").alias("total_wins"),
        F.sum("lose").alias("total_losses"),
        F.sum("draw").alias("total_draws"),
        F.max_by("closing", "closed_at").alias("current_rating"),
        F.max("peak").alias("peak_rating"),
        F.min("low").alias("lowest_rating"),
        *[games_of(c).alias(f"{c}_games") for c in CLASSES],
    )


def time_class_counts_by_user(player_games: DataFrame) -> DataFrame:
    return player_games.groupBy(F.col("my_username").alias("username")).agg(
        *[F.count_if(F.col("time_class") == c).alias(f"{c}_games") for c in CLASSES]
    )


def with_defaults(stats: DataFrame) -> DataFrame:
    """NULL counts and ratings to 0, NULL days to the epoch."""
    days = ("last_game_date", "first_game_date")
    numbers = [c for c in stats.columns if c.endswith(("_rating", "_days", "_games", "_wins", "_losses", "_draws"))]
    return stats.withColumns(
        {
            **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers},
            **{c: F.coalesce(c, F.lit("1970-01-01").cast("date")) for c in days},
        }
    )


def dim_users(staged: DataFrame, player_games: DataFrame) -> DataFrame:
    """One row per player: every name joined to its lifetime statistics."""
    joined = all_usernames(staged).join(user_lifetime_stats(player_games), "username", "left")
    return with_defaults(joined).select(
        scoring.surrogate_key(F.col("username")).alias("user_key"),
        "username", "current_rating", "peak_rating", "lowest_rating", "last_game_date", "first_game_date",
        "active_days", "total_games", "total_wins", "total_losses", "total_draws",
        scoring.win_rate(F.col("total_wins"), F.col("total_games")).alias("win_rate"),
        *[f"{c}_games" for c in CLASSES],
        F.current_timestamp().alias("updated_at"),
    )


# -- facts ---------------------------------------------------------------------------------


def fct_games(player_games: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Player games with the player key.

    Without ``users`` the key is computed in place, which equals the lookup in a complete
    dimension; with ``users`` it is looked up and stays NULL for players the dimension lacks.
    """
    keyed = joins.with_user_key(player_games) if users is None else joins.join_users(player_games, users)
    return keyed.withColumnRenamed("uploaded_at", "loaded_at").withColumn(
        "fact_updated_at", F.current_timestamp()
    ).select(*FACT_COLUMNS)


def my_games(facts: DataFrame, username: str) -> DataFrame:
    return facts.filter(F.lower("my_username") == username.lower())


def daily_user_stats(player_games: DataFrame) -> DataFrame:
    return player_games.groupBy(
        F.col("my_username").alias("username"), F.col("game_date").alias("stat_date"), "time_class"
    ).agg(
        F.count("*").alias("games_played"),
        scoring.count_outcome("win").alias("wins"),
        scoring.count_outcome("lose").alias("losses"),
        scoring.count_outcome("draw").alias("draws"),
        scoring.exact_avg(F.col("my_accuracy")).alias("avg_accuracy"),
        F.avg("my_rating").alias("avg_rating"),
        F.max("my_rating").alias("max_rating"),
        F.min("my_rating").alias("min_rating"),
        _rating_by_time().alias("closing_rating"),
    )


def cumulative_user_stats(daily: DataFrame) -> DataFrame:
    """Running totals over days; a window sees one row per day, never games."""
    so_far = (
        Window.partitionBy("username", "time_class")
        .orderBy("stat_date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumns(
        {
            "total_games": F.sum("games_played").over(so_far),
            "total_wins": F.sum("wins").over(so_far),
            "current_rating": F.col("closing_rating"),
            "highest_rating_ever": F.max("max_rating").over(so_far),
        }
    )


# Output columns in their order.
USER_STATISTICS_COLUMNS = [
    "stat_key", "user_key", "username", "stat_date", "time_class", "games_played", "wins", "losses", "draws",
    "avg_accuracy", "avg_rating", "max_rating", "min_rating", "closing_rating",
    "total_games", "total_wins", "current_rating", "highest_rating_ever", "fact_updated_at",
]


def user_statistics_rows(cumulative: DataFrame, users: DataFrame | None = None) -> DataFrame:
    keyed = (
        joins.with_user_key(cumulative, "username")
        if users is None
        else joins.join_users(cumulative, users, "username")
    )
    return keyed.withColumns(
        {
            "stat_key": scoring.surrogate_key(F.col("username"), F.col("stat_date"), F.col("time_class")),
            "avg_accuracy": F.round("avg_accuracy", 2),
            "avg_rating": F.round("avg_rating", 1),
            "fact_updated_at": F.current_timestamp(),
        }
    ).select(*USER_STATISTICS_COLUMNS)


def fct_user_statistics(player_games: DataFrame, users: DataFrame | None = None) -> DataFrame:
    return user_statistics_rows(cumulative_user_stats(daily_user_stats(player_games)), users)


# -- daily summary -------------------------------------------------------------------------

_STREAM = ["my_username", "time_class"]


def my_daily(facts: DataFrame) -> DataFrame:
    return facts.groupBy("my_username", "game_date", "game_year", "game_month", "time_class").agg(
        F.count("*").alias("games_played"),
        scoring.count_outcome("win").alias("wins"),
        scoring.count_outcome("lose").alias("losses"),
        scoring.count_outcome("draw").alias("draws"),
        scoring.win_rate(scoring.count_outcome("win"), F.count("*")).alias("win_rate"),
        _rating_by_time().alias("closing_rating"),
        F.max("my_rating").alias("day_peak_rating"),
        F.min("my_rating").alias("day_low_rating"),
        scoring.exact_avg(F.col("my_accuracy")).alias("avg_accuracy"),
        F.max("game_end_timestamp").alias("last_game_at"),
    )


def cumulative_my_daily(daily: DataFrame) -> DataFrame:
    so_far = (
        Window.partitionBy(*_STREAM).orderBy("game_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return daily.withColumns(
        {
            "total_games": F.sum("games_played").over(so_far),
            "total_wins": F.sum("wins").over(so_far),
            "peak_rating_ever": F.max("day_peak_rating").over(so_far),
        }
    )


def class_streaks(facts: DataFrame) -> DataFrame:
    """Longest and current streaks per player and class."""
    return streaks.streak_extremes(facts, _STREAM, "outcome", "game_end_timestamp", "game_id")


def numbered_outcomes(facts: DataFrame) -> DataFrame:
    """Games with the change mark and the number of their streak."""
    narrow = facts.select(*_STREAM, "game_id", "game_date", "game_end_timestamp", "outcome")
    return streaks.number_streaks(narrow, _STREAM, "outcome", "game_end_timestamp", "game_id")


def streak_table(facts: DataFrame) -> DataFrame:
    return streaks.streak_lengths(numbered_outcomes(facts), _STREAM, "outcome", "game_date")


def top_openings(facts: DataFrame, minimum: int = 5, k: int | None = None) -> DataFrame:
    """Own openings by share of wins, ranked per player and class."""
    ranked_by = [F.desc(scoring.ratio(F.col("wins"), F.col("games_played"))), F.desc("games_played"), F.asc("my_opening")]
    stats = (
        facts.filter(F.col("my_opening") != openings.NOT_MINE)
        .groupBy(*_STREAM, "my_opening")
        .agg(F.count("*").alias("games_played"), scoring.count_outcome("win").alias("wins"))
        .filter(F.col("games_played") >= minimum)
        .withColumn("win_rate", scoring.win_rate(F.col("wins"), F.col("games_played")))
    )
    if k is not None:
        return rows.top_per_key(stats, _STREAM, ranked_by, k, "rn")
    return stats.withColumn("rn", F.row_number().over(Window.partitionBy(*_STREAM).orderBy(*ranked_by)))


def recent_games(facts: DataFrame, k: int = 10) -> DataFrame:
    narrow = facts.select(
        *_STREAM, "game_id", "game_date", "game_end_timestamp", "outcome", "my_result", "my_rating",
        "opp_username", "opp_rating", "rating_diff", "my_opening", "my_accuracy",
    )
    return rows.top_per_key(narrow, _STREAM, [F.desc("game_end_timestamp"), F.desc("game_id")], k, "rn")


def my_daily_stats(facts: DataFrame) -> DataFrame:
    """One row per player, day and class with running totals and streaks."""
    return (
        cumulative_my_daily(my_daily(facts))
        .join(class_streaks(facts), _STREAM, "left")
        .select(
            "my_username", "game_date", "game_year", "game_month", "time_class",
            "games_played", "wins", "losses", "draws", "win_rate",
            "closing_rating", "day_peak_rating", "day_low_rating", "avg_accuracy", "peak_rating_ever",
            "total_games", "total_wins",
            "longest_win_streak", "longest_loss_streak", "current_streak_outcome", "current_streak_length",
            "last_game_at", F.current_timestamp().alias("updated_at"),
        )
    )


# -- reports -------------------------------------------------------------------------------


def rating_progression(user_statistics: DataFrame, tracked: DataFrame) -> DataFrame:
    """Month by month ratings of the followed players, newest month first."""
    followed = tracked.select(F.lower("username").alias("_name"))
    return (
        user_statistics.filter(F.col("time_class").isin(*RATED_CLASSES))
        .withColumn("_name", F.lower("username"))
        .join(followed, "_name")
        .groupBy("username", "time_class", cal.month_start(F.col("stat_date")).alias("month"))
        .agg(
            F.max("current_rating").alias("end_of_month_rating"),
            F.max("highest_rating_ever").alias("peak_rating_to_date"),
            F.sum("games_played").alias("games_that_month"),
            F.sum("wins").alias("wins_that_month"),
        )
        .withColumn("monthly_win_rate", scoring.win_rate(F.col("wins_that_month"), F.col("games_that_month")))
        .orderBy("username", "time_class", F.desc("month"))
    )


def opening_stats(facts: DataFrame, minimum: int = 10) -> DataFrame:
    return (
        facts.filter((F.col("my_opening") != openings.NOT_MINE) & F.col("time_class").isin(*RATED_CLASSES))
        .groupBy(*_STREAM, "my_opening")
        .agg(
            F.count("*").alias("games_played"),
            scoring.count_outcome("win").alias("wins"),
            scoring.count_outcome("draw").alias("draws"),
            scoring.count_outcome("lose").alias("losses"),
            F.avg("my_rating").alias("avg_rating_when_played"),
            F.max("game_date").alias("last_played"),
        )
        .filter(F.col("games_played") >= minimum)
        .withColumn("win_rate", scoring.win_rate(F.col("wins"), F.col("games_played")))
    )


def top_openings_by_win_rate(facts: DataFrame, k: int = 5, minimum: int = 10) -> DataFrame:
    """The ``k`` best openings of each player and class."""
    order = [F.desc("win_rate"), F.desc("games_played"), F.asc("my_opening")]
    best = rows.top_per_key(opening_stats(facts, minimum), _STREAM, order, k, "rank_by_win_rate")
    return best.select(
        *_STREAM, "rank_by_win_rate", "my_opening", "games_played", "wins", "draws", "losses", "win_rate",
        F.round("avg_rating_when_played").alias("avg_rating"), "last_played",
    ).orderBy(*_STREAM, "rank_by_win_rate")
