"""Feeds and views for dashboards. Every function returns a DataFrame; nothing is served here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import calendar as cal
from rookery.functions import movetext as mt
from rookery.functions import openings, scoring
from rookery.operators import rows
from rookery.plans import parsed_games, warehouse
from rookery.sources.landing import is_all_years

DAYS_DEFAULT = 90
RECENT_GAMES = 20

_SIDES = ("username", "rating", "result", "accuracy")

# Columns the view fills from the record text: name, type.
RECORD_COLUMNS = {
    "my_moves": "string", "opp_moves": "string", "moves": "string",
    "my_num_moves": "bigint", "my_time_left": "double", "opp_time_left": "double",
    "my_time_left_ratio": "double", "opp_time_left_ratio": "double", "time_spent": "double",
    "en_passant_count": "bigint", "promotion_count": "bigint", "my_castling": "string", "opp_castling": "string",
}


def _viewed(raw: DataFrame) -> DataFrame:
    """Landed rows from the side of the user who loaded them; no match falls to Black."""
    is_white = F.coalesce(F.lower("white_username") == F.lower("loaded_by_user"), F.lit(False))
    return raw.withColumn("my_color", F.when(is_white, "white").otherwise("black"))


def dashboard_view(raw: DataFrame, fill: bool = False) -> DataFrame:
    """One row per landed row, not deduped.

    The 13 columns that need the record text are typed NULLs, as the consumers of the view know
    them, or filled from the parser with ``fill``.
    """
    slug = raw.withColumn("eco_slug", openings.opening_slug(F.col("pgn")))
    if fill:
        parsed = parsed_games.parse_rows(slug.filter(F.col("pgn").isNotNull()).withColumn("_pgn", F.col("pgn")))
        base = parsed.withColumnRenamed("_pgn", "pgn")
    else:
        base = slug
    date = cal.utc_date(F.col("end_time"))
    viewed = _viewed(base).select(
        "*",
        *[rows.mine(f).alias(f"my_{f}") for f in _SIDES],
        *[rows.theirs(f).alias(f"opp_{f}") for f in _SIDES],
    ).filter(F.col("my_username").isNotNull())
    viewed = warehouse.with_openings(warehouse.scored(viewed))
    records = _record_columns(viewed) if fill else {n: F.lit(None).cast(t) for n, t in RECORD_COLUMNS.items()}
    return viewed.select(
        "uuid", "url", "pgn",
        cal.instant(F.col("end_time")).alias("timestamp"),
        date.alias("date"),
        F.col("time_control"), "time_class", F.col("rules").alias("game_type"), "rated",
        "eco", "my_opening", "my_username", "my_rating", "my_result", "my_color", "my_accuracy",
        "opp_username", "opp_rating", "opp_result", "opp_accuracy",
        F.col("outcome").alias("my_win_or_lose"), "rating_diff",
        *[c.cast(RECORD_COLUMNS[n]).alias(n) for n, c in records.items()],
        F.month(date).alias("month"),
        cal.weekday_name(date).alias("weekday"),
        cal.utc_hour(F.col("end_time")).alias("hour"),
        F.dayofweek(date).alias("day_of_week"),
        F.col("uuid").alias("unique_id"),
        "uploaded_at",
        F.concat(F.col("my_username"), F.lit("_"), F.year(date).cast("string")).alias("username_year"),
    )


def _record_columns(viewed: DataFrame) -> dict[str, Column]:
    control = F.col("control_seconds")
    my_n, opp_n = rows.mine("num_moves"), rows.theirs("num_moves")
    last_mover = F.when(my_n > opp_n, "me").otherwise("opponent")
    my_left = mt.time_left(F.col("my_result"), last_mover, "opponent", rows.mine("last_clock"), control)
    opp_left = mt.time_left(F.col("opp_result"), last_mover, "me", rows.theirs("last_clock"), control)

    def joined(moves: Column) -> Column:
        return F.array_join(moves, " ")

    return {
        "my_moves": joined(parsed_games.moves_of("my")), "opp_moves": joined(parsed_games.moves_of("opp")),
        "moves": joined(F.col("moves")),
        "my_num_moves": my_n, "my_time_left": my_left, "opp_time_left": opp_left,
        "my_time_left_ratio": mt.time_left_ratio(my_left, control),
        "opp_time_left_ratio": mt.time_left_ratio(opp_left, control),
        "time_spent": F.col("time_spent"),
        "en_passant_count": rows.mine("en_passant"), "promotion_count": rows.mine("promotions"),
        "my_castling": rows.mine("castling"), "opp_castling": rows.theirs("castling"),
    }


def user_year_view(view: DataFrame, username: str, year: object = "ALL") -> DataFrame:
    """One player's rows of the view, of one year or of all."""
    if is_all_years(year):
        return view.filter(F.col("my_username") == username)
    return view.filter(F.col("username_year") == f"{username}_{year}")


def view_row_count(view: DataFrame) -> DataFrame:
    """Rows behind every key of the view."""
    return view.groupBy("username_year").agg(F.count("*").alias("n"))


def _of_class(df: DataFrame, time_class: str | None) -> DataFrame:
    return df if not time_class else df.filter(F.col("time_class") == time_class.strip().lower())


def daily_feed(daily: DataFrame, time_class: str | None = None, limit: int = DAYS_DEFAULT) -> DataFrame:
    """The newest ``limit`` daily rows of each player."""
    newest = [F.desc("game_date"), F.asc("time_class")]
    feed = rows.top_per_key(_of_class(daily, time_class), ["my_username"], newest, limit, "rn")
    return feed.select(
        "my_username", "rn", F.col("game_date").cast("string").alias("game_date"), "game_year", "game_month", "time_class",
        "games_played", "wins", "losses", "draws", F.round("win_rate", 4).alias("win_rate"),
        "closing_rating", "day_peak_rating", "avg_accuracy", "peak_rating_ever", "total_games", "total_wins",
        "longest_win_streak", "longest_loss_streak", "current_streak_outcome", "current_streak_length",
        cal.utc_wall_clock(F.col("last_game_at")).cast("string").alias("last_game_at"),
        cal.utc_wall_clock(F.col("updated_at")).cast("string").alias("updated_at"),
    )


def summary_feed(daily: DataFrame, time_class: str | None = None) -> DataFrame:
    """The latest day of each player and class with the lifetime share of wins."""
    latest = rows.top_per_key(_of_class(daily, time_class), ["my_username", "time_class"], [F.desc("game_date")], 1)
    return latest.select(
        "my_username", "time_class", F.col("closing_rating").alias("current_rating"), "peak_rating_ever", "total_games",
        F.round(scoring.ratio(F.col("total_wins"), F.col("total_games")), 4).alias("lifetime_win_rate"),
        "longest_win_streak", "current_streak_outcome", "current_streak_length",
        cal.utc_wall_clock(F.col("last_game_at")).cast("string").alias("last_game_at"),
    )


def recent_feed(facts: DataFrame, time_class: str | None = None, limit: int = RECENT_GAMES) -> DataFrame:
    """The last games of each player, newest first."""
    newest = [F.desc("game_end_timestamp"), F.desc("game_id")]
    columns = [
        "my_username", "game_id", "game_date", "game_end_timestamp", "time_class", "outcome", "my_result", "my_rating",
        "opp_username", "opp_rating", "rating_diff", "my_opening", "my_accuracy", "game_url",
    ]
    last = rows.top_per_key(_of_class(facts, time_class).select(*columns), ["my_username"], newest, limit, "rn")
    return last.withColumns(
        {
            "game_date": F.col("game_date").cast("string"),
            "game_end_timestamp": cal.utc_wall_clock(F.col("game_end_timestamp")).cast("string"),
        }
    ).drop("game_id")


def portfolio_stats(
    facts: DataFrame, daily: DataFrame, username: str, time_class: str | None = None, limit: int = DAYS_DEFAULT
) -> dict[str, DataFrame]:
    """Summary, daily rows and recent games of one player."""
    own_days = daily.filter(F.lower("my_username") == username.lower())
    return {
        "summary": summary_feed(own_days, time_class),
        "daily": daily_feed(own_days, time_class, limit),
        "recent_games": recent_feed(warehouse.my_games(facts, username), time_class),
    }
