"""Grouped aggregates, per player."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions import scoring
from rookery.operators import rows
from rookery.plans import lifetime, serving, warehouse
from rookery.sources import landing


def user_lifetime_stats(spark, folder):
    return warehouse.user_lifetime_stats(src.player_games(spark, folder))


def time_class_counts_by_user(spark, folder):
    return warehouse.time_class_counts_by_user(src.player_games(spark, folder))


def daily_user_stats(spark, folder):
    return src.rounded(warehouse.daily_user_stats(src.player_games(spark, folder)), "avg_accuracy", "avg_rating")


def my_daily(spark, folder):
    return src.rounded(warehouse.my_daily(src.facts(spark, folder)), "avg_accuracy")


def opening_stats(spark, folder):
    return src.rounded(warehouse.opening_stats(src.facts(spark, folder)), "avg_rating_when_played")


def win_rate_by_eco(spark, folder):
    return src.rounded(lifetime.win_rate_by_eco(src.analysis(spark, folder)), "win_rate")


def games_by_eco(spark, folder):
    return lifetime.games_by_eco(src.analysis(spark, folder))


def wdl_percentages(spark, folder):
    shares = lifetime.wdl_percentages(src.analysis(spark, folder))
    return src.rounded(shares, "win_percentage", "loss_percentage", "draw_percentage")


def elo_progression(spark, folder):
    return src.rounded(lifetime.elo_progression(src.analysis(spark, folder)), "avg_rating")


def total_time_spent_hours(spark, folder):
    return src.rounded(lifetime.total_time_spent_hours(src.analysis(spark, folder)), "hours")


def opponent_counts(spark, folder):
    return lifetime.opponent_counts(src.analysis(spark, folder))


def time_control_counts(spark, folder):
    return lifetime.time_control_counts(src.analysis(spark, folder))


def castling_counts(spark, folder):
    return lifetime.castling_counts(src.analysis(spark, folder))


def variant_counts(spark, folder):
    return rows.value_counts(src.clean(spark, folder), lifetime.PLAYER, "rules")


def time_class_counts(spark, folder):
    return rows.value_counts(src.clean(spark, folder), lifetime.PLAYER, "time_class")


def outcome_counts(spark, folder):
    return lifetime.outcome_counts(src.analysis(spark, folder))


def result_counts(spark, folder):
    return lifetime.result_counts(src.clean(spark, folder))


def move_totals(spark, folder):
    return lifetime.move_totals(src.analysis(spark, folder))


def time_by_day(spark, folder):
    return lifetime.time_by_day(src.analysis(spark, folder))


def busiest_day(spark, folder):
    return lifetime.busiest_day(src.analysis(spark, folder))


def opening_count_list(spark, folder):
    return rows.value_counts(src.analysis(spark, folder), lifetime.PLAYER, "my_opening")


def max_end_time(spark, folder):
    return landing.max_end_time(src.raw(spark, folder), src.OWNER.upper())


def high_water_marks(spark, folder):
    return landing.high_water_marks(src.raw(spark, folder))


def row_count_for_user(spark, folder):
    return landing.row_count_for_user(src.raw(spark, folder), src.OWNER)


def net_new_rows(spark, folder):
    """Rows per player after a load less the rows before it."""
    raw = src.raw(spark, folder)
    before = landing.high_water_marks(raw.filter(F.unix_seconds("uploaded_at") < src.BATCH_SPLIT))
    after = landing.high_water_marks(raw).select("player", F.col("landed_rows").alias("after"))
    return after.join(before, "player", "left").select(
        "player", (F.col("after") - F.coalesce("landed_rows", F.lit(0))).alias("net_new")
    )


def view_row_count(spark, folder):
    return serving.view_row_count(serving.dashboard_view(src.raw(spark, folder)))


def flag_statistics_totals(spark, folder):
    return lifetime.flag_statistics_totals(src.analysis(spark, folder))


def flag_count_groups(spark, folder):
    return lifetime.flag_count_groups(src.analysis(spark, folder))


def event_totals(spark, folder):
    """The same grouping and rate helpers over the event table."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        scoring.win_rate(F.count_if(F.col("event_type") == "purchase"), F.count("*")).alias("purchase_rate"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        user_lifetime_stats, time_class_counts_by_user, daily_user_stats, my_daily, opening_stats, win_rate_by_eco,
        games_by_eco, wdl_percentages, elo_progression, total_time_spent_hours, opponent_counts, time_control_counts,
        castling_counts, variant_counts, time_class_counts, outcome_counts, result_counts, move_totals, time_by_day,
        busiest_day, opening_count_list, max_end_time, high_water_marks, row_count_for_user, net_new_rows,
        view_row_count, flag_statistics_totals, flag_count_groups, event_totals,
    )
}


def _an(columns: str, where: str = "", table: str = "an") -> str:
    return over("an") + f"SELECT my_username, {columns} FROM {table} {where} GROUP BY ALL"


def _counts(column: str, values: tuple[str, ...]) -> str:
    return ", ".join(f"""count(*) FILTER ({column} = '{v}') AS "{v}" """ for v in values)


_BY_PLAYER = """
who AS (SELECT DISTINCT url, uploaded_at, end_time, lower(p) AS player
  FROM (SELECT url, uploaded_at, end_time, unnest([white_username, black_username]) AS p FROM raw) WHERE p IS NOT NULL)"""

ORACLE = {
    "user_lifetime_stats": over("dim") + "SELECT * FROM life",
    "time_class_counts_by_user": over("dim") + "SELECT username, blitz_games, rapid_games, bullet_games, daily_games FROM life",
    "daily_user_stats": over("ustats") + """
SELECT * EXCLUDE last_game_at REPLACE (round(avg_accuracy, 6) AS avg_accuracy, round(avg_rating, 6) AS avg_rating) FROM perday""",
    "my_daily": over("ustats") + """
SELECT username AS my_username, stat_date AS game_date, year(stat_date)::INTEGER AS game_year, month(stat_date)::INTEGER AS game_month,
  time_class, games_played, wins, losses, draws, round(wins / games_played, 4) AS win_rate, closing_rating,
  max_rating AS day_peak_rating, min_rating AS day_low_rating, round(avg_accuracy, 6) AS avg_accuracy, last_game_at FROM perday""",
    "opening_stats": over("pg") + """
SELECT my_username, time_class, my_opening, count(*) AS games_played, count(*) FILTER (outcome = 'win') AS wins,
  count(*) FILTER (outcome = 'draw') AS draws, count(*) FILTER (outcome = 'lose') AS losses,
  round(avg((outcome = 'win')::INT), 4) AS win_rate, round(avg(my_rating), 6) AS avg_rating_when_played, max(game_date) AS last_played
FROM pg WHERE my_opening <> 'N/A' AND time_class <> 'daily' GROUP BY ALL HAVING count(*) >= 10""",
    "win_rate_by_eco": _an("eco, round(avg((outcome = 'win')::INT), 6) AS win_rate"),
    "games_by_eco": _an("eco, count(*) AS games_played"),
    "wdl_percentages": _an(
        "round(avg((outcome = 'win')::INT) * 100, 6) AS win_percentage, round(avg((outcome = 'lose')::INT) * 100, 6) AS loss_percentage, "
        "round(avg((outcome = 'draw')::INT) * 100, 6) AS draw_percentage"
    ),
    "elo_progression": _an("date, round(avg(my_rating), 6) AS avg_rating"),
    "total_time_spent_hours": _an("round(sum(time_spent) / 3600, 6) AS hours"),
    "opponent_counts": _an("opp_username, count(*) AS games_played"),
    "time_control_counts": _an("control_label AS time_control, count(*) AS games_played"),
    "castling_counts": _an(_counts("my_castling", ("kingside", "queenside", "none"))),
    "variant_counts": _an("rules, count(*) AS n", table="clean"),
    "time_class_counts": _an("time_class, count(*) AS n", table="clean"),
    "outcome_counts": _an(_counts("outcome", ("win", "draw", "lose"))),
    "result_counts": _an(
        _counts("my_result", ("win", "checkmated", "timeout", "timevsinsufficient", "resigned", "stalemate", "repetition",
                              "abandoned", "insufficient", "agreed"))
        + ", count(*) FILTER (my_result IN ('stalemate', 'repetition', 'timevsinsufficient', 'insufficient', 'agreed')) AS total_draw"
        ", count(*) FILTER (my_result IN ('checkmated', 'timeout', 'resigned', 'abandoned')) AS total_loss",
        table="clean",
    ),
    "move_totals": _an(
        "sum(my_num_moves)::BIGINT AS total_moves, sum(en_passant_count)::BIGINT AS total_en_passant, "
        "sum(promotion_count)::BIGINT AS total_promotions"
    ),
    "time_by_day": _an("date, sum(time_spent)::BIGINT AS time_spent"),
    "busiest_day": over("an") + """
SELECT DISTINCT ON (my_username) my_username, date, time_spent
FROM (SELECT my_username, date, sum(time_spent)::BIGINT AS time_spent FROM an GROUP BY ALL)
ORDER BY my_username, time_spent DESC, date""",
    "opening_count_list": _an("my_opening, count(*) AS n"),
    "max_end_time": over("raw") + """
SELECT max(end_time) AS max_end_time FROM raw WHERE list_contains([lower(white_username), lower(black_username)], 'player7')""",
    "high_water_marks": over("raw", extra=_BY_PLAYER) + """
SELECT player, max(end_time) AS max_end_time, count(*) AS landed_rows FROM who GROUP BY 1""",
    "row_count_for_user": over("raw") + """
SELECT count(*) AS n FROM raw WHERE list_contains([lower(white_username), lower(black_username)], 'player7')""",
    "net_new_rows": over("raw", extra=_BY_PLAYER) + """
SELECT player, count(*) FILTER (epoch(uploaded_at) >= 1735690100) AS net_new FROM who GROUP BY 1""",
    "view_row_count": over("raw") + """
SELECT concat(u, '_', y) AS username_year, count(*) AS n FROM (
  SELECT if(coalesce(lower(white_username) = lower(loaded_by_user), false), white_username, black_username) AS u,
    year(make_timestamp(end_time * 1000000)) AS y FROM raw) WHERE u IS NOT NULL GROUP BY 1""",
    "flag_statistics_totals": _an(
        "count(*) FILTER (outcome = 'win' AND my_time_left BETWEEN 0.1 AND 5) AS my_total_flag_wins, "
        "count(*) FILTER (outcome = 'win' AND opp_time_left BETWEEN 0.1 AND 5) AS my_total_flag_losses"
    ),
    "flag_count_groups": over("an") + """
SELECT my_username, 'mine' AS flag_set, my_time_left, outcome, link, count(*) AS n FROM an
WHERE outcome = 'win' AND my_time_left BETWEEN 0.1 AND 5 GROUP BY ALL
UNION ALL
SELECT my_username, 'theirs', my_time_left, outcome, link, count(*) FROM an
WHERE outcome = 'win' AND opp_time_left BETWEEN 0.1 AND 5 GROUP BY ALL""",
    "event_totals": """
SELECT user_id, count(*) AS n, round(avg((event_type = 'purchase')::INT), 4) AS purchase_rate FROM events GROUP BY 1""",
}
