"""Dedupe, running totals, streaks, ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.operators import streaks
from rookery.plans import charts, lifetime, serving, warehouse


def dedupe_latest(spark, folder):
    kept = warehouse.deduped(src.raw(spark, folder))
    return src.edge(kept.select("uuid", "uploaded_at", "loaded_by_user", "white_accuracy"))


def cumulative_user_stats(spark, folder):
    totals = warehouse.cumulative_user_stats(warehouse.daily_user_stats(src.player_games(spark, folder)))
    return totals.select("username", "stat_date", "time_class", "total_games", "total_wins", "current_rating", "highest_rating_ever")


def cumulative_my_daily(spark, folder):
    totals = warehouse.cumulative_my_daily(warehouse.my_daily(src.facts(spark, folder)))
    return totals.select("my_username", "game_date", "time_class", "total_games", "total_wins", "peak_rating_ever")


def outcome_changed(spark, folder):
    marked = warehouse.numbered_outcomes(src.facts(spark, folder))
    return src.edge(marked.drop("streak_group"))


def streak_group(spark, folder):
    numbered = warehouse.numbered_outcomes(src.facts(spark, folder))
    return numbered.select("my_username", "time_class", "game_id", "outcome", "streak_group")


def streak_group_null_class(spark, folder):
    """Games without a time class form runs of their own."""
    facts = src.facts(spark, folder).withColumn("time_class", F.expr("nullif(time_class, 'daily')"))
    return warehouse.numbered_outcomes(facts).select("my_username", "time_class", "game_id", "outcome", "streak_group")


def streak_lengths(spark, folder):
    return warehouse.streak_table(src.facts(spark, folder))


def best_streaks(spark, folder):
    return warehouse.class_streaks(src.facts(spark, folder)).select(
        "my_username", "time_class", "longest_win_streak", "longest_loss_streak"
    )


def current_streak(spark, folder):
    return warehouse.class_streaks(src.facts(spark, folder)).select(
        "my_username", "time_class", "current_streak_outcome", "current_streak_length"
    )


def top_openings_5min(spark, folder):
    return warehouse.top_openings(src.facts(spark, folder))


def recent_games_10(spark, folder):
    return src.edge(warehouse.recent_games(src.facts(spark, folder)))


def top_openings_by_win_rate(spark, folder):
    return warehouse.top_openings_by_win_rate(src.facts(spark, folder))


def latest_per_time_class(spark, folder):
    return serving.summary_feed(warehouse.my_daily_stats(src.facts(spark, folder)))


def longest_streak(spark, folder):
    return lifetime.longest_streak(src.analysis(spark, folder))


def rolling_outcome_share(spark, folder):
    shares = charts.rolling_outcome_share(src.analysis(spark, folder))
    return src.rounded(shares, "win_share", "draw_share", "lose_share")


def event_streaks(spark, folder):
    """Runs of one event type per user, over a table with many more keys."""
    events = spark.read.parquet(f"{folder}/events.parquet").select(
        "user_id", "event_type", "event_id", F.col("ts").cast("timestamp").alias("at"), F.to_date("ts").alias("day")
    )
    numbered = streaks.number_streaks(events, ["user_id"], "event_type", "at", "event_id")
    return streaks.streak_lengths(numbered, ["user_id"], "event_type", "day")


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_latest, cumulative_user_stats, cumulative_my_daily, outcome_changed, streak_group, streak_group_null_class, streak_lengths,
        best_streaks, current_streak, top_openings_5min, recent_games_10, top_openings_by_win_rate,
        latest_per_time_class, longest_streak, rolling_outcome_share, event_streaks,
    )
}

ORACLE = {
    "dedupe_latest": over("stg") + "SELECT uuid, uploaded_at, loaded_by_user, white_accuracy FROM latest",
    "cumulative_user_stats": over("ustats") + """
SELECT username, stat_date, time_class, total_games, total_wins, current_rating, highest_rating_ever FROM ustats""",
    "cumulative_my_daily": over("ustats") + """
SELECT username AS my_username, stat_date AS game_date, time_class, total_games, total_wins, highest_rating_ever AS peak_rating_ever
FROM ustats""",
    "outcome_changed": over("runs") + "SELECT * EXCLUDE nth FROM marked",
    "streak_group": over("runs") + "SELECT my_username, time_class, game_id, outcome, streak_group FROM grouped",
    "streak_group_null_class": over("runs") + """
SELECT my_username, nullif(time_class, 'daily') AS time_class, game_id, outcome, streak_group FROM grouped""",
    "streak_lengths": over("runs") + "SELECT * FROM runs",
    "best_streaks": over("runs") + "SELECT my_username, time_class, longest_win_streak, longest_loss_streak FROM best",
    "current_streak": over("runs") + "SELECT my_username, time_class, current_streak_outcome, current_streak_length FROM best",
    "top_openings_5min": over("pg") + """
SELECT *, round(wins / games_played, 4) AS win_rate,
  rank() OVER (PARTITION BY my_username, time_class ORDER BY wins / games_played DESC, games_played DESC, my_opening)::INTEGER AS rn
FROM (SELECT my_username, time_class, my_opening, count(*) AS games_played, count(*) FILTER (outcome = 'win') AS wins
  FROM pg WHERE my_opening <> 'N/A' GROUP BY ALL) WHERE games_played >= 5""",
    "recent_games_10": over("pg") + """
SELECT my_username, time_class, game_id, game_date, game_end_timestamp, outcome, my_result, my_rating, opp_username, opp_rating,
  rating_diff, my_opening, my_accuracy, n::INTEGER AS rn
FROM (SELECT *, rank() OVER (PARTITION BY my_username, time_class ORDER BY game_end_timestamp DESC, game_id DESC) AS n FROM pg)
WHERE n <= 10""",
    "top_openings_by_win_rate": over("pg") + """
, counted AS (
  SELECT my_username, time_class, my_opening, count(*) AS games_played, count(*) FILTER (outcome = 'win') AS wins,
    count(*) FILTER (outcome = 'draw') AS draws, count(*) FILTER (outcome = 'lose') AS losses,
    round(avg((outcome = 'win')::INT), 4) AS win_rate, round(avg(my_rating)) AS avg_rating, max(game_date) AS last_played
  FROM pg WHERE my_opening <> 'N/A' AND time_class IN ('blitz', 'rapid', 'bullet') GROUP BY ALL),
placed AS (
  SELECT c.*, 1 + (SELECT count(*) FROM counted o WHERE o.my_username = c.my_username AND o.time_class = c.time_class
    AND o.games_played >= 10 AND (o.win_rate > c.win_rate OR (o.win_rate = c.win_rate AND (o.games_played > c.games_played
      OR (o.games_played = c.games_played AND o.my_opening < c.my_opening))))) AS place
  FROM counted c WHERE games_played >= 10)
SELECT * EXCLUDE place, place::INTEGER AS rank_by_win_rate FROM placed WHERE place <= 5""",
    "latest_per_time_class": over("mydaily") + """
SELECT DISTINCT ON (my_username, time_class) my_username, time_class, closing_rating AS current_rating, peak_rating_ever, total_games,
  round(total_wins / total_games, 4) AS lifetime_win_rate, longest_win_streak, current_streak_outcome, current_streak_length,
  strftime(last_game_at, '%Y-%m-%d %H:%M:%S') AS last_game_at
FROM mydaily ORDER BY my_username, time_class, game_date DESC""",
    "longest_streak": over("an") + """
, ordered AS (
  SELECT my_username, outcome, row_number() OVER (PARTITION BY my_username ORDER BY ended, game_id)
    - row_number() OVER (PARTITION BY my_username, outcome ORDER BY ended, game_id) AS island FROM an),
lens AS (SELECT my_username, outcome, island, count(*) AS n FROM ordered GROUP BY ALL)
SELECT my_username, ifnull(max(n) FILTER (outcome = 'win'), 0) AS longest_winning_streak,
  ifnull(max(n) FILTER (outcome = 'lose'), 0) AS longest_losing_streak FROM lens GROUP BY 1""",
    "rolling_outcome_share": over("an") + """
, per_clock AS (
  SELECT my_username, time_class, my_time_left, avg((outcome = 'win')::INT) AS w, avg((outcome = 'draw')::INT) AS d,
    avg((outcome = 'lose')::INT) AS l FROM an WHERE time_class <> 'daily' GROUP BY ALL)
SELECT my_username, time_class, my_time_left, round(avg(w) OVER t, 6) AS win_share, round(avg(d) OVER t, 6) AS draw_share,
  round(avg(l) OVER t, 6) AS lose_share
FROM per_clock WINDOW t AS (PARTITION BY my_username, time_class ORDER BY my_time_left ROWS 29 PRECEDING)""",
    "event_streaks": """
WITH marked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
    - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
runs AS (SELECT user_id, event_type, island, min(nth) AS starts, count(*) AS streak_length, min(ts)::DATE AS streak_start,
  max(ts)::DATE AS streak_end FROM marked GROUP BY ALL)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY starts) - 1 AS streak_group,
  streak_length, streak_start, streak_end FROM runs""",
}
