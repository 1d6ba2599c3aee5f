"""Joins, anti joins and history joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions.calendar import instant
from rookery.operators import joins, merge
from rookery.plans import charts, ingest, lifetime, quality, refresh, warehouse


def fct_games(spark, folder):
    return src.edge(src.facts(spark, folder).drop("fact_updated_at"))


def fct_games_partial_users(spark, folder):
    """The join form, against a dimension that lacks some players."""
    known = src.users(spark, folder).filter(F.lower("username").isin(*[n.lower() for n in src.SEEDED]))
    facts = warehouse.fct_games(src.player_games(spark, folder), known)
    return src.edge(facts.select("player_game_key", "my_username", "user_key", "loaded_at"))


def dim_users(spark, folder):
    return src.users(spark, folder).drop("updated_at")


def user_stats_join_dim(spark, folder):
    cumulative = warehouse.cumulative_user_stats(warehouse.daily_user_stats(src.player_games(spark, folder)))
    joined = joins.join_users(cumulative, src.users(spark, folder), "username")
    return joined.select("username", "user_key", "stat_date", "time_class", "total_games", "total_wins", "highest_rating_ever")


def rating_progression(spark, folder):
    return warehouse.rating_progression(src.user_statistics(spark, folder), src.tracked(spark, folder))


def new_games_anti(spark, folder):
    raw = src.raw(spark, folder)
    landed = F.unix_seconds("uploaded_at") < src.BATCH_SPLIT
    batch = raw.filter(~landed & F.col("uuid").isNotNull()).withColumn("player", F.lower("loaded_by_user"))
    return ingest.new_games_anti(batch, raw.filter(landed)).select("uuid", "player", "end_time")


def tracked_without_games(spark, folder):
    return quality.tracked_users_present(src.tracked(spark, folder), src.facts(spark, folder))


def opening_stats_merge(spark, folder):
    return src.rounded(lifetime.opening_merge(src.analysis(spark, folder)), "win_rate")


def daily_enrich(spark, folder):
    facts = src.facts(spark, folder)
    joined = warehouse.my_daily(facts).join(warehouse.class_streaks(facts), ["my_username", "time_class"], "left")
    return joined.select(
        "my_username", "game_date", "time_class", "games_played", "longest_win_streak", "longest_loss_streak",
        "current_streak_outcome", "current_streak_length",
    )


def aligned_add(spark, folder):
    counted = charts.win_pct_by_opp_rating(src.analysis(spark, folder))
    return counted.select(
        "my_username", "rating_low", "time_class", "wins", "losses", (F.col("wins") + F.col("losses")).alias("decided")
    )


def _history(spark, folder):
    """Player versions after three looks: half the year, the rest but daily games, everything."""
    games = src.player_games(spark, folder)
    looks = (
        games.filter(F.col("game_month") <= 6),
        games.filter(F.col("time_class") != "daily"),
        games,
    )
    staged = src.staged(spark, folder)
    history = None
    for day, seen in enumerate(looks, start=1):
        users = warehouse.dim_users(staged, seen).drop("updated_at")
        now = instant(F.lit(1735689600 + day * 86400))
        history = merge.first_snapshot(users, now) if history is None else merge.snapshot_check(
            history, users, "user_key", refresh.SNAPSHOT_CHECKS, now
        )
    return history


def asof_snapshot(spark, folder):
    then = joins.as_of(_history(spark, folder), instant(F.lit(1735689600 + 2 * 86400 + 3600)))
    return src.edge(then.select("username", "total_games", "current_rating", "win_rate", "valid_from", "valid_to"))


def asof_snapshot_join(spark, folder):
    """Every landed load with its loader's version at that time."""
    loads = src.raw(spark, folder).groupBy(F.col("loaded_by_user").alias("username"), "uploaded_at").agg(
        F.count("*").alias("loads")
    ).withColumn("at", F.col("uploaded_at") + F.expr("INTERVAL '36' HOUR"))
    history = _history(spark, folder).select("username", "total_games", "valid_from", "valid_to")
    joined = joins.as_of_join(loads, history, "username", "at")
    return src.edge(joined.select("username", "uploaded_at", "loads", "total_games", "valid_from"))


QUERIES = {
    f.__name__: f
    for f in (
        fct_games, fct_games_partial_users, dim_users, user_stats_join_dim, rating_progression, new_games_anti,
        tracked_without_games, opening_stats_merge, daily_enrich, aligned_add, asof_snapshot, asof_snapshot_join,
    )
}

# One row per player, look and value; a version opens where a look differs from the look before.
HISTORY = """
look AS (
  SELECT d, r.username, ifnull(count(game_id), 0) AS total_games,
    ifnull(arg_max(my_rating, game_end_timestamp), 0) AS current_rating, ifnull(max(my_rating), 0) AS peak_rating,
    round(count(*) FILTER (outcome = 'win') / nullif(count(game_id), 0), 4) AS win_rate,
    count(*) FILTER (time_class = 'blitz') AS blitz, count(*) FILTER (time_class = 'rapid') AS rapid,
    count(*) FILTER (time_class = 'bullet') AS bullet
  FROM roster r CROSS JOIN (VALUES (1), (2), (3)) v(d)
  LEFT JOIN pg ON my_username = r.username AND (d = 3 OR (d = 1 AND game_month <= 6) OR (d = 2 AND time_class <> 'daily'))
  GROUP BY ALL),
opened AS (
  SELECT l.*, make_timestamp((1735689600 + d * 86400)::BIGINT * 1000000) AS valid_from FROM look l
  WHERE NOT EXISTS (SELECT 1 FROM look b WHERE b.username = l.username AND b.d = l.d - 1
    AND (b.total_games, b.current_rating, b.peak_rating, b.blitz, b.rapid, b.bullet)
      = (l.total_games, l.current_rating, l.peak_rating, l.blitz, l.rapid, l.bullet)
    AND b.win_rate IS NOT DISTINCT FROM l.win_rate)),
history AS (
  SELECT *, (SELECT min(n.valid_from) FROM opened n WHERE n.username = o.username AND n.valid_from > o.valid_from) AS valid_to
  FROM opened o)"""

ORACLE = {
    "fct_games": over("pg") + """
SELECT * EXCLUDE (eco_slug_raw, uploaded_at, loaded_by_user), uploaded_at AS loaded_at, md5(my_username) AS user_key FROM pg""",
    "fct_games_partial_users": over("dim") + """
SELECT player_game_key, my_username, d.user_key, uploaded_at AS loaded_at
FROM pg LEFT JOIN (SELECT * FROM dim WHERE lower(username) IN ('player0', 'player1', 'player2', 'player3', 'player4', 'player5', 'player6', 'player7', 'player8', 'player9')) d ON d.username = my_username""",
    "dim_users": over("dim") + "SELECT * FROM dim",
    "user_stats_join_dim": over("ustats") + """
SELECT username, user_key, stat_date, time_class, total_games, total_wins, highest_rating_ever FROM ustats""",
    "rating_progression": over("ustats", "tracked") + """
SELECT u.username, time_class, date_trunc('month', stat_date)::DATE AS month, max(current_rating) AS end_of_month_rating,
  max(highest_rating_ever) AS peak_rating_to_date, sum(games_played)::BIGINT AS games_that_month, sum(wins)::BIGINT AS wins_that_month,
  round(sum(wins) / sum(games_played), 4) AS monthly_win_rate
FROM ustats u WHERE time_class <> 'daily' AND lower(u.username) IN (SELECT lower(username) FROM tracked) GROUP BY ALL""",
    "new_games_anti": over("raw") + """
SELECT uuid, lower(loaded_by_user) AS player, end_time FROM raw r
WHERE uuid IS NOT NULL AND epoch(uploaded_at) >= 1735690100 AND NOT EXISTS (
  SELECT 1 FROM raw o WHERE o.uuid = r.uuid AND epoch(o.uploaded_at) < 1735690100
    AND (lower(o.white_username) = lower(r.loaded_by_user) OR lower(o.black_username) = lower(r.loaded_by_user)))""",
    "tracked_without_games": over("pg", "tracked") + """
SELECT username FROM tracked WHERE lower(username) NOT IN (SELECT lower(my_username) FROM pg)""",
    "opening_stats_merge": over("an") + """
SELECT my_username, eco, round(avg((outcome = 'win')::INT), 6) AS win_rate, count(*) AS games_played FROM an GROUP BY ALL""",
    "daily_enrich": over("ustats", "runs") + """
SELECT username AS my_username, stat_date AS game_date, u.time_class, games_played, longest_win_streak, longest_loss_streak,
  current_streak_outcome, current_streak_length
FROM ustats u LEFT JOIN best b ON b.my_username = u.username AND b.time_class = u.time_class""",
    "aligned_add": over("an") + """
SELECT my_username, ((opp_rating - 1) // 50 * 50)::BIGINT AS rating_low, time_class, count(*) FILTER (outcome = 'win') AS wins,
  count(*) FILTER (outcome = 'lose') AS losses, count(*) AS decided
FROM an WHERE outcome <> 'draw' AND opp_rating BETWEEN 1 AND 2500 GROUP BY ALL""",
    "asof_snapshot": over("dim", extra=HISTORY) + """
SELECT username, total_games, current_rating, win_rate, valid_from, valid_to FROM history
WHERE valid_from <= TIMESTAMP '2025-01-03 01:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2025-01-03 01:00:00')""",
    "asof_snapshot_join": over("dim", extra=HISTORY) + """
SELECT l.username, uploaded_at, loads, total_games, valid_from
FROM (SELECT loaded_by_user AS username, uploaded_at, count(*) AS loads FROM raw GROUP BY ALL) l
ASOF LEFT JOIN history h ON h.username = l.username AND h.valid_from <= l.uploaded_at + INTERVAL 36 HOUR""",
}
