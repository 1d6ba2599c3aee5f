"""Record games, top-k lists and feeds, per player."""

from __future__ import annotations

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.plans import charts, lifetime, serving, warehouse

# Query name to record name.
_RECORDS = {
    "quickest_checkmate": "checkmate",
    "biggest_victory": "victory",
    "biggest_upset": "upset",
    "highest_rated_opponent_beaten": "opponent",
    "longest_game": "longest",
    "most_moves_game": "moves",
    "least_time_won": "least_time_won",
    "least_time_lost": "least_time_lost",
}


def _record(name):
    return lambda spark, folder: lifetime.record_game(src.analysis(spark, folder), name)


def highest_rating(spark, folder):
    return lifetime.highest_rating(src.analysis(spark, folder))


def last_rating_by_class(spark, folder):
    return lifetime.last_rating_by_class(src.analysis(spark, folder))


def most_played_openings(spark, folder):
    return src.rounded(lifetime.most_played_openings(src.analysis(spark, folder)), "win_rate")


def top_opponents(spark, folder):
    return lifetime.top_opponents(src.analysis(spark, folder))


def favourite_openings(spark, folder):
    return lifetime.favourite_openings(src.analysis(spark, folder))


def top10_flagged_games(spark, folder):
    return lifetime.top10_flagged_games(src.analysis(spark, folder))


def daily_feed(spark, folder):
    return src.rounded(serving.daily_feed(warehouse.my_daily_stats(src.facts(spark, folder))), "avg_accuracy").drop("updated_at")


def recent_feed(spark, folder):
    return serving.recent_feed(src.facts(spark, folder))


def top10_openings_wdl(spark, folder):
    return src.rounded(charts.top_openings_wdl(src.analysis(spark, folder)), "win", "draw", "lose")


QUERIES = {name: _record(record) for name, record in _RECORDS.items()} | {
    f.__name__: f
    for f in (
        highest_rating, last_rating_by_class, most_played_openings, top_opponents, favourite_openings,
        top10_flagged_games, daily_feed, recent_feed, top10_openings_wdl,
    )
}


def _first(order: str, where: str = "true", extra: str = "") -> str:
    return over("an") + f"""
SELECT DISTINCT ON (my_username) my_username, opp_username, opp_rating, time_class, {extra} date, link
FROM an WHERE {where} ORDER BY my_username, {order}, ended, game_id"""


ORACLE = {
    "quickest_checkmate": _first("time_spent", "opp_result = 'checkmated'", "time_spent, my_num_moves,"),
    "biggest_victory": _first("rating_diff", "outcome = 'win'"),
    "biggest_upset": _first("rating_diff DESC", "outcome = 'lose'"),
    "highest_rated_opponent_beaten": _first("opp_rating DESC", "outcome = 'win'"),
    "longest_game": _first("time_spent DESC", extra="time_spent,"),
    "most_moves_game": _first("my_num_moves DESC", extra="my_num_moves,"),
    "least_time_won": _first("my_time_left", "outcome = 'win'", "my_time_left,"),
    "least_time_lost": _first("opp_time_left", "outcome = 'lose'", "opp_time_left,"),
    "highest_rating": over("an") + """
SELECT DISTINCT ON (my_username) my_username, my_rating AS rating, time_class AS time_control, date
FROM an ORDER BY my_username, my_rating DESC, ended, game_id""",
    "last_rating_by_class": over("an") + """
SELECT DISTINCT ON (u.my_username, c.time_class) u.my_username, c.time_class, ifnull(an.date::VARCHAR, 'N/A') AS date,
  ifnull(an.my_rating::VARCHAR, 'N/A') AS my_rating
FROM (SELECT DISTINCT my_username FROM an) u CROSS JOIN (VALUES ('blitz'), ('rapid'), ('bullet')) c(time_class)
LEFT JOIN an ON an.my_username = u.my_username AND an.time_class = c.time_class
ORDER BY u.my_username, c.time_class, an.date DESC, ended DESC, game_id DESC""",
    "most_played_openings": over("an") + """
SELECT my_username, eco, round(w, 6) AS win_rate, games_played, n::INTEGER AS rn FROM (
  SELECT *, rank() OVER (PARTITION BY my_username ORDER BY games_played DESC, eco) AS n FROM (
    SELECT my_username, eco, avg((outcome = 'win')::INT) AS w, count(*) AS games_played FROM an GROUP BY ALL)) WHERE n <= 5""",
    "top_opponents": over("an") + """
SELECT my_username, opp_username, games_played, n::INTEGER AS rn FROM (
  SELECT *, rank() OVER (PARTITION BY my_username ORDER BY games_played DESC, opp_username) AS n FROM (
    SELECT my_username, opp_username, count(*) AS games_played FROM an GROUP BY ALL)) WHERE n <= 5""",
    "favourite_openings": over("an") + """
, often AS (SELECT my_username, my_opening, count(*) AS n FROM an WHERE my_opening <> 'N/A' GROUP BY ALL),
whites AS (SELECT DISTINCT ON (my_username) my_username, my_opening FROM often WHERE NOT contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening),
blacks AS (SELECT DISTINCT ON (my_username) my_username, my_opening FROM often WHERE contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening)
SELECT my_username, whites.my_opening AS white_opening, blacks.my_opening AS black_opening
FROM whites FULL JOIN blacks USING (my_username)""",
    "top10_flagged_games": over("an") + """
SELECT my_username, link, opp_time_left, my_time_left, outcome, my_color, n::INTEGER AS rn, f AS flag_set FROM (
  SELECT *, 'flagged' AS f, rank() OVER (PARTITION BY my_username ORDER BY opp_time_left, ended, game_id) AS n
  FROM an WHERE outcome = 'win' AND my_time_left BETWEEN 0.1 AND 5
  UNION ALL
  SELECT *, 'get_flagged', rank() OVER (PARTITION BY my_username ORDER BY my_time_left, ended, game_id)
  FROM an WHERE outcome = 'win' AND opp_time_left BETWEEN 0.1 AND 5) WHERE n <= 10""",
    "daily_feed": over("mydaily") + """
SELECT my_username, n::INTEGER AS rn, game_date::VARCHAR AS game_date, game_year, game_month, time_class, games_played, wins, losses,
  draws, win_rate, closing_rating, day_peak_rating, round(avg_accuracy, 6) AS avg_accuracy, peak_rating_ever, total_games, total_wins,
  longest_win_streak, longest_loss_streak, current_streak_outcome, current_streak_length,
  strftime(last_game_at, '%Y-%m-%d %H:%M:%S') AS last_game_at
FROM (SELECT *, rank() OVER (PARTITION BY my_username ORDER BY game_date DESC, time_class) AS n FROM mydaily) WHERE n <= 90""",
    "recent_feed": over("pg") + """
SELECT my_username, game_date::VARCHAR AS game_date, strftime(game_end_timestamp, '%Y-%m-%d %H:%M:%S') AS game_end_timestamp,
  time_class, outcome, my_result, my_rating, opp_username, opp_rating, rating_diff, my_opening, my_accuracy, game_url, n::INTEGER AS rn
FROM (SELECT *, rank() OVER (PARTITION BY my_username ORDER BY game_end_timestamp DESC, game_id DESC) AS n FROM pg) WHERE n <= 20""",
    "top10_openings_wdl": over("an") + """
SELECT my_username, n::INTEGER AS rn, eco, total, round(w, 6) AS win, round(d, 6) AS draw, round(l, 6) AS lose FROM (
  SELECT *, rank() OVER (PARTITION BY my_username ORDER BY total DESC, eco) AS n FROM (
    SELECT my_username, eco, count(*) AS total, avg((outcome = 'win')::INT) AS w, avg((outcome = 'draw')::INT) AS d,
      avg((outcome = 'lose')::INT) AS l FROM an GROUP BY ALL)) WHERE n <= 10""",
}
