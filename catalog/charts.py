"""The data behind every chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.plans import charts
from rookery.session import stage

_SHARE = ["win_percentage"]
# Query name: chart function and its columns to round.
_CHARTS = {
    "games_by_month": (charts.games_by_month, []),
    "games_by_weekday": (charts.games_by_weekday, []),
    "games_by_hour": (charts.games_by_hour, []),
    "wdl_by_time_control": (charts.wdl_by_time_control, []),
    "wdl_by_time_class": (charts.wdl_by_time_class, []),
    "outcome_by_hour": (charts.outcome_by_hour, _SHARE),
    "outcome_by_weekday": (charts.outcome_by_weekday, _SHARE),
    "outcome_by_month": (charts.outcome_by_month, _SHARE),
    "win_pct_by_opp_rating": (charts.win_pct_by_opp_rating, _SHARE),
    "moves_vs_time_points": (charts.moves_vs_time_points, []),
    "win_rate_by_moves_bin": (charts.win_rate_by_moves_bin, _SHARE),
    "scaled_rating_diff": (charts.scaled_rating_diff, ["scaled_diff"]),
    "scaled_rating_box": (charts.scaled_rating_box, ["lowest", "q1", "median", "q3", "highest"]),
    "outcome_by_time_left": (charts.rolling_outcome_share, ["win_share", "draw_share", "lose_share"]),
    "castling_win_ratio": (charts.castling_win_ratio, ["opp_kingside", "opp_queenside", "opp_none"]),
    "castling_game_count": (charts.castling_game_count, []),
    "monthly_avg_rating": (charts.monthly_avg_rating, ["avg_rating"]),
    "duration_histogram": (charts.duration_histogram, []),
}


def _chart(function, columns):
    return lambda spark, folder: src.rounded(function(src.analysis(spark, folder)), *columns)


def all_charts(spark, folder):
    """Rows of every chart table, from one analysis table written once."""
    games = stage(src.analysis(spark, folder).drop("moves", "my_moves", "opp_moves"), "analysis")
    counts = None
    for name, table in charts.all_charts(games).items():
        line = table.groupBy("my_username").agg(F.count("*").alias("n")).select("my_username", F.lit(name).alias("chart"), "n")
        counts = line if counts is None else counts.unionByName(line)
    return counts


QUERIES = {name: _chart(*spec) for name, spec in _CHARTS.items()} | {"all_charts": all_charts}


def _an(columns: str, where: str = "") -> str:
    return over("an") + f"SELECT my_username, {columns} FROM an {where} GROUP BY ALL"


_WIN = "round(avg((outcome = 'win')::INT) * 100, 6) AS win_percentage"
_WDL = "count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'draw') AS draw, count(*) FILTER (outcome = 'lose') AS lose"
_SIDES = ("kingside", "queenside", "none")

_WEEK = """
, days AS (SELECT * FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'),
    (6, 'Saturday'), (7, 'Sunday')) v(day_number, weekday)),
players AS (SELECT DISTINCT my_username FROM an),
counted AS (SELECT my_username, dayname(date) AS weekday, count(*) AS games, avg((outcome = 'win')::INT) * 100 AS w FROM an GROUP BY ALL)"""

_DURATIONS = """
, edges AS (SELECT * FROM (VALUES (0, 0, 60), (1, 60, 120), (2, 120, 180), (3, 180, 240), (4, 240, 300), (5, 300, 600), (6, 600, 900),
    (7, 900, 1200), (8, 1200, 1800), (9, 1800, 2400), (10, 2400, 3000)) v(bin_number, low, high)),
players AS (SELECT DISTINCT my_username FROM an WHERE time_class <> 'daily' AND time_spent < 3000)"""

_SCALED = """
, moments AS (SELECT my_username, avg(rating_diff) AS m, stddev_pop(rating_diff) AS s FROM an GROUP BY 1),
scaled AS (SELECT an.my_username, outcome, rating_diff, (rating_diff - m) / s AS z FROM an JOIN moments USING (my_username))"""


def _grid(cell: str) -> str:
    columns = ", ".join(f"max({cell}) FILTER (opp_castling = '{o}') AS {o}_" for o in _SIDES)
    return over("an") + f"""
, cells AS (SELECT my_username, my_castling, opp_castling, count(*) AS n, avg((outcome = 'win')::INT) AS r FROM an GROUP BY ALL),
wide AS (SELECT my_username, my_castling, {columns} FROM cells GROUP BY ALL),
players AS (SELECT DISTINCT my_username FROM an)
SELECT p.my_username, s.side AS my_castling, """ + ", ".join(f"coalesce({o}_, 0) AS opp_{o}" for o in _SIDES) + """
FROM players p CROSS JOIN (VALUES ('kingside'), ('queenside'), ('none')) s(side)
LEFT JOIN wide w ON w.my_username = p.my_username AND w.my_castling = s.side"""


ORACLE = {
    "games_by_month": _an("date_trunc('month', date)::DATE AS month, count(*) AS games, strftime(date_trunc('month', date), '%b') AS month_label"),
    "games_by_weekday": over("an") + _WEEK + """
SELECT p.my_username, day_number, weekday, games FROM players p CROSS JOIN days LEFT JOIN counted USING (my_username, weekday)""",
    "games_by_hour": _an("(start_est_s // 3600)::INTEGER AS hour, count(*) AS games"),
    "wdl_by_time_control": _an(f"control_label AS time_control, {_WDL}"),
    "wdl_by_time_class": _an(f"time_class, {_WDL}"),
    "outcome_by_hour": _an(f"(start_est_s // 3600)::INTEGER AS hour, count(*) AS games, {_WIN}"),
    "outcome_by_weekday": over("an") + _WEEK + """
SELECT p.my_username, day_number, weekday, games, round(w, 6) AS win_percentage
FROM players p CROSS JOIN days LEFT JOIN counted USING (my_username, weekday)""",
    "outcome_by_month": _an(f"month(date)::INTEGER AS month, count(*) AS games, {_WIN}"),
    "win_pct_by_opp_rating": over("an") + """
SELECT my_username, low AS rating_low, concat(low, '-', low + 50) AS rating_range, time_class,
  count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'lose') AS losses,
  round(avg((outcome = 'win')::INT) * 100, 6) AS win_percentage
FROM (SELECT *, ((opp_rating - 1) // 50 * 50)::BIGINT AS low FROM an WHERE opp_rating > 0 AND opp_rating <= 2500 AND outcome <> 'draw')
GROUP BY ALL""",
    "moves_vs_time_points": over("an") + "SELECT my_username, my_num_moves, time_spent, outcome FROM an",
    "win_rate_by_moves_bin": _an(
        "((my_num_moves - 1) // 5 * 5)::BIGINT AS moves_low, count(*) FILTER (outcome = 'win') AS win_count, count(*) AS total_games, " + _WIN,
        "WHERE my_num_moves > 0",
    ),
    "scaled_rating_diff": over("an") + _SCALED + """
SELECT my_username, outcome, rating_diff, count(*) AS n, round(any_value(z), 6) AS scaled_diff FROM scaled GROUP BY ALL""",
    "scaled_rating_box": over("an") + _SCALED + """
SELECT my_username, outcome, count(*) AS games, round(min(z), 6) AS lowest, round(quantile_cont(z, 0.25), 6) AS q1,
  round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.75), 6) AS q3, round(max(z), 6) AS highest
FROM scaled GROUP BY ALL""",
    "outcome_by_time_left": over("an") + """
, per_clock AS (
  SELECT my_username, time_class, my_time_left, avg((outcome = 'win')::INT) AS w, avg((outcome = 'draw')::INT) AS d,
    avg((outcome = 'lose')::INT) AS l FROM an WHERE time_class IN ('bullet', 'blitz', 'rapid') GROUP BY ALL)
SELECT my_username, time_class, my_time_left, round(avg(w) OVER t, 6) AS win_share, round(avg(d) OVER t, 6) AS draw_share,
  round(avg(l) OVER t, 6) AS lose_share
FROM per_clock WINDOW t AS (PARTITION BY my_username, time_class ORDER BY my_time_left ROWS 29 PRECEDING)""",
    "castling_win_ratio": _grid("if(n >= 10, round(r, 6), NULL)"),
    "castling_game_count": _grid("n"),
    "monthly_avg_rating": _an("time_class, month(date)::INTEGER AS month, round(avg(my_rating), 6) AS avg_rating"),
    "duration_histogram": over("an") + _DURATIONS + """
SELECT p.my_username, bin_number, concat(low // 60, '-', high // 60, ' min') AS duration,
  count(*) FILTER (a.time_class = 'blitz') AS blitz, count(*) FILTER (a.time_class = 'rapid') AS rapid,
  count(*) FILTER (a.time_class = 'bullet') AS bullet
FROM players p CROSS JOIN edges LEFT JOIN an a ON a.my_username = p.my_username AND time_spent >= low AND time_spent < high
GROUP BY ALL""",
    "all_charts": over("an") + """
, players AS (SELECT my_username, count(*) AS n FROM an GROUP BY 1),
tops AS (SELECT my_username, least(10, count(DISTINCT eco)) AS k FROM an GROUP BY 1)
SELECT my_username, 'games_by_month' AS chart, count(DISTINCT date_trunc('month', date)) AS n FROM an GROUP BY 1
UNION ALL SELECT my_username, c, 7 FROM players, (VALUES ('games_by_weekday'), ('outcome_by_weekday')) v(c)
UNION ALL SELECT my_username, c, 3 FROM players, (VALUES ('castling_win_ratio'), ('castling_game_count')) v(c)
UNION ALL SELECT my_username, 'duration_histogram', 11 FROM players
UNION ALL SELECT my_username, c, count(DISTINCT start_est_s // 3600) FROM an, (VALUES ('games_by_hour'), ('outcome_by_hour')) v(c) GROUP BY ALL
UNION ALL SELECT my_username, 'monthly_avg_rating', count(DISTINCT (time_class, month(date))) FROM an GROUP BY 1
UNION ALL SELECT my_username, 'top10_openings_wdl', k FROM tops
UNION ALL SELECT my_username, 'wdl_by_time_class', count(DISTINCT time_class) FROM an GROUP BY 1
UNION ALL SELECT my_username, 'scaled_rating_box', count(DISTINCT outcome) FROM an GROUP BY 1
UNION ALL SELECT my_username, 'outcome_by_month', count(DISTINCT month(date)) FROM an GROUP BY 1
UNION ALL SELECT my_username, 'win_pct_by_opp_rating', count(DISTINCT ((opp_rating - 1) // 50, time_class))
  FROM an WHERE opp_rating BETWEEN 1 AND 2500 AND outcome <> 'draw' GROUP BY 1
UNION ALL SELECT my_username, 'moves_vs_time_points', n FROM players
UNION ALL SELECT my_username, 'win_rate_by_moves_bin', count(DISTINCT (my_num_moves - 1) // 5) FROM an WHERE my_num_moves > 0 GROUP BY 1
UNION ALL SELECT my_username, 'outcome_by_time_left', count(DISTINCT (time_class, my_time_left)) FROM an GROUP BY 1""",
}
