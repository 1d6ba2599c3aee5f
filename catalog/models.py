"""Composite outputs: facts, the daily summary, statistics documents, the portfolio feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions.scoring import OUTCOMES
from rookery.plans import lifetime, serving, warehouse
from rookery.session import stage


def fct_user_statistics(spark, folder):
    return src.user_statistics(spark, folder).drop("fact_updated_at")


def my_daily_stats(spark, folder):
    return src.rounded(warehouse.my_daily_stats(src.facts(spark, folder)), "avg_accuracy").drop("updated_at")


def _table(spark, folder, *extra):
    """The analysis table, written once for statistics that read it several times."""
    games = src.analysis(spark, folder)
    return stage(games.drop("my_moves", "opp_moves") if "moves" in extra else games.drop("moves", "my_moves", "opp_moves"), "analysis")


_CLASSES = ("blitz", "rapid", "bullet", "daily")


def total_statistics(spark, folder):
    document = lifetime.total_statistics(_table(spark, folder))
    flat = [F.col("castling_counts")[s].alias(f"castled_{s}") for s in lifetime.CASTLING_SIDES]
    flat += [F.col("total_win_draw_loss")[o].alias(f"total_{o}") for o in OUTCOMES]
    flat += [F.col("total_results")[r].alias(f"result_{r}") for r in lifetime.NAMED_RESULTS]
    flat += [F.col("timeclass_counts")[c].alias(f"class_{c}") for c in _CLASSES]
    flat += [F.col("biggest_games")[r]["link"].alias(f"link_{r}") for r in lifetime.records()]
    for c in lifetime.LAST_RATING_CLASSES:
        flat.append(F.col("last_game_ratings")[c]["my_rating"].alias(f"last_{c}"))
    controls = F.transform(F.array_sort(F.map_entries("timecontrol_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    opponents = F.transform("most_played_opponent", lambda e: F.concat(e["opponent"], F.lit("="), e["games_played"].cast("string")))
    return src.edge(
        document.select(
            "my_username", "total_moves", "total_en_passant", "total_promotions", "total_games",
            "longest_winning_streak", "longest_losing_streak", *flat,
            F.col("total_time_spent.total_time").alias("total_time"),
            F.col("highest_rating.rating").alias("best_rating"), F.col("highest_rating.time_control").alias("best_rating_class"),
            F.col("highest_rating.date").alias("best_rating_date"),
            F.col("most_time_spent_day_dict.date").alias("busiest_day"), F.col("most_time_spent_day_dict.time_spent").alias("busiest_time"),
            F.col("my_openings.white_opening").alias("white_opening"), F.col("my_openings.black_opening").alias("black_opening"),
            F.array_join(controls, ";").alias("controls"), F.array_join(opponents, ";").alias("opponents"),
        )
    )


def collect_statistics(spark, folder):
    found = lifetime.collect_statistics(_table(spark, folder, "moves"))
    shares = F.col("win_loss_draw_percentages")
    mate, best = F.col("quickest_checkmate"), F.col("best_game_by_rating")
    return src.rounded(
        found.select(
            "my_username", *[shares[f"{n}_percentage"].alias(f"{n}_percentage") for n in ("win", "loss", "draw")],
            "total_time_spent", mate["link"].alias("mate_link"), F.array_join(mate["moves"], " ").alias("mate_moves"),
            best["link"].alias("best_link"), best["opp_rating"].alias("best_opp_rating"),
            F.array_join(F.transform("most_played_openings", lambda e: F.concat(e["eco"], F.lit("="), e["games_played"].cast("string"))), ";").alias("openings"),
            F.array_join(F.transform("most_played_opponent", lambda e: F.concat(e["opp_username"], F.lit("="), e["games_played"].cast("string"))), ";").alias("opponents"),
        ),
        "win_percentage", "loss_percentage", "draw_percentage", "total_time_spent",
    )


def _portfolio(spark, folder, part):
    facts = src.facts(spark, folder)
    return serving.portfolio_stats(facts, warehouse.my_daily_stats(facts), src.OWNER.lower(), "Blitz", 400)[part]


def portfolio_summary(spark, folder):
    return _portfolio(spark, folder, "summary")


def portfolio_daily(spark, folder):
    return src.rounded(_portfolio(spark, folder, "daily"), "avg_accuracy").drop("updated_at")


def portfolio_recent_games(spark, folder):
    return _portfolio(spark, folder, "recent_games")


QUERIES = {
    f.__name__: f
    for f in (
        fct_user_statistics, my_daily_stats, total_statistics, collect_statistics, portfolio_summary, portfolio_daily,
        portfolio_recent_games,
    )
}


def _record(name: str, order: str, where: str = "true") -> str:
    return f"""
rec_{name} AS (SELECT DISTINCT ON (my_username) my_username, link, opp_rating, moves FROM an WHERE {where}
  ORDER BY my_username, {order}, ended, game_id)"""


_RECORDS = {
    "victory": ("rating_diff", "outcome = 'win'"), "upset": ("rating_diff DESC", "outcome = 'lose'"),
    "checkmate": ("time_spent", "opp_result = 'checkmated'"), "opponent": ("opp_rating DESC", "outcome = 'win'"),
    "longest": ("time_spent DESC",), "moves": ("my_num_moves DESC",),
    "least_time_won": ("my_time_left", "outcome = 'win'"), "least_time_lost": ("opp_time_left", "outcome = 'lose'"),
}


def _list(column: str, name: str, limit: str = "") -> str:
    return f"""
{name} AS (SELECT my_username, string_agg(item || '=' || n, ';' ORDER BY {'n DESC, ' if limit else ''}item) AS {name} FROM (
  SELECT *, rank() OVER (PARTITION BY my_username ORDER BY n DESC, item) AS place FROM (
    SELECT my_username, {column} AS item, count(*) AS n FROM an GROUP BY ALL)) {limit} GROUP BY 1)"""


_NAMED = ("win", "checkmated", "timeout", "timevsinsufficient", "resigned", "stalemate", "repetition", "abandoned", "insufficient", "agreed")

_TOTAL = (
    over("an")
    + ","
    + ",".join(_record(n, *s) for n, s in _RECORDS.items())
    + ","
    + _list("control_label", "controls")
    + ","
    + _list("opp_username", "opponents", "WHERE place <= 5")
    + """,
isles AS (SELECT my_username, outcome, row_number() OVER (PARTITION BY my_username ORDER BY ended, game_id)
    - row_number() OVER (PARTITION BY my_username, outcome ORDER BY ended, game_id) AS isle FROM an),
longest AS (SELECT my_username, max(n) FILTER (outcome = 'win') AS longest_winning_streak, max(n) FILTER (outcome = 'lose') AS longest_losing_streak
  FROM (SELECT my_username, outcome, isle, count(*) AS n FROM isles GROUP BY ALL) GROUP BY 1),
spent AS (SELECT my_username, date, sum(time_spent)::BIGINT AS s FROM an GROUP BY ALL),
busy AS (SELECT DISTINCT ON (my_username) my_username, date::VARCHAR AS busiest_day,
  format('{} days {} hours {} minutes {} seconds', s // 86400, s // 3600 % 24, s // 60 % 60, s % 60) AS busiest_time
  FROM spent ORDER BY my_username, s DESC, date),
top_rating AS (SELECT DISTINCT ON (my_username) my_username, my_rating AS best_rating, time_class AS best_rating_class, date AS best_rating_date
  FROM an ORDER BY my_username, my_rating DESC, ended, game_id),
often AS (SELECT my_username, my_opening, count(*) AS n FROM an WHERE my_opening <> 'N/A' GROUP BY ALL),
whites AS (SELECT DISTINCT ON (my_username) my_username, my_opening FROM often WHERE NOT contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening),
blacks AS (SELECT DISTINCT ON (my_username) my_username, my_opening FROM often WHERE contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening),
sums AS (SELECT my_username, sum(time_spent)::BIGINT % 31536000 AS rest, sum(my_num_moves)::BIGINT AS total_moves,
  sum(en_passant_count)::BIGINT AS total_en_passant, sum(promotion_count)::BIGINT AS total_promotions, count(*) AS total_games, """
    + ", ".join(f"count(*) FILTER (my_castling = '{s}') AS castled_{s}" for s in ("kingside", "queenside", "none"))
    + ", "
    + ", ".join(f"count(*) FILTER (outcome = '{o}') AS total_{o}" for o in ("win", "draw", "lose"))
    + ", "
    + ", ".join(f"count(*) FILTER (my_result = '{r}') AS result_{r}" for r in _NAMED)
    + ", "
    + ", ".join(f"count(*) FILTER (time_class = '{c}') AS class_{c}" for c in _CLASSES)
    + ", "
    + ", ".join(f"arg_max(my_rating, (date, ended)) FILTER (time_class = '{c}') AS last_{c}" for c in ("blitz", "rapid", "bullet"))
    + """ FROM an GROUP BY 1)
SELECT sums.* EXCLUDE rest, ifnull(longest_winning_streak, 0) AS longest_winning_streak, ifnull(longest_losing_streak, 0) AS longest_losing_streak,
  format('{} days {} hours {} minutes {} seconds', rest // 86400, rest // 3600 % 24, rest // 60 % 60, rest % 60) AS total_time,
  best_rating, best_rating_class, best_rating_date, busiest_day, busiest_time, whites.my_opening AS white_opening, blacks.my_opening AS black_opening,
  controls, opponents, """
    + ", ".join(f"rec_{n}.link AS link_{n}" for n in _RECORDS)
    + " FROM sums JOIN longest USING (my_username) JOIN busy USING (my_username) JOIN top_rating USING (my_username) "
    "JOIN controls USING (my_username) JOIN opponents USING (my_username) LEFT JOIN whites USING (my_username) LEFT JOIN blacks USING (my_username) "
    + " ".join(f"LEFT JOIN rec_{n} USING (my_username)" for n in _RECORDS)
)

ORACLE = {
    "fct_user_statistics": over("ustats") + "SELECT * FROM ustats",
    "my_daily_stats": over("mydaily") + "SELECT * REPLACE (round(avg_accuracy, 6) AS avg_accuracy) FROM mydaily",
    "total_statistics": _TOTAL,
    "collect_statistics": over("an") + "," + _record("checkmate", *_RECORDS["checkmate"]) + "," + _record("victory", *_RECORDS["victory"])
    + "," + _list("eco", "openings", "WHERE place <= 5") + "," + _list("opp_username", "opponents", "WHERE place <= 5") + """,
sums AS (SELECT my_username, round(avg((outcome = 'win')::INT) * 100, 6) AS win_percentage, round(avg((outcome = 'lose')::INT) * 100, 6) AS loss_percentage,
  round(avg((outcome = 'draw')::INT) * 100, 6) AS draw_percentage, round(sum(time_spent) / 3600, 6) AS total_time_spent FROM an GROUP BY 1)
SELECT sums.*, m.link AS mate_link, array_to_string(m.moves, ' ') AS mate_moves, v.link AS best_link, v.opp_rating AS best_opp_rating, openings, opponents
FROM sums LEFT JOIN rec_checkmate m USING (my_username) LEFT JOIN rec_victory v USING (my_username)
JOIN openings USING (my_username) JOIN opponents USING (my_username)""",
    "portfolio_summary": over("mydaily") + """
SELECT DISTINCT ON (time_class) my_username, time_class, closing_rating AS current_rating, peak_rating_ever, total_games,
  round(total_wins / total_games, 4) AS lifetime_win_rate, longest_win_streak, current_streak_outcome, current_streak_length,
  strftime(last_game_at, '%Y-%m-%d %H:%M:%S') AS last_game_at
FROM mydaily WHERE my_username = 'Player7' AND time_class = 'blitz' ORDER BY time_class, game_date DESC""",
    "portfolio_daily": over("mydaily") + """
SELECT my_username, (row_number() OVER (ORDER BY game_date DESC))::INTEGER AS rn, game_date::VARCHAR AS game_date, game_year, game_month,
  time_class, games_played, wins, losses, draws, win_rate, closing_rating, day_peak_rating, round(avg_accuracy, 6) AS avg_accuracy,
  peak_rating_ever, total_games, total_wins, longest_win_streak, longest_loss_streak, current_streak_outcome, current_streak_length,
  strftime(last_game_at, '%Y-%m-%d %H:%M:%S') AS last_game_at
FROM mydaily WHERE my_username = 'Player7' AND time_class = 'blitz' ORDER BY game_date DESC LIMIT 365""",
    "portfolio_recent_games": over("pg") + """
SELECT my_username, game_date::VARCHAR AS game_date, strftime(game_end_timestamp, '%Y-%m-%d %H:%M:%S') AS game_end_timestamp,
  time_class, outcome, my_result, my_rating, opp_username, opp_rating, rating_diff, my_opening, my_accuracy, game_url,
  (row_number() OVER (ORDER BY game_end_timestamp DESC, game_id DESC))::INTEGER AS rn
FROM pg WHERE my_username = 'Player7' AND time_class = 'blitz' ORDER BY game_end_timestamp DESC, game_id DESC LIMIT 20""",
}
