"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions import calendar as cal
from rookery.functions import scoring
from rookery.plans import parsed_games, serving, warehouse
from rookery.sources.landing import year_filter


def stg_raw_games(spark, folder):
    return src.edge(warehouse.stg_raw_games(src.raw(spark, folder)))


def null_key_filter(spark, folder):
    kept = warehouse.null_key_filter(src.raw(spark, folder))
    return src.edge(kept.select("uuid", "end_time", "white_username", "black_username", "uploaded_at"))


def calendar_fields(spark, folder):
    fields = cal.calendar_fields(F.col("end_time"))
    return src.edge(src.raw(spark, folder).select("url", "end_time", *[c.alias(n) for n, c in fields.items()]))


def _games(spark, folder, *columns):
    return src.player_games(spark, folder).select("game_id", "my_username", *columns)


def outcome_class(spark, folder):
    return _games(spark, folder, "my_result", "outcome")


def rating_diff(spark, folder):
    return _games(spark, folder, "my_rating", "opp_rating", "rating_diff")


def _opened(spark, folder):
    return warehouse.with_openings(warehouse.scored(warehouse.player_games_unpivot(src.staged(spark, folder))))


def eco_slug_raw(spark, folder):
    return _opened(spark, folder).select("game_id", "my_username", "eco_slug_raw")


def eco(spark, folder):
    return _games(spark, folder, "eco")


def my_opening(spark, folder):
    return _games(spark, folder, "my_color", "eco", "my_opening")


def username_year(spark, folder):
    return _games(spark, folder, "username_year")


def surrogate_key(spark, folder):
    key = scoring.surrogate_key(F.col("uuid"), F.col("white_username"), F.col("end_time"))
    return src.raw(spark, folder).select("url", key.alias("row_key"))


def user_perspective(spark, folder):
    own = parsed_games.user_perspective(src.clean(spark, folder), src.OWNER.upper())
    return own.select(
        "game_id", "my_username", "my_color", "my_rating", "my_result", "my_num_moves",
        "opp_username", "opp_rating", "opp_result", "opp_num_moves", "outcome", "my_opening", "rating_diff",
    )


def dashboard_view(spark, folder):
    return src.edge(serving.dashboard_view(src.raw(spark, folder)))


def dashboard_view_filled(spark, folder):
    view = serving.dashboard_view(src.raw(spark, folder), fill=True)
    return src.rounded(view.select("url", "uploaded_at", "my_username", *serving.RECORD_COLUMNS),
                       "my_time_left_ratio", "opp_time_left_ratio")


def user_year_view(spark, folder):
    view = serving.user_year_view(serving.dashboard_view(src.raw(spark, folder)), src.OWNER, 2024)
    return src.edge(view.select("uuid", "url", "my_username", "my_color", "my_win_or_lose", "username_year", "uploaded_at"))


def analysis_filter(spark, folder):
    return parsed_games.analysis_filter(src.clean(spark, folder)).select("game_id", "my_username", "rules", "time_class")


def drop_any_null(spark, folder):
    return parsed_games.drop_any_null(src.clean(spark, folder)).select("game_id", "my_username", "time_class")


def drop_needed_null(spark, folder):
    needed = ["my_rating", "opp_rating", "my_result", "date", "time_spent"]
    return parsed_games.drop_null_in(src.clean(spark, folder), needed).select("game_id", "my_username", "time_class")


def year_filter_all(spark, folder):
    return year_filter(src.player_games(spark, folder), "ALL").select("game_id", "my_username", "game_year")


def year_filter_one(spark, folder):
    return year_filter(src.player_games(spark, folder), 2024).select("game_id", "my_username", "game_year")


def my_games(spark, folder):
    own = warehouse.my_games(src.facts(spark, folder), src.OWNER.lower())
    return src.edge(own.drop("fact_updated_at"))


def default_literals(spark, folder):
    staged = src.staged(spark, folder)
    winners = src.player_games(spark, folder).filter((F.col("outcome") == "win") & (F.col("my_color") == "black")
                                                    & (F.col("time_class") == "daily") & (F.col("my_rating") > 2400))
    sparse = warehouse.all_usernames(staged).join(warehouse.user_lifetime_stats(winners), "username", "left")
    return warehouse.with_defaults(sparse)


QUERIES = {
    f.__name__: f
    for f in (
        stg_raw_games, null_key_filter, calendar_fields, outcome_class, rating_diff, eco_slug_raw, eco, my_opening,
        username_year, surrogate_key, user_perspective, dashboard_view, dashboard_view_filled, user_year_view,
        analysis_filter, drop_any_null, drop_needed_null, year_filter_all, year_filter_one, my_games, default_literals,
    )
}

# The viewer is the loader; everything that is not White's own load is seen from Black.
_VIEW = r"""
viewer AS (
  SELECT *, coalesce(lower(white_username) = lower(loaded_by_user), false) AS w, make_timestamp(end_time * 1000000) AS ts,
    nullif(regexp_extract(pgn, '\[ECOUrl "https?://[^"]+/openings/([^"]+)"\]', 1), '') AS slug FROM raw),
turned AS (
  SELECT *, if(w, 'white', 'black') AS my_color, if(w, white_username, black_username) AS my_username,
    if(w, white_rating, black_rating) AS my_rating, if(w, white_result, black_result) AS my_result,
    if(w, white_accuracy, black_accuracy) AS my_accuracy, if(w, black_username, white_username) AS opp_username,
    if(w, black_rating, white_rating) AS opp_rating, if(w, black_result, white_result) AS opp_result,
    if(w, black_accuracy, white_accuracy) AS opp_accuracy,
    coalesce(nullif(regexp_extract(slug, '^.+?(Defense|Gambit|Opening|Game|Attack|System)', 0), ''), slug, 'No Opening') AS eco
  FROM viewer),
dash AS (
  SELECT uuid, url, pgn, ts AS timestamp, ts::DATE AS date, time_control, time_class, rules AS game_type, rated, eco,
    if(eco <> 'No Opening' AND (my_color = 'black') = contains(eco, 'Defense'), eco, 'N/A') AS my_opening,
    my_username, my_rating, my_result, my_color, my_accuracy, opp_username, opp_rating, opp_result, opp_accuracy,
    if(my_result = 'win', 'win', if(list_contains(['draw', 'stalemate', 'repetition', 'insufficient',
      'timevsinsufficient', 'agreed', '50move'], my_result), 'draw', 'lose')) AS my_win_or_lose,
    my_rating - opp_rating AS rating_diff, uploaded_at, year(ts) AS y, ts
  FROM turned WHERE my_username IS NOT NULL)"""

def _pg_rows(columns: str) -> str:
    return over("pg") + f"SELECT game_id, my_username, {columns} FROM pg"


ORACLE = {
    "stg_raw_games": over("stg") + "SELECT * FROM stg",
    "null_key_filter": over("raw") + """
SELECT uuid, end_time, white_username, black_username, uploaded_at FROM raw
WHERE uuid IS NOT NULL AND end_time IS NOT NULL AND white_username IS NOT NULL AND black_username IS NOT NULL""",
    "calendar_fields": over("raw") + """
SELECT url, end_time, t AS game_end_timestamp, t::DATE AS game_date, year(t)::INTEGER AS game_year, month(t)::INTEGER AS game_month,
  day(t)::INTEGER AS game_day, hour(t)::INTEGER AS game_hour, (dayofweek(t) + 1)::INTEGER AS game_day_of_week,
  strftime(t, '%A') AS game_weekday_name
FROM (SELECT url, end_time, make_timestamp(end_time * 1000000) AS t FROM raw)""",
    "outcome_class": _pg_rows("my_result, outcome"),
    "rating_diff": _pg_rows("my_rating, opp_rating, rating_diff"),
    "eco_slug_raw": _pg_rows("eco_slug_raw"),
    "eco": _pg_rows("eco"),
    "my_opening": _pg_rows("my_color, eco, my_opening"),
    "username_year": _pg_rows("username_year"),
    "surrogate_key": over("raw") + """
SELECT url, md5(concat_ws('-', coalesce(uuid, '_dbt_utils_surrogate_key_null_'),
  coalesce(white_username, '_dbt_utils_surrogate_key_null_'), end_time::VARCHAR)) AS row_key FROM raw""",
    "user_perspective": over("an") + """
SELECT game_id, my_username, my_color, my_rating, my_result, my_num_moves, opp_username, opp_rating, opp_result, opp_num_moves,
  outcome, my_opening, rating_diff FROM clean WHERE my_username = 'Player7'""",
    "dashboard_view": over("raw", extra=_VIEW) + """
SELECT * EXCLUDE (y, ts), NULL::VARCHAR AS my_moves, NULL::VARCHAR AS opp_moves, NULL::VARCHAR AS moves, NULL::BIGINT AS my_num_moves,
  NULL::DOUBLE AS my_time_left, NULL::DOUBLE AS opp_time_left, NULL::DOUBLE AS my_time_left_ratio, NULL::DOUBLE AS opp_time_left_ratio,
  NULL::DOUBLE AS time_spent, NULL::BIGINT AS en_passant_count, NULL::BIGINT AS promotion_count, NULL::VARCHAR AS my_castling,
  NULL::VARCHAR AS opp_castling, month(ts)::INTEGER AS month, dayname(ts) AS weekday, hour(ts)::INTEGER AS hour,
  (dayofweek(ts) + 1)::INTEGER AS day_of_week, uuid AS unique_id, concat(my_username, '_', y) AS username_year FROM dash""",
    "dashboard_view_filled": over("parsed") + """
, pov AS (SELECT *, coalesce(lower(white_username) = lower(loaded_by_user), false) AS w FROM parsed),
t AS (
  SELECT url, uploaded_at, if(w, white_username, black_username) AS my_username, if(w, white_result, black_result) AS mr,
    if(w, black_result, white_result) AS opr, if(w, white_moves, black_moves) AS mm, if(w, black_moves, white_moves) AS om, moves AS am,
    if(w, white_n, black_n) AS mn, if(w, black_n, white_n) AS opn, if(w, white_last, black_last) AS ml,
    if(w, black_last, white_last) AS ol, control_s AS c, time_spent AS sp, if(w, white_castling, black_castling) AS mc,
    if(w, black_castling, white_castling) AS oc, if(w, white_promotions, black_promotions) AS pr,
    if(w, white_passant, black_passant) AS ep FROM pov),
left_over AS (
  SELECT *, if(mr = 'timeout' OR (mr = 'timevsinsufficient' AND mn <= opn), 0.0::DOUBLE, coalesce(ml, c)) AS mt,
    if(opr = 'timeout' OR (opr = 'timevsinsufficient' AND mn > opn), 0.0::DOUBLE, coalesce(ol, c)) AS ot FROM t)
SELECT url, uploaded_at, my_username, array_to_string(mm, ' ') AS my_moves, array_to_string(om, ' ') AS opp_moves,
  array_to_string(am, ' ') AS moves, mn AS my_num_moves, mt AS my_time_left, ot AS opp_time_left,
  round(mt / c, 6) AS my_time_left_ratio, round(ot / c, 6) AS opp_time_left_ratio, sp::DOUBLE AS time_spent,
  ep::BIGINT AS en_passant_count, pr::BIGINT AS promotion_count, mc AS my_castling, oc AS opp_castling
FROM left_over WHERE my_username IS NOT NULL""",
    "user_year_view": over("raw", extra=_VIEW) + """
SELECT uuid, url, my_username, my_color, my_win_or_lose, concat(my_username, '_', y) AS username_year, uploaded_at
FROM dash WHERE my_username = 'Player7' AND y = 2024""",
    "analysis_filter": over("an") + """
SELECT game_id, my_username, rules, time_class FROM clean
WHERE rules = 'chess' AND time_class IN ('blitz', 'rapid', 'bullet', 'daily')""",
    "drop_any_null": over("an") + """
SELECT game_id, my_username, time_class FROM clean
WHERE my_time_left / control_s IS NOT NULL AND opp_time_left / control_s IS NOT NULL
  AND link IS NOT NULL AND date IS NOT NULL AND my_rating IS NOT NULL AND opp_rating IS NOT NULL AND my_result IS NOT NULL AND opp_result IS NOT NULL AND moves IS NOT NULL""",
    "drop_needed_null": over("an") + """
SELECT game_id, my_username, time_class FROM clean WHERE my_rating IS NOT NULL AND opp_rating IS NOT NULL AND my_result IS NOT NULL AND date IS NOT NULL AND time_spent IS NOT NULL""",
    "year_filter_all": _pg_rows("game_year"),
    "year_filter_one": _pg_rows("game_year") + " WHERE game_year = 2024",
    "my_games": over("pg") + """
SELECT * EXCLUDE (eco_slug_raw, uploaded_at, loaded_by_user), uploaded_at AS loaded_at, md5(my_username) AS user_key
FROM pg WHERE lower(my_username) = 'player7'""",
    "default_literals": over("dim") + """
SELECT username, ifnull(max(game_date), DATE '1970-01-01') AS last_game_date, ifnull(min(game_date), DATE '1970-01-01') AS first_game_date,
  count(DISTINCT game_date) AS active_days, count(game_id) AS total_games, count(*) FILTER (outcome = 'win') AS total_wins,
  0::BIGINT AS total_losses, 0::BIGINT AS total_draws, ifnull(arg_max(my_rating, game_end_timestamp), 0) AS current_rating,
  ifnull(max(my_rating), 0) AS peak_rating, ifnull(min(my_rating), 0) AS lowest_rating, 0::BIGINT AS blitz_games,
  0::BIGINT AS rapid_games, 0::BIGINT AS bullet_games, count(game_id) AS daily_games
FROM roster LEFT JOIN (SELECT * FROM pg WHERE outcome = 'win' AND my_color = 'black' AND time_class = 'daily' AND my_rating > 2400) q
  ON q.my_username = roster.username GROUP BY username""",
}
