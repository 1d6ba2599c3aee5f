"""Columns parsed from the record text, each over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions import movetext as mt
from rookery.plans import parsed_games as pp


def _text(spark, folder):
    return src.raw(spark, folder).select("url", "uploaded_at", "pgn")


def _out(df, *columns):
    return src.edge(df.select("url", "uploaded_at", *columns))


def pgn_tags(spark, folder):
    tagged = pp.with_tags(_text(spark, folder)).withColumn("tags", mt.tag_map(F.col("tag_names"), F.col("tag_values")))
    tag = F.col("tags")
    return _out(tagged, tag["Date"].alias("date"), tag["StartTime"].alias("start_time"), tag["EndTime"].alias("end_time"),
                tag["Link"].alias("link"), F.try_element_at("tags", F.lit("ECOUrl")).alias("eco_url"),
                F.size("tags").cast("bigint").alias("n_tags"))


def pgn_moves(spark, folder):
    return _out(_text(spark, folder), F.array_join(mt.moves(F.col("pgn")), " ").alias("moves"))


def pgn_clocks(spark, folder):
    def listed(pattern):
        return F.array_join(F.transform(mt.clock_list(F.col("pgn"), pattern), lambda c: F.concat(c["move_no"], F.lit("@"), c["clk"])), " ")

    return _out(_text(spark, folder), listed(mt.WHITE_CLOCK_PATTERN).alias("white"), listed(mt.BLACK_CLOCK_PATTERN).alias("black"))


def time_control_label(spark, folder):
    return src.raw(spark, folder).select("url", "time_control", mt.time_control_label(F.col("time_control")).alias("label"))


def utc_to_est_time(spark, folder):
    return _out(pp.with_header(src.raw(spark, folder)), "start_time_est", "end_time_est")


def est_date_adjust(spark, folder):
    return _out(pp.with_header(src.raw(spark, folder)), F.date_format("date", "yyyy.MM.dd").alias("date"))


def time_spent(spark, folder):
    return _out(pp.with_header(src.raw(spark, folder)), "time_spent")


def process_game(spark, folder):
    games = pp.process_game(src.raw(spark, folder))
    flat = {
        "moves": F.array_join("moves", " "),
        **{c: F.array_join(F.transform(c, lambda m: m["clk"]), " ") for c in ("white_metamoves", "black_metamoves")},
    }
    return games.withColumns(flat).drop("pgn")


def clock_to_seconds(spark, folder):
    clocks = _text(spark, folder).select(
        "url", "uploaded_at", F.posexplode(mt.clock_times(F.col("pgn"), mt.WHITE_CLOCK_PATTERN)).alias("at", "clock")
    )
    return clocks.select("url", "clock", mt.clock_seconds(F.col("clock")).alias("seconds"))


def time_control_seconds(spark, folder):
    return src.raw(spark, folder).select("url", "time_control", mt.time_control_seconds(F.col("time_control")).alias("seconds"))


def _seen(*columns):
    return lambda spark, folder: src.clean(spark, folder).select("game_id", "my_username", *columns)


def time_left_ratio(spark, folder):
    games = src.clean(spark, folder).select("game_id", "my_username", "my_time_left_ratio", "opp_time_left_ratio")
    return src.rounded(games, "my_time_left_ratio", "opp_time_left_ratio")


def split_moves(spark, folder):
    games = src.clean(spark, folder)
    return games.select("game_id", "my_username", *[F.array_join(c, " ").alias(c) for c in ("my_moves", "opp_moves")])


def clean_games(spark, folder):
    games = src.clean(spark, folder).drop("uploaded_at", "loaded_by_user", "start_est_seconds")
    games = games.withColumns({c: F.array_join(c, " ") for c in ("moves", "my_moves", "opp_moves")})
    return src.rounded(games, "my_time_left_ratio", "opp_time_left_ratio")


QUERIES = {
    f.__name__: f
    for f in (
        pgn_tags, pgn_moves, pgn_clocks, time_control_label, utc_to_est_time, est_date_adjust, time_spent, process_game,
        clock_to_seconds, time_control_seconds, time_left_ratio, split_moves, clean_games,
    )
} | {
    "last_mover": _seen("last_mover"),
    "time_left": _seen("my_time_left", "opp_time_left"),
    "num_moves": _seen("my_num_moves", "opp_num_moves"),
    "castling": _seen("my_castling", "opp_castling"),
    "promotion_count": _seen("promotion_count"),
    "en_passant_count": _seen("en_passant_count"),
}


def _texts(columns: str) -> str:
    return over("parsed") + f"SELECT url, uploaded_at, {columns} FROM parsed"


def _clean(columns: str) -> str:
    return over("an") + f"SELECT game_id, my_username, {columns} FROM clean"


ORACLE = {
    "pgn_tags": over("parsed") + """
SELECT url, uploaded_at, t_date AS date, t_start AS start_time, t_end AS end_time, link, eco_link AS eco_url,
  4 + (eco_link IS NOT NULL)::BIGINT AS n_tags FROM texts""",
    "pgn_moves": _texts("array_to_string(moves, ' ') AS moves"),
    "pgn_clocks": _texts(
        "array_to_string(list_transform(list_zip(white_nos, white_clks), lambda z: z[1] || '@' || z[2]), ' ') AS white, "
        "array_to_string(list_transform(list_zip(black_nos, black_clks), lambda z: z[1] || '@' || z[2]), ' ') AS black"
    ),
    "time_control_label": over("parsed") + "SELECT url, raw_control AS time_control, control_label AS label FROM parsed",
    "utc_to_est_time": _texts("start_time_est, end_time_est"),
    "est_date_adjust": _texts("strftime(local_day, '%Y.%m.%d') AS date"),
    "time_spent": _texts("time_spent"),
    "process_game": over("parsed") + """
SELECT url, array_to_string(moves, ' ') AS moves, strftime(utc_day, '%Y.%m.%d') AS date, start_time_est, end_time_est, time_spent,
  control_label AS time_control, white_username, black_username, array_to_string(white_clks, ' ') AS white_metamoves,
  array_to_string(black_clks, ' ') AS black_metamoves, link, eco_link AS eco, time_class, rules AS game_type, rated, tcn, uuid,
  initial_setup, fen, rules, white_rating, white_result, black_rating, black_result FROM parsed""",
    "clock_to_seconds": over("parsed") + """
SELECT url, clock, string_split(clock, ':')[1]::DOUBLE * 3600 + string_split(clock, ':')[2]::DOUBLE * 60
  + string_split(clock, ':')[3]::DOUBLE AS seconds FROM (SELECT url, unnest(white_clks) AS clock FROM parsed)""",
    "time_control_seconds": over("parsed") + "SELECT url, raw_control AS time_control, control_s AS seconds FROM parsed",
    "last_mover": _clean("last_mover"),
    "time_left": _clean("my_time_left, opp_time_left"),
    "num_moves": _clean("my_num_moves, opp_num_moves"),
    "time_left_ratio": _clean(
        "round(my_time_left / control_s, 6) AS my_time_left_ratio, round(opp_time_left / control_s, 6) AS opp_time_left_ratio"
    ),
    "split_moves": _clean("array_to_string(my_moves, ' ') AS my_moves, array_to_string(opp_moves, ' ') AS opp_moves"),
    "castling": _clean("my_castling, opp_castling"),
    "promotion_count": _clean("promotion_count"),
    "en_passant_count": _clean("en_passant_count"),
    "clean_games": over("an") + """
SELECT game_id, url AS game_url, ended AS game_end_timestamp, link, date, start_time_est, end_time_est, time_spent,
  control_label AS time_control, control_s AS control_seconds, time_class, rules, rated, tcn, initial_setup, fen, eco,
  array_to_string(moves, ' ') AS moves, my_color, my_username, my_rating, my_result, array_to_string(my_moves, ' ') AS my_moves,
  my_num_moves, my_castling, opp_username, opp_rating, opp_result, array_to_string(opp_moves, ' ') AS opp_moves, opp_num_moves,
  opp_castling, promotion_count, en_passant_count, outcome, my_opening, rating_diff, last_mover, my_time_left, opp_time_left,
  round(my_time_left / control_s, 6) AS my_time_left_ratio, round(opp_time_left / control_s, 6) AS opp_time_left_ratio FROM clean""",
}
