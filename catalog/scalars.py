"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions import calendar as cal
from rookery.functions import durations, scoring
from rookery.plans import lifetime


def win_rate(spark, folder):
    """Four decimals and two, and NULL where a player never had that colour in that class."""
    games = src.player_games(spark, folder).groupBy("my_username", "my_color", "game_day").agg(
        F.count_if((F.col("outcome") == "win") & (F.col("time_class") == "daily")).alias("wins"),
        F.count_if(F.col("time_class") == "daily").alias("n"),
    )
    wins, n = F.col("wins"), F.col("n")
    return games.select("*", scoring.win_rate(wins, n).alias("rate4"), scoring.win_rate(wins, n, 2).alias("rate2"))


def current_season(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select("o_orderkey", cal.season(F.to_date("o_orderdate")).alias("season"))


def seconds_to_units(spark, folder):
    spent = lifetime.time_by_day(src.analysis(spark, folder)).select(
        "my_username", "date", (F.col("time_spent") * 1009).alias("seconds")
    )
    units = spent.select("my_username", "date", durations.seconds_to_units(F.col("seconds")).alias("u"))
    return src.edge(units.select("my_username", "date", "u.*"))


def nullif_division(spark, folder):
    games = src.player_games(spark, folder).groupBy("my_username", "game_day").agg(
        F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("time_class") == "bullet").alias("n")
    )
    return games.select("my_username", "game_day", F.round(F.try_divide("wins", "n"), 4).alias("rate"))


def string_functions(spark, folder):
    end = cal.utc_date(F.col("end_time"))
    return src.raw(spark, folder).select(
        "url", F.lower("white_username").alias("lowered"), F.concat("black_username", F.lit("_"), F.year(end).cast("string")).alias("joined"),
        F.col("end_time").cast("string").alias("text"), F.date_format(end, "EEEE").alias("weekday"),
    )


def date_functions(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    day = F.to_date("o_orderdate")
    return orders.select(
        "o_orderkey", cal.month_start(day).alias("month"), F.year(day).alias("year"), F.quarter(day).alias("quarter"),
        F.dayofweek(day).alias("day_of_week"), cal.utc_wall_clock(cal.instant(F.col("o_orderkey") * 1000)).alias("instant"),
        (day > F.current_date()).alias("in_future"),
    )


def regex_functions(spark, folder):
    slug = F.nullif(F.regexp_extract("p_name", r"^(\w+)\s", 1), F.lit(""))
    part = spark.read.parquet(f"{folder}/part.parquet")
    return part.select("p_partkey", slug.alias("first_word"), F.col("p_type").rlike("(BRASS|STEEL)$").alias("is_metal"))


def math_functions(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 8).alias("unit_price"),
        F.ceil(F.col("l_quantity") / 3).alias("packs"), (F.col("l_quantity") - F.lit(10)).alias("over_ten"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        win_rate, current_season, seconds_to_units, nullif_division, string_functions, date_functions, regex_functions,
        math_functions,
    )
}

ORACLE = {
    "win_rate": over("pg") + """
SELECT *, round(wins / nullif(n, 0), 4) AS rate4, round(wins / nullif(n, 0), 2) AS rate2 FROM (
  SELECT my_username, my_color, game_day, count(*) FILTER (outcome = 'win' AND time_class = 'daily') AS wins,
    count(*) FILTER (time_class = 'daily') AS n FROM pg GROUP BY ALL)""",
    "current_season": "SELECT o_orderkey, concat(year(o_orderdate), '-Q', quarter(o_orderdate)) AS season FROM orders",
    "seconds_to_units": over("an") + """
, s AS (SELECT my_username, date, sum(time_spent)::BIGINT * 1009 AS t FROM an GROUP BY ALL),
r AS (SELECT *, t // 31536000 AS y, t % 31536000 AS rest FROM s)
SELECT my_username, date, y::DOUBLE AS years, (rest // 86400)::DOUBLE AS days, (rest // 3600 % 24)::DOUBLE AS hours,
  (rest // 60 % 60)::DOUBLE AS minutes, (rest % 60)::DOUBLE AS seconds,
  format('{} days {} hours {} minutes {} seconds', rest // 86400, rest // 3600 % 24, rest // 60 % 60, rest % 60) AS total_time,
  (rest * 200 + 86400) // 172800 / 100 AS total_time_in_days, (rest * 200 + 3600) // 7200 / 100 AS total_time_in_hours,
  (rest * 200 + 60) // 120 / 100 AS total_time_in_minutes, rest::DOUBLE AS total_time_in_seconds,
  (rest * 20000 + 31536000) // 63072000 / 100 AS percentage_of_year FROM r""",
    "nullif_division": over("pg") + """
SELECT my_username, game_day, round(count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (time_class = 'bullet'), 0), 4) AS rate
FROM pg GROUP BY ALL""",
    "string_functions": over("raw") + """
SELECT url, lower(white_username) AS lowered, black_username || '_' || year(make_timestamp(end_time * 1000000)) AS joined,
  end_time::VARCHAR AS text, dayname(make_timestamp(end_time * 1000000)) AS weekday FROM raw""",
    "date_functions": """
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS month, year(o_orderdate)::INTEGER AS year,
  quarter(o_orderdate)::INTEGER AS quarter, (dayofweek(o_orderdate) + 1)::INTEGER AS day_of_week,
  make_timestamp(o_orderkey * 1000000000) AS instant, o_orderdate::DATE > current_date AS in_future FROM orders""",
    "regex_functions": r"""
SELECT p_partkey, nullif(regexp_extract(p_name, '^(\w+)\s', 1), '') AS first_word,
  regexp_matches(p_type, '(BRASS|STEEL)$') AS is_metal FROM part""",
    "math_functions": """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) AS unit_price, ceil(l_quantity / 3)::BIGINT AS packs,
  l_quantity - 10 AS over_ten FROM lineitem""",
}
