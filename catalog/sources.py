"""Scans, sources and sinks. Sinks write to the shared folder and the query returns the table read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.functions.calendar import instant, utc_date
from rookery.operators import merge
from rookery.plans import lifetime, warehouse
from rookery.session import stage, work_path
from rookery.sources import landing, sinks

LANDED = (
    "uuid, url, tcn, pgn, time_control, end_time, rated, time_class, rules, fen, initial_setup, "
    "white_username, white_rating, white_result, white_uuid, black_username, black_rating, black_result, black_uuid, "
    "white_accuracy, black_accuracy"
)
# Fixed instants: the loads that the sink queries stamp.
STAMP, RESTAMP = 1736000000, 1736500000


def _archive(spark, folder):
    """Month documents per player, written as JSON and read back."""
    nested = landing.nest_games(src.raw(spark, folder))
    day = utc_date(F.col("game.end_time"))
    path = work_path(spark, "archive")
    (
        nested.select(F.array("game").alias("games"), "loaded_by_user", F.year(day).alias("year"), F.month(day).alias("month"))
        .write.partitionBy("loaded_by_user", "year", "month")
        .option("compression", "gzip")
        .json(path)
    )
    return landing.read_month_archives(spark, path)


def flatten_raw_game(spark, folder):
    return landing.flatten_games(_archive(spark, folder), keep=["loaded_by_user"])


def scan_raw_games(spark, folder):
    path = work_path(spark, "raw_games")
    src.raw(spark, folder).write.parquet(path)
    return src.edge(landing.scan_raw_games(spark, path))


def seed_tracked_usernames(spark, folder):
    path = work_path(spark, "tracked")
    src.tracked(spark, folder).write.option("header", "true").csv(path)
    return landing.tracked_usernames(spark, path)


def archive_month_prune(spark, folder):
    pruned = landing.month_prune(_archive(spark, folder), 2024, (2024, 6))
    return pruned.groupBy("loaded_by_user", "year", "month").agg(
        F.count("*").alias("games"), F.max("game.end_time").alias("last_end")
    )


def append_raw_games(spark, folder):
    path = work_path(spark, "landing")
    rows = src.raw(spark, folder)
    early = F.unix_seconds("uploaded_at") < src.BATCH_SPLIT
    for part, stamp in ((rows.filter(early), STAMP), (rows.filter(~early), RESTAMP)):
        batch = landing.with_load_metadata(part, F.upper("loaded_by_user"), instant(F.lit(stamp)))
        if stamp == RESTAMP:
            batch = batch.withColumn("event_name", F.concat(F.lit("cup-"), F.col("tcn")))
        landing.append_raw_games(batch, path)
    return src.edge(landing.scan_raw_games(spark, path)).drop("pgn")


def write_table(spark, folder):
    path = work_path(spark, "table")
    rows = src.raw(spark, folder).select("uuid", "time_class", "end_time")
    sinks.write_table(rows, path, "truncate")
    sinks.write_table(rows.filter("time_class = 'daily'"), path, "append")
    sinks.write_table(rows.filter("time_class = 'none such'"), path, "append")
    return spark.read.parquet(path)


def upsert_by_key(spark, folder):
    path = work_path(spark, "upserted")
    rows = warehouse.deduped(src.raw(spark, folder)).drop("pgn")
    first = F.unix_seconds("uploaded_at") < src.BATCH_SPLIT
    merge.merge_upsert(spark, path, rows.filter(first), ["uuid"], ["uploaded_at"])
    again = rows.filter(~first | F.col("rated")).withColumns(
        {"uploaded_at": instant(F.lit(RESTAMP)), "time_control": F.lit("changed")}
    )
    merge.merge_upsert(spark, path, again, ["uuid"], ["uploaded_at"])
    return src.edge(spark.read.parquet(path))


def export_games(spark, folder):
    csv_path, json_path = work_path(spark, "games_csv"), work_path(spark, "games_json")
    # parsed once for both formats
    games = stage(
        src.analysis(spark, folder).select(
            "game_id", "my_username", "date", "moves", "my_rating", "outcome", "my_time_left", "link"
        ),
        "games",
    )
    sinks.export_csv(games, csv_path)
    sinks.export_json(games, json_path)
    from_csv = spark.read.option("header", "true").option("escape", '"').schema(
        "game_id string, my_username string, date date, moves string, my_rating bigint, outcome string, "
        "my_time_left double, link string"
    ).csv(csv_path).withColumn("format", F.lit("csv"))
    from_json = spark.read.schema(games.schema).json(json_path).withColumn("moves", F.to_json("moves")).withColumn(
        "format", F.lit("json")
    )
    return from_csv.unionByName(from_json)


def export_statistics_json(spark, folder):
    path = work_path(spark, "documents")
    # written once, as the statistics read it several times
    games = stage(src.analysis(spark, folder).drop("moves", "my_moves", "opp_moves"), "analysis")
    sinks.export_statistics(lifetime.total_statistics(games), path)
    return spark.read.option("wholetext", "false").text(path).select("my_username", F.col("value").alias("document"))


def _runs(spark, folder):
    batch = src.raw(spark, folder).groupBy(F.coalesce("loaded_by_user", F.lit("unknown")).alias("username")).agg(
        F.count("*").alias("games_fetched"), F.count("uuid").alias("games_uploaded")
    )
    failed = F.col("games_fetched") - F.col("games_uploaded") > 6
    return batch.select(
        instant(F.lit(STAMP)).alias("run_at"), "username",
        F.when(failed, "failed").otherwise("success").alias("status"), "games_fetched", "games_uploaded",
        (F.col("games_fetched") / F.lit(7.0)).alias("duration_seconds"),
        F.when(failed, "rows without key").alias("error_message"), F.lit(None).cast("string").alias("triggered_by"),
    )


def ingest_run_log(spark, folder):
    path = work_path(spark, "runs")
    sinks.append_run_log(_runs(spark, folder), path)
    return src.edge(sinks.read_run_log(spark, path))


def ingest_run_summary(spark, folder):
    return sinks.run_log_summary(sinks.run_log_rows(_runs(spark, folder)))


def ingest_failed_usernames(spark, folder):
    return sinks.failed_usernames(sinks.run_log_rows(_runs(spark, folder)))


def materialize(spark, folder):
    staged = sinks.materialize(src.staged(spark, folder), "rookery_staged", "view")
    games = sinks.materialize(
        warehouse.player_games_unpivot(staged).select("my_username", "game_id", "my_color", "my_rating"),
        "rookery_games", "table", work_path(spark, "rookery_games"),
    )
    return games.groupBy("my_username", "my_color").agg(F.count("*").alias("games"), F.max("my_rating").alias("best"))


def layout_month_partition(spark, folder):
    path = work_path(spark, "facts")
    sinks.write_month_layout(src.facts(spark, folder), path, "game_date", ["my_username", "time_class"])
    stored = spark.read.parquet(path).filter(F.col(sinks.MONTH_COLUMN) >= F.lit("2024-03-01").cast("date"))
    return stored.select("player_game_key", "game_date", F.col(sinks.MONTH_COLUMN).alias("game_month_start"), "my_username", "time_class")


QUERIES = {
    f.__name__: f
    for f in (
        flatten_raw_game, scan_raw_games, seed_tracked_usernames, archive_month_prune, append_raw_games, write_table,
        upsert_by_key, export_games, export_statistics_json, ingest_run_log, ingest_run_summary, ingest_failed_usernames,
        materialize, layout_month_partition,
    )
}

_RUNS = """
runlog AS (
  SELECT make_timestamp(1736000000000000) AS run_at, username, if(f - u > 6, 'failed', 'success') AS status,
    f AS games_fetched, u AS games_uploaded, round(f / 7.0, 2)::DOUBLE AS duration_seconds,
    if(f - u > 6, 'rows without key', '') AS error_message, 'local' AS triggered_by
  FROM (SELECT coalesce(loaded_by_user, 'unknown') AS username, count(*) AS f, count(uuid) AS u FROM raw GROUP BY 1))"""

# The statistics document, field by field in its order.
_BIGGEST = {
    "victory": ("rating_diff", "outcome = 'win'", ()), "upset": ("rating_diff DESC", "outcome = 'lose'", ()),
    "checkmate": ("time_spent", "opp_result = 'checkmated'", ("time_spent", "my_num_moves")),
    "opponent": ("opp_rating DESC", "outcome = 'win'", ()), "longest": ("time_spent DESC", "true", ("time_spent",)),
    "moves": ("my_num_moves DESC", "true", ("my_num_moves",)),
    "least_time_won": ("my_time_left", "outcome = 'win'", ("my_time_left",)),
    "least_time_lost": ("opp_time_left", "outcome = 'lose'", ("opp_time_left",)),
}
_NAMED = "['win', 'checkmated', 'timeout', 'timevsinsufficient', 'resigned', 'stalemate', 'repetition', 'abandoned', 'insufficient', 'agreed']"
_LAST = ("blitz", "rapid", "bullet")


def _object(fields: dict[str, str]) -> str:
    return "json_object(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _counted(column: str, *values: str) -> str:
    return _object({v: f"count(*) FILTER ({column} = '{v}')" for v in values})


def _biggest(name: str, order: str, which: str, extra: tuple[str, ...]) -> str:
    fields = _object({f: f for f in ("opp_username", "opp_rating", "time_class", *extra, "date", "link")})
    return f"""
big_{name} AS (SELECT my_username, {fields} AS {name} FROM (
  SELECT DISTINCT ON (my_username) * FROM an WHERE {which} ORDER BY my_username, {order}, ended, game_id))"""


def _spelt(seconds: str) -> str:
    return f"format('{{}} days {{}} hours {{}} minutes {{}} seconds', {seconds} // 86400, {seconds} // 3600 % 24, {seconds} // 60 % 60, {seconds} % 60)"


_DOCUMENT = ",".join(_biggest(n, *s) for n, s in _BIGGEST.items()) + "".join(
    f""",
last_{c} AS (SELECT my_username, json_object('date', date, 'my_rating', my_rating) AS {c} FROM (
  SELECT DISTINCT ON (my_username) * FROM an WHERE time_class = '{c}' ORDER BY my_username, date DESC, ended DESC, game_id DESC))"""
    for c in _LAST
) + f""",
isles AS (SELECT my_username, outcome, row_number() OVER (PARTITION BY my_username ORDER BY ended, game_id)
    - row_number() OVER (PARTITION BY my_username, outcome ORDER BY ended, game_id) AS isle FROM an),
longest_run AS (SELECT my_username, ifnull(max(n) FILTER (outcome = 'win'), 0) AS won, ifnull(max(n) FILTER (outcome = 'lose'), 0) AS lost
  FROM (SELECT my_username, outcome, isle, count(*) AS n FROM isles GROUP BY ALL) GROUP BY 1),
day AS (SELECT DISTINCT ON (my_username) my_username, json_object('date', date::VARCHAR, 'time_spent', {_spelt("(s % 31536000)")}) AS day
  FROM (SELECT my_username, date, sum(time_spent)::BIGINT AS s FROM an GROUP BY ALL) ORDER BY my_username, s DESC, date),
peak AS (SELECT DISTINCT ON (my_username) my_username, json_object('rating', my_rating, 'time_control', time_class, 'date', date) AS peak
  FROM an ORDER BY my_username, my_rating DESC, ended, game_id),
often AS (SELECT my_username, my_opening, count(*) AS n FROM an WHERE my_opening <> 'N/A' GROUP BY ALL),
whites AS (SELECT DISTINCT ON (my_username) * FROM often WHERE NOT contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening),
blacks AS (SELECT DISTINCT ON (my_username) * FROM often WHERE contains(my_opening, 'Defense') ORDER BY my_username, n DESC, my_opening),
rivals AS (SELECT my_username, list(json_object('opponent', opp_username, 'games_played', n) ORDER BY place) AS rivals FROM (
  SELECT *, row_number() OVER (PARTITION BY my_username ORDER BY n DESC, opp_username) AS place
  FROM (SELECT my_username, opp_username, count(*) AS n FROM an GROUP BY ALL)) WHERE place <= 5 GROUP BY 1),
tally AS (
  SELECT my_username, 'control' AS what, 1 AS place, control_label AS item, count(*) AS n FROM an GROUP BY ALL
  UNION ALL SELECT my_username, 'result', 2, my_result, count(*) FROM an WHERE NOT list_contains({_NAMED}, my_result) GROUP BY ALL
  UNION ALL SELECT my_username, 'result', 1, r, (SELECT count(*) FROM an WHERE an.my_username = p.my_username AND my_result = r)
    FROM (SELECT DISTINCT my_username, unnest({_NAMED}) AS r FROM an) p),
tallies AS (SELECT my_username, what, concat('{{', string_agg(concat(to_json(item), ':', n), ',' ORDER BY place,
    if(what = 'result' AND place = 1, list_position({_NAMED}, item), 0), item), '}}')::JSON AS tallies FROM tally GROUP BY ALL),
sums AS (SELECT my_username, {_counted("my_castling", "kingside", "queenside", "none")} AS castling,
    {_counted("outcome", "win", "draw", "lose")} AS outcomes, {_counted("time_class", "blitz", "rapid", "bullet", "daily")} AS classes,
    sum(time_spent)::BIGINT AS s, s % 31536000 AS rest, sum(my_num_moves)::BIGINT AS total_moves, sum(en_passant_count)::BIGINT AS passant,
    sum(promotion_count)::BIGINT AS promotions, count(*) AS games FROM an GROUP BY 1)"""

_UNITS = {"days": 86400, "hours": 3600, "minutes": 60}
_SPENT = {
    "years": "(s // 31536000)::DOUBLE", "days": "(rest // 86400)::DOUBLE", "hours": "(rest // 3600 % 24)::DOUBLE",
    "minutes": "(rest // 60 % 60)::DOUBLE", "seconds": "(rest % 60)::DOUBLE", "total_time": _spelt("rest"),
    **{f"total_time_in_{u}": f"((rest * 200 + {n}) // {2 * n})::DOUBLE / 100" for u, n in _UNITS.items()},
    "total_time_in_seconds": "'@rest'", "percentage_of_year": "((rest * 20000 + 31536000) // 63072000)::DOUBLE / 100",
}
# Spark writes numbers from ten million on with an exponent, which JSON functions would spell out again.
_DOCUMENT_ROWS = "SELECT my_username, replace(" + _object({
    "my_username": "my_username", "castling_counts": "castling", "total_time_spent": _object(_SPENT), "total_moves": "total_moves",
    "total_win_draw_loss": "outcomes", "total_results": "r.tallies", "total_en_passant": "passant", "total_promotions": "promotions",
    "total_games": "games", "longest_winning_streak": "won", "longest_losing_streak": "lost", "most_played_opponent": "rivals",
    "highest_rating": "peak", "most_time_spent_day_dict": "day",
    "my_openings": "json_object('white_opening', whites.my_opening, 'black_opening', blacks.my_opening)",
    "timeclass_counts": "classes", "timecontrol_counts": "c.tallies", "biggest_games": _object({n: n for n in _BIGGEST}),
    "last_game_ratings": _object({c: c for c in _LAST}),
}) + """::VARCHAR, '"@rest"', CASE WHEN rest < 10000000 THEN concat(rest, '.0') WHEN rest % 10000000 = 0 THEN concat(rest // 10000000, '.0E7')
    ELSE concat(rest // 10000000, '.', rtrim(lpad((rest % 10000000)::VARCHAR, 7, '0'), '0'), 'E7') END) AS document
FROM sums JOIN longest_run USING (my_username) JOIN day USING (my_username) JOIN peak USING (my_username) JOIN rivals USING (my_username)
  JOIN tallies r ON r.my_username = sums.my_username AND r.what = 'result'
  JOIN tallies c ON c.my_username = sums.my_username AND c.what = 'control'
  LEFT JOIN whites USING (my_username) LEFT JOIN blacks USING (my_username)
""" + "".join(f"  LEFT JOIN {t} USING (my_username)\n" for t in [*(f"big_{n}" for n in _BIGGEST), *(f"last_{c}" for c in _LAST)])

ORACLE = {
    "flatten_raw_game": over("raw") + f"SELECT {LANDED}, loaded_by_user FROM raw",
    "scan_raw_games": over("raw") + "SELECT * FROM raw",
    "seed_tracked_usernames": over("tracked") + "SELECT * FROM tracked",
    "archive_month_prune": over("raw") + """
SELECT loaded_by_user, 2024::INTEGER AS year, month(make_timestamp(end_time * 1000000))::INTEGER AS month,
  count(*) AS games, max(end_time) AS last_end
FROM raw WHERE end_time >= epoch(TIMESTAMP '2024-06-01') AND end_time < epoch(TIMESTAMP '2025-01-01') GROUP BY ALL""",
    "append_raw_games": over("raw") + f"""
SELECT {LANDED.replace("pgn, ", "")},
  make_timestamp(if(epoch(uploaded_at) < 1735690100, 1736000000, 1736500000)::BIGINT * 1000000) AS uploaded_at,
  upper(loaded_by_user) AS loaded_by_user, if(epoch(uploaded_at) < 1735690100, NULL, 'cup-' || tcn) AS event_name
FROM raw WHERE uuid IS NOT NULL""",
    "write_table": over("raw") + """
SELECT uuid, time_class, end_time FROM raw UNION ALL SELECT uuid, time_class, end_time FROM raw WHERE time_class = 'daily'""",
    "upsert_by_key": over("stg") + f"""
SELECT * EXCLUDE (pgn, uploaded_at, time_control, loaded_by_user),
  if(epoch(uploaded_at) < 1735690100, time_control, 'changed') AS time_control, loaded_by_user,
  if(epoch(uploaded_at) < 1735690100 AND NOT rated, uploaded_at, make_timestamp(1736500000000000)) AS uploaded_at
FROM latest""",
    "export_games": over("an") + """
SELECT game_id, my_username, date, to_json(moves)::VARCHAR AS moves, my_rating, outcome, my_time_left, link, f AS format
FROM an, (VALUES ('csv'), ('json')) v(f)""",
    "export_statistics_json": over("an", extra=_DOCUMENT) + _DOCUMENT_ROWS,
    "ingest_run_log": over("raw", extra=_RUNS) + "SELECT * FROM runlog",
    "ingest_run_summary": over("raw", extra=_RUNS) + """
SELECT sum(games_fetched)::BIGINT AS total_fetched, sum(games_uploaded)::BIGINT AS total_uploaded,
  count(*) FILTER (status = 'failed') AS failed_runs FROM runlog""",
    "ingest_failed_usernames": over("raw", extra=_RUNS) + "SELECT username FROM runlog WHERE status = 'failed'",
    "materialize": over("stg") + """
SELECT u AS my_username, c AS my_color, count(*) AS games, max(r) AS best FROM (
  SELECT white_username AS u, 'white' AS c, white_rating AS r FROM stg
  UNION ALL SELECT black_username, 'black', black_rating FROM stg) GROUP BY ALL""",
    "layout_month_partition": over("pg") + """
SELECT player_game_key, game_date, date_trunc('month', game_date)::DATE AS game_month_start, my_username, time_class
FROM pg WHERE game_date >= DATE '2024-03-01'""",
}
