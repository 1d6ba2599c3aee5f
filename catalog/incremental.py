"""Refreshes in two batches; each query returns the end state, the SQL says what it must be."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.joins import HISTORY
from catalog.oracle_tables import over
from rookery.functions.calendar import instant, utc_date
from rookery.plans import ingest, refresh, warehouse
from rookery.session import stage, work_path
from rookery.sources import landing, sinks


def _batches(spark, folder):
    """The landing before and after the second load."""
    raw = stage(src.raw(spark, folder), "raw_games")
    return raw.filter(F.unix_seconds("uploaded_at") < src.BATCH_SPLIT), raw


def _facts_after(spark, folder):
    path = work_path(spark, "fct_games")
    for state in _batches(spark, folder):
        refresh.refresh_fct_games(spark, state, path)
    return path


def fct_games_incremental(spark, folder):
    return src.edge(spark.read.parquet(_facts_after(spark, folder)).drop("fact_updated_at", refresh.VALUES_AT, sinks.MONTH_COLUMN))


def fct_my_games_incremental(spark, folder):
    facts_path, path = work_path(spark, "fct_games"), work_path(spark, "fct_my_games")
    for state in _batches(spark, folder):
        refresh.refresh_fct_games(spark, state, facts_path)
        refresh.refresh_my_games(spark, spark.read.parquet(facts_path), path, src.OWNER)
    stored = spark.read.parquet(path)
    return src.edge(stored.select("player_game_key", "game_id", "my_accuracy", "opp_accuracy", "outcome", "loaded_at"))


def _statistics(spark, path):
    return spark.read.parquet(path).drop("fact_updated_at", sinks.MONTH_COLUMN)


def fct_user_statistics_incremental(spark, folder):
    """Strict refresh: two halves of the year, the totals carried on."""
    path = work_path(spark, "fct_user_statistics")
    games = stage(src.player_games(spark, folder), "player_games")
    refresh.refresh_user_statistics(spark, games.filter(F.col("game_month") <= 6), path, "strict")
    refresh.refresh_user_statistics(spark, games, path, "strict")
    return _statistics(spark, path)


def fct_user_statistics_repair(spark, folder):
    """Repair refresh: late games on every day of the year."""
    path = work_path(spark, "fct_user_statistics")
    before, after = _batches(spark, folder)
    refresh.refresh_user_statistics(spark, warehouse.int_player_games(before), path)
    changed = warehouse.int_player_games(after.filter(F.unix_seconds("uploaded_at") >= src.BATCH_SPLIT))
    refresh.refresh_user_statistics(spark, stage(warehouse.int_player_games(after), "games"), path, "repair", stage(changed, "changed"))
    return _statistics(spark, path)


def snapshot_check(spark, folder):
    """Three looks at the players; every version with its validity."""
    path = work_path(spark, "snap_users")
    games, staged = stage(src.player_games(spark, folder), "player_games"), src.staged(spark, folder)
    for day, seen in enumerate(("game_month <= 6", "time_class <> 'daily'", "true"), start=1):
        users = warehouse.dim_users(staged, games.filter(seen))
        refresh.refresh_snapshot(spark, users, path, instant(F.lit(1735689600 + day * 86400)))
    return src.edge(spark.read.parquet(path).select(
        "user_key", "username", "total_games", "current_rating", "win_rate", "valid_from", "valid_to"
    ))


def snapshot_current(spark, folder):
    path = work_path(spark, "snap_users")
    games, staged = stage(src.player_games(spark, folder), "player_games"), src.staged(spark, folder)
    for day, seen in enumerate(("game_month <= 6", "true"), start=1):
        refresh.refresh_snapshot(spark, warehouse.dim_users(staged, games.filter(seen)), path, instant(F.lit(1735689600 + day * 86400)))
    current = refresh.snapshot_current(spark.read.parquet(path))
    return src.edge(current.select("username", "total_games", "peak_rating", "valid_from"))


def _ingested(spark, folder):
    """Two loads of all followed players: the months up to June, then the whole archive."""
    landing_path, log_path = work_path(spark, "landing"), work_path(spark, "runs")
    nested = landing.nest_games(src.raw(spark, folder))
    day = utc_date(F.col("game.end_time"))
    archive = stage(nested.withColumns({"year": F.year(day), "month": F.month(day)}), "archive", ["year", "month"])
    tracked = stage(src.tracked(spark, folder), "tracked")
    ingest.ingest(spark, archive.filter("month <= 6"), tracked, landing_path, log_path, uploaded_at=instant(F.lit(1736000000)))
    ingest.ingest(spark, archive, tracked, landing_path, log_path, uploaded_at=instant(F.lit(1736500000)))
    return landing_path, log_path


def ingest_user(spark, folder):
    landed = landing.scan_raw_games(spark, _ingested(spark, folder)[0])
    return src.edge(landed.select("uuid", "url", "end_time", "white_username", "black_username", "loaded_by_user", "uploaded_at"))


def ingest_user_audit(spark, folder):
    log = sinks.read_run_log(spark, _ingested(spark, folder)[1])
    return src.edge(log.drop("duration_seconds"))


QUERIES = {
    f.__name__: f
    for f in (
        fct_games_incremental, fct_my_games_incremental, fct_user_statistics_incremental, fct_user_statistics_repair,
        snapshot_check, snapshot_current, ingest_user, ingest_user_audit,
    )
}

# A game first landed in the first load keeps its first values but for five columns.
_MERGED = """
first_up AS (SELECT game_id, min(uploaded_at) AS first_at, max(uploaded_at) AS last_at FROM (
  SELECT uuid AS game_id, uploaded_at FROM raw WHERE uuid IS NOT NULL AND white_username IS NOT NULL) GROUP BY 1),
merged AS (
  SELECT pg.* EXCLUDE (eco_slug_raw, uploaded_at, loaded_by_user),
    if(epoch(first_at) < 1735690100, first_at, last_at) AS loaded_at, md5(my_username) AS user_key
  FROM pg JOIN first_up USING (game_id))"""

# What each followed player brings, in two loads. The first follower by name lands a shared game.
_LANDINGS = """
brought AS (
  SELECT uuid, url, end_time, white_username, black_username, loaded_by_user,
    month(make_timestamp(end_time * 1000000)) <= 6 AS early
  FROM raw r WHERE uuid IS NOT NULL AND lower(loaded_by_user) = (
    SELECT min(lower(o.loaded_by_user)) FROM raw o WHERE o.uuid = r.uuid AND upper(o.loaded_by_user) IN (SELECT username FROM tracked))),
marks AS (
  SELECT player, max(month(make_timestamp(end_time * 1000000))) AS m FROM (
    SELECT end_time, unnest([lower(white_username), lower(black_username)]) AS player FROM brought WHERE early) GROUP BY 1),
again AS (
  SELECT r.*, month(make_timestamp(end_time * 1000000)) AS m, lower(loaded_by_user) AS player FROM raw r
  WHERE upper(loaded_by_user) IN (SELECT username FROM tracked)),
landed_now AS (
  SELECT uuid, url, end_time, white_username, black_username, loaded_by_user,
    make_timestamp(if(early, 1736000000, 1736500000)::BIGINT * 1000000) AS uploaded_at FROM brought)"""

ORACLE = {
    "fct_games_incremental": over("pg", extra=_MERGED) + "SELECT * FROM merged",
    "fct_my_games_incremental": over("pg", extra=_MERGED) + """
-- A merge leaves loaded_at alone, so changed games of the first load stay behind the mark of this table.
, own AS (
  SELECT uuid AS game_id, uploaded_at, if(white_username = 'Player7', white_accuracy, black_accuracy) AS mine,
    if(white_username = 'Player7', black_accuracy, white_accuracy) AS theirs FROM raw)
SELECT player_game_key, game_id, own.mine AS my_accuracy, own.theirs AS opp_accuracy, outcome, loaded_at
FROM merged JOIN own USING (game_id) WHERE my_username = 'Player7' AND own.uploaded_at = merged.loaded_at""",
    "fct_user_statistics_incremental": over("ustats") + "SELECT * FROM ustats",
    "fct_user_statistics_repair": over("ustats") + "SELECT * FROM ustats",
    "snapshot_check": over("dim", extra=HISTORY) + """
SELECT md5(username) AS user_key, username, total_games, current_rating, win_rate, valid_from, valid_to FROM history""",
    "snapshot_current": over("dim", extra=HISTORY) + """
SELECT username, total_games, peak_rating, TIMESTAMP '2025-01-03 00:00:00' AS valid_from FROM look WHERE d = 3""",
    "ingest_user": over("raw", "tracked", extra=_LANDINGS) + "SELECT * FROM landed_now",
    "ingest_user_audit": over("raw", "tracked", extra=_LANDINGS) + """
, fetched AS (
  SELECT 1736000000 AS t, player, count(*) AS n FROM again WHERE m <= 6 GROUP BY ALL
  UNION ALL
  SELECT 1736500000, a.player, count(*) FROM again a LEFT JOIN marks k ON k.player = a.player
  WHERE k.m IS NULL OR a.m >= k.m GROUP BY ALL),
uploaded AS (SELECT epoch(uploaded_at) AS t, lower(loaded_by_user) AS player, count(*) AS n FROM landed_now GROUP BY ALL)
SELECT make_timestamp(l.t::BIGINT * 1000000) AS run_at, username, if(f.n IS NULL, 'skipped', 'success') AS status,
  ifnull(f.n, 0) AS games_fetched, ifnull(u.n, 0) AS games_uploaded, '' AS error_message, 'local' AS triggered_by
FROM tracked CROSS JOIN (VALUES (1736000000), (1736500000)) l(t)
LEFT JOIN fetched f ON f.t = l.t AND f.player = lower(username) LEFT JOIN uploaded u ON u.t = l.t AND u.player = lower(username)""",
}
