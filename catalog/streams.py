"""The daily job as a stream: files land in two loads, each run takes what is new."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.session import work_path
from rookery.sources import sinks
from rookery.streaming import refresh_stream


def _streamed(spark, folder, late_first=False):
    landing, games, statistics, checkpoint = (work_path(spark, n) for n in ("landing", "games", "statistics", "stream"))
    raw = src.raw(spark, folder)  # each load makes the texts of its own rows only
    early = F.unix_seconds("uploaded_at") < src.BATCH_SPLIT
    loads = (raw.filter(early), raw.filter(~early))
    for load in reversed(loads) if late_first else loads:
        load.write.mode("append").option("compression", "zstd").parquet(landing)
        refresh_stream.run_available(spark, landing, games, statistics, checkpoint)
    return games, statistics


def stream_fct_games(spark, folder):
    games = spark.read.parquet(_streamed(spark, folder)[0])
    return src.edge(games.select("player_game_key", "my_username", "my_accuracy", "opp_accuracy", "outcome"))


def stream_fct_games_late_first(spark, folder):
    """The later uploads arrive first: the older ones that follow change nothing."""
    games = spark.read.parquet(_streamed(spark, folder, late_first=True)[0])
    return src.edge(games.drop("fact_updated_at", "loaded_at", sinks.MONTH_COLUMN))


def stream_user_statistics(spark, folder):
    return spark.read.parquet(_streamed(spark, folder)[1]).drop("fact_updated_at", sinks.MONTH_COLUMN)


def stream_event_counts(spark, folder):
    """Event counts over two loads of the event table."""
    landing, counts, checkpoint = (work_path(spark, n) for n in ("events", "counts", "stream"))
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    for load in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        load.write.mode("append").parquet(landing)
        refresh_stream.run_event_counts(spark, landing, counts, checkpoint)
    return spark.read.parquet(counts).select("user_id", "day", "event_type", "n")


QUERIES = {f.__name__: f for f in (stream_fct_games, stream_fct_games_late_first, stream_user_statistics, stream_event_counts)}

ORACLE = {
    "stream_fct_games": over("pg") + "SELECT player_game_key, my_username, my_accuracy, opp_accuracy, outcome FROM pg",
    "stream_fct_games_late_first": over("pg") + """
SELECT * EXCLUDE (eco_slug_raw, uploaded_at, loaded_by_user), md5(my_username) AS user_key, uploaded_at AS values_at FROM pg""",
    "stream_user_statistics": over("ustats") + "SELECT * FROM ustats",
    "stream_event_counts": "SELECT user_id, ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
