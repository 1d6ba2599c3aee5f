"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

PLAYER = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("rating", T.LongType()),
        T.StructField("result", T.StringType()),
        T.StructField("uuid", T.StringType()),
    ]
)

GAME = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("tcn", T.StringType()),
        T.StructField("pgn", T.StringType()),
        T.StructField("time_control", T.StringType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("rated", T.BooleanType()),
        T.StructField("time_class", T.StringType()),
        T.StructField("rules", T.StringType()),
        T.StructField("fen", T.StringType()),
        T.StructField("initial_setup", T.StringType()),
        T.StructField("white", PLAYER),
        T.StructField("black", PLAYER),
        T.StructField(
            "accuracies",
            T.StructType([T.StructField("white", T.DoubleType()), T.StructField("black", T.DoubleType())]),
        ),
    ]
)

# One JSON document per player and month.
MONTH_ARCHIVE = T.StructType([T.StructField("games", T.ArrayType(GAME))])

RAW_GAMES = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("tcn", T.StringType()),
        T.StructField("pgn", T.StringType()),
        T.StructField("time_control", T.StringType()),
        T.StructField("end_time", T.LongType()),
        T.StructField("rated", T.BooleanType()),
        T.StructField("time_class", T.StringType()),
        T.StructField("rules", T.StringType()),
        T.StructField("fen", T.StringType()),
        T.StructField("initial_setup", T.StringType()),
        T.StructField("white_username", T.StringType()),
        T.StructField("white_rating", T.LongType()),
        T.StructField("white_result", T.StringType()),
        T.StructField("white_uuid", T.StringType()),
        T.StructField("black_username", T.StringType()),
        T.StructField("black_rating", T.LongType()),
        T.StructField("black_result", T.StringType()),
        T.StructField("black_uuid", T.StringType()),
        T.StructField("white_accuracy", T.DoubleType()),
        T.StructField("black_accuracy", T.DoubleType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("loaded_by_user", T.StringType()),
    ]
)

TRACKED_USERNAMES = T.StructType(
    [
        T.StructField("username", T.StringType()),
        T.StructField("added_at", T.DateType()),
        T.StructField("notes", T.StringType()),
    ]
)

RUN_LOG = T.StructType(
    [
        T.StructField("run_at", T.TimestampType()),
        T.StructField("username", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("games_fetched", T.LongType()),
        T.StructField("games_uploaded", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("triggered_by", T.StringType()),
    ]
)
