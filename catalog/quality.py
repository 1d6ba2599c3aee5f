"""Declared data tests over the models, and over inputs that fail them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.plans import quality, warehouse
from rookery.session import stage


def _report(frames):
    report = None
    for name, df in frames.items():
        part = quality.model_report(name, df)
        report = part if report is None else report.unionByName(part)
    return report


def model_tests(spark, folder):
    """All 46 declared column tests, one row each."""
    raw = stage(src.raw(spark, folder), "raw_games")
    games = stage(warehouse.int_player_games(raw), "player_games")
    facts = stage(warehouse.fct_games(games), "fct_games")
    own = warehouse.my_games(facts, src.OWNER)
    return _report(
        {
            "raw_games": raw,
            "stg_raw_games": warehouse.stg_raw_games(raw).drop("pgn"),
            "int_player_games": games,
            "fct_my_games": own,
            "my_daily_stats": warehouse.my_daily_stats(own),
            "dim_users": warehouse.dim_users(warehouse.staged_games(raw), games),
            "fct_games": facts,
            "fct_user_statistics": warehouse.fct_user_statistics(games),
        }
    )


def dq_not_null(spark, folder):
    return quality.not_null(src.raw(spark, folder), ("uuid", "white_username", "white_accuracy", "uploaded_at"))


def dq_unique(spark, folder):
    return quality.unique(src.raw(spark, folder), "uuid")


def dq_accepted_values(spark, folder):
    return quality.accepted_values(src.raw(spark, folder), "time_class", ("blitz", "rapid", "bullet"))


def no_future_games(spark, folder):
    late = quality.no_future_games(src.staged(spark, folder), F.lit("2024-12-01").cast("date"))
    return src.edge(late)


def outcomes_sum_to_total(spark, folder):
    return quality.outcomes_sum_to_total(src.user_statistics(spark, folder))


def outcomes_sum_broken(spark, folder):
    """The same check on statistics whose draws were lost."""
    return quality.outcomes_sum_to_total(src.user_statistics(spark, folder).withColumn("draws", F.lit(0).cast("bigint")))


def tracked_users_present(spark, folder):
    return quality.tracked_users_present(src.tracked(spark, folder), src.facts(spark, folder))


def assertions(spark, folder):
    return quality.assertion_report(
        src.staged(spark, folder), src.user_statistics(spark, folder), src.tracked(spark, folder), src.facts(spark, folder)
    )


def null_profile(spark, folder):
    return quality.null_profile(src.raw(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        model_tests, dq_not_null, dq_unique, dq_accepted_values, no_future_games, outcomes_sum_to_total,
        outcomes_sum_broken, tracked_users_present, assertions, null_profile,
    )
}

_LANDED = (
    "uuid url tcn pgn time_control end_time rated time_class rules fen initial_setup white_username white_rating white_result "
    "white_uuid black_username black_rating black_result black_uuid white_accuracy black_accuracy uploaded_at loaded_by_user"
).split()

# Test names by model; every count must be 0 but for missing keys in the landing.
_DECLARED = {
    model: [f"not_null:{c}" for c in tests.not_null] + [f"accepted_values:{c}" for c in tests.accepted] + [f"unique:{c}" for c in tests.unique]
    for model, tests in quality.MODEL_TESTS.items()
}

ORACLE = {
    "model_tests": over("raw") + "\nUNION ALL\n".join(
        f"SELECT '{model}' AS model, '{test}' AS test, "
        + ("(SELECT count(*) FROM raw WHERE uuid IS NULL)" if (model, test) == ("raw_games", "not_null:uuid") else "0::BIGINT")
        + " AS failures"
        for model, tests in _DECLARED.items()
        for test in tests
    ),
    "dq_not_null": over("raw") + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS failures FROM raw"
        for c in ("uuid", "white_username", "white_accuracy", "uploaded_at")
    ),
    "dq_unique": over("raw") + "SELECT uuid AS value, count(*) AS n FROM raw WHERE uuid IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dq_accepted_values": over("raw") + """
SELECT time_class AS value, count(*) AS n FROM raw WHERE time_class NOT IN ('blitz', 'rapid', 'bullet') GROUP BY 1""",
    "no_future_games": over("stg") + """
SELECT game_id, game_date, game_end_timestamp, white_username, black_username FROM stg WHERE game_date > DATE '2024-12-01'""",
    "outcomes_sum_to_total": over("ustats") + """
SELECT username, stat_date, time_class, games_played, wins, losses, draws, wins + losses + draws AS wld_sum FROM ustats
WHERE wins + losses + draws <> games_played""",
    "outcomes_sum_broken": over("ustats") + """
SELECT username, stat_date, time_class, games_played, wins, losses, 0::BIGINT AS draws, wins + losses AS wld_sum FROM ustats
WHERE draws > 0""",
    "tracked_users_present": over("pg", "tracked") + """
SELECT username FROM tracked t WHERE NOT EXISTS (SELECT 1 FROM pg WHERE lower(pg.my_username) = lower(t.username))""",
    "assertions": """
SELECT 'no_future_games' AS test, 'error' AS severity, 0::BIGINT AS failures
UNION ALL SELECT 'outcomes_sum_to_total', 'error', 0
UNION ALL SELECT 'tracked_users_present', 'warn', count(*) FROM region""",
    "null_profile": over("raw") + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM raw" for c in _LANDED
    ),
}
