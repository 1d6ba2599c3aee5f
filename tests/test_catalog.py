"""Registered queries against their SQL on the small tables.

A spread over all sections by default; ROOKERY_ALL=1 runs every query.
"""

from __future__ import annotations

import os

import pytest

import catalog
from tests.compare import differences

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()

SPREAD = [
    "flatten_raw_game", "append_raw_games", "upsert_by_key", "export_games", "stg_raw_games", "dashboard_view_filled",
    "int_player_games", "dim_users", "rating_progression", "new_games_anti", "asof_snapshot_join", "user_lifetime_stats",
    "busiest_day", "flag_count_groups", "streak_group", "best_streaks", "top_openings_by_win_rate", "rolling_outcome_share",
    "event_streaks", "quickest_checkmate", "last_rating_by_class", "top10_flagged_games", "daily_feed", "pgn_tags",
    "clean_games", "process_game", "seconds_to_units", "scaled_rating_box", "castling_win_ratio", "duration_histogram",
    "my_daily_stats", "total_statistics", "collect_statistics", "fct_games_incremental", "fct_user_statistics_repair",
    "snapshot_check", "ingest_user_audit", "model_tests", "null_profile", "stream_user_statistics", "stream_event_counts",
]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("ROOKERY_ALL") else SPREAD)
def test_query_equals_sql(spark, con, small, name):
    problems = differences(QUERIES[name](spark, small), con, ORACLE[name])
    assert not [p for p in problems if not p.startswith("note")], "\n".join(problems)
