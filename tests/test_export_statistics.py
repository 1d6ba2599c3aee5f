"""The exported statistics document is the whole one."""

from __future__ import annotations

import json
from datetime import date, datetime

import catalog
from rookery.plans import lifetime
from rookery.session import work_path
from rookery.sources import sinks
from tests.compare import differences

FIELDS = [
    "my_username", "castling_counts", "total_time_spent", "total_moves", "total_win_draw_loss", "total_results",
    "total_en_passant", "total_promotions", "total_games", "longest_winning_streak", "longest_losing_streak",
    "most_played_opponent", "highest_rating", "most_time_spent_day_dict", "my_openings", "timeclass_counts",
    "timecontrol_counts", "biggest_games", "last_game_ratings",
]
GAMES = (
    "my_username string, game_id string, game_end_timestamp timestamp, date date, time_class string, time_control string, "
    "my_castling string, outcome string, my_result string, opp_result string, time_spent bigint, my_num_moves bigint, "
    "en_passant_count bigint, promotion_count bigint, my_rating bigint, opp_username string, opp_rating bigint, "
    "rating_diff bigint, my_time_left double, opp_time_left double, my_opening string, link string"
)


def test_the_query_exports_every_field(spark, con, small):
    found = catalog.queries()["export_statistics_json"](spark, small)
    assert not differences(found, con, catalog.oracle_sql()["export_statistics_json"])
    documents = {r["my_username"]: json.loads(r["document"]) for r in found.collect()}
    assert documents
    for name, document in documents.items():
        assert list(document) == FIELDS and document["my_username"] == name
        assert list(document["castling_counts"]) == list(lifetime.CASTLING_SIDES)
        for part in ("castling_counts", "total_win_draw_loss", "total_results", "timeclass_counts", "timecontrol_counts"):
            assert sum(document[part].values()) == document["total_games"]
    assert any(d["total_results"].get("50move") for d in documents.values())


def test_a_player_with_one_lost_game(spark):
    rows = [
        ("A/b \"é\"", "g1", datetime(2024, 1, 2, 3, 4), date(2024, 1, 2), "blitz", "3m + 2s", "queenside", "lose", "threecheck", "win", 12_000_000, 7, 0, 1,
         1500, "x", 1600, -100, 3.5, 0.5, "N/A", "l1"),
        ("c", "g2", datetime(2024, 1, 2, 3, 4), date(2024, 1, 2), "daily", "1d", "none", "draw", "agreed", "agreed", 61, 0, 0, 0,
         1400, "y", 1400, 0, 1.0, 2.0, "Caro-Kann-Defense", "l2"),
    ]
    games = spark.createDataFrame(rows, GAMES)
    path = work_path(spark, "documents")
    sinks.export_statistics(lifetime.total_statistics(games), path)
    found = {d["my_username"]: d for d in (json.loads(r["value"]) for r in spark.read.text(path).collect())}
    lost, drawn = found["A/b \"é\""], found["c"]
    assert list(lost) == list(drawn) == FIELDS
    assert lost["castling_counts"] == {"kingside": 0, "queenside": 1, "none": 0}
    assert {k: n for k, n in lost["total_results"].items() if n} == {"threecheck": 1} and lost["total_time_spent"]["total_time_in_seconds"] == 12e6
    assert lost["biggest_games"]["victory"] is None and lost["biggest_games"]["upset"]["link"] == "l1"
    assert lost["my_openings"] == {"white_opening": None, "black_opening": None} and lost["last_game_ratings"]["rapid"] is None
    assert drawn["total_results"]["agreed"] == 1 and list(drawn["total_results"]) == list(lifetime.NAMED_RESULTS)
    assert drawn["my_openings"]["black_opening"] == "Caro-Kann-Defense" and drawn["longest_losing_streak"] == 0
