"""Unpivots, unions, pivots."""

from __future__ import annotations

from catalog import inputs as src
from catalog.oracle_tables import over
from rookery.plans import charts, warehouse
from rookery.sources import landing

COLUMNS = [
    "game_id", "my_username", "my_color", "my_rating", "my_result", "my_accuracy",
    "opp_username", "opp_rating", "opp_result", "opp_accuracy",
]


def player_games_unpivot(spark, folder):
    return warehouse.player_games_unpivot(src.staged(spark, folder)).select(*COLUMNS)


def int_player_games(spark, folder):
    return src.edge(src.player_games(spark, folder))


def all_usernames(spark, folder):
    return warehouse.all_usernames(src.staged(spark, folder))


def pivot_outcomes(spark, folder):
    return charts.pivot_outcomes(src.analysis(spark, folder), "eco")


def pivot_castling(spark, folder):
    return charts.castling_game_count(src.clean(spark, folder))


def existing_uuids(spark, folder):
    return landing.existing_uuids(src.raw(spark, folder), src.OWNER.upper(), 1711929600)


QUERIES = {
    f.__name__: f
    for f in (player_games_unpivot, int_player_games, all_usernames, pivot_outcomes, pivot_castling, existing_uuids)
}

_SIDES = ("kingside", "queenside", "none")

ORACLE = {
    "player_games_unpivot": over("pg") + f"SELECT {', '.join(COLUMNS)} FROM pg",
    "int_player_games": over("pg") + "SELECT * EXCLUDE eco_slug_raw FROM pg",
    "all_usernames": over("dim") + "SELECT username FROM roster",
    "pivot_outcomes": over("an") + """
SELECT my_username, eco, count(*) FILTER (outcome = 'win') AS win, count(*) FILTER (outcome = 'draw') AS draw,
  count(*) FILTER (outcome = 'lose') AS lose FROM an GROUP BY ALL""",
    "pivot_castling": over("an") + "SELECT u.my_username, s.side AS my_castling, "
    + ", ".join(f"count(*) FILTER (c.my_castling = s.side AND c.opp_castling = '{o}') AS opp_{o}" for o in _SIDES)
    + """
FROM (SELECT DISTINCT my_username FROM clean) u CROSS JOIN (VALUES ('kingside'), ('queenside'), ('none')) s(side)
LEFT JOIN clean c ON c.my_username = u.my_username GROUP BY ALL""",
    "existing_uuids": over("raw") + """
SELECT DISTINCT uuid FROM raw
WHERE end_time >= 1711929600 AND list_contains([lower(white_username), lower(black_username)], 'player7')""",
}
