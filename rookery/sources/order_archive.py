"""A game archive derived from an ``orders`` table, one game per order plus re-uploads.

The recipe is the one FIXTURES.md declares; it stands in for the archives that real players produce.
It is written as SQL expressions, one call for each step, because it is long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the recipe.
_KEYED = [
    "k",
    "CASE WHEN k % 211 <> 0 THEN concat('g', k) END AS uuid",
    "concat('https://games.test/', k) AS url",
    "concat('t', k) AS tcn",
    "element_at(array('60', '180+2', '600', '300+5', '1/259200', '500'), int(k % 6) + 1) AS time_control",
    "element_at(array('bullet', 'blitz', 'rapid', 'blitz', 'daily', 'rapid'), int(k % 6) + 1) AS time_class",
    "1704067200L + (k * 7919) % 31536000 AS end_time",
    "k % 5 <> 0 AS rated",
    "CASE WHEN k % 20 = 0 THEN 'chess960' ELSE 'chess' END AS rules",
    "'f' AS fen",
    "'start' AS initial_setup",
    "CASE WHEN k % 101 <> 0 THEN concat('Player', c % 12) END AS white_username",
    "concat('Player', (c % 12 + 1 + k % 11) % 12) AS black_username",
    "800L + (k * 37) % 1700 AS white_rating",
    "800L + (k * 53) % 1700 AS black_rating",
    "element_at(array('resigned', 'checkmated', 'timeout', 'abandoned'), int(k % 4) + 1) AS lost",
    "element_at(array('agreed', 'stalemate', 'repetition', 'insufficient', 'timevsinsufficient', '50move'), int(k % 6) + 1) AS drawn",
    "CASE WHEN k % 3 <> 0 THEN 50 + double(k % 400) / 10 END AS white_accuracy",
    "CASE WHEN k % 3 <> 0 THEN 50 + double(k % 450) / 10 END AS black_accuracy",
    "1735689600L + k % 1000 AS uploaded_epoch",
    """element_at(array('Sicilian-Defense-Najdorf-Variation', 'Italian-Game-Two-Knights', 'Queens-Gambit-Declined',
       'London-System', 'Caro-Kann-Defense', 'Kings-Indian-Attack', 'English-Opening', 'Ruy-Lopez', NULL), int(k % 9) + 1) AS slug""",
    "int(5 + k % 40) AS n",
    "int(k div 40 % 60) AS second",
]


def _clock_time(epoch: str) -> str:
    second = f"pmod({epoch}, 86400)"
    return f"concat_ws(':', lpad({second} div 3600, 2, '0'), lpad({second} div 60 % 60, 2, '0'), lpad({second} % 60, 2, '0'))"


def _listed(texts: list[str]) -> str:
    return f"array({', '.join(repr(t) for t in texts)})"


# A record has at most 44 turns. What surrounds the seconds of a clock follows from the turn alone, and is looked up.
_TURNS = range(1, 45)
_NUMBERS = _listed([f"{i}. " for i in _TURNS])
_BLACK_NUMBERS = _listed([f" {i}... " for i in _TURNS])
_MINUTES = _listed([f" {{[%clk 0:0{max(0, 4 - i // 9)}:" for i in _TURNS])
_SECONDS = _listed([f"{s:02}" for s in range(60)])
_CLOSINGS = _listed([".5]}" if i % 2 == 0 else "]}" for i in _TURNS])


def _clock(offset: int) -> str:
    return (
        f"element_at({_MINUTES}, i), element_at({_SECONDS}, (i * 7 + second + {offset}) % 60 + 1), element_at({_CLOSINGS}, i)"
    )


_WHITE_MOVE = "CASE WHEN i = 6 AND k % 3 = 0 THEN 'O-O' WHEN i = 7 AND k % 5 = 1 THEN 'O-O-O' WHEN i = 40 THEN 'e8=Q' ELSE 'Nf3' END"
_BLACK_MOVE = "CASE WHEN i = 6 AND k % 4 = 0 THEN 'O-O' WHEN i = 8 AND k % 5 = 2 THEN 'O-O-O' WHEN i = 42 THEN 'd1=N' ELSE 'Nc6' END"

_TURN = f"""concat(element_at({_NUMBERS}, i), {_WHITE_MOVE}, {_clock(0)},
  CASE WHEN i = n AND k % 2 = 1 THEN '' ELSE concat(element_at({_BLACK_NUMBERS}, i), {_BLACK_MOVE}, {_clock(13)}) END)"""

# Only a missing key makes the text NULL, and the CASE says so: a filter on the text that Spark moves below
# the exchange then asks for the key, and does not make every text a first time where the orders are scanned.
_PLAYED = [
    "*",
    "CASE WHEN k % 7 < 3 THEN 'win' WHEN k % 7 < 6 THEN lost ELSE drawn END AS white_result",
    "CASE WHEN k % 7 < 3 THEN lost WHEN k % 7 < 6 THEN 'win' ELSE drawn END AS black_result",
    f"""CASE WHEN k IS NOT NULL THEN coalesce(concat('[Date "', date_format(date_from_unix_date(int(end_time div 86400)), 'yyyy.MM.dd'), '"]\\n',
      '[StartTime "', {_clock_time("(end_time - (30 + k % 1500))")}, '"]\\n', '[EndTime "', {_clock_time("end_time")}, '"]\\n',
      coalesce(concat('[ECOUrl "https://www.chess.com/openings/', slug, '"]\\n'), ''), '[Link "', url, '"]\\n\\n',
      array_join(transform(sequence(1, n), i -> {_TURN}), ' '), ' *'), '') END AS pgn""",
]

_LANDED = [
    "uuid", "url", "tcn", "pgn", "time_control", "end_time", "rated", "time_class", "rules", "fen", "initial_setup",
    "white_username", "white_rating", "white_result", "md5(white_username) AS white_uuid",
    "black_username", "black_rating", "black_result", "md5(black_username) AS black_uuid",
    "CASE WHEN again THEN 99.5D ELSE white_accuracy END AS white_accuracy",
    "black_accuracy",
    "timestamp_seconds(uploaded_epoch + CASE WHEN again THEN 86400 ELSE 0 END) AS uploaded_at",
    "CASE WHEN again THEN black_username ELSE coalesce(white_username, black_username) END AS loaded_by_user",
]


# Orders of one task: their record texts are a hundred times their keys.
_ORDERS_PER_TASK = 200_000


def read_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the orders table, spread by key before the record texts are made of them.

    The number of parts follows from the number of orders: by the size of the keys alone, adaptive
    execution would join them to a few tasks.
    """
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
    parts = max(spark.sparkContext.defaultParallelism, -(-orders.count() // _ORDERS_PER_TASK))
    return orders.repartition(parts, "o_orderkey")


def raw_games_from_orders(orders: DataFrame) -> DataFrame:
    """``raw_games`` rows for an orders frame with ``o_orderkey`` and ``o_custkey``.

    Keys are not negative. Uploads are doubled by exploding a flag in one scan. The record text is made last, so that a
    filter on uploads goes below it and makes no text of the rows it drops.
    """
    return (
        orders.selectExpr("o_orderkey AS k", "o_custkey AS c")
        .selectExpr(*_KEYED)
        .selectExpr("*", "explode(CASE WHEN k % 50 = 0 THEN array(false, true) ELSE array(false) END) AS again")
        .selectExpr(*_PLAYED)
        .selectExpr(*_LANDED)
    )


def raw_games(spark: SparkSession, folder: str) -> DataFrame:
    return raw_games_from_orders(read_orders(spark, folder))
