"""Hand-written cases for every expression."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rookery.functions import calendar as cal
from rookery.functions import durations, openings, scoring
from rookery.functions import movetext as mt
from rookery.plans import charts, parsed_games

PGN = (
    '[Date "2024.01.02"]\n[StartTime "03:00:00"]\n[EndTime "03:00:20"]\n[Link "a"]\n[Link "b"]\n\n'
    "1. e4 {[%clk 0:02:54.6]} 1... e5 {[%clk 0:02:59]} 2. O-O+ {[%clk 0:02:50]} 1-0"
)


def one(spark, value, **columns):
    """The value of an expression over a single row of given columns."""
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in columns.items()])
    return row.select(value.alias("v")).head()[0]


def tag_line(slug):
    return f'[ECOUrl "https://site.test/openings/{slug}"]\n'


@pytest.mark.parametrize(
    ("slug", "family"),
    [
        ("Sicilian-Defense-Najdorf-Variation", "Sicilian-Defense"),
        ("Ruy-Lopez", "Ruy-Lopez"),
        ("Kings-Gambit-Defense", "Kings-Gambit"),
        ("Gambit-Anything-Defense", "Gambit-Anything-Defense"),
    ],
)
def test_opening_family(spark, slug, family):
    assert one(spark, openings.opening_family(openings.opening_slug(F.col("p"))), p=tag_line(slug)) == family


def test_no_opening(spark):
    slug = openings.opening_slug(F.col("p"))
    assert one(spark, openings.opening_family(slug), p="1. e4") == "No Opening"
    assert one(spark, openings.slug_or_default(slug), p="1. e4") == "No-Opening"


@pytest.mark.parametrize(
    ("eco", "color", "mine"),
    [
        ("Sicilian-Defense", "white", "N/A"),
        ("Sicilian-Defense", "black", "Sicilian-Defense"),
        ("Ruy-Lopez", "white", "Ruy-Lopez"),
        ("Ruy-Lopez", "black", "N/A"),
        ("No Opening", "white", "N/A"),
    ],
)
def test_my_opening(spark, eco, color, mine):
    assert one(spark, openings.my_opening(F.col("e"), F.col("c")), e=eco, c=color) == mine


@pytest.mark.parametrize(
    ("control", "label", "seconds"),
    [
        ("600", "10m + 0s", 600),
        ("500", "8m 20s + 0s", 500),
        ("30", "30s + 0s", 30),
        ("300+5", "5m + 5s", 305),
        ("0", "0s + 0s", 0),
        ("-", "Unlimited", None),
        ("", "Invalid time control", None),
        ("1/259200", "0.3 day(s) per move", None),
        ("1/86400", "1.0 day(s) per move", None),
        ("1/x", "Unrecognized format: 1/x", None),
        ("1+2+3", "Unrecognized format: 1+2+3", None),
        ("abc", "Unrecognized format: abc", None),
    ],
)
def test_time_control(spark, control, label, seconds):
    assert one(spark, mt.time_control_label(F.col("c")), c=control) == label
    assert one(spark, mt.time_control_seconds(F.col("c")), c=control) == seconds


@pytest.mark.parametrize(
    ("start", "est", "day"),
    [("03:00:00", "22:00:00", "2024-01-01"), ("00:00:00", "19:00:00", "2024-01-02"), ("00:00:01", "19:00:01", "2024-01-01"),
     ("05:00:00", "00:00:00", "2024-01-02")],
)
def test_local_time_and_date(spark, start, est, day):
    assert one(spark, mt.est_time(F.col("s")), s=start) == est
    local = mt.est_date(mt.header_date(F.lit("2024.01.02")), mt.est_seconds(mt.day_seconds(F.col("s"))))
    assert str(one(spark, local, s=start)) == day


def test_bad_header_times_are_null(spark):
    assert one(spark, mt.day_seconds(F.col("s")), s="25:00:00") is None
    assert one(spark, mt.est_time(F.col("s")), s="soon") is None
    assert one(spark, mt.header_date(F.col("s")), s="2024.13.01") is None


def test_time_spent_over_midnight(spark):
    spent = mt.elapsed_seconds(mt.day_seconds(F.lit("23:59:50")), mt.day_seconds(F.lit("00:00:10")))
    assert one(spark, spent) == 20


def test_moves_and_castling(spark):
    moves = mt.moves(F.col("p"))
    assert one(spark, moves, p=PGN) == ["e4", "e5", "O-O+"]
    assert one(spark, mt.castling_side(mt.every_second(moves, 0)), p=PGN) == "none"
    assert one(spark, moves, p="1. O-O {note e.p. x} 1... O-O-O 2. e8=Q ={ 7 1/2-1/2") == ["O-O", "x}", "O-O-O", "e8=Q", "={"]
    assert one(spark, moves, p="[A \"x\"]\nplain [b]\n[c] e4\n e5") == ["plain", "[c]", "e4", "e5"]
    assert one(spark, mt.castling_side(F.array(F.lit("O-O"), F.lit("O-O-O")))) == "queenside"
    assert one(spark, mt.count_containing(F.array(F.lit("e8=Q"), F.lit("d1=N"), F.lit("e4")), "=")) == 2


def test_moves_travel_as_text(spark):
    for moves in (["e4", "e5"], []):
        there = F.array(*[F.lit(m) for m in moves]).cast("array<string>")
        assert one(spark, mt.moves_of_text(mt.move_text(there))) == moves


def test_clocks(spark):
    white = mt.clock_list(F.col("p"), mt.WHITE_CLOCK_PATTERN)
    black = mt.clock_list(F.col("p"), mt.BLACK_CLOCK_PATTERN)
    assert [tuple(c) for c in one(spark, white, p=PGN)] == [("1", "0:02:54.6"), ("2", "0:02:50")]
    assert [tuple(c) for c in one(spark, black, p=PGN)] == [("1", "0:02:59")]
    assert one(spark, mt.clock_seconds(F.lit("1:02:03.5"))) == 3723.5
    assert one(spark, mt.last_clock_seconds(mt.clock_times(F.col("p"), mt.WHITE_CLOCK_PATTERN)), p="no clocks") is None


def test_last_of_repeated_tags_wins(spark):
    names, values = mt.tag_names(F.col("p")), mt.tag_values(F.col("p"))
    assert one(spark, mt.tag(names, values, "Link"), p=PGN) == "b"
    assert one(spark, mt.tag(names, values, "Event"), p=PGN) is None
    assert one(spark, mt.tag_map(names, values), p=PGN) == {
        "Date": "2024.01.02", "StartTime": "03:00:00", "EndTime": "03:00:20", "Link": "b"
    }


@pytest.mark.parametrize(
    ("result", "mover", "expected"),
    [("timeout", "me", 0), ("timevsinsufficient", "opponent", 0), ("timevsinsufficient", "me", 7), ("win", "me", 7), (None, "me", 7)],
)
def test_time_left(spark, result, mover, expected):
    left = mt.time_left(F.col("r").cast("string"), F.col("m"), "opponent", F.lit(7.0), F.lit(60.0))
    assert one(spark, left, r=result, m=mover) == expected


def test_time_left_falls_back_to_the_control(spark):
    assert one(spark, mt.time_left(F.lit("win"), F.lit("me"), "opponent", F.lit(None).cast("double"), F.lit(60.0))) == 60
    assert one(spark, mt.time_left_ratio(F.lit(5.0), F.lit(0.0))) is None


def test_outcomes_rates_and_keys(spark):
    assert one(spark, scoring.outcome_class(F.lit("50move"))) == "draw"
    assert one(spark, scoring.outcome_class(F.lit(None).cast("string"))) == "lose"
    assert one(spark, scoring.win_rate(F.lit(0), F.lit(0))) is None
    assert one(spark, scoring.win_rate(F.lit(2), F.lit(3), 2)) == 0.67
    key = scoring.surrogate_key(F.lit("a"), F.lit(None).cast("string"))
    assert one(spark, key) == one(spark, F.md5(F.lit("a-_dbt_utils_surrogate_key_null_")))


def test_calendar(spark):
    assert one(spark, cal.season(F.lit("2026-06-30").cast("date"))) == "2026-Q2"
    assert str(one(spark, cal.utc_date(F.lit(-1).cast("bigint")))) == "1969-12-31"
    assert one(spark, cal.utc_hour(F.lit(1704067200 + 3600 * 23 + 59).cast("bigint"))) == 23


def test_duration_parts(spark):
    parts = one(spark, durations.seconds_to_units(F.lit(31536000 + 2 * 86400 + 3 * 3600 + 4 * 60 + 5).cast("bigint")))
    assert (parts["years"], parts["total_time"]) == (1.0, "2 days 3 hours 4 minutes 5 seconds")
    assert parts["total_time_in_hours"] == 51.07


def test_rating_bins(spark):
    games = spark.createDataFrame(
        [("p", r, "blitz", "win") for r in (0, 50, 51, 2500, 2501)], "my_username string, opp_rating bigint, time_class string, outcome string"
    )
    found = {r["rating_range"] for r in charts.win_pct_by_opp_rating(games).collect()}
    assert found == {"0-50", "50-100", "2450-2500"}


def test_equal_clock_counts_leave_the_opponent_last(spark, small):
    from rookery.sources import order_archive

    games = parsed_games.clean_games(parsed_games.parse_games(order_archive.raw_games(spark, small)))
    equal = games.filter("my_num_moves = opp_num_moves").select("last_mover").distinct().collect()
    assert [r[0] for r in equal] == ["opponent"]
