"""Operators against brute force and across refresh paths."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from rookery.functions.calendar import instant
from rookery.operators import joins, merge, rows, streaks
from rookery.plans import ingest, quality, refresh, warehouse
from rookery.session import work_path
from rookery.sources import landing, order_archive

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def games_of(spark, spec):
    """spec: {player: [(minutes, outcome), ...]}"""
    data = [
        (p, START + timedelta(minutes=m), f"g{i:05d}", o)
        for p, games in spec.items()
        for i, (m, o) in enumerate(games)
    ]
    return spark.createDataFrame(data, "my_username string, game_end_timestamp timestamp, game_id string, outcome string")


def brute(games):
    ordered = [o for _, _, o in sorted((m, i, o) for i, (m, o) in enumerate(games))]
    runs = [(o, len(list(g))) for o, g in groupby(ordered)]
    longest = {w: max((n for o, n in runs if o == w), default=None) for w in ("win", "lose")}
    return longest["win"], longest["lose"], *runs[-1]


def streak_rows(df):
    found = streaks.streak_extremes(df, ["my_username"], "outcome", "game_end_timestamp", "game_id").collect()
    return {r["my_username"]: (r[1], r[2], r[3], r[4]) for r in found}


def test_named_streak(spark):
    spec = {"p": [(i * 50, o) for i, o in enumerate("win win lose lose lose draw win".split())]}
    assert streak_rows(games_of(spark, spec)) == {"p": (2, 3, "win", 1)}


def test_streaks_across_chunks_equal_brute_force(spark):
    """Dense and sparse players, a heavy one, equal times, runs over many hours and runs inside one."""
    rng = random.Random(7)
    spec = {
        "dense": [(i // 20, rng.choice(["win", "win", "lose", "draw"])) for i in range(3000)],
        "sparse": [(i * 95, rng.choice(["win", "lose"])) for i in range(200)],
        "steady": [(i * 7, "win") for i in range(500)],
        "flip": [(i, "win" if i % 2 else "lose") for i in range(300)],
        "single": [(5, "draw")],
    }
    for p in range(8):
        spec[f"r{p}"] = [(rng.randrange(3000), rng.choice(["win", "lose", "draw"])) for _ in range(rng.randrange(1, 120))]
    df = games_of(spark, spec)
    assert streak_rows(df) == {p: brute(g) for p, g in spec.items()}
    short = streaks.streak_extremes(df, ["my_username"], "outcome", "game_end_timestamp", "game_id", 60).collect()
    assert {r["my_username"]: (r[1], r[2], r[3], r[4]) for r in short} == {p: brute(g) for p, g in spec.items()}

    numbered = streaks.number_streaks(df, ["my_username"], "outcome", "game_end_timestamp", "game_id").collect()
    for player, games in spec.items():
        mine = sorted((r for r in numbered if r["my_username"] == player), key=lambda r: (r["game_end_timestamp"], r["game_id"]))
        group, before = 0, None
        for r in mine:
            changed = int(before is not None and before != r["outcome"])
            group += changed
            assert (r["outcome_changed"], r["streak_group"]) == (changed, group)
            before = r["outcome"]


def test_top_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "id AS v")
    top = rows.top_per_key(df, ["k"], [F.desc("v")], 2, "rn")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
    assert {(r.k, r.v, r.rn) for r in top.collect()} == {(0, 998, 1), (0, 996, 2), (1, 999, 1), (1, 997, 2)}


def test_merge_updates_listed_columns_only(spark):
    path = work_path(spark, "t")
    schema = "k string, a int, b int, m string"
    merge.merge_upsert(spark, path, spark.createDataFrame([("x", 1, 1, "jan"), ("y", 2, 2, "feb")], schema), ["k"], ["a"], "m")
    untouched = {f for f in spark.read.parquet(path).inputFiles() if "m=feb" in f}
    # x moves month in the source: the row stays where it is. NULL overwrites. z is new.
    source = spark.createDataFrame([("x", None, 9, "mar"), ("z", 3, 3, "mar")], schema)
    merge.merge_upsert(spark, path, source, ["k"], ["a"], "m")
    table = spark.read.parquet(path)
    assert {tuple(r) for r in table.select("k", "a", "b", "m").collect()} == {
        ("x", None, 1, "jan"), ("y", 2, 2, "feb"), ("z", 3, 3, "mar")
    }
    assert untouched <= set(table.inputFiles())
    with pytest.raises(ValueError):
        merge.merge_upsert(spark, path, source.union(source), ["k"], ["a"], "m")


def test_shared_games_go_to_the_first_player(spark):
    batch = spark.createDataFrame(
        [("a", "p2", 1), ("a", "p1", 2), ("b", "p2", 3), ("b", "p2", 4)], "uuid string, player string, n int"
    )
    assert sorted(r.n for r in ingest.first_loader(batch).collect()) == [2, 3, 4]


def test_snapshot_versions(spark):
    path = work_path(spark, "snap")
    base = [(f"k{i}", f"u{i}", 1500, 1500, 1, 0.5, 1, 0, 0) for i in range(2)]
    schema = ("user_key string, username string, current_rating int, peak_rating int, total_games int, win_rate double, "
              "blitz_games int, rapid_games int, bullet_games int")
    changed = [(*base[0][:2], 1510, *base[0][3:]), base[1]]
    for day, users in ((1, base), (2, changed), (3, changed)):
        refresh.refresh_snapshot(spark, spark.createDataFrame(users, schema), path, instant(F.lit(day * 86400)))
    history = spark.read.parquet(path)
    rows_ = {(r.username, r.current_rating, r.valid_from.day, r.valid_to and r.valid_to.day) for r in history.collect()}
    assert rows_ == {("u0", 1500, 2, 3), ("u0", 1510, 3, None), ("u1", 1500, 2, None)}
    assert refresh.snapshot_current(history).count() == 2
    then = joins.as_of(history, instant(F.lit(2 * 86400 - 1)))
    assert {r.current_rating for r in then.collect()} == {1500}


def _statistics(df):
    skip = ("fact_updated_at", "game_month_start")
    columns = [c for c in sorted(df.columns) if c not in skip]
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_incremental_equals_full_refresh(spark, small):
    raw = order_archive.raw_games(spark, small)
    games = warehouse.int_player_games(raw)
    full = _statistics(warehouse.fct_user_statistics(games))
    path = work_path(spark, "stats")
    late = "game_id LIKE '%3'"
    refresh.refresh_user_statistics(spark, games.filter(f"NOT ({late})"), path)
    strict = work_path(spark, "strict")
    refresh.refresh_user_statistics(spark, games.filter(f"NOT ({late})"), strict)
    refresh.refresh_user_statistics(spark, games, path, "repair", games.filter(late))
    assert _statistics(spark.read.parquet(path)) == full
    # Late games on known days are passed over by the strict watermark.
    refresh.refresh_user_statistics(spark, games, strict, "strict")
    assert _statistics(spark.read.parquet(strict)) != full
    # A repeated repair changes nothing.
    refresh.refresh_user_statistics(spark, games, path, "repair", games.filter(late))
    assert _statistics(spark.read.parquet(path)) == full


def test_fixture_counts(spark, small):
    raw = order_archive.raw_games(spark, small)
    found = raw.agg(F.count("*"), F.count("uuid"), F.count("white_username"), F.count_distinct("uuid"), F.sum(F.length("pgn"))).head()
    assert tuple(found) == (1530, 1521, 1514, 1492, 2191300)


def test_unpivot_doubles_games_and_outcomes_add_up(spark, small):
    raw = order_archive.raw_games(spark, small)
    games = warehouse.int_player_games(raw)
    assert games.count() == 2 * warehouse.staged_games(raw).count()
    assert quality.outcomes_sum_to_total(warehouse.fct_user_statistics(games)).isEmpty()


def test_record_text_never_crosses_a_shuffle(spark, small):
    path = work_path(spark, "raw_games")
    order_archive.raw_games(spark, small).write.parquet(path)
    games = warehouse.int_player_games(landing.scan_raw_games(spark, path))
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    lines = games._jdf.queryExecution().executedPlan().toString().split("\n")
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    above = [line for line in lines[:exchange] if "pgn" in line]
    assert not above
    scan = next(line for line in lines if "FileScan" in line)
    assert "PushedFilters: [IsNotNull(uuid), IsNotNull(end_time), IsNotNull(white_username), IsNotNull(black_username)" in scan
    assert "tcn" not in scan.split("ReadSchema")[1] and "white_uuid" not in scan.split("ReadSchema")[1]


def test_month_prune_reaches_the_folders(spark, small):
    path = work_path(spark, "months")
    spark.range(24).selectExpr("id", "2023 + id div 12 AS year", "id % 12 + 1 AS month").write.partitionBy("year", "month").parquet(path)
    archive = spark.read.parquet(path)
    assert landing.month_prune(archive, "ALL", (2024, 11)).count() == 2
    assert landing.month_prune(archive, 2023).count() == 12
    assert landing.month_prune(archive, "2024", (2023, 5)).count() == 12
    plan = landing.month_prune(archive, 2024, (2024, 11))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "PushedFilters: []" in plan
