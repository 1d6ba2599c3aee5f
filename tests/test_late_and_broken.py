"""Late, repeated, missing and broken input."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import functions as F

from rookery.operators import merge, streaks
from rookery.plans import charts, ingest, refresh
from rookery.session import work_path
from rookery.sources import landing

MERGED = "key string, month string, value int, at int"


def _table(spark, path):
    return sorted(tuple(r) for r in spark.read.option("mergeSchema", "true").parquet(path).select("key", "month", "value", "at").collect())


def _merge(spark, path, rows):
    merge.merge_upsert(spark, path, spark.createDataFrame(rows, MERGED), ["key"], ["value", "at"], "month", newest="at")


def test_the_newest_source_row_wins_in_any_order(spark):
    loads = [[("a", "m1", 1, 1), ("b", "m1", 5, 1)], [("a", "m1", 2, 2), ("c", "m2", 7, 1)], [("a", "m2", 3, 3), ("b", None, 6, 0), ("d", None, 8, 1)]]
    seen = set()
    for order in itertools.permutations(loads):
        path = work_path(spark, "merged")
        for load in order:
            _merge(spark, path, load)
        seen.add(tuple((k, v, at) for k, _, v, at in _table(spark, path)))
    assert seen == {(("a", 3, 3), ("b", 5, 1), ("c", 7, 1), ("d", 8, 1))}


def test_a_merge_leaves_other_partitions_alone(spark):
    path = work_path(spark, "merged")
    _merge(spark, path, [(f"k{i}", f"m{i % 7}", i, 1) for i in range(70)])
    files = {r["f"]: r["month"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f"), "month").distinct().collect()}
    _merge(spark, path, [("k3", "m3", -1, 2), ("new", "m5", 0, 2)])
    after = {r["f"] for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}
    assert {m for f, m in files.items() if f not in after} == {"m3", "m5"}
    assert ("k3", "m3", -1, 2) in _table(spark, path) and len(_table(spark, path)) == 71


def test_more_partitions_than_any_list(spark):
    """No number of touched partitions turns a merge into something else."""
    target = spark.range(40).select(F.col("id").cast("string").alias("key"), F.col("id").alias("month"))
    touched = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "month long")
    assert merge.in_touched(target, touched, "month").count() == 20


def test_streaks_keep_null_keys(spark):
    rows = [(None if i % 3 == 0 else "p", None if i % 2 else "c", i, f"g{i:03d}", "win" if i % 7 < 4 else "lose") for i in range(120)]
    df = spark.createDataFrame(rows, "player string, class string, at long, id string, outcome string").withColumn("at", F.timestamp_seconds(F.col("at") * 900))
    got = {r["id"]: r["streak_group"] for r in streaks.number_streaks(df, ["player", "class"], "outcome", "at", "id").collect()}
    want, last, group = {}, {}, {}
    for player, time_class, _, key, outcome in rows:
        k = (player, time_class)
        group[k] = group.get(k, 0) + (k in last and last[k] != outcome)
        last[k] = outcome
        want[key] = group[k]
    assert got == want


def test_histogram_lists_players_past_the_last_edge(spark):
    games = spark.createDataFrame([("far", "blitz", 99_999.0), ("near", "blitz", 10.0)], f"{charts.PLAYER[0]} string, time_class string, time_spent double")
    rows = charts.duration_histogram(games).collect()
    sums = {p: sum(r["blitz"] for r in rows if r[charts.PLAYER[0]] == p) for p in ("far", "near")}
    assert len(rows) == 2 * (len(charts.DURATION_EDGES) - 1) and sums == {"far": 0, "near": 1}


def test_an_empty_batch_is_new_to_nothing(spark):
    batch = spark.createDataFrame([], "uuid string, player string, end_time long")
    assert ingest.new_games_anti(batch, None).count() == 0


def test_broken_documents_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "loaded_by_user=ann" / "year=2024" / "month=1"
    folder.mkdir(parents=True)
    good = json.dumps({"games": [{"uuid": "g1", "end_time": 5}, {"uuid": "g2"}]})
    (folder / "a.json").write_text("\n".join([good, '{"games": [{"uuid": "g3"', json.dumps({"games": [{"uuid": "g4", "end_time": "no time"}]})]))
    games = landing.read_month_archives(spark, str(tmp_path)).select("game.uuid").collect()
    broken = landing.broken_documents(spark, str(tmp_path)).collect()
    assert sorted(r["uuid"] for r in games) == ["g1", "g2"]
    assert len(broken) == 2 and {r["loaded_by_user"] for r in broken} == {"ann"} and any("no time" in r["document"] for r in broken)


def test_a_run_with_broken_documents_has_failed(spark):
    tracked = spark.createDataFrame([("ANN",), ("Bob",), ("Cyd",)], "username string")
    counts = spark.createDataFrame([("ann", 4), ("bob", 2)], "player string, n_fetched long")
    uploaded = counts.withColumnRenamed("n_fetched", "n_uploaded")
    broken = spark.createDataFrame([("Ann", "{"), ("ann", "{"), ("dan", "{")], "loaded_by_user string, document string")
    rows = ingest.run_rows(counts, uploaded, tracked, 0.0, "test", False, F.current_timestamp(), broken).collect()
    assert {r["username"]: (r["status"], r["error_message"]) for r in rows} == {
        "ANN": ("failed", "2 month documents cannot be read"), "Bob": ("success", None), "Cyd": ("skipped", None),
    }


def test_a_repair_reads_only_months_from_the_first_touched_day(spark):
    import datetime

    path = work_path(spark, "by_month")
    days = spark.range(120).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("game_date"))
    refresh.by_month(days, "game_date").write.partitionBy(refresh.MONTH_COLUMN).parquet(path)
    kept = refresh.since_day(spark.read.parquet(path), datetime.date(2024, 3, 15))
    assert kept.count() == 120 - 74
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert refresh.MONTH_COLUMN in filters and "2024-03-01" in filters or "19783" in filters


def test_a_year_of_parsed_games(spark):
    games = spark.createDataFrame([("2024.05.01",), ("2023.12.31",), (None,)], "date string")
    assert landing.year_filter(games, 2024).count() == 1 and landing.year_filter(games, "ALL").count() == 3
