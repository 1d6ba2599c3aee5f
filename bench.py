"""Headline queries over landed tables; prints one JSON line.

The landing, the parsed games and the facts are written once, as the daily job does, and the writes
are timed too. Every query then runs three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame

from catalog import inputs
from rookery.plans import charts, lifetime, parsed_games, refresh, warehouse
from rookery.session import local_session, work_path

RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8, "rookery-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def land(name: str, df: DataFrame) -> DataFrame:
        path = work_path(spark, name)
        start = time.perf_counter()
        df.write.parquet(path)
        times[f"write_{name}"] = time.perf_counter() - start
        return spark.read.parquet(path)

    raw = land("raw_games", inputs.raw(spark, folder))
    parsed = land("games_parsed", parsed_games.parse_games(raw))
    facts = land("fct_games", warehouse.fct_games(warehouse.int_player_games(raw)))
    analysis = parsed_games.analysis_games(parsed_games.clean_games(parsed))

    timed = {
        "stg_raw_games": lambda: warehouse.stg_raw_games(raw),
        "int_player_games": lambda: warehouse.int_player_games(raw),
        "top_openings_from_raw": lambda: warehouse.top_openings_by_win_rate(warehouse.fct_games(warehouse.int_player_games(raw))),
        "parse_games": lambda: parsed_games.parse_games(raw),
        "top_openings_by_win_rate": lambda: warehouse.top_openings_by_win_rate(facts),
        "user_lifetime_stats": lambda: warehouse.user_lifetime_stats(facts),
        "dim_users": lambda: warehouse.dim_users(warehouse.stg_raw_games(raw), facts),
        "fct_user_statistics": lambda: warehouse.fct_user_statistics(facts),
        "my_daily_stats": lambda: warehouse.my_daily_stats(facts),
        "streak_lengths": lambda: warehouse.streak_table(facts),
        "total_statistics": lambda: lifetime.total_statistics(analysis),
        "collect_statistics": lambda: lifetime.collect_statistics(analysis),
        "win_pct_by_opp_rating": lambda: charts.win_pct_by_opp_rating(analysis),
        "rolling_outcome_share": lambda: charts.rolling_outcome_share(analysis),
        "scaled_rating_box": lambda: charts.scaled_rating_box(analysis),
    }
    for name, query in timed.items():
        seconds = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run(query())
            seconds.append(time.perf_counter() - start)
        times[name] = statistics.median(seconds)
        print(f"{name} {times[name]:.2f}", file=sys.stderr)

    seconds = []
    for _ in range(RUNS):
        path = work_path(spark, "merged")
        start = time.perf_counter()
        refresh.refresh_fct_games(spark, raw.filter("unix_seconds(uploaded_at) < 1735690100"), path)
        refresh.refresh_fct_games(spark, raw, path)
        seconds.append(time.perf_counter() - start)
    times["fct_games_incremental"] = statistics.median(seconds)

    queries = {name: round(seconds, 3) for name, seconds in times.items()}
    total = sum(queries.values())
    print(json.dumps({
        "metric": "total_wall_seconds", "value": round(total, 3), "unit": "sec", "queries": queries,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "games": facts.count() // 2,
        "spark": spark.version, "cores": cores,
    }))


if __name__ == "__main__":
    main()
