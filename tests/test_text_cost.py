"""What the record text costs: made once, parsed once, and only for what a query uses."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog
from catalog import inputs
from rookery.functions import movetext as mt
from rookery.plans import parsed_games


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_once_and_above_the_exchange(spark, small):
    text = plan(parsed_games.parse_games(inputs.raw(spark, small)))
    assert text.count("transform(sequence(") == 1
    assert text.index("transform(sequence(") < text.index("RepartitionByExpression")


def test_orders_keep_their_tasks(spark, small):
    frame = inputs.order_archive.read_orders(spark, small)
    frame.count()
    assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_charts_without_moves_take_none(spark, small):
    assert "filter(split(" not in plan(catalog.queries()["outcome_by_weekday"](spark, small))
    assert "filter(split(" in plan(catalog.queries()["split_moves"](spark, small))


def test_one_pass_clocks_equal_two_passes(spark):
    texts = [
        None, "", "no clocks", "1. e4 {[%clk 0:01:02.5]} 1... e5 {[%clk 0:01:03]} 12. O-O {[%clk 0:00:09]} *",
        "1. 2... {[%clk 1:00]} {[%clk 2:00]}", "5.. e4 {[%clk 0:01]} 5.... e4 {[%clk 0:02]}", "7. a.b... {[%clk 0:03.5]} 3. {[%clk 4]}",
        "10. e4 {[%clk 0:1.]} 11. e4 {[%clk 0:12:3]} 11... e5 {[%clk :]} 12. x 12. y {[%clk 9]}",
    ]
    p = F.col("p")
    marks = mt.clock_marks(p)
    for side, pattern in (("white", mt.WHITE_CLOCK_PATTERN), ("black", mt.BLACK_CLOCK_PATTERN)):
        own = mt.marks_of(marks, side)
        both = F.arrays_zip(F.regexp_extract_all("p", F.lit(pattern), F.lit(1)), mt.clock_times(p, pattern))
        rows = spark.createDataFrame([(t,) for t in texts], "p string").select(
            F.transform(own, mt.mark_clock).alias("new"), mt.clock_times(p, pattern).alias("old"),
            mt.last_clock(own).alias("new_last"), mt.last_clock_seconds(mt.clock_times(p, pattern)).alias("old_last"),
            mt.clock_list(p, pattern).alias("new_list"), both.alias("old_list"),
        ).collect()
        for row in rows:
            assert row.new == row.old and row.new_last == row.old_last
            assert [tuple(x) for x in row.new_list or []] == [tuple(x) for x in row.old_list or []]


def test_exports_parse_once(spark, small, monkeypatch):
    seen = []
    kept = catalog.sources.sinks.export_csv
    monkeypatch.setattr(catalog.sources.sinks, "export_csv", lambda df, path: (seen.append(plan(df)), kept(df, path)))
    catalog.queries()["export_games"](spark, small)
    assert seen and "transform(sequence(" not in seen[0]


def test_archives_and_landings_are_compressed(spark, small, tmp_path):
    from pathlib import Path

    from rookery.session import shared_folder, stage
    from rookery.sources import landing

    before = set(Path(shared_folder(spark)).rglob("*.json*"))
    catalog.queries()["flatten_raw_game"](spark, small)
    written = {p for p in Path(shared_folder(spark)).rglob("*.json*") if not p.name.startswith(".")} - before
    assert written and all(p.name.endswith(".json.gz") for p in written)
    landing.append_raw_games(inputs.raw(spark, small).limit(5), str(tmp_path / "landing"))
    assert list((tmp_path / "landing").glob("*.zstd.parquet"))
    staged = stage(spark.range(3).toDF("i"), "three")
    assert all(".zstd." in f for f in staged.inputFiles())


def test_merged_tables_are_compressed(spark, tmp_path):
    from rookery.operators import merge

    rows = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, v int, p string")
    for folder, partition in (("flat", None), ("parts", "p")):
        path = str(tmp_path / folder)
        for source in (rows, rows.withColumn("v", F.col("v") + 1)):
            merge.merge_upsert(spark, path, source, ["k"], ["v"], partition)
            assert all(".zstd." in f for f in spark.read.parquet(path).inputFiles())
        assert sorted(r.v for r in spark.read.parquet(path).collect()) == [11, 21]


def test_tags_of_cut_texts_equal_those_of_whole_texts(spark):
    texts = [
        None, "", '"]', 'no tags 1. e4', '[A "x"]', '[A "x"] tail "] [B "y"', '[A "x [B "y"]\n[A ""]\n1. e4 [C "z"] e5 {[%clk 0:01]} *',
        '[Ä "x"]\n[B\n"y"]\n\n1. e4 {[%clk 0:00:01]} 1... e5 {a "] b} 2. O-O 12x = =. .= {x} x{ é 3 %%% e8=Q', "  1. 2. 3.", "e4", "e4 1.", "1. e4\n\t* ",
    ]
    p = F.col("p")
    rows = spark.createDataFrame([(t,) for t in texts], "p string")
    for row in rows.select(
        "p", mt.tag_names(p).alias("n"), mt.tag_values(p).alias("v"),
        F.reverse(F.regexp_extract_all(p, F.lit(mt.TAG_PATTERN), F.lit(1))).alias("n0"),
        F.reverse(F.regexp_extract_all(p, F.lit(mt.TAG_PATTERN), F.lit(2))).alias("v0"),
    ).collect():
        assert (row.n, row.v) == (row.n0, row.v0), row.p


def test_record_texts_keep_their_wording(spark):
    orders = spark.createDataFrame([(k, 1) for k in (41, 2399, 10**12 + 39, None)], "o_orderkey bigint, o_custkey bigint")
    frame = inputs.order_archive.raw_games_from_orders(orders)
    assert "lpad" not in plan(frame).split("transform(sequence(")[1].split("AS pgn")[0]
    texts = {r.url: r.pgn and r.pgn.split("\n\n")[1] for r in frame.collect()}
    assert texts.pop(None) is None
    for url, text in texts.items():
        k = int(url.rsplit("/")[-1])
        n, words = 5 + k % 40, []
        for i in range(1, n + 1):
            white = "O-O" if i == 6 and k % 3 == 0 else "O-O-O" if i == 7 and k % 5 == 1 else "e8=Q" if i == 40 else "Nf3"
            black = "O-O" if i == 6 and k % 4 == 0 else "O-O-O" if i == 8 and k % 5 == 2 else "d1=N" if i == 42 else "Nc6"
            clocks = [f"{{[%clk 0:0{max(0, 4 - i // 9)}:{(i * 7 + k // 40 + o) % 60:02}{'.5' if i % 2 == 0 else ''}]}}" for o in (0, 13)]
            words.append(f"{i}. {white} {clocks[0]}" + ("" if i == n and k % 2 else f" {i}... {black} {clocks[1]}"))
        assert text == " ".join(words) + " *", k


def test_complete_rows_read_no_clocks_and_equal_the_old_test(spark, small):
    query = plan(catalog.queries()["win_rate_by_eco"](spark, small))
    assert "CASE WHEN" in query and mt.CLOCK_PATTERN not in query
    clean = inputs.clean(spark, small)
    others = [c for c in parsed_games.COMPLETE_COLUMNS if c not in parsed_games.TIME_COLUMNS]
    old = clean.filter(parsed_games.rows.all_not_null(others)).na.drop("any", subset=parsed_games.TIME_COLUMNS)
    new = parsed_games.drop_any_null(clean)
    assert old.count() == new.count() > 0 and old.exceptAll(new).isEmpty()


def test_loads_make_only_their_own_texts(spark, small):
    raw = inputs.raw(spark, small)
    early = F.unix_seconds("uploaded_at") < inputs.BATCH_SPLIT
    text = plan(raw.filter(early))
    below = text[text.index("transform(sequence(") :]
    assert "transform(sequence(" not in below[1:] and "Filter" not in text.split("transform(sequence(")[0]
    assert "Filter" in below and str(inputs.BATCH_SPLIT) in below
    assert raw.filter(early).count() + raw.filter(~early).count() == raw.count()


def test_a_staged_batch_is_not_staged_again(spark, small, monkeypatch):
    from rookery.operators import merge

    names = []
    kept = merge.stage
    monkeypatch.setattr(merge, "stage", lambda df, name, *more: (names.append(name), kept(df, name, *more))[1])
    found = catalog.queries()["stream_user_statistics"](spark, small)
    assert found.count() > 0
    assert names.count("merge_source") == 2 and names.count("placed") == 2  # the statistics of two loads only
