"""The numbers behind every chart, per player. Nothing is drawn here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery.functions import scoring
from rookery.functions.calendar import WEEKDAYS, month_start
from rookery.operators import rows
from rookery.plans.lifetime import CASTLING_SIDES, PLAYER

# Bin widths and edges.
RATING_STEP, RATING_TOP = 50, 2500
MOVES_STEP = 5
DURATION_EDGES = (0, 60, 120, 180, 240, 300, 600, 900, 1200, 1800, 2400, 3000)
SMOOTHING_ROWS = 30
CASTLING_MINIMUM = 10

CHART_CLASSES = ("blitz", "rapid", "bullet")


def _wins() -> Column:
    return F.count_if(F.col("outcome") == "win")


def _win_percentage(games: Column) -> Column:
    return scoring.ratio(_wins(), games) * 100


def _start_hour() -> Column:
    return F.floor(F.col("start_est_seconds") / 3600).cast("int")


# -- calendar ------------------------------------------------------------------------------


def games_by_month(games: DataFrame) -> DataFrame:
    month = month_start(F.col("date"))
    return (
        games.groupBy(*PLAYER, month.alias("month"))
        .agg(F.count("*").alias("games"))
        .withColumn("month_label", F.date_format("month", "MMM"))
    )


def _by_weekday(games: DataFrame, names: list[str], cells: dict[str, Column], types: list[str]) -> DataFrame:
    """Seven fixed rows per player, Monday first; a day without games has NULLs."""
    day = F.weekday("date")
    numbered = games.select(*PLAYER, day.alias("_day"), "outcome").groupBy(*PLAYER, "_day").agg(
        *[c.alias(n) for n, c in cells.items()]
    )
    wide = numbered.groupBy(*PLAYER).agg(
        *[F.max(F.when(F.col("_day") == i, F.struct(*cells))).alias(f"_d{i}") for i in range(7)]
    )
    lines = [(i + 1, WEEKDAYS[i], *[F.col(f"_d{i}")[n] for n in names]) for i in range(7)]
    return rows.unfold(wide, PLAYER, ["day_number", "weekday", *names], lines, ["int", "string", *types])


def games_by_weekday(games: DataFrame) -> DataFrame:
    return _by_weekday(games, ["games"], {"games": F.count("*")}, ["bigint"])


def games_by_hour(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, _start_hour().alias("hour")).agg(F.count("*").alias("games"))


def outcome_by_hour(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, _start_hour().alias("hour")).agg(
        F.count("*").alias("games"), _win_percentage(F.count("*")).alias("win_percentage")
    )


def outcome_by_weekday(games: DataFrame) -> DataFrame:
    cells = {"games": F.count("*"), "win_percentage": _win_percentage(F.count("*"))}
    return _by_weekday(games, list(cells), cells, ["bigint", "double"])


def outcome_by_month(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, F.month("date").alias("month")).agg(
        F.count("*").alias("games"), _win_percentage(F.count("*")).alias("win_percentage")
    )


def monthly_avg_rating(games: DataFrame) -> DataFrame:
    return games.filter(F.col("my_rating").isNotNull()).groupBy(
        *PLAYER, "time_class", F.month("date").alias("month")
    ).agg(F.avg("my_rating").alias("avg_rating"))


# -- outcomes ------------------------------------------------------------------------------


def pivot_outcomes(games: DataFrame, key: str) -> DataFrame:
    return rows.pivot_counts(games, [*PLAYER, key], "outcome", scoring.OUTCOMES)


def top_openings_wdl(games: DataFrame, k: int = 10) -> DataFrame:
    """The most common openings with their shares of wins, draws and losses."""
    counted = pivot_outcomes(games, "eco").withColumn("total", F.col("win") + F.col("draw") + F.col("lose"))
    common = rows.top_per_key(counted, PLAYER, [F.desc("total"), F.asc("eco")], k, "rn")
    return common.select(*PLAYER, "rn", "eco", "total", *[scoring.ratio(F.col(o), F.col("total")).alias(o) for o in scoring.OUTCOMES])


def wdl_by_time_control(games: DataFrame) -> DataFrame:
    return pivot_outcomes(games, "time_control")


def wdl_by_time_class(games: DataFrame) -> DataFrame:
    return pivot_outcomes(games, "time_class")


# -- bins ----------------------------------------------------------------------------------


def _right_closed(value: Column, step: int) -> Column:
    """Lower bound of the bin ``(low, low + step]`` that holds a whole number."""
    return (F.ceil(value / F.lit(step)) * step - step).cast("bigint")


def win_pct_by_opp_rating(games: DataFrame) -> DataFrame:
    """Wins per hundred decided games by the opponent's rating bin and class; draws are left out."""
    rating = F.col("opp_rating")
    binned = games.filter((rating > 0) & (rating <= RATING_TOP) & (F.col("outcome") != "draw"))
    low = F.col("rating_low")
    return (
        binned.groupBy(*PLAYER, _right_closed(rating, RATING_STEP).alias("rating_low"), "time_class")
        .agg(_wins().alias("wins"), F.count_if(F.col("outcome") == "lose").alias("losses"))
        .select(
            *PLAYER, "rating_low",
            F.concat_ws("-", low.cast("string"), (low + RATING_STEP).cast("string")).alias("rating_range"),
            "time_class", "wins", "losses",
            (scoring.ratio(F.col("wins"), F.col("wins") + F.col("losses")) * 100).alias("win_percentage"),
        )
    )


def moves_vs_time_points(games: DataFrame) -> DataFrame:
    return games.select(*PLAYER, "my_num_moves", "time_spent", "outcome").na.drop("any")


def win_rate_by_moves_bin(games: DataFrame) -> DataFrame:
    moves = F.col("my_num_moves")
    return (
        moves_vs_time_points(games)
        .filter(moves > 0)
        .groupBy(*PLAYER, _right_closed(moves, MOVES_STEP).alias("moves_low"))
        .agg(
            _wins().alias("win_count"),
            F.count("*").alias("total_games"),
            _win_percentage(F.count("*")).alias("win_percentage"),
        )
    )


def scaled_rating_diff(games: DataFrame) -> DataFrame:
    """Distinct rating differences with their size and z-score over all games of the player.

    Differences are whole numbers, so the games collapse into a small histogram before anything
    is gathered per player; mean and population deviation come from its integer sums.
    """
    diff = F.col("rating_diff")
    histogram = (
        games.filter(diff.isNotNull())
        .groupBy(*PLAYER, "outcome", "rating_diff")
        .agg(F.count("*").alias("n"))
    )
    player = Window.partitionBy(*PLAYER)
    n = F.sum("n").over(player).cast("double")
    total = F.sum(diff * F.col("n")).over(player).cast("double")
    squares = F.sum(diff * diff * F.col("n")).over(player).cast("double")
    return histogram.withColumns(
        {"_mean": total / n, "_std": F.sqrt(squares / n - (total / n) * (total / n))}
    ).select(*PLAYER, "outcome", "rating_diff", "n", F.try_divide(diff - F.col("_mean"), F.col("_std")).alias("scaled_diff"))


def scaled_rating_box(games: DataFrame) -> DataFrame:
    """Box-plot quartiles of the z-score by outcome."""
    quartile = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    return scaled_rating_diff(games).groupBy(*PLAYER, "outcome").agg(
        F.sum("n").alias("games"),
        F.min("scaled_diff").alias("lowest"),
        *[F.percentile("scaled_diff", q, F.col("n")).alias(name) for name, q in quartile.items()],
        F.max("scaled_diff").alias("highest"),
    )


def rolling_outcome_share(games: DataFrame) -> DataFrame:
    """Outcome shares by clock left, smoothed over the last 30 distinct clock values of a class.

    The window runs over distinct clock values, not games.
    """
    by_clock = rows.pivot_counts(
        games.filter(F.col("time_class").isin(*CHART_CLASSES)),
        [*PLAYER, "time_class", "my_time_left"],
        "outcome",
        scoring.OUTCOMES,
    ).withColumn("total", F.col("win") + F.col("draw") + F.col("lose"))
    trailing = Window.partitionBy(*PLAYER, "time_class").orderBy("my_time_left").rowsBetween(1 - SMOOTHING_ROWS, 0)
    return by_clock.select(
        *PLAYER, "time_class", "my_time_left",
        *[F.avg(scoring.ratio(F.col(o), F.col("total"))).over(trailing).alias(f"{o}_share") for o in scoring.OUTCOMES],
    )


# -- castling ------------------------------------------------------------------------------


def _castling_grid(games: DataFrame, cell: Column, kind: str) -> DataFrame:
    """A 3 x 3 grid per player, own side down and the opponent's across; empty cells are 0."""
    paired = games.na.drop("any", subset=["my_castling", "opp_castling", "outcome"]).groupBy(
        *PLAYER, "my_castling", "opp_castling"
    ).agg(F.count("*").alias("_n"), _wins().alias("_w")).withColumn("_cell", cell)
    at = {
        (m, o): F.coalesce(
            F.max(F.when((F.col("my_castling") == m) & (F.col("opp_castling") == o), F.col("_cell"))),
            F.lit(0).cast(kind),
        ).alias(f"{m}_{o}")
        for m in CASTLING_SIDES
        for o in CASTLING_SIDES
    }
    wide = paired.groupBy(*PLAYER).agg(*at.values())
    lines = [(m, *[F.col(f"{m}_{o}") for o in CASTLING_SIDES]) for m in CASTLING_SIDES]
    names = ["my_castling", *[f"opp_{o}" for o in CASTLING_SIDES]]
    return rows.unfold(wide, PLAYER, names, lines, ["string", kind, kind, kind])


def castling_win_ratio(games: DataFrame) -> DataFrame:
    enough = F.when(F.col("_n") >= CASTLING_MINIMUM, scoring.ratio(F.col("_w"), F.col("_n")))
    return _castling_grid(games, enough, "double")


def castling_game_count(games: DataFrame) -> DataFrame:
    return _castling_grid(games, F.col("_n"), "bigint")


# -- durations -----------------------------------------------------------------------------


def _duration_labels() -> list[str]:
    minutes = [e // 60 for e in DURATION_EDGES]
    return [f"{a}-{b} min" for a, b in zip(minutes, minutes[1:])]


def duration_histogram(games: DataFrame) -> DataFrame:
    """Games by duration bin, closed on the left, side by side for three classes; every bin of every player is listed.

    Games past the last edge fall in no bin; a player with none in a bin gets zeros.
    """
    bins = list(zip(DURATION_EDGES, DURATION_EDGES[1:], _duration_labels()))
    spent = F.col("time_spent")
    number = None
    for i, (low, high, _) in enumerate(bins):
        inside = (spent >= low) & (spent < high)
        number = F.when(inside, i) if number is None else number.when(inside, i)
    counted = (
        games.select(*PLAYER, "time_class", number.alias("_bin"))
        .groupBy(*PLAYER, "_bin", "time_class")
        .agg(F.count("*").alias("_n"))
    )

    def total(i: int, time_class: str) -> Column:
        here = (F.col("_bin") == i) & (F.col("time_class") == time_class)
        return F.coalesce(F.sum(F.when(here, F.col("_n"))), F.lit(0)).alias(f"{time_class}_{i}")

    wide = counted.groupBy(*PLAYER).agg(*[total(i, c) for i in range(len(bins)) for c in CHART_CLASSES])
    lines = [(i, label, *[F.col(f"{c}_{i}") for c in CHART_CLASSES]) for i, (_, _, label) in enumerate(bins)]
    return rows.unfold(
        wide, PLAYER, ["bin_number", "duration", *CHART_CLASSES], lines, ["int", "string", "bigint", "bigint", "bigint"]
    )


# Every chart's data by name, in drawing order.
CHARTS = {
    "games_by_month": games_by_month,
    "games_by_weekday": games_by_weekday,
    "games_by_hour": games_by_hour,
    "monthly_avg_rating": monthly_avg_rating,
    "top10_openings_wdl": top_openings_wdl,
    "wdl_by_time_class": wdl_by_time_class,
    "scaled_rating_box": scaled_rating_box,
    "outcome_by_hour": outcome_by_hour,
    "outcome_by_weekday": outcome_by_weekday,
    "outcome_by_month": outcome_by_month,
    "win_pct_by_opp_rating": win_pct_by_opp_rating,
    "moves_vs_time_points": moves_vs_time_points,
    "win_rate_by_moves_bin": win_rate_by_moves_bin,
    "outcome_by_time_left": rolling_outcome_share,
    "castling_win_ratio": castling_win_ratio,
    "castling_game_count": castling_game_count,
    "duration_histogram": duration_histogram,
}


def all_charts(games: DataFrame) -> dict[str, DataFrame]:
    """All chart tables over one analysis table."""
    return {name: chart(games) for name, chart in CHARTS.items()}
