"""Lifetime statistics of every player: counts, records, streaks and the statistics document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import durations, openings, scoring
from rookery.operators import rows, streaks

PLAYER = ["my_username"]

# The result words counted by name.
# Result words in their order.
NAMED_RESULTS = ("win", "checkmated", "timeout", "timevsinsufficient", "resigned", "stalemate", "repetition",
                 "abandoned", "insufficient", "agreed")
DRAWN_RESULTS = ("stalemate", "repetition", "timevsinsufficient", "insufficient", "agreed")
LOST_RESULTS = ("checkmated", "timeout", "resigned", "abandoned")

CASTLING_SIDES = ("kingside", "queenside", "none")
LAST_RATING_CLASSES = ("blitz", "rapid", "bullet")

# Fixed bounds: seconds on the clock that make a finish a time scramble.
SCRAMBLE_FROM, SCRAMBLE_TO = 0.1, 5


def _outcome_is(outcome: str) -> Column:
    return F.col("outcome") == outcome


# -- counts --------------------------------------------------------------------------------


def win_rate_by_eco(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, "eco").agg(
        scoring.ratio(F.count_if(_outcome_is("win")), F.count("*")).alias("win_rate")
    )


def games_by_eco(games: DataFrame) -> DataFrame:
    return rows.value_counts(games, PLAYER, "eco", "games_played")


def opening_merge(games: DataFrame) -> DataFrame:
    """Share of wins and number of games per opening, from one grouping."""
    return games.groupBy(*PLAYER, "eco").agg(
        scoring.ratio(F.count_if(_outcome_is("win")), F.count("*")).alias("win_rate"),
        F.count("*").alias("games_played"),
    )


def wdl_percentages(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER).agg(
        *[
            (scoring.ratio(F.count_if(_outcome_is(o)), F.count("*")) * 100).alias(f"{n}_percentage")
            for o, n in (("win", "win"), ("lose", "loss"), ("draw", "draw"))
        ]
    )


def elo_progression(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, "date").agg(F.avg("my_rating").alias("avg_rating"))


def total_time_spent_hours(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER).agg((F.sum("time_spent") / 3600).alias("hours"))


def opponent_counts(games: DataFrame) -> DataFrame:
    """Games with every opponent of each player, in no order; ``top_opponents`` ranks them."""
    return rows.value_counts(games, PLAYER, "opp_username", "games_played")


def time_control_counts(games: DataFrame) -> DataFrame:
    return rows.value_counts(games, PLAYER, "time_control", "games_played")


def castling_counts(games: DataFrame) -> DataFrame:
    return rows.pivot_counts(games, PLAYER, "my_castling", CASTLING_SIDES)


def result_counts(games: DataFrame) -> DataFrame:
    """Ten named results; the draw total counts five of the seven drawing results."""
    counted = rows.pivot_counts(games, PLAYER, "my_result", NAMED_RESULTS)

    def total(words: tuple[str, ...]) -> Column:
        return sum((F.col(w) for w in words), F.lit(0))

    return counted.withColumns({"total_draw": total(DRAWN_RESULTS), "total_loss": total(LOST_RESULTS)})


def outcome_counts(games: DataFrame) -> DataFrame:
    return rows.pivot_counts(games, PLAYER, "outcome", scoring.OUTCOMES)


def move_totals(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER).agg(
        F.sum("my_num_moves").alias("total_moves"),
        F.sum("en_passant_count").alias("total_en_passant"),
        F.sum("promotion_count").alias("total_promotions"),
    )


def time_by_day(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER, "date").agg(F.sum("time_spent").alias("time_spent"))


def busiest_day(games: DataFrame) -> DataFrame:
    """The day with the most playing time, the earliest one on a tie."""
    first_most = F.struct(-F.col("time_spent"), F.col("date"))
    return time_by_day(games).groupBy(*PLAYER).agg(
        F.min_by("date", first_most).alias("date"), F.max("time_spent").alias("time_spent")
    )


def _in_scramble(clock: str) -> Column:
    return _outcome_is("win") & (F.col(clock) >= SCRAMBLE_FROM) & (F.col(clock) <= SCRAMBLE_TO)


def flag_statistics_totals(games: DataFrame) -> DataFrame:
    return games.groupBy(*PLAYER).agg(
        F.count_if(_in_scramble("my_time_left")).alias("my_total_flag_wins"),
        F.count_if(_in_scramble("opp_time_left")).alias("my_total_flag_losses"),
    )


def flag_count_groups(games: DataFrame) -> DataFrame:
    """Sizes by clock, outcome and game for both scramble sets; a game may be in both."""
    sets = F.array_compact(
        F.array(
            F.when(_in_scramble("my_time_left"), F.lit("mine")), F.when(_in_scramble("opp_time_left"), F.lit("theirs"))
        )
    )
    return (
        games.select(*PLAYER, "my_time_left", "outcome", "link", F.explode(sets).alias("flag_set"))
        .groupBy(*PLAYER, "flag_set", "my_time_left", "outcome", "link")
        .agg(F.count("*").alias("n"))
    )


def top10_flagged_games(games: DataFrame, k: int = 10) -> DataFrame:
    """Closest scrambles per player, both ways round."""
    picked = [*PLAYER, "link", "opp_time_left", "my_time_left", "outcome", "my_color", "game_end_timestamp", "game_id"]

    def closest(own: str, other: str, name: str) -> DataFrame:
        order = [F.asc(other), F.asc("game_end_timestamp"), F.asc("game_id")]
        won = games.filter(_in_scramble(own)).select(*picked)
        return rows.top_per_key(won, PLAYER, order, k, "rn").withColumn("flag_set", F.lit(name))

    return closest("my_time_left", "opp_time_left", "flagged").unionByName(
        closest("opp_time_left", "my_time_left", "get_flagged")
    ).drop("game_end_timestamp", "game_id")


# -- record games --------------------------------------------------------------------------

_BASE = ("opp_username", "opp_rating", "time_class")
_END = ("date", "link")


class Record:
    """A record game: which games count, what is compared, and which fields are reported."""

    def __init__(self, metric: str, largest: bool, counts: Column | None, extra: tuple[str, ...] = ()):
        self.metric, self.largest, self.counts = metric, largest, counts
        self.fields = (*_BASE, *extra, *_END)

    def column(self, payload: tuple[str, ...] | None = None) -> Column:
        """Struct of the record game; the earliest game wins a tie."""
        value = F.col(self.metric)
        order = F.struct(-value if self.largest else value, F.col("game_end_timestamp"), F.col("game_id"))
        if self.counts is not None:
            order = F.when(self.counts, order)
        return F.min_by(F.struct(*(payload or self.fields)), order)


def records() -> dict[str, Record]:
    return {
        "victory": Record("rating_diff", False, _outcome_is("win")),
        "upset": Record("rating_diff", True, _outcome_is("lose")),
        "checkmate": Record("time_spent", False, F.col("opp_result") == "checkmated", ("time_spent", "my_num_moves")),
        "opponent": Record("opp_rating", True, _outcome_is("win")),
        "longest": Record("time_spent", True, None, ("time_spent",)),
        "moves": Record("my_num_moves", True, None, ("my_num_moves",)),
        "least_time_won": Record("my_time_left", False, _outcome_is("win"), ("my_time_left",)),
        "least_time_lost": Record("opp_time_left", False, _outcome_is("lose"), ("opp_time_left",)),
    }


def record_game(games: DataFrame, name: str) -> DataFrame:
    """One record per player, as plain columns; players without such a game have no row."""
    return (
        games.groupBy(*PLAYER)
        .agg(records()[name].column().alias("_record"))
        .filter(F.col("_record").isNotNull())
        .select(*PLAYER, "_record.*")
    )


def highest_rating(games: DataFrame) -> DataFrame:
    order = F.struct(-F.col("my_rating"), F.col("game_end_timestamp"), F.col("game_id"))
    top = F.min_by(F.struct(F.col("my_rating").alias("rating"), F.col("time_class").alias("time_control"), "date"), order)
    return games.groupBy(*PLAYER).agg(top.alias("_top")).select(*PLAYER, "_top.*")


def _last_rating(time_class: str) -> Column:
    latest = F.struct("date", "game_end_timestamp", "game_id")
    return F.max_by(F.struct("date", "my_rating"), F.when(F.col("time_class") == time_class, latest))


def last_rating_by_class(games: DataFrame) -> DataFrame:
    """The latest rating in three classes; a class never played reads 'N/A'."""
    wide = games.groupBy(*PLAYER).agg(*[_last_rating(c).alias(c) for c in LAST_RATING_CLASSES])

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("N/A"))

    return rows.unfold(
        wide,
        PLAYER,
        ["time_class", "date", "my_rating"],
        [(c, text(F.col(c)["date"]), text(F.col(c)["my_rating"])) for c in LAST_RATING_CLASSES],
        ["string", "string", "string"],
    )


# -- top-k lists ---------------------------------------------------------------------------


def most_played_openings(games: DataFrame, k: int = 5) -> DataFrame:
    return rows.top_per_key(opening_merge(games), PLAYER, [F.desc("games_played"), F.asc("eco")], k, "rn")


def top_opponents(games: DataFrame, k: int = 5) -> DataFrame:
    counts = rows.value_counts(games, PLAYER, "opp_username", "games_played")
    return rows.top_per_key(counts, PLAYER, [F.desc("games_played"), F.asc("opp_username")], k, "rn")


def favourite_openings(games: DataFrame) -> DataFrame:
    """The most frequent own opening without 'Defense' and with it."""
    counts = rows.value_counts(games.filter(F.col("my_opening") != openings.NOT_MINE), PLAYER, "my_opening")
    most = F.struct(-F.col("n"), F.col("my_opening"))
    defense = F.col("my_opening").contains("Defense")
    return counts.groupBy(*PLAYER).agg(
        F.min_by("my_opening", F.when(~defense, most)).alias("white_opening"),
        F.min_by("my_opening", F.when(defense, most)).alias("black_opening"),
    )


def longest_streak(games: DataFrame) -> DataFrame:
    """Longest winning and losing run over all classes, 0 when there is none."""
    found = streaks.streak_extremes(games, PLAYER, "outcome", "game_end_timestamp", "game_id")
    return found.select(
        *PLAYER,
        F.coalesce("longest_win_streak", F.lit(0)).alias("longest_winning_streak"),
        F.coalesce("longest_loss_streak", F.lit(0)).alias("longest_losing_streak"),
    )


# -- documents -----------------------------------------------------------------------------


def _facets(games: DataFrame) -> DataFrame:
    """Counts and time by opponent, control, own opening, day and result, in one pass over the games."""
    facets = {"opponent": "opp_username", "control": "time_control", "opening": "my_opening", "day": "date", "result": "my_result"}
    pairs = [F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("item")) for f, c in facets.items()]
    return (
        games.select(*PLAYER, "time_spent", F.inline(F.array(*pairs)))
        .groupBy(*PLAYER, "facet", "item")
        .agg(F.count("*").alias("n"), F.sum("time_spent").alias("time_spent"))
    )


def total_statistics(games: DataFrame) -> DataFrame:
    """One row per player with the whole statistics document in nested columns.

    ``games`` should be a table: it is read three times, once for counts and records, once for
    the facets, once for the streaks.
    """
    sides = F.struct(*[F.count_if(F.col("my_castling") == c).alias(c) for c in CASTLING_SIDES])
    outcomes = F.struct(*[F.count_if(_outcome_is(o)).alias(o) for o in scoring.OUTCOMES])
    results = F.create_map(*[c for r in NAMED_RESULTS for c in (F.lit(r), F.count_if(F.col("my_result") == r))])
    classes = F.struct(*[F.count_if(F.col("time_class") == c).alias(c) for c in ("blitz", "rapid", "bullet", "daily")])
    top = F.struct(-F.col("my_rating"), F.col("game_end_timestamp"), F.col("game_id"))
    scalars = games.groupBy(*PLAYER).agg(
        sides.alias("castling_counts"),
        F.sum("time_spent").alias("_seconds"),
        F.sum("my_num_moves").alias("total_moves"),
        outcomes.alias("total_win_draw_loss"),
        results.alias("_named_results"),
        F.sum("en_passant_count").alias("total_en_passant"),
        F.sum("promotion_count").alias("total_promotions"),
        F.count("*").alias("total_games"),
        F.min_by(
            F.struct(F.col("my_rating").alias("rating"), F.col("time_class").alias("time_control"), "date"), top
        ).alias("highest_rating"),
        classes.alias("timeclass_counts"),
        F.struct(*[r.column().alias(n) for n, r in records().items()]).alias("biggest_games"),
        F.struct(*[_last_rating(c).alias(c) for c in LAST_RATING_CLASSES]).alias("last_game_ratings"),
    )

    most = F.struct(-F.col("n"), F.col("item"))
    mine = (F.col("facet") == "opening") & (F.col("item") != openings.NOT_MINE)
    defense = F.col("item").contains("Defense")
    is_day = F.col("facet") == "day"
    facets = _facets(games)
    picks = facets.groupBy(*PLAYER).agg(
        F.struct(
            F.min_by("item", F.when(mine & ~defense, most)).alias("white_opening"),
            F.min_by("item", F.when(mine & defense, most)).alias("black_opening"),
        ).alias("my_openings"),
        F.min_by(
            F.struct(F.col("item").alias("date"), F.col("time_spent").alias("seconds")),
            F.when(is_day, F.struct(-F.col("time_spent"), F.col("item"))),
        ).alias("_day"),
    )
    # Opponents are cut to five before they are gathered; a player's controls and results are as
    # many as there are distinct texts of them, however many games were played.
    best = rows.top_per_key(
        facets.filter(F.col("facet") == "opponent"), PLAYER, [F.desc("n"), F.asc("item")], 5, "rn"
    )
    opponents = best.groupBy(*PLAYER).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rn", F.col("item").alias("opponent"), F.col("n").alias("games_played")))),
            lambda e: F.struct(e["opponent"].alias("opponent"), e["games_played"].alias("games_played")),
        ).alias("most_played_opponent")
    )
    is_control, is_result = F.col("facet") == "control", F.col("facet") == "result"

    def counted(which: Column) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(which, F.struct("item", "n")))))

    texts = (
        facets.filter(is_control | is_result)
        .groupBy(*PLAYER)
        .agg(
            counted(is_control).alias("timecontrol_counts"),
            counted(is_result & ~F.col("item").isin(*NAMED_RESULTS)).alias("_other_results"),
        )
    )
    spent = durations.seconds_to_units
    return (
        scalars.join(picks, PLAYER)
        .join(opponents, PLAYER)
        .join(texts, PLAYER)
        .join(longest_streak(games), PLAYER)
        .select(
            *PLAYER, "castling_counts", spent(F.col("_seconds")).alias("total_time_spent"), "total_moves",
            "total_win_draw_loss", F.map_concat("_named_results", "_other_results").alias("total_results"),
            "total_en_passant", "total_promotions", "total_games",
            "longest_winning_streak", "longest_losing_streak", "most_played_opponent", "highest_rating",
            F.struct(
                F.col("_day")["date"].alias("date"), spent(F.col("_day")["seconds"])["total_time"].alias("time_spent")
            ).alias("most_time_spent_day_dict"),
            "my_openings", "timeclass_counts", "timecontrol_counts", "biggest_games", "last_game_ratings",
        )
    )


_GAME_CARD = ("date", "moves", "my_rating", "opp_rating", "my_num_moves", "link")


def collect_statistics(games: DataFrame) -> DataFrame:
    """Summary per player: favourite openings and opponents, shares, hours, quickest mate, best win."""

    def card(name: str) -> Column:
        return records()[name].column(_GAME_CARD)

    def listed(top: DataFrame, name: str, *fields: str) -> DataFrame:
        """At most five ranked rows per player as one array."""
        ordered = F.array_sort(F.collect_list(F.struct("rn", *fields)))
        return top.groupBy(*PLAYER).agg(
            F.transform(ordered, lambda e: F.struct(*[e[f].alias(f) for f in fields])).alias(name)
        )

    shares = [
        (scoring.ratio(F.count_if(_outcome_is(o)), F.count("*")) * 100).alias(f"{n}_percentage")
        for o, n in (("win", "win"), ("lose", "loss"), ("draw", "draw"))
    ]
    scalars = games.groupBy(*PLAYER).agg(
        F.struct(*shares).alias("win_loss_draw_percentages"),
        card("checkmate").alias("quickest_checkmate"),
        (F.sum("time_spent") / 3600).alias("total_time_spent"),
        card("victory").alias("best_game_by_rating"),
    )
    return scalars.join(
        listed(most_played_openings(games), "most_played_openings", "eco", "win_rate", "games_played"), PLAYER
    ).join(listed(top_opponents(games), "most_played_opponent", "opp_username", "games_played"), PLAYER)
