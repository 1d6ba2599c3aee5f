"""Outcome, rate and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Result words that count as a draw.
DRAW_RESULTS = ("draw", "stalemate", "repetition", "insufficient", "timevsinsufficient", "agreed", "50move")

# Outcomes.
OUTCOMES = ("win", "draw", "lose")

# Fixed value: text that stands for NULL inside a surrogate key.
KEY_NULL = "_dbt_utils_surrogate_key_null_"

# Sums of measured doubles are taken over decimals: exact, and so the same whatever order the
# partitions arrive in.
_EXACT = "decimal(38,18)"


def outcome_class(result: Column) -> Column:
    return F.when(result == "win", "win").when(result.isin(*DRAW_RESULTS), "draw").otherwise("lose")


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def win_rate(wins: Column, total: Column, decimals: int = 4) -> Column:
    """Rounded share of wins; NULL when nothing was played."""
    return F.round(ratio(wins, total), decimals)


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast(_EXACT)).cast("double")


def exact_avg(value: Column) -> Column:
    """Mean of a double, over its first 18 decimals."""
    return ratio(exact_sum(value), F.count(value))


def surrogate_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit(KEY_NULL)) for p in parts]))


def count_outcome(outcome: str, column: str = "outcome") -> Column:
    return F.count_if(F.col(column) == outcome)
