"""Lookups against player tables, anti joins and history joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions.scoring import surrogate_key


def with_user_key(df: DataFrame, username: str = "my_username") -> DataFrame:
    """The player key of the dimension, computed in place.

    The dimension holds every player of every game under exactly this key, so no join is needed
    to look it up.
    """
    return df.withColumn("user_key", surrogate_key(F.col(username)))


def join_users(df: DataFrame, users: DataFrame, username: str = "my_username") -> DataFrame:
    """Left join to a given player dimension, for one that may lack players.

    No broadcast is forced: the adaptive planner broadcasts the keys when their measured size
    allows and otherwise splits the hot players of the sorted join.
    """
    keys = users.select(F.col("username").alias(username), "user_key")
    return df.join(keys, username, "left")


def unmatched(left: DataFrame, right: DataFrame, on: dict[str, Column] | list[str], right_on: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``left`` without a partner; ``on`` may name computed keys."""
    if isinstance(on, list):
        return left.join(right.select(*on).distinct(), on, "left_anti")
    right_on = right_on or on
    names = list(on)
    keyed = left.withColumns(on)
    keys = right.select(*[right_on[n].alias(n) for n in names]).distinct()
    return keyed.join(keys, names, "left_anti").drop(*names)


def as_of(history: DataFrame, day: Column) -> DataFrame:
    """Versions that were valid at a point in time."""
    return history.filter(
        (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
    )


def as_of_join(facts: DataFrame, history: DataFrame, key: str, at: str) -> DataFrame:
    """Each fact with the version of its key that was valid at ``at``; facts before the first stay, unmatched.

    An equality on the key carries the join, the interval is checked on each pair of one key.
    """
    h = history.withColumnRenamed(key, "_key")
    valid = (
        (facts[key] == h["_key"])
        & (h["valid_from"] <= facts[at])
        & (h["valid_to"].isNull() | (h["valid_to"] > facts[at]))
    )
    return facts.join(h, valid, "left").drop("_key")
