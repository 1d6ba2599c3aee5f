"""Helpers that several operators of this package share."""

from __future__ import annotations

import string
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NON_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ship(module: str) -> None:
    """Send the functions of ``module`` to executors by value, so that these need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def space_words(text: Column) -> Column:
    """Words between white space; an empty array for null and blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def norm_words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and characters beyond ASCII; an empty array for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NON_WORDS), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once per row however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the regex class ``[characters]``."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def token_table(outside: Iterable[int]) -> bytes:
    """For ``tokens``: A-Z lower-cased, the bytes ``outside`` of tokens as blanks, every other byte as it is."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for byte in outside:
        table[byte] = 32
    return bytes(table)


def tokens(texts: pa.StringArray, table: bytes, limit: int = 4 << 20) -> Iterator[tuple[int, int, pa.BinaryArray, np.ndarray]]:
    """(first, last, tokens, counts) per slice of rows ``first:last`` of about ``limit`` bytes, in a task.

    ``tokens`` are all runs of bytes that ``table`` does not turn into blanks, row after row; ``counts`` says how many
    each row has (a null has none). Separators are ASCII, so a token of valid UTF-8 is valid.
    """
    texts = texts.fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = memoryview(texts.buffers()[2] or b"")
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        chars = np.frombuffer(bytes(data[ends[first] : ends[last]]).translate(table), np.uint8)
        bounds = ends[first : last + 1] - ends[first]
        inside = chars != 32
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        heads = bounds[bounds < len(chars)]
        begins[heads] = inside[heads]
        starts = np.flatnonzero(begins)
        kept = chars[inside]
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(kept)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        yield first, last, words, np.diff(np.searchsorted(starts, bounds))
        first = last


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def thinned(df: DataFrame, order: str, want: int, group: str | None = None) -> DataFrame:
    """The rows of smallest hash ``order``, about four times ``want`` (of each ``group``), all if there are fewer.

    What is sorted for a sample of ``want`` rows then does not grow with the table. One narrow count comes first.
    """
    share = F.shiftrightunsigned(F.col(order).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), 11) / float(1 << 53)
    if group is None:
        return df.where(share <= 4 * want / max(1, df.count()))
    bounds = df.groupBy(group).agg(F.count("*").alias("_total"))
    return df.join(bounds, group).where(share <= 4 * want / F.col("_total")).drop("_total")
