"""Upserts into partitioned Parquet tables, and versioned history."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.session import stage


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table with at least one file is there."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def require_unique(df: DataFrame, keys: list[str]) -> None:
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"source rows are not unique on {keys}")


def _updated(target: DataFrame, changes: DataFrame, keys: list[str], update: list[str], newest: str | None) -> DataFrame:
    """Target rows; matched ones take the listed columns of the changes, NULLs included.

    With ``newest``, only where that column of the change is later than the row's own.
    """
    flag, marked = "_matched", {c: f"_new_{c}" for c in update}
    given = changes.select(*keys, *[F.col(c).alias(n) for c, n in marked.items()], F.lit(True).alias(flag))
    takes = F.col(flag)
    if newest:
        takes = takes & (F.col(newest).isNull() | (F.col(marked[newest]) > F.col(newest)))
    return target.join(given, keys, "left").select(
        *[F.when(takes, F.col(marked[c])).otherwise(F.col(c)).alias(c) if c in marked else F.col(c) for c in target.columns]
    )


def merge_rows(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], newest: str | None = None) -> DataFrame:
    """The rows a table holds after a merge: updated ones, and source rows without a match added whole."""
    added = source.join(target.select(*keys), keys, "left_anti")
    return _updated(target, source, keys, update, newest).unionByName(added, allowMissingColumns=True)


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    return df.sortWithinPartitions(*order) if order else df


def in_touched(target: DataFrame, touched: DataFrame, partition: str) -> DataFrame:
    """Rows of ``target`` in the partitions of ``touched`` (one column); a semi join that prunes the scan when it runs."""
    found = target.join(touched, partition, "left_semi")
    if not touched.filter(F.col(partition).isNull()).isEmpty():
        found = found.unionByName(target.filter(F.col(partition).isNull()))
    return found


def merge_upsert(
    spark: SparkSession,
    path: str,
    source: DataFrame,
    keys: list[str],
    update: list[str],
    partition: str | None = None,
    schema: T.StructType | None = None,
    cluster_by: list[str] | None = None,
    newest: str | None = None,
    staged: bool = False,
) -> None:
    """Merge ``source`` into the Parquet table at ``path``.

    The table is created when absent. With a partition column, only the partitions that gain or
    change a row are rewritten; they are found in one pass over the stored keys. With ``newest``,
    a stored row changes only for a source row that is later in that column. The result is
    staged in the shared folder first and then written over the old files, so the second step
    can be repeated if it is lost half-way. ``staged`` says that ``source`` is a plain selection from
    a table that is staged already, so that it need not be written again.

    Rows are ranged over partition and cluster columns before they are written: a partition is
    written by few tasks, not by every task of the join, and a heavy one by several.
    """
    if not staged:
        source = stage(source, "merge_source")
    require_unique(source, keys)
    order = [partition, *(cluster_by or keys)] if partition else []
    if not table_exists(spark, path):
        first = _sorted(source.repartitionByRange(*order) if order else source, order)
        writer = first.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(partition) if partition else writer).parquet(path)
        return
    # files of different merges may differ in their columns
    target = spark.read.schema(schema).parquet(path) if schema else spark.read.option("mergeSchema", "true").parquet(path)
    if partition is None:
        stage(merge_rows(target, source, keys, update, newest), "merged").write.mode("overwrite").option("compression", "zstd").parquet(path)
        return

    # Where each source row is stored already, if anywhere: the only scan of the stored keys.
    held = target.select(*keys, F.col(partition).alias("_held_in"), F.lit(True).alias("_held"))
    placed = stage(source.join(held, keys, "left"), "placed")
    touched = placed.select(F.when(F.col("_held"), F.col("_held_in")).otherwise(F.col(partition)).alias(partition)).distinct()
    added = placed.filter(F.col("_held").isNull()).select(*source.columns)
    changes = placed.filter(F.col("_held")).select(*source.columns)
    merged = _updated(in_touched(target, touched, partition), changes, keys, update, newest)
    rows = merged.unionByName(added, allowMissingColumns=True).repartitionByRange(*order)
    result = stage(_sorted(rows, order), "merged", [partition])
    (
        _sorted(result, order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(partition)
        .parquet(path)
    )


def snapshot_check(history: DataFrame, current: DataFrame, key: str, check: list[str], now: Column) -> DataFrame:
    """The next state of a history table after one look at ``current``.

    A key whose checked columns differ from its open version gets that version closed and a new
    one opened; unseen keys open their first version; closed versions never change.
    """
    payload = [c for c in current.columns]
    open_rows = history.filter(F.col("valid_to").isNull())
    closed_rows = history.filter(F.col("valid_to").isNotNull())
    fresh = current.select(F.col(key), F.struct(*payload).alias("_fresh"))
    paired = open_rows.select(F.col(key), F.struct(*history.columns).alias("_open")).join(fresh, key, "full")
    same = reduce(lambda a, b: a & b, [F.col("_open")[c].eqNullSafe(F.col("_fresh")[c]) for c in check])
    opens = F.struct(
        *[F.col("_fresh")[c].alias(c) for c in payload],
        now.cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
    )

    def kept(valid_to: Column) -> Column:
        return F.struct(
            *[F.col("_open")[c].alias(c) for c in payload],
            F.col("_open")["valid_from"].alias("valid_from"),
            valid_to.cast("timestamp").alias("valid_to"),
        )

    versions = (
        F.when(F.col("_open").isNull(), F.array(opens))
        .when(F.col("_fresh").isNull() | same, F.array(kept(F.lit(None))))
        .otherwise(F.array(kept(now), opens))
    )
    live = paired.select(F.inline(versions))
    return closed_rows.select(*live.columns).unionByName(live)


def first_snapshot(current: DataFrame, now: Column) -> DataFrame:
    return current.withColumns({"valid_from": now.cast("timestamp"), "valid_to": F.lit(None).cast("timestamp")})
