"""Writers: tables, exports, the run log and the month layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery import schema
from rookery.functions.calendar import month_start

# How a write treats a table that is already there.
DISPOSITIONS = {"append": "append", "truncate": "overwrite", "empty": "errorifexists"}

MONTH_COLUMN = "game_month_start"


def write_table(df: DataFrame, path: str, disposition: str = "append") -> bool:
    """Write a Parquet table, creating it when absent; an empty frame writes nothing."""
    mode = DISPOSITIONS[disposition]
    if df.isEmpty():
        return False
    df.write.mode(mode).parquet(path)
    return True


def materialize(df: DataFrame, name: str, how: str, path: str | None = None) -> DataFrame:
    """Publish a model as a ``view`` or as a ``table`` rebuilt in full."""
    spark = df.sparkSession
    if how == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if how != "table" or path is None:
        raise ValueError("materialize a model as 'view', or as 'table' with a path")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def month_layout(df: DataFrame, date_column: str, cluster_by: list[str]) -> DataFrame:
    """Rows placed by month and cluster column and sorted for range pruning inside each file.

    Ranging over month and cluster columns together splits a heavy month, or a heavy player
    inside it, over many tasks instead of sending it to one.
    """
    keyed = df.withColumn(MONTH_COLUMN, month_start(F.col(date_column)))
    order = [MONTH_COLUMN, *cluster_by, date_column]
    return keyed.repartitionByRange(*dict.fromkeys(order)).sortWithinPartitions(*dict.fromkeys(order))


def write_month_layout(df: DataFrame, path: str, date_column: str, cluster_by: list[str], mode: str = "overwrite") -> None:
    month_layout(df, date_column, cluster_by).write.mode(mode).partitionBy(MONTH_COLUMN).parquet(path)


def flat_columns(df: DataFrame) -> DataFrame:
    """Drop the record text and turn nested columns into JSON text."""
    kept = [f for f in df.schema if f.name != "pgn"]
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in kept]
    )


def export_csv(df: DataFrame, path: str) -> None:
    flat_columns(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.drop("pgn").write.mode("overwrite").json(path)


def statistics_documents(statistics: DataFrame) -> DataFrame:
    """One JSON document per player, with every field: what a player lacks reads null."""
    return statistics.select("my_username", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def export_statistics(statistics: DataFrame, path: str) -> None:
    statistics_documents(statistics).write.mode("overwrite").partitionBy("my_username").text(path)


def run_log_rows(runs: DataFrame) -> DataFrame:
    """Run summaries in the declared shape of the log."""
    return runs.select(
        "run_at",
        "username",
        "status",
        "games_fetched",
        "games_uploaded",
        F.round("duration_seconds", 2).alias("duration_seconds"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce("triggered_by", F.lit("local")).alias("triggered_by"),
    )


def append_run_log(runs: DataFrame, path: str) -> None:
    run_log_rows(runs).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RUN_LOG).parquet(path)


def run_log_summary(log: DataFrame) -> DataFrame:
    """Totals over the log."""
    return log.agg(
        F.coalesce(F.sum("games_fetched"), F.lit(0)).alias("total_fetched"),
        F.coalesce(F.sum("games_uploaded"), F.lit(0)).alias("total_uploaded"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
    )


def failed_usernames(log: DataFrame) -> DataFrame:
    """Players with a failed run, as rows: the list may be long."""
    return log.filter(F.col("status") == "failed").select("username").distinct()
