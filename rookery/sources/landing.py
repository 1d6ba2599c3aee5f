"""Reading archives and the landing table, and appending to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery import schema
from rookery.functions.calendar import utc_date

# Year words that mean every year.
ALL_YEARS = ("ALL", "0000")

# Column that keeps the text of a month document that cannot be read.
CORRUPT = "_corrupt_record"

_GAME_FIELDS = [f.name for f in schema.GAME if f.name not in ("white", "black", "accuracies")]
_PLAYER_FIELDS = [f.name for f in schema.PLAYER]


def flatten_games(games: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nested ``game`` structs to the 21 flat landing columns; a missing sub-document gives NULLs."""
    game = F.col("game")
    sides = [game[side][f].alias(f"{side}_{f}") for side in ("white", "black") for f in _PLAYER_FIELDS]
    accuracy = [game["accuracies"][side].alias(f"{side}_accuracy") for side in ("white", "black")]
    return games.select(*[game[f].alias(f) for f in _GAME_FIELDS], *sides, *accuracy, *(keep or []))


def nest_games(raw: DataFrame) -> DataFrame:
    """Flat landing rows back to one nested ``game`` struct per row; the inverse of ``flatten_games``."""
    sides = [
        F.struct(*[F.col(f"{side}_{f}").alias(f) for f in _PLAYER_FIELDS]).alias(side) for side in ("white", "black")
    ]
    has_accuracy = F.col("white_accuracy").isNotNull() | F.col("black_accuracy").isNotNull()
    accuracy = F.when(has_accuracy, F.struct(F.col("white_accuracy").alias("white"), F.col("black_accuracy").alias("black")))
    return raw.select(F.struct(*_GAME_FIELDS, *sides, accuracy.alias("accuracies")).alias("game"), "loaded_by_user")


def read_month_archives(spark: SparkSession, path: str) -> DataFrame:
    """Nested games of a folder of month documents laid out as ``loaded_by_user=/year=/month=``.

    Documents that cannot be read are in ``broken_documents``.
    """
    documents = _documents(spark, path)
    partitions = [c for c in documents.columns if c not in ("games", CORRUPT)]
    return documents.filter(F.col(CORRUPT).isNull()).select(F.explode("games").alias("game"), *partitions)


def broken_documents(spark: SparkSession, path: str) -> DataFrame:
    """Month documents that cannot be read, whole, as text, with the player, year and month of their folder."""
    documents = _documents(spark, path)
    return documents.filter(F.col(CORRUPT).isNotNull()).drop("games").withColumnRenamed(CORRUPT, "document")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    kept = T.StructType([*schema.MONTH_ARCHIVE.fields, T.StructField(CORRUPT, T.StringType())])
    document = F.from_json("value", kept, {"columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).withColumn("_d", document).select("*", "_d.games", f"_d.{CORRUPT}").drop("value", "_d")


def scan_raw_games(spark: SparkSession, path: str) -> DataFrame:
    """The landing table, with the columns of every append."""
    declared = spark.read.option("mergeSchema", "true").parquet(path)
    return declared.select(*[F.col(f.name).cast(f.dataType) for f in schema.RAW_GAMES if f.name in declared.columns],
                           *[c for c in declared.columns if c not in schema.RAW_GAMES.names])


def tracked_usernames(spark: SparkSession, path: str) -> DataFrame:
    """The typed CSV seed of players to follow."""
    return spark.read.option("header", "true").schema(schema.TRACKED_USERNAMES).csv(path)


def is_all_years(year: object) -> bool:
    return str(year).strip().upper() in ALL_YEARS


def year_filter(df: DataFrame, year: object, column: str = "game_year") -> DataFrame:
    """Rows of one year or of all; parsed games, which have no year column, are asked by their date."""
    if is_all_years(year):
        return df
    if column not in df.columns and "date" in df.columns:
        return df.filter(F.substring(F.col("date").cast("string"), 1, 4) == str(int(year)))
    return df.filter(F.col(column) == int(year))


def month_number(epoch_seconds: Column) -> Column:
    """Months as one comparable number, ``year * 100 + month``."""
    date = utc_date(epoch_seconds)
    return F.year(date) * 100 + F.month(date)


def month_prune(archive: DataFrame, year: object = "ALL", since: tuple[int, int] | None = None) -> DataFrame:
    """Keep the months of one year and from the high-water month on, which is itself read again.

    ``year`` and ``month`` are partition columns of the archive, so both predicates prune folders.
    """
    pruned = year_filter(archive, year, "year")
    if since is None:
        return pruned
    since_year, since_month = since
    return pruned.filter(
        (F.col("year") > since_year) | ((F.col("year") == since_year) & (F.col("month") >= since_month))
    )


def with_load_metadata(games: DataFrame, loaded_by: Column, uploaded_at: Column | None = None) -> DataFrame:
    """Stamp a batch and drop the rows that have no uuid."""
    stamp = F.current_timestamp() if uploaded_at is None else uploaded_at
    return games.filter(F.col("uuid").isNotNull()).withColumns({"uploaded_at": stamp, "loaded_by_user": loaded_by})


def append_raw_games(batch: DataFrame, path: str) -> None:
    """Append a stamped batch; columns the table lacks are allowed and show up on the next scan."""
    batch.write.mode("append").option("compression", "zstd").parquet(path)


def plays(username: str) -> Column:
    """A player on either colour, ignoring case."""
    name = username.lower()
    return (F.lower("white_username") == name) | (F.lower("black_username") == name)


def existing_uuids(raw: DataFrame, username: str, since_end_time: int | None = None) -> DataFrame:
    rows = raw.filter(plays(username))
    if since_end_time is not None:
        rows = rows.filter(F.col("end_time") >= since_end_time)
    return rows.select("uuid").distinct()


def max_end_time(raw: DataFrame, username: str) -> DataFrame:
    return raw.filter(plays(username)).agg(F.max("end_time").alias("max_end_time"))


def row_count_for_user(raw: DataFrame, username: str) -> DataFrame:
    return raw.filter(plays(username)).agg(F.count("*").alias("n"))


def _players_of_row() -> Column:
    return F.explode(F.array_distinct(F.array(F.lower("white_username"), F.lower("black_username"))))


def high_water_marks(raw: DataFrame) -> DataFrame:
    """Latest game end and row count of every player, names folded to lower case."""
    players = raw.select("end_time", _players_of_row().alias("player")).filter(F.col("player").isNotNull())
    return players.groupBy("player").agg(F.max("end_time").alias("max_end_time"), F.count("*").alias("landed_rows"))
