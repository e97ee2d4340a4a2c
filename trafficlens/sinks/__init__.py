"""Writers. Text output is space separated, without header or quotes; tables are Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.hours import date_of
from trafficlens.schema import PAGE, TRAFFIC_FIELDS, with_hour_number


NULL_FIELD = "\\N"


def write_text(df: DataFrame, path: str, sep: str = " ", mode: str = "overwrite") -> None:
    """All columns in order, joined by ``sep``; NULL becomes the field \\N.

    A field that contains the separator or a line break would shift the columns of its line for
    every reader, so it stops the job.
    """
    def field(name: str) -> Column:
        text = F.col(name).cast("string")
        broken = text.contains(sep) | text.contains("\n")
        message = F.concat(F.lit(f"{name} contains the separator: "), text)
        return F.coalesce(F.when(broken, F.raise_error(message).cast("string")).otherwise(text), F.lit(NULL_FIELD))

    df.select(F.concat_ws(sep, *[field(name) for name in df.columns]).alias("value")).write.mode(mode).text(path)


def write_traffic_table(
    traffic: DataFrame, path: str, mode: str = "overwrite", files_per_date: int = 8
) -> None:
    """Traffic as Parquet by date, pages sorted within files.

    A day is spread over ``files_per_date`` tasks by page. The rebalance hint lets adaptive
    execution split a task that got too much and merge small ones, and unlike a range partitioning
    it reads its input once. Sorting lets filters on a page skip row groups.
    """
    dated = with_hour_number(traffic).withColumn("date", date_of("hour_no"))
    rows = _spread(dated.select(*TRAFFIC_FIELDS, "date"), "date", files_per_date)
    rows.sortWithinPartitions("date", *PAGE, "hour").write.mode(mode).partitionBy("date").parquet(path)


def write_slice_sums(sums: DataFrame, path: str, dates: list | None = None) -> None:
    """Slice sums, one folder per date; with ``dates`` over those of these dates, which must all have
    been there. A date that has no sums left gets an empty file in place of its rows."""
    dated = sums.withColumn("date", F.date_from_unix_date("day_no"))
    writer = _spread(dated, "date", 2).write.mode("overwrite")
    if dates is None:
        writer.partitionBy("date").parquet(path)
        return
    for date in dates:
        own = dated.where(F.col("date") == F.lit(date)).drop("date")
        own.write.mode("overwrite").parquet(f"{path}/date={date}")


def write_window_models(
    models: DataFrame, path: str, mode: str = "overwrite", files_per_date: int = 2
) -> None:
    """Window models, one folder per date of the window's middle."""
    dated = models.withColumn("window_mid_date", F.col("window_mid").cast("date"))
    rows = _spread(dated, "window_mid_date", files_per_date)
    rows.write.mode(mode).partitionBy("window_mid_date").parquet(path)


def _spread(df: DataFrame, date: str, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64(*PAGE), F.lit(parts))
    return df.withColumn("part", part).hint("rebalance", date, "part").drop("part")


def replace_window_models(models: DataFrame, path: str, files_per_date: int = 2) -> None:
    """Write models over those of the same dates of the window's middle; other dates stay."""
    dated = models.withColumn("window_mid_date", F.col("window_mid").cast("date"))
    writer = _spread(dated, "window_mid_date", files_per_date).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("window_mid_date").parquet(path)


def replace_daily_sums(sums: DataFrame, path: str, files_per_date: int = 2) -> None:
    """Write sums by page and day over those of the same dates; other dates stay."""
    dated = sums.withColumn("date", F.date_from_unix_date("day_no"))
    writer = _spread(dated, "date", files_per_date).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_by(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """One folder per value of ``column``, such as the severity or the project."""
    df.write.mode(mode).partitionBy(column).parquet(path)
