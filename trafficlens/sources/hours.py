"""Hour ranges: which dump files to read, and which hours have none."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.hours import day_number, hour_number_from, timestamp_of


def paths_for_hours(folder: str, start: dt.datetime, hours: int) -> list[str]:
    """One glob per hour, for :func:`trafficlens.sources.read_dumps`."""
    times = (start + dt.timedelta(hours=i) for i in range(hours))
    return [f"{folder.rstrip('/')}/pagecounts-{t:%Y%m%d-%H}*" for t in times]


def expected_hours(spark: SparkSession, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Every hour number from start up to, not including, end."""
    return spark.range(hour_number_from(start), hour_number_from(end)).select(
        F.col("id").alias("hour_no")
    )


DUMP_NAME = r"pagecounts-(\d{8})-(\d{2,})[^/]*$"


def dump_hour(path: Column) -> Column:
    """Hour number of a dump file from its name, NULL if the name tells none."""
    digits, rest = F.regexp_extract(path, DUMP_NAME, 1), F.regexp_extract(path, DUMP_NAME, 2)
    part = lambda column, start, length: F.substring(column, start, length).try_cast("int")
    date = F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date")
    return F.when(part(rest, 1, 2) < 24, F.unix_date(date).cast("bigint") * 24 + part(rest, 1, 2))


def dump_version(path: Column) -> Column:
    """The digits after the hour in a dump file's name, as a number; 0 if there are none."""
    return F.coalesce(F.substring(F.regexp_extract(path, DUMP_NAME, 2), 3, 18).try_cast("bigint"), F.lit(0).cast("bigint"))


def _files(spark: SparkSession, paths) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path")


def list_dumps(spark: SparkSession, paths) -> DataFrame:
    """Rows (hour_no, version, path) of the dump files in a folder, or of paths or globs, from their
    names alone. The version is the digits after the hour, as a number. Files of other names are
    passed over; :func:`other_files` lists them.
    """
    path = F.col("path")
    return _files(spark, paths).select(dump_hour(path).alias("hour_no"), dump_version(path).alias("version"), "path").where("hour_no is not null")


def other_files(spark: SparkSession, paths) -> DataFrame:
    """Rows (path) of the files whose names tell no hour."""
    return _files(spark, paths).where(dump_hour(F.col("path")).isNull())


def first_version(listing: DataFrame, keys: tuple[str, ...] = (), most: int | None = 9) -> DataFrame:
    """The file each hour is served by: its lowest version from 0 to ``most``, without it the lowest.

    ``listing`` has hour_no and version (the digits after the hour in the file name), further
    ``keys`` if several listings are in it, and a path where there is one.
    """
    known = listing.where(F.col("version") >= 0) if most is None else listing.where(F.col("version").between(0, most))
    path = [F.min_by("path", F.struct("version", "path")).alias("path")] if "path" in listing.columns else []
    return known.groupBy(*keys, "hour_no").agg(F.min("version").alias("version"), *path)


def coverage_gaps(expected: DataFrame, listing: DataFrame, keys: tuple[str, ...] = (), most: int | None = 9) -> DataFrame:
    """Expected hours that no listed file serves, by day (and ``keys``), with the missing count.

    As in the audit's rule only versions up to ``most`` serve an hour."""
    missing = expected.join(first_version(listing, keys, most), [*keys, "hour_no"], "left_anti")
    day = F.date_from_unix_date(day_number("hour_no")).alias("date")
    return missing.groupBy(*keys, day).agg(
        F.count("*").alias("missing_hours"),
        timestamp_of(F.min("hour_no")).alias("first_missing"),
    )
