"""Delimited text: hourly dumps, prepared traffic, per-day anomalies, whitelists.

Fields are split on the delimiter with trailing empty fields dropped; there is no header and no
quoting, so titles with quotes or percent escapes come through unchanged. Further fields are
ignored. ``mode`` says what a bad line does: "fail" stops the job, "drop" leaves the line out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.hours import calendar_fields
from trafficlens.schema import ANOMALIES_DDL, TRAFFIC_FIELDS, with_timestamp
from trafficlens.sinks import NULL_FIELD
from trafficlens.sources.hours import dump_hour, dump_version, first_version, list_dumps, other_files

DUMP_FIELDS = ("project", "title", "requests", "bytes")
NUMBER_TYPES = {
    "requests": "bigint", "bytes": "bigint", "visit_max": "bigint",
    "year": "int", "month": "int", "day": "int", "hour": "int",
    "relative_to_quantile": "double", "relative_to_norm": "double",
}


def read_dumps(spark: SparkSession, paths, mode: str = "fail", all_versions: bool = False) -> DataFrame:
    """Raw hourly dumps ``pagecounts-YYYYMMDD-HH*`` (gz or plain) of a folder, paths or globs as traffic rows.

    Of several files of one hour that of the lowest version is read, so that no hour counts twice;
    with ``all_versions`` every file is. A file whose name tells no hour stops the job, or is left out
    if ``mode`` is "drop". The list of files is bounded by the hours of the calendar. Lines with fewer
    than four fields are dropped in either mode. A gz file is one task: for repeated use convert dumps
    once with :func:`trafficlens.sinks.write_traffic_table`. A truncated archive stops the job unless
    ``spark.sql.files.ignoreCorruptFiles`` is set.
    """
    if not all_versions:
        paths = served_files(spark, paths, mode)
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_name").alias("file_name")
    )
    return parse_dump_lines(lines, mode=mode)


def served_files(spark: SparkSession, paths, mode: str = "fail") -> list[str]:
    """The dump files among paths or globs that serve an hour: of each its lowest version."""
    if mode == "fail":
        others = [r.path for r in other_files(spark, paths).limit(5).collect()]
        if others:
            raise ValueError(f"the names of these files tell no hour: {', '.join(others)}")
    chosen = first_version(list_dumps(spark, paths), most=None).select("path").collect()
    if not chosen:
        raise ValueError(f"no dump files in {paths}")
    return sorted(r.path for r in chosen)


def read_folder(spark: SparkSession, folder: str, mode: str = "fail") -> DataFrame:
    """All hours of a folder, each from the file of its lowest version, whatever that is.

    Files of other names, such as counts by project, are passed over.
    """
    return read_dumps(spark, served_files(spark, folder, "drop"), mode, all_versions=True)


def read_dump_file(spark: SparkSession, path: str) -> DataFrame:
    """One dump file, its hour taken from the path, as a nested ``time``; short lines fail."""
    lines = spark.read.text(path).select("value", F.lit(path).alias("file_name"))
    rows = parse_dump_lines(lines, mode="fail", short_lines="fail")
    time = F.struct("year", "month", "day", "hour").alias("time")
    return rows.select(*DUMP_FIELDS, time)


def parse_dump_lines(lines: DataFrame, mode: str = "fail", short_lines: str = "drop", with_version: bool = False) -> DataFrame:
    """Traffic rows from (value, file_name) lines; the hour is read off the file name, and with
    ``with_version`` the version, too."""
    name = F.substring_index("file_name", "/", -1)
    rows = _split_lines(lines, " ", len(DUMP_FIELDS), short_lines, keep=[name.alias("name")])
    clock = [
        F.substring("name", start, length).alias(field)
        # Fixed offsets of the name pattern, counted from 1.
        for field, start, length in (
            ("year", 12, 4), ("month", 16, 2), ("day", 18, 2), ("hour", 21, 2),
        )
    ]
    version = [dump_version(F.col("name")).alias("version")] if with_version else []
    named = rows.select(*_named(DUMP_FIELDS), *clock, *version)
    return with_timestamp(_typed(named, TRAFFIC_FIELDS, mode, keep=["version"] if with_version else []))


def dump_fields(lines: DataFrame) -> DataFrame:
    """All columns of ``lines`` (text, path), whether the text has ``enough`` fields, the fields, the
    numbers also as text, and the hour from the path. Nothing is left out and nothing fails."""
    parts = F.split(F.rtrim("text"), " ")
    rows = lines.withColumn("parts", parts).withColumn("enough", F.coalesce(F.size("parts") >= len(DUMP_FIELDS), F.lit(False)))
    field = lambda k: F.when(F.col("enough"), F.get("parts", F.lit(k)))
    named = rows.select("*", *[field(k).alias(f"{n}_text" if n in NUMBER_TYPES else n) for k, n in enumerate(DUMP_FIELDS)])
    hour = dump_hour(F.substring_index("path", "/", -1))
    text = lambda n: F.when(F.col(n) != NULL_FIELD, F.col(n)).alias(n)
    kept = [c for c in named.columns if c not in ("project", "title", "parts")]
    return named.select(*kept, text("project"), text("title"), F.col("requests_text").try_cast("bigint").alias("requests"),
                        F.col("bytes_text").try_cast("bigint").alias("bytes"), *calendar_fields(hour))


def read_traffic(spark: SparkSession, paths, sep: str = " ", mode: str = "fail") -> DataFrame:
    """Prepared traffic: project, title, requests, bytes, year, month, day, hour."""
    rows = _split_lines(spark.read.text(paths), sep, len(TRAFFIC_FIELDS), mode)
    return with_timestamp(_typed(rows.select(*_named(TRAFFIC_FIELDS)), TRAFFIC_FIELDS, mode))


def read_anomalies(spark: SparkSession, paths, sep: str = " ", mode: str = "fail") -> DataFrame:
    """Per-day anomalies as written by :func:`trafficlens.sinks.write_text`."""
    fields = tuple(part.split()[0] for part in ANOMALIES_DDL.split(","))
    rows = _split_lines(spark.read.text(paths), sep, len(fields), mode)
    return _typed(rows.select(*_named(fields)), fields, mode)


def read_whitelist(
    spark: SparkSession, paths, sep: str = " ", titles_only: bool = False, mode: str = "fail"
) -> DataFrame:
    """Pages to keep: lines of ``project title``, or of a title for every project."""
    fields = ("title",) if titles_only else ("project", "title")
    rows = _split_lines(spark.read.text(paths).where("value != ''"), sep, len(fields), mode)
    return rows.select(*_named(fields))


def _split_lines(lines: DataFrame, sep: str, arity: int, short_lines: str, keep=()) -> DataFrame:
    """Split ``value`` into the array ``parts`` with at least ``arity`` fields."""
    value = F.regexp_replace("value", f"({re.escape(sep)})+$", "") if sep != " " else F.rtrim("value")
    parts = F.split(value, re.escape(sep))
    rows = lines.select(parts.alias("parts"), F.col("value"), *keep)
    enough = F.size("parts") >= arity
    if short_lines == "fail":
        message = F.concat(F.lit(f"fewer than {arity} fields: "), F.col("value"))
        checked = F.when(enough, F.col("parts")).otherwise(F.raise_error(message))
        return rows.withColumn("parts", checked)
    return rows.where(enough)


def _named(fields) -> list[Column]:
    return [F.col("parts")[i].alias(name) for i, name in enumerate(fields)]


def _typed(rows: DataFrame, fields, mode: str, keep=()) -> DataFrame:
    """Cast the number fields; a text that is no number fails or drops its row."""
    if mode not in ("fail", "drop"):
        raise ValueError(f"mode must be 'fail' or 'drop', not {mode!r}")
    numbers = [name for name in fields if name in NUMBER_TYPES]

    def number(name: str) -> Column:
        value = F.col(name).try_cast(NUMBER_TYPES[name])
        if mode == "fail":
            message = F.concat(F.lit(f"not a number in {name}: "), F.col(name))
            value = F.coalesce(value, F.raise_error(message).cast(NUMBER_TYPES[name]))
        # The writers' token for NULL is no bad number.
        return F.when(F.col(name) != NULL_FIELD, value)

    if mode == "drop":
        good = [F.col(n).try_cast(NUMBER_TYPES[n]).isNotNull() | (F.col(n) == NULL_FIELD) for n in numbers]
        for test in good:
            rows = rows.where(test)
    texts = lambda n: F.when(F.col(n) != NULL_FIELD, F.col(n))
    return rows.select(*[(number(n) if n in numbers else texts(n)).alias(n) for n in fields], *keep)
