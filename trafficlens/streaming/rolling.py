"""Dump files as they arrive: new hours join the traffic table, complete windows get models, and the
days they are centred on are scored.

What a round needs of earlier ones is small: the ledger of hours, and sums of their slices. Raw hours
of earlier rounds are read only where a lower version replaces one of theirs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.functions.hours import EPOCH
from trafficlens.operators.anomalies import anomalies_from_scores
from trafficlens.operators.windows import DAY, WEEK, merged_slices, models_of_slices, scores_of_slices, slice_sums
from trafficlens.plans.incremental import changed_windows, days_of_windows, middle, windows_complete
from trafficlens.schema import with_hour_number
from trafficlens.sinks import replace_window_models, write_slice_sums, write_traffic_table
from trafficlens.sources import parse_dump_lines, read_traffic_table
from trafficlens.streaming.ledger import DAYS_DDL, HOURS_DDL, LIVE, REPLACED, Hour, hours_known, read_snapshot, served, write_snapshot


@dataclass(frozen=True)
class RollingPaths:
    """Where a rolling run keeps its tables."""

    traffic: str  # rows by round and date; read with rolled_traffic
    models: str  # window models by date of the middle
    checkpoint: str

    @property
    def hours(self) -> str:
        return f"{self.checkpoint.rstrip('/')}_hours"

    @property
    def days(self) -> str:
        return f"{self.checkpoint.rstrip('/')}_days"

    @property
    def slices(self) -> str:
        return f"{self.models.rstrip('/')}_slices"

    @property
    def scores(self) -> str:
        return f"{self.models.rstrip('/')}_daily"


def roll_dumps(
    spark: SparkSession, folder: str, traffic_path: str, models_path: str, checkpoint: str,
    anchor: dt.datetime, size: int = WEEK, step: int = DAY, files_per_batch: int = DAY,
    mode: str = "fail",
) -> StreamingQuery:
    """Start reading the dump files that are there and not yet read; ends when all are in.

    Each round writes its own folders, so a round repeated after a failure replaces its rows instead
    of doubling them. Files may arrive in any order and late: a window is published when an hour after
    its end is there, and again when hours of it come later. Of several files of an hour that of the
    lowest version counts, in whatever order they come, and of equal versions the first.
    """
    lines = (
        spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch)
        .format("text").load(folder)
        .select("value", F.col("_metadata.file_name").alias("file_name"))
    )
    traffic = parse_dump_lines(lines, mode=mode, with_version=True)
    paths = RollingPaths(traffic_path, models_path, checkpoint)
    return (
        traffic.writeStream.foreachBatch(lambda batch, number: roll_round(batch, number, paths, anchor, size, step))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def roll_round(
    batch: DataFrame, number: int, paths: RollingPaths, anchor: dt.datetime, size: int = WEEK, step: int = DAY,
) -> None:
    """Take in the rows of a round: traffic with the ``version`` of the file each is from.

    Rounds are numbered from 0 without gaps. A round may be done again; it comes to the same.
    """
    spark = batch.sparkSession
    rows = with_hour_number(batch)
    known = hours_known(spark, paths.hours, number - 1)
    # A row for each file of the round, by its name alone.
    arrived = [(r.hour_no, r.version) for r in rows.select("hour_no", "version").distinct().collect()]
    ledger = served(known, arrived, number)
    mine = {h.hour_no: h.version for h in ledger if h.batch == number and h.state == LIVE}
    if mine:
        live = rows.where(F.struct("hour_no", "version").isin([F.struct(F.lit(h).cast("bigint"), F.lit(v).cast("bigint")) for h, v in sorted(mine.items())]))
        own = f"{paths.traffic}/batch={number}"
        write_traffic_table(live.drop("version"), own)
        write_slice_sums(slice_sums(read_traffic_table(spark, own), anchor, size, step), f"{paths.slices}/batch={number}")
        _take_back(spark, paths, known, ledger, anchor, size, step)
        days = _bring_up_to_date(spark, paths, number, known, ledger, sorted(mine), anchor, size, step)
    else:
        days = []
    scored = {r.day_no: r.batch for r in read_snapshot(spark, DAYS_DDL, paths.days, number - 1).collect()}
    scored.update({d: number for d in days})
    write_snapshot(spark, sorted(scored.items()), DAYS_DDL, paths.days, number)
    # Last, as it says that the round is done.
    write_snapshot(spark, [(h.hour_no, h.version, h.batch, h.state) for h in ledger], HOURS_DDL, paths.hours, number)


def _take_back(spark, paths: RollingPaths, known: list[Hour], ledger: list[Hour], anchor, size, step) -> None:
    """Make the slice sums of earlier rounds anew for the dates of which an hour has been replaced."""
    before = {(h.hour_no, h.batch) for h in known if h.state == REPLACED}
    now = [h for h in ledger if h.state == REPLACED and (h.hour_no, h.batch) not in before]
    for batch in sorted({h.batch for h in now}):
        gone = sorted(h.hour_no for h in ledger if h.state == REPLACED and h.batch == batch)
        dates = sorted({_date(h.hour_no // DAY) for h in now if h.batch == batch})
        rows = with_hour_number(read_traffic_table(spark, f"{paths.traffic}/batch={batch}", dates=dates))
        left = slice_sums(rows.where(~F.col("hour_no").isin(gone)), anchor, size, step)
        write_slice_sums(left, f"{paths.slices}/batch={batch}", dates)


def _bring_up_to_date(spark, paths: RollingPaths, number: int, known, ledger, hours: list[int], anchor, size, step) -> list[int]:
    """Models and daily scores of the windows that a round changes, from slice sums alone; the day numbers scored."""
    newest = lambda files: max((h.hour_no for h in files if h.state == LIVE), default=None)
    complete = windows_complete(anchor, newest(ledger), size, step)
    wanted = changed_windows(anchor, hours, newest(known), newest(ledger), size, step)
    days = {middle(anchor, k, size, step) for k in wanted} | {_date(h // DAY) for h in hours}
    # All windows centred on those days; the last of a day with a model scores it.
    windows = {k for k in range(complete) if middle(anchor, k, size, step) in days}
    if windows:
        parts = stored_slices(spark, paths, days_of_windows(anchor, windows, size, step) | days, anchor, complete)
        models = models_of_slices(parts, size, step).where(F.col("k").isin(sorted(windows)))
        replace_window_models(models, paths.models)
        numbers = sorted((d - EPOCH.date()).days for d in days)
        scores = scores_of_slices(parts, size, step).where(F.col("day_no").isin(numbers))
        scores.write.mode("overwrite").parquet(f"{paths.scores}/batch={number}")
        return numbers
    return []


def stored_slices(spark: SparkSession, paths: RollingPaths, days: set[dt.date], anchor: dt.datetime, windows: int) -> DataFrame:
    """Slice parts of some days, added up over the rounds; no other day is read, and no raw hour."""
    table = spark.read.option("basePath", paths.slices).parquet(f"{paths.slices}/batch=*")
    return merged_slices(table.where(F.col("date").isin(sorted(days))), anchor, windows)


def rolled_traffic(spark: SparkSession, paths: RollingPaths, dates: list[dt.date] | None = None) -> DataFrame:
    """The rows of all rounds, each hour from the file that serves it."""
    rows = with_hour_number(read_traffic_table(spark, paths.traffic, dates=dates))
    gone = read_snapshot(spark, HOURS_DDL, paths.hours).where(F.col("state") == REPLACED).select("hour_no", "batch")
    return rows.join(gone, ["hour_no", "batch"], "left_anti").drop("batch")


def rolled_scores(spark: SparkSession, paths: RollingPaths) -> DataFrame:
    """Daily scores of all pages as the rounds have left them: of each day, those of the last round that scored it."""
    days = read_snapshot(spark, DAYS_DDL, paths.days)
    rows = spark.read.option("basePath", paths.scores).parquet(f"{paths.scores}/batch=*")
    return rows.join(days, ["day_no", "batch"], "left_semi").drop("batch")


def rolled_anomalies(spark: SparkSession, paths: RollingPaths, deviations: float = 3.0) -> DataFrame:
    """Days with an hour more than ``deviations`` off, as :func:`moving_average_anomalies` finds them."""
    return anomalies_from_scores(rolled_scores(spark, paths), deviations)


def _date(day_no: int) -> dt.date:
    return EPOCH.date() + dt.timedelta(days=day_no)
