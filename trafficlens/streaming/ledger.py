"""Small tables that a stream keeps next to its checkpoint: a whole snapshot a round.

A round reads the snapshot of the round before it and writes its own, so that its cost does not grow
with the number of rounds, and a round done again after a failure comes to the same. Snapshots hold a
row for each hour or day of the calendar and file version, never one for each row of traffic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE, REPLACED, ASIDE = "live", "replaced", "set aside"
HOURS_DDL = "hour_no bigint, version bigint, batch bigint, state string"
DAYS_DDL = "day_no int, batch bigint"


@dataclass(frozen=True)
class Hour:
    """A file of an hour: its version, the round that brought it, and what became of its rows.

    ``live`` rows count; ``replaced`` ones are in the table, but a lower version came later; those of
    a file ``set aside`` were never written.
    """

    hour_no: int
    version: int
    batch: int
    state: str


def served(known: list[Hour], arrived: list[tuple[int, int]], batch: int) -> list[Hour]:
    """The ledger after a round that brought files (hour number, version).

    Of the files of an hour that of the lowest version serves it, of equal versions the earliest
    round's. What the same round has left there before is taken as not there.
    """
    hours: dict[int, list[Hour]] = {}
    for h in known:
        hours.setdefault(h.hour_no, []).append(h)
    for hour_no, version in sorted(set(arrived)):
        files = hours.setdefault(hour_no, [])
        live = next((f for f in files if f.state == LIVE), None)
        if live is not None and live.version <= version:
            files.append(Hour(hour_no, version, batch, ASIDE))
            continue
        if live is not None:
            files.remove(live)
            files.append(Hour(hour_no, live.version, live.batch, REPLACED))
        files.append(Hour(hour_no, version, batch, LIVE))
    return [f for hour_no in sorted(hours) for f in hours[hour_no]]


def write_snapshot(spark: SparkSession, rows: list[tuple], ddl: str, path: str, batch: int) -> None:
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("overwrite").parquet(f"{path}/round={batch}")


def read_snapshot(spark: SparkSession, ddl: str, path: str, batch: int | None = None) -> DataFrame:
    """The snapshot that a round has left, by default the newest; without one no rows."""
    if batch is None:
        batch = newest_round(spark, path)
    if batch is None or batch < 0:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(f"{path}/round={batch}")


def newest_round(spark: SparkSession, path: str) -> int | None:
    """Found in the names of the files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.max(F.regexp_extract("path", r"/round=(\d+)/", 1).try_cast("bigint"))).first()[0]


def hours_known(spark: SparkSession, path: str, batch: int | None = None) -> list[Hour]:
    return [Hour(*r) for r in read_snapshot(spark, HOURS_DDL, path, batch).collect()]
