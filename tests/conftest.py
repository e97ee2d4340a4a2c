import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trafficlens import configure  # noqa: E402
from trafficlens.schema import with_timestamp  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("trafficlens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        # A zone with daylight saving: results must not depend on it.
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


START = dt.datetime(2014, 3, 1, 5)
DDL = "project string, title string, requests bigint, bytes bigint, year int, month int, day int, hour int"


def row(page, at, requests, size=None):
    """A traffic row of page ("project", "title") at START + so many hours."""
    t = START + dt.timedelta(hours=at)
    return (*page, requests, requests * 3 + at % 7 if size is None else size, t.year, t.month, t.day, t.hour)


@pytest.fixture(scope="session")
def make_traffic(spark):
    def make(rows):
        return with_timestamp(spark.createDataFrame(rows, DDL))

    return make


def noise(seed):
    """Endless small numbers, the same each time."""
    state = seed
    while True:
        state = (state * 1103515245 + 12345) % 2**31
        yield state >> 16


@pytest.fixture(scope="session")
def sample_rows():
    """Three pages over 15 days: dense, with gaps and a doubled hour, and short."""
    numbers = noise(7)
    rows = []
    for at in range(15 * 24):
        spike = 900 if at in (130, 210) else 0
        rows.append(row(("en", "Dense"), at, 100 + next(numbers) % 40 + spike))
        if next(numbers) % 3:
            rows.append(row(("de", "Gaps"), at, 10 + next(numbers) % 9))
        if at == 100:
            rows.append(row(("de", "Gaps"), at, 44))
            rows.append(row(("de", "Gaps"), at, 45))
        if 40 <= at < 90:
            rows.append(row(("de", "Short"), at, next(numbers) % 5))
    return rows


@pytest.fixture(scope="session")
def sample(make_traffic, sample_rows):
    return make_traffic(sample_rows).cache()
