import datetime as dt
import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from trafficlens.sinks import write_text, write_traffic_table
from trafficlens.sources.account import ingest_with_account
from trafficlens.sources import (
    coverage_gaps,
    expected_hours,
    paths_for_hours,
    read_anomalies,
    read_dump_file,
    read_dumps,
    read_traffic,
    read_traffic_table,
    read_whitelist,
)
from trafficlens.schema import TRAFFIC_FIELDS

NAME = "pagecounts-20140105-030001.gz"
GOOD = ["en Main_Page 5 100", "en A_B 7 9 extra", 'de "Quoted"_%C3%A4 1 2']
SHORT = ["bad line", "en Foo 5 ", ""]
BAD = ["en  Foo 5 100", "en Foo x 100", "en Foo 5.5 100"]


def dump(folder, lines, name=NAME):
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / name, "wt") as out:
        out.write("\n".join(lines) + "\n")
    return str(folder)


def test_dump_lines(spark, tmp_path):
    df = read_dumps(spark, dump(tmp_path / "a", GOOD + SHORT))
    rows = sorted(tuple(r) for r in df.collect())
    when = (2014, 1, 5, 3, dt.datetime(2014, 1, 5, 3))
    assert rows == [
        ("de", '"Quoted"_%C3%A4', 1, 2, *when), ("en", "A_B", 7, 9, *when), ("en", "Main_Page", 5, 100, *when),
    ]


@pytest.mark.parametrize("line", BAD)
def test_bad_number_fails_or_drops(spark, tmp_path, line):
    path = dump(tmp_path / "a", GOOD + [line])
    with pytest.raises(Exception, match="not a number"):
        read_dumps(spark, path).collect()
    assert read_dumps(spark, path, mode="drop").count() == 3


def test_one_dump_file_has_nested_time(spark, tmp_path):
    path = dump(tmp_path / "a", GOOD[:1]) + "/" + NAME
    row = read_dump_file(spark, path).first()
    assert row["time"].asDict() == {"year": 2014, "month": 1, "day": 5, "hour": 3}
    short = dump(tmp_path / "b", SHORT[:1]) + "/" + NAME
    with pytest.raises(Exception, match="fewer than 4"):
        read_dump_file(spark, short).collect()


def test_hour_globs_select_files(spark, tmp_path):
    for hour in range(4):
        dump(tmp_path / "a", [f"en P {hour} 1"], f"pagecounts-20131231-{22 + hour}0000.gz" if hour < 2
             else f"pagecounts-20140101-0{hour - 2}0000.gz")
    paths = paths_for_hours(str(tmp_path / "a"), dt.datetime(2013, 12, 31, 23), 2)
    assert [p.rsplit("/")[-1] for p in paths] == ["pagecounts-20131231-23*", "pagecounts-20140101-00*"]
    assert sorted(r.requests for r in read_dumps(spark, paths).collect()) == [1, 2]


@pytest.mark.parametrize("sep", [" ", "\t"])
def test_traffic_text_roundtrip(spark, sample, tmp_path, sep):
    path = str(tmp_path / "out")
    write_text(sample.select(*TRAFFIC_FIELDS), path, sep=sep)
    back = read_traffic(spark, path, sep)
    assert back.columns == sample.columns
    assert back.exceptAll(sample).isEmpty() and sample.exceptAll(back).isEmpty()
    with pytest.raises(Exception, match="already exists"):
        write_text(sample, path, mode="errorifexists")


def test_short_traffic_line_fails(spark, tmp_path):
    (tmp_path / "t").write_text("en P 1 2 2014 1 5\n")
    with pytest.raises(Exception, match="fewer than 8"):
        read_traffic(spark, str(tmp_path / "t")).collect()
    assert read_traffic(spark, str(tmp_path / "t"), mode="drop").count() == 0


def test_anomalies_roundtrip(spark, tmp_path):
    rows = [("en", "A", 2014, 1, 5, 12, 3.25, 1e-9), ("en", "B", 2014, 1, 6, 10**12, 1e12, 2.0)]
    df = spark.createDataFrame(
        rows, "project string, title string, year int, month int, day int, visit_max bigint, q double, n double"
    )
    write_text(df, str(tmp_path / "a"))
    assert sorted(tuple(r) for r in read_anomalies(spark, str(tmp_path / "a")).collect()) == rows


def test_whitelist_forms(spark, tmp_path):
    (tmp_path / "w").write_text("en Main_Page\nde Spezial:Suche\n\n")
    rows = {tuple(r) for r in read_whitelist(spark, str(tmp_path / "w")).collect()}
    assert rows == {("en", "Main_Page"), ("de", "Spezial:Suche")}
    (tmp_path / "t").write_text("Main_Page\n%C3%84\n")
    titles = read_whitelist(spark, str(tmp_path / "t"), titles_only=True)
    assert titles.columns == ["title"] and titles.count() == 2
    with pytest.raises(Exception, match="fewer than 2"):
        read_whitelist(spark, str(tmp_path / "t")).collect()


def test_table_prunes_by_date(spark, sample, tmp_path):
    path = str(tmp_path / "table")
    write_traffic_table(sample, path)
    part = read_traffic_table(spark, path, dt.date(2014, 3, 3), dt.date(2014, 3, 4))
    assert {r.day for r in part.select("day").distinct().collect()} == {3, 4}
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    whole = read_traffic_table(spark, path)
    assert whole.count() == sample.count()


def test_coverage(spark):
    start = dt.datetime(2014, 1, 1)
    expected = expected_hours(spark, start, dt.datetime(2014, 1, 3))
    first = expected.agg(F.min("hour_no")).first()[0]
    files = [(first + h, v) for h in range(48) for v in (0, 3) if h not in (5, 30, 31)]
    listing = spark.createDataFrame(files + [(first + 30, 10)], "hour_no bigint, version int")
    gaps = sorted(tuple(r) for r in coverage_gaps(expected, listing).collect())
    assert gaps == [
        (dt.date(2014, 1, 1), 1, dt.datetime(2014, 1, 1, 5)),
        (dt.date(2014, 1, 2), 2, dt.datetime(2014, 1, 2, 6)),
    ]


def test_damaged_dumps_are_accounted_for(spark, tmp_path):
    """A good file, one with short, over-long and bad lines, a cut archive, an empty one and a plain one."""
    def name(hour):
        return tmp_path / f"pagecounts-20140105-{hour:02d}0000.gz"

    many = "".join(f"en Page_{k} {k} {k * k} {zlib.crc32(b'%d' % k)}\n" for k in range(20_000))
    name(1).write_bytes(gzip.compress(b"en A 1 10\nen B 2 20"))
    name(2).write_bytes(gzip.compress(("en C 3 30\nshort line\nen " + "x" * 300 + " 4 40\nen D y 50\nen E \\N 60\n").encode()))
    whole = gzip.compress(many.encode())
    name(3).write_bytes(whole[: len(whole) // 2])
    name(4).write_bytes(gzip.compress(b""))
    (tmp_path / "pagecounts-20140105-050000").write_text("en F 7 70\n")
    table = str(tmp_path / "table")
    ledger, totals = ingest_with_account(spark, f"{tmp_path}/pagecounts-*", table, longest=200)
    got = {r.path[-9:].removesuffix(".gz")[:2] if r.path.endswith(".gz") else "05": r for r in ledger.collect()}
    facts = {k: (r.lines, r.kept, r.short, r.too_long, r.bad_number, r.cut_off) for k, r in got.items()}
    part = facts.pop("03")
    assert facts == {"01": (2, 2, 0, 0, 0, False), "02": (5, 2, 1, 1, 1, False), "04": (0, 0, 0, 0, 0, False), "05": (1, 1, 0, 0, 0, False)}
    assert part[5] and 0 < part[1] < 20_000 and part[0] - part[1] <= 1
    stored = read_traffic_table(spark, table)
    assert stored.count() == totals["kept"] == 5 + part[1] and totals["lines"] == 8 + part[0]
    assert {(r.title, r.requests, r.hour) for r in stored.where("hour <> 3").collect()} == {("A", 1, 1), ("B", 2, 1), ("C", 3, 2), ("E", None, 2), ("F", 7, 5)}
    with pytest.raises(Exception):
        read_dumps(spark, str(name(3))).count()
