"""Run queries and their SQL side by side: ``python -m checks.compare [sf_dir] [names...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES


def database(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, records) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None if equal, else what differs. Names, values and Python types must agree."""
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if ours else "no rows"
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    theirs = rows_of(names, result.fetchall())
    if ours == theirs and repr(ours) == repr(theirs):
        return None
    different = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    return f"{len(ours)} vs {len(theirs)} rows, {len(different)} differ, first {different[:1]}"


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    bad = 0
    for query in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            problem = compare(session, con, query, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {query} {time.time() - start:.2f}s {problem or ''}",
              flush=True)
    print(f"{bad} differ")
