"""Damaged dumps taken in with an account: what of each file was kept, and what was not."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trafficlens.session import importable, scratch_path
from trafficlens.sinks import write_traffic_table
from trafficlens.sources.text import NULL_FIELD, dump_fields, served_files

LONGEST = 1 << 16  # characters of a line; longer ones are damage
STATES = ("kept", "short", "too_long", "bad_number")


def inflated_sizes(paths: DataFrame) -> DataFrame:
    """Rows (path, inflated): what a gz archive of one member says its size is, modulo 2^32, from its
    last four bytes; NULL for other files. Only these bytes are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for path in batch.column(0).to_pylist():
                size = None
                if path.endswith(".gz"):
                    system, inner = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                    with system.open_input_file(inner) as file:
                        if file.size() >= 4:
                            size = int.from_bytes(file.read_at(4, file.size() - 4), "little")
                sizes.append(size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "inflated"])

    importable(paths.sparkSession)
    return paths.select("path").mapInArrow(run, "path string, inflated bigint")


def ingest_with_account(spark: SparkSession, paths, table: str, longest: int = LONGEST) -> tuple[DataFrame, dict[str, int]]:
    """Write the good lines of dumps as a traffic table, however damaged the files; returns the ledger and
    the totals.

    The ledger has a row for each file that serves an hour: path, lines, kept, short (fewer than four
    fields), too_long, bad_number, and cut_off: whether the archive ends before its data does. What could
    be read of a cut archive is kept. Files are read once; totals are observed in that pass. Lines longer
    than ``longest`` characters are left out unread. An empty file has 0 lines.
    """
    files = served_files(spark, paths, "drop")
    lines = spark.read.option("ignoreCorruptFiles", True).text(files).select("value", F.col("_metadata.file_path").alias("path"))
    long = F.char_length("value") > longest
    parsed = dump_fields(lines.withColumn("text", F.when(~long, F.col("value"))))
    numbers = [F.col(n).isNotNull() | F.col(f"{n}_text").eqNullSafe(NULL_FIELD) for n in ("requests", "bytes")]
    state = F.when(long, "too_long").when(~F.col("enough"), "short").when(numbers[0] & numbers[1], "kept").otherwise("bad_number")
    rows = parsed.select(
        "path", state.alias("state"), (F.octet_length("value") + 1).cast("bigint").alias("size"),
        "project", "title", "requests", "bytes", "year", "month", "day", "hour")
    seen = Observation("dump lines")
    counted = rows.observe(seen, F.count("*").alias("lines"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES])
    staging = scratch_path(spark, "dump-lines")
    counted.write.partitionBy("state").parquet(staging)
    totals = {k: int(v) for k, v in seen.get.items()}
    schema = rows.schema
    stored = spark.read.schema(schema).parquet(staging)
    write_traffic_table(stored.where("state = 'kept'").select("project", "title", "requests", "bytes", "year", "month", "day", "hour"), table)
    by_file = stored.groupBy("path").agg(
        F.count("*").alias("lines"), *[F.count(F.when(F.col("state") == s, 1)).alias(s) for s in STATES], F.sum("size").alias("read"))
    listed = spark.createDataFrame([(f,) for f in files], "path string")
    sizes = inflated_sizes(listed.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism)))).withColumn("name", F.substring_index("path", "/", -1))
    joined = sizes.join(by_file.withColumn("name", F.substring_index("path", "/", -1)).drop("path"), "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    # The last line may end without a line break.
    missing = (F.col("inflated") - F.coalesce("read", F.lit(0))) % (1 << 32)
    cut = F.col("inflated").isNotNull() & ~missing.isin([0, -1, (1 << 32) - 1])
    return joined.select("path", *map(zero, ("lines", *STATES)), cut.alias("cut_off")), totals
