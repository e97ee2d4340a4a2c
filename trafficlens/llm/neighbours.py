"""The row that follows each row in order of its id, without a global window."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import written

QUANTILES = 256
ROWS = 4_000  # rows of a bucket, about
_LEAST = -(1 << 63)


def _bucket(key: Column, bounds: list[int], split: int) -> Column:
    """Number of the bucket: the quantile range of the key, and an even share of that range."""
    steps = [bounds[k : k + 16] for k in range(0, len(bounds), 16)]
    at_most = lambda values: F.size(F.filter(values, lambda b: b <= key))
    coarse = F.greatest(at_most(F.lit([s[0] for s in steps])) - 1, F.lit(0))
    rank = F.greatest(coarse * 16 + at_most(F.slice(F.lit(bounds), coarse * 16 + 1, 16)) - 1, F.lit(0))
    low = F.get(F.lit(bounds), rank)
    high = F.coalesce(F.get(F.lit(bounds), rank + 1), F.lit(bounds[-1] + 1).cast("decimal(38,0)"))
    wide = lambda c: c.cast("decimal(38,0)")
    share = F.floor((wide(key) - wide(low)).cast("double") * split / F.greatest((wide(high) - wide(low)).cast("double"), F.lit(1.0)))
    return rank.cast("bigint") * split + F.least(F.greatest(share.cast("bigint"), F.lit(0)), F.lit(split - 1))


def with_next(rows: DataFrame, id_col: str, tie: Column, columns: list[str], prefix: str = "next_",
              prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds the given columns of the next row in ascending order of (id, tie); after the last comes
    the first. A null id comes before all others. Columns that ``prepare`` adds to the rows may be among
    them: they are made once for each row, after rows have been dealt out, and so do not travel.

    Rows are dealt into buckets by approximate quantiles of the id, each cut evenly; every bucket
    also gets the first row of the one after it. Only that row travels twice.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST))
    got = rows.select(key.alias("k")).agg(F.count("*").alias("n"), F.percentile_approx("k", [i / QUANTILES for i in range(QUANTILES)], 10_000).alias("q")).first()
    bounds = sorted(set(got.q or [0]))
    bucket = _bucket(key, bounds, max(1, math.ceil(got.n / QUANTILES / ROWS)))
    # One row a bucket; the next bucket that has rows is found in order of buckets.
    firsts = rows.groupBy(bucket.alias("bucket")).agg(F.min(key).alias("first"))
    order = Window.orderBy("bucket")
    before = F.lag("bucket").over(order)
    last = F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = written(firsts.select(F.col("first").alias("_first"), F.coalesce(before, last).alias("_before"), before.isNull().alias("_wraps")), "bucket-heads")
    keyed = rows.withColumns({"_key": key, "_own": bucket})
    dealt = keyed.join(heads, F.col("_key") == F.col("_first"), "left").withColumn("_places", F.when(
        F.col("_first").isNull(), F.array(F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("guest")))).otherwise(F.array(
            F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("_before").alias("bucket"), F.when(F.col("_wraps"), 2).otherwise(1).alias("guest")))))
    spread = dealt.select(*(rows[c] for c in rows.columns), "_key", tie.alias("_tie"), F.explode("_places").alias("_at"))
    spread = spread.select(*rows.columns, "_key", "_tie", F.col("_at.bucket").alias("_bucket"), F.col("_at.guest").alias("_guest"))
    spread = spread.withColumn("_last", F.col("_guest") == 2)
    if prepare is not None:
        # The window below takes over this partitioning and order.
        spread = prepare(spread.repartition("_bucket").sortWithinPartitions("_bucket", "_last", "_key", "_tie"))
    order = Window.partitionBy("_bucket").orderBy("_last", "_key", "_tie")
    led = {f"{prefix}{c}": F.lead(c).over(order) for c in columns}
    return spread.withColumns(led).where("_guest = 0").drop("_key", "_tie", "_bucket", "_guest", "_last")
