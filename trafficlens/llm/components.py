"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of edges (a, b); the component is its smallest node.

    Alternates two steps until nothing changes: every node ties its larger neighbours, then its
    smaller ones, to the smallest node it knows. A round takes a few joins and sums by node, and
    rounds grow with the logarithm of the longest chain. Each round is written to shared storage.
    Null ends are passed over.
    """
    def stars(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("a", "m").alias("m"))
        joined = pairs.join(least, F.col("a") == F.col("at"))
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Of a pair here a is the larger one: it and its smaller neighbours all go to the smallest.
        moved = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return moved.where("a > b").distinct()

    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull() | F.col("b").isNull())
        .toDF("a", "b", "missing").where("not missing and a > b").select("a", "b").distinct(), "edges")
    state = None
    while True:
        # Rows, and the exact sum of a hash of them, tell whether a round has changed anything.
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        current = written(stars(stars(current, True), False), "edges")
    heads = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
