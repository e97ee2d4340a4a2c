"""Bounded samples of labelled documents, and the split that keeps rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, modulus: int,
                    remainder: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (label, text) of at most ``per_class`` labelled documents of each class, none held out.

    Which rows are taken depends on a hash of the id alone. The ids are broadcast: 2 * per_class at
    most. Null ids, labels other than 0 and 1, and ids without a document are passed over; a
    document that is labelled twice, or an id with several rows, counts as often as it occurs.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & ~held_out(F.col("id"), modulus, remainder))
    one = lambda c: rows.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
    ids = one(0).unionByName(one(1))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "id").select("id", "label", F.coalesce("text", F.lit("")).alias("text"))
