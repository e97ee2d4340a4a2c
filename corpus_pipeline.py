"""The corpus pipeline: from all documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from trafficlens.llm.queries import documents, labels, vocabulary
from trafficlens.session import written

ORACLE_SQL = None  # classifiers, sketches and tokenizers are beyond SQL


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accept(docs, quality_classifier.train(docs, labels(spark, sf_dir)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those with no word left go.

    A document that had no word before stays. ``n_chars`` follows the text.
    """
    found = line_dedup.dedup_lines(docs, near_words=line_dedup.SHORT_WORDS)
    touched = F.size("exact_lines") + F.size("near_lines") > 0
    kept = found.where(~touched | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; of equal rows one."""
    found = written(ngram_join.near_duplicates(docs).select("doc_id", "group_id"), "pipeline-groups")
    gone = written(found.where("doc_id <> group_id").select("doc_id").distinct(), "pipeline-gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mix reads them: once at least, twice at most on average of a source."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each on what the one before it has written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
