"""Quality by nearest-neighbour voting among labelled documents in a latent semantic space.

Terms are hashed words, patterns of three character classes, and shares that tell how repetitive a
text is. Weighted by inverse document frequency, the labelled sample is factored into few latent
dimensions. Each document gets exact cosines to all labelled vectors, in blocks, and the labels of
its nearest ones, weighted by similarity, give its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import Texts, small_batches, texts_of, window_hashes
from trafficlens.llm.labelled import held_out, labelled_sample
from trafficlens.llm.quality_rules import later_repeats

PER_CLASS = 2048  # bound of the labelled sample, each class
RANK = 64
NEIGHBOURS = 25
SHARPNESS = 20.0  # a neighbour's weight is exp(SHARPNESS * cosine)
# Rows of documents against which the cosines to all labelled vectors are held at once.
BLOCK = 512

WORD_BUCKETS = 1024
CLASSES = 12
_CLASS = np.full(256, 11, np.int64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
for _code, _bytes in enumerate((b".", b",", b"!?", b"#$%&*", b"|<>", b"\"'()[]{}-:;"), 5):
    _CLASS[list(_bytes)] = _code
SHARES = 6
TERMS = WORD_BUCKETS + CLASSES**3 + SHARES


def term_counts(texts: Texts) -> np.ndarray:
    """Weights of the terms of each text, one row each, damped by a logarithm."""
    n = len(texts)
    starts, stops = texts.words()
    owner = texts.owners(starts)
    words = np.maximum(np.bincount(owner, minlength=n), 1)
    hashes = texts.span_hashes(starts, stops)
    counts = np.zeros((n, TERMS), np.float32)
    table = lambda rows, columns, width: np.bincount(rows * width + columns, minlength=n * width).reshape(n, width)
    counts[:, :WORD_BUCKETS] = table(owner, (hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS)
    kinds = _CLASS[texts.data]
    if len(kinds) > 2:
        triples = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
        rows = np.repeat(np.arange(n), np.diff(texts.ends))[: len(triples)]
        inside = rows == np.repeat(np.arange(n), np.diff(texts.ends))[2:]
        counts[:, WORD_BUCKETS:-SHARES] = table(rows[inside], triples[inside], CLASSES**3)
    # Per thousand words, so that the length of a text does not decide.
    counts *= (1000 / words)[:, None]
    share = lambda marks: 1000 * np.bincount(owner, marks, minlength=n) / words
    salted = hashes ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    same = np.zeros(len(owner), bool)
    same[1:] = salted[1:] == salted[:-1]
    again = later_repeats(salted)
    threes = window_hashes(salted, 3)
    three = np.zeros(len(owner), bool)
    three[: len(threes)] = later_repeats(threes)
    capital = (texts.data[starts] >= 65) & (texts.data[starts] <= 90) if len(starts) else same
    long = stops - starts > 12
    few = (words[owner] < 30) if len(owner) else same
    counts[:, -SHARES:] = np.stack([share(x) for x in (same, again, three, capital, long, few)], 1)
    return np.log1p(counts)


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1, in place; zero rows stay."""
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return rows


@dataclass
class Space:
    """What scoring needs: term weights, latent axes, labelled unit vectors and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(counts * self.weights) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(counts), BLOCK):
            latent = self.project(counts[at : at + BLOCK])
            cosines = latent @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.exp(SHARPNESS * (np.take_along_axis(cosines, near, 1) - cosines.max(1, keepdims=True)))
            got = (votes * self.labels[near]).sum(1) / votes.sum(1)
            known = np.abs(latent).sum(1) > 0
            out[at : at + BLOCK][known] = got[known]
        return np.clip(out, 0.0, 1.0)


def fit(counts: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Space:
    """The latent space of labelled rows, by a randomised singular value decomposition."""
    if not len(labels):
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32), 0.5)
    weights = (np.log((1 + len(labels)) / (1 + (counts > 0).sum(0))) + 0.1).astype(np.float32)
    # The shares are few columns against thousands of words.
    weights[-SHARES:] = 2.0
    rows = unit(counts * weights)
    rank = min(rank, *rows.shape)
    basis = rows.T @ np.random.default_rng(0).standard_normal((len(rows), rank + 10)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(rows.T @ (rows @ np.linalg.qr(basis)[0]))[0]
    axes = (basis @ np.linalg.svd(rows @ basis, full_matrices=False)[2].T)[:, :rank].astype(np.float32)
    return Space(weights, axes, unit(rows @ axes), labels.astype(np.float32), float(labels.mean()))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 3, remainder: int = 1,
          id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Space:
    """Fit on at most 2 * ``per_class`` labelled documents; their term weights reach the driver as half floats."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label_col, per_class, modulus, remainder, id_col, text_col)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column("text")):
                rows = term_counts(texts).astype(np.float16)
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["id", "label", "terms"])

    got = sample.select("id", "label", "text").mapInArrow(terms, "id string, label int, terms binary").toArrow()
    # The order of tasks must not show in the result.
    got = got.sort_by([("id", "ascending"), ("label", "ascending"), ("terms", "ascending")])
    counts = np.zeros((got.num_rows, TERMS), np.float32)
    for k, row in enumerate(got.column("terms")):
        counts[k] = np.frombuffer(row.as_buffer(), np.float16)
    known = np.array(got.column("label").to_pylist(), np.float64)
    del got
    return fit(counts, known)


def score(docs: DataFrame, space: Space, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of all documents; the space, of bounded size, is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                scores = np.concatenate([shared.value.score(term_counts(part)) for part in halves(texts)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(scores)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, space: Space, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least so much."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(at)):
                scores = np.concatenate([shared.value.score(term_counts(part)) for part in halves(texts)])
                yield batch.slice(texts.first, len(texts)).filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)


def halves(texts: Texts) -> Iterator[Texts]:
    """Parts of at most BLOCK texts, so that the dense rows of short texts stay few."""
    for at in range(0, len(texts), BLOCK):
        ends = texts.ends[at : at + BLOCK + 1]
        yield Texts(texts.data[ends[0] : ends[-1]], ends - ends[0], texts.first + at)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", modulus: int = 3, remainder: int = 1,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score in [0, 1] (higher: label 1 likelier), predicted.

    Only the text is an input of a score. A null or empty text, or one that shares no term with the
    sample, gets the share of label 1 in the sample; without any labelled row every score is 0.5.
    Repeated rows each get a row, equal texts equal scores; ties among neighbours at the cut have
    equal cosines, so that which are taken matters only between equal vectors. An empty table gives
    no rows; other columns are not read.
    """
    space = train(docs, labels, label_col, modulus, remainder, id_col, text_col)
    out = score(docs, space, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), modulus, remainder).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
