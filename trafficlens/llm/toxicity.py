"""A toxicity classifier whose scores do not depend on which group a sentence names.

A logistic regression over hashed words and word beginnings. Training adds, for labelled texts that
name a group, the same texts with other groups of the kind in its place, and penalises the square of
the score's change, so that a group's name gets no weight of its own and a neutral mention stays
neutral.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import LETTERS, SMALL, Texts, mix, small_batches, texts_of
from trafficlens.llm.labelled import held_out, labelled_sample
from trafficlens.session import written

PER_CLASS = 4096  # bound of the labelled sample, each class
TABLE_BITS = 22
FEATURES = 2048
PREFIXES = (4, 5, 6, 7)
LEAST_TEXTS = 4  # a feature is learnt from so many texts at least
SWAPS = 2  # counterfactual texts for a text that names a group
PENALTY = 4.0
RIDGE = 2e-4
STEPS = 400

# Names of groups; those of one line stand for each other. A parameter of the trainer.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("americans", "mexicans", "chinese", "indians", "africans", "europeans", "arabs"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of each word and word beginning, each pair once, in order."""
    starts, stops = texts.words(LETTERS)
    owner = texts.owners(starts)
    small = SMALL[texts.data]
    parts, owners = [texts.span_hashes(starts, stops, small)], [owner]
    for size in PREFIXES:
        longer = stops - starts > size
        begin = starts[longer]
        parts.append(mix(texts.span_hashes(begin, begin + size, small) + np.uint64(size)))
        owners.append(owner[longer])
    cells = np.concatenate(owners).astype(np.uint64) << np.uint64(TABLE_BITS)
    cells = np.unique(cells | (np.concatenate(parts) >> np.uint64(64 - TABLE_BITS)))
    return (cells >> np.uint64(TABLE_BITS)).astype(np.int64), (cells & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def word_features(words) -> np.ndarray:
    """All features of some words."""
    found = [features(t)[1] for t in texts_of(pa.array(list(words), pa.string()))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def counterfactuals(text: str, groups=IDENTITY_TERMS, swaps: int = SWAPS) -> list[str]:
    """The text with every group it names exchanged for the next of its kind, then the one after."""
    place = {term: (line, k) for line, terms in enumerate(groups) for k, term in enumerate(terms)}
    pattern = re.compile(r"\b(" + "|".join(sorted(map(re.escape, place), key=len, reverse=True)) + r")\b", re.I)
    if not pattern.search(text):
        return []

    def other(match, by):
        line, k = place[match[0].lower()]
        return groups[line][(k + by) % len(groups[line])]

    made = dict.fromkeys(pattern.sub(lambda m: other(m, by), text) for by in range(1, swaps + 1))
    return [x for x in made if x != text]


@dataclass
class Model:
    """Features, sorted, with their weights; all others weigh nothing."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << TABLE_BITS, np.float32)
        table[self.features] = self.weights
        return table


def fit(rows: list[tuple[int, np.ndarray]], swapped: list[tuple[np.ndarray, np.ndarray]], chosen: np.ndarray,
        penalty: float = PENALTY) -> Model:
    """Weights of the chosen features from (label, features) and pairs (features, after a swap).

    Loss: class-balanced logistic loss, ridge, and penalty times the mean square of the change of
    the linear score under a swap. Full gradient steps with momentum.
    """
    if len({label for label, _ in rows}) < 2:
        prior = np.clip(np.mean([label for label, _ in rows]) if rows else 0.5, 0.01, 0.99)
        return Model(chosen[:0], np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    dense = lambda found: np.isin(chosen, found, assume_unique=True).astype(np.float32)
    x = np.stack([dense(f) for _, f in rows])
    y = np.array([label for label, _ in rows], np.float32)
    change = np.stack([dense(b) - dense(a) for a, b in swapped]) if swapped else np.zeros((0, len(chosen)), np.float32)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    weights, bias = np.zeros(len(chosen), np.float32), 0.0
    speed, bias_speed = np.zeros_like(weights), 0.0
    # Step below the inverse of a bound of the curvature: mean row square / 4 plus the penalty's.
    step = 1.0 / (0.25 * float((x.sum(1) * share).sum() + 1) + RIDGE + 2 * penalty * float((change**2).sum() / max(len(change), 1)))
    for _ in range(STEPS):
        error = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y) * share
        slope = x.T @ error + RIDGE * weights
        if len(change):
            slope += 2 * penalty / len(change) * (change.T @ (change @ weights))
        speed = 0.95 * speed - step * slope
        bias_speed = 0.95 * bias_speed - step * float(error.sum())
        weights, bias = weights + speed, bias + bias_speed
    return Model(chosen, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, remainder: int = 0,
          id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY_TERMS, penalty: float = PENALTY,
          per_class: int = PER_CLASS) -> Model:
    """Fit on at most 2 * ``per_class`` labelled documents.

    Tasks count in how many texts of each class a feature occurs; those that tell the classes apart
    best, and those of the group names, are chosen, and only these of each text reach the driver.
    """
    small_batches(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, label_col, per_class, modulus, remainder, id_col, text_col), "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << TABLE_BITS), np.int32)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for texts in texts_of(batch.column("text")):
                owner, feature = features(texts)
                for c in (0, 1):
                    of = feature[label[texts.first + owner] == c]
                    seen[c] += np.bincount(of, minlength=1 << TABLE_BITS).astype(np.int32)
        found = np.flatnonzero(seen.any(0))
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0][part].astype(np.int64)), pa.array(seen[1][part].astype(np.int64))],
                                             names=["feature", "without", "with"])

    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = sample.select("label", "text")
    spread = (texts.mapInArrow(counted, "feature bigint, without bigint, with bigint")
              .groupBy("feature").agg(F.sum("without").alias("without"), F.sum("with").alias("with")))
    per = lambda column, c: (F.col(column) + 0.5) / F.lit(sizes.get(c, 0) + 1.0)
    odds = F.abs(F.log(per("with", 1) / per("without", 0)))
    error = F.sqrt(1 / (F.col("with") + 0.5) + 1 / (F.col("without") + 0.5))
    best = (spread.where(F.col("with") + F.col("without") >= LEAST_TEXTS).select("feature", (odds / error).alias("strength"))
            .orderBy(F.desc("strength"), "feature").limit(FEATURES))
    chosen = np.unique(np.concatenate(
        [np.array([r.feature for r in best.collect()], np.int64), word_features(t for g in groups for t in g)]))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(column):
            out = []
            for texts in texts_of(column):
                owner, feature = features(texts)
                keep = np.isin(feature, chosen)
                parts = np.split(feature[keep], np.searchsorted(owner[keep], np.arange(1, len(texts))))
                out += [x.astype(np.int32).tobytes() for x in parts]
            return out

        for batch in batches:
            base = of(batch.column("text"))
            others = [[] for _ in base]
            for k, text in enumerate(batch.column("text").to_pylist()):
                if made := counterfactuals(text, groups):
                    others[k] = of(pa.array(made, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").cast(pa.int32()), pa.array(base, pa.binary()), pa.array(others, pa.list_(pa.binary()))],
                names=["label", "found", "swapped"])

    got = texts.mapInArrow(reduced, "label int, found binary, swapped array<binary>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["label"], r["found"], r["swapped"]))
    ids = lambda raw: np.frombuffer(raw, np.int32).astype(np.int64)
    rows = [(r["label"], ids(r["found"])) for r in got]
    pairs = [(ids(r["found"]), ids(s)) for r in got for s in r["swapped"]]
    return fit(rows, pairs, chosen, penalty)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of all documents; the model, of bounded size, is broadcast."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value.table(), shared.value.bias
        for batch in batches:
            for texts in texts_of(batch.column(1)):
                owner, feature = features(texts)
                total = bias + np.bincount(owner, table[feature], minlength=len(texts))
                scores = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(scores)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", modulus: int = 5, remainder: int = 0,
             id_col: str = "doc_id", text_col: str = "text", groups=IDENTITY_TERMS) -> DataFrame:
    """One row per document: id, held_out, score in [0, 1] (higher: label 1 likelier), predicted.

    Only the text is an input of a score. A null or empty text gets the score of a text without any
    known feature. Without labelled rows of both classes every score is the share of label 1, 0.5
    without any. Repeated rows each get a row, and equal texts equal scores. Among features of equal
    strength the smaller is chosen. An empty table gives no rows; other columns are not read.
    """
    model = train(docs, labels, label_col, modulus, remainder, id_col, text_col, groups)
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col), modulus, remainder).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
