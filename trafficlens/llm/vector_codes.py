"""Product-quantised vector codes, with nearest entries found through memoised grid cells.

A vector of whole numbers is cut into equal parts, each with a codebook of its own. To find a part's
nearest entry, its coarse cell on a grid is looked up in the task's memory: it holds the entries that
can be nearest to any point of the cell. An entry cannot if its least distance to the cell's box is
beyond some other entry's greatest one. Only entries left over are measured, exactly. Codebooks are
small (entries x vector length), so each round sends them to the tasks and gets sums per entry back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import small_batches
from trafficlens.session import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LARGEST = 1 << 27  # components are held within, so that distances fit 64 bits
CELLS = 1 << 15  # cells that a task remembers for a part; others are worked out each time


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * float(SCALE)), -LARGEST, LARGEST).astype(np.int64)


class Grid:
    """Nearest entries of one codebook (entries x components), remembered by cell."""

    def __init__(self, entries: np.ndarray, most: int = CELLS):
        self.entries, self.most = entries, most
        # A side of about a third of the spread: some entries fall away, and cells are met again.
        spread = float(np.std(entries, axis=0).mean()) if entries.size else 0.0
        self.bits = max(0, int(np.log2(spread / 3))) if spread >= 3 else 0
        self.known: dict[bytes, int] = {}
        self.kept = np.zeros((0, len(entries)), bool)
        self.measured = 0

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """(cells x entries): which entries can be nearest to a point of the cell, ties among them."""
        out = np.zeros((len(cells), len(self.entries)), bool)
        for k in range(0, len(cells), 1024):
            low = (cells[k : k + 1024] << self.bits)[:, None, :]
            high = low + (1 << self.bits) - 1
            least = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
            most = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
            out[k : k + 1024] = (least**2).sum(2) <= (most**2).sum(2).min(1, keepdims=True)
        return out

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """(points x entries): the entries to measure."""
        cells = np.ascontiguousarray(points >> self.bits)
        raw = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, place = np.unique(raw, return_index=True, return_inverse=True)
        keys = [raw[k].tobytes() for k in first]
        number = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(number < 0)
        table = self.kept
        if len(new):
            made = self.undominated(cells[first[new]])
            number[new] = len(self.kept) + np.arange(len(new))
            table = np.concatenate((self.kept, made))
            room = self.most - len(self.kept)
            if room > 0:
                self.known.update(zip([keys[k] for k in new[:room]], number[new[:room]].tolist()))
                self.kept = table[: len(self.kept) + min(room, len(new))]
        return table[number[place.ravel()]]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each point's nearest entry; of ties the lowest number."""
        if not points.shape[1] or not len(points):
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        row, entry = np.nonzero(self.candidates(points))
        self.measured += len(row)
        distance = ((points[row] - self.entries[entry]) ** 2).sum(1)
        begin = np.searchsorted(row, np.arange(len(points)))
        best = np.minimum.reduceat(distance, begin)
        hit = np.flatnonzero(distance == best[row])
        hit = hit[np.concatenate(([True], row[hit][1:] != row[hit][:-1]))]
        return entry[hit], best


def _points(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(vectors x parts x components) of whole numbers."""
    vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(vectors).reshape(batch.num_rows, parts, -1)


def _sums(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Rows (part, entry, place, total, n): sums of the parts assigned to each entry."""
    parts, entries, length = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(c) for c in codebooks]
        total, count = np.zeros((parts, entries, length), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                points = _points(batch, parts)
                for p, grid in enumerate(grids):
                    code, _ = grid.nearest(points[:, p])
                    np.add.at(total[p], code, points[:, p])
                    count[p] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            made = (np.repeat(part, length), np.repeat(entry, length), np.tile(np.arange(length), len(part)), total[part, entry].ravel(), np.repeat(count[part, entry], length))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in made], names=["part", "entry", "place", "total", "n"])

    done = rows.select("vector").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    return done.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def _coded(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Rows (id, label, code, error)."""
    parts = len(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(c) for c in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _points(batch, parts)
            found = [grid.nearest(points[:, p]) for p, grid in enumerate(grids)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error.astype(np.int64))],
                names=["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts x entries x components) of rows (id, vector) of one length, or None without any id.

    They start from the vectors of the smallest ids; rows of one id go by their vectors. Each round
    replaces every entry that has parts by their mean, rounded down.
    """
    seeds = rows.where("id is not null").orderBy("id", "vector").limit(entries).select("vector").collect()
    if not seeds:
        return None
    start = whole_numbers(np.array([s.vector for s in seeds], float))
    codebooks = np.ascontiguousarray(start.reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        # As many rows as the codebooks have numbers.
        for r in _sums(rows, codebooks).collect():
            codebooks[r.part, r.entry, r.place] = int(r.total) // r.n
    return codebooks


def codebooks_digest(codebooks: np.ndarray | None) -> str:
    """SHA-256 of all entries' components in decimal digits, by part, entry and place."""
    numbers = [] if codebooks is None else codebooks.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def vector_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Rows (id, code, error, label_error, codebooks_sha256) of all usable vectors.

    ``code`` has two hex digits a part, the number of its nearest entry; ``error`` is the squared
    distance to the entries, over all parts, in units of 1/256; ``label_error`` its sum over the rows
    of the label, rows without a label together.

    A vector that is null or has a null, infinite or NaN component is left out. Vectors are as long as
    the first one by (id, vector) whose length is a multiple of ``parts``; others, empty ones too, can't
    be cut and have null for code and error. Components beyond 2^27 / 256 count as that. Rows
    without an id are coded, but start no codebook; if no row has one, all codes are null. Repeated
    rows each count. Of entries at one distance the first is taken. With fewer vectors than
    ``entries`` codebooks are as small. An empty table gives no rows; other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark)
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    rows = rows.where(usable(F.col("vector")))
    length = F.size("vector")
    first = rows.where((length > 0) & (length % parts == 0) & F.col("id").isNotNull()).orderBy("id", "vector").limit(1).select(length.alias("n")).first()
    fit = rows.where(length == (first.n if first else -1))
    codebooks = train(fit, parts, entries, rounds)
    none = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
    others = rows.where(length != (first.n if first else -1)).select("id", "label", *none)
    coded = written(others if codebooks is None else _coded(fit, codebooks).union(others), "vector-codes")
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))
