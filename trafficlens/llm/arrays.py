"""Whole texts as numpy arrays: words, lines and their hashes, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from trafficlens.session import importable

# About so many bytes of text are turned into arrays at a time; a longer text is one slice.
SLICE_BYTES = 1 << 20

# Limits of a batch of rows between Spark and Python. Whole texts may be long, and the usual 10,000
# of them would take gigabytes.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
# Bytes of a word: all but white space; letters: those of the alphabet and of every longer code point.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Bytes with the capitals A to Z made small.
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


@dataclass
class Texts:
    """UTF-8 bytes of some texts end to end; text i is ``data[ends[i]:ends[i + 1]]``."""

    data: np.ndarray
    ends: np.ndarray
    first: int  # row of the first text in its column

    def __len__(self) -> int:
        return len(self.ends) - 1

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(marks)))
        return total[self.ends[1:]] - total[self.ends[:-1]]

    def powers(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data) + 1
        up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    def span_hashes(self, starts: np.ndarray, stops: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes give equal hashes."""
        up, down = self.powers()
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[self.data if data is None else data] * up[:-1])))
        return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))

    def words(self, bytes_of_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the runs of given bytes; by default all but white space (9 to 13, 32)."""
        inside = bytes_of_word[self.data]
        start, stop = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = self.ends[(self.ends > 0) & (self.ends < len(self.data))]
        start[edges] = inside[edges]
        stop[edges - 1] = inside[edges - 1]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and stops of the lines, split at each newline; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        owner = self.owners(breaks)
        starts = np.concatenate((self.ends[:-1], breaks + 1))
        stops = np.concatenate((breaks, self.ends[1:]))
        text = np.arange(len(self))
        return starts[np.lexsort((starts, np.concatenate((text, owner))))], stops[np.lexsort((stops, np.concatenate((owner, text))))]

    def owners(self, positions: np.ndarray) -> np.ndarray:
        """The text that each byte position belongs to."""
        return np.searchsorted(self.ends, positions, "right") - 1


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches within the limits; no result depends on them. Workers are
    told where this package is."""
    importable(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Slices of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    if column.offset:
        column = pa.concat_arrays([column])
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        # Empty texts take no bytes, so the number of texts is held as well.
        stop = min(stop, len(column), at + 2_000)
        yield Texts(data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at], at)
        at = stop


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes; shorter by n - 1 than its input."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    factor = np.uint64(1)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * factor
        factor = np.uint64((int(factor) * 0xC2B2AE3D27D4EB4F) % (1 << 64))
    return mix(out)
