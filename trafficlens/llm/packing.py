"""Packing of tokenised documents along a space-filling curve.

A document's hashed word vector is projected to few dimensions, the point's index on a Hilbert curve
is its key, and a range sort by that key puts similar documents side by side. Each task fills
sequences from its stretch of the curve without gaps.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import mix, small_batches, texts_of

TASK_BYTES = 32 << 20  # of texts that a task packs, about
SEQUENCE = 1024
END_OF_TEXT = 0  # id put after each document
DIMENSIONS = 4
BITS = 12
BUCKETS = 1024

PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)

_PROJECTION = np.where(
    (mix(np.arange(BUCKETS * DIMENSIONS, dtype=np.uint64)) >> np.uint64(63)) == 0, -1.0, 1.0
).reshape(BUCKETS, DIMENSIONS)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with integer coordinates below 2**bits, one row each.

    Gray-code form: the coordinates are taken bit by bit from the top; each level undoes the
    reflection and exchange of axes that the curve applied to the cells below it.
    """
    axes = points.astype(np.int64).T.copy()
    n = len(axes)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for k in range(n):
            flip = (axes[k] & bit) != 0
            swap = np.where(flip, 0, (axes[0] ^ axes[k]) & below)
            axes[0] ^= np.where(flip, below, swap)
            axes[k] ^= swap if k else 0
    for k in range(1, n):
        axes[k] ^= axes[k - 1]
    parity = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        parity ^= np.where(axes[n - 1] & (1 << level), (1 << level) - 1, 0)
    axes ^= parity
    index = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            index = (index << 1) | ((axes[k] >> level) & 1)
    return index


def curve_keys(column: pa.Array) -> pa.Array:
    """Hilbert key of each text; texts without words share one key."""
    keys = []
    for texts in texts_of(column):
        starts, stops = texts.words()
        cells = texts.owners(starts) * BUCKETS + (texts.span_hashes(starts, stops) % np.uint64(BUCKETS)).astype(np.int64)
        counts = np.bincount(cells, minlength=len(texts) * BUCKETS).reshape(len(texts), BUCKETS)
        vectors = np.log1p(counts)
        norms = np.sqrt((vectors**2).sum(1, keepdims=True))
        # Sums of many signs are near normal with deviation 1: a logistic curve spreads them evenly.
        spread = 1 / (1 + np.exp(-1.7 * (vectors / np.maximum(norms, 1e-9)) @ _PROJECTION))
        keys.append(hilbert_index(np.minimum(spread * (1 << BITS), (1 << BITS) - 1), BITS))
    return pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())


class Encoder:
    """Token ids of a byte-level BPE vocabulary that exists as a tokenizers and as a tiktoken file.

    Both libraries give the same ids; tiktoken takes a quarter of the time. A text that spells the
    special token is left to tokenizers.
    """

    def __init__(self, ranks_path: str, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path

    def ids(self, text: str) -> list[int]:
        if "<|endoftext|>" in text:
            return _slow_tokenizer(self.json_path).encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(1)
def _slow_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _encoder(ranks_path: str, json_path: str) -> Encoder:
    return Encoder(ranks_path, json_path)


def cut(tokens: np.ndarray, starts: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (segment, from, to, sequence) of tokens cut at segment starts and after each length."""
    edges = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    points = np.union1d(edges, starts[starts < edges[-1]])
    begin, end = points[:-1], points[1:]
    segment = np.searchsorted(starts, begin, "right") - 1
    sequence = np.searchsorted(edges, begin, "right") - 1
    return zip(segment.tolist(), begin.tolist(), end.tolist(), sequence.tolist(), (begin - edges[sequence]).tolist())


class Lane:
    """Documents that are packed one after another."""

    def __init__(self, size: int, numbers: Iterator[int], kind):
        self.size, self.numbers, self.kind = size, numbers, kind
        self.rest = np.zeros(0, np.uint32)
        self.open_docs: list[tuple[object, int, int]] = []  # id, tokens, where its first token here stands in it
        self.starts = np.zeros(0, np.int64)

    def pieces(self, tokens, docs, lengths) -> pa.RecordBatch:
        rows, numbers = [], [next(self.numbers) for _ in lengths]
        for at, begin, end, number, offset in cut(tokens, self.starts, lengths):
            key, total, skipped = docs[at]
            rows.append((key, skipped + begin - int(self.starts[at]), end - begin, zlib.crc32(tokens[begin:end]), total, numbers[number], offset))
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], self.kind), *(pa.array(c, pa.int64()) for c in columns[1:])],
            names=["id", *(x.split()[0] for x in PIECES.split(", "))])

    def add(self, documents: list[tuple[object, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        lengths = [len(ids) for _, ids in documents]
        docs = self.open_docs + [(key, len(ids), 0) for key, ids in documents]
        tokens = np.concatenate([self.rest, *(ids for _, ids in documents)])
        self.starts = np.concatenate((self.starts, len(self.rest) + np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)))
        full = len(tokens) // self.size
        if full:
            yield self.pieces(tokens, docs, [self.size] * full)
        used = full * self.size
        keep = max(int(np.searchsorted(self.starts, used, "right")) - 1, 0) if used < len(tokens) else len(self.starts)
        self.open_docs = [(k, n, skipped + max(used - int(s), 0)) for (k, n, skipped), s in zip(docs[keep:], self.starts[keep:])]
        self.starts = np.maximum(self.starts[keep:] - used, 0)
        self.rest = tokens[used:]

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.rest):
            lengths = [1 << b for b in range(len(self.rest).bit_length() - 1, -1, -1) if len(self.rest) >> b & 1]
            yield self.pieces(self.rest, self.open_docs, lengths)


def fill(batches: Iterator[pa.RecordBatch], encode, first_sequence: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents (id, text) of one task, in order, in sequences of ``size`` tokens.

    Rows that follow each other with one id are copies: the first goes to the first lane, the next to
    the second and so on, and each lane has its own sequences, so that no sequence has two copies of a
    document. What is left of a lane at the end goes to sequences whose lengths are powers of two, so
    nothing is padded.
    """
    lanes: list[Lane] = []
    numbers = itertools.count(first_sequence)
    before, copy = object(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            dealt: dict[int, list] = {}
            for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                # Rows without an id are no copies of each other.
                copy = copy + 1 if key == before and key is not None else 0
                before = key
                dealt.setdefault(copy, []).append((key, np.array([*encode(text or ""), END_OF_TEXT], "<u4")))
            for k in sorted(dealt):
                while len(lanes) <= k:
                    lanes.append(Lane(size, numbers, batch.schema.field("id").type))
                yield from lanes[k].add(dealt[k])
    for lane in lanes:
        yield from lane.end()


def _bounds(docs: DataFrame, parts: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids at which the tasks' shares of the curve begin, from some 100 rows a task that a
    hash of the id picks. They only say where tasks begin."""
    every = max(1, rows // (100 * parts))
    some = docs.where(F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(every)) == 0)
    # Equal rows, of which a hash picks all or none, count once.
    found = _keyed(some, None).select("key", F.coalesce("order", F.lit(0)).alias("order")).distinct().toArrow()
    key, order = found["key"].to_numpy(), found["order"].to_numpy()
    at = np.lexsort((order, key))
    chosen = at[np.arange(1, parts) * len(at) // parts] if len(at) else at
    return key[chosen], order[chosen]


def part_of(key: np.ndarray, order: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many of the bounds, which are in order, are at or before each (key, order)."""
    keys, orders = bounds
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    for k in np.flatnonzero(low < high):
        low[k] += np.searchsorted(orders[low[k] : high[k]], order[k], "right")
    return low


def _keyed(rows: DataFrame, bounds: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (part, key, order, id, text): place on the curve, and the task that has that part of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = curve_keys(batch.column("text"))
            order = batch.column("order").fill_null(0).to_numpy()
            part = np.zeros(len(key), np.int64) if bounds is None else part_of(key.to_numpy(), order, bounds)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), key, *(batch.column(k) for k in ("order", "id", "text"))], names=["part", "key", "order", "id", "text"])

    kind = dict(rows.dtypes)["id"]
    # Ids of any type in one order of numbers; equal ids lie together.
    order = F.col("id").cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("id")
    return rows.select(order.alias("order"), "id", "text").mapInArrow(run, f"part int, key bigint, order bigint, id {kind}, text string")


def pack(docs: DataFrame, ranks_path: str, json_path: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SEQUENCE) -> DataFrame:
    """One row per piece: the document's id, where the piece starts in it, length, CRC-32 of its ids,
    tokens of the document (with the id 0 after it), sequence and offset there.

    ``sequence_id`` is the task's number in its upper bits and a count below. Every sequence holds
    ``size`` tokens but the last few of a task, whose lengths are powers of two.

    A null or empty text is the id 0 alone. Repeated rows are packed as often as they occur, each copy
    in sequences that hold no other copy of it; rows with one id keep it in all their pieces, a null id
    stays null and is no copy of another; an empty table gives no row. Rows that share an id and differ
    in text are parted where they are neighbours on the curve only.
    Equal texts are told apart by their id in the sort, so a group of copies spreads over tasks.
    Other columns are not read.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_path, json_path)
        yield from fill(batches, encoder.ids, TaskContext.get().partitionId() << 40, size)

    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # Tasks by the bytes of the texts; as many as a shuffle has, if each gets a megabyte.
    found = text.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    share = lambda size: -(-(found.bytes or 0) // size)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), share(1 << 20)), share(TASK_BYTES))
    keyed = _keyed(text, _bounds(text, parts, found.n))
    ordered = keyed.repartitionById(parts, F.col("part")).sortWithinPartitions("key", "order", "id", F.xxhash64("text")).select("id", "text")
    return ordered.mapInArrow(task, f"id {kind}, {PIECES}").withColumnRenamed("id", id_col)
