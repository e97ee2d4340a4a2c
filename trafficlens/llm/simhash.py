"""Near-duplicate documents by SimHash, with multi-index hashing.

Of two fingerprints of 64 bits that differ in 3 at most, one half of 32 bits differs in 1 at most. So
halves index the fingerprints, and each looks up its own halves and all at one bit from them: every
close pair meets in a table entry, and the whole distance is verified there. Only one of two
halves that differ in a bit looks for the other, the one whose bit is 0.

Entries are what tasks work on. One that holds many fingerprints is cut again by the other half, of
whose quarters again one differs in 1 at most. Then 16 bits are left, so that no entry can hold more
than 65,536 fingerprints; those that look one up are dealt into blocks. A task says
which fingerprints hang together among those it has seen, never which pairs: what it puts
out is bounded by what it reads, and links within and between entries make the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import small_batches
from trafficlens.llm.components import connected_components
from trafficlens.session import written

WORDS = 3
SEED = 42
DISTANCE = 3  # halves and quarters are looked up at one bit: right for distances up to 3
ENTRY = 4096  # fingerprints of an entry that is not cut again
BLOCK = 1 << 16  # of those that look an entry up, so many go to a task
SHINGLES = 1 << 14  # whose bits are counted at a time
BUFFER = 1 << 16  # rows of entries that are worked on together
MATRIX = 1 << 21


def simhash(text: bytes, words: int = WORDS) -> int:
    """Each bit that more than half of the shingles' hashes have set."""
    parts = text.lower().split()  # of bytes: A to Z, and white space 9 to 13 and 32
    n = len(parts)
    if not n:
        return 0
    span = min(words, n)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - span + 1].tolist()
    stops = ends[span - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), SHINGLES):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + SHINGLES], stops[k : k + SHINGLES])], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (id, fp): the fingerprint of each text as a signed number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [simhash(t.as_py() or b"", words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "id bigint, fp bigint")


def _flips(value: Column, bits: int, unset: bool) -> Column:
    """The values one bit away; with ``unset``, only those with a bit more."""
    at = F.sequence(F.lit(0), F.lit(bits - 1))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)
    if unset:
        at = F.filter(at, lambda b: value.bitwiseAND(bit(b)) == 0)
    return F.transform(at, lambda b: value.bitwiseXOR(bit(b)))


def _offset(values: Column, by: Column) -> Column:
    return F.transform(values, lambda v: v.bitwiseOR(by))


def _entries(rows: DataFrame, parts: list[Column], bits: int, keys: list[str], name: str) -> DataFrame:
    """Rows (*keys, name, looks, fp, n, m) of the table's entries in which something may meet.

    ``rows`` has keys, looks (whether it only looks for others) and fp. By each of the parts a row that
    does not look stands in an entry; all look at entries one bit away, those that stand in none in
    their own, too. n stand in the entry, m look it up.
    """
    stand, look = [], []
    for k, part in enumerate(parts):
        offset = F.lit(k << bits).cast("bigint")
        here = F.array(part.bitwiseOR(offset))
        stand.append(F.when(~F.col("looks"), here).otherwise(F.array().cast("array<bigint>")))
        far = F.when(F.col("looks"), F.concat(F.array(part), _flips(part, bits, False))).otherwise(_flips(part, bits, True))
        look.append(_offset(far, offset))
    standing = rows.select(*keys, F.explode(F.concat(*stand)).alias(name), F.lit(False).alias("looks"), "fp")
    looking = rows.select(*keys, F.explode(F.concat(*look)).alias(name), F.lit(True).alias("looks"), "fp")
    every = standing.union(looking)
    sizes = every.groupBy(*keys, name).agg(F.count(F.when(~F.col("looks"), 1)).alias("n"), F.count(F.when(F.col("looks"), 1)).alias("m"))
    sizes = written(sizes.where("n > 0 and n + m > 1"), f"simhash-{name}-sizes")
    return every.join(sizes.hint("merge"), [*keys, name])


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows (entry, sub, block, looks, fp): those that look are dealt out, those that stand are in every block."""
    blocks = F.greatest(F.ceil(F.col("m") / block), F.lit(1)).cast("bigint")
    at = F.when(F.col("looks"), F.array(F.pmod(F.xxhash64("fp"), blocks))).otherwise(F.sequence(F.lit(0).cast("bigint"), blocks - 1))
    return rows.select("entry", "sub", F.explode(at).alias("block"), "looks", "fp")


def _least_linked(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels that edges have pulled down to the least of their component."""
    while True:
        least = np.minimum(labels[a], labels[b])
        lower = labels.copy()
        np.minimum.at(lower, a, least)
        np.minimum.at(lower, b, least)
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _entry_edges(fp: np.ndarray, standing: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, row) that join what hangs together in an entry whose first rows stand in it."""
    label = np.arange(len(fp))
    step = max(1, MATRIX // standing)
    while True:
        before = label.copy()
        for k in range(0, len(fp), step):
            close = np.bitwise_count(fp[k : k + step, None] ^ fp[None, :standing]) <= distance
            least = np.minimum(label[k : k + step], np.where(close, label[None, :standing], len(fp)).min(1))
            label[k : k + step] = least
            label[:standing] = np.minimum(label[:standing], np.where(close, least[:, None], len(fp)).min(0))
        if (label == before).all():
            return np.arange(len(fp)), label


def linked(entry: np.ndarray, looks: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least one it hangs together with) among rows in order of entry, standing ones first."""
    begin = np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1])))
    end = np.append(begin[1:], len(entry))
    standing = np.add.reduceat((~looks).astype(np.int64), begin)
    few, number = 8, np.repeat(np.arange(len(begin)), end - begin)
    a, b = [], []
    small = (standing <= few)[number]
    for k in range(few):
        at = begin[number] + k
        rows = np.flatnonzero(small & (k < standing[number]) & (np.arange(len(fp)) > at))
        near = rows[np.bitwise_count(fp[rows] ^ fp[at[rows]]) <= distance]
        a.append(near)
        b.append(at[near])
    for k in np.flatnonzero(standing > few):
        x, y = _entry_edges(fp[begin[k] : end[k]], int(standing[k]), distance)
        a.append(x[x != y] + begin[k])
        b.append(y[x != y] + begin[k])
    values, node = np.unique(fp, return_inverse=True)
    a, b = node[np.concatenate(a)], node[np.concatenate(b)]
    label = _least_linked(np.arange(len(values)), a, b)
    some = np.unique(np.concatenate((a, b)))
    return values[some], values[label[some]]


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """Rows (a, b) that join what hangs together within the blocks of entries."""
    keys = ["entry", "sub", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held)
            columns = [table.column(k).to_numpy() for k in (*keys, "looks", "fp")]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)))
            # What may go on in the next batch stays.
            stop = len(new) if last else int(np.flatnonzero(new)[-1])
            held, size = [] if last else table.slice(stop).to_batches(), len(new) - stop
            if stop:
                a, b = linked(np.cumsum(new[:stop]), columns[3][:stop].astype(bool), columns[4][:stop].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        most = BUFFER
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield from work(False)
                most = BUFFER + size  # a long entry is looked through once it has doubled
        if size:
            yield from work(True)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "looks").mapInArrow(run, "a bigint, b bigint")


def components(fps: DataFrame, distance: int = DISTANCE, entry: int = ENTRY, block: int = BLOCK) -> DataFrame:
    """Rows (fp, component): fingerprints that links lead to, and the least of each component.

    ``fps`` has each fingerprint once. Those without a link are left out.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be 0 to {DISTANCE}, not {distance}")
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    halves = _entries(fps.select(F.lit(False).alias("looks"), "fp"), [high, low], 32, [], "entry")
    small = halves.where(F.col("n") <= entry).withColumn("sub", F.lit(-1).cast("bigint"))
    large = halves.where(F.col("n") > entry).select("entry", "looks", "fp")
    # The half that the entry does not fix.
    rest = F.when(F.shiftright("entry", 32) == 0, low).otherwise(high)
    quarters = _entries(large, [F.shiftrightunsigned(rest, 16), rest.bitwiseAND(F.lit(0xFFFF))], 16, ["entry"], "sub")
    columns = ["entry", "sub", "looks", "fp", "n", "m"]
    met = _dealt(small.select(*columns).union(quarters.select(*columns)), block)
    edges = written(_links(met, distance), "simhash-links")
    return connected_components(edges.where("a <> b")).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                    words: int = WORDS, entry: int = ENTRY, block: int = BLOCK) -> DataFrame:
    """One row per document: id, fingerprint, component_id.

    ``fingerprint`` has 16 hex digits: a bit is set if more than half of the text's word n-grams, repeats
    included, have it in their XXH64. A to Z count as small letters, words end at white space. Texts
    link if at most ``distance`` bits differ; ``component_id`` is the smallest id that links lead to.

    A text of fewer than ``words`` words has one n-gram of them all; a null, empty or blank text has
    fingerprint 0 and links like any other. Rows without an id link, too; their component's id is
    the smallest there is, null if there is none. Repeated rows each get a row. An empty table gives
    no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col, words), "simhash-texts")
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fingerprints")
    joined = fps.join(components(fps.select("fp"), distance, entry, block), "fp", "left")
    rooted = written(joined.select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-roots")
    roots = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-components")
    known = written(rooted.join(roots, "root").select("fp", "component_id"), "simhash-known")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(known, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")
