"""Near-duplicate documents: a Jaccard self-join on word n-grams by MinHash banding, made exact.

Texts with equal n-gram sets form a class, and only one text of each takes part. MinHash bands bring
together texts that may be similar, in buckets, and every text of a bucket is verified against the
bucket's leader, its smallest text; what links is in one component with it. Each costs a pair a text,
so that a group of any size comes together in linear work.

Bands may miss a pair. So each text also has a prefix: its n-grams in one order for all texts, so many
of the first that two texts within the threshold have one of these in common. Rare n-grams come first
in that order. The place of the first n-gram that two texts share bounds how many they share at all, so
it tells of what size the other can be: texts that find none of such a size in a bucket leave it. Pairs
that share a prefix n-gram and still lie in different components meet in cells: the texts of a bucket of
bounded size are one, those of larger ones are cut into blocks, and two blocks meet in one. There, bits
that bound the difference of two sets from below rule out nearly all that are not near. For the few
pairs left n-grams are compared, each pair's in one of its cells. So no link is lost.

A link never leaves its component. At the end all pairs inside each component are compared, in cells
again, for the number of links of each text; only numbers leave a cell.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.arrays import Texts, mix, small_batches, texts_of, window_hashes
from trafficlens.llm.components import connected_components
from trafficlens.session import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999  # chance that a pair just at the threshold shares a band
MAX_HASHES = 192
BLOCK = 256  # texts of a block, about
LEADERS = 4  # rounds, at most, in which the leader of a band's bucket meets the others
FEW = 8  # the last round is one that finds at most so small a part of the links of the first
SAMPLE = 20_000  # texts, about, that tell which n-grams are common; only the work depends on it
COMMON = 1 << 18  # common n-grams known to each task, at most
BLOCK_GRAMS = 1 << 20  # n-grams of a block whose texts are all compared, about
CLASSES, MOST = 100, (1 << 12) - 1  # classes of sizes for each doubling, and the last one


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def shingles(texts: Texts, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, and where each text's begin and end.

    A text with fewer than n words has one n-gram of all its words; one without words has none.
    """
    starts, stops = texts.words()
    hashes = texts.span_hashes(starts, stops)
    owner = texts.owners(starts)
    count = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(count)))
    windows = window_hashes(hashes, n)
    valid = np.flatnonzero(owner[: len(windows)] == owner[n - 1 :]) if len(windows) else np.zeros(0, np.int64)
    made, made_by = windows[valid], owner[valid]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([window_hashes(hashes[begin[k] : begin[k + 1]], int(count[k]))[0] for k in short], np.uint64)
        made, made_by = np.concatenate((made, extra)), np.concatenate((made_by, short))
        order = np.argsort(made_by, kind="stable")
        made, made_by = made[order], made_by[order]
    return made, np.searchsorted(made_by, np.arange(len(texts) + 1))


def band_hashes(made: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes of each text with n-grams, one row each, in order of the texts."""
    begin = ends[:-1][np.diff(ends) > 0]
    out = np.zeros((len(begin), bands), np.uint64)
    if not len(begin):
        return out
    odd = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(bands * rows):
        least = np.minimum.reduceat((made ^ odd[2 * k]) * odd[2 * k + 1], begin)
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def common_grams(texts: DataFrame, n: int, sample: int = SAMPLE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that several of some texts have, sorted, and in how many (255 at most)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch.column(1)):
                made, ends = shingles(part, n)
                sets = [np.unique(made[b:e]) for b, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["gram"])

    share = sample / max(texts.count(), 1)
    some = texts.sample(share, 1) if share < 1 else texts
    counts = some.mapInArrow(run, "gram bigint").groupBy("gram").agg(F.least(F.count("*"), F.lit(255)).cast("int").alias("n"))
    counts = written(counts.where("n > 1"), "ngram-common")
    least, known = 256, 0
    for row in sorted(counts.groupBy("n").agg(F.count("*").alias("grams")).collect(), reverse=True):
        known += row.grams
        if known > most and least < 256:
            break
        least = row.n
    found = counts.where(F.col("n") >= least).limit(most).toArrow()
    grams, number = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.uint64)
    order = np.argsort(grams)
    return grams[order], number[order]


def size_class(size: np.ndarray) -> np.ndarray:
    """Sizes on a logarithmic scale, cut down to whole numbers of 12 bits."""
    return np.minimum(np.floor(CLASSES * np.log2(np.maximum(size, 1))), MOST).astype(np.uint64)


def prefix(own: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n-grams of a set, rare ones first: two sets within the threshold share one of theirs.

    Of a set of s n-grams the other has threshold * s at least, so not all of so many can be missing.
    Each is 40 bits of the n-gram, the class of the set's size, and that of the largest set which can be
    within the threshold if this is the first n-gram they share: those before it are not in the other.
    """
    order = own >> np.uint64(8)
    grams, number = common
    if len(grams):
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        order = order | (np.where(grams[place] == own, number[place], np.uint64(0)) << np.uint64(56))
    many = min(len(own) - int(np.ceil(threshold * len(own) - 1e-6)) + 1, len(own))
    first = np.argpartition(order, many - 1)[:many]
    first = first[np.argsort(order[first])]
    before = np.searchsorted(order[first], order[first])
    largest = (len(own) - before) * ((1 + threshold) / threshold) - len(own)
    classes = (size_class(np.array(len(own))) << np.uint64(12)) | size_class(largest * (1 + 1e-9) + 1e-6)
    return (own[first] >> np.uint64(24) << np.uint64(24)) | classes


def parity_bits(own: np.ndarray) -> bytes:
    """Whether an odd number of the n-grams fall on each of 1 to 2 places an n-gram, a power of two."""
    places = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _folded(bits: bytes, size: int) -> int:
    """The bits as of fewer places, ``size`` bytes, a number."""
    value, length = int.from_bytes(bits, "little"), len(bits)
    while length > size:
        length //= 2
        value = (value >> (8 * length)) ^ (value & ((1 << (8 * length)) - 1))
    return value


def may_be_near(bits: bytes, size: int, other_bits: bytes, other_size: int, threshold: float) -> bool:
    """False only if two sets are below the threshold: bits that differ are n-grams that differ."""
    if min(size, other_size) < threshold * max(size, other_size) - 1e-6:
        return False
    length = min(len(bits), len(other_bits))
    apart = (_folded(bits, length) ^ _folded(other_bits, length)).bit_count()
    return apart <= (1 - threshold) / (1 + threshold) * (size + other_size) + 1e-6


def _set_key(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def sketches(texts: DataFrame, bands: int, rows: int, n: int, threshold: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (id, set_key, size, bands, prefix, bits): digest and size of the n-gram set, the band
    hashes, the prefix and the parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch.column(1)):
                made, ends = shingles(part, n)
                hashed = iter(band_hashes(made, ends, bands, rows).astype(np.int64))
                own = [np.unique(made[b:e]) for b, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(map(_set_key, own), pa.binary()), pa.array(map(len, own), pa.int64()),
                     pa.array([next(hashed) if len(s) else None for s in own], pa.list_(pa.int64())),
                     pa.array([prefix(s, threshold, common).view(np.int64) if len(s) else None for s in own], pa.list_(pa.int64())),
                     pa.array([parity_bits(s) if len(s) else None for s in own], pa.binary())],
                    names=["id", "set_key", "size", "bands", "prefix", "bits"])

    return texts.mapInArrow(run, "id bigint, set_key binary, size bigint, bands array<bigint>, prefix array<bigint>, bits binary")


def _full_sets(texts: DataFrame, n: int) -> DataFrame:
    """Rows (id, set_key, grams): the sorted n-gram set of each text as 64-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch.column(1)):
                made, ends = shingles(part, n)
                sets = [np.unique(made[b:e]) for b, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, len(part)), pa.array(map(_set_key, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["id", "set_key", "grams"])

    return texts.mapInArrow(run, "id bigint, set_key binary, grams binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, one matrix."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    # N-grams of one text alone are in no intersection.
    common = (np.bincount(group) > 1)[group] if len(group) else new
    group, owner = np.cumsum(new[common]) - 1, owner[common]
    total = np.zeros((m, m), np.float32)
    width = 8192
    cuts = np.searchsorted(group, np.arange(0, (group[-1] + 1 if len(group) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if a < b:
            present = np.zeros((m, width), np.float32)
            present[owner[a:b], group[a:b] - k * width] = 1
            total += present @ present.T
    return total.astype(np.int64)


def verify_leader(leader: np.ndarray, others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sorted sets are within the threshold of the leader's."""
    size = np.array([len(s) for s in others])
    values = np.concatenate(others)
    place = np.searchsorted(leader, values)
    hit = np.append(leader, 0)[place] == values
    hit &= place < len(leader)
    total = np.concatenate(([0], np.cumsum(hit)))
    ends = np.cumsum(size)
    both = total[ends] - total[ends - size]
    return both >= threshold * (len(leader) + size - both)


def linked_pairs(sets: list[np.ndarray], asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs asked for, a symmetric matrix, are within the threshold."""
    size = np.array([len(s) for s in sets])
    if asked.sum() // 2 <= 4 * len(sets):
        linked = np.zeros_like(asked)
        for a, b in zip(*np.nonzero(np.triu(asked))):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            linked[a, b] = linked[b, a] = both >= threshold * (size[a] + size[b] - both)
        return linked
    both = shared_counts(sets)
    return asked & (both >= threshold * (size[:, None] + size[None, :] - both))


def _met(side: np.ndarray) -> np.ndarray:
    """The pairs of a cell: across, where two blocks meet, and all where a block meets itself (all sides 0)."""
    return side[:, None] != side[None, :] if side.any() else np.ones((len(side), len(side)), bool)


def candidates(side: np.ndarray, component: np.ndarray, bits: pa.ChunkedArray, size: np.ndarray, most: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Places of the pairs of texts of different components that may be near in a cell."""
    rows, found = {}, []
    asked = _met(side) & (component[:, None] != component[None, :])
    near = (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-6)
    fits = size_class(size)[None, :] <= most[:, None].astype(np.uint64)
    asked &= near & fits & fits.T
    if not asked.any():
        return found
    length = pc.binary_length(bits).to_numpy()

    def words_of(k: int, size: int) -> np.ndarray:
        if (k, size) not in rows:
            rows[k, size] = np.frombuffer(_folded(bits[k].as_py(), size).to_bytes(size, "little"), np.uint64)
        return rows[k, size]

    for a in np.flatnonzero(asked.any(1)):
        others = np.flatnonzero(asked[a, a + 1 :]) + a + 1
        bound = (1 - threshold) / (1 + threshold) * (size[a] + size[others]) + 1e-6
        shorter = np.minimum(length[others], length[a])
        for short in np.unique(shorter):
            some = shorter == short
            apart = np.bitwise_count(np.stack([words_of(int(k), int(short)) for k in others[some]]) ^ words_of(int(a), int(short))).sum(1)
            found += [(a, k) for k in others[some][apart <= bound[some]]]
    return found


def verify_cell(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """(id, smallest id it hangs together with) of the texts that have links to other components in one cell."""
    linked = linked_pairs(sets, component[:, None] != component[None, :], threshold)
    label = ids.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        lower = np.minimum(label, least)
        if (lower == label).all():
            break
        label = lower
    return [(int(i), int(r)) for i, r, any_link in zip(ids, label, linked.any(1)) if any_link]


def count_cell(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """(id, links) of the texts of a cell to other ids in it; sets of one id count together."""
    linked = linked_pairs(sets, _met(side) & (ids[:, None] != ids[None, :]), threshold)
    first, at = np.unique(ids, return_inverse=True)
    if len(first) < len(ids):
        a, b = np.nonzero(linked)
        linked = np.zeros((len(first), len(first)), bool)
        linked[at[a], at[b]] = True
    else:
        linked = linked[np.argsort(ids)]
    return [(int(i), int(n)) for i, n in zip(first, linked.sum(1)) if n]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, of batches sorted by it."""
    kept, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if kept and keys[a] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = keys[a]
    if kept:
        yield pa.Table.from_batches(kept)


def _each_cell(rows: DataFrame, found, columns: tuple[str, ...]) -> DataFrame:
    """Rows of longs that ``found`` makes of the rows of each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, "cell"):
            made = list(zip(*found(table)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=list(columns))

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, ", ".join(f"{c} bigint" for c in columns))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _grams(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]


def _led(pairs: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (a, b): the pairs (leader, id) that are within the threshold.

    A leader's set travels once for each block of the texts it meets.
    """
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts"))
    members = pairs.join(counts, "leader").select("leader", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id")
    leaders = counts.select("leader", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("leader").alias("id"))

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        leader = table.column("leader")[0].as_py()
        grams = _grams(table)
        others = np.flatnonzero(ids != leader)
        linked = np.zeros(len(others), bool)
        for own in np.flatnonzero(ids == leader):
            if len(others):
                linked |= verify_leader(grams[own], [grams[k] for k in others], threshold)
        near = np.unique(ids[others[linked]])
        return pa.table({"a": pa.array(np.full(len(near), leader, np.int64)), "b": pa.array(near)})

    met = members.union(leaders).join(sets.select("id", "grams"), "id")
    return met.groupBy("leader", "part").applyInArrow(verify, "a bigint, b bigint")


def _cells(rows: DataFrame, block: int) -> DataFrame:
    """Rows (id, component, cell, side, most) of texts in buckets of several components; two blocks meet in a cell.

    Texts meet there for many n-grams at once, so that none bounds the sizes.
    """
    leaders = rows.groupBy("hash").agg(F.min("id").alias("leader"))
    homes = rows.join(leaders, "hash").groupBy("id", "component").agg(F.min("leader").alias("home"))
    # A component of many texts has blocks of its own, which need not meet each other.
    large = homes.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > block).select("component", F.col("component").alias("only"))
    homes = written(homes.join(large, "component", "left").select("id", "component", "home", "only"), "ngram-homes")
    parts = homes.groupBy("home", "only").agg(F.ceil(F.count("*") / block).cast("bigint").alias("parts")).select(F.col("home").alias("h"), F.col("only").alias("o"), "parts")
    dealt = homes.join(parts, (F.col("home") == F.col("h")) & F.col("only").eqNullSafe(F.col("o")))
    blocks = written(dealt.select("id", "component", F.struct("home", "only", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")).alias("block")), "ngram-blocks")
    met = rows.select("hash", "id").join(blocks, "id").select("hash", "block").distinct()
    other = met.select("hash", F.col("block").alias("next"))
    apart = F.col("block.only").isNull() | F.col("next.only").isNull() | (F.col("block.only") != F.col("next.only"))
    pairs = met.join(other, "hash").where((F.col("block") < F.col("next")) & apart).select("block", "next").distinct()
    alone = blocks.where("block.only is null").select("block").distinct().select("block", F.col("block").alias("next"))
    cells = written(pairs.union(alone), "ngram-cells")
    sides = cells.select("block", "next", F.col("block").alias("of"), F.lit(0).alias("side")).union(
        cells.where("block < next").select("block", "next", F.col("next").alias("of"), F.lit(1).alias("side")))
    key = lambda b: F.xxhash64(f"{b}.home", f"{b}.only", f"{b}.part")
    mine = blocks.select("id", "component", key("block").alias("key"), F.col("block").alias("own"))
    spread = sides.select(key("of").alias("key"), "of", "block", "next", "side")
    return mine.join(spread, "key").where(F.col("own").eqNullSafe(F.col("of"))).select(
        "id", "component", F.xxhash64("block", "next").alias("cell"), "side", F.lit(MOST).cast("bigint").alias("most"))


def _joined_components(old: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, component) after links (a, b) have joined components."""
    ends = links.join(old.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(
        old.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    merged = connected_components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select("node", F.col("component").alias("least"))
    moved = old.join(merged, F.col("component") == F.col("node"), "left")
    return moved.select("id", F.coalesce("least", "component").alias("component"))


def _several(shared: DataFrame, components: DataFrame) -> DataFrame:
    """Rows (hash, n, id, component, most) of the buckets whose n texts lie in several components."""
    rows = shared.join(components, "id", "left").select("hash", "id", F.coalesce("component", "id").alias("component"), "most")
    mixed = rows.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("hash", "n")
    return rows.join(mixed, "hash").select("hash", "n", "id", "component", "most")


def _shared(each: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, id, leader) of the buckets of several ids; the leader is the smallest."""
    bucket = Window.partitionBy(*keys)
    rows = each.select(*keys, "id", F.min("id").over(bucket).alias("leader"), F.max("id").over(bucket).alias("last"))
    return rows.where("leader < last").drop("last").distinct()


def _shared_prefixes(each: DataFrame, threshold: float) -> DataFrame:
    """Rows (hash, id, most) of the texts that share a prefix n-gram with one of a size that their places in
    it allow; the class of the largest such size is ``most``."""
    gap = int(np.ceil(-CLASSES * np.log2(threshold)))
    # Rows are dealt before they are taken apart: so only two numbers of each travel.
    rows = each.repartition(F.shiftright("prefix", 24)).select(
        F.shiftright("prefix", 24).alias("hash"), "id", F.shiftright("prefix", 12).bitwiseAND(MOST).alias("size"), F.col("prefix").bitwiseAND(MOST).alias("most"))
    by_size = Window.partitionBy("hash").orderBy("size")
    # Whoever has a larger one in reach has the next one, a smaller one is no further than the last.
    rows = rows.select(
        "hash", "id", "size", "most", F.lead("size").over(by_size).alias("next"), F.lag("size").over(by_size).alias("last"),
        F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1)).alias("reach"))
    met = rows.where((F.col("next") <= F.col("most")) | ((F.col("last") >= F.col("size") - gap) & (F.col("reach") >= F.col("size"))))
    return met.groupBy("hash", "id").agg(F.max("most").alias("most"))


def _possible(pairs: DataFrame, bits: DataFrame, threshold: float) -> DataFrame:
    """Rows (leader, id): the pairs that the parity bits do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [may_be_near(*row, threshold) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield batch.select(["leader", "id"]).filter(pa.array(left, pa.bool_()))

    theirs = bits.select(F.col("id").alias("leader"), F.col("bits").alias("leader_bits"), F.col("size").alias("leader_size"))
    both = pairs.join(bits, "id").join(theirs, "leader").select("leader", "id", "bits", "size", "leader_bits", "leader_size")
    return both.mapInArrow(run, "leader bigint, id bigint").distinct()


def _link_cells(components: DataFrame, sizes: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Rows (id, grams, cell, side): all pairs of texts of one component meet in one cell."""
    parts = components.join(sizes, "id").groupBy("component").agg(F.ceil(F.greatest(
        F.count("*") / block, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("parts"))
    dealt = written(components.join(parts, "component").select("id", "component", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")), "ngram-parts")
    spread = dealt.select("id", "component", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cell = F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other"))
    cells = spread.select("id", cell.alias("cell"), (F.col("part") > F.col("other")).cast("int").alias("side"))
    return cells.join(sets.select("id", "grams"), "id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
                    n: int = WORDS, recall: float = RECALL, block: int = BLOCK, leaders: int = LEADERS) -> DataFrame:
    """One row per document: id, class_id, n_copies, n_links, group_id.

    ``class_id`` is the smallest id among documents with the same n-gram set, ``n_copies`` how many
    rows that class has, ``group_id`` the smallest id that links lead to, ``n_links`` the number of
    other classes within the threshold. Word n-grams are of runs between white space.

    A null, empty or blank text, and a row without an id, has no n-grams: it is a class and group of
    its own with 0 links. A text with fewer than n words has one n-gram of all of them. Rows that
    share an id count as one document in groups. Ties go to the smallest id. An empty table gives no
    rows; other columns are not read. Pairs below the threshold are never linked, all others are.
    ``recall`` is the share of pairs just at the threshold that bands find; prefixes find the rest.
    The work for ``n_links`` grows with the square of a component, the rows that meet for it with that
    square over twice ``block``; all else grows with the texts.
    """
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = written(sketches(texts, bands, rows, n, threshold, common_grams(texts, n)), "ngram-sketches")
    real = all_rows.where("set_key is not null and id is not null")
    classes = written(real.groupBy("set_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies")), "ngram-classes")
    copies = written(real.select("id", "set_key").join(classes, "set_key").where("id <> class_id").select("id", "set_key").distinct(), "ngram-copies")
    reps = real.join(copies, ["id", "set_key"], "left_anti")
    shared = written(_shared_prefixes(reps.select("id", F.explode("prefix").alias("prefix")), threshold), "ngram-shared")
    wanted = written(shared.select("id").distinct(), "ngram-wanted")
    some = real.join(wanted, "id", "left_semi").join(copies, ["id", "set_key"], "left_anti")
    bits = written(some.select("id", "set_key", "size", "bits").dropDuplicates(["id", "set_key"]), "ngram-bits")

    def sets_of(ids: DataFrame) -> DataFrame:
        own = _full_sets(texts.join(ids, "id", "left_semi"), n).where("set_key is not null")
        return written(own.join(copies, ["id", "set_key"], "left_anti").dropDuplicates(["id", "set_key"]), "ngram-sets")

    components, seen, met = wanted.select("id", F.col("id").alias("component")), [], []

    def lead(pairs: DataFrame) -> int:
        nonlocal components
        pairs = written(_possible(pairs, bits, threshold), "ngram-pairs")
        if pairs.isEmpty():
            return 0
        sets = sets_of(written(pairs.select(F.explode(F.array("leader", "id")).alias("id")).distinct(), "ngram-ids"))
        found = written(_led(pairs, sets, threshold, block), "ngram-led")
        components = written(_joined_components(components, found), "ngram-components")
        seen.append(sets)
        return found.count()

    if leaders > 0:
        each = some.select("id", F.posexplode("bands").alias("band", "hash"))
        groups = written(_shared(each, ["band", "hash"]), "ngram-buckets")
    for k in range(leaders):
        if k:
            # The leader's component is done with: the smallest text outside it leads next.
            of = components.select("id", F.col("component").alias("own"))
            known = groups.join(of, "id").join(of.toDF("leader", "led"), "leader").where("own <> led").select("band", "hash", "id")
            groups = written(known.withColumn("leader", F.min("id").over(Window.partitionBy("band", "hash"))), "ngram-buckets")
        met.append(lead(groups.where("leader < id").select("leader", "id").distinct()))
        # Cells find the few links left at less cost than another round.
        if FEW * met[-1] <= met[0]:
            break
    several = written(_several(shared, components), "ngram-several")
    large = several.where(F.col("n") > block)
    cells = several.where(F.col("n") <= block).select("id", "component", F.col("hash").alias("cell"), F.lit(0).alias("side"), "most")
    if not large.isEmpty():
        cells = cells.union(written(_cells(large, block), "ngram-meetings"))

    def possible(table: pa.Table) -> list[tuple[int, int, int]]:
        ids, cell = _numbers(table, "id"), _numbers(table, "cell")
        found = candidates(_numbers(table, "side"), _numbers(table, "component"), table.column("bits"), _numbers(table, "size"), _numbers(table, "most"), threshold)
        return [(int(min(ids[a], ids[b])), int(max(ids[a], ids[b])), int(cell[a])) for a, b in found]

    def verify(table: pa.Table) -> list[tuple[int, int]]:
        return verify_cell(_numbers(table, "id"), _numbers(table, "component"), _grams(table), threshold)

    # A pair may meet in many cells; its sets travel to one of them.
    left = _each_cell(cells.join(bits.drop("set_key"), "id"), possible, ("a", "b", "cell")).groupBy("a", "b").agg(F.min("cell").alias("cell"))
    left = written(left.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-left")
    if not left.isEmpty():
        sets = sets_of(written(left.select("id").distinct(), "ngram-ids"))
        found = written(_each_cell(left.join(components, "id").join(sets, "id"), verify, ("a", "b")), "ngram-links")
        components = written(_joined_components(components, found), "ngram-components")
        seen.append(sets)

    # Every link lies in a component, and whoever has one has been verified above.
    grouped = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    grouped = written(components.join(grouped, "component").select("id", "component"), "ngram-grouped")

    def count(table: pa.Table) -> list[tuple[int, int]]:
        return count_cell(_numbers(table, "id"), _numbers(table, "side"), _grams(table), threshold)

    found = grouped.select(F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("component").alias("group_id")).limit(0)
    if seen:
        sets = seen[0]
        for more in seen[1:]:
            sets = sets.union(more)
        if len(seen) > 1:
            sets = sets.dropDuplicates(["id", "set_key"])
        links = _each_cell(_link_cells(grouped, bits.select("id", "size"), sets, 2 * block), count, ("id", "links"))
        counted = links.groupBy("id").agg(F.sum("links").alias("n_links"))
        found = grouped.join(counted, "id").select(F.col("id").alias("class_id"), "n_links", F.col("component").alias("group_id"))
    found = written(found, "ngram-groups")

    known = real.select("id", "set_key").join(classes, "set_key").join(found, "class_id", "left").select(
        "id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("group_id", "class_id").alias("group_id"))
    single = all_rows.where("set_key is null or id is null").select(
        "id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("group_id"))
    return known.union(single).withColumnRenamed("id", id_col)
