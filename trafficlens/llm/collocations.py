"""Phrases whose words occur together more often than by chance, from Rabin-Karp fingerprints.

Every n-gram of words gets a 64-bit fingerprint from prefix polynomials: over the bytes of a word,
and over the words of a text, so that a gram of any length costs two look-ups and a product. Tasks add
up equal fingerprints, and the shuffle adds up what the tasks have, with a pointer to one occurrence.
A phrase cannot be more frequent than the phrases inside it. So grams of n words are counted where
both grams of n - 1 words are frequent, which a bitmap of fixed size tells: it never leaves out a
frequent one. Text is only read for frequent fingerprints, through their pointers. A fingerprint
that stands for several phrases shows by a second hash of other bytes; such ones are counted again
by their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.arrays import SMALL, Texts, mix, small_batches, texts_of
from trafficlens.session import written

LONGEST = 5  # words of a phrase
LEAST = 100  # occurrences of a candidate
TOP = 2000  # phrases of a language
# Occurrences that a task adds up at a time, and the bits that tell which shorter grams are frequent.
CHUNK, BITMAP_BITS = 1 << 21, 26
CHECK_BITS = 31  # of the second hash
RANK_PARTS = 64

# Pieces end at . , ; : ! ? and at the bytes 10 to 13; words at these, blank and tab.
ENDS = np.zeros(256, np.int64)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = 1
IN_WORD = ENDS == 0
IN_WORD[[9, 32]] = False

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))
_OTHER = (np.arange(256) * 151 + 89).astype(np.uint8)  # each byte as another one, for the second hash


def _powers(factor: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, factor)
    out[:1] = 1
    return np.cumprod(out)


class Grams:
    """The words of some texts, and fingerprints of their n-grams."""

    def __init__(self, texts: Texts, langs: np.ndarray):
        low = SMALL[texts.data]
        self.texts, self.low = texts, low
        self.starts, self.stops = Texts(low, texts.ends, texts.first).words(IN_WORD)
        self.owner = texts.owners(self.starts)
        piece = np.cumsum(ENDS[low]) if len(low) else np.zeros(0, np.int64)
        # Unlike in two words if a piece or a text ends between them.
        self.piece = piece[self.starts] + self.owner
        self.lang = langs[self.owner]
        n = len(self.starts) + 1
        down = _powers(_INVERSE, n)
        self.sums = []
        for data in (low, _OTHER[low]):
            words = texts.span_hashes(self.starts, self.stops, data)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n)[:-1])))
            self.sums.append((total, down))

    def at(self, n: int) -> np.ndarray:
        """Where an n-gram within a piece begins, by number of its first word."""
        if len(self.starts) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - n + 1] == self.piece[n - 1 :])

    def hashes(self, at: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
        total, down = self.sums[kind]
        return mix((total[at + n] - total[at]) * down[at] + self.lang[at] + np.uint64(n))

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.stops[at : at + n]))


def _lang_hashes(column: pa.Array) -> np.ndarray:
    """A number for each language, from its 64-bit hash."""
    return mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _marked(bitmap: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(hashes), bool)
    cell = hashes >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)


def _found(grams: Grams, n: int, bits: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(at, fingerprint) of the n-grams of which both (n - 1)-grams may be frequent."""
    at = grams.at(n)
    keep = np.uint64((1 << 64) - (1 << (64 - bits)))
    if shorter is not None:
        for k in (0, 1):
            at = at[_marked(shorter, grams.hashes(at + k, n - 1) & keep)]
    return at, grams.hashes(at, n) & keep


def _bitmap(fingerprints: DataFrame) -> np.ndarray:
    """A bit for each value of the first bits of the fingerprints; 8 MB whatever their number."""
    cell = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    bits = fingerprints.select(F.shiftright(cell, 6).alias("at"), F.expr(f"shiftleft(1L, cast({BITMAP_WORD} as int))").alias("bits"))
    rows = bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


BITMAP_WORD = f"shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63"


def _each(texts: DataFrame, schema: str, use: Callable[[Grams, pa.RecordBatch], Iterator[pa.RecordBatch]], end=lambda: iter(())) -> DataFrame:
    """Rows that ``use`` makes of slices of the texts (doc, lang_no, lang, text), and ``end`` at last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = _lang_hashes(batch.column("lang_no"))
            for part in texts_of(batch.column("text")):
                rows = batch.slice(part.first, len(part))
                yield from use(Grams(part, langs[part.first : part.first + len(part)]), rows)
        yield from end()

    return texts.mapInArrow(run, schema)


class _Adder:
    """Adds up fingerprints of a task, some at a time."""

    def __init__(self, n: int, bits: int, shorter):
        self.n, self.bits, self.shorter = n, bits, shorter
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def use(self, grams: Grams, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, fp = _found(grams, self.n, self.bits, None if self.shorter is None else self.shorter.value)
        check = (grams.hashes(at, self.n, 1) >> np.uint64(64 - CHECK_BITS)).astype(np.int64)
        doc = rows.column("doc").to_numpy()[grams.owner[at]]
        begin = (grams.starts[at] - grams.texts.ends[grams.owner[at]]).astype(np.int64)
        self.parts.append((fp, check, doc, begin))
        self.size += len(fp)
        if self.size >= CHUNK:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.parts = []
            return
        fp, check, doc, begin = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        self.parts, self.size = [], 0
        order = np.argsort(fp, kind="stable")
        fp, check = fp[order], check[order]
        # One row for each fingerprint and second hash; in a run of one fingerprint both are mostly one.
        new = np.concatenate(([True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(fp)))
        at = order[first]
        columns = [fp[first].view(np.int64), count << CHECK_BITS | check[first], doc[at], begin[at]]
        for k in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names=["fp", "n_check", "doc", "begin"])


def _frequent(texts: DataFrame, n: int, least: int, bits: int, shorter) -> DataFrame:
    """Rows (fp, a, several, doc, begin): fingerprints of n-grams that occur ``least`` times."""
    adder = _Adder(n, bits, shorter)

    # The adder holds state of one task: each task unpickles its own. Tasks have added up what they
    # can, so the rows are dealt out as they are, and narrow.
    rows = _each(texts, "fp bigint, n_check bigint, doc bigint, begin bigint", adder.use, adder.end).repartition("fp")
    check = F.col("n_check").bitwiseAND(F.lit((1 << CHECK_BITS) - 1))
    sums = rows.groupBy("fp").agg(
        F.sum(F.shiftright("n_check", CHECK_BITS)).alias("a"), F.min(check).alias("low"), F.max(check).alias("high"), F.first("doc").alias("doc"), F.first("begin").alias("begin"))
    return sums.where(F.col("a") >= least).select("fp", "a", (F.col("low") != F.col("high")).alias("several"), "doc", "begin")


def _phrases(texts: DataFrame, frequent: DataFrame, bits: int) -> DataFrame:
    """Rows (lang, words, phrase, a) of the frequent fingerprints that stand for one phrase."""
    wanted = frequent.where("not several").groupBy("doc").agg(F.collect_list(F.struct("fp", "n", "begin", "a")).alias("wanted"))
    rows = texts.join(wanted.hint("merge"), "doc")

    def use(grams: Grams, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = rows.column("wanted")
        owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        fp, n, begin, a = (flat.field(k).to_numpy() for k in range(4))
        keep = np.uint64((1 << 64) - (1 << (64 - bits)))
        at = np.searchsorted(grams.starts, grams.texts.ends[owner] + begin)
        out = []
        for k in np.unique(n):
            mine = np.flatnonzero((n == k) & (at + k <= len(grams.starts)))
            # The pointer holds if the text there has the fingerprint; of rows that share an id one does.
            held = mine[(grams.hashes(at[mine], int(k)) & keep).view(np.int64) == fp[mine]]
            out += [(owner[i], grams.phrase(at[i], int(k)).decode(), int(k), int(a[i])) for i in held]
        langs = rows.column("lang")
        if out:
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array([x[0] for x in out])), pa.array([x[2] for x in out], pa.int32()), pa.array([x[1] for x in out]), pa.array([x[3] for x in out], pa.int64())],
                names=["lang", "words", "phrase", "a"])

    return _each(rows, "lang string, words int, phrase string, a bigint", use).distinct()


def _recounted(texts: DataFrame, several: DataFrame, n: int, least: int, bits: int) -> DataFrame:
    """The same for fingerprints of several phrases: counted by their text."""
    marks = texts.sparkSession.sparkContext.broadcast(_bitmap(several))

    def use(grams: Grams, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, fp = _found(grams, n, bits, None)
        hit = np.flatnonzero(_marked(marks.value, fp))
        if len(hit):
            at, fp = at[hit], fp[hit]
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang").take(pa.array(grams.owner[at])), pa.array([grams.phrase(k, n).decode() for k in at]), pa.array(fp.view(np.int64))],
                names=["lang", "phrase", "fp"])

    counted = _each(texts, "lang string, phrase string, fp bigint", use).groupBy("lang", "phrase", "fp").agg(F.count("*").alias("a"))
    exact = counted.where(F.col("a") >= least).join(several.select("fp"), "fp", "left_semi")
    return exact.select("lang", F.lit(n).alias("words"), "phrase", "a")


def frequent_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                     longest: int = LONGEST, least: int = LEAST, fingerprint_bits: int = 64) -> DataFrame:
    """Rows (lang, words, phrase, a): the phrases of 1 to ``longest`` words that occur ``least`` times."""
    spark = docs.sparkSession
    small_batches(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("doc"), F.xxhash64(lang).alias("lang_no"), lang.alias("lang"), text.alias("text"))
    shorter, levels, parts = None, [], []
    for n in range(1, longest + 1):
        level = written(_frequent(texts, n, least, fingerprint_bits, shorter), f"phrases-{n}")
        levels.append(level.withColumn("n", F.lit(n)))
        several = level.where("several")
        if not several.isEmpty():
            parts.append(_recounted(texts, several, n, least, fingerprint_bits))
        if n < longest:
            shorter = spark.sparkContext.broadcast(_bitmap(level))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    out = _phrases(texts, every, fingerprint_bits)
    for part in parts:
        out = out.union(part)
    return written(out, "phrases")


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, total): how many words each language has."""
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in texts_of(batch.column(1)):
                count = np.bincount(part.owners(part.words(IN_WORD)[0]), minlength=len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(count.astype(np.int64))], names=["lang", "words"])

    return texts.mapInArrow(run, "lang string, words bigint").groupBy("lang").agg(F.sum("words").alias("total"))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, words, phrase, a, l, r, n, score) of phrases of two words or more.

    A phrase is cut after its first words; the cut whose parts would meet most often by chance, so
    with the lowest score, counts. Every part is frequent as the phrase is, so that both joins find it.
    """
    split = F.split("phrase", " ")
    cut = lambda begin, n: F.array_join(F.slice(split, begin, n), " ")
    cuts = phrases.where("words > 1").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("words")).alias("right"))
    part = lambda side, count: phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    met = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals.select("lang", F.col("total").alias("n")), "lang")
    # Whole numbers of up to 38 digits; div cuts down exactly.
    wide = lambda c: f"cast({c} as decimal(20,0))"
    score = F.expr(f"cast(1000 * {wide('a')} * {wide('n')} as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
    best = met.withColumn("score", score).groupBy("lang", "words", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.l", "best.r", "n", "best.score")


def whole_phrases(found: DataFrame) -> DataFrame:
    """Phrases that do not always stand inside one longer phrase of the table."""
    split = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(split, i, n), " "))))
    parts = found.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = found.join(most, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")


def collocations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST,
                 least: int = LEAST, top: int = TOP, fingerprint_bits: int = 64) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's phrases of the highest scores.

    A to Z count as small letters. Texts are cut into pieces at . , ; : ! ? and line ends, pieces into
    words at blanks and tabs; phrases are 2 to ``longest`` words within a piece that occur ``least``
    times in their language. The score is 1000 times the ratio of a phrase's count to what its two
    parts would give by chance, at the cut where that is least (then the first). A phrase that is
    never met outside a longer phrase goes. Ties of the score go by count, then by phrase in order of
    UTF-8 bytes.

    A null text counts as empty, a null language as "und"; rows without an id, repeated rows and rows
    that share an id all count. An empty table gives no rows; other columns are not read. With
    fewer ``fingerprint_bits`` more phrases share a fingerprint and are counted by their text: the
    result is the same.
    """
    phrases = frequent_phrases(docs, id_col, text_col, lang_col, longest, least, fingerprint_bits)
    found = whole_phrases(written(scored(phrases, word_counts(docs, text_col, lang_col)), "phrases-scored"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    near = found.withColumn("in_part", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("in_part") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = near.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
