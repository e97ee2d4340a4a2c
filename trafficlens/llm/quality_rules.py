"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths are compared within each text; the share of its
characters that lie inside repeated n-grams and lines decides. All texts of a slice are handled by
the same array operations, so a text costs no Python loop of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import Texts, mix, small_batches, texts_of, window_hashes

# Published limits for the share of characters in repeated n-grams, by n, and in repeated lines.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
# Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
REPEAT_PERCENT = 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.sort(keys)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    return twice[np.minimum(at, len(twice) - 1)] == keys


def later_repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys equal an earlier one."""
    out = np.zeros(len(keys), bool)
    some = np.flatnonzero(_repeated(keys))
    if len(some):
        order = some[np.argsort(keys[some], kind="stable")]
        out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n that begins at one of the starts."""
    steps = np.zeros(words + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + n, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """Counts and coverages of each text of a slice."""
    data = texts.data
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    starts, stops = texts.words()
    owner = texts.owners(starts)
    n = len(texts)
    length = chars[stops] - chars[starts]
    count = lambda who, weight=None: np.bincount(who, weight, minlength=n)[:n]
    out = {
        "n_words": count(owner).astype(np.int64),
        "word_chars": count(owner, length).astype(np.int64),
        "n_symbols": texts.per_text(_IS_SYMBOL[data]).astype(np.int64),
    }
    hashes = texts.span_hashes(starts, stops)
    salt = mix(owner.astype(np.uint64) * _ODD + np.uint64(1))
    total = np.maximum(out["word_chars"], 1)
    for size in (5, *(k for k in NGRAM_LIMITS if k != 5)):
        keys = window_hashes(hashes, size)
        valid = np.flatnonzero(owner[: len(keys)] == owner[size - 1 :][: len(keys)]) if len(keys) else np.zeros(0, int)
        keys = keys[valid] ^ salt[valid]
        if size == 5:
            found = valid[_repeated(keys)]
            out["n_repeat_words"] = count(owner, _covered(found, 5, len(owner))).astype(np.int64)
        again = valid[later_repeats(keys)]
        out[f"coverage_{size}"] = count(owner, length * _covered(again, size, len(owner))) / total

    begin, end = texts.lines()
    first_word = np.searchsorted(starts, begin)
    has_word = (first_word < len(starts)) & (starts[np.minimum(first_word, len(starts) - 1)] < end) if len(starts) else np.zeros(len(begin), bool)
    begin, end = begin[has_word], end[has_word]
    line_owner = texts.owners(begin)
    keys = texts.span_hashes(begin, end) ^ mix(line_owner.astype(np.uint64) * _ODD + np.uint64(1))
    again = later_repeats(keys)
    out["n_dup_lines"] = count(line_owner, again).astype(np.int64)
    size = chars[end] - chars[begin]
    out["coverage_lines"] = count(line_owner, size * again) / np.maximum(count(line_owner, size), 1)
    return out


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column(1)):
            got = measure(texts)
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > REPEAT_PERCENT * got["n_words"])
            bad = got["coverage_lines"] > LINE_LIMIT
            for size, limit in NGRAM_LIMITS.items():
                bad |= got[f"coverage_{size}"] > limit
            columns = [batch.column(0).slice(texts.first, len(texts))]
            columns += [pa.array(got[k]) for k in COUNTS]
            columns += [pa.array(got[f"coverage_{k}"]) for k in (*NGRAM_LIMITS, "lines")]
            columns += [pa.array(failed), pa.array(~failed & ~bad)]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)


NAMES = ["id", *COUNTS, *(f"coverage_{k}" for k in (*NGRAM_LIMITS, "lines")), "base_failed", "kept"]


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, base counts, coverages and verdict. No shuffle.

    Words are runs without the characters 9 to 13 and 32. ``coverage_n`` is the share of word
    characters inside n-grams of n words that repeat an earlier one of the same text,
    ``coverage_lines`` the share of the characters of lines with a word in lines that equal an
    earlier one. A text fails the base rules with fewer than 10 words or more than 20 % of them in
    repeated 5-word windows; it is kept if it passes them and every coverage is within its limit.

    A null or empty text has no words and fails. Repeated rows each get their own row, a null id
    stays null, an empty table gives none; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(
        [f"id {kind}", *(f"{k} bigint" for k in COUNTS)]
        + [f"{k} double" for k in NAMES if k.startswith("coverage")] + ["base_failed boolean", "kept boolean"]
    )
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_verdicts, schema)
    return found.withColumnRenamed("id", id_col)
