"""Document fingerprints from closed syncmers over characters.

A run of k characters is an anchor if, of the runs of s characters inside it, a least one by hash
stands at its front or at its end. Whether it does depends on the k characters alone, so that two
texts choose the same anchors wherever they share k characters: a character put in or taken out
changes only the anchors that hold it, also in text without spaces. The smallest anchor hashes make
the fingerprint; likeness counts all anchors, and places of anchors that two texts share show
the passages they share. This is built-in functions over arrays.

Anchors are found once for each text. Those of an edited text that is the front of one text and the
front of another come from theirs, and from the few characters around the seam.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.neighbours import with_next

K = 12
S = 6
SKETCH = 64  # anchors of a fingerprint
PIECE = 4096  # characters of a text that are worked on at a time
PLACE_BITS = 27  # of a number that holds a place and a part of a hash
PLACE = (1 << PLACE_BITS) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def anchors(text: Column, k: int = K, s: int = S, piece: int = PIECE) -> Column:
    """Struct of two arrays, hash and code: the closed syncmers of a text, by place. Empty if it has none.

    The hash is one of the first and the last s characters, which hold all k. The code has the upper
    bits of the hash, a bit that is 0, and the place (:func:`places`; those beyond 2^27 count as that).
    Long texts are cut into pieces that overlap by k - 1 characters.
    """
    if not s < k <= 2 * s:
        raise ValueError("k must be above s and at most 2 * s")
    last = k - s  # place of the last s-mer in a k-mer

    def found(hashes, offset):
        starts = F.when(F.size(hashes) > last, F.sequence(F.lit(0), F.size(hashes) - last - 1)).otherwise(F.array().cast("array<int>"))
        least = lambda *places: F.least(*places) if len(places) > 1 else places[0]
        edge = lambda i: F.least(F.get(hashes, i), F.get(hashes, i + last))
        inner = lambda i: least(*(F.get(hashes, i + j) for j in range(1, last)))
        at = F.filter(starts, lambda i: edge(i) <= inner(i)) if last > 1 else starts
        hashed = lambda a: F.transform(a, lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + last)))
        # Places are added to the upper bits as one number.
        code = lambda a, h: F.zip_with(a, h, lambda i, x: F.coalesce(x.bitwiseAND(F.lit(~(2 * PLACE + 1))) + F.least(offset + i, F.lit(PLACE)), F.lit(0)))
        return let(let(at, lambda a: F.struct(a.alias("at"), hashed(a).alias("hash"))), lambda x: F.struct(x["hash"].alias("hash"), code(x["at"], x["hash"]).alias("code")))

    def of_piece(p, number):
        mers = F.regexp_extract_all(p, F.lit(f"(?s)(?=(.{{{s}}}))."), F.lit(1))
        return let(F.transform(mers, lambda m: F.xxhash64(m)), lambda h: found(h, number * piece))

    pieces = F.regexp_extract_all(_text(text), F.lit(f"(?s)(?=(.{{1,{piece + k - 1}}})).{{1,{piece}}}"), F.lit(1))
    return let(F.transform(pieces, of_piece), lambda x: F.struct(F.flatten(x["hash"]).alias("hash"), F.flatten(x["code"]).alias("code")))


def places(found: Column) -> Column:
    return F.transform(found["code"], lambda c: c.bitwiseAND(F.lit(PLACE)).cast("int"))


def anchor_set(hashes: Column, text: Column) -> Column:
    """The distinct anchor hashes of a text; of a text without an anchor, the hash of it all, so that
    equal texts have equal ones and no set is empty."""
    return F.when(F.size(hashes) > 0, F.array_distinct(hashes)).otherwise(F.array(F.xxhash64(F.lit(K), _text(text))))


def as_text(hashes: Column, most: int = SKETCH) -> Column:
    """The fingerprint: the first of the hashes, which are in order, 16 hexadecimal digits each."""
    return F.array_join(F.transform(F.slice(hashes, 1, most), lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def shared_runs(a: Column, b: Column, k: int = K) -> Column:
    """Array of (at, other_at, length): the passages that two texts share, from their anchors.

    Anchors with equal hashes are paired, one pair a hash: of several places the last in the first
    text with the first in the other. Pairs at one distance of places (a diagonal) of which each
    begins within k characters after the one before make a run, in characters of both texts.
    Hashes are compared by 36 bits.
    """
    return runs_of(both_in_order(a, b), k)


def both_in_order(a: Column, b: Column) -> Column:
    """The codes of two texts' anchors in one order: those of one hash lie together, those of the first
    text, by place, before the other's."""
    return F.sort_array(F.concat(a["code"], F.transform(b["code"], lambda c: c + F.lit(PLACE + 1))))


def runs_of(every: Column, k: int = K) -> Column:
    """:func:`shared_runs` from :func:`both_in_order`."""
    def diagonal(x, y):
        at = x.bitwiseAND(F.lit(PLACE))
        return F.when(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 1, (y.bitwiseAND(F.lit(PLACE)) - at + F.lit(PLACE + 1)) * F.lit(PLACE + 1) + at)

    pairs = let(every, lambda v: F.sort_array(F.filter(F.transform(v, lambda x, i: diagonal(x, F.get(v, i + 1))), lambda p: p.isNotNull())))

    def runs(p):
        first = F.filter(F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>")), lambda i: (i == 0) | (F.get(p, i) - F.get(p, i - 1) > k))
        at = lambda i: F.get(p, i).bitwiseAND(F.lit(PLACE))

        def run(f):
            def made(i, j):
                end = at(F.coalesce(F.get(f, j + 1), F.size(p)) - 1) + k
                other = at(i) + F.shiftright(F.get(p, i), PLACE_BITS) - F.lit(PLACE + 1)
                return F.struct(at(i).alias("at"), other.alias("other_at"), (end - at(i)).alias("length"))

            return F.transform(f, made)

        return let(first, run)

    return let(pairs, runs)


def longest(runs: Column) -> Column:
    """The longest run; of several the first."""
    found = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["at"]).alias("before"), r["at"].alias("at"), r["other_at"].alias("other_at"))))
    return F.struct(found["length"].alias("length"), found["at"].alias("at"), found["other_at"].alias("other_at"))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, its edited text and how it compares with the next document.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    of the longest passage shared with the next document longest_match (characters), match_at and
    match_next_at, null without one. The edited text has its last n_chars div 2 characters replaced by
    the first as many, or all, of the next document by id; the first follows the last. Likeness is
    the Jaccard similarity of all anchors; only the fingerprint is a sketch.

    A null text is empty. An empty text, and any without an anchor, has one anchor made from all of it. A
    null id comes before all others; places after the first 2^27 characters count as that; rows that share an id, and repeated rows, each get a row, in an order
    by their texts. A single row is its own next. An empty table gives no rows; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col), _text(F.col(text_col)).alias("text"))
    found = with_next(rows, id_col, F.xxhash64("text"), ["text", "anchors"], prepare=lambda r: r.withColumn("anchors", anchors(F.col("text"))))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    found = found.withColumns({"n": n, "cut": n - half, "take": F.least(half, F.char_length("next_text"))})
    found = found.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("cut")), F.substring("next_text", F.lit(1), F.col("take"))))
    # Whole anchors of the front, of what replaces the end, and those across the seam.
    until = lambda found, last: F.slice(f"{found}.hash", F.lit(1), F.size(F.filter(f"{found}.code", lambda c: c.bitwiseAND(F.lit(PLACE)) <= last)))
    front, end = until("anchors", F.col("cut") - K), until("next_anchors", F.col("take") - K)
    seam = F.substring("edited", F.greatest(F.col("cut") - K + 2, F.lit(1)), F.least(F.col("cut"), F.lit(K - 1)) + F.least(F.col("take"), F.lit(K - 1)))
    ordered = lambda hashes, of: F.sort_array(anchor_set(hashes, of))
    # Sets and sorted arrays are columns of their own that are named several times: so Spark makes
    # each once, and in compiled code, which it does not do inside a function over arrays.
    made = found.select(
        F.col(id_col), F.col("n").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        ordered(F.col("anchors.hash"), F.col("text")).alias("own"), anchor_set(F.col("next_anchors.hash"), F.col("next_text")).alias("after"),
        ordered(F.concat(front, end, anchors(seam)["hash"]), F.col("edited")).alias("edited"), both_in_order(F.col("anchors"), F.col("next_anchors")).alias("every"))
    made = made.withColumns({"in_edited": F.size(F.array_intersect("own", "edited")), "in_after": F.size(F.array_intersect("own", "after"))})
    alike = lambda n, other: (F.col(n) / (F.size("own") + F.size(other) - F.col(n))).cast("double")
    match = F.when((F.col("in_after") > 0) & (F.size("every") > 0), longest(runs_of(F.col("every"))))
    made = made.select(
        F.col(id_col), "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        alike("in_edited", "edited").alias("near_edited"), alike("in_after", "after").alias("near_next"), match.alias("match"))
    return made.select(
        F.col(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.col("match.length").alias("longest_match"), F.col("match.at").alias("match_at"), F.col("match.other_at").alias("match_next_at"))
