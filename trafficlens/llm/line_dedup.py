"""Removal of lines that repeat, exactly or but for one word or one character, an earlier line of the
corpus.

The order of lines is (doc_id, line number). Near repeats come from a deletion neighbourhood, once
over words and once over characters, which also meets lines whose words are joined or split and lines
of few words. Over words: every line of a pair within one word edit either leaves the same words when the word at the
same place is taken out (a replaced word), or is the other line with one word taken out (an added
word). So each line emits hashed keys of its variants, equal keys meet, and the earliest line of a
key stands for it. The distance is then verified on the words themselves. Over
characters all is the same, with a character in place of a word.

A line of n words has n variants, so only lines that can have a partner emit them. First by two keys
a line: with one edit, either the first or the last q words of two lines are equal, q being at most
half their words. Of the lines left, by eight: of four quarters of a line one edit leaves three,
two counted from the front and two from the back. Neither step loses a pair. What lines that share
three quarters have outside them is quartered again, as long as it is long. Of the few words left
they emit the variants, so that the work for a line grows with its length, not with its square.

Tables that grow with the corpus are joined by sorting, never broadcast. Everything is DataFrame
operations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.session import written

MIN_WORDS = 1  # lines of white space are never removed
NEAR_WORDS = 8  # of shorter lines, words are compared exactly only
SHORT_WORDS = 4  # the same where near copies of short lines count, too: one word is a quarter at most
NEAR_CHARS = 8  # of shorter lines, characters are compared exactly only: one is an eighth at most
REST = 128  # units outside the shared quarters, at most, of which variants are made; 4 at least


def _words(line: Column) -> Column:
    # Mostly blanks alone divide words, and a plain cut at these takes a fraction of an expression's time.
    rare = [F.contains(line, F.lit(c)) for c in "\t\x0b\x0c\r"]
    found = F.regexp_extract_all(line, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(reduce(or_, rare), found).otherwise(F.array_remove(F.split(line, " ", -1), ""))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


@dataclass(frozen=True)
class Units:
    """What edits are counted in: the parts of a line, as an array or a string."""

    name: str
    least: int  # units of a line that can have near copies
    of: Callable[[Column], Column]
    size: Callable[[Column], Column]
    cut: Callable[[Column, Column, Column], Column]  # from a place, counted from 1, so many units
    hashed: Callable[[Column], Column]  # what keys are made from
    near: Callable[[Column, Column], Column]


def _key(*columns: Column) -> list[Column]:
    """128 bits of hash, as two numbers."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)]


def _half(n: Column) -> Column:
    """Words that a line of n words compares at either end: a power of two, at most n / 2."""
    return F.pow(F.lit(2), F.floor(F.log2(n / 2))).cast("int")


def _line_keys(docs: DataFrame, id_col: str, text_col: str, kinds: tuple[Units, ...]) -> DataFrame:
    """Rows (doc, pos, h, g, again, and ends by kind of units): hash of the line, whether the document
    has it earlier, and the hashes of its ends under which lines that may be near it meet."""
    names = [u.name for u in kinds]

    def read(line, pos):
        h, g = _key(line)
        return F.struct(h.alias("h"), g.alias("g"), pos.alias("pos"), _words(line).alias("words"), line.alias("chars"))

    def keyed(x):
        return F.struct(x["h"].alias("h"), x["g"].alias("g"), x["pos"].alias("pos"), *(_end_keys(x[u.name], u).alias(u.name) for u in kinds))

    # One step inside the other, so that a line is cut into words once.
    lines = F.transform(F.split(F.col(text_col).cast("string"), "\n", -1), read)
    kept = F.sort_array(F.transform(F.filter(lines, lambda x: F.size(x["words"]) >= MIN_WORDS), keyed))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), kept.alias("all"))
    marked = F.transform("all", lambda x, i: F.struct(
        x["h"].alias("h"), x["g"].alias("g"), x["pos"].alias("pos"), *(x[n].alias(n) for n in names),
        F.when(i > 0, (F.col("all")[i - 1]["h"] == x["h"]) & (F.col("all")[i - 1]["g"] == x["g"])).otherwise(False).alias("again")))
    return rows.select("doc", F.inline(marked))


def _end_keys(line: Column, units: Units) -> Column:
    """Hashes of the first and of the last q units, for the q of the line and of one a unit shorter."""
    keys = lambda n, q: [F.xxhash64(F.lit(1), q, units.cut(line, F.lit(1), q)), F.xxhash64(F.lit(2), q, units.cut(line, n - q + 1, q))]
    none = F.array().cast("array<bigint>")

    def made(x):
        n, q, less = x["n"], x["q"], x["less"]
        own = F.when(n >= units.least, F.array(*keys(n, q))).otherwise(none)
        return F.concat(own, F.when((n > units.least) & (less != q), F.array(*keys(n, less))).otherwise(none))

    sizes = lambda n: F.struct(n.alias("n"), _half(n).alias("q"), _half(n - 1).alias("less"))
    return let(let(units.size(line), sizes), made)


def _slice(line: Column, begin, end, units: Units) -> Column:
    return units.cut(line, F.lit(begin) + 1 if isinstance(begin, int) else begin + 1, F.greatest(end - begin, F.lit(0)))


def _quarters(hashed: Column, m: Column, more: Column | int, units: Units) -> list[tuple[Column, ...]]:
    """Three of the four quarters of a line, for each quarter that is left out, as of a line of m units.

    Of lines of equal length with one word replaced, three quarters are equal. A line with one more
    word, put into the first quarter, has the shorter line's second quarter one place later, and put
    into the last quarter has the third one place earlier.
    """
    n, a = units.size(hashed), F.floor(m / 4).cast("int")
    part = lambda at: units.cut(hashed, at + 1, a)
    front, second, third, back = part(F.lit(0)), part(a), part(n - 2 * a), part(n - a)
    return [(part(a + more), third, back), (front, third, back), (front, second, back), (front, second, part(n - 2 * a - more))]


def _quarter_keys(hashed: Column, units: Units) -> Column:
    """Structs (key, k, more): hashes of three of the four quarters of a line, as it stands (more 0)
    and as a line with one word more (1). ``k`` tells which quarter is left out."""
    n = units.size(hashed)

    def keys(m, more):
        made = _quarters(hashed, m, more, units)
        return [F.struct(F.xxhash64(F.lit(k), m, *parts).alias("key"), F.lit(k).alias("k"), F.lit(more).alias("more")) for k, parts in enumerate(made)]

    none = F.array().cast("array<struct<key:bigint,k:int,more:int>>")
    return F.concat(F.array(*keys(n, 0)), F.when(n > units.least, F.array(*keys(n - 1, 1))).otherwise(none))


def _rest_keys(key: Column, rest: Column, more: Column, units: Units) -> Column:
    """Structs (key, rest): the same for the units that a key has left out, and what stays outside."""
    m = units.size(rest) - more
    made = _quarters(rest, m, more, units)
    return F.array(*(F.struct(F.xxhash64(key, F.lit(k), m, *parts).alias("key"), _left_out(rest, F.lit(k), more, units).alias("rest")) for k, parts in enumerate(made)))


def _left_out(hashed: Column, k: Column, more: Column, units: Units) -> Column:
    """The units outside the three quarters of a key: where the edit must be."""
    n = units.size(hashed)
    a = F.floor((n - more) / 4).cast("int")
    part = lambda begin, end: _slice(hashed, begin, end, units)
    return (F.when(k == 0, F.concat(part(0, a + more), part(2 * a + more, n - 2 * a)))
            .when(k == 1, part(a, n - 2 * a))
            .when(k == 2, part(2 * a, n - a))
            .otherwise(F.concat(part(2 * a, n - 2 * a - more), part(n - a - more, n))))


def _variants(key: Column, rest: Column, more: Column, units: Units) -> Column:
    """Structs (variant, kind) of a line under a key, from the units left out of it: one taken out at
    a place (kind 0), all of them (1); and for a line taken as longer by a word, one taken out (2)."""
    n = units.size(rest)
    without = lambda i: F.concat(units.cut(rest, F.lit(1), i), units.cut(rest, i + 2, n - i - 1))
    made = lambda variant, kind: F.struct(variant.alias("variant"), F.lit(kind).alias("kind"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    as_it_is = F.concat(
        F.transform(places, lambda i: made(F.xxhash64(F.lit(0), key, i, without(i)), 0)), F.array(made(F.xxhash64(F.lit(1), key, rest), 1)))
    return F.when(more == 0, as_it_is).otherwise(F.transform(places, lambda i: made(F.xxhash64(F.lit(1), key, without(i)), 2)))


def within_one(a: Column, b: Column) -> Column:
    """Whether one word edit at most turns one array of words into the other."""
    apart = lambda x, y: F.array_position(F.zip_with(x, y, lambda v, w: ~v.eqNullSafe(w)), True)
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    # Equal words at the front, and at the back; the place of the first difference is 0 if there is none.
    front = lambda x, y: F.when(apart(x, y) == 0, longer).otherwise(apart(x, y) - 1)
    return (longer - shorter <= 1) & (front(a, b) + front(F.reverse(a), F.reverse(b)) >= longer - 1)


def close_strings(a: Column, b: Column, piece: int = 512) -> Column:
    """Whether one character edit at most turns one string into the other, in time that grows with
    their length: of long strings equal pieces at the front and at the back are cut off first."""
    pieces = lambda x: F.regexp_extract_all(x, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))

    def without_front(x, y):
        apart = F.array_position(F.zip_with(pieces(x), pieces(y), lambda v, w: ~v.eqNullSafe(w)), True)
        rest = lambda s, n: F.when(n == 0, F.lit("")).otherwise(F.substring(s, ((n - 1) * piece + 1).cast("int"), F.char_length(s)))
        return let(apart, lambda n: F.struct(rest(x, n).alias("x"), rest(y, n).alias("y")))

    near = lambda x, y: F.levenshtein(x, y, 1) >= 0
    # With one edit it lies in the first piece left, and all after that is equal from the back.
    ends = lambda p: let(without_front(F.reverse(p["x"]), F.reverse(p["y"])), lambda q: F.when(
        F.greatest(F.char_length(q["x"]), F.char_length(q["y"])) > 2 * piece + 1, F.lit(False)).otherwise(near(q["x"], q["y"])))
    long = F.greatest(F.char_length(a), F.char_length(b)) > 2 * piece
    return F.when(long, let(without_front(a, b), ends)).otherwise(near(a, b))


def words(least: int) -> Units:
    return Units("words", least, _words, F.size, F.slice, _hashed, within_one)


def characters(least: int) -> Units:
    return Units("chars", least, lambda line: line, F.char_length, F.substring, lambda x: x, close_strings)


def _chosen(keys: DataFrame, units: Units) -> DataFrame:
    """Rows (doc, pos) of the lines, at their first place, that share an end with another line."""
    ends = keys.where(~F.col("again") & (F.size(units.name) > 0)).select("doc", "pos", "h", F.explode(units.name).alias("end"))
    met = written(ends.groupBy("end").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("end"), "line-ends")
    return ends.join(met.hint("merge"), "end").groupBy("h").agg(F.min(F.struct("doc", "pos")).alias("at")).select("at.doc", "at.pos")


def _fetched(docs: DataFrame, chosen: list[DataFrame], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, pos, kinds, line) of the chosen lines; bit k of kinds tells that list k has it.

    One join fetches them all. Of rows that share an id, each gives its line."""
    marked = [rows.select("doc", "pos", F.lit(1 << k).alias("kind")) for k, rows in enumerate(chosen)]
    every = marked[0]
    for rows in marked[1:]:
        every = every.union(rows)
    places = every.groupBy("doc", "pos").agg(F.sum("kind").cast("int").alias("kinds"))
    per_doc = places.groupBy("doc").agg(F.collect_list(F.struct("pos", "kinds")).alias("places"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    split = texts.join(per_doc.hint("merge"), "doc").select("doc", "places", F.split("text", "\n", -1).alias("lines"))
    place = lambda p: F.struct(p["pos"].alias("pos"), p["kinds"].alias("kinds"), F.get(F.col("lines"), p["pos"]).alias("line"))
    return split.select("doc", F.inline(F.transform("places", place))).where("line is not null")


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows whose key another line has: two lines differ in their document or in their place in it."""
    met = written(rows.groupBy("key").agg(
        F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last"))
        .where("low < high or first < last").select("key"), "line-meetings")
    return rows.join(met.hint("merge"), "key")


def _rests(lines: DataFrame, units: Units, most: int) -> DataFrame:
    """Rows (doc, pos, key, more, rest) of lines that share all but a few units, ``most`` or fewer,
    with another line: the key of what they share, and the units outside it."""
    hashed = lines.select("doc", "pos", units.hashed(F.col("units")).alias("hashes"))
    quarters = written(hashed.select("doc", "pos", F.inline(_quarter_keys(F.col("hashes"), units))), "line-quarters")
    left = _meeting(quarters).join(hashed.hint("merge"), ["doc", "pos"])
    columns = ["doc", "pos", "key", "more", "rest"]
    rests = written(left.select("doc", "pos", "key", "more", _left_out(F.col("hashes"), F.col("k"), F.col("more"), units).alias("rest")), "line-rests")
    most = max(most, 4)  # fewer cannot be quartered
    # Counted as in the shorter line, so that both lines of a pair are cut as often.
    size = units.size(F.col("rest")) - F.col("more")
    done, long = [rests.where(size <= most)], rests.where(size > most)
    while not long.isEmpty():
        cut = long.select("doc", "pos", "more", F.inline(_rest_keys(F.col("key"), F.col("rest"), F.col("more"), units)))
        rests = written(_meeting(written(cut, "line-cut")).select(*columns), "line-rests")
        done.append(rests.where(size <= most))
        long = rests.where(size > most)
    every = done[0].select(*columns)
    for rows in done[1:]:
        every = every.union(rows.select(*columns))
    return every


def _near(fetched: DataFrame, bit: int, units: Units, most: int) -> DataFrame:
    """Rows (doc, pos) of lines with an earlier line one edit away."""
    lines = fetched.where(F.col("kinds").bitwiseAND(F.lit(bit)) != 0).select("doc", "pos", units.of(F.col("line")).alias("units"))
    lines = written(lines.where(units.size(F.col("units")) >= units.least), "line-units")
    rests = _rests(lines, units, most)
    made = written(rests.select("doc", "pos", F.inline(_variants(F.col("key"), F.col("rest"), F.col("more"), units))), "line-variants")
    at = F.struct("doc", "pos")
    leaders = written(
        made.groupBy("variant").agg(*(F.min(F.when(F.col("kind") == k, at)).alias(f"first_{k}") for k in (0, 1, 2)), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "line-leaders")
    # What stands first under a variant: lines with the same place taken out; for a whole line those
    # longer by a word, and the other way round.
    leader = F.when(F.col("kind") == 0, F.col("first_0")).when(F.col("kind") == 1, F.col("first_2")).otherwise(F.col("first_1"))
    pairs = written(
        made.join(leaders.hint("merge"), "variant").select("doc", "pos", leader.alias("to")).where(F.col("to") < at)
        .select("doc", "pos", F.col("to.doc").alias("to_doc"), F.col("to.pos").alias("to_pos")).distinct(), "line-pairs")
    theirs = lines.select(F.col("doc").alias("to_doc"), F.col("pos").alias("to_pos"), F.col("units").alias("to_units"))
    checked = pairs.join(lines, ["doc", "pos"]).join(theirs, ["to_doc", "to_pos"])
    return checked.where(units.near(F.col("units"), F.col("to_units"))).select("doc", "pos").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, most: int = REST) -> DataFrame:
    """Rows (doc, exact, near) for documents with lines to remove: their numbers, from 0, in order."""
    kinds = (words(near_words), characters(near_chars))
    keys = written(_line_keys(docs, id_col, text_col, kinds), "line-keys")
    # Repeats add up before the shuffle, however often a line occurs; the join that follows has plain
    # tables on both sides, so that adaptive execution can split a hot line.
    groups = written(keys.groupBy("h", "g").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-groups")
    exact = keys.select("doc", "pos", "h", "g", "again").join(groups.hint("merge"), ["h", "g"]).where(F.col("again") | (F.col("first") < F.col("doc")))
    fetched = written(_fetched(docs, [_chosen(keys, units) for units in kinds], id_col, text_col), "line-fetched")
    near = _near(fetched, 1, kinds[0], most).union(_near(fetched, 2, kinds[1], most))
    both = exact.select("doc", "pos", F.lit(False).alias("near")).union(near.select("doc", "pos", F.lit(True).alias("near")))
    places = lambda near: F.array_sort(F.collect_set(F.when(F.col("near") == near, F.col("pos"))))
    per_doc = both.groupBy("doc").agg(places(False).alias("exact"), places(True).alias("near"))
    return per_doc.select("doc", "exact", F.array_except("near", "exact").alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, most: int = REST) -> DataFrame:
    """All columns of ``docs`` with the text's repeated lines taken out, and ``exact_lines`` and
    ``near_lines``, the numbers of the removed ones.

    A line goes if an earlier line is equal; or at most one word edit away (a word replaced, added or
    left out), both having ``near_words`` words (4 at least); or one character edit away, both having
    ``near_chars`` characters (4 at least). Whether the earlier one itself stays does not matter. Lines
    are split at \\n and compared as they are, words are runs between white space. Lines without
    a word, empty ones among them, always stay. All other lines stay, in order.

    A null text stays null and has no lines; a null id is passed through. Rows that share an id count
    as one document: equal lines of theirs do not remove each other, and both rows lose the same
    lines. ``most`` is how many units outside shared quarters make variants; results do not depend on it. A text all of whose lines go becomes empty. An empty table gives no rows. Columns of
    ``docs`` that have the names of the two added ones are replaced.
    """
    gone = written(repeated_lines(docs, id_col, text_col, near_words, near_chars, most), "lines-gone").select(
        F.col("doc").alias("_doc"), F.col("exact").alias("_exact"), F.col("near").alias("_near"))
    joined = docs.join(gone.hint("merge"), docs[id_col] == F.col("_doc"), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    # The places as text, to look each one up at one go.
    drop = F.concat(F.col("_exact"), F.col("_near"))
    kept = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(drop, i)), "\n")
    none = F.array().cast("array<int>")
    out = joined.withColumn(text_col, F.when(F.col("_doc").isNull(), F.col(text_col).cast("string")).otherwise(kept))
    return out.withColumns({"exact_lines": F.coalesce("_exact", none), "near_lines": F.coalesce("_near", none)}).drop("_doc", "_exact", "_near")
