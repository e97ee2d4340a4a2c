import random
import re

import pytest
from llm_cases import docs_of, edge_rows, edges, nothing, prose
from pyspark.sql import functions as F

from trafficlens.llm import line_dedup


def words(line):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows):
    """Every line against every earlier one; rows of (id, text)."""
    seen, out = [], {}
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for pos, line in enumerate((text or "").split("\n")):
            own = words(line)
            if len(own) < 2:
                continue
            exact, near = out.setdefault(doc, (set(), set()))
            if line in first:
                if first[line] != (doc, pos):
                    exact.add(pos)
            else:
                first[line] = (doc, pos)
                if len(own) >= 8:
                    if any(abs(len(own) - len(o)) <= 1 and distance(own, o) <= 1 for o in seen):
                        near.add(pos)
                    seen.append(own)
    return {d: (sorted(e), sorted(n)) for d, (e, n) in out.items()}


def check(found, rows):
    expected = brute(rows)
    for r in found.collect():
        exact, near = expected.get(r.doc_id, ([], []))
        assert (list(r.exact_lines), list(r.near_lines)) == (exact, near), r.doc_id
        if r.text is not None:
            text = dict(rows)[r.doc_id]
            assert r.text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in {*exact, *near})


@pytest.mark.parametrize("most", [line_dedup.REST, 4])
def test_edits_against_every_pair(spark, most):
    rng = random.Random(5)
    base = [prose(i, n).split() for i, n in enumerate([8, 8, 9, 9, 12, 15, 16, 17, 31, 32, 33, 64, 65])]
    lines = []
    for own in base:
        for turn in range(12):
            line = list(own)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(line) + 1)
                kind = rng.randrange(3)
                if kind == 0:
                    line.insert(at, rng.choice(["new", own[0]]))
                elif at < len(line):
                    line[at : at + 1] = [] if kind == 1 else ["changed"]
            lines.append(" ".join(line))
        lines.append(" ".join(own))
    rng.shuffle(lines)
    rows = [(i // 3, line) for i, line in enumerate(lines)]
    docs = {}
    for doc, line in rows:
        docs.setdefault(doc, []).append(line)
    rows = [(d, "\n".join(x)) for d, x in docs.items()]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), most=most)
    check(found, rows)
    assert sum(map(len, (r.near_lines for r in found.collect()))) > 60


def test_edge_cases(spark):
    found = line_dedup.dedup_lines(edges(spark)).collect()
    assert len(found) == len(edge_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[0].text is None and by_id[1].text == "" and by_id[2].text == " \n\t "
    assert by_id[4].text and by_id[5].text == ""
    assert [r.text for r in found if r.doc_id == 4] == [edge_rows()[4][1]] * 2
    assert list(by_id[11].exact_lines) == [2] and by_id[11].text == "1 2\n\n"
    assert by_id[6].text == ""  # one word more than an earlier line
    assert all(r.s == "clash" and r.words == 5 for r in found)
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_one_line_in_a_third_of_all_rows(spark):
    texts = [f"{prose(i, 12)}\nthe same old line as ever" if i % 3 else "the same old line as ever" for i in range(300)]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts)).collect()}
    assert found[0].text == "the same old line as ever"
    assert all(found[i].text == (prose(i, 12) if i % 3 else "") for i in range(1, 300))


@pytest.mark.parametrize("most", [line_dedup.REST, 5])
def test_short_lines_and_characters_against_every_pair(spark, most):
    """One word edit in lines of few words; one character edit at any length, words joined or split."""
    rng = random.Random(8)
    lines = ["Anat with by of nteres atre are.", "Anat with by of lyhaes atre are.", "brown fox", "brownfox", "7 8 9", "7 8 8",
             f"{prose(70, 30)} brown fox {prose(71, 20)}", f"{prose(70, 30)} brownfox {prose(71, 20)}", f"{prose(70, 30)} brown-fox {prose(71, 20)}"]
    for i in range(40):
        own = prose(200 + i, 1 + i % 9)
        for turn in range(6):
            line = list(own)
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "x", " ", "é"])
            lines.append("".join(line))
        lines.append(own)
        parts = own.split()
        parts[rng.randrange(len(parts))] = "changed"
        lines.append(" ".join(parts))
    rows = [(i, line) for i, line in enumerate(lines)]
    expected, seen = set(), []
    for i, line in rows:
        own = words(line)
        if len(own) < line_dedup.MIN_WORDS:
            continue
        for other in seen:
            theirs = words(other)
            if other == line:
                break
            if min(len(own), len(theirs)) >= line_dedup.SHORT_WORDS and distance(own, theirs) <= 1:
                expected.add(i)
            if min(len(line), len(other)) >= line_dedup.NEAR_CHARS and abs(len(line) - len(other)) <= 1 and distance(line, other) <= 1:
                expected.add(i)
        if line in seen:
            expected.discard(i)
        seen.append(line)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.dedup_lines(frame, near_words=line_dedup.SHORT_WORDS, most=most).collect()
    assert {r.doc_id for r in found if r.near_lines} == expected
    assert {1, 7} <= expected and 5 not in expected and len(expected) > 100


def test_lines_of_one_word_go_if_they_repeat(spark):
    chinese = "这是一个没有空格的句子" * 6
    texts = [f"Les.\n{chinese}\n\n \t", f"Les.\n{chinese}\n\n \t", "Les.\nhttp://x/1", f"{chinese[:30]}新{chinese[30:]}\n ", "Les"]
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, texts), near_words=line_dedup.SHORT_WORDS).collect()}
    assert [found[i].text for i in range(5)] == [texts[0], "\n \t", "http://x/1", " ", "Les"]
    assert (list(found[1].exact_lines), list(found[3].near_lines)) == ([0, 1], [0])


@pytest.mark.parametrize("piece", [3, 512])
def test_close_strings_against_distances(spark, piece):
    rng = random.Random(piece)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        pairs.append((a, "".join(b)))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in frame.select(line_dedup.close_strings(F.col("a"), F.col("b"), piece)).collect()]
    assert got == [distance(a, b) <= 1 for a, b in pairs]


def test_long_lines(spark):
    """Lines of 2,000 and of 100,000 characters, one edit apart at any place, or two."""
    rng = random.Random(4)
    lines = []
    for k, length in enumerate([2000] * 4 + [2003, 100_000]):
        line = "".join(rng.choice("abcdefghij") for _ in range(length))
        at = [0, length // 4, length // 2, length - 1, rng.randrange(length)][k % 5]
        for other in (line[:at] + "X" + line[at + 1 :], line[:at] + "Y" + line[at:], line[:at] + line[at + 1 :]):
            lines.append([line, other, True])
        lines.append([line, "Z" + line[1 : length // 3] + "Z" + line[length // 3 + 1 :], False])
    rows, expected = [], set()
    for n, (line, other, near) in enumerate(lines):
        mark = f"{n:05d}" * 8  # keeps the pairs apart
        rows += [(2 * n, mark + line), (2 * n + 1, mark + other)]
        if near:
            expected.add(2 * n + 1)
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "near_lines").collect()
    assert {r.doc_id for r in found if r.near_lines} == expected


def test_words_are_runs_between_white_space(spark):
    lines = ["", " ", "\t", "a  b", " a\tb c ", "x\x0by\r", "é ü 漢 ", "a b c", "one"]
    found = spark.createDataFrame([(line,) for line in lines], "line string").select("line", line_dedup._words(F.col("line")).alias("words")).collect()
    assert {r.line: r.words for r in found} == {line: re.findall(r"[^\x20\x09-\x0D]+", line) for line in lines}
