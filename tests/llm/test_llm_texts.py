"""Repetition rules, packing, near duplicates, fingerprints, mixing."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_of, edge_rows, edges, nothing, prose
from pyspark.sql import functions as F

from trafficlens.llm import fingerprints, mixing, neighbours, ngram_join, packing, quality_rules
from trafficlens.llm.arrays import texts_of
from trafficlens.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- repetition rules

def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i : i + 5])].append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_coverage(text, n):
    words = WORD.findall(text or "")
    seen, covered = set(), set()
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in seen:
            covered.update(range(i, i + n))
        seen.add(tuple(words[i : i + n]))
    return sum(len(words[i]) for i in covered) / max(sum(map(len, words)), 1)


def rule_texts():
    rng = random.Random(9)
    texts = [r[1] for r in edge_rows()]
    for _ in range(150):
        words = [rng.choice(["a", "é", "bb", "c#", "<d>", "日本"]) for _ in range(rng.randrange(60))]
        texts.append("".join(w + rng.choice([" ", " ", "\n", "\t\t", "\n\n", "\x0b", " ", "\x1c"]) for w in words))
    return texts


def test_repetition_rules_against_plain_loops(spark):
    texts = rule_texts()
    found = sorted(quality_rules.repetition_rules(docs_of(spark, texts)).collect(), key=lambda r: r.doc_id)
    for text, r in zip(texts, found):
        expected = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        failed = expected[0] < 10 or 100 * expected[4] > 20 * expected[0]
        coverages = {n: plain_coverage(text, n) for n in quality_rules.NGRAM_LIMITS}
        for n, c in coverages.items():
            assert r[f"coverage_{n}"] == pytest.approx(c)
        assert r.base_failed == failed
        beyond = any(c > quality_rules.NGRAM_LIMITS[n] for n, c in coverages.items()) or r.coverage_lines > quality_rules.LINE_LIMIT
        assert r.kept == (not failed and not beyond)


def test_repetition_rules_edge_cases(spark):
    found = quality_rules.repetition_rules(edges(spark)).collect()
    assert [r.doc_id for r in found] == [r[0] for r in edge_rows()]
    assert quality_rules.repetition_rules(nothing(spark)).count() == 0


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_slices_do_not_show(limit):
    column = pa.array(rule_texts())
    got = [tuple(int(m[k][i]) for k in quality_rules.COUNTS) for t in texts_of(column.slice(3), limit) for m in [quality_rules.measure(t)] for i in range(len(t))]
    assert got == [plain_counts(x.as_py()) for x in column.slice(3)]


# ---- packing

@pytest.mark.parametrize("dimensions,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_goes_from_cell_to_cell(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    index = packing.hilbert_index(cells, bits)
    assert sorted(index) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def vocabulary():
    tokens = pytest.importorskip("public_tokenizers")
    return tokens.path("byte_bpe_50k.tiktoken"), tokens.path("byte_bpe_50k.json")


def check_packed(rows, texts, vocabulary, copies=None):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary[1])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for key, text in texts.items():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        count = Counter()
        for r in by_doc[key]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            count.update(range(r.start, r.start + r.length))
        assert set(count) == set(range(len(ids))) and set(count.values()) == {(copies or {}).get(key, 1)}
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_round_trip(spark, vocabulary):
    texts = [prose(i, 5 + 37 * i % 400) for i in range(120)] + [None, "", " ", "a<|endoftext|>b", "日本語 🙂", prose(5, 4000)] + [prose(1, 50)] * 60
    found = packing.pack(docs_of(spark, texts), *vocabulary).collect()
    check_packed(found, dict(enumerate(texts)), vocabulary)
    assert len({r.sequence_id for r in found}) < 80


def test_packing_edge_cases(spark, vocabulary):
    rows = [r for r in edge_rows() if r[0] is not None]
    found = packing.pack(edges(spark).where("doc_id is not null"), *vocabulary).collect()
    check_packed(found, {r[0]: r[1] for r in rows}, vocabulary, copies={4: 2})
    assert packing.pack(edges(spark), *vocabulary).where("doc_id is null").agg(F.sum("length") - F.sum("doc_tokens")).first()[0] is not None
    assert packing.pack(nothing(spark), *vocabulary).count() == 0


def test_copies_are_packed_apart(spark, vocabulary):
    """Rows with one id are never twice in a sequence, and each copy is whole."""
    texts = [prose(i, 20 + i % 90) for i in range(60)]
    rows = [(i, texts[i]) for i in range(60) for _ in range(1 + i % 4)] + [(None, "x")] * 5
    found = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), *vocabulary).collect()
    starts = Counter((r.sequence_id, r.doc_id) for r in found if r.start == 0 and r.doc_id is not None)
    assert max(starts.values()) == 1 and sum(starts.values()) == len(rows) - 5
    tokens = Counter()
    for r in found:
        tokens[r.doc_id] += r.length
    assert all(tokens[i] % (1 + i % 4) == 0 for i in range(60))
    by_sequence = Counter()
    for r in found:
        by_sequence[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in by_sequence.values())


def test_tasks_share_the_curve_by_key_and_id():
    rng = np.random.default_rng(1)
    key, order = rng.integers(0, 9, 500), rng.integers(-5, 5, 500)
    at = np.lexsort((order, key))[::37]
    got = packing.part_of(key, order, (key[at], order[at]))
    assert list(got) == [sum((key[b], order[b]) <= (k, o) for b in at) for k, o in zip(key, order)]


def test_similar_documents_are_neighbours_on_the_curve():
    a, b = prose(1, 300), prose(2, 300)
    near = a.replace("the", "or", 2)
    keys = packing.curve_keys(pa.array([a, near, b, a])).to_pylist()
    assert keys[0] == keys[3] and abs(keys[0] - keys[1]) < abs(keys[0] - keys[2])


# ---- near duplicates

def shingle_set(text):
    words = WORD.findall(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k] or k, k)
    rep = {k: first[s or k] for k, s in sets.items()}
    reps = sorted(set(rep.values()))
    links, parent = Counter(), {k: k for k in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(reps):
        for b in reps[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    size = Counter(rep.values())
    return {k: (rep[k], size[rep[k]], links[rep[k]], find(rep[k])) for k in sets}


def near_texts():
    rng = random.Random(8)
    texts = []
    for group in range(12):
        base = prose(group, 120).split()
        for _ in range(rng.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(99)}"
            texts.append(" ".join(own))
    texts += [prose(50, 3)] * 4 + [None, "", "  ", prose(60, 3000), prose(60, 3000) + " end"]
    rng.shuffle(texts)
    return texts


def hanging_texts():
    """A chain whose ends are not alike, and two stars that hang together by one member each."""
    def changed(words, places, mark):
        own = list(words)
        for p in places:
            own[p] = f"{mark}{p}"
        return own

    base = prose(71, 200).split()
    texts, step = [base], list(base)
    for k in range(8):
        step = changed(step, range(10 + 20 * k, 14 + 20 * k), "c")
        texts.append(step)
    star = prose(72, 200).split()
    one = changed(star, (20, 60, 100), "m")
    two = changed(one, (140, 180, 10), "m")
    other = changed(two, (30, 75, 120), "m")
    texts += [star, one, two, other]
    texts += [changed(star, (k,), "s") for k in range(40, 60, 2)] + [changed(other, (k,), "o") for k in range(40, 60, 2)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("block,leaders", [(4, 0), (4, 2), (256, 4)])
def test_near_duplicates_against_all_pairs(spark, block, leaders):
    texts = near_texts() + hanging_texts()
    random.Random(block).shuffle(texts)
    found = ngram_join.near_duplicates(docs_of(spark, texts), block=block, leaders=leaders).collect()
    expected = plain_groups(list(enumerate(texts)))
    assert {r.doc_id: (r.class_id, r.n_copies, r.group_id) for r in found} == {k: (c, n, g) for k, (c, n, _, g) in expected.items()}
    links = {r.doc_id: (r.n_links, expected[r.doc_id][2]) for r in found}
    assert all(n <= most and (n > 0) == (most > 0) for n, most in links.values())
    if not leaders:
        # Everything goes through the cells, which count every link between components.
        assert all(n == most for n, most in links.values())
    assert max(n for n, _ in links.values()) > 8


def test_near_duplicates_count_every_link(spark):
    """All links of a text count, those inside a group that needs none of them, too; bands lose none."""
    base = prose(91, 120).split()
    texts = [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in range(0, 120, 4)] + near_texts()
    expected = plain_groups(list(enumerate(texts)))
    for recall in (ngram_join.RECALL, 0.01):
        found = ngram_join.near_duplicates(docs_of(spark, texts), block=8, recall=recall).collect()
        assert {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in found} == expected


def test_a_group_takes_a_pair_a_text(spark):
    """Near copies of one text meet their leader once each; next to nothing is left for the cells."""
    base = prose(90, 150).split()
    texts = []
    for k in range(300):
        own = list(base)
        own[k % 150] = f"w{k}"
        texts.append(" ".join(own))
    met = []
    keep = ngram_join._led

    def led(pairs, *rest):
        met.append(pairs.count())
        return keep(pairs, *rest)

    ngram_join._led = led
    try:
        found = ngram_join.near_duplicates(docs_of(spark, texts), block=16).collect()
    finally:
        ngram_join._led = keep
    assert {r.group_id for r in found} == {0}
    assert sum(met) < 6 * len(texts)


def test_a_pair_is_verified_in_one_cell(spark, monkeypatch):
    """Texts that share many n-grams and still are no near copies: their sets travel once, not for each n-gram."""
    texts = []
    for k in range(12):
        words = prose(300 + k, 200).split()
        # 5 words apart change 25 n-grams of 196: as near as 171 / 221.
        texts += [" ".join(words), " ".join(f"w{p}" if p % 40 == 20 else w for p, w in enumerate(words))]
    rows, keep = {}, ngram_join.written

    def written(df, name):
        rows.setdefault(name, []).append(found := keep(df, name))
        return found

    monkeypatch.setattr(ngram_join, "written", written)
    # As in a large table, whose sample tells nothing of n-grams that two texts have.
    monkeypatch.setattr(ngram_join, "common_grams", lambda texts, n: (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    found = ngram_join.near_duplicates(docs_of(spark, texts), leaders=0).collect()
    assert {r.doc_id: (r.class_id, r.n_copies, r.n_links, r.group_id) for r in found} == plain_groups(list(enumerate(texts)))
    left = rows["ngram-left"][0]
    assert left.select("id").distinct().count() == left.count() > 2


def test_texts_of_other_sizes_leave_a_bucket(spark, monkeypatch):
    """A shared n-gram alone brings no texts together whose sizes rule out that they are near."""
    passage = "one passage that all of these texts share"
    texts = [passage + " " + prose(400 + k, 30 * 2**k) for k in range(5)]
    shared, keep = [], ngram_join.written

    def written(df, name):
        found = keep(df, name)
        if name == "ngram-shared":
            shared.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "written", written)
    monkeypatch.setattr(ngram_join, "common_grams", lambda texts, n: (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    found = ngram_join.near_duplicates(docs_of(spark, texts)).collect()
    assert all(r.group_id == r.doc_id and r.n_links == 0 for r in found)
    assert shared == [0]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_near_sets_meet_at_the_first_gram_they_share(threshold):
    rng = np.random.default_rng(4)
    pool = ngram_join.mix(np.arange(1, 400, dtype=np.uint64))
    common = np.sort(pool[:60]), rng.integers(2, 256, 60).astype(np.uint64)
    sets = []
    for size in (1, 2, 3, 4, 5, 9, 10, 11, 40, 41, 49, 50, 51, 200):
        base = rng.choice(pool, size, replace=False)
        for lost in sorted({0, 1, size // 10, size // 5, size // 2}):
            added = rng.choice(pool, rng.integers(0, 1 + size // 5), replace=False)
            sets.append(np.unique(np.concatenate((base[min(lost, size - 1) :], added))))
    codes = [{int(c) >> 24: (int(c) >> 12 & 4095, int(c) & 4095) for c in ngram_join.prefix(s, threshold, common)} for s in sets]
    near = 0
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            both = len(np.intersect1d(x, y))
            if both >= threshold * (len(x) + len(y) - both):
                near += 1
                assert any(codes[a][g][0] <= codes[b][g][1] and codes[b][g][0] <= codes[a][g][1] for g in codes[a].keys() & codes[b].keys())
    assert near > 0


def test_verify_leader_against_sets():
    rng = np.random.default_rng(3)
    leader = np.unique(rng.integers(0, 60, 50).astype(np.uint64))
    others = [np.unique(np.concatenate((leader[rng.random(len(leader)) < 0.9], rng.integers(0, 70, rng.integers(0, 6)).astype(np.uint64)))) for _ in range(80)]
    alike = lambda s: len(set(leader) & set(s)) >= 0.8 * len(set(leader) | set(s))
    assert list(ngram_join.verify_leader(leader, others, 0.8)) == [alike(s) for s in others]


def test_near_duplicates_edge_cases(spark):
    found = ngram_join.near_duplicates(edges(spark)).collect()
    assert len(found) == len(edge_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    assert by_id[5].class_id == 4 and by_id[5].n_copies == 3 and by_id[6].group_id == 4 and by_id[6].n_links == 1
    assert all(by_id[k].group_id == k and by_id[k].n_links == 0 for k in (0, 1, 2, 3, 8, 20))
    assert all(r.class_id is None and r.n_links == 0 for r in found if r.doc_id is None)
    assert ngram_join.near_duplicates(nothing(spark)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MAX_HASHES


def test_shared_counts_against_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 500, rng.integers(0, 300)).astype(np.uint64)) for _ in range(20)]
    expected = [[len(set(a) & set(b)) if len(set(a)) and len(set(b)) else 0 for b in sets] for a in sets]
    got = ngram_join.shared_counts(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == expected[i][j]


def test_components_against_union_find(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 360)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- fingerprints

def hashes_of(spark, texts):
    """XXH64 of strings and of pairs of numbers, as Spark gives it."""
    grams = sorted({t[i : i + fingerprints.S] for t in texts for i in range(len(t) - fingerprints.S + 1)})
    one = {r.g: r.h for r in spark.createDataFrame([(g,) for g in grams] or [("",)], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    last = fingerprints.K - fingerprints.S
    pairs = sorted({(one[t[i : i + fingerprints.S]], one[t[i + last : i + fingerprints.K]]) for t in texts for i in range(len(t) - fingerprints.K + 1)})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs or [(0, 0)], "a bigint, b bigint").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    whole = {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64(F.lit(fingerprints.K), F.col("t")).alias("h")).collect()}
    return one, two, whole


def plain_anchors(text, one, two):
    k, s = fingerprints.K, fingerprints.S
    mers = [one[text[i : i + s]] for i in range(len(text) - s + 1)]
    found = []
    for i in range(len(text) - k + 1):
        inside = mers[i : i + k - s + 1]
        if min(inside[0], inside[-1]) == min(inside):
            found.append((i, two[inside[0], inside[-1]]))
    return found


def fingerprint_texts():
    chinese = "".join(chr(0x4E00 + random.Random(i).randrange(5000)) for i in range(71))
    passage = prose(900, 60)
    long = [f"{prose(s, 900)} {passage} {prose(s + 1, 900)}" for s in (901, 903)]
    short = ["", "abc", "one two three four", "x" * 11, "x" * 12, "x" * 13, "ab" * 40, "\U0001F600" * 30 + "é" * 20, chinese, "新" + chinese]
    return [r[1] or "" for r in edge_rows() if len(r[1] or "") < 5000] + short + long + [t for t in near_texts() if t][:30]


@pytest.mark.parametrize("piece", [16, 50, 4096])
def test_anchors_against_plain_loops(spark, piece):
    texts = fingerprint_texts()
    one, two, _ = hashes_of(spark, texts)
    found = docs_of(spark, texts).select("doc_id", fingerprints.anchors(F.col("text"), piece=piece).alias("a"))
    rows = found.select("doc_id", fingerprints.places(F.col("a")).alias("at"), "a.hash").orderBy("doc_id").collect()
    for text, r in zip(texts, rows):
        assert list(zip(r["at"], r["hash"])) == plain_anchors(text, one, two)


def plain_compared(spark, docs):
    """docs: (id, text) in order; of each row what compared_with_next says but the longest run."""
    edited = []
    for k, (_, text) in enumerate(docs):
        other, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited.append(text[: len(text) - half] + other[:half])
    one, two, whole = hashes_of(spark, [t for _, t in docs] + edited)
    sets = lambda t: {h for _, h in plain_anchors(t, one, two)} or {whole[t]}
    hexed = lambda s: "".join(f"{x & (2**64 - 1):016x}" for x in sorted(s)[: fingerprints.SKETCH])
    alike = lambda a, b: len(a & b) / len(a | b)
    out = []
    for k, (key, text) in enumerate(docs):
        own, after, changed = sets(text), sets(docs[(k + 1) % len(docs)][1]), sets(edited[k])
        out.append((key, len(text), hashlib.sha256(edited[k].encode()).hexdigest(), hexed(own), hexed(changed), alike(own, changed), alike(own, after)))
    return out


def test_compared_with_next_against_plain_loops(spark):
    texts = fingerprint_texts()
    texts += [t[:n] for t in texts[-2:] for n in (12, 13, 22, 23, 24, 25, 30)]
    docs = list(enumerate(texts))
    found = sorted(fingerprints.compared_with_next(docs_of(spark, texts).repartition(3)).collect(), key=lambda r: r.doc_id)
    assert [tuple(r)[:7] for r in found] == plain_compared(spark, docs)
    for k, r in enumerate(found):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        assert (r.longest_match is None) == (r.near_next == 0 or min(len(text), len(after)) < fingerprints.K)
        if r.longest_match is not None:
            assert text[r.match_at : r.match_at + r.longest_match] == after[r.match_next_at : r.match_next_at + r.longest_match]
            assert r.longest_match >= fingerprints.K


def test_the_shared_passage_of_long_texts_is_found(spark):
    passage = prose(900, 60)
    one, two = (f"{prose(s, 2500)} {passage} {prose(s + 1, 2500)}" for s in (901, 903))
    r = fingerprints.compared_with_next(docs_of(spark, [one, two])).orderBy("doc_id").first()
    assert r.longest_match >= len(passage) - 2 * (fingerprints.K - fingerprints.S)
    assert abs(r.match_at - one.index(passage)) <= 10 and 0 < r.near_next < 0.1 and r.near_edited > 0.3
    runs = docs_of(spark, ["0123456789 abcdefghijklmnopqrstuvwxyz " * 1 + prose(1, 50) + " the end of it all is here", "so " + prose(1, 50) + " 0123456789 abcdefghijklmnopqrstuvwxyz"])
    made = fingerprints.with_next(runs.withColumn("anchors", fingerprints.anchors(F.col("text"))), "doc_id", F.xxhash64("text"), ["anchors"])
    found = made.select(fingerprints.shared_runs(F.col("anchors"), F.col("next_anchors")).alias("r")).first().r
    assert len(found) >= 2 and max(x["length"] for x in found) > 100


def test_compared_with_next_edge_cases(spark):
    rows = sorted(((r[0], r[1] or "") for r in edge_rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    found = fingerprints.compared_with_next(edges(spark)).collect()
    assert len(found) == len(rows) and Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    by_text = {}
    for r in found:
        for text in {t for k, t in rows if k == r.doc_id}:
            if r.doc_id is not None:
                assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and r.n_chars == len(text)
    assert fingerprints.compared_with_next(nothing(spark)).count() == 0
    alone = fingerprints.compared_with_next(docs_of(spark, [prose(1, 30)])).first()
    assert alone.near_next == 1 and alone.longest_match > 50 and alone.match_at == alone.match_next_at


def test_anchors_are_made_once_a_row(spark):
    plan = fingerprints.compared_with_next(docs_of(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("regexp_extract_all") <= 8


@pytest.mark.parametrize("ids", [range(50), [10**18, -5, 3, 7, 8, 2**62, -(2**63) + 1], [1], [*range(0, 4000, 7), *range(10**9, 10**9 + 300)]])
def test_next_row(spark, ids, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 1)
    ids = list(ids)
    rng = random.Random(1)
    rng.shuffle(ids)
    frame = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.next_text for r in neighbours.with_next(frame, "doc_id", F.xxhash64("text"), ["text"]).collect()}
    order = sorted(ids)
    assert found == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_next_row_edge_cases(spark):
    frame = spark.createDataFrame([(None, "n"), (2, "b"), (2, "b"), (1, "a")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.next_text) for r in neighbours.with_next(frame, "doc_id", F.xxhash64("text"), ["text"]).collect())
    assert got == [(0, "a"), (1, "b"), (2, "b"), (2, "n")]
    assert neighbours.with_next(frame.limit(0), "doc_id", F.xxhash64("text"), ["text"]).count() == 0


# ---- mixing

def sources(spark):
    rng = random.Random(2)
    texts, source = [], []
    for s, n in (("big", 900), ("mid", 300), ("low", 120), ("few", 40)):
        for _ in range(n):
            texts.append(prose(len(texts), rng.randrange(5, 30)))
            source.append(s)
    return texts, source, docs_of(spark, texts, source)


def mixed(texts, source, rows):
    have, got, passes = Counter(), Counter(), defaultdict(set)
    for t, s in zip(texts, source):
        have[s] += len(t.split())
    for r in rows:
        assert r.n_tokens == len(texts[r.doc_id].split()) and r.source == source[r.doc_id]
        assert r.pass_no not in passes[r.doc_id]
        passes[r.doc_id].add(r.pass_no)
        got[r.source] += r.n_tokens
    assert all(p == set(range(len(p))) for p in passes.values())
    total = sum(got.values())
    entropy = -sum(x / total * math.log(x / total) for x in got.values()) / math.log(len(have))
    return have, got, passes, entropy


def test_mix_meets_the_repetition_limit(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 20)
    texts, source, docs = sources(spark)
    rows = mixing.mix(docs, max_repeats=2.5).collect()
    have, got, passes, _ = mixed(texts, source, rows)
    assert set(passes) == set(range(len(texts)))
    repeats = {s: got[s] / have[s] for s in have}
    assert repeats["big"] == 1 and max(repeats.values()) <= 2.5 and repeats["few"] > 2.4
    # Weights go with a power of the shares.
    power = [math.log(repeats[s]) / math.log(have[s] / have["big"]) for s in ("mid", "low", "few")]
    assert max(power) - min(power) < 0.05
    # Each tenth of the mix has nearly the same shares.
    for tenth in range(10):
        part = Counter()
        for r in rows:
            if int(r.mix_at * 10) == tenth:
                part[r.source] += r.n_tokens
        assert abs(part["big"] / sum(part.values()) - got["big"] / sum(got.values())) < 0.08


def test_mix_meets_the_entropy(spark):
    texts, source, docs = sources(spark)
    plain = mixed(texts, source, mixing.mix(docs, max_repeats=None).collect())
    assert all(plain[1][s] == plain[0][s] for s in plain[0])
    assert mixed(texts, source, mixing.mix(docs, target_entropy=0.95, max_repeats=None).collect())[3] == pytest.approx(0.95, abs=0.01)
    small = mixing.mix(docs, budget_tokens=3000).collect()
    assert 2600 < sum(r.n_tokens for r in small) <= 3000


def test_mix_edge_cases(spark):
    rows = mixing.mix(edges(spark)).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in edge_rows()}
    copies = mixing.mixed_documents(edges(spark))
    assert copies.columns == edges(spark).columns
    count = Counter((r.doc_id, r.text) for r in copies.collect())
    assert set(count) == {(r[0], r[1]) for r in edge_rows()}
    assert count[(4, edge_rows()[4][1])] % 2 == 0
    assert mixing.mix(nothing(spark)).count() == 0 and mixing.mixed_documents(nothing(spark)).count() == 0
    blank = docs_of(spark, [None, "", " "])
    assert mixing.mix(blank).count() == 3
