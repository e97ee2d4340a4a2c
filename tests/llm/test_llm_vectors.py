"""SimHash, vector codes and phrase mining, against plain loops."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_cases import docs_of, edge_rows, edges, nothing, prose
from pyspark.sql import functions as F

from trafficlens.llm import collocations, simhash, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- simhash

def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(SMALL))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def simhash_texts():
    rng = random.Random(5)
    texts = [r[1] for r in edge_rows()] + ["Two words", "two\tWORDS", "É é", "a b c", "A  b\nC"]
    for group in range(15):
        base = prose(group, 150).split()
        for _ in range(rng.choice([1, 3, 12])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(99)}"
            texts.append(rng.choice([" ", "  ", "\n"]).join(own))
    return texts


@pytest.mark.parametrize("entry,block", [(4096, 1 << 16), (1, 2)])
def test_simhash_against_all_pairs(spark, entry, block):
    texts = simhash_texts()
    found = sorted(simhash.near_duplicates(docs_of(spark, texts), entry=entry, block=block).collect(), key=lambda r: r.doc_id)
    fps = [plain_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in found] == [f"{x:016x}" for x in fps]
    assert [r.component_id for r in found] == plain_components(fps)
    assert len({r.component_id for r in found}) < len(set(fps))


@pytest.mark.parametrize("entry,block,buffer,matrix", [(4096, 1 << 16, 1 << 16, 1 << 21), (3, 5, 7, 64), (20, 1 << 16, 50, 300)])
def test_simhash_components_of_dense_groups(spark, entry, block, buffer, matrix, monkeypatch):
    """Many fingerprints share a half, links lead through long chains, and some differ in 4 bits only."""
    monkeypatch.setattr(simhash, "BUFFER", buffer)
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    rng = random.Random(buffer)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(50):
            x = center
            for b in rng.sample(range(rng.choice([20, 32, 64])), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    chain = rng.getrandbits(64)
    for _ in range(30):
        fps.add(chain)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
            chain ^= 1 << b
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    got = {r.fp: r.component for r in simhash.components(frame, entry=entry, block=block).collect()}
    roots = plain_components(fps)
    groups = defaultdict(list)
    for x, r in zip(fps, roots):
        groups[r].append(signed(x))
    expected = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == expected and len(expected) > 200


def test_simhash_edge_cases(spark):
    found = simhash.near_duplicates(edges(spark)).collect()
    assert len(found) == len(edge_rows())
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    blank = [k for k, t in ((r[0], r[1]) for r in edge_rows()) if k is not None and not WORD.search(t or "")]
    assert all(by_id[k].fingerprint == "0" * 16 and by_id[k].component_id == 0 for k in blank)
    assert by_id[5].component_id == 4 and len([r for r in found if r.doc_id == 4]) == 2
    assert all(r.component_id is not None for r in found if r.doc_id is None and r.fingerprint == "0" * 16)
    alone = spark.createDataFrame([(None, prose(1, 30))], "doc_id bigint, text string")
    assert simhash.near_duplicates(alone).first().component_id is None
    assert simhash.near_duplicates(nothing(spark)).count() == 0


# ---- vector codes

def plain_codes(rows, entries=64, parts=16, rounds=2):
    """rows: (id, vector, label) without unusable ones."""
    whole = [[max(-(1 << 27), min(1 << 27, math.floor(256 * float(x)))) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(w[p * width : (p + 1) * width]) for p in range(parts)] for w in whole]
    first = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: (rows[k][0], rows[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [tuple(sum(c) // len(own[k]) for c in zip(*own[k])) if k in own else e for k, e in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    totals = Counter()
    for (_, _, label), f in zip(rows, found):
        totals[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), totals[label], digest) for (i, _, label), f in zip(rows, found)), key=repr)


def vectors(n, length, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 1, (6, length))
    return [(int(i), [float(x) for x in np.float32(centers[i % 6] + rng.normal(0, spread, length))], [None, 1, 2, 3][i % 4]) for i in rng.permutation(n)]


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("n,length,cells", [(300, 32, 1 << 15), (300, 32, 5), (20, 16, 1 << 15), (150, 48, 1 << 15)])
def test_vector_codes_against_plain_loops(spark, n, length, cells, monkeypatch):
    monkeypatch.setattr(vector_codes.Grid.__init__, "__defaults__", (cells,))
    rows = vectors(n, length, n + length)
    found = vector_codes.vector_codes(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_codes(rows)


def test_few_entries_are_measured_and_none_is_missed():
    rng = np.random.default_rng(4)
    entries = rng.integers(-400, 400, (64, 4))
    points = np.concatenate((rng.integers(-500, 500, (3000, 4)), entries, np.repeat(entries[:5], 3, 0)))
    grid = vector_codes.Grid(np.concatenate((entries, entries[:7])), most=500)
    for _ in range(2):
        code, distance = grid.nearest(points)
        every = ((points[:, None] - grid.entries) ** 2).sum(2)
        assert (code == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert grid.bits > 4 and len(grid.kept) == len(grid.known) == 500
    assert grid.measured < 0.4 * 2 * every.size


def test_vector_codes_edge_cases(spark):
    rows = vectors(40, 16, 1)
    odd = [(100, None, 1), (101, [0.0] * 15 + [None], 1), (102, [float("nan")] * 16, None), (103, [float("inf")] * 16, 2), (104, [1.0] * 15, 1), (105, [], None)]
    more = [(None, [0.5] * 16, 1), (3, [0.1] * 16, None), (3, [0.1] * 16, None), (None, [3e38] + [-3e38] * 15, 2)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows + odd + more], VECTORS + ", id string, error double")
    found = sorted((tuple(r) for r in vector_codes.vector_codes(frame).collect()), key=repr)
    expected = plain_codes(rows + more)
    uncut = {r[0]: r for r in found if r[0] in (104, 105)}
    assert [r for r in found if r[0] not in (104, 105)] == expected
    assert all(r[1] is None and r[2] is None for r in uncut.values()) and len(uncut) == 2
    assert vector_codes.vector_codes(frame.limit(0)).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.vector_codes(frame.where("vec_id = 104")).collect()] == [(104, None, None, None)]
    assert [r.code for r in vector_codes.vector_codes(frame.where("vec_id is null")).collect()] == [None, None]


# ---- phrases

def plain_collocations(rows, least, longest=5, top=2000):
    """rows: (text, lang)."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    wanted = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, words), a in wanted.items():
        within = lambda big: any(big[i : i + len(words)] == words for i in range(len(big) - len(words) + 1))
        if any(g == lang and len(big) > len(words) and b >= a and within(big) for (g, big), b in wanted.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


def phrase_rows():
    rng = random.Random(3)
    rows = [(r[1], lang) for r in edge_rows() for lang in ("en", None)]
    for i in range(260):
        words = [rng.choice(["The", "the", "cat", "sat", "mat", "é", "日本", "ß", "on", "ON", "x\x00"]) for _ in range(rng.randrange(1, 90))]
        rows.append(("".join(w + rng.choice([" "] * 9 + ["\t", "  ", ". ", ",", "\n", "! ", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None])))
    rows += [("New York City has many streets, new york city", "en")] * 40 + [("a" * 4000, "en"), ("to be or not to be " * 60, "en")]
    return rows


@pytest.mark.parametrize("least,top,bits,chunk", [(30, 2000, 64, 1 << 21), (12, 25, 64, 300), (30, 2000, 9, 1 << 21)])
def test_collocations_against_plain_loops(spark, least, top, bits, chunk, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = phrase_rows()
    frame = spark.createDataFrame([(None if k % 50 == 7 else k // 2, t, g) for k, (t, g) in enumerate(rows)], "doc_id bigint, text string, lang string").repartition(5)
    found = collocations.collocations(frame, least=least, top=top, fingerprint_bits=bits)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, least, top=top)


def test_products_beyond_64_bits(spark):
    big = 10**12
    phrases = spark.createDataFrame([("en", 2, "a b", 7 * big - 1), ("en", 1, "a", 7 * big), ("en", 1, "b", 11 * big + 3)], "lang string, words int, phrase string, a bigint")
    row = collocations.scored(phrases, spark.createDataFrame([("en", 3 * 10**13 + 1)], "lang string, total bigint")).first()
    assert row.score == 1000 * (7 * big - 1) * (3 * 10**13 + 1) // (7 * big * (11 * big + 3))


def test_collocations_edge_cases(spark):
    assert collocations.collocations(nothing(spark)).count() == 0
    assert collocations.collocations(edges(spark)).where(F.col("a") < 100).count() == 0
    rows = [(r[1], r[2]) for r in edge_rows()]
    found = collocations.collocations(edges(spark), least=3)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 3)
