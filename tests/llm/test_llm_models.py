"""The two classifiers and the tagger of personal data."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_of, edge_rows, edges, nothing, prose

from trafficlens.llm import pii, quality_classifier, toxicity

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(spark):
    """600 texts: every third is junk, every fourth of the others holds a bad word."""
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(600):
        own = prose(i, rng.randrange(30, 90))
        junk, bad = i % 3 == 0, i % 3 and i % 4 == 1
        if junk:
            own = " | ".join(own.split()) if i % 2 else own.upper().replace(" ", "!! ")
        if bad:
            own = own.replace(" ", " " + rng.choice(["scoundrel", "rascals", "villainous"]) + " ", 1)
        texts.append(own)
        labels.append((i, int(not junk), int(bool(bad)), "clash"))
    return docs_of(spark, texts), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = corpus(spark)
    found = module.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(found) > 80
    assert sum(r.predicted == r[label] for r in found) / len(found) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


@pytest.mark.parametrize("module,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_labels_of_held_out_rows_are_not_used(spark, module, label):
    docs, labels = corpus(spark)
    modulus, rest = (3, 1) if module is quality_classifier else (5, 0)
    turned = labels.selectExpr("doc_id", f"if(crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {rest}, 1 - {label}, {label}) as {label}")
    scores = lambda with_: {r.doc_id: r.score for r in module.classify(docs, with_).collect()}
    assert scores(labels) == scores(turned)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_edge_cases(spark, module):
    docs, labels = corpus(spark)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1, None), (5, None, None, None), (99_999, 1, 1, None), (7, 1, 0, None)], LABELS))
    model = module.train(docs, odd)
    found = module.score(edges(spark), model).collect()
    assert len(found) == len(edge_rows()) and all(0 <= r.score <= 1 for r in found)
    by_text = {}
    for row, r in zip(edge_rows(), found):
        assert row[0] == r.doc_id
        assert by_text.setdefault(row[1] or "", r.score) == r.score
    assert module.score(nothing(spark), model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1 and toxic = 1"), labels.where("doc_id = 1")):
        assert all(0 <= r.score <= 1 for r in module.classify(docs, few).limit(20).collect())


def test_accept_keeps_rows_as_they_are(spark):
    docs, labels = corpus(spark)
    model = quality_classifier.train(docs, labels)
    kept = quality_classifier.accept(edges(spark), model)
    assert kept.schema.simpleString() == edges(spark).schema.simpleString()
    good = {r.doc_id for r in quality_classifier.score(docs, model).where("score >= 0.5").collect()}
    assert {r.doc_id for r in quality_classifier.accept(docs, model).collect()} == good


def test_neighbours_against_plain_cosines():
    rng = np.random.default_rng(1)
    counts = rng.random((80, quality_classifier.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 80).astype(float)
    space = quality_classifier.fit(counts, labels, rank=20)
    scores = space.score(counts[:10])
    for row, score in zip(space.project(counts[:10]), scores):
        cosines = space.vectors @ row
        near = np.argsort(-cosines)[: quality_classifier.NEIGHBOURS]
        votes = np.exp(quality_classifier.SHARPNESS * cosines[near])
        assert score == pytest.approx((votes * labels[near]).sum() / votes.sum(), rel=1e-4)


def test_counterfactuals_reduce_false_alarms():
    """Group names occur mostly in toxic training texts; a neutral mention must not be scored as toxic."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        text = prose(i, 20)
        toxic = i % 2
        if toxic:
            text += " scoundrel" if rng.random() < 0.7 else " rascal"
        if rng.random() < (0.8 if toxic else 0.02):
            text = "muslims " + text
        rows.append((toxic, text))
    of = lambda text: toxicity.features(next(toxicity.texts_of(pa.array([text]))))[1]
    made = [(t, of(x)) for t, x in rows]
    pairs = [(of(x), of(y)) for _, x in rows for y in toxicity.counterfactuals(x)]
    assert toxicity.counterfactuals("The Muslims and men")[0] == "The christians and girls"
    chosen = np.unique(np.concatenate([f for _, f in made]))
    chosen = np.union1d(chosen, toxicity.word_features(["muslims", "christians", "jews"]))

    def score(model, text):
        return 1 / (1 + np.exp(-(model.bias + model.table()[of(text)].sum())))

    plain, fair = toxicity.fit(made, [], chosen), toxicity.fit(made, pairs, chosen, penalty=20.0)
    neutral = [f"muslims {prose(9000 + i, 20)}" for i in range(60)]
    bad = [f"{prose(8000 + i, 20)} scoundrel" for i in range(60)]
    alarms = lambda model, texts: sum(score(model, t) >= 0.5 for t in texts)
    assert alarms(fair, neutral) < 0.5 * alarms(plain, neutral)
    assert alarms(fair, bad) > 50


# ---- personal data

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {0: True, 1: kind != 1 or all(int(p) <= 255 for p in m[0].split(".")),
                    2: 13 <= len(digits) <= 19 and pii.luhn(digits), 3: 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890..@@+- (),Z%_\né") for _ in range(rng.randrange(70)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("9" * 200_000 + "@" + "a" * 200_000) == []


def test_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.Tagger.new(1)
    for k, v in vars(tagger).items():
        setattr(tagger, k, v.astype(np.float64))
    codes, tags = rng.integers(1, 40, (3, 12)), rng.integers(0, pii.TAGS, (3, 12))
    _, slopes = tagger.gradients(codes, tags)
    for k, v in vars(tagger).items():
        at = np.unravel_index(np.abs(slopes[k]).argmax(), v.shape)
        old, step = v[at], 1e-3
        v[at] = old + step
        up = tagger.gradients(codes, tags)[0]
        v[at] = old - step
        down = tagger.gradients(codes, tags)[0]
        v[at] = old
        assert (up - down) / (2 * step) == pytest.approx(slopes[k][at], rel=1e-2, abs=1e-3)


def test_decode_is_the_best_path():
    rng = np.random.default_rng(3)
    tagger = pii.Tagger.new(2)
    tagger.move = rng.standard_normal(tagger.move.shape).astype(np.float32)
    codes = rng.integers(1, 40, (2, 4))
    scores = tagger.emissions(tagger.states(codes, False)[1])
    total = lambda w, path: tagger.first[path[0]] + sum(scores[t, w, p] for t, p in enumerate(path)) + sum(tagger.move[a, b] for a, b in zip(path, path[1:]))
    import itertools
    for w, got in enumerate(tagger.decode(codes)):
        best = max(itertools.product(range(pii.TAGS), repeat=4), key=lambda p: total(w, p))
        assert total(w, tuple(got)) == pytest.approx(total(w, best), abs=1e-4)


def test_tagger_finds_other_spellings_and_keeps_base(spark):
    rng = random.Random(4)
    kinds = [lambda: f"{rng.choice('abcdef')}{rng.randrange(10**6)}@mail{rng.randrange(9)}.example.com", lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
             lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"]
    texts = []
    for i in range(400):
        own = prose(i, 30).split()
        own.insert(rng.randrange(30), rng.choice(kinds)())
        texts.append(" ".join(own))
    docs = docs_of(spark, [*texts, f"{prose(1, 20)} 1 (345) 555-1234 {prose(2, 20)}", prose(3, 50) + " in 1999 or 42"])
    tagger = pii.train(docs)
    found = {r.doc_id: r for r in pii.find(docs, tagger).collect()}
    for i, text in enumerate(texts):
        base = pii.written_out(pii.base_spans(text))
        assert set(base.split(",")) <= set(found[i].spans.split(","))
    assert found[400].n_phone == 0 and found[400].spans.startswith("phone:")
    assert found[401].spans == ""
    edge = pii.find(edges(spark), tagger).collect()
    assert len(edge) == len(edge_rows())
    assert all(r.n_email == 0 for r in edge)
    assert pii.find(nothing(spark), pii.train(nothing(spark))).count() == 0


def test_tagger_learns_from_rare_spans(spark, monkeypatch):
    """One text in 1,000 holds a span, in the middle of a long text; the others hold other numbers."""
    texts = [f"{prose(i, 12)} {i} or {i * 7}" for i in range(4000)]
    for i in range(0, 4000, 1000):
        texts[i] = f"{'in 1999 or 42 then ' * 300} +1 (345) 555-{1000 + i} {'in 2001 or 17 then ' * 300}"
    seen = {}
    monkeypatch.setattr(pii, "fit", lambda codes, tags: seen.update(codes=codes, tags=tags))
    pii.train(docs_of(spark, texts))
    held = (seen["tags"] > 0).any(1)
    assert held.sum() >= 8 and 0 < (~held).sum() <= pii.TRAIN_WINDOWS // 3


def test_windows_are_put_together():
    """A span longer than a window's middle, and one at each end of the text, come out whole."""
    text = "a@b.cd " + "x " * 40 + "l" * 150 + "@mail.example " + "y " * 40 + "q@r.st"
    codes = pii.codes_of(text)
    number, windows = pii.windows_of(codes)
    assert windows.shape[1] == pii.WINDOW
    gold = np.zeros(len(text), np.int64)
    spans = [m.span() for m in re.finditer(r"\S*@\S*", text)]
    for s, e in spans:
        gold[s:e], gold[s] = 2, 1
    padded = np.zeros(pii.CONTEXT + len(text) + pii.WINDOW, np.int64)
    padded[pii.CONTEXT : pii.CONTEXT + len(text)] = gold
    tags = padded[number[:, None] * pii.CORE + np.arange(pii.WINDOW)]
    out = pii.added_spans(text, number, tags, [])
    assert (0, 0, 6) in out and (0, len(text) - 6, len(text)) in out
