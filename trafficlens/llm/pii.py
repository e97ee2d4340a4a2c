"""Personal data in texts: fixed patterns, and a character-level tagger that adds what they miss.

The tagger is a bidirectional LSTM with CRF transitions, trained in numpy on spans that the patterns
find in a bounded sample, also in spellings that the patterns do not know. It reads overlapping
windows: each owns its middle and sees some characters on both sides, the owned tags are laid end to
end over the text, and spans are read off the whole text. Every kind holds a digit or an @ by its
definition, so windows without either hold nothing and are not decoded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.arrays import small_batches
from trafficlens.session import written

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base kinds. Those that begin with a digit are tried only at the
# start of a run of digits, which changes no match and keeps long runs linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CARD_DIGITS = (13, 19)
PHONE_DIGITS = (9, 15)

SAMPLE_DOCS = 2000  # bound of the sample the tagger learns from
TRAIN_WINDOWS = 1500
CORE, CONTEXT = 64, 32
WINDOW = CORE + 2 * CONTEXT
EMBED, HIDDEN = 10, 20
EPOCHS, BATCH, RATE = 6, 64, 0.01
DECODE = 512  # windows decoded at once
TAGS = 1 + 2 * len(KINDS)  # outside, and begin and inside of each kind

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, leftmost and without overlap within a kind, by kind and start."""
    found: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]:
            found.append((3, *m.span()))
    return found


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# ---- characters and windows

_SYMBOLS = "@._%+-() \n,:;/=\"'[]<>"
_CODES = 5 + 26 + len(_SYMBOLS)
_TABLE = np.full(128, 1, np.int64)  # 0 pads, 1 other, 2 digit, 3 capital, 4 letters beyond ASCII
_TABLE[48:58] = 2
_TABLE[65:91] = 3
_TABLE[97:123] = 5 + np.arange(26)
for _k, _c in enumerate(_SYMBOLS):
    _TABLE[ord(_c)] = 31 + _k


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], 4)


def windows_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the windows with a digit or @ in their middle or context, and their codes."""
    trigger = np.flatnonzero((codes == 2) | (codes == _TABLE[64]))
    if not len(trigger):
        return np.zeros(0, np.int64), np.zeros((0, WINDOW), np.int64)
    near = np.concatenate(((trigger - CONTEXT) // CORE, trigger // CORE, (trigger + CONTEXT) // CORE))
    number = np.unique(np.clip(near, 0, (len(codes) - 1) // CORE))
    padded = np.zeros(CONTEXT + len(codes) + WINDOW, np.int64)
    padded[CONTEXT : CONTEXT + len(codes)] = codes
    return number, padded[number[:, None] * CORE + np.arange(WINDOW)]


# ---- the tagger

@dataclass
class Tagger:
    """Parameters: embeddings with input weights, recurrent weights, biases of both directions,
    emissions, and CRF transitions with start scores."""

    embed: np.ndarray   # codes x EMBED
    into: np.ndarray    # 2 x EMBED x 4 HIDDEN
    again: np.ndarray   # 2 x HIDDEN x 4 HIDDEN
    bias: np.ndarray    # 2 x 4 HIDDEN
    emit: np.ndarray    # 2 HIDDEN x TAGS
    emit_bias: np.ndarray
    move: np.ndarray    # TAGS x TAGS
    first: np.ndarray

    @staticmethod
    def new(seed: int = 0) -> Tagger:
        rng = np.random.default_rng(seed)
        normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        bias = np.zeros((2, 4 * HIDDEN), np.float32)
        bias[:, HIDDEN : 2 * HIDDEN] = 1  # forget gates open
        return Tagger(normal(_CODES, EMBED), normal(2, EMBED, 4 * HIDDEN), normal(2, HIDDEN, 4 * HIDDEN), bias,
                      normal(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))

    def states(self, codes: np.ndarray, keep: bool):
        """Hidden states (time, 2, window, HIDDEN), the second direction read backwards; and the
        values that the way back needs."""
        inputs = np.stack((codes.T, codes.T[::-1]), 1)  # time x 2 x window
        table = np.einsum("ce,deg->dcg", self.embed, self.into) + self.bias[:, None]
        steps, n = len(inputs), codes.shape[0]
        h = np.zeros((steps + 1, 2, n, HIDDEN), np.float32)
        c = np.zeros((steps + 1, 2, n, HIDDEN), np.float32) if keep else None
        cell = np.zeros((2, n, HIDDEN), np.float32)
        saved = np.zeros((steps, 2, n, 4 * HIDDEN), np.float32) if keep else None
        both = np.arange(2)[:, None]
        for t in range(steps):
            gates = table[both, inputs[t]] + h[t] @ self.again
            gates[..., : 3 * HIDDEN] = 1 / (1 + np.exp(-gates[..., : 3 * HIDDEN]))
            gates[..., 3 * HIDDEN :] = np.tanh(gates[..., 3 * HIDDEN :])
            i, f, o, g = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            cell = f * cell + i * g
            h[t + 1] = o * np.tanh(cell)
            if keep:
                saved[t], c[t + 1] = gates, cell
        return inputs, h, c, saved

    def emissions(self, h: np.ndarray) -> np.ndarray:
        """Time x window x TAGS."""
        seen = np.concatenate((h[1:, 0], h[1:, 1][::-1]), -1)
        return seen @ self.emit + self.emit_bias

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The best tags of each window under the CRF."""
        scores = self.emissions(self.states(codes, False)[1])
        best, back = scores[0] + self.first, []
        for t in range(1, len(scores)):
            step = best[:, :, None] + self.move
            back.append(step.argmax(1).astype(np.int8))
            best = step.max(1) + scores[t]
        tags = np.zeros(codes.shape, np.int8)
        tags[:, -1] = best.argmax(1)
        row = np.arange(len(codes))
        for t in range(len(scores) - 2, -1, -1):
            tags[:, t] = back[t][row, tags[:, t + 1]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags of each window, and its gradients."""
        inputs, h, c, saved = self.states(codes, True)
        scores = self.emissions(h)
        steps, n, _ = scores.shape

        def total(x, axis):
            top = x.max(axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)

        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + self.first
        for t in range(1, steps):
            ahead[t] = total(ahead[t - 1][:, :, None] + self.move, 1) + scores[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = total(self.move + (behind[t + 1] + scores[t + 1])[:, None, :], 2)
        log_z = total(ahead[-1], 1)
        at, row = tags.T, np.arange(n)
        gold = self.first[at[0]] + sum(scores[t, row, at[t]] for t in range(steps)) + self.move[at[:-1], at[1:]].sum(0)
        d_scores = np.exp(ahead + behind - log_z[None, :, None])
        d_move = np.zeros_like(self.move)
        for t in range(1, steps):
            pair = ahead[t - 1][:, :, None] + self.move + (scores[t] + behind[t])[:, None, :]
            d_move += np.exp(pair - log_z[:, None, None]).sum(0)
        np.add.at(d_move, (at[:-1], at[1:]), -1)
        for t in range(steps):
            d_scores[t, row, at[t]] -= 1
        d_scores /= n
        d_first = d_scores[0].sum(0)

        seen = np.concatenate((h[1:, 0], h[1:, 1][::-1]), -1)
        d_emit = np.einsum("tnh,tnk->hk", seen, d_scores)
        d_seen = d_scores @ self.emit.T
        d_h = np.stack((d_seen[..., :HIDDEN], d_seen[::-1, :, HIDDEN:]), 1)
        d_again, d_table = np.zeros_like(self.again), np.zeros((2, _CODES, 4 * HIDDEN), np.float32)
        carry, d_cell = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        both = np.arange(2)[:, None]
        for t in range(steps - 1, -1, -1):
            i, f, o, g = (saved[t][..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            squashed = np.tanh(c[t + 1])
            d_out = d_h[t] + carry
            d_cell = d_cell + d_out * o * (1 - squashed**2)
            d_gates = np.concatenate((d_cell * g * i * (1 - i), d_cell * c[t] * f * (1 - f),
                                      d_out * squashed * o * (1 - o), d_cell * i * (1 - g**2)), -1)
            d_again += h[t].transpose(0, 2, 1) @ d_gates
            np.add.at(d_table, (both, inputs[t]), d_gates)
            carry, d_cell = d_gates @ self.again.transpose(0, 2, 1), d_cell * f
        return float((log_z - gold).mean()), {
            "embed": np.einsum("dcg,deg->ce", d_table, self.into), "into": np.einsum("ce,dcg->deg", self.embed, d_table),
            "again": d_again, "bias": d_table.sum(1), "emit": d_emit, "emit_bias": d_scores.sum((0, 1)),
            "move": d_move / n, "first": d_first}


def fit(codes: np.ndarray, tags: np.ndarray, seed: int = 0) -> Tagger:
    """Train on windows with their tags, by Adam."""
    tagger, rng = Tagger.new(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in vars(tagger).items()}
    square = {k: np.zeros_like(v) for k, v in vars(tagger).items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            step += 1
            _, slopes = tagger.gradients(codes[order[at : at + BATCH]], tags[order[at : at + BATCH]])
            norm = np.sqrt(sum(float((g**2).sum()) for g in slopes.values()))
            for k, g in slopes.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g**2
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(tagger, k, (getattr(tagger, k) - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32))
    return tagger


def other_spelling(kind: int, text: str, choice: int) -> str:
    """The same kind of data in a spelling that the patterns may not know."""
    if kind == 0:
        return text.replace("@", (" @ ", "(at)@", "@")[choice % 3], 1)
    if kind == 1:
        return text.replace(".", (".", " . ", "[.]")[choice % 3])
    if kind == 2:
        digits = digits_of(text)
        return (" ", ".", "-")[choice % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    return ("00" + text[1:], text[1:], text.replace(" ", "."))[choice % 3]


def training_windows(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts and their tags, each text as it is and with its spans spelt otherwise."""
    all_codes, all_tags = [], []
    for text in texts:
        spans, last = [], -1
        for kind, start, end in sorted(base_spans(text), key=lambda s: s[1:]):
            if start >= last:
                spans.append((kind, start, end))
                last = end
        for turn in range(2 if spans else 1):
            parts, marked, at = [], [], 0
            for kind, start, end in spans:
                parts.append(text[at:start])
                new = text[start:end]
                if turn:
                    new = other_spelling(kind, new, zlib.crc32(new.encode()))
                begin = sum(map(len, parts))
                marked.append((kind, begin, begin + len(new)))
                parts.append(new)
                at = end
            whole = "".join([*parts, text[at:]])
            codes = codes_of(whole)
            tags = np.zeros(len(codes), np.int64)
            for kind, start, end in marked:
                tags[start:end] = 2 + 2 * kind
                tags[start] = 1 + 2 * kind
            number, windows = windows_of(codes)
            padded = np.zeros(CONTEXT + len(tags) + WINDOW, np.int64)
            padded[CONTEXT : CONTEXT + len(tags)] = tags
            all_codes.append(windows)
            all_tags.append(padded[number[:, None] * CORE + np.arange(WINDOW)])
    if not all_codes:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    codes, tags = np.concatenate(all_codes), np.concatenate(all_tags)
    order = balanced(tags, TRAIN_WINDOWS, seed)
    return codes[order], tags[order]


def balanced(tags: np.ndarray, most: int, seed: int = 0) -> np.ndarray:
    """Numbers of at most ``most`` windows: up to two thirds hold spans, of each kind as many as of the
    others as far as there are, and up to a third hold none."""
    order = np.random.default_rng(seed).permutation(len(tags))
    kind = (tags[order].max(1, initial=0) - 1) // 2
    rank = np.zeros(len(order), np.int64)
    for k in range(len(KINDS)):
        rank[kind == k] = np.arange((kind == k).sum())
    held = np.flatnonzero(kind >= 0)
    none = np.flatnonzero(kind < 0)[: most // 3]
    held = held[np.argsort(rank[held], kind="stable")][: most - most // 3]
    return order[np.sort(np.concatenate((held, none)))]


def plausible(kind: int, text: str) -> bool:
    """What a span of the tagger must look like to be one of its kind."""
    count = len(digits_of(text))
    if kind == 0:
        before, sign, after = text.partition("@")
        return bool(sign) and bool(re.search(r"[A-Za-z0-9]", before)) and bool(re.search(r"[A-Za-z0-9]\.[A-Za-z0-9]", after))
    if kind == 1:
        numbers = re.findall("[0-9]+", text)
        return len(numbers) == 4 and not re.search("[A-Za-z]", text) and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    low, high = CARD_DIGITS if kind == 2 else PHONE_DIGITS
    return low <= count <= high and not re.search(r"[^0-9+() .\-]", text)


def added_spans(text: str, number: np.ndarray, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of decoded windows, read off the text as a whole, that meet no base span and cut no word."""
    whole = np.zeros((number[-1] + 1) * CORE, np.int8)
    cells = (number[:, None] * CORE + np.arange(CORE)).ravel()
    whole[cells] = tags[:, CONTEXT : CONTEXT + CORE].ravel()
    whole = whole[: len(text)]
    kind = np.where(whole > 0, (whole - 1) // 2, -1)
    begins = np.flatnonzero((kind >= 0) & ((whole % 2 == 1) | (np.concatenate(([-1], kind[:-1])) != kind)))
    out = []
    taken = sorted((s, e) for _, s, e in base)
    for start in begins.tolist():
        end = start + 1
        while end < len(kind) and kind[end] == kind[start] and whole[end] % 2 == 0:
            end += 1
        part = text[start:end]
        left = start + len(part) - len(part.lstrip())
        right = left + len(part.strip())
        cuts = re.match("[A-Za-z0-9]", text[left - 1 : left]) or re.match("[A-Za-z0-9]", text[right : right + 1])
        if left < right and not cuts and plausible(int(kind[start]), text[left:right]) and not any(s < right and left < e for s, e in taken):
            out.append((int(kind[start]), left, right))
    return out


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Tagger | None:
    """Learn from the windows of at most ``sample_docs`` texts with a digit or @.

    Tasks find the base spans of all texts. Of those that hold a kind an equal share is chosen for
    each kind by hash, however rare it is, and as many that hold none. Tasks cut the windows and send
    only these, at most 32 of each text. None without any such text.
    """
    per_doc = 32
    share = max(1, sample_docs // (1 + len(KINDS)))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest hashes of each kind in a task, -1 being the kind of texts without a span."""
        found = {k: set() for k in range(-1, len(KINDS))}
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in {s[0] for s in base_spans(text)} or {-1}:
                    found[k].add(h)
            found = {k: set(heapq.nsmallest(share, v)) for k, v in found.items()}
        rows = [(k, h) for k, v in found.items() for h in v]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["kind", "h"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                codes, tags = training_windows([text])
                order = balanced(tags, per_doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([codes[order].astype(np.int8).tobytes()], pa.binary()),
                     pa.array([tags[order].astype(np.int8).tobytes()], pa.binary())], names=["codes", "tags"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    # A few thousand numbers a task.
    smallest = written(hashed.mapInArrow(least, "kind int, h bigint"), "pii-sample")
    chosen = None
    for k in range(-1, len(KINDS)):
        of_kind = smallest.where(F.col("kind") == k).select("h").distinct().orderBy("h").limit(share)
        chosen = of_kind if chosen is None else chosen.union(of_kind)
    picked = hashed.join(F.broadcast(chosen.distinct()), "h").dropDuplicates(["h"]).select("text")
    got = picked.mapInArrow(cut, "codes binary, tags binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["codes"], r["tags"]))
    read = lambda k: np.concatenate([np.frombuffer(r[k], np.int8) for r in got] or [np.zeros(0, np.int8)]).astype(np.int64).reshape(-1, WINDOW)
    codes, tags = read("codes"), read("tags")
    if not len(codes):
        return None
    order = balanced(tags, TRAIN_WINDOWS)
    return fit(codes[order], tags[order])


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, digest of the base spans, all spans.

    Offsets are code points. ``spans`` lists base spans and those the tagger adds, as
    ``kind:start:end`` by kind, then start. A null or empty text has none. Repeated rows each get a
    row, a null id stays null, an empty table gives no rows, other columns are not read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) if "@" in t or re.search("[0-9]", t) else [] for t in texts]
                spans = [list(b) for b in base]
                for k, number, tags in decoded(texts, shared.value):
                    spans[k] += added_spans(texts[k], number, tags, base[k])
                count = lambda kind: pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64())
                digest = [hashlib.sha256(written_out(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(count(k) for k in range(4)), pa.array(digest), pa.array([written_out(s) for s in spans], pa.string())],
                    names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoded(texts: list[str], tagger: Tagger | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Text number, window numbers and tags of each text with windows; DECODE windows at a time."""
    if tagger is None:
        return
    cut = []
    for k, text in enumerate(texts):
        if "@" in text or re.search("[0-9]", text):
            number, codes = windows_of(codes_of(text))
            if len(number):
                cut.append((k, number, codes.astype(np.int8)))
    held, size = [], 0
    for item in [*cut, None]:
        if item is not None:
            held.append(item)
            size += len(item[1])
        if held and (item is None or size >= DECODE):
            codes = np.concatenate([c for _, _, c in held]).astype(np.int64)
            tags = np.concatenate([tagger.decode(codes[a : a + DECODE]) for a in range(0, len(codes), DECODE)])
            ends = np.cumsum([len(n) for _, n, _ in held])
            for (k, number, _), own in zip(held, np.split(tags, ends[:-1])):
                yield k, number, own
            held, size = [], 0
