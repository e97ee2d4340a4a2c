"""Awkward tables for the operators."""

import random

DDL = ("doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key int, score string, "
       "s string, pos int, label int, bands int, h int, sketch string, tokens int, k string, line string, words int, spans int")


def prose(seed, words):
    """Made-up words, the same each time."""
    rng = random.Random(seed)
    parts = ["an", "the", "or", "is", "tion", "er", "in", "ing", "ed", "al", "é", "ß"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def edge_rows():
    """Nulls in every column, empty and blank and very long texts, ties, repeated rows, one word."""
    long = "\n".join(prose(1000 + i, 60) for i in range(400))
    texts = [None, "", " \n\t ", "one", prose(1, 40), prose(1, 40), prose(1, 40) + " more", long, "a" * 30_000,
             "日本語の文章です", "x\x00y z w", "1 2\n\n1 2\n"]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "src", 1), (20, None, None, None, None), (None, None, None, None, None), (None, prose(3, 30), "en", None, 3)]
    return [(*r, "clash", 7, "clash", "clash", 3, 1, 2, 4, "clash", 9, "clash", "clash", 5, 6) for r in rows]


def edges(spark):
    return spark.createDataFrame(edge_rows(), DDL)


def nothing(spark):
    return spark.createDataFrame([], DDL)


def docs_of(spark, texts, source="src"):
    rows = [(i, t, source if isinstance(source, str) else source[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")
