"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent between 0 and 1, found by bisection so that the mix has
a target entropy or no source is read more often than a limit. The weights are realised in passes:
each pass over a source is a permutation of its blocks, and of the documents in a block; the last
pass stops where the source's token budget ends. Everything is DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import written

BLOCK_DOCS = 1000  # documents of a block, about
MAX_REPEATS = 2.0
SECTIONS = 16  # exponents tried at once: four steps of bisection
ROUNDS = 8


def count_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"\S+")), F.lit(0)).cast("bigint")


def _source(docs: DataFrame, source_col: str) -> list[Column]:
    """The source as two columns without nulls, to group and join by."""
    source = F.col(source_col).cast("string")
    return [F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("s_null")]


def _place(key: Column, *salt: object) -> Column:
    return F.xxhash64(*(F.lit(x) for x in salt), key)


def exponent(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> float:
    """The exponent for rows (tokens) of sources.

    With a target the largest whose weights have at least that entropy, as a share of the largest
    possible; with a limit the smallest under which, when the largest source is read once, none is
    read more than ``max_repeats`` times. With both, the limit comes first; with neither, 1.
    """
    used = sources.where("tokens > 0")
    total, largest, least, n = used.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n or n < 2:
        return 1.0
    shares = used.select(F.log(F.col("tokens") / F.lit(float(total))).alias("l"))

    def entropies(tried: list[float]) -> list[float]:
        weights = [F.exp(F.col("l") * a) for a in tried]
        row = shares.agg(*(x for w in weights for x in (F.sum(w), F.sum(w * F.col("l"))))).first()
        return [(math.log(row[2 * k]) - a * row[2 * k + 1] / row[2 * k]) / math.log(n) for k, a in enumerate(tried)]

    def repeats(tried: list[float]) -> list[float]:
        return [(largest / least) ** (1 - a) for a in tried]

    def bisect(enough) -> float:
        """The point in [0, 1] up to which ``enough`` holds."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            tried = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            good = enough(tried)
            last = max((k for k, g in enumerate(good) if g), default=0)
            low, high = tried[last], tried[min(last + 1, SECTIONS)]
        return low

    found = []
    if target_entropy is not None:
        found.append(bisect(lambda tried: [h >= target_entropy for h in entropies(tried)]))
    if max_repeats is not None:
        # Repeats fall as the exponent rises: the end of the exponents with too many.
        over = bisect(lambda tried: [r > max_repeats for r in repeats(tried)])
        found.append(min(1.0, over + SECTIONS**-ROUNDS) if repeats([0.0])[0] > max_repeats else 0.0)
    # Seven digits, far above the noise of sums in another order.
    return round(max(found), 7) if found else 1.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS,
        budget_tokens: int | None = None, seed: int = 0) -> DataFrame:
    """One row per copy: id, source, n_tokens, pass_no, block_no, mix_at.

    A source with share p of the tokens gets the weight p ** a / sum, with ``a`` from ``exponent``,
    and that part of ``budget_tokens``; without a budget, the smallest one with which every source is
    read once in full, so that no document is lost. ``pass_no`` counts from 0; every full pass holds
    each document of the source once, and the last one its first documents in the order of that pass
    as long as they fit. ``mix_at`` in [0, 1) is where the copy stands in its source's tokens:
    ordered by it, each stretch of the mix has the target weights.

    A null source is a source of its own. A null or empty text has 0 tokens and is copied in full
    passes only, once if its source has no tokens at all. Rows that share an id go together. A null id is a
    document like others. Order within a pass is by hash, ties by id. An empty table gives no rows;
    other columns are not read.
    """
    slim, blocks = _plan(docs, id_col, text_col, source_col, target_entropy, max_repeats, budget_tokens, seed)
    # Blocks are small, and so is each window here.
    in_block = Window.partitionBy("s", "s_null", "block", "pass_no").orderBy("place", "id")
    copies = slim.join(blocks, ["s", "s_null", "block"]).withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    copies = copies.withColumn("pass_info", F.get("orders", F.col("pass_no")))
    copies = copies.withColumn("place", _place(F.struct("id", "pass_no"), seed, "doc"))
    # The sum takes in all rows of the same place, so that rows that share an id go together.
    copies = copies.withColumn("inside", F.sum("tokens").over(in_block))
    upto = F.col("pass_no") * F.col("source_tokens") + F.col("pass_info.before") + F.col("inside")
    kept = copies.where((F.col("pass_no") < F.col("full")) | (upto <= F.col("target")))
    at = F.when(F.col("target") > 0, (upto - F.col("tokens")) / F.greatest(F.col("target"), F.lit(1))).otherwise(0.0)
    return kept.select(
        F.col("id").alias(id_col), F.when(~F.col("s_null"), F.col("s")).alias(source_col), F.col("tokens").alias("n_tokens"),
        F.col("pass_no").cast("int").alias("pass_no"), F.col("pass_info.rank").alias("block_no"), F.least(at, F.lit(1.0)).alias("mix_at"))


def _plan(docs, id_col, text_col, source_col, target_entropy, max_repeats, budget_tokens, seed):
    """Rows (id, s, s_null, block, tokens) of documents, and of each block its source's budget and its
    rank and tokens before it in each pass."""
    source = _source(docs, source_col)
    sizes = written(docs.groupBy(*source).agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("bigint").alias("blocks")), "mix-sizes")
    rows = docs.select(F.col(id_col).alias("id"), *source, count_tokens(F.col(text_col)).alias("tokens"))
    slim = written(rows.join(sizes, ["s", "s_null"]).select(
        "id", "s", "s_null", F.pmod(_place(F.col("id"), seed, "block"), F.col("blocks")).alias("block"), "tokens"), "mix-documents")
    blocks = written(slim.groupBy("s", "s_null", "block").agg(F.sum("tokens").alias("tokens")), "mix-blocks")
    sources = written(blocks.groupBy("s", "s_null").agg(F.sum("tokens").alias("tokens")), "mix-sources")
    a = exponent(sources, target_entropy, max_repeats)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total)), F.lit(a))).otherwise(0.0)
    norm = sources.agg(F.sum(raw)).first()[0] or 1.0
    weighed = sources.withColumn("weight", raw / F.lit(norm))
    if budget_tokens is None:
        budget_tokens = sources.where("tokens > 0").agg(F.max(F.col("tokens") / (raw / F.lit(norm)))).first()[0] or 0
    # To six digits of a token, so that a source read exactly once is not a rounding error short.
    target = F.floor(F.round(F.col("weight") * F.lit(float(budget_tokens)), 6) + 1e-6).cast("bigint")
    budgets = weighed.select("s", "s_null", F.col("tokens").alias("source_tokens"), target.alias("target"))
    full = F.when(F.col("source_tokens") > 0, F.floor(F.col("target") / F.greatest("source_tokens", F.lit(1)))).otherwise(1)
    budgets = written(budgets.withColumn("full", full.cast("bigint")).withColumn(
        "passes", F.col("full") + (F.col("target") > F.col("full") * F.col("source_tokens")).cast("bigint")).where("passes > 0"), "mix-budgets")
    # Ranks of blocks: a window over the blocks of a source, thousands of times fewer than documents.
    each = blocks.join(budgets, ["s", "s_null"]).withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int") - 1)))
    order = Window.partitionBy("s", "s_null", "pass_no").orderBy(_place(F.struct("block", "pass_no"), seed, "order"), "block")
    ranked = each.select(
        "s", "s_null", "block", "source_tokens", "target", "full", "passes", "pass_no", (F.row_number().over(order) - 1).alias("rank"),
        (F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"))
    plans = ranked.groupBy("s", "s_null", "block", "source_tokens", "target", "full", "passes").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pass_no", "rank", "before"))), lambda x: F.struct(x["rank"].alias("rank"), x["before"].alias("before"))).alias("orders"))
    return slim, written(plans, "mix-plans")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` copies it; a row without a copy is left out."""
    copies = mix(docs, id_col, text_col, source_col, **options)
    # The passes that hold a document are the first ones, so the last tells how many there are.
    counted = copies.groupBy(F.col(id_col).alias("_id"), F.col(source_col).alias("_s")).agg((F.max("pass_no") + 1).alias("_copies"))
    counted = written(counted, "mix-copies")
    same = docs[id_col].eqNullSafe(F.col("_id")) & docs[source_col].cast("string").eqNullSafe(F.col("_s"))
    # The copies grow with the documents: joined by sorting, never broadcast.
    rows = docs.join(counted.hint("merge"), same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*(docs[c] for c in docs.columns))
