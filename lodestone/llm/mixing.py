"""Mixing sources to target weights by subset-sum budget fitting.

Sources sorted by code point (null last) weigh 5, 2, 1 in turn and share a pool
of 150 % of all words; a target stops at twice its source's words and the excess
is shared anew. A target of at least the source takes every document once and
fits the rest with second copies. The budget left is fitted from the counts of
documents by exact length: a proportional share of every length first, then a
bounded-knapsack dynamic program over what remains. Which documents of a length
are taken is decided by a seeded hash of their id.

Defined results: null text has size 0; documents of size 0 take 0 words. A null
source is a source of its own. Repeated rows are separate documents. Equal ids
are ordered by their size only, so reruns agree. An empty table gives an empty
result. Texts may be of any length; other columns are not read. One row a source
goes to the driver. Above ``EXACT`` words of budget the share of each length and
then the longest documents that fit are taken; the program decides the rest.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ranked, stage

WEIGHTS = (5, 2, 1)
#: Words that the dynamic program fits exactly; what lies above is dealt by length.
EXACT = 1 << 15


def targets(sizes: dict[str | None, int], weights=WEIGHTS, pool=Fraction(3, 2), most: int = 2) -> dict[str | None, Fraction]:
    """The target of each source, as exact fractions."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = pool * sum(sizes.values()), {}, set(names)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: Fraction(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def fit(length: np.ndarray, count: np.ndarray, budget: int, exact: int = EXACT) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget`` or just below.

    Lengths are distinct and positive, and ``budget`` is at most their words.
    """
    length, count = length.astype(np.int64), count.astype(np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return count.copy()
    take = np.array([int(c) * budget // total for c in count], np.int64)
    left = budget - int((take * length).sum())
    for i in np.argsort(-length):
        if left <= exact:
            break
        if take[i] < count[i] and length[i] <= left:
            take[i] += 1
            left -= int(length[i])
    # Bounded knapsack: items are runs of 1, 2, 4 ... documents of a length; bit s of a state says that s words can be reached.
    items, states, full = [], [], (1 << (left + 1)) - 1
    reach = 1
    for i in np.argsort(length):
        spare, run = min(int(count[i] - take[i]), left // int(length[i]) if length[i] else 0), 1
        while spare > 0 and not reach >> left & 1:
            run = min(run, spare)
            states.append(reach)
            items.append((i, run))
            reach |= reach << (run * int(length[i])) & full
            spare -= run
            run *= 2
    goal = reach.bit_length() - 1
    for (i, run), before in zip(reversed(items), reversed(states), strict=True):
        if not before >> goal & 1:
            take[i] += run
            goal -= run * int(length[i])
    return take


def size_of(text: str) -> Column:
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, *, weights=WEIGHTS, pool=Fraction(3, 2), most: int = 2, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies (0, 1 or 2) of every document."""
    spark = docs.sparkSession
    sized = stage(docs.select("doc_id", "source", size_of("text").alias("size")), "sized")
    counts = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    # One row a source, not a document.
    sizes = {r["source"]: int(r["w"]) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect()}
    target = targets(sizes, weights, pool, most)
    goals = spark.createDataFrame([(s, sizes[s], float(t), int(t // sizes[s]) if sizes[s] else 0, round(t % sizes[s]) if sizes[s] else 0) for s, t in target.items()], "g_source string, source_size long, target double, base long, budget long")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["size"] > 0].sort_values("size")
        budget = int(part["budget"].iloc[0]) if len(part) else 0
        part = part.assign(extra=fit(part["size"].to_numpy(), part["n"].to_numpy(), budget) if budget else 0)
        return part[["g_source", "size", "extra"]]

    plan = counts.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("g_source")))
    chosen = plan.groupBy("source").applyInPandas(choose, "g_source string, size long, extra long")
    chosen = chosen.where("extra > 0").select(F.col("g_source").alias("c_source"), F.col("size").alias("c_size"), "extra")
    rank = ranked(sized.withColumn("_seed", F.lit(seed)), ["source", "size"], ["_seed", "doc_id"], "rank").drop("_seed")
    both = rank.join(chosen, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
    both = both.join(F.broadcast(goals), F.col("source").eqNullSafe(F.col("g_source")), "left")
    copies = (F.col("base") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)).cast("int")
    return both.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
