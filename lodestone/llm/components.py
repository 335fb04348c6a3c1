"""Connected components of a distributed edge list, by hooking and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stage


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of ``n`` vertices, for edges in one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id that it reaches.

    Labels only fall, and every round also hands the new label to the old
    label's vertex and follows labels twice, so long chains halve each round.
    Each round is written to the shared folder, which cuts the lineage.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct()
    both = stage(both.toDF("src", "dst"), "edges")
    label = stage(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m")).select("id", F.least("id", "m").alias("l")), "label")
    total = None
    while True:
        near = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("l").alias("m"))
        met = label.join(near, label["id"] == near["src"]).select("id", "l", F.least("l", "m").alias("m"))
        offers = met.select("id", F.col("m").alias("l")).union(met.select(F.col("l").alias("id"), F.col("m").alias("l")))
        hooked = stage(offers.groupBy("id").agg(F.min("l").alias("l")), "hooked")
        up = hooked.select(F.col("id").alias("up"), F.col("l").alias("top"))
        label = stage(hooked.join(up, hooked["l"] == up["up"]).select("id", F.least("l", "top").alias("l")), "label")
        now = label.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return label.select("id", F.col("l").alias("component"))
        total = now
