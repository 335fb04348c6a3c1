"""Sharding by Karmarkar-Karp differencing of indivisible groups of equal texts.

Groups are dealt to chunks of bounded size. A task differences its chunk: the
two partial partitions of largest spread are combined, the larger sums of one
with the smaller sums of the other, until one is left. The chunks' partial
partitions are differenced in the same way, ``fan`` of them in a task, in rounds
until one is left; then the rounds are followed back by joins. No task and not
the driver sees more than a chunk. Law ``bytes``: the shards' sizes are near
equal; a group is never split, however large.

Defined results: null text has size 1 and shares a group with empty text.
Repeated rows are equal texts. Slots run gapless from 0 in each shard, in the
order of a seeded hash of id, size and checksum. Null ids are rows like others.
Texts may be of any length. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ranked, stage


def difference(parts: list[tuple[int, ...]], shards: int) -> list[list[int]]:
    """For each partial partition (its sums, any order), the shard of each of its slots.

    Ties of spread go to the part that came first, so results repeat.
    """
    heap, children = [], []
    for i, sums in enumerate(parts):
        order = sorted(range(shards), key=lambda s: -sums[s])
        ordered = [sums[s] for s in order]
        children.append((order,))
        heapq.heappush(heap, (ordered[-1] - ordered[0], i, ordered))
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        sums = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(shards), key=lambda s: -sums[s])
        ordered = [sums[s] for s in order]
        children.append((a, b, order))
        heapq.heappush(heap, (ordered[-1] - ordered[0], len(children) - 1, ordered))
    places: dict[int, list[int]] = {}
    if children:
        places[len(children) - 1] = list(range(shards))
    for node in range(len(children) - 1, len(parts) - 1, -1):
        own, (a, b, order) = places.pop(node), children[node]
        places[a], places[b] = [0] * shards, [0] * shards
        for i, slot in enumerate(order):
            places[a][slot] = own[i]
            places[b][shards - 1 - slot] = own[i]
    out = []
    for i in range(len(parts)):
        at = [0] * shards
        for slot, place in zip(children[i][0], places[i], strict=True):
            at[slot] = place
        out.append(at)
    return out


def shard(docs: DataFrame, *, shards: int = 16, chunk_groups: int = 20_000, fan: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = stage(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.md5(raw)).alias("_key")), "keyed")
    groups = stage(keyed.groupBy("_key").agg(F.sum("size").alias("bytes")), "groups")
    chunks = max(1, -(-groups.count() // chunk_groups))
    groups = groups.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "_key"), F.lit(chunks)).cast("int"))

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "_key"], ascending=[False, True])
        places = difference([(int(b), *[0] * (shards - 1)) for b in rows["bytes"]], shards)
        return rows.assign(part=[p[0] for p in places])

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        sums = rows.pivot(index="chunk", columns="part", values="bytes").reindex(columns=range(shards)).fillna(0).sort_index()
        places = difference([tuple(map(int, v)) for v in sums.to_numpy()], shards)
        place = {(c, p): to for c, at in zip(sums.index, places, strict=True) for p, to in enumerate(at)}
        return rows.assign(up=rows["chunk"] // fan, up_part=[place[x] for x in zip(rows["chunk"], rows["part"], strict=True)])

    parted = stage(groups.groupBy("chunk").applyInPandas(part, "_key binary, bytes long, chunk int, part int"), "parted")
    sums, rounds = parted, []
    while chunks > 1:
        sums = sums.groupBy("chunk", "part").agg(F.sum("bytes").alias("bytes"))
        dealt = sums.groupBy(F.floor(F.col("chunk") / fan)).applyInPandas(combine, "chunk int, part int, bytes long, up int, up_part int")
        rounds.append(stage(dealt, "round"))
        sums = rounds[-1].select(F.col("up").alias("chunk"), F.col("up_part").alias("part"), "bytes")
        chunks = -(-chunks // fan)
    place = None
    for each in reversed(rounds):
        if place is None:
            place = each.select("chunk", "part", F.col("up_part").alias("shard"))
        else:
            above = place.select(F.col("chunk").alias("up"), F.col("part").alias("up_part"), "shard")
            place = each.join(above, ["up", "up_part"]).select("chunk", "part", "shard")
    placed = parted.withColumn("shard", F.col("part")) if place is None else parted.join(place, ["chunk", "part"])
    rows = keyed.join(placed.select("_key", "shard"), "_key").drop("_key")
    out = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
