"""Embedding near-dedup by product quantisation.

Unit vectors go to inverted lists of a coarse quantiser; the residual to the
list's centroid is coded in subspaces. A query looks up its inner products with
all codewords once and adds them by code (asymmetric distance). Every member
carries the length of its coding error, which bounds how far that sum is off, so
the filter loses nothing; what passes is decided by the exact cosine in double
precision. Probing loses nothing either: two linked vectors lie at most a
chord apart, and the plane half-way between their lists' centroids parts them,
so one of them is within half a chord of that plane. Every query therefore
probes each list whose plane is that near, as long as the list's widest angle
from its centroid allows a link at all; of a pair that finds itself twice, the
vector nearer to the plane counts it. Centroids closer than a link's length
become one, so that a group of near vectors is one list (of many blocks) rather
than many lists that all probe each other.

Both quantisers are fitted on about ``sample_rows`` vectors chosen by a hash of
their number (four for each list, if those are more); there is a list for every
``list_rows`` vectors, beyond ``most_lists`` lists one for each of the square
root of all vectors. Every vector is indexed and every vector is a query. Equal
vectors are indexed once. A list is cut into blocks of members and of queries,
so a hot list is many tasks; a block reports link counts and a spanning forest
of its links, never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite parts
link with nothing and are kept. Vectors of different lengths link with nothing
of another length. Rows that repeat a vec_id are vectors of their own, in links
and in counts. Null ids are left out of links, with a null component. A table of
no vectors gives no rows. ``vec_id`` is an integer. Other columns, labels among
them, are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .components import components, forest


def k_means(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly drawn rows; empty ones stay where they were."""
    draw = np.random.default_rng(seed).permutation(len(x))[:k]
    c = x[draw].astype(np.float64)
    for _ in range(rounds):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def apart(c: np.ndarray, length: float) -> np.ndarray:
    """The rows of ``c`` of which none is closer than ``length`` to one kept before."""
    square, kept, free = (c**2).sum(1), [], np.ones(len(c), bool)
    for i in range(len(c)):
        if free[i]:
            kept.append(i)
            free &= square + square[i] - 2 * c @ c[i] >= length**2
    return c[kept]


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class Quantiser:
    coarse: np.ndarray
    #: (subspaces, codewords, width)
    books: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, codewords: int, length: float) -> Quantiser:
        """``x``: unit vectors; centroids lie at least ``length`` apart."""
        coarse = apart(k_means(x, min(lists, len(x)), 8), length)
        rest = cls._cut(x - coarse[cls._near(x, coarse)], subspaces)
        books = [k_means(rest[:, m], min(codewords, len(x)), 5) for m in range(subspaces)]
        return cls(coarse, np.stack(books))

    @staticmethod
    def _near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)

    @staticmethod
    def _cut(x: np.ndarray, subspaces: int) -> np.ndarray:
        width = -(-x.shape[1] // subspaces)
        x = np.pad(x, ((0, 0), (0, width * subspaces - x.shape[1])))
        return x.reshape(len(x), subspaces, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, length of the coding error, and angle to the list's centroid."""
        home = self._near(x, self.coarse)
        rest = self._cut(x - self.coarse[home], len(self.books))
        code = np.stack([self._near(rest[:, m], book) for m, book in enumerate(self.books)], 1)
        made = np.stack([book[code[:, m]] for m, book in enumerate(self.books)], 1)
        error = np.sqrt(((rest - made) ** 2).sum((1, 2)))
        return home.astype(np.int32), code.astype(np.uint8), error, _angle(np.einsum("ij,ij->i", x, self._directions()[home]))

    def _directions(self) -> np.ndarray:
        return self.coarse / np.maximum(np.sqrt((self.coarse**2).sum(1, keepdims=True)), 1e-300)

    def margin(self, x: np.ndarray, home: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Distance of each vector from the plane half-way between its list's centroid and another's."""
        way = self.coarse[other] - self.coarse[home]
        gap = np.einsum("ij,ij->i", self.coarse[other] + self.coarse[home] - 2 * x, way)
        return gap / (2 * np.sqrt(np.einsum("ij,ij->i", way, way)))

    def reach(self, x: np.ndarray, home: np.ndarray, widest: np.ndarray, threshold: float) -> np.ndarray:
        """(queries, lists): the lists that each query has to probe.

        ``widest`` has each list's largest angle between a member and its centroid, negative without members.
        """
        c, turn, chord = self.coarse, np.arccos(threshold), np.sqrt(2 - 2 * threshold)
        square, dot = (c**2).sum(1), x @ c.T
        gap = square - 2 * dot - (square[home] - 2 * dot[np.arange(len(x)), home])[:, None]
        length = np.sqrt(np.maximum(square + square[home][:, None] - 2 * (c[home] @ c.T), 0))
        near = gap <= chord * length + 1e-6
        near &= _angle(x @ self._directions().T) <= widest + turn + 1e-7
        near[np.arange(len(x)), home] = True
        return near & (widest >= 0)

    def table(self, q: np.ndarray) -> np.ndarray:
        """(subspaces, codewords, queries): inner products of each query's parts with each codeword."""
        return self.books.astype(np.float32) @ self._cut(q, len(self.books)).transpose(1, 2, 0).astype(np.float32)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Raw and unit vectors in double precision."""
    raw = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return raw, scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def vector_duplicates(vectors: DataFrame, *, threshold: float = 0.95, list_rows: int = 1024, most_lists: int = 4096, subspaces: int = 8, codewords: int = 64, sample_rows: int = 16_000, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    key = F.unhex(F.md5(F.concat_ws(",", F.col("embedding").cast("array<string>")).cast("binary")))
    keyed = stage(own.withColumn("key", F.when(F.coalesce(sound, F.lit(False)), key)), "vectors")
    one = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"), F.any_value("embedding").alias("embedding"))
    # A number of its own for each distinct vector: several may share a vec_id.
    one = stage(one.withColumn("id", F.monotonically_increasing_id()), "distinct")
    sizes = one.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row a length
    found = None
    for r in sizes:
        lists = max(1, min(r["n"] // list_rows, max(most_lists, math.isqrt(r["n"]))))
        part = _links(one.where(F.size("embedding") == r["dim"]), r["dim"], r["n"], threshold, lists, subspaces, codewords, max(sample_rows, 4 * lists), block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found, "found")
    counts = found.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cid"), F.col("component").alias("number"))
    linked = stage(one.select("key", "id", "least", "times").join(counts, "id", "left").join(group, F.col("id") == F.col("cid"), "left"), "linked")
    names = linked.where("number is not null").groupBy(F.col("number").alias("named")).agg(F.min("least").alias("component_id"))
    # Vectors that link with none are in no component; their own number spreads them over the tasks.
    classes = linked.join(names, F.coalesce("number", "id") == F.col("named"), "left")
    classes = classes.select("key", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = keyed.select("vec_id", "key").join(classes, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(one: DataFrame, dim: int, n: int, threshold: float, lists: int, subspaces: int, codewords: int, sample_rows: int, block: int) -> DataFrame:
    """(id, n, root): link counts, and edges to the root of each block's spanning trees."""
    spark = one.sparkSession
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(41), "key"), 11).cast("double") / float(1 << 53)
    drawn = one.where(unit < min(1.0, sample_rows / n)).select("embedding").toArrow() if n > 64 else one.limit(64).select("embedding").toArrow()
    sample = _unit(drawn.column(0).combine_chunks(), dim)[1] if drawn.num_rows else np.eye(1, dim)
    shared = spark.sparkContext.broadcast(Quantiser.fit(sample, lists, min(subspaces, dim), codewords, float(np.sqrt(2 - 2 * threshold))))

    def index(batches):
        for batch in batches:
            if batch.num_rows:
                home, code, error, angle = shared.value.encode(_unit(batch.column(2), dim)[1])
                codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1]), pa.py_buffer(np.ascontiguousarray(code))])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(home), codes, pa.array(error), pa.array(angle)], ["id", "times", "embedding", "home", "code", "error", "angle"])

    kind = one.schema["embedding"].dataType.simpleString()
    indexed = stage(one.select("id", "times", "embedding").mapInArrow(index, f"id bigint, times bigint, embedding {kind}, home int, code binary, error double, angle double"), "indexed")
    # One row a list.
    held = indexed.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect()
    members, widest = {r["home"]: r["n"] for r in held}, np.full(len(shared.value.coarse), -np.inf)
    for r in held:
        widest[r["home"]] = r["angle"]

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                near = shared.value.reach(_unit(part.column(1), dim)[1], part.column(2).to_numpy(), widest, threshold)
                lists_ = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(near.sum(1))), pa.int32()), pa.array(np.nonzero(near)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists_], ["id", "near"])

    probed = stage(indexed.select("id", "embedding", "home").mapInArrow(probe, "id bigint, near array<int>"), "probed")
    asked = {r[0]: r[1] for r in probed.select(F.explode("near").alias("l")).groupBy("l").count().collect()}
    plan = spark.createDataFrame([(l, -(-m // block), -(-asked[l] // (4 * block))) for l, m in members.items()], "list int, parts int, rounds int")
    plan = F.broadcast(plan)
    salt = lambda seed, n_: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(n_)).cast("int")
    rows = ["id", "times", "embedding", "home", "code", "error"]
    bare = ["id", "times", "embedding", "home", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error")]
    member = indexed.withColumn("list", F.col("home")).join(plan, "list").select("list", salt(43, "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), F.lit(True).alias("member"), *rows)
    asking = indexed.join(probed.select(F.col("id").alias("_id"), "near"), F.col("id") == F.col("_id"))
    query = asking.withColumn("list", F.explode("near")).join(plan, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt(47, "rounds").alias("round"), F.lit(False).alias("member"), *bare)

    def link(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("member").to_numpy().astype(bool)
        ids, times = table.column("id").to_numpy(), table.column("times").to_numpy()
        none = pa.table([pa.array([], pa.int64())] * 3, ["id", "n", "root"])
        xs, qs = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(xs) or not len(qs):
            return none
        here = int(table.column("list")[0].as_py())
        home = table.column("home").to_numpy()
        _, v = _unit(table.column("embedding").combine_chunks(), dim)
        q = shared.value
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(xs)).to_pylist()), np.uint8).reshape(len(xs), -1)
        error = table.column("error").take(pa.array(xs)).to_numpy().astype(np.float32)
        pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(qs), 256):
            some = qs[at : at + 256]
            look = q.table(v[some])
            about = np.tile((v[some] @ q.coarse[here]).astype(np.float32), (len(xs), 1))
            for m in range(look.shape[0]):
                about += look[m, code[:, m]]
            # Sums in single precision are off by far less than the allowance.
            x, y = np.nonzero(about + error[:, None] >= threshold - 1e-4)
            x, y = xs[x], some[y]
            live = (home[y] != here) | (ids[y] < ids[x])
            x, y = x[live], y[live]
            for i in range(0, len(x), 1 << 16):
                a, b = x[i : i + (1 << 16)], y[i : i + (1 << 16)]
                close = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
                a, b = a[close], b[close]
                # A pair of two lists is counted by the vector nearer to the plane between them.
                two = np.flatnonzero(home[b] != here)
                here_, there = np.full(len(two), here), home[b[two]]
                asker, member_ = q.margin(v[b[two]], there, here_), q.margin(v[a[two]], here_, there)
                keep = np.ones(len(a), bool)
                keep[two] = (asker < member_) | ((asker == member_) & (ids[b[two]] < ids[a[two]]))
                pairs_a.append(a[keep])
                pairs_b.append(b[keep])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        if not len(a):
            return none
        # The same vector may stand on both sides: work on distinct ids, smallest first, so that roots are least ids.
        known, place = np.unique(ids, return_inverse=True)
        a, b, t = place[a], place[b], np.zeros(len(known), np.int64)
        t[place] = times
        n_links = np.bincount(a, t[b], len(known)) + np.bincount(b, t[a], len(known))
        root = forest(a, b, len(known))
        live = np.flatnonzero(n_links)
        return pa.table([pa.array(known[live]), pa.array(n_links[live].astype(np.int64)), pa.array(known[root[live]])], ["id", "n", "root"])

    return member.unionByName(query).groupBy("list", "part", "round").applyInArrow(link, "id bigint, n bigint, root bigint")
