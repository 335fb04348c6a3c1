"""MinHash near-dedup by improved consistent weighted sampling (ICWS).

A text is a bag of five-word shingles weighted by 1 + ln TF times a clipped IDF. ICWS
draws (shingle, level) samples so that two texts agree on a draw with the
probability of their weighted Jaccard similarity; bands of draws give candidate
pairs, and each candidate is verified by the exact weighted Jaccard similarity
of its whole texts. Classes are the connected components of verified links.

IDF is 1 + min(1, ln(N / df) / ln(1 / common)): from 1 for a shingle in every
document to 2 for one in at most a share ``common`` of them, so the weighted
similarity stays close to the plain one; in tables of fewer than 1 / ``common``
documents a shingle of one document is below 2. Only the common shingles need their df,
and of these there are at most (mean length / common) whatever N is: a shingle
with df >= common * N is counted at least at 3/4 of that by segments that
report what reaches a quarter of the share, which gives the candidates; a second
pass counts those over all documents.

Equal texts are one candidate, whatever their number. A bucket of at most
``small`` texts is compared pair by pair, leaving out pairs whose samples agree
too rarely. In a larger bucket every text is compared with one leader; buckets
whose texts are then still in several components are compared in full, in pairs
of blocks: the weighted overlap of all texts of two blocks is a product of two
matrices, and a block reports a spanning forest of its links, never the pairs.

Defined results: equal texts share a class, wordless ones too; null and empty
texts are classes of their own. A class is named by its smallest doc_id; kept is
the row of that id whose text is the first of the class by (doc_id, key). Texts
of fewer than five words are one shingle of all their words. Rows that repeat a
doc_id with several texts are classed by each text. A null doc_id has a null
class, is kept and links nothing. Texts may be of any length. ``doc_id`` is an
integer; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage
from .components import components, forest
from .textbytes import mix, pieces, shingles, text_bytes, words

_LOW = np.uint64((1 << 48) - 1)
_PIECE = 512 << 10
_FLUSH = 2_000_000
_tables: list[np.ndarray] = []


def bag(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row << 48 | shingle) of each distinct shingle of each row, in order, and its count."""
    row, h = shingles(words(data, offsets), k)
    key = np.sort((row.astype(np.uint64) << np.uint64(48)) | (h & _LOW))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[new], np.diff(np.append(new, len(key)))


def weights(key: np.ndarray, tf: np.ndarray, common: tuple[np.ndarray, np.ndarray, float]) -> np.ndarray:
    shingle, idf, rest = common
    out = np.full(len(key), rest)
    if len(shingle):
        h = key & _LOW
        at = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
        out = np.where(shingle[at] == h, idf[at], out)
    return out * (1 + np.log(tf))


def _quantiles() -> list[np.ndarray]:
    """R ~ Gamma(2, 1) and ln of another, at 65,536 even quantiles."""
    if not _tables:
        u = (np.arange(65536) + 0.5) / 65536
        x = 1 + 2 * u
        for _ in range(60):  # Newton on 1 - (1 + x) exp(-x) = u
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), 1e-4)
        _tables[:] = [x.astype(np.float32), np.log(x).astype(np.float32)]
    return _tables


def icws(key: np.ndarray, weight: np.ndarray, rows: int, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows that have shingles, their numbers and ``draws`` samples each.

    A sample is the least ln a = ln c - r (t - beta + 1), t = floor(ln w / r + beta);
    equal (shingle, t) give equal values, so the value itself stands for the sample.
    """
    r_table, c_table = _quantiles()
    bound = np.searchsorted(key, np.arange(rows + 1, dtype=np.uint64) << np.uint64(48))
    live = np.flatnonzero(np.diff(bound))
    out = np.zeros((len(live), draws), np.uint32)
    if not len(live):
        return live, out
    h = mix(key & _LOW)
    log = np.log(weight).astype(np.float32)
    first = bound[live]
    for j in range(draws):
        z = (h ^ np.uint64((j + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x94D049BB133111EB)
        bits = z.view(np.uint16).reshape(-1, 4)
        r, beta = r_table[bits[:, 3]], bits[:, 1] * np.float32(1 / 65536)
        t = np.floor(log / r + beta)
        out[:, j] = np.minimum.reduceat(c_table[bits[:, 2]] - r * (t - beta + np.float32(1)), first).view(np.uint32)
    return live, out


def common_shingles(docs: DataFrame, *, common: float = 0.02, k: int = 5, text: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """The shingles in more than ``common`` of all documents, and in two at least, their IDF, and the IDF of all others."""
    texts = docs.select(F.col(text).alias("text"))

    def segments(batches):
        held, size, n = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= max(1, common / 4 * n)
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[keep].view(np.int64), -1)), pa.array(np.append(c[keep], n).astype(np.int64))], ["h", "n"])

        for batch in batches:
            for part, data, offsets in pieces(batch):
                key, _ = bag(data, offsets, k)
                held.append(key & _LOW)
                size, n = size + len(key), n + part.num_rows
                if size >= _FLUSH:
                    yield flush()
                    held, size, n = [], 0, 0
        if n:
            yield flush()

    found = stage(texts.mapInArrow(segments, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "shingles")
    total = found.where("h = -1").first()
    total = 1 if total is None else int(total["n"])
    # The others are in one document, or in so few that the IDF is clipped.
    rest = 1 + min(1.0, math.log(total) / math.log(1 / common))
    # At most (mean length) / (0.75 common) rows.
    some = np.sort(np.array([r["h"] for r in found.where((F.col("h") >= 0) & (F.col("n") >= max(2.0, 0.75 * common * total))).select("h").collect()], np.int64).view(np.uint64))
    if not len(some):
        return some, np.zeros(0), rest
    shared = docs.sparkSession.sparkContext.broadcast(some)

    def count(batches):
        df = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for _, data, offsets in pieces(batch):
                h = bag(data, offsets, k)[0] & _LOW
                at = np.minimum(np.searchsorted(shared.value, h), len(df) - 1)
                df += np.bincount(at[shared.value[at] == h], minlength=len(df))
        live = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int64)), pa.array(df[live])], ["i", "n"])

    df = np.zeros(len(some))
    for r in texts.mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        df[r["i"]] = r["n"]
    df = np.maximum(df, 1)
    keep = df > common * total
    return some[keep], 1 + np.minimum(1, np.log(total / df[keep]) / math.log(1 / common)), rest


def sketches(docs: DataFrame, common: tuple[np.ndarray, np.ndarray, float], *, bands: int, rows: int, k: int) -> DataFrame:
    """doc_id, key (of the exact text; null for null or empty), sig and band keys of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def draw(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, limit=_PIECE):
                key, tf = bag(data, offsets, k)
                live, sig = icws(key, weights(key, tf, shared.value), part.num_rows, bands * rows)
                band = np.zeros((len(live), bands), np.uint64)
                for j in range(rows):
                    band = mix(band + salt) + sig[:, j::rows][:, :bands].astype(np.uint64)
                band = mix(band).view(np.int64)
                small = (mix(sig.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
                size = np.zeros(part.num_rows, np.int64)
                size[live] = 1
                at = np.concatenate([[0], np.cumsum(size)])
                sigs = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((at * small.shape[1] * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(small))])
                lists = pa.ListArray.from_arrays(pa.array((at * bands).astype(np.int32)), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sigs, lists], ["doc_id", "key", "sig", "band"])

    key = F.when(F.length("text") > 0, F.unhex(F.md5(F.col("text").cast("binary"))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", key.alias("key"), "text").mapInArrow(draw, f"doc_id {kind}, key binary, sig binary, band array<bigint>")


def _agree(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (sig[a] == sig[b]).sum(1)


def _near_in_buckets(member: DataFrame, draws: int, least: int) -> DataFrame:
    """Pairs of one bucket whose samples agree in at least ``least`` draws."""

    def compare(batches):
        rest = None

        def pairs(t: pa.Table):
            bucket, ids = t.column("bucket").to_numpy(), t.column("id").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, draws)
            found, lag = [np.zeros((0, 2), np.int64)], 1
            while lag < len(ids):
                at = np.flatnonzero(bucket[lag:] == bucket[:-lag])
                if not len(at):
                    break
                at = at[_agree(sig, at, at + lag) >= least]
                found.append(np.stack([ids[at], ids[at + lag]], 1))
                lag += 1
            both = np.sort(np.concatenate(found), 1)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            if not t.num_rows:
                continue
            bucket = t.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket == bucket[-1], True))
            yield pairs(t.slice(0, last))
            rest = t.slice(last)
        if rest is not None:
            yield pairs(rest)

    ordered = member.repartition("bucket").sortWithinPartitions("bucket", "id")
    return ordered.select("bucket", "id", "sig").mapInArrow(compare, "a bigint, b bigint")


def _near_in_blocks(state: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray, float], *, threshold: float, k: int, block: int) -> DataFrame:
    """Links (a, b) that join the components of each bucket of ``state`` (bucket, id, n, component), by exact similarity of all its pairs."""
    shared = state.sparkSession.sparkContext.broadcast(common)
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit(23), "id"), parts).cast("int")
    rows = state.join(texts.hint("merge"), "id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "component", "text")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, group, own = (table.column(c).to_numpy() for c in ("id", "component", "own"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        key, tf = bag(*text_bytes(table.column("text")), k)
        row, h = (key >> np.uint64(48)).astype(np.int64), key & _LOW
        idf = weights(key, np.ones(len(key)), shared.value)
        total = np.bincount(row, idf * (1 + np.log(tf)), len(ids))
        # min(1 + ln x, 1 + ln y) is a sum over levels that both reach, so each (shingle, level) is a column.
        at = np.repeat(np.arange(len(key)), tf)
        level = np.arange(len(at)) - np.repeat(np.cumsum(tf) - tf, tf) + 1
        step = np.where(level > 1, np.log(level) - np.log(np.maximum(level - 1, 1)), 1.0)
        _, column, times = np.unique(mix(h[at] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        both = times[column] > 1
        number = np.cumsum(times > 1) - 1
        column, r, value = number[column[both]], row[at[both]], np.sqrt(idf[at[both]] * step[both])
        order = np.argsort(column, kind="stable")
        column, r, value = column[order], r[order], value[order]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        low, width = np.zeros((len(left), len(right))), 4096
        edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for n, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            dense = np.zeros((len(ids), width))
            dense[r[i:j], column[i:j] - n * width] = value[i:j]
            low += dense[left] @ dense[right].T
        near = low >= threshold * (total[left][:, None] + total[right][None, :] - low) - 1e-9
        a, b = np.nonzero(near & (group[left][:, None] != group[right][None, :]))
        known, place = np.unique(group, return_inverse=True)
        root = forest(place[left[a]], place[right[b]], len(known))
        live = np.flatnonzero(root != np.arange(len(known)))
        return pa.table([pa.array(known[live]), pa.array(known[root[live]])], ["a", "b"])

    return rows.groupBy("bucket", "lo", "hi").applyInArrow(compare, "a bigint, b bigint")


def similarity(pairs: DataFrame, texts: DataFrame, common: tuple[np.ndarray, np.ndarray, float], *, k: int) -> DataFrame:
    """(a, b, j): the exact weighted Jaccard similarity of each pair's whole texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(common)
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "ta", "tb")

    def judge(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "ta", _PIECE):
                sides = [bag(data, offsets, k), bag(*text_bytes(part.column(3)), k)]
                key = np.concatenate([s[0] for s in sides])
                w = np.concatenate([weights(*s, shared.value) for s in sides])
                order = np.argsort(key, kind="stable")
                key, w = key[order], w[order]
                twin = np.flatnonzero(key[1:] == key[:-1])
                row = (key >> np.uint64(48)).astype(np.int64)
                low = np.bincount(row[twin], np.minimum(w[twin], w[twin + 1]), part.num_rows)
                total = np.bincount(row, w, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(low / np.maximum(total - low, 1e-9))], ["a", "b", "j"])

    return both.mapInArrow(judge, "a bigint, b bigint, j double")


def _join_buckets(members: DataFrame, facts: DataFrame, block: int) -> DataFrame:
    """Join ``facts`` (bucket, n and more) to the members of each bucket; a large bucket is dealt in parts of about ``block`` rows."""
    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64(F.lit(31), "id"), parts).cast("int"))
    copies = facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copies, ["bucket", "part"]).drop("part")


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, k: int = 5, bands: int = 14, rows: int = 3, common: float = 0.02, small: int = 16, block: int = 512) -> DataFrame:
    """One row a document: doc_id, key (of its text), text_id (its text's smallest doc_id), class_id, kept."""
    draws, least = bands * rows, math.floor(bands * rows * (threshold - 0.3))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = common_shingles(own, common=common, k=k)
    drawn = stage(sketches(own, idf, bands=bands, rows=rows, k=k), "sketches")
    keyed = drawn.where(F.col("key").isNotNull())
    reps = keyed.groupBy("key").agg(F.min("doc_id").alias("text_id"), F.any_value("sig").alias("sig"), F.any_value("band").alias("band")).where("text_id is not null")
    # A number of its own for each distinct text: several may share a doc_id.
    reps = stage(reps.withColumn("id", F.monotonically_increasing_id()), "texts")
    band = reps.where(F.size("band") > 0).select("id", F.explode("band").alias("bucket"))
    sizes = band.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stage(band.join(sizes, "bucket").select("bucket", "id", "n"), "members")
    small_member = member.where(F.col("n") <= small).join(reps.select("id", "sig"), "id")
    pairs = _near_in_buckets(small_member, draws, least)
    large = member.where(F.col("n") > small)
    lead = large.groupBy("bucket", "n").agg(F.min(F.struct(F.xxhash64(F.lit(29), "id").alias("h"), "id")).alias("s")).select("bucket", "n", F.col("s.id").alias("lead"))
    star = _join_buckets(large, lead, block).where("id != lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
    pairs = stage(pairs.union(star).distinct(), "pairs")
    involved = member.select("id").distinct().join(reps.select("id", "key", "text_id"), "id").hint("merge")
    # By the id of one document that has the text: copies of it meet nobody.
    named = own.join(involved, F.col("doc_id") == F.col("text_id")).where(F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("key"))
    texts = stage(named.select("id", "text").dropDuplicates(["id"]), "involved")
    links = stage(similarity(pairs, texts, idf, k=k).where(F.col("j") >= threshold).select("a", "b"), "links")
    group = components(links)
    state = large.join(group, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    split = state.groupBy("bucket", "n").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket", "n")
    state = stage(_join_buckets(state, split, block), "state")
    if state.limit(1).count():
        more = stage(_near_in_blocks(state, texts, idf, threshold=threshold, k=k, block=block).distinct(), "more")
        if more.limit(1).count():
            group = components(links.unionByName(more))
    classed = stage(reps.select("key", "id", "text_id").join(group, "id", "left"), "classed")
    first = classed.where("component is not null").groupBy(F.col("component").alias("number")).agg(F.min(F.struct("text_id", "key")).alias("first"))
    # Texts that link with none are in no component; their own number spreads them over the tasks.
    classes = classed.join(first, F.coalesce("component", "id") == F.col("number"), "left").select("key", "text_id", F.coalesce("first.text_id", "text_id").alias("class_id"), F.coalesce("first.key", "key").alias("class_key"))
    out = drawn.select("doc_id", "key").join(classes.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    kept = F.col("doc_id").isNull() | F.col("class_key").isNull() | ((F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key")))
    return out.select("doc_id", "key", F.coalesce("text_id", "doc_id").alias("text_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), kept.alias("kept"))
