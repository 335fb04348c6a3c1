"""Benchmark decontamination through a stored positional inverted index.

The index is cut by document, as search engines shard theirs: a segment holds
some documents' postings (word, position) for every word that they have, sorted
by word, packed, in one row of a table in the shared folder. Searches read that
table and not the texts. A phrase's words are ordered by their frequency in the
whole corpus, which a first pass over the words' counts alone gives; phrases
with a word that no document has are dropped there. The positions of the rarest
word, shifted by its offset, are then intersected with the shifted lists of the
others, from rare to common. Proximity search reads the same segments. No posting
is shuffled; only phrases travel, in blocks of a fixed number of words, one block
at a time, and hits come back by (segment, row).

Words are identified by 64-bit hashes: of 10 million different words two agree
with probability 3e-6, and a phrase is mistaken only if all of its words are.

Defined results: null or wordless text has no words and is never contaminated;
a null item text gives no window, and rows with a null item_id are left out.
Equal windows of several items, and repeated benchmark rows, count for each
item id once. Repeated documents, null ids and ids that several texts share are
judged row by row. An empty benchmark leaves every document clean; an empty
table gives an empty result. Texts may be of any length: a segment has one text
at least. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import stage
from .textbytes import Words, pack, pieces, text_bytes, unpack, words

#: Positions of a segment fit in so many bits of a posting; the word's number has the rest.
_POSITION = 40
_SEGMENT = 4 << 20


class Segment:
    """Postings of some documents for the words of a sorted vocabulary; positions leave one place free after each row."""

    def __init__(self, first: np.ndarray, postings: np.ndarray, size: int):
        self.first, self.postings = first, postings
        self.bound = np.searchsorted(postings, np.arange(size + 1, dtype=np.int64) << _POSITION)
        self.df = np.diff(self.bound)

    @classmethod
    def of(cls, w: Words, vocabulary: np.ndarray) -> Segment:
        """Of texts at hand."""
        rows = len(w.first) - 1
        at = np.minimum(np.searchsorted(vocabulary, w.hash), max(len(vocabulary) - 1, 0))
        known = np.flatnonzero(vocabulary[at] == w.hash) if len(vocabulary) else np.zeros(0, np.int64)
        position = known + w.row[known] if len(known) else known
        return cls(w.first + np.arange(rows + 1), np.sort((at[known].astype(np.int64) << _POSITION) | position), len(vocabulary))

    @classmethod
    def stored(cls, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, steps: np.ndarray, vocabulary: np.ndarray) -> Segment:
        """Of a row of the index: only the vocabulary's lists are read."""
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        at = np.minimum(np.searchsorted(terms, vocabulary), max(len(terms) - 1, 0))
        number = np.flatnonzero(terms[at] == vocabulary) if len(terms) else np.zeros(0, np.int64)
        at = at[number] if len(terms) else number
        begin, n = (np.cumsum(counts) - counts)[at], counts[at]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        total = np.cumsum(steps)
        before = np.where(begin > 0, total[begin - 1], 0) if len(total) else begin
        position = total[np.repeat(begin, n) + within] - np.repeat(before, n) if len(total) else within
        return cls(first, (np.repeat(number, n).astype(np.int64) << _POSITION) | position, len(vocabulary))

    def positions(self, term: int) -> np.ndarray:
        return self.postings[self.bound[term] : self.bound[term + 1]] & ((1 << _POSITION) - 1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << _POSITION) | position
        at = np.minimum(np.searchsorted(self.postings, key), max(len(self.postings) - 1, 0))
        return (self.postings[at] == key) if len(self.postings) else np.zeros(len(key), bool)

    def row(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def phrases(self, terms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrase number and first position of every occurrence; ``terms`` has one phrase a row, ``order`` its offsets from rare to common."""
        number = np.flatnonzero(self.df[terms].min(1) > 0) if len(terms) else np.zeros(0, np.int64)
        if not len(number):
            return number, number
        rare = terms[number, order[number, 0]]
        count = self.df[rare]
        phrase = np.repeat(number, count)
        at = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.bound[rare], count)
        start = (self.postings[at] & ((1 << _POSITION) - 1)) - order[phrase, 0]
        live = start >= 0
        phrase, start = phrase[live], start[live]
        for j in range(1, terms.shape[1]):
            offset = order[phrase, j]
            live = self.has(terms[phrase, offset], start + offset)
            phrase, start = phrase[live], start[live]
        return phrase, start

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Rows that hold all ``terms`` within a span of ``slop`` words beyond their number."""
        terms = sorted(set(terms), key=lambda t: self.df[t])
        reach = len(terms) + slop - 1
        found = np.zeros(0, np.int64)
        rare = np.unique(self.row(self.positions(terms[0])))
        # The span starts at one of the terms: try each start and ask that every other term follows in reach.
        for first in terms:
            start = self.positions(first)
            start = start[np.isin(self.row(start), rare)]
            for other in terms:
                if other != first and len(start):
                    at = np.searchsorted(self.postings, (other << _POSITION) | start)
                    after = self.postings[np.minimum(at, len(self.postings) - 1)] & ((1 << _POSITION) - 1)
                    # A position past the row's end belongs to another row.
                    within = (at < self.bound[other + 1]) & (after <= start + reach) & (after < self.first[self.row(start) + 1])
                    start = start[within]
            found = np.union1d(found, self.row(start))
        return found.astype(np.int64)


@dataclass
class Block:
    """Windows of some benchmark items, by length, with the items that have each and their offsets from rare to common words."""

    vocabulary: np.ndarray
    windows: list[np.ndarray]
    owners: list[np.ndarray]
    orders: list[np.ndarray]
    items: list[str]

    def ranked(self, times: np.ndarray) -> Block:
        """With words ordered by how often each occurs, and without windows that hold a word that never does."""
        live = [times[w].min(1) > 0 if len(w) else np.zeros(0, bool) for w in self.windows]
        windows = [w[x] for w, x in zip(self.windows, live, strict=True)]
        return Block(self.vocabulary, windows, [o[x] for o, x in zip(self.owners, live, strict=True)], [np.argsort(times[w], axis=1, kind="stable") for w in windows], self.items)

    def search(self, segment: Segment) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hit words as runs (row, from, to), and (row, item) of every item found; sorted by row."""
        cover = np.zeros(int(segment.first[-1]) + 1, np.int32)
        pairs = [np.zeros(0, np.int64)]
        for terms, owner, order in zip(self.windows, self.owners, self.orders, strict=True):
            phrase, start = segment.phrases(terms, order)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + terms.shape[1], -1)
            pairs.append(segment.row(start) * len(self.items) + owner[phrase])
        edge = np.flatnonzero(np.diff(np.cumsum(cover) > 0, prepend=False, append=False))
        begin, end = edge[::2], edge[1::2]
        row = segment.row(begin)
        pair = np.unique(np.concatenate(pairs))
        return row, begin - segment.first[row], end - segment.first[row], pair // max(len(self.items), 1), pair % max(len(self.items), 1)


def blocks(benchmark: DataFrame, window: int = 13, block_words: int = 200_000) -> Iterator[Block]:
    """Cut the benchmark's windows into blocks of at most about ``block_words`` words (one item at least), streaming its rows."""
    rows, size = [], 0
    for r in benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), "text").toLocalIterator():
        rows.append(r)
        size += len(r[1]) // 4
        if size >= block_words:
            yield _block(rows, window)
            rows, size = [], 0
    if rows:
        yield _block(rows, window)


def _block(rows: list, window: int) -> Block:
    w = words(*text_bytes(pa.array([r[1] for r in rows], pa.large_string())))
    items, owner = np.unique(np.array([r[0] for r in rows], object).astype(str), return_inverse=True)
    vocabulary = np.unique(w.hash)
    term = np.searchsorted(vocabulary, w.hash).astype(np.int64)
    count = np.diff(w.first)
    length = np.minimum(count, window)
    out = Block(vocabulary, [], [], [], items.tolist())
    for k in np.unique(length[length > 0]):
        own = np.flatnonzero(length == k)
        n = count[own] - k + 1
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(w.first[own], n)
        out.windows.append(term[start[:, None] + np.arange(k)])
        out.owners.append(np.repeat(owner[own], n))
    return out.ranked(np.ones(len(vocabulary), np.int64))


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row for each segment, with its documents' keys and words in their order, and its postings.

    ``terms`` are the sorted hashes of all of its words as packed differences,
    ``counts`` the length of each word's list, ``steps`` the differences of
    positions within a list. ``segment`` numbers the rows.
    """
    kind = docs.schema[key].dataType

    def post(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, "_text", _SEGMENT):
                w = words(data, offsets)
                order = np.argsort(w.hash, kind="stable")
                h, position = w.hash[order], order + w.row[order]
                at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
                steps = np.diff(position, prepend=np.zeros(1, np.int64))
                steps[at] = position[at]
                gaps = np.diff(h[at], prepend=np.zeros(1, np.uint64))
                packed = [np.diff(w.first).astype(np.int32), np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8).T, np.diff(np.append(at, len(h))).astype(np.int32), steps.astype(np.int32)]
                keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([pack(x)], pa.binary()) for x in packed)], ["keys", "sizes", "terms", "counts", "steps"])

    schema = T.StructType([T.StructField("keys", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "terms", "counts", "steps"))])
    return stage(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(post, schema).withColumn("segment", F.monotonically_increasing_id()), "index")


def _terms(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _segments(batches, vocabulary: np.ndarray) -> Iterator[tuple[int, Segment]]:
    """Segments of rows (segment, sizes, terms, counts, steps)."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes, counts, steps = (np.frombuffer(unpack(row[c]), np.int32).astype(np.int64) for c in ("sizes", "counts", "steps"))
            yield row["segment"], Segment.stored(sizes, _terms(row["terms"]), counts, steps, vocabulary)


def word_counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How often the corpus has each word of a sorted vocabulary; reads the words and counts of the index only."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = _terms(terms)
                if len(own):
                    at = np.minimum(np.searchsorted(own, shared.value), len(own) - 1)
                    total += np.where(own[at] == shared.value, np.frombuffer(unpack(counts), np.int32)[at], 0)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(total[live])], ["i", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    found = index.select("terms", "counts").mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # one row a word of the block
    out[found["i"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    shared.destroy()
    return out


_HITS = "segment bigint, row int, hit_from array<bigint>, hit_to array<bigint>, items array<string>"


def phrase_hits(index: DataFrame, block: Block) -> DataFrame:
    """(segment, row, hit_from, hit_to, items) of every document with a hit: hit words as runs [from, to), and the items found."""
    ranked = block.ranked(word_counts(index, block.vocabulary))
    shared = index.sparkSession.sparkContext.broadcast(ranked)

    def search(batches):
        b = shared.value
        for number, segment in _segments(batches, b.vocabulary):
            row, begin, end, item_row, item = b.search(segment)
            rows = np.unique(item_row)
            if len(rows):
                lists = [pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(row, rows), len(row)), pa.int32()), pa.array(x)) for x in (begin, end)]
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(item_row, rows), len(item)), pa.int32()), pa.array([b.items[i] for i in item], pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(rows.astype(np.int32)), *lists], ["segment", "row", "hit_from", "hit_to", "items"])

    if not any(map(len, ranked.windows)):
        return index.sparkSession.createDataFrame([], _HITS)
    found = stage(index.select("segment", "sizes", "terms", "counts", "steps").mapInArrow(search, _HITS), "hits")
    shared.destroy()
    return found


def proximity_hits(index: DataFrame, queries: list[list[str]], *, slop: int) -> DataFrame:
    """(segment, row, query): documents that hold all words of a query, in any order, within a span of ``slop`` words more than it has."""
    asked = [words(*text_bytes(pa.array([" ".join(q)]))).hash for q in queries]
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked]))
    terms = [np.searchsorted(vocabulary, q).tolist() for q in asked]

    def search(batches):
        for number, segment in _segments(batches, vocabulary):
            for query, own in enumerate(terms):
                rows = segment.near(own, slop) if own else np.zeros(0, np.int64)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(rows.astype(np.int32)), pa.array(np.full(len(rows), query, np.int32))], ["segment", "row", "query"])

    return index.select("segment", "sizes", "terms", "counts", "steps").mapInArrow(search, "segment bigint, row int, query int")


def documents_of(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """(segment, row, key, n_words) of every document of an index."""
    kind = index.schema["keys"].dataType.elementType

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.frombuffer(unpack(batch.column(1)[i].as_py()), np.int32)
                keys = batch.column(2).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), batch.column(0)[i].as_py(), np.int64)), pa.array(np.arange(len(sizes), dtype=np.int32)), keys, pa.array(sizes.astype(np.int64))], ["segment", "row", key, "n_words"])

    schema = T.StructType([T.StructField("segment", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField(key, kind), T.StructField("n_words", T.LongType())])
    return index.select("segment", "sizes", "keys").mapInArrow(read, schema)


def _in_runs(runs: Column) -> Column:
    """Words in an array of runs (from, to) that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["end"]))).alias("n"), F.greatest(s["end"], x["to"]).alias("end"))
    return F.aggregate(F.array_sort(runs), start, add, lambda s: s["n"])


def verdict(n_hit: Column, n_words: Column, share: int) -> Column:
    return (n_hit > 0) & (n_hit * share >= n_words)


def _judged(index: DataFrame, benchmark: DataFrame, key: str, window: int, share: int, block_words: int) -> DataFrame:
    """key, n_words, n_hit, items and contaminated of every document of an index."""
    hits = None
    for block in blocks(benchmark, window, block_words):
        found = phrase_hits(index, block)
        hits = found if hits is None else hits.unionByName(found)
    docs = documents_of(index, key)
    if hits is None:
        hits = index.sparkSession.createDataFrame([], _HITS)
    runs = F.transform(F.arrays_zip("hit_from", "hit_to"), lambda x: F.struct(x["hit_from"].alias("from"), x["hit_to"].alias("to")))
    merged = hits.groupBy("segment", "row").agg(_in_runs(F.flatten(F.collect_list(runs))).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = docs.join(merged, ["segment", "row"], "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(key, "n_words", "n_hit", "items").withColumn("contaminated", verdict(F.col("n_hit"), F.col("n_words"), share))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, block_words: int = 200_000) -> DataFrame:
    """One row a document: its words, hit words, items found, and the verdict n_hit * share >= n_words."""
    return _judged(build_index(docs), benchmark, "doc_id", window, share, block_words)


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 13, share: int = 20, block_words: int = 200_000) -> DataFrame:
    """The rows of docs (all columns) that are not contaminated.

    A benchmark of one block is searched in one pass over the rows, in segments
    that are not stored; one of several blocks through an index of the distinct
    texts. Either way a row is judged by its own text.
    """
    parts = blocks(benchmark, window, block_words)
    block, more = next(parts, None), next(parts, None)
    if block is None:
        return docs
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")
    if more is not None:
        keyed = plain.withColumn("_key", F.sha2(f"c{at}", 256))
        texts = keyed.select("_key", F.col(f"c{at}").alias("text")).where("_key is not null").dropDuplicates(["_key"])
        bad = _judged(build_index(texts, key="_key"), benchmark, "_key", window, share, block_words).where("contaminated").select("_key")
        return keyed.join(bad, "_key", "left_anti").select(*plain.columns).toDF(*names)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def search(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, f"c{at}"):
                w = words(data, offsets)
                segment = Segment.of(w, shared.value.vocabulary)
                row, begin, end, *_ = shared.value.ranked(segment.df).search(segment)
                hit = np.bincount(row, end - begin, part.num_rows)
                keep = (hit == 0) | (hit * share < np.diff(w.first))
                yield part.filter(pa.array(keep))

    return plain.mapInArrow(search, plain.schema).toDF(*names)
