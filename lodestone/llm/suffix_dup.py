"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

Suffixes need ordering only through ``window`` bytes, most significant digit
first, and a group that holds a single document is dropped after each pass.

1. The leading digit is sparse: of each window only its anchor, the run of about
   half a window's bytes that has the smallest hash within it, is dealt out.
   Equal windows have equal anchors at equal places, so a window whose anchor no
   other document has is unique.
2. Windows of surviving anchors are ordered within their block of documents: by
   anchor and place, then by the window's own bytes, eight at a time. Those that
   a smaller document of the block holds are settled, and the others travel with
   their bytes.
3. By anchor, the travelling windows of all blocks are ordered in the same way:
   in each group of equal windows all but the smallest document's are repeated.
4. The marks return to their documents, whose covered bytes are cut out.

Hashes only choose and group candidates; what is equal is decided by bytes. A
task sends one entry for an anchor that many of its documents share, and a block
one for a window, so a passage that a third of all documents hold arrives once a
block. Blocks hold about ``block_bytes`` of text (one text at least) and are far
more than the tasks, whose number is the session's; texts of any length are read
in segments. Larger blocks send fewer entries for a hot passage.

Defined results: null text is empty; texts shorter than the window lose nothing.
Windows never cross documents. Rows that repeat a doc_id are one document for
"smaller", so they take nothing from each other. A null doc_id neither gives nor
loses. An empty table gives an empty result. ``doc_id`` is an integer; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tasks
from .textbytes import VALUES, mix, pack, pieces, powers, text_bytes, unpack

_PLACE = 21
#: Bytes of a segment: a place in one fits in ``_PLACE`` bits.
_SEGMENT = 512 << 10
#: Anchors that a task gathers before it sends them.
_FLUSH = 1 << 21
_TEXTS = 16 << 20
_LOW = np.uint64((1 << 32) - 1)
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _whole(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(unpack(x) for x in table.column(name).to_pylist()), kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which pack better than the numbers; each entry starts anew."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def _sums(table: pa.Table, name: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(unpack(x), np.int64)) for x in table.column(name).to_pylist())])


def _prefix(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def _segments(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1): about ``_SEGMENT`` bytes each, and every window in just one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _SEGMENT, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if j == i + 1 and high - low > _SEGMENT:
            for at in range(low, high - window + 1, _SEGMENT):
                yield i, j, at, min(at + _SEGMENT + window - 1, high)
        else:
            yield i, j, low, high
        i = j


def anchors(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of windows with one anchor: the anchor's hash and place, and the run's first and last window.

    A window of 50 bytes has 25 candidates of 26 bytes.
    """
    gram = window // 2 + 1
    bits = np.uint64(_PLACE)
    for i, j, low, high in _segments(offsets, window):
        bounds = np.clip(offsets[i : j + 1], low, high) - low
        part, size = data[low:high], np.diff(bounds)
        live = np.flatnonzero(size >= window)
        if not len(live):
            continue
        total = _prefix(part)
        hashes = mix((total[gram:] - total[:-gram]) * powers(len(total))[1][: len(total) - gram])
        mark = np.zeros(len(part) + 1, np.int8)
        mark[bounds[live]] += 1
        np.add.at(mark, bounds[live] + size[live] - window + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1], dtype=np.int8))
        key = hashes >> bits
        key <<= bits
        key |= np.arange(len(key), dtype=np.uint64)
        width, reach = window - gram + 1, 1
        while reach * 2 <= width:
            key = np.minimum(key[: len(key) - reach], key[reach:])
            reach *= 2
        key = np.minimum(key[: len(key) - (width - reach)], key[width - reach :])
        anchor = (key[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.append(edge[1:], len(starts)) - 1
        at = anchor[edge]
        # Anchors are small hashes: spread them again.
        yield mix(hashes[at]), at + low, starts[edge] + low, starts[last] + low


def repeated(lead: np.ndarray, data: np.ndarray, place: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes over the windows at ``place``, by ``lead`` and then by their bytes, eight a digit.

    Says which windows a smaller document holds, and which are their group's smallest document's or alone.
    """
    out, least = np.zeros(len(place), bool), np.ones(len(place), bool)
    if not len(place):
        return out, least
    offsets = [*range(0, window - 7, 8), window - 8]
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), np.uint64, data, strides=(1,))

    def shared(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the groups that hold a single document: in those no two neighbours differ."""
        edge, own = np.flatnonzero(new), doc[order]
        differs = np.zeros(len(order), bool)
        differs[1:] = (own[1:] != own[:-1]) & ~new[1:]
        keep = np.repeat(np.logical_or.reduceat(differs, edge), np.diff(np.append(edge, len(order))))
        return order[keep], new[keep]

    def settle(order: np.ndarray, new: np.ndarray) -> None:
        """Each group is one window: its smallest document keeps it."""
        if len(order):
            own = doc[order]
            low = np.minimum.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
            out[order] = own > low
            least[order] = own == low

    order = np.argsort(lead)
    key = lead[order]
    order, new = shared(order, np.concatenate([[True], key[1:] != key[:-1]]))
    if not len(order):
        return out, least
    at = place[order]
    differs = np.zeros(len(order) - 1, bool)
    for offset in offsets:
        digit = eight[at + offset]
        differs |= digit[1:] != digit[:-1]
    differs &= ~new[1:]
    if not differs.any():
        settle(order, new)
        return out, least
    # Groups whose digits are all alike are in order already; the others are ordered digit by digit.
    group = np.cumsum(new) - 1
    several = np.zeros(group[-1] + 1, bool)
    several[group[1:][differs]] = True
    several = several[group]
    settle(order[~several], new[~several])
    order, new = order[several], new[several]
    for offset in offsets:
        if not len(order):
            break
        digit = eight[place[order] + offset].byteswap()
        rank = np.lexsort((digit, np.cumsum(new)))
        order, digit = order[rank], digit[rank]
        new[1:] |= digit[1:] != digit[:-1]
        order, new = shared(order, new)
    settle(order, new)
    return out, least


def _runs(at: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of maximal runs of consecutive ``at`` with equal ``extra``; both sorted."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (extra[1:] != extra[:-1])]))
    return edge, np.diff(np.append(edge, len(at)))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs [first, last], and the run of each."""
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def _split(bucket: np.ndarray):
    bound = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for i, j in zip(bound[:-1], bound[1:], strict=True):
        yield int(bucket[i]), slice(int(i), int(j))


_PACKED = "kind int, part int, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """kind, part, and three packed columns."""
    columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(2)] + [pa.array([pack(r[i]) for r in rows], pa.binary()) for i in range(2, 5)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "part", "a", "b", "c"])


def _none() -> np.ndarray:
    return np.zeros(0, np.uint8)


def _target(doc: np.ndarray, parts: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """Texts packed by the block of their doc_id."""
    def gather(batches):
        for batch in batches:
            for part, data, offsets in pieces(batch, limit=_TEXTS):
                ids = part.column(0).to_numpy()
                target = _target(ids, parts)
                order = np.argsort(target, kind="stable")
                rows = []
                for t, s in _split(target[order]):
                    own = order[s]
                    text = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in own])
                    rows.append((0, t, ids[own], np.diff(offsets)[own], text))
                yield _rows(rows)

    return docs.select("doc_id", "text").mapInArrow(gather, _PACKED)


class _Block:
    """The documents of one block, in order of id and text, so that a row number means the same in every pass."""

    def __init__(self, table: pa.Table):
        ids, size, text = _whole(table, "a", np.int64), _whole(table, "b", np.int64), _whole(table, "c", np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])
        raw = [text[at[i] : at[i + 1]].tobytes() for i in range(len(ids))]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        self.ids = ids[order]
        self.raw = [raw[i] for i in order]
        self.offsets = np.concatenate([[0], np.cumsum(size[order])])

    @property
    def data(self) -> np.ndarray:
        return np.frombuffer(b"".join(self.raw), np.uint8)


def remove_repeats(docs: DataFrame, *, window: int = 50, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (the removed runs [from, to)) of every row."""
    if window < 16:
        raise ValueError("a window has 16 bytes at least")
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = given.where("doc_id is not null")
    total_bytes = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(4, (total_bytes // block_bytes).bit_length())
    shift = np.uint64(64 - (parts.bit_length() - 1))

    def dealt(df: DataFrame) -> DataFrame:
        # The work is far more than the packed bytes tell, so the number of tasks is set.
        return df.repartition(tasks(spark), "part")

    def lead(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            h, doc = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            h, doc = h[new], doc[new]
            fresh = np.concatenate([[True], h[1:] != h[:-1]])
            many = (np.diff(np.append(np.flatnonzero(fresh), len(h))) > 1).astype(np.uint8)
            one_h, one = h[fresh], doc[fresh]
            bucket = (one_h >> shift).astype(np.int64)
            order = np.lexsort((one, bucket))
            rows = [(0, b, (one_h[order[s]] & _LOW).astype(np.uint32), _steps(one[order[s]]), many[order[s]]) for b, s in _split(bucket[order])]
            # The anchor's other documents are known to share it: they need not meet it again.
            rest_h, rest = (h[~fresh] & _LOW).astype(np.uint32), doc[~fresh]
            target = _target(rest, parts)
            order = np.lexsort((rest, target))
            rows += [(1, t, rest_h[order[s]], _steps(rest[order[s]]), _none()) for t, s in _split(target[order])]
            return _rows(rows)

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for h, _, first, _ in anchors(data, offsets, window):
                held.append((h, ids[np.searchsorted(offsets, first, "right") - 1]))
                size += len(h)
                if size >= _FLUSH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def meet(table: pa.Table) -> pa.Table:
        """Entries of documents pass; of a bucket of anchors those go on that several documents have."""
        if table.column("kind")[0].as_py() == 1:
            return table
        h, doc, many = _whole(table, "a", np.uint32), _sums(table, "b"), _whole(table, "c", np.uint8)
        _, word, times = np.unique(h, return_inverse=True, return_counts=True)
        live = (times[word] > 1) | (np.bincount(word, many, len(times))[word] > 0)
        h, doc = h[live], doc[live]
        target = _target(doc, parts)
        order = np.lexsort((doc, target))
        return pa.Table.from_batches([_rows([(1, t, h[order[s]], _steps(doc[order[s]]), _none()) for t, s in _split(target[order])])])

    shared = dealt(own.mapInArrow(lead, _PACKED)).groupBy("kind", "part").applyInArrow(meet, _PACKED)

    def order_block(texts: pa.Table, found: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([_rows([])])
        if not texts.num_rows or not found.num_rows:
            return empty
        block = _Block(texts)
        data, offsets = block.data, block.offsets
        # (document, anchor) pairs that survived; a pair too many costs time only.
        pair = lambda x, d: mix(x.astype(np.uint64) + mix(d.view(np.uint64)))
        known = np.unique(pair(_whole(found, "a", np.uint32), _sums(found, "b")))
        chosen = []
        for h, at, first, last in anchors(data, offsets, window):
            row = np.searchsorted(offsets, first, "right") - 1
            mine = pair(h & _LOW, block.ids[row])
            live = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
            chosen.append((h[live], at[live], first[live], last[live], row[live]))
        if not chosen:
            return empty
        h, anchor, first, last, row = (np.concatenate([x[i] for x in chosen]) for i in range(5))
        place, run = _spread(first, last)
        gone, least = repeated(h[run] + (place - anchor[run]).view(np.uint64) * _STEP, data, place, block.ids[row[run]], window)
        rows = []
        number = int(texts.column("part")[0].as_py())
        edge, n = _runs(place[gone], row[run[gone]])
        if len(edge):
            r = row[run[gone]][edge]
            rows.append((1, number, r.astype(np.int32), place[gone][edge] - offsets[r], n.astype(np.int32)))
        # The smallest document's windows travel, with all repeats within it.
        rest, own_run = place[least], run[least]
        edge, n = _runs(rest, own_run)
        at, own_run = rest[edge], own_run[edge]
        bucket = (h[own_run] >> shift).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        for b, s in _split(bucket[order]):
            mine = order[s]
            r = row[own_run[mine]]
            bytes_at, _ = _spread(at[mine], at[mine] + n[mine] + window - 2)
            head = np.concatenate([[len(mine), number], _steps(block.ids[r]), _steps(r), at[mine] - offsets[r], n[mine], at[mine] - anchor[own_run[mine]]])
            rows.append((0, b, head, (h[own_run[mine]] & _LOW).astype(np.uint32), data[bytes_at]))
        return pa.Table.from_batches([_rows(rows)])

    # Both passes over the texts read one exchange of them; text is packed, as Spark moves a third less of it so.
    packed = dealt(_texts(own, parts)).groupBy("part")
    ordered = packed.cogroup(dealt(shared).groupBy("part")).applyInArrow(order_block, _PACKED)

    def order_bucket(table: pa.Table) -> pa.Table:
        """Marks of blocks pass; a bucket of travelling windows is ordered."""
        if table.column("kind")[0].as_py() == 1:
            return table
        heads = []
        for x in table.column("a").to_pylist():
            head = np.frombuffer(unpack(x), np.int64)
            own_ = head[2:].reshape(5, -1).copy()
            own_[:2] = np.cumsum(own_[:2], axis=1)
            heads.append(np.vstack([own_, np.full(head[0], head[1])]))
        doc, row, start, n, away, target = np.hstack(heads)
        low, data = _whole(table, "b", np.uint32), _whole(table, "c", np.uint8)
        begin = np.concatenate([[0], np.cumsum(n + window - 1)])[:-1]
        place, run = _spread(begin, begin + n - 1)
        key = low.astype(np.uint64) * _SPREAD
        gone, _ = repeated(key[run] + (place - begin[run] + away[run]).view(np.uint64) * _STEP, data, place, doc[run], window)
        edge, length = _runs(place[gone], run[gone])
        own_run = run[gone][edge]
        begin_at = place[gone][edge] - begin[own_run] + start[own_run]
        order = np.argsort(target[own_run], kind="stable")
        rows = [(1, t, row[own_run][order[s]].astype(np.int32), begin_at[order[s]], length[order[s]].astype(np.int32)) for t, s in _split(target[own_run][order])]
        return pa.Table.from_batches([_rows(rows)])

    marks = dealt(ordered).groupBy("kind", "part").applyInArrow(order_bucket, _PACKED)
    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<from: bigint, to: bigint>>"

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(6)]
        if texts.num_rows:
            block = _Block(texts)
            if found.num_rows:
                row, start, n = _whole(found, "a", np.int32), _whole(found, "b", np.int64), _whole(found, "c", np.int32)
            else:
                row, start, n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
            order = np.argsort(row, kind="stable")
            bound = np.searchsorted(row[order], np.arange(len(block.ids) + 1))
            for i, raw in enumerate(block.raw):
                own = order[bound[i] : bound[i + 1]]
                spans = []
                for a, b in sorted(zip(start[own].tolist(), (start[own] + n[own] + window - 1).tolist(), strict=True)):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                for column, x in zip(columns, (int(block.ids[i]), len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"from": a, "to": b} for a, b in spans]), strict=True):
                    column.append(x)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = packed.cogroup(dealt(marks).groupBy("part")).applyInArrow(cut, result)
    raw = F.col("text").cast("binary")
    lone = given.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), F.array().cast("array<struct<from: bigint, to: bigint>>").alias("spans"))
    return out.unionByName(lone)
