"""Words of whole text columns as numpy arrays, without a Python object a word.

A piece is the UTF-8 bytes of some rows laid end to end. Word hashes come from
one prefix sum of byte values times powers of an odd number modulo 2**64, so a
text of any length costs the same for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 64)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers[0][:n], _powers[1][:n]


_CODEC = pa.Codec("zstd", compression_level=1)


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array, compressed if that pays."""
    raw = np.ascontiguousarray(x).tobytes()
    if len(raw) < 128:
        return b"\0" + raw
    return b"\1" + len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(x: bytes) -> bytes:
    return x[1:] if x[:1] == b"\0" else _CODEC.decompress(x[9:], int.from_bytes(x[1:9], "little"), asbytes=True)


def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
    if fold:
        v[65:91] = v[97:123]
    return v


VALUES, FOLDED = _byte_values(False), _byte_values(True)
#: Word bytes once A-Z is lower-cased: digits, letters and all bytes beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False
#: All but the six white-space bytes.
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` bytes of text, never splitting a row."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    n, i = batch.num_rows, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: Words of row i are first[i] to first[i + 1].
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ALNUM, values: np.ndarray = FOLDED) -> Words:
    """Maximal runs of ``inside`` bytes in each row, with a 64-bit hash of each."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    solid = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``k`` words; a shorter row's words are one run."""
    count = np.diff(w.first)
    full = np.maximum(count - k + 1, 0)
    row = np.repeat(np.arange(len(count)), full)
    at = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(w.first[:-1], full)
    h = np.zeros(len(row), np.uint64)
    for j in range(k):
        h = h * _U(0xC2B2AE3D27D4EB4F) + w.hash[at + j]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        g = np.zeros(len(short), np.uint64)
        for j in range(k):
            live = count[short] > j
            g[live] = g[live] * _U(0xC2B2AE3D27D4EB4F) + w.hash[w.first[short[live]] + j]
        g = g + count[short].astype(np.uint64)
        row, h = np.concatenate([row, short]), np.concatenate([h, g])
    return row, mix(h)
