"""Language ID by bit-sliced Bloom filters of character n-grams.

Each learned language has a Bloom filter of the letter trigrams that are usual
in it. The filters share their hash functions and are stored sliced: row i
holds bit i of every language, so the AND of a trigram's k rows is a bitmask of
all languages that contain it. A document's bits are counted by language, each
count is corrected for its filter's false positives, and the language with the
largest corrected share of the document's trigrams wins.

Defined results: null text, empty text and text without a letter give ``und``
with score 0. Ties go to the language that sorts first. Repeated rows are
judged one by one. Null ids count as held out. Without training rows every
text is ``und``, and an empty table gives an empty result. Texts may be of any
length: they are worked on in segments. Only the named columns are read, so extra
columns may bear any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import id_crc, stage
from .textbytes import text_bytes

UNDECIDED = "und"
_HASHES = 3
#: Bytes of text that are worked on at once, whatever the length of a text.
_SEGMENT = 128 << 10
_folded: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Each letter's lower case; a space for every other sign."""
    if not _folded:
        signs = (chr(c) for c in range(0x110000))
        _folded.append(np.fromiter((ord(c.lower()[0]) if c.isalpha() else 0x20 for c in signs), np.uint32, 0x110000))
    return _folded[0]


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and folded code point of each sign of UTF-8 bytes; a byte that begins no sign is none."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint32)
    wide = np.flatnonzero(code >= 0xC0)
    if len(wide):
        lead, full = code[wide], np.append(data, np.zeros(3, np.uint8))
        one, two, three = (full[at[wide] + i].astype(np.uint32) & 0x3F for i in (1, 2, 3))
        long = np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three)
        code[wide] = np.minimum(np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, long), 0x10FFFF)
    return at, _fold()[code]


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every letter: its row, and the letter with both neighbours; other signs and a text's ends count as a space.

    Works through the bytes in segments, so a text may be of any length.
    """
    bounds = offsets[np.diff(offsets, append=len(data)) > 0] if len(offsets) else offsets
    low = 0
    while low < len(data):
        high = min(low + _SEGMENT, len(data))
        # With a whole sign more on each side: no sign has over four bytes.
        left, right = max(low - 4, 0), min(high + 8, len(data))
        at, code = _signs(data[left:right])
        at = at + left
        edge = np.searchsorted(at, bounds[np.searchsorted(bounds, left) : np.searchsorted(bounds, right)])
        before, after = np.full(len(code), 0x20, np.uint32), np.full(len(code), 0x20, np.uint32)
        before[1:], after[:-1] = code[:-1], code[1:]
        before[edge[edge < len(code)]] = 0x20
        after[edge[edge > 0] - 1] = 0x20
        own = np.flatnonzero((code != 0x20) & (at >= low) & (at < high))
        key = before[own].astype(np.uint64) << np.uint64(42) | code[own].astype(np.uint64) << np.uint64(21) | after[own].astype(np.uint64)
        yield np.searchsorted(offsets, at[own], "right") - 1, key
        low = high


def _slots(key: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """The k filter rows of each key, by double hashing."""
    a = key * np.uint64(0x9E3779B97F4A7C15)
    a = a ^ (a >> np.uint64(29))
    b = (a * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
    shift = np.uint64(64 - (rows.bit_length() - 1))
    for i in range(_HASHES):
        yield ((a + np.uint64(i) * b) * np.uint64(0x94D049BB133111EB)) >> shift


@dataclass
class LanguageModel:
    languages: list[str]
    #: Row i, word w: bit i of languages 64 w to 64 w + 63.
    slices: np.ndarray
    false_positive: np.ndarray
    #: Share of a language's own trigrams that its filter was built to hold.
    coverage: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, size = len(texts), len(self.languages)
        count, hits = np.zeros(n), np.zeros((n, size))
        for row, key in _grams(*text_bytes(texts)):
            if not len(key):
                continue
            low, high = int(row[0]), int(row[-1]) + 1
            row -= low
            count[low:high] += np.bincount(row, minlength=high - low)
            for w in range(self.slices.shape[1] if size else 0):
                mask = None
                for slot in _slots(key, len(self.slices)):
                    got = self.slices[slot, w]
                    mask = got if mask is None else mask & got
                for lang in range(64 * w, min(size, 64 * w + 64)):
                    bit = mask.dtype.type(1 << (lang - 64 * w))
                    hits[low:high, lang] += np.bincount(row[(mask & bit) != 0], minlength=high - low)
        if not size:
            return [UNDECIDED] * n, np.zeros(n), count
        n_grams = np.maximum(count, 1)[:, None]
        share = np.clip((hits / n_grams - self.false_positive) / (1 - self.false_positive), 0, 1)
        share = np.minimum(share / self.coverage, 1)
        best = share.argmax(1)
        score = np.where(count > 0, share[np.arange(n), best], 0.0)
        return [self.languages[b] if c else UNDECIDED for b, c in zip(best, count, strict=True)], score, count


def train(docs: DataFrame, *, sample_rows: int = 8000, min_share: float = 2e-5, min_ratio: float = 0.08, text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """Learn filters from whole texts with a non-null language.

    About ``sample_rows`` rows of each language, chosen by a hash of the key,
    are learned from; that bound is the only sampling. A language holds a
    trigram that makes up ``min_share`` of its trigrams (so at most
    1 / min_share are kept) and is not ``min_ratio`` times rarer in it than in
    another one, which keeps quotations of other languages out.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(3), "k"), 11).cast("double") / float(1 << 53)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], np.zeros((1, 1), np.uint8), np.zeros(0), np.zeros(0))
    limit = F.lit(0.0)
    for name, n in sizes.items():
        limit = F.when(F.col("lang") == name, F.lit(min(1.0, sample_rows / n))).otherwise(limit)

    def count(batches):
        for batch in batches:
            names, own = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
            for row, grams in _grams(*text_bytes(batch.column(1))):
                for i in np.unique(own[row]):
                    keys, n = np.unique(grams[own[row] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = rows.where(unit < limit).select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = stage(counted, "trigrams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    least = F.lit(0)
    for name in languages:
        least = F.when(F.col("lang") == name, F.lit(max(2.0, min_share * totals[name]))).otherwise(least)
    kept = counted.where(F.col("n") >= least).toPandas()
    kept["f"] = kept["n"] / kept["lang"].map(totals)
    kept = kept[kept["f"] >= min_ratio * kept.groupby("gram")["f"].transform("max")]
    most = max(1, int(kept.groupby("lang").size().max() if len(kept) else 1))
    m = 1 << max(10, int(np.ceil(np.log2(6 * most))))
    size = len(languages)
    kind = next(t for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 1 << 30)) if size <= b)
    slices = np.zeros((m, (size + 63) // 64), kind)
    coverage = np.ones(size)
    for at, name in enumerate(languages):
        own = kept[kept["lang"] == name]
        coverage[at] = max(own["f"].sum(), 0.05)
        for slot in _slots(own["gram"].to_numpy(np.int64).view(np.uint64), m):
            np.bitwise_or.at(slices[:, at // 64], slot, kind(1 << (at % 64)))
    fill = np.array([((slices[:, at // 64] >> kind(at % 64)) & kind(1)).mean() for at in range(size)])
    return LanguageModel(languages, slices, fill**_HASHES, coverage)


def identify(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns of docs with lang_pred, score and n_grams of every row."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def judge(batches):
        for batch in batches:
            names, score, n = shared.value.predict(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score), pa.array(n.astype(np.int64))], schema.names)

    return docs.select(*keep, *([] if text in keep else [F.col(text).alias("_text")])).mapInArrow(judge, schema)


def language_id(docs: DataFrame, *, fold_count: int = 3, held: int = 1, **options) -> DataFrame:
    """Learn from all folds but ``held`` and judge every row."""
    own = docs.select("doc_id", "text", "lang").withColumn("held_out", (id_crc() % fold_count == held) | F.col("doc_id").isNull())
    model = train(own.where(~F.col("held_out")), **options)
    return identify(own, model, keep=["doc_id", "held_out"])
