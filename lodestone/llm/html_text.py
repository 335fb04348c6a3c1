"""Main text of HTML pages: block structure, and a host suffix array.

A page becomes blocks of text. What markup names a menu, header, footer,
sidebar, notice, advert, form or comment is left out, and where a page marks its
article, the rest of the page is no candidate. All other blocks of all pages,
articles included, form the host's token stream, in which long substrings that
repeat across distinct pages are boilerplate: a string of ``long`` tokens, or a
shorter block as a whole, that stands in ``share`` of the host's distinct page
contents and in ``least`` of them. The uncovered tokens of the candidate blocks
are the text.

Since only equality to a bounded depth matters, equal suffixes of the stream
meet by a hash of (host, first ``run`` tokens) and need no total order. The array
is sparse at first: of each ``long`` tokens only the suffix with the smallest hash
is dealt out. Equal strings deal out equal suffixes, so every boilerplate string
shows. Then all suffixes next to those found are dealt out, and a run of them as
long as ``long`` tokens is covered, to its first and last token. Both rounds are
cut by host and key, in as many parts as a host of any size needs.

Defined results: null or empty html gives empty text. Character references are
decoded once, in each run of text by itself. ``br`` is white space. A tag that the
page does not close ends it, an unclosed script, style or comment runs to the
end, as in browsers; markup of any length is read once. Pages of a host with
equal candidate text are one content, so copies cover nothing of each other.
Pages without a host are compared with none. Repeated rows are judged one by
one; other columns are not read. Contents are counted by 32-bit tags, which
counts 10 million contents 0.1 % low.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import stage, tasks
from .textbytes import SOLID, VALUES, mix, text_bytes, words
from .url_filter import host_and_path

#: Possessive throughout: a tag is read once, closed or not.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)[\s/]*+>""")
NAMED = re.compile(r"</?[a-zA-Z]")
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
TELLING = re.compile(r"class|id|role|itemprop|hidden|style", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg math object canvas title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BARRED = frozenset("nav footer aside form menu dialog button select option input fieldset head".split())
BARRED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of a class or id that name what no article holds.
FOREIGN = frozenset("advert adverts advertisement advertisements advertising sponsor sponsored promo breadcrumb breadcrumbs sidebar nav navbar navigation menu comment comments disqus respond replies cookie cookies gdpr newsletter popup modal".split())
#: Parts that do so unless another part names the article's own.
DOUBTFUL = frozenset("ad ads header footer masthead banner notice notices consent share sharing social related search login signup subscribe skip widget".split())
OWN = frozenset("article post entry content body story main text title headline free no without has with".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}
_WHOLE = np.uint64(0x632BE59BD9B4E019)
_PLACE = np.uint64(28)


@lru_cache(maxsize=1 << 16)
def _foreign(name: str) -> bool:
    parts = set(re.split(r"[^a-z0-9]+", name.lower()))
    return bool(parts & FOREIGN) or bool(parts & DOUBTFUL and not parts & OWN)


def _marks(attributes: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if TELLING.search(attributes) else {}


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, 2 in an article and 1 in a main part, barred by its markup) of every block, in page order."""
    out: list[tuple[str, int, bool]] = []
    if not page:
        return out
    # (name, state before); places of each open name; place of the innermost element that is not inline.
    stack: list[tuple[str, int, bool]] = []
    places: dict[str, list[int]] = defaultdict(list)
    outer: list[int] = []
    main, barred = 0, False
    held: list[str] = []

    def end_block() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, main, barred))

    def close(to: int) -> None:
        nonlocal main, barred
        if stack[to][1:] != (main, barred):
            end_block()
        main, barred = stack[to][1:]
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            if name not in INLINE:
                outer.pop()

    at, size = 0, len(page)
    while at < size:
        left = page.find("<", at)
        if left < 0:
            left = size
        if left > at:
            held.append(entities.unescape(page[at:left]))
        if left + 1 >= size:
            held.append(page[left:])
            break
        sign, named_ = page[left + 1], NAMED.match(page, left)
        if sign in "!?/" and not named_:
            stop = page.find("-->", left + 2) + 2 if page.startswith("<!--", left) else page.find(">", left)
            at = stop + 1 if stop > left else size
            continue
        if not named_:
            held.append("<")
            at = left + 1
            continue
        m = TAG.match(page, left)
        if m is None:
            break  # a tag that never ends
        at = m.end()
        name = m[2].lower()
        if name not in INLINE:
            end_block()
        elif name == "br":
            held.append(" ")
        if m[1]:
            if places[name] and (name not in INLINE or not outer or places[name][-1] > outer[-1]):
                close(places[name][-1])
            continue
        if name in ENDS_P and places["p"]:
            close(places["p"][-1])
        elif name == "li" and places["li"] and places["li"][-1] > max([p[-1] for p in (places["ul"], places["ol"]) if p], default=-1):
            close(places["li"][-1])
        if name in VOID:
            continue
        if name in RAW:
            if page[at - 2] != "/" or name in ("script", "style", "title", "textarea"):
                end = _CLOSE[name].search(page, at)
                at = end.end() if end else size
            continue
        marks = _marks(m[3]) if m[3] else {}
        before = (main, barred)
        role = marks.get("role", "")
        named = name not in ("html", "body", "main", "article") and any(map(_foreign, (marks.get("class", "") + " " + marks.get("id", "")).split()))
        hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
        if name in BARRED or (name == "header" and not main) or role in BARRED_ROLES or hidden or named:
            barred = True
        if name == "article" or role == "article" or marks.get("itemprop") == "articlebody":
            main = 2
        elif name == "main" or role == "main":
            main = max(main, 1)
        if (main, barred) != before and held:
            now, (main, barred) = (main, barred), before
            end_block()
            main, barred = now
        if name not in INLINE:
            outer.append(len(stack))
        places[name].append(len(stack))
        stack.append((name, *before))
    end_block()
    return out


def chosen(found: list[tuple[str, int, bool]]) -> tuple[list[str], list[str]]:
    """The candidate blocks, and the other ones that markup does not bar.

    Articles, if they hold a third of the main parts' text; else the main parts; else all.
    """
    amount = [sum(len(text) for text, main, barred in found if not barred and main >= level) for level in (0, 1, 2)]
    level = 2 if amount[2] and 3 * amount[2] >= amount[1] else 1 if amount[1] else 0
    return [b[0] for b in found if not b[2] and b[1] >= level], [b[0] for b in found if not b[2] and b[1] < level]


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, text (the candidate blocks, a line each) and the other blocks' texts."""

    def read(batches):
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts, rest = [], []
            for page in batch.column(3).to_pylist():
                mine, others = chosen(blocks(page))
                texts.append("\n".join(mine))
                rest.append(others)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts, pa.string()), pa.array(rest, pa.list_(pa.string()))], ["page_id", "url", "host", "text", "rest"])

    host, _ = host_and_path(F.col("url"))
    page_id = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(read, f"page_id {page_id}, url string, host string, text string, rest array<string>")


class _Stream:
    """Suffix heads of some blocks of text, each named by its host too."""

    def __init__(self, texts: pa.Array, host: np.ndarray, run: int, long: int):
        self.words = w = words(*text_bytes(texts.cast(pa.large_string())), SOLID, VALUES)
        count = np.diff(w.first)
        heads = np.where(count >= long, count - run + 1, 0)
        self.first = np.concatenate([[0], np.cumsum(heads)])
        self.block = np.repeat(np.arange(len(count)), heads)
        #: The token that each suffix begins with.
        self.at = np.arange(len(self.block)) - self.first[self.block] + w.first[self.block]
        head = np.zeros(len(self.block), np.uint64)
        for j in range(run):
            head = head * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[self.at + j]
        self.key = mix(mix(head) ^ host[self.block])
        self.short = np.flatnonzero((count > 0) & (count < long))
        whole = np.zeros(len(self.short), np.uint64)
        for j in range(long - 1):
            live = count[self.short] > j
            whole[live] = whole[live] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[w.first[self.short[live]] + j]
        self.short_key = mix(mix(whole + _WHOLE * count[self.short].astype(np.uint64)) ^ host[self.short])
        self.width = long - run + 1

    def sampled(self) -> np.ndarray:
        """The suffix of smallest key of each ``long`` tokens."""
        n, width = len(self.key), self.width
        if n < width:
            return np.zeros(0, np.int64)
        order = (self.key >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64)
        reach, low = 1, order
        while reach * 2 <= width:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        start = np.flatnonzero(self.block[: n - width + 1] == self.block[width - 1 :])
        return np.unique((np.minimum(low[start], low[start + width - reach]) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64))

    def beside(self, hit: np.ndarray) -> np.ndarray:
        """All suffixes of a block less than ``width`` away from the given ones."""
        mark = np.zeros(len(self.key) + 1, np.int64)
        np.add.at(mark, np.maximum(hit - self.width + 1, self.first[self.block[hit]]), 1)
        np.add.at(mark, np.minimum(hit + self.width, self.first[self.block[hit] + 1]), -1)
        return np.flatnonzero(np.cumsum(mark[:-1]))

    def covered(self, hit: np.ndarray, run: int) -> np.ndarray:
        """Tokens of the runs of suffixes in ``hit`` (a mask) that come to ``long`` tokens."""
        edge = np.flatnonzero(np.concatenate([[True], (self.block[1:] != self.block[:-1]) | (hit[1:] != hit[:-1])])) if len(hit) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(hit)))
        live = (size >= self.width) & hit[edge] if len(edge) else np.zeros(0, bool)
        mark = np.zeros(len(self.words.hash) + 1, np.int64)
        mark[self.at[edge[live]]] += 1
        np.add.at(mark, self.at[edge[live]] + size[live] + run - 1, -1)
        return np.cumsum(mark[:-1]) > 0


def _known(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(key), bool)
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


_DEALT = "hk bigint, part int, tags binary, sizes binary, keys binary"


def _dealt(page: np.ndarray, key: np.ndarray, host: np.ndarray, content: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    """Keys of pages by (host, part of it); a content's keys lie together and are named once."""
    part = ((key >> np.uint64(32)) % parts[page].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((key, content[page], part, host[page]))
    page, key, part = page[order], key[order], part[order]
    h, c = host[page], content[page]
    same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    new = np.concatenate([[True], ~(same & (c[1:] == c[:-1]) & (key[1:] == key[:-1]))])[: len(key)]
    h, c, key, part = h[new], c[new], key[new], part[new]
    same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
    group = np.flatnonzero(np.concatenate([[True], ~same])[: len(key)])
    named = np.flatnonzero(np.concatenate([[True], ~(same & (c[1:] == c[:-1]))])[: len(key)])
    size, tag = np.diff(np.append(named, len(key))).astype(np.int32), c[named].astype(np.uint32)
    to = np.append(group[1:], len(key))
    cut, cut_to = np.searchsorted(named, group), np.searchsorted(named, to)
    slices = list(zip(group, to, cut, cut_to, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(h[group].view(np.int64)), pa.array(part[group].astype(np.int32)), pa.array([tag[k:m].tobytes() for *_, k, m in slices], pa.binary()), pa.array([size[k:m].tobytes() for *_, k, m in slices], pa.binary()), pa.array([key[i:j].tobytes() for i, j, *_ in slices], pa.binary())], ["hk", "part", "tags", "sizes", "keys"])


def _blocks_of(batch: pa.RecordBatch, others: bool) -> tuple[pa.Array, np.ndarray]:
    """Blocks of ``text`` and, if asked for, ``rest``, and each one's page."""
    lists = [pc.split_pattern(batch.column(batch.schema.get_field_index("text")), "\n")]
    if others:
        lists.append(batch.column(batch.schema.get_field_index("rest")))
    page = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in lists]).astype(np.int64)
    return pa.concat_arrays([pc.list_flatten(x).cast(pa.large_string()) for x in lists]), page


def _keys_of(column: pa.Array) -> np.ndarray:
    """All keys of a column of key lists that repeat for a host, sorted."""
    return np.unique(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def extract(pages: DataFrame, *, run: int = 6, long: int = 12, share: float = 0.5, least: int = 4, part_contents: int = 4000) -> DataFrame:
    """page_id, url and text of every page."""
    spark = pages.sparkSession
    named = parse(pages).withColumn("hk", F.when(F.col("host") != "", F.xxhash64(F.lit(53), "host"))).withColumn("content", F.xxhash64(F.lit(59), "host", "text"))
    parsed = stage(named.drop("host"), "parsed")
    hosted = parsed.where("hk is not null")
    sizes = stage(hosted.select("hk", "content").distinct().groupBy("hk").agg(F.count(F.lit(1)).alias("contents")), "sizes")
    # A row for each ``part_contents`` contents at most.
    large = F.broadcast(sizes.where(F.col("contents") > part_contents).select(F.col("hk").alias("_hk"), F.ceil(F.col("contents") / part_contents).cast("int").alias("parts")))

    def split(df: DataFrame) -> DataFrame:
        return df.join(large, F.col("hk") == F.col("_hk"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("_hk")

    def deal(find):
        """Deal out the keys that ``find`` picks of a batch's stream, as places among suffixes."""
        def give(batches):
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                host, content, parts = (batch.column(i).to_numpy() for i in range(3))
                texts, page = _blocks_of(batch, True)
                stream = _Stream(texts, host.view(np.uint64)[page], run, long)
                at, whole = find(stream, batch)
                owner = np.concatenate([page[stream.block[at]], page[stream.short[whole]]])
                if len(owner):
                    yield _dealt(owner, np.concatenate([stream.key[at], stream.short_key[whole]]), host.view(np.uint64), content.view(np.uint64), parts)

        return give

    def meet(table: pa.Table) -> pa.Table:
        """Keys of a part of a host that stand in ``least`` contents, and in how many."""
        def whole(name, t):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), t)

        key, tag = whole("keys", np.uint64), np.repeat(whole("tags", np.uint32), whole("sizes", np.int32))
        order = np.lexsort((tag, key))
        key, tag = key[order], tag[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])])[: len(key)]
        key, n = np.unique(key[new], return_counts=True)
        key, n = key[n >= least], n[n >= least]
        return pa.table([pa.array(np.full(len(key), table.column("hk")[0].as_py(), np.int64)), pa.array(key.view(np.int64)), pa.array(n)], ["hk", "key", "n"])

    def spread(dealt: DataFrame, label: str) -> DataFrame:
        """(_hk, keys): the boilerplate keys of each host; there are at most 1 / share times the mean content's suffixes."""
        met = dealt.repartition(tasks(spark), "hk", "part").groupBy("hk", "part").applyInArrow(meet, "hk bigint, key bigint, n bigint")
        common = met.join(sizes, "hk").where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("contents") * share)))
        return stage(common.groupBy("hk").agg(F.sort_array(F.collect_list("key")).alias("keys")).withColumnRenamed("hk", "_hk"), label)

    first = spread(split(hosted).select("hk", "content", "parts", "text", "rest").mapInArrow(deal(lambda stream, batch: (stream.sampled(), np.arange(len(stream.short)))), _DEALT), "sampled")

    def near(stream: _Stream, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys = _keys_of(batch.column(5))
        return stream.beside(np.flatnonzero(_known(keys, stream.key))), np.flatnonzero(_known(keys, stream.short_key))

    asked = split(hosted.join(first, F.col("hk") == F.col("_hk")).drop("_hk"))
    cover = spread(asked.select("hk", "content", "parts", "text", "rest", "keys").mapInArrow(deal(near), _DEALT), "covered")
    judged = parsed.select("page_id", "url", "text", "hk").join(cover, F.col("hk") == F.col("_hk"), "left").select("page_id", "url", "text", "hk", "keys")

    def finish(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            out, keys = batch.column(2), _keys_of(batch.column(4))
            if len(keys):
                host = batch.column(3).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                listed, page = _blocks_of(batch, False)
                stream = _Stream(listed, host[page], run, long)
                gone = stream.covered(_known(keys, stream.key), run)
                whole = stream.short[_known(keys, stream.short_key)]
                held = listed.to_pylist()
                for i in whole:
                    held[i] = ""
                for i in np.unique(np.searchsorted(stream.words.first, np.flatnonzero(gone), "right") - 1):
                    tokens = held[i].split(" ")
                    held[i] = " ".join(t for t, g in zip(tokens, gone[stream.words.first[i] : stream.words.first[i + 1]], strict=True) if not g)
                lines: list[list[str]] = [[] for _ in range(batch.num_rows)]
                for p, text in zip(page, held, strict=True):
                    if text:
                        lines[p].append(text)
                out = pa.array(["\n".join(x) for x in lines], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["page_id", "url", "text"])

    page_id = pages.schema["page_id"].dataType.simpleString()
    return judged.mapInArrow(finish, f"page_id {page_id}, url string, text string")
