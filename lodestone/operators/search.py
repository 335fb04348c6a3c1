"""Search: index, retrieval, ranking, and what the logs teach."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lexicon, query as qy
from ..functions.exprs import count_if, half_up
from ..functions.text import keywords, loose_regex, normal, normal_token, normalize

c = F.col


def index(documents: DataFrame) -> DataFrame:
    """Derived title features of documents (id, title, content, ...)."""
    words = F.split(F.trim("title"), " +")
    return documents.withColumns({"has_numbers": c("title").rlike("[0-9]"), "word_count": F.size(words), "title_length": F.char_length("title"), "primary_keyword": F.lower(F.substring_index(F.trim("title"), " ", 1))})


def postings(documents: DataFrame, text: str = "content", only: Sequence[str] | None = None) -> DataFrame:
    """(token, id, tf): an inverted index as a DataFrame.

    ``only`` (words, or prefixes with a trailing *) cuts a column of normalised
    text to the rows that hold any of them before it takes their tokens apart.
    """
    if only is not None:
        documents = documents.where(_or([c(text).contains(w.rstrip("*")) for w in only]))
    tokens = documents.select("id", F.explode(keywords(c(text), unique=False)).alias("token"))
    if only is not None:
        tokens = tokens.where(_or([c("token").startswith(w[:-1]) if w.endswith("*") else c("token") == w for w in only]))
    return tokens.groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def store_postings(postings_: DataFrame, path: str, buckets: int = 64) -> None:
    """Write postings in folders by a hash of the token, sorted by token, so that a search reads its words' folders only."""
    dealt = postings_.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stored_postings(spark, path: str, words: Sequence[str] | None = None, buckets: int = 64) -> DataFrame:
    """Stored postings, of some whole words only if given; a prefix may stand in any folder."""
    rows = spark.read.parquet(path)
    if words is not None and not any(w.endswith("*") for w in words):
        own = spark.range(1).select(F.array(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int") for w in words])).first()[0]
        rows = rows.where(c("bucket").isin(*own) & c("token").isin(*words))
    return rows.drop("bucket")


def retrieve(index_: DataFrame, groups: Sequence[Sequence[str]], mode: str = "and", exclude: Sequence[str] = ()) -> DataFrame:
    """(id, hits, tf): documents with a word of every group (``and``) or of any (``or``). A trailing * is a prefix."""
    def match(word: str) -> Column:
        return c("token").startswith(word[:-1]) if word.endswith("*") else c("token") == word

    def any_of(words: Sequence[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | match(w)
        return out

    wanted = any_of([w for g in groups for w in g])
    found = index_.where(wanted).groupBy("id").agg(*[F.bool_or(any_of(g)).alias(f"g{i}") for i, g in enumerate(groups)], F.sum("tf").alias("tf"))
    hits = sum((F.when(c(f"g{i}"), 1).otherwise(0) for i in range(len(groups))), F.lit(0))
    out = found.select("id", hits.alias("hits"), "tf").where(c("hits") >= (len(groups) if mode == "and" else 1))
    if exclude:
        out = out.join(index_.where(any_of(exclude)).select("id"), "id", "left_anti")
    return out


def relevance(index_: DataFrame, words: Sequence[str], documents: DataFrame) -> DataFrame:
    """Sum of tf * idf^2 with idf = log10(N / df); N is the number of rows of ``documents``."""
    own = index_.where(c("token").isin(*words))
    df = own.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    scored = own.join(F.broadcast(df), "token").crossJoin(F.broadcast(n))  # one row a query word; one row
    return scored.groupBy("id").agg(F.round(F.sum(c("tf") * F.pow(F.log10(c("n") / c("df")), F.lit(2.0))), 6).alias("score"))


def relax(index_: DataFrame, steps: Sequence[tuple[Sequence[Sequence[str]], str]]) -> DataFrame:
    """All steps in one plan, tagged; only the first step that finds anything is kept."""
    tagged = None
    for number, (groups, mode) in enumerate(steps):
        part = retrieve(index_, groups, mode).withColumn("step", F.lit(number))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.agg(F.min("step").alias("first"))
    return tagged.join(F.broadcast(first), c("step") == c("first"), "left_semi")


def rerank(
    rows: DataFrame, words: Sequence[str], phrase: str, intent: str = "general", confidence: float = 0.0, *,
    terms: Mapping[str, float] | None = None, types: Mapping[int, float] | None = None, recent: Sequence[tuple[str, float]] = (),
) -> DataFrame:
    """Candidates (title, content, fulltext, clicks, views, popularity, ctr, freshness, data_type_id, data_type_slug) with their score.

    ``terms`` and ``types`` are a user's affinities, ``recent`` the words of recent
    searches: a few each, so each becomes an expression.
    """
    title, content = normalize(F.coalesce("title", F.lit(""))), normalize(F.coalesce("content", F.lit("")))
    rows = rows.withColumns({"_t": title, "_c": content})
    title, content = c("_t"), c("_c")
    at_least_0 = lambda name: F.greatest(F.coalesce(c(name), F.lit(0)), F.lit(0))
    parts = [3.0 * F.coalesce(c("fulltext"), F.lit(0.0))]
    if normal(phrase):
        parts.append(F.when(title.contains(normal(phrase)), 8.0).when(content.contains(normal(phrase)), 3.0).otherwise(0.0))
    for word in words:
        parts.append(F.when(title.contains(normal_token(word)), 2.0).when(content.contains(normal_token(word)), 0.5).otherwise(0.0))
        if qy.NUMBER.match(word):
            parts.append(F.when(title.contains(word), 5.0).otherwise(-1.0))
    if words:
        at = F.locate(normal_token(words[0]), title)
        parts.append(F.when(at > 0, 1.5 / (at + 1)).otherwise(0.0))
    parts += [F.ln(at_least_0("clicks") + 1) * 2.5, F.ln(at_least_0("views") + 1) * 1.5, at_least_0("popularity") * 3, at_least_0("ctr") * 4, at_least_0("freshness") * 2]
    favoured = lexicon.INTENT_TYPES.get(intent, ()) if confidence >= 0.3 else ()
    if favoured:
        parts.append(F.when(c("data_type_slug").isin(*favoured), confidence * 5.0).otherwise(0.0))
    for term, affinity in (terms or {}).items():
        # A term is a token: a run of letters and digits.
        alone = rf"(^|[^\p{{L}}\p{{N}}]){re.escape(term)}([^\p{{L}}\p{{N}}]|$)"
        held = [text.contains(term) & text.rlike(alone) for text in (title, content)]
        parts.append(F.when(held[0] | held[1], affinity * 6.0).otherwise(0.0))
    parts += [F.when(c("data_type_id") == number, affinity * 2.0).otherwise(0.0) for number, affinity in (types or {}).items() if affinity > 0]
    last = F.lit(0.0)
    for word, weight in reversed(recent):  # the first hit counts
        last = F.when(title.contains(normal_token(word)), weight * 2.0).otherwise(last)
    score = sum(parts[1:], parts[0]) + last
    return rows.withColumn("score", F.round(score.cast("double"), 4)).drop("_t", "_c")


def snippet(text: Column, word: str, before: int = 60, after: int = 100, fallback: int = 160) -> Column:
    at = F.locate(word, F.lower(text))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(before + after))).otherwise(F.substring(text, 1, fallback))


def highlight(text: Column, words: Sequence[str] | str) -> Column:
    """Words in stars, the longest first, in any letter variant and with any diacritics."""
    words = [words] if isinstance(words, str) else words
    for word in sorted((w for w in words if len(w) >= 2), key=len, reverse=True):
        text = F.regexp_replace(text, F.lit(rf"(?iu)(?<!\*\*)({loose_regex(word)})(?!\*\*)"), F.lit("**$1**"))
    return text


# Search over the index: rows (id, entry_id, project_id, language, status, data_type_id, data_type_slug, title, content,
# search_text, published_at, clicks, views, popularity, ctr, freshness) and their postings (token, id, tf).


@dataclass(frozen=True)
class Search:
    keyword: str
    project_id: int
    language: str = "en"
    page: int = 1
    per_page: int = 20
    type_slug: str | None = None

    @property
    def fetched(self) -> int:
        """Rows that are ranked anew; the full-text score alone decides which."""
        return max(100, 3 * self.per_page)


def not_containing(words: Sequence[str], text: Column) -> Column:
    """None of the words anywhere in a text; true for no words."""
    out = F.lit(True)
    for word in words:
        if normal_token(word):
            out = out & ~text.contains(normal_token(word))
    return out


def eligible(index_: DataFrame, q: Search, intent: str = "general", confidence: float = 0.0, exclude: Sequence[str] = ()) -> DataFrame:
    """Published rows of the project and language without excluded words, of the asked type or else of the intent's types; a row without a type fits any intent."""
    keep = (c("project_id") == q.project_id) & (c("language") == q.language) & (c("status") == "published") & not_containing(exclude, c("search_text"))
    favoured = lexicon.INTENT_TYPES.get(intent, ()) if intent != "general" and confidence >= 0.3 else ()
    if q.type_slug is not None:
        keep = keep & (c("data_type_slug") == q.type_slug)
    elif favoured:
        keep = keep & (c("data_type_slug").isNull() | c("data_type_slug").isin(*favoured))
    return index_.where(keep)


def matching(index_: DataFrame, postings_: DataFrame, step: Sequence[qy.Group]) -> DataFrame:
    """Ids that fit a step: all required groups, or any group if none is. Words are prefixes, phrases stand in the text."""
    flags = [f"g{i}" for i in range(len(step))]
    singles = [[normal_token(w) for w in g.words if " " not in w] for g in step]
    phrases = [[normal(w) for w in g.words if " " in w] for g in step]

    by_word = postings_.where(_or([c("token").startswith(w) for ws in singles for w in ws]))
    found = by_word.select("id", *[_or([c("token").startswith(w) for w in ws]).alias(f) for ws, f in zip(singles, flags, strict=True)])
    if any(phrases):
        by_phrase = index_.where(_or([c("search_text").contains(p) for ps in phrases for p in ps]))
        found = found.unionByName(by_phrase.select("id", *[_or([c("search_text").contains(p) for p in ps]).alias(f) for ps, f in zip(phrases, flags, strict=True)]))
    found = found.groupBy("id").agg(*[F.bool_or(f).alias(f) for f in flags])
    required = [c(f) for g, f in zip(step, flags, strict=True) if g.required]
    for flag in required:
        found = found.where(flag)
    return found.where(_or([c(f) for f in flags])).select("id")


def _or(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def first_step(index_: DataFrame, postings_: DataFrame, q: Search, processed: qy.Processed, exclude: Sequence[str] = ()) -> DataFrame:
    """Eligible rows of the first step that finds any, with ``step``; all steps are one plan."""
    own = eligible(index_, q, processed.intent, processed.confidence, exclude)
    tagged = None
    for number, step in enumerate(processed.steps):
        if step:
            ids = matching(own, postings_, step).withColumn("step", F.lit(number))
            tagged = ids if tagged is None else tagged.unionByName(ids)
    if tagged is None:
        return own.limit(0).withColumn("step", F.lit(0))
    found = own.join(tagged, "id")
    first = found.agg(F.min("step").alias("first"))
    return found.join(F.broadcast(first), c("step") == c("first")).drop("first")


def exclude_only(index_: DataFrame, q: Search, exclude: Sequence[str]) -> DataFrame:
    """Rows without any of the words, by popularity and then date: a page of those ranked anew, with the total."""
    own = index_.where((c("project_id") == q.project_id) & (c("language") == q.language) & (c("status") == "published") & not_containing(exclude, c("search_text")))
    if q.type_slug is not None:
        own = own.where(c("data_type_slug") == q.type_slug)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    top = own.orderBy(F.desc("popularity"), F.desc("published_at"), "id").limit(q.fetched).withColumn("fulltext", c("popularity").cast("double"))
    return _page(rerank(top, [], ""), q).crossJoin(F.broadcast(total)).withColumn("step", F.lit(0))


def _page(ranked: DataFrame, q: Search) -> DataFrame:
    return ranked.orderBy(F.desc("score"), "id").offset((q.page - 1) * q.per_page).limit(q.per_page)


def query_words(processed: qy.Processed) -> list[str]:
    """All words of a query's steps."""
    return sorted({w for step in processed.steps for g in step for word in g.words for w in normal(word).split()})


def search(index_: DataFrame, postings_: DataFrame, q: Search, processed: qy.Processed, exclude: Sequence[str] = (), **preference) -> DataFrame:
    """A page of ranked rows with their score, the total and the step that found them."""
    if not processed.words and exclude:
        return exclude_only(index_, q, exclude)
    found = first_step(index_, postings_, q, processed, exclude)
    total = found.agg(F.count(F.lit(1)).alias("total"))
    words = query_words(processed)
    scored = relevance(postings_, words, index_).withColumnRenamed("score", "fulltext")
    top = found.join(scored, "id", "left").withColumn("fulltext", F.coalesce("fulltext", F.lit(0.0))).orderBy(F.desc("fulltext"), "id").limit(q.fetched)
    clean = [w for w in map(normal_token, processed.words) if w]
    ranked = rerank(top, clean, " ".join(clean), processed.intent, processed.confidence, **preference)
    return _page(ranked, q).crossJoin(F.broadcast(total))


@dataclass(frozen=True)
class Found:
    items: DataFrame
    total: int
    keyword: str
    #: layout, typo or nothing: what was mended in the query.
    mended: str | None
    processed: qy.Processed


def answer(index_: DataFrame, postings_: DataFrame, q: Search, learned: Mapping[str, Sequence[str]] | None = None, enhance=None, **preference) -> Found:
    """The whole search: other layout, negation, synonyms, steps, and then layout, typos and a given ``enhance`` where nothing is found.

    A mended query counts only if it finds more. ``enhance`` takes a query and
    gives another or None; it is the hook for an external rewriter.
    """
    def run(keyword: str, exclude: Sequence[str]) -> tuple[DataFrame, int, qy.Processed]:
        processed = qy.process(keyword, learned)
        items = search(index_, postings_, replace(q, keyword=keyword), processed, exclude, **preference)
        head = items.select("total").head()
        if head is None and q.page > 1:
            head = search(index_, postings_, replace(q, keyword=keyword, page=1), processed, exclude, **preference).select("total").head()
        return items, int(head["total"]) if head else 0, processed

    other = qy.mistyped_arabic(q.keyword)
    if other.fixed:
        items, total, processed = _mended(run, other.fixed, q.language)
        if total:
            return Found(items, total, other.fixed, "layout", processed)
    rewritten = qy.rewrite(q.keyword, q.language)
    items, total, processed = run(rewritten.text, rewritten.exclude)
    keyword, mended = q.keyword, None
    if not total or not processed.words:
        arabic = qy.arabic_share(q.keyword) > 0.15
        layout, typo = qy.fix_layout(q.keyword), qy.correct(q.keyword)
        tries = [] if arabic else [("layout", layout.fixed if layout.confidence >= 0.40 else None, ()), ("typo", typo[0] if typo[1] >= 0.50 else None, rewritten.exclude)]
        if enhance is not None:
            tries.append(("enhanced", enhance(q.keyword), rewritten.exclude))
        for name, text, exclude in tries:
            if text and not total:
                again = run(text, exclude)
                if again[1] > total:
                    (items, total, processed), keyword, mended = again, text, name
    return Found(items, total, keyword, mended, processed)


def _mended(run, text: str, language: str):
    rewritten = qy.rewrite(text, language)
    return run(rewritten.text, rewritten.exclude)


def log_search(log: DataFrame, found: Found, q: Search, user_id: int | None, now: str) -> DataFrame:
    """The search log with one more row."""
    row = [(user_id, q.project_id, q.keyword, q.language, found.processed.intent, found.processed.confidence, found.total, now)]
    new = log.sparkSession.createDataFrame(row, "user_id long, project_id long, keyword string, language string, detected_intent string, intent_confidence double, results_count long, searched_at string")
    return log.unionByName(new.withColumn("searched_at", c("searched_at").cast("timestamp_ntz")), allowMissingColumns=True)


def log_clicks(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """The click log with new clicks."""
    return log.unionByName(clicks, allowMissingColumns=True)


# Signals from the logs: search(id, user_id, keyword, language, results_count, searched_at), click(...).


def _age(now: str, ts: Column, unit: str) -> Column:
    return F.greatest(F.timestamp_diff(unit, ts, F.lit(now).cast("timestamp_ntz")), F.lit(0))


def popular(searches: DataFrame, now: str, clicks: DataFrame | None = None) -> DataFrame:
    """Counts over 24 h, 7 d, 30 d and all time by normalised keyword and language, with trending and all-time scores and the trend."""
    at = F.lit(now).cast("timestamp_ntz")
    key = F.lower(F.trim("keyword"))
    recent = lambda h: F.count_if(c("searched_at") >= F.timestamp_add("HOUR", F.lit(-h), at))
    out = searches.where(F.octet_length(F.trim("keyword")) >= 2).groupBy(key.alias("keyword"), "language").agg(
        recent(24).alias("count_24h"), recent(168).alias("count_7d"), recent(720).alias("count_30d"), F.count(F.lit(1)).alias("count_all"), F.max("searched_at").alias("last_searched_at")
    )
    if clicks is not None:
        per = clicks.groupBy(F.lower(F.trim("keyword")).alias("keyword"), "language").agg(F.count(F.lit(1)).alias("clicks"))
        out = out.join(per, ["keyword", "language"], "left")
    else:
        out = out.withColumn("clicks", F.lit(0))
    out = out.withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    hours, days = _age(now, c("last_searched_at"), "HOUR"), _age(now, c("last_searched_at"), "DAY")
    out = out.withColumn("trending_score", F.round((4.0 * c("count_24h") + 2.0 * c("count_7d") + c("count_30d")) / F.pow(hours + 2.0, F.lit(1.5)), 4))
    out = out.withColumn("alltime_score", F.round(F.log10(c("count_all") + 1.0) + 1.5 * F.log10(c("clicks") + 1.0) + F.greatest(F.lit(0.0), 1 - days / 90.0), 4))
    return out.withColumn("trend", trend_label(c("count_24h"), c("count_7d")))


def trend_label(day: Column, week: Column) -> Column:
    """rising at twice the week's daily mean, falling at half of it, else stable."""
    daily = week / 7.0
    return F.when((week <= 0) & (day > 0), "rising").when(week <= 0, "stable").when(day >= 2 * daily, "rising").when(day <= 0.5 * daily, "falling").otherwise("stable")


WINDOWS = {"24h": "count_24h", "7d": "count_7d", "30d": "count_30d", "all": "count_all"}


def listed(popular_: DataFrame, limit: int, window: str = "24h", by: str = "trending_score", least: int = 3) -> DataFrame:
    """Top keywords by a score; the window decides the count shown and ties, not the rows.

    Windows widen until ``least`` rows are found. All have the same rows, so with
    fewer rows the widest one is used; an unknown window is the widest.
    """
    asked, widest = WINDOWS.get(window, "count_all"), "count_all"
    own = popular_.where("count_all > 0")
    n = own.limit(least).agg((F.count(F.lit(1)) < least).alias("few"))
    shown = own.crossJoin(F.broadcast(n)).withColumn("count", F.when(c("few"), c(widest)).otherwise(c(asked)))
    used = F.when(c("few"), "all").otherwise(window if window in WINDOWS else "all")
    return shown.withColumn("window", used).orderBy(F.desc(by), F.desc("count"), F.desc("count_all"), "keyword", "language").limit(limit)


def trending(popular_: DataFrame, limit: int, window: str = "24h") -> DataFrame:
    return listed(popular_, limit, window).select("keyword", "language", "count", "trending_score", "trend")


def most_popular(popular_: DataFrame, limit: int, window: str = "all") -> DataFrame:
    return listed(popular_, limit, window, "alltime_score").select("keyword", "language", "count", "alltime_score", "window")


def suggestion_score(searches: Column, clicks: Column, days: Column, compat: str = "decay") -> Column:
    """log10(s + 1) + 2 log10(c + 1) + recency; ``signed`` counts past days as negative, so the bonus grows with age."""
    recency = F.greatest(F.lit(0.0), 1 - days / 30.0) if compat == "decay" else F.greatest(F.lit(0.0), 1 + days / 30.0)
    return F.log10(searches + 1.0) + 2 * F.log10(clicks + 1.0) + F.coalesce(recency, F.lit(0.0))


def suggestions(searches: DataFrame) -> DataFrame:
    """Rebuilt from the log, by project, normalised keyword of two signs or more and language; clicks start at 0."""
    own = searches.where(F.char_length(F.trim("keyword")) >= 2).groupBy("project_id", F.lower(F.trim("keyword")).alias("keyword"), "language").agg(F.count(F.lit(1)).alias("search_count"), F.max("searched_at").alias("last_searched_at"))
    return own.withColumn("click_count", F.lit(0).cast("long")).withColumn("score", F.round(F.log10(c("search_count") + 1.0), 4))


def rescored(suggestions_: DataFrame, now: str, compat: str = "decay") -> DataFrame:
    """Suggestions with the score that searches and clicks keep up to date."""
    return suggestions_.withColumn("score", F.round(suggestion_score(c("search_count"), c("click_count"), _age(now, c("last_searched_at"), "DAY"), compat), 4))


def suggest(suggestions_: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Suggestions for a prefix of at least two letters."""
    if len(prefix.strip()) < 2:
        return suggestions_.limit(0)
    return suggestions_.where(c("keyword").startswith(prefix.strip().lower())).orderBy(F.desc("score"), F.desc("search_count"), "keyword", "language").limit(limit)


def synonym_pairs(searches: DataFrame, now: str | None = None, *, days: int = 90, least_signs: int = 3, least_uses: int = 2, least_together: int = 2, least_jaccard: float = 0.15, least_confidence: float = 0.20) -> DataFrame:
    """Token pairs that share distinct keywords of the last days: Jaccard, confidence 0.5 J + 0.3 log-normalised count + 0.2 balance.

    A keyword counts once, however often it was searched; its tokens are paired
    within the keyword only, which bounds the pairs by its few words.
    """
    own = searches.where(F.char_length(F.trim("keyword")) >= least_signs)
    if now is not None:
        own = own.where(c("searched_at") >= F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz")))
    uses = own.groupBy(F.lower(F.trim("keyword")).alias("keyword")).agg(F.count(F.lit(1)).alias("n")).where(c("n") >= least_uses)
    tokens = uses.select("keyword", F.array_sort(keywords(c("keyword"))).alias("t"))
    freq = tokens.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    pair = tokens.select(F.posexplode("t").alias("i", "a"), "t").select("a", F.explode(F.slice("t", c("i") + 2, F.size("t"))).alias("b"))
    both = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("together")).where(c("together") >= least_together)
    fa, fb = freq.select(c("w").alias("a"), c("f").alias("count_a")), freq.select(c("w").alias("b"), c("f").alias("count_b"))
    out = both.join(fa, "a").join(fb, "b").withColumn("jaccard", c("together") / (c("count_a") + c("count_b") - c("together")))
    top = out.agg(F.max("together").alias("top"))
    norm = F.log(c("together") + 1.0) / F.log(c("top") + 1.0)
    balance = F.least("count_a", "count_b") / F.greatest("count_a", "count_b")
    out = out.where(c("jaccard") >= least_jaccard).crossJoin(F.broadcast(top))
    sure = F.round(F.least(F.greatest(0.5 * c("jaccard") + 0.3 * norm + 0.2 * balance, F.lit(0.0)), F.lit(1.0)), 6)
    return out.select("a", "b", "together", "count_a", "count_b", F.round("jaccard", 6).alias("jaccard"), sure.alias("confidence")).where(c("confidence") >= least_confidence)


def learned_synonyms(pairs: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """Both directions of approved pairs; the ``most`` surest for each word."""
    both = pairs.select(c("a").alias("word"), c("b").alias("synonym"), "confidence").unionByName(pairs.select(c("b").alias("word"), c("a").alias("synonym"), "confidence")).where(c("confidence") >= least)
    w = W.partitionBy("word").orderBy(F.desc("confidence"), "synonym")
    return both.withColumn("rank", F.row_number().over(w)).where(c("rank") <= most)


def signals(rows: DataFrame, now: str) -> DataFrame:
    """CTR clicks / (views + 1), freshness 1 / (days + 1) (no date: 30 days), and popularity, of (id, clicks, views, published_at).

    Days are calendar days, negative for a date to come; a date of tomorrow has no freshness.
    """
    days = F.coalesce(F.datediff(F.to_date(F.lit(now).cast("timestamp_ntz")), F.to_date("published_at")), F.lit(30))
    out = rows.withColumn("ctr", half_up(c("clicks"), c("views") + 1, 4)).withColumn("freshness", F.when(days != -1, F.round(1 / (days + 1.0), 4)))
    return out.withColumn("popularity", F.round(0.6 * F.ln(c("clicks") + 1.0) + 0.3 * F.ln(c("views") + 1.0) + 0.1 * c("freshness"), 4))


def rating_popularity(index_: DataFrame, entries: DataFrame) -> DataFrame:
    """Index rows with the popularity that their entries' ratings give; rows of unknown entries keep none."""
    rated = entries.select(c("id").alias("entry_id"), c("ratings_count").alias("_n"), c("ratings_avg").cast("double").alias("_avg"))
    score = F.round(2 * F.log10(c("_n") + 1.0) + 1.5 * F.log10(c("clicks") + 1.0) + 0.5 * c("_avg"), 4)
    return index_.join(rated, "entry_id", "left").withColumn("popularity_rating", score).drop("_n", "_avg")


def type_affinity(clicks: DataFrame) -> DataFrame:
    """Per user and type n / (n + 3) from two clicks on."""
    return clicks.groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumn("affinity", F.round(c("n") / (c("n") + 3), 4))


def term_affinity(clicks: DataFrame, most: int = 20, neutral: Sequence[str] = lexicon.NEUTRAL_WORDS) -> DataFrame:
    """Per user the terms of clicked texts, n / (n + 2) from two clicks on; neutral words dropped, the top ``most``."""
    terms = clicks.select("user_id", F.explode(keywords(c("text"))).alias("term")).where(~c("term").isin(*neutral) if neutral else F.lit(True))
    counted = terms.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = W.partitionBy("user_id").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(w)).where(c("rank") <= most).withColumn("affinity", F.round(c("n") / (c("n") + 2), 4)).drop("rank")


def recent_keywords(searches: DataFrame, now: str, *, days: int = 14, recent: int = 8, most: int = 10, compat: str = "decay") -> DataFrame:
    """Per user the words of the last keywords, split at white space, weighted exp(-age / 7 days), the most of each."""
    at = F.lit(now).cast("timestamp_ntz")
    own = searches.where((c("searched_at") >= F.timestamp_add("DAY", F.lit(-days), at)) & (F.char_length(F.trim("keyword")) >= 2))
    last = own.groupBy("user_id", "keyword").agg(F.max("searched_at").alias("at"))
    w = W.partitionBy("user_id").orderBy(F.desc("at"), "keyword")
    age = _age(now, c("at"), "DAY") * (1.0 if compat == "decay" else -1.0)
    rows = last.withColumn("_r", F.row_number().over(w)).where(c("_r") <= recent).select("user_id", F.explode(F.split(F.lower(F.trim("keyword")), r"\s+")).alias("word"), F.round(F.exp(-age / 7.0), 4).alias("weight"))
    rows = rows.where((F.length("word") >= 3) & ~c("word").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$")).groupBy("user_id", "word").agg(F.max("weight").alias("weight"))
    top = W.partitionBy("user_id").orderBy(F.desc("weight"), "word")
    return rows.withColumn("_r", F.row_number().over(top)).where(c("_r") <= most).drop("_r")


def _since(searches: DataFrame, now: str, days: int) -> DataFrame:
    return searches.where(c("searched_at") >= F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz")))


def quality_overview(searches: DataFrame, now: str, days: int = 7) -> DataFrame:
    out = _since(searches, now, days).agg(F.count(F.lit(1)).alias("searches"), count_if(c("results_count") == 0).alias("zero"), half_up(F.sum("results_count"), F.count(F.lit(1)), 2).alias("avg_results"), F.countDistinct("keyword").alias("keywords"))
    return out.withColumn("zero_rate", half_up(c("zero") * 100, c("searches"), 1))


def quality_problems(searches: DataFrame, now: str, days: int = 7, *, zero: int = 20, low: int = 20, unsure: int = 15, odd: int = 10) -> DataFrame:
    """Keywords that search badly, of four kinds, the worst of each: without results, with few, found with little confidence, and suspicious ones.

    Suspicious is longer than 100 signs or with three operator signs in a row; the
    project and the time bound these too.
    """
    own = _since(searches, now, days)

    def kind(name: str, rows: DataFrame, least: int, most: int) -> DataFrame:
        grouped = rows.groupBy("keyword", "language").agg(F.count(F.lit(1)).alias("n"), half_up(F.sum("results_count"), F.count(F.lit(1)), 4).alias("avg_results"), half_up(F.sum(F.round(c("intent_confidence") * 1000).cast("long")), F.count(F.lit(1)) * 1000, 4).alias("avg_confidence"))
        return grouped.where(c("n") >= least).orderBy(F.desc("n"), "keyword", "language").limit(most).select(F.lit(name).alias("kind"), "keyword", "language", "n", "avg_results", "avg_confidence")

    suspicious = (F.char_length("keyword") > 100) | c("keyword").rlike(r'[+\-><()~*"@]{3,}')
    parts = (
        kind("zero", own.where("results_count = 0"), 2, zero), kind("low", own.where("results_count > 0 and results_count < 3"), 2, low),
        kind("unsure", own.where("intent_confidence < 0.4 and results_count > 0"), 3, unsure), kind("suspicious", own.where(suspicious), 1, odd),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log_page(searches: DataFrame, only: str | None, page: int, size: int) -> DataFrame:
    """A page of the log, newest first, with the total: all, ``zero_results``, ``ai_used``, or grouped as ``high_frequency``."""
    if only == "high_frequency":
        rows = searches.groupBy("keyword", "language", "project_id").agg(F.count(F.lit(1)).alias("search_count"), half_up(F.sum("results_count"), F.count(F.lit(1)), 4).alias("avg_results"), F.max("searched_at").alias("last_searched"))
        order = [F.desc("search_count"), "keyword", "language", "project_id"]
    else:
        keep = {"zero_results": "results_count = 0", "ai_used": "results_count > 0 and intent_confidence >= 0.5"}.get(only or "", "true")
        rows, order = searches.where(keep), [F.desc("searched_at"), "id"]
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def signal_health(index_: DataFrame) -> DataFrame:
    """One row: rows, clicks, views, mean signals, and rows without views or clicks."""
    n = F.count(F.lit(1))
    mean4 = lambda name: half_up(F.sum(F.round(c(name) * 10000).cast("long")), n * 10000, 4).alias(f"avg_{name}")
    return index_.agg(n.alias("rows"), F.sum("clicks").alias("clicks"), F.sum("views").alias("views"), mean4("ctr"), mean4("popularity"), mean4("freshness"), count_if(c("views") == 0).alias("zero_views"), count_if(c("clicks") == 0).alias("zero_clicks"))


def most_clicked(index_: DataFrame, limit: int = 5) -> DataFrame:
    return index_.orderBy(F.desc("clicks"), "entry_id").limit(limit).select("entry_id", F.substring("title", 1, 30).alias("title"), "clicks", "views", "ctr", "popularity")


def clicked_texts(clicks: DataFrame, searches: DataFrame, index_: DataFrame, now: str, *, days: int = 30, most: int = 100) -> DataFrame:
    """Per user the texts of the newest clicks, one a click: in the language of the search that led to it, or in any."""
    led = searches.select(c("id").alias("search_log_id"), c("language").alias("asked"))
    own = clicks.where(c("clicked_at") >= F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz"))).join(led, "search_log_id", "left")
    rows = own.join(index_.select("entry_id", "language", "title", "content"), "entry_id").where(c("asked").isNull() | (c("language") == c("asked")))
    text = F.trim(F.concat_ws(" ", *[F.when(F.trim(x) != "", c(x)) for x in ("title", "content")]))
    one = rows.withColumn("text", text).where("text <> ''").groupBy("user_id", c("id").alias("click_id"), "clicked_at").agg(F.min_by("text", "language").alias("text"))
    w = W.partitionBy("user_id").orderBy(F.desc("clicked_at"), "click_id")
    return one.withColumn("rank", F.row_number().over(w)).where(c("rank") <= most)


def click_counts(clicks: DataFrame, now: str, days: int = 30, by: str = "user_id") -> DataFrame:
    """Clicks per user (or session) and data type of the last days."""
    return clicks.where(c("clicked_at") >= F.timestamp_add("DAY", F.lit(-days), F.lit(now).cast("timestamp_ntz"))).groupBy(by, "type").agg(F.count(F.lit(1)).alias("clicks"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that two results share, lose and gain."""
    both = a.select("id", F.lit(1).alias("in_a")).join(b.select("id", F.lit(1).alias("in_b")), "id", "full")
    return both.select("id", F.when(c("in_a").isNull(), "new").when(c("in_b").isNull(), "lost").otherwise("common").alias("state"))
