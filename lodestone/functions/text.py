"""Text columns: folding, tokens, language tests, typos and intent."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon

FOLD_FROM = "".join(lexicon.FOLDS.values())
FOLD_TO = "".join(k * len(v) for k, v in lexicon.FOLDS.items())
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_SPACE = r"[\s\p{Z}\x85]+"


#: Signs that folding touches; other texts skip it.
_TOUCHED = "[\u0600-\u06ff\u200b-\u200f\u202a-\u202e\u2060\ufeef\ufeff]"


def folded(text: Column) -> Column:
    """Without invisible signs and diacritics, letters and digits folded one to one, in lower case."""
    bare = F.translate(F.regexp_replace(text, f"{lexicon.INVISIBLE}|{lexicon.MARKS}", ""), FOLD_FROM, FOLD_TO)
    return F.lower(F.when(text.rlike(_TOUCHED), bare).otherwise(text))


def normalize(text: Column) -> Column:
    """``folded``, with white space collapsed."""
    return F.trim(F.regexp_replace(folded(text), _SPACE, " "))


def normal(text: str | None) -> str:
    """``normalize`` for a text of the driver, such as a typed query."""
    bare = re.sub(lexicon.MARKS, "", re.sub(lexicon.INVISIBLE, "", text or ""))
    return " ".join(bare.translate(_FOLD).lower().split())


def normal_token(text: str | None) -> str:
    return normal(text).replace(" ", "")


def tokens(text: Column, least: int = 2) -> Column:
    """Distinct runs of letters and digits of normalised text."""
    return F.array_distinct(F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


STOP_WORDS = tuple(dict.fromkeys(map(normal_token, lexicon.STOP_WORDS)))


def has_arabic(text: Column) -> Column:
    return text.rlike("[\u0600-\u06ff]")


def loose_regex(word: str) -> str:
    """A pattern that matches a normalised word in raw text: any letter variant, with diacritics and invisible signs between."""
    return lexicon.BETWEEN.join(f"[{ch}{lexicon.FOLDS[ch]}]" if ch in lexicon.FOLDS else re.escape(ch) for ch in word)


def keywords(text: Column, *, unique: bool = True, stop: Sequence[str] = STOP_WORDS, least: int = 2, most: int = 40) -> Column:
    """Runs of letters and digits of folded text, without stop words, 2 to 40 signs."""
    kept = F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(least, most) & ~w.isin(*stop))
    return F.array_distinct(kept) if unique else kept


def language_class(text: Column) -> Column:
    """arabic above 0.30 of the letters, mixed if both scripts exceed 0.15, gibberish, else latin."""
    arabic = F.length(F.regexp_replace(text, "[^\u0600-\u06ff]", ""))
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    letters = F.greatest(arabic + latin, F.lit(1))
    return (
        F.when((arabic / letters > 0.15) & (latin / letters > 0.15), "mixed").when(arabic / letters > 0.30, "arabic").when(is_gibberish(text), "gibberish").when(latin > 0, "latin").otherwise("none")
    )


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def vowel_ratio(text: Column) -> Column:
    """Share of vowels among Latin letters."""
    own = _letters(text)
    return F.length(F.regexp_replace(own, "[^aeiou]", "")) / F.greatest(F.length(own), F.lit(1))


def arabic_ratio(text: Column) -> Column:
    """Share of Arabic signs among all that are no white space."""
    solid = F.regexp_replace(text, r"\s+", "")
    return F.length(F.regexp_replace(solid, "[^\u0600-\u06ff]", "")) / F.greatest(F.length(solid), F.lit(1))


def is_arabic(text: Column) -> Column:
    return arabic_ratio(text) > 0.30


def is_mixed(text: Column) -> Column:
    """Both scripts above 0.15 of all signs but spaces."""
    signs = F.replace(text, F.lit(" "), F.lit(""))
    total = F.greatest(F.length(signs), F.lit(1))
    share = lambda other: F.length(F.regexp_replace(signs, other, "")) / total
    return (share("[^\u0600-\u06ff]") > 0.15) & (share("[^a-zA-Z]") > 0.15)


def is_gibberish(text: Column) -> Column:
    """Of four Latin letters and more: hardly a vowel, five consonants in a row, or a block of two to a third of the letters three times in most places."""
    own = _letters(text)
    size = F.length(own)
    covers = lambda n: size - F.length(F.replace(own, F.substring(own, F.lit(1), n), F.lit("")))
    repeats = F.exists(F.sequence(F.lit(2), F.greatest(F.floor(size / 3).cast("int"), F.lit(2))), lambda n: (covers(n) >= 3 * n) & (covers(n) / size >= 0.70))
    odd = F.when(vowel_ratio(text) < 0.10, True).when(own.rlike("[^aeiou]{5,}"), True).when(size < 6, False).otherwise(repeats)
    return F.when((size < 4) | is_arabic(text), False).otherwise(odd)


def language_analysis(text: Column) -> dict[str, Column]:
    """All language tests of a text."""
    arabic = is_arabic(text)
    mixed = ~arabic & is_mixed(text)
    return {"is_arabic": arabic, "is_mixed": mixed, "is_english_only": ~arabic & ~mixed, "is_gibberish": is_gibberish(text), "vowel_ratio": vowel_ratio(text), "arabic_ratio": F.round(arabic_ratio(text), 4)}


def strip_html(text: Column) -> Column:
    """Tags away, the five named references decoded, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def typo_candidates(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The nearest dictionary word of each unknown word: at most distance 1, 2 or 3 by length, similarity at least 0.60.

    An edit reaches one place of a word only, so of the ``most`` + 1 even pieces of
    a term one stands in the word unchanged, shifted by ``most`` at most. Words and
    terms meet by such a piece, its number and the term's length; no pair is missed,
    and pairs without a common piece are never made.
    """
    most = lambda w: F.when(F.length(w) <= 5, 1).when(F.length(w) <= 8, 2).otherwise(3)
    begin = lambda size, piece, pieces: F.floor(size * piece / pieces).cast("int")
    own = words.select("word").distinct().withColumn("most", most("word"))
    own = own.withColumn("size", F.explode(F.sequence(F.greatest(F.length("word") - F.col("most"), F.lit(1)), F.length("word") + F.col("most"))))
    own = own.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("most"))))
    first, to = begin(F.col("size"), F.col("piece"), F.col("most") + 1), begin(F.col("size"), F.col("piece") + 1, F.col("most") + 1)
    shifts = F.sequence(F.greatest(first - F.col("most"), F.lit(0)), first + F.col("most"))
    own = own.withColumns({"n": to - first, "part": F.explode(F.array_distinct(F.transform(shifts, lambda at: F.substring("word", at + 1, to - first))))}).where(F.length("part") == F.col("n")).drop("n")
    known = dictionary.select("term").distinct().withColumn("size", F.length("term")).withColumn("most", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    known = known.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("most"))))
    first, to = begin(F.col("size"), F.col("piece"), F.col("most") + 1), begin(F.col("size"), F.col("piece") + 1, F.col("most") + 1)
    known = known.withColumn("part", F.substring("term", first + 1, to - first))
    met = own.join(known, ["size", "most", "piece", "part"]).select("word", "most", "term").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= F.col("most"))
    similar = near.where(1 - F.col("distance") / F.greatest(F.length("word"), F.length("term")) >= 0.6)
    best = similar.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("b")).select("word", F.col("b.term").alias("term"), F.col("b.distance").alias("distance"))
    return best.withColumn("confidence", F.when(F.col("distance") == 0, 1.0).when(F.col("distance") == 1, 0.88).when(F.col("distance") == 2, 0.72).otherwise(0.55))


def intent(queries: DataFrame, signals: dict[str, dict[str, float]] = lexicon.INTENTS) -> DataFrame:
    """The intent with the largest share of signal weight, if at least 0.3, else general; ``queries`` is (id, text).

    Of equal shares the intent named first wins.
    """
    order = {name: i for i, name in enumerate(signals)}
    rows = [(i, order[i], w, float(x)) for i, words in signals.items() for w, x in words.items()]
    table = queries.sparkSession.createDataFrame(rows, "intent string, place int, word string, weight double")
    words = queries.select("id", F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word"))
    summed = words.join(F.broadcast(table), "word").groupBy("id", "intent", "place").agg(F.sum("weight").alias("w"))  # a fixed table
    best = summed.groupBy("id").agg(F.max_by("intent", F.struct("w", -F.col("place"))).alias("intent"), F.round(F.max("w") / F.sum("w"), 4).alias("confidence"))
    out = queries.select("id").join(best, "id", "left")
    sure = F.coalesce(F.col("confidence") >= 0.3, F.lit(False))
    return out.select("id", F.when(sure, F.col("intent")).otherwise("general").alias("intent"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
