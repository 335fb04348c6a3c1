"""A typed query on the driver: negation, layout, typos, entities, and the groups of words that it is searched by.

Query texts are short, so these are plain functions; ``as_column`` applies one to
a column of queries in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, functions as F

from . import lexicon
from .text import normal, normal_token

NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\Z")
ARABIC = re.compile("[\u0600-\u06ff]")


def as_column(text: Column, function: Callable[[str], object]) -> Column:
    """A function's result on each query, as JSON."""
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(function(t or ""), ensure_ascii=False, separators=(",", ":")))

    return apply(text)


def _unique(words: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(words))


def variants(word: str, most: int = 3) -> list[str]:
    """The word's counterparts in the other language."""
    return [w for w in _COUNTERPARTS.get(normal_token(word), []) if w != normal_token(word)][:most]


def words_of(text: str, least: int = 2) -> list[str]:
    """Distinct runs of letters and digits of a normalised text."""
    return _unique(w for w in re.findall(r"[^\W_]+", text) if len(w) >= least)


def other_words(words: Sequence[str]) -> list[str]:
    """Counterparts of all words that are not among them."""
    known = {normal_token(w) for w in words}
    return _unique(v for w in words for v in variants(w) if v not in known)


def _counterparts() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for arabic, english in lexicon.TRANSLITERATIONS.items():
        for word in english:
            for a, b in ((normal_token(arabic), normal_token(word)), (normal_token(word), normal_token(arabic))):
                if b not in out.setdefault(a, []):
                    out[a].append(b)
    return out


_COUNTERPARTS = _counterparts()


# Negation


@dataclass(frozen=True)
class Rewritten:
    include: list[str]
    exclude: list[str]
    negated: bool

    @property
    def text(self) -> str:
        return " ".join(self.include)


def _alphanumeric(sign: str) -> bool:
    return sign.isascii() and sign.isalnum() or bool(ARABIC.match(sign))


def _find(text: str, phrases: Iterable[str], bounded: bool) -> tuple[str, str] | None:
    """What stands before and after the longest phrase whose first occurrence counts."""
    for phrase in sorted(phrases, key=len, reverse=True):
        at = text.find(phrase)
        if at < 0:
            continue
        end = at + len(phrase)
        if bounded and (at and _alphanumeric(text[at - 1]) or end < len(text) and _alphanumeric(text[end])):
            continue
        return text[:at].strip(), text[end:].strip()
    return None


def _parted(before: str, after: list[str]) -> tuple[str, list[str]]:
    """Words before the phrase stay and at most four after it go; without words before, numbers go and words stay if there are both."""
    if before:
        return before, after[:4]
    numbers = [w for w in after if NUMBER.match(w)]
    others = [w for w in after if not NUMBER.match(w)]
    return (" ".join(others), numbers) if numbers and others else ("", after[:4])


def _rewrite(text: str, phrases: Iterable[str], fillers: set[str], splits: str, bounded: bool) -> tuple[list[str], list[str], bool]:
    found = _find(text, phrases, bounded)
    cut = lambda t: [w for w in re.split(splits, t) if w]
    include, exclude = (text, []) if found is None else _parted(found[0], cut(found[1]))
    return [w for w in cut(include) if w not in fillers and len(w) >= 2], [w for w in exclude if w not in fillers], found is not None


def rewrite_english(query: str) -> Rewritten:
    include, exclude, negated = _rewrite(query.strip().lower(), lexicon.NEGATIONS["en"], set(lexicon.FILLERS["en"]), r"[\s\-_,.]+", True)
    return Rewritten(include, _unique(exclude), negated)


def negated(query: str) -> bool:
    return _find(query.strip().lower(), lexicon.NEGATIONS["en"], True) is not None


def rewrite_arabic(query: str) -> Rewritten:
    """Works on normalised text; an excluded word takes its counterparts in the other language with it."""
    fillers = set(map(normal_token, lexicon.FILLERS["ar"]))
    include, exclude, found = _rewrite(normal(query), _unique(map(normal, lexicon.NEGATIONS["ar"])), fillers, r"[\s,،.]+", False)
    out: list[str] = []
    for word in exclude:
        if NUMBER.match(word):
            out.append(word)
        elif len(word) >= 2:
            out += [word, *(v for v in variants(word) if len(v) >= 2)]
    return Rewritten(_unique(include), _unique(out), found)


def split_negation(query: str) -> tuple[list[str], list[str]]:
    """(include, exclude) words of an English query."""
    out = rewrite_english(query)
    return out.include, out.exclude


def rewrite(query: str, language: str = "en") -> Rewritten:
    """The rewriting that the query's script asks for; a plain query stays as it is."""
    if arabic_share(query) > 0.30 or language == "ar":
        out = rewrite_arabic(query)
    elif negated(query):
        out = rewrite_english(query)
    else:
        return Rewritten(query.split(), [], False)
    return out if out.include else Rewritten(query.split(), out.exclude, out.negated)


# Script and layout


def arabic_share(text: str) -> float:
    solid = re.sub(r"\s+", "", text)
    return len(ARABIC.findall(solid)) / len(solid) if solid else 0.0


def _scripts(text: str) -> tuple[float, float]:
    """Shares of Arabic and Latin letters among all signs but spaces and digits."""
    signs = [c for c in text if c != " " and not c.isdigit()]
    if not signs:
        return 0.0, 0.0
    arabic = sum("\u0600" <= c <= "\u06ff" or "\ufb50" <= c <= "\ufdff" or "\ufe70" <= c <= "\ufeff" for c in signs)
    return arabic / len(signs), sum(c.isascii() and c.isalpha() for c in signs) / len(signs)


def vowel_share(text: str) -> float:
    letters = re.sub("[^a-z]", "", text.lower())
    return len(re.sub("[^aeiou]", "", letters)) / len(letters) if letters else 0.0


#: Of keys that give the same sign the last one counts.
_BACK = {sign: key for key, sign in lexicon.KEYS.items() if len(sign) == 1}


@dataclass(frozen=True)
class Layout:
    fixed: str | None
    confidence: float
    direction: str | None


NO_LAYOUT = Layout(None, 0.0, None)


def _to_english(query: str) -> Layout:
    text = "".join(_BACK.get(c, c) for c in query).strip()
    arabic, english = _scripts(text)
    if not text or english < 0.7:
        return NO_LAYOUT
    letters = [c for c in text.lower() if c.isascii() and c.isalpha()]
    vowels = sum(c in "aeiou" for c in letters) / len(letters)
    sizes = [len(w.encode()) for w in text.split(" ")]
    score = english * 0.4 + (0.3 if 0.15 <= vowels <= 0.6 else 0.1) + (0.2 if arabic == 0 else 0) + (0.1 if 2 <= sum(sizes) / len(sizes) <= 15 else 0)
    score = round(min(1.0, score), 4)
    return Layout(text, score, "ar_to_en") if score >= 0.4 else NO_LAYOUT


def fix_layout(query: str) -> Layout:
    """The query as typed on the other keyboard layout, where it looks like it was."""
    query = query.strip()
    arabic, english = _scripts(query)
    if arabic > 0.2 and english > 0.2:
        return NO_LAYOUT
    if arabic >= 0.7:
        return _to_english(query)
    if english < 0.7 or vowel_share(query) >= 0.20:
        return NO_LAYOUT
    text = "".join(lexicon.KEYS.get(c, c) for c in query.lower()).strip()
    score = round(_scripts(text)[0], 4)
    return Layout(text, score, "en_to_ar") if score >= 0.6 else NO_LAYOUT


def mistyped_arabic(query: str) -> Layout:
    """English that was typed on the Arabic layout."""
    found = _to_english(query) if query.strip() and _scripts(query)[0] >= 0.7 else NO_LAYOUT
    return found if found.confidence >= 0.35 else NO_LAYOUT


# Typos


def distance(a: str, b: str) -> int:
    """Levenshtein distance in bytes."""
    x, y = a.encode(), b.encode()
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, q in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != q))
    return row[-1]


def correct_word(word: str) -> tuple[str | None, float]:
    """Misspelling list, then words that are right, then the nearest target: at most distance 1, 2 or 3 by length."""
    if word in lexicon.TYPOS:
        return lexicon.TYPOS[word], 0.95
    if word in lexicon.KNOWN_WORDS:
        return word, 1.0
    n = len(word)
    if n < 4:
        return None, 0.0
    most = 1 if n <= 5 else 2 if n <= 8 else 3
    best: tuple[int, str] | None = None
    for size in range(max(1, n - most), n + most + 1):
        for target in lexicon.TYPO_TARGETS.get(size, []):
            if most == 1 and target[0] != word[0]:
                continue
            d = distance(word, target)
            if 0 < d <= most and (best is None or d < best[0]) and 1 - d / max(n, len(target)) >= 0.60:
                best = d, target
    return (best[1], {1: 0.88, 2: 0.72, 3: 0.55}[best[0]]) if best else (None, 0.0)


def correct(query: str) -> tuple[str | None, float]:
    """The corrected query and the mean confidence of its words, 1 for a word that stays; nothing if all stay."""
    words = query.strip().lower().split()
    fixed = [(f, p) if f is not None and f != w else (w, 1.0) for w, (f, p) in ((w, correct_word(w)) for w in words)]
    if [f for f, _ in fixed] == words:
        return None, 0.0
    return " ".join(f for f, _ in fixed), round(sum(p for _, p in fixed) / len(words), 4)


# Entities


def entities(query: str) -> dict[str, object]:
    """Brand, model, product, place, price range and attributes that a query names."""
    text = query.strip().lower()
    words = text.split()
    brand = next((w for w in words if w in lexicon.BRANDS), None)
    model = None
    for pattern in lexicon.MODELS:
        if (m := re.search(pattern, text)) and m[1].strip() != brand:
            model = m[1].strip()
            break
    place = next((w for w in words if w in lexicon.PLACES), None) or next((b for a, b in zip(words, words[1:]) if a in lexicon.PLACE_SIGNS and len(b) >= 3), None)
    number = lambda pattern: float(m[1]) if (m := re.search(pattern, text)) else None
    least, most = number(lexicon.PRICE_LEAST), number(lexicon.PRICE_MOST)
    if m := re.search(lexicon.PRICE_RANGE, text):
        least, most = float(m[1]), float(m[2])
    if m := re.search(r"\$(\d+)", text):
        most, least = float(m[1]) * 1.2 if most is None else most, float(m[1]) * 0.8 if least is None else least
    attributes = {k: v for k, v in (("color", next((lexicon.COLOURS[w] for w in reversed(words) if w in lexicon.COLOURS), None)), ("storage", next((w.upper() for w in reversed(words) if w in lexicon.STORAGE), None))) if v}
    product = " ".join(x for x in (brand, model) if x) or None
    return {"brand": brand, "model": model, "product": product, "place": place, "price_min": least, "price_max": most, "attributes": attributes}


# Groups of words


@dataclass(frozen=True)
class Group:
    """Words any of which will do; the first is the typed one. A phrase has a space, every word is a prefix."""

    words: tuple[str, ...]
    required: bool
    #: The typed word counts by itself, beside its synonyms.
    weighted: bool = True


@dataclass(frozen=True)
class Processed:
    words: list[str]
    groups: list[list[str]]
    #: From the strictest to the loosest; each a list of groups.
    steps: list[list[Group]]
    intent: str
    confidence: float
    exclude: list[str] = field(default_factory=list)


def _bare(word: str) -> str:
    return re.sub(r'[+\-><()~*"@#$%^&]+', "", word)


def _term(word: str) -> str:
    return '"' + word.replace('"', "") + '"' if " " in word else _bare(word) + "*"


def render(step: Sequence[Group], exclude: Sequence[str] = ()) -> str:
    """A step in the notation of full-text search."""
    out = []
    for g in step:
        if len(g.words) == 1:
            out.append(("+" if g.required else "") + _bare(g.words[0]) + "*")
        elif g.required or not g.weighted:
            out.append(("+" if g.required else "") + "(" + " ".join(map(_term, g.words)) + ")")
        else:
            out.append(_term(g.words[0]) + " (" + " ".join(map(_term, g.words[1:])) + ")")
    return " ".join([*out, *("-" + _bare(w) for w in exclude)])


def relaxed(groups: Sequence[Sequence[str]]) -> list[list[Group]]:
    """All groups required, the first only, none, and the first group alone; steps that repeat the one before are left out."""
    if len(groups) <= 1:
        return [[Group(tuple(g), False) for g in groups]]
    made = [
        [Group(tuple(g), True, False) for g in groups],
        [Group(tuple(g), i == 0, i != 0) for i, g in enumerate(groups)],
        [Group(tuple(g), False) for g in groups],
        [Group(tuple(groups[0]), False)],
    ]
    out = [made[0]]
    for step in made[1:]:
        if render(step) != render(out[-1]):
            out.append(step)
    return out


def detect_intent(words: Sequence[str]) -> tuple[str, float]:
    scores = {i: sum(signals.get(w.strip().lower(), 0.0) for w in words) for i, signals in lexicon.INTENTS.items()}
    total = sum(scores.values())
    if not total:
        return "general", 0.0
    best = max(scores, key=lambda i: scores[i])
    sure = round(scores[best] / total, 4)
    return (best, sure) if sure >= 0.3 else ("general", sure)


_QUERY_STOP = set(map(normal_token, lexicon.QUERY_STOP_WORDS))


def process(text: str, learned: Mapping[str, Sequence[str]] | None = None, *, most_words: int = 10, most_terms: int = 5) -> Processed:
    """Words of a query, a group of alternatives for each, and the steps in which it is searched.

    ``learned`` has a project's approved synonyms; then come fixed synonyms and
    counterparts in the other language.
    """
    clean = normal(re.sub(r'[+\-><()~*"@#$%^&=\[\]{}|\\]+', " ", text))
    found = [w for w in re.split(r"[\s\-_,،.]+", clean) if len(w) >= 2]
    words = ([w for w in found if normal_token(w) not in _QUERY_STOP] or found)[:most_words]
    groups = []
    for word in words:
        group = [word]
        for other in [*(learned or {}).get(word, ()), *lexicon.SYNONYMS.get(word, [])[:2], *variants(word)]:
            if other.strip() and other not in group and other not in words and len(group) < most_terms:
                group.append(other)
        groups.append(group)
    intent, confidence = detect_intent(words)
    return Processed(words, groups, relaxed(groups), intent, confidence)
