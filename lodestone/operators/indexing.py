"""The search index: title, content, meta and search text of entries by language."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import query as qy
from ..functions.text import normal, strip_html
from . import upsert

c = F.col
TITLES = ("text", "string", "title")
CONTENTS = ("textarea", "richtext", "markdown", "wysiwyg")


def fields_of(values: DataFrame) -> DataFrame:
    """(entry_id, language, title, content, meta) from (entry_id, language, field, type, value, id).

    The first title field by id is the title, later ones are meta; long fields join
    as content in order of id; of a meta field's values the last counts. No language
    means en. Empty values are dropped.
    """
    kind = F.lower("type")
    own = values.where(c("value").isNotNull() & (c("value") != "")).withColumns({"language": F.coalesce("language", F.lit("en")), "_title": kind.isin(*TITLES), "_content": kind.isin(*CONTENTS)})
    first = own.groupBy("entry_id", "language").agg(F.min_by(F.when(c("_title"), c("value")), F.when(c("_title"), c("id"))).alias("title"), F.min(F.when(c("_title"), c("id"))).alias("_first"), F.sort_array(F.collect_list(F.when(c("_content"), F.struct("id", strip_html(c("value")).alias("t"))))).alias("_c"))
    rest = own.join(first.select(c("entry_id").alias("_e"), c("language").alias("_l"), "_first"), (c("entry_id") == c("_e")) & (c("language") == c("_l")))
    rest = rest.where(~c("_content") & ~F.coalesce(c("id") == c("_first"), F.lit(False))).groupBy("entry_id", "language", "field").agg(F.max_by("value", "id").alias("value"))
    meta = rest.groupBy("entry_id", "language").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("meta"))
    out = first.join(meta, ["entry_id", "language"], "left")
    none = F.array().cast(meta.schema["meta"].dataType)
    return out.select("entry_id", "language", strip_html(c("title")).alias("title"), F.concat_ws(" ", F.transform("_c", lambda x: x["t"])).alias("content"), F.coalesce("meta", none).alias("meta"))


def flat(meta: object, depth: int = 0, deepest: int = 4) -> str:
    """The scalars of a JSON value in order, down to a depth; a text that is no JSON stays."""
    if meta is None or meta == "" or depth > deepest:
        return ""
    if isinstance(meta, str) and not depth:
        try:
            meta = json.loads(meta)
        except ValueError:
            return str(meta)
        if meta is None:
            return ""
    if not isinstance(meta, (list, dict)):
        return str(meta)
    parts = (flat(x, depth + 1, deepest) if isinstance(x, (list, dict)) else "" if x is None else ("1" if x is True else "" if x is False else str(x)) for x in (meta.values() if isinstance(meta, dict) else meta))
    return " ".join(p for p in parts if p.strip())


def build_text(title: str | None, content: str | None, meta: str | None, *, longest: int = 60_000, most: int = 60) -> str:
    """Normalised title, content and meta values, and words' counterparts in the other language."""
    text = normal(" ".join(p for p in (title or "", content or "", flat(meta)) if p.strip()))[:longest]
    extra = qy.other_words(qy.words_of(text))[:most] if text else []
    return " ".join([text, *extra]) if extra else text


def search_text(title: Column, content: Column, meta: Column) -> Column:
    """``build_text`` of columns; ``meta`` is JSON."""

    @F.pandas_udf("string")
    def build(titles: pd.Series, contents: pd.Series, metas: pd.Series) -> pd.Series:
        return pd.Series([build_text(*row) for row in zip(titles, contents, metas, strict=True)])

    return build(title, content, meta)


def reindex(entries: DataFrame, values: DataFrame, projects: DataFrame, languages: Sequence[str] = ("en",)) -> DataFrame:
    """The whole index: a row for each live published entry and language of its project that has a title.

    ``projects`` has (id, supported_languages as a JSON list); without one ``languages`` hold.
    """
    given = F.from_json("supported_languages", "array<string>")
    own = projects.select(c("id").alias("project_id"), F.explode(F.when(F.size(given) > 0, given).otherwise(F.array(*map(F.lit, languages)))).alias("language"))
    live = entries.where(c("deleted_at").isNull() & (c("status") == "published"))
    rows = live.select(c("id").alias("entry_id"), "data_type_id", "data_type_slug", "project_id", "status", "published_at").join(own, "project_id").join(fields_of(values), ["entry_id", "language"]).where(c("title").isNotNull() & (c("title") != ""))
    meta = F.when(F.size("meta") > 0, F.to_json(F.map_from_entries("meta")))
    rows = rows.withColumn("meta", meta)
    return rows.withColumn("search_text", search_text(c("title"), c("content"), c("meta")))


def update_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after some entries changed: their rows replace the old ones, by entry and language; signals stay."""
    kept = [x for x in index.columns if x not in rows.columns]
    fresh = rows.join(index.select("entry_id", "language", *kept), ["entry_id", "language"], "left") if kept else rows
    return upsert.upsert(index, fresh.select(*index.columns), ["entry_id", "language"])
