"""Content reports, EAV records, predicates, graph, versions and ratings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import bucket, count_if, in_range, live, mean, rate
from ..params import ReportParams

c = F.col
STATUS = ("published", "draft", "scheduled", "archived")


def admin_overview(projects: DataFrame, types: DataFrame, entries: DataFrame, ratings: DataFrame, collections: DataFrame, p: ReportParams) -> DataFrame:
    """Projects (total, new, by module), data types, collections, entries by status with the publish rate, and ratings."""
    modules = F.coalesce(F.from_json("enabled_modules", "array<string>"), F.array().cast("array<string>"))
    n = F.count(F.lit(1))
    head = live(projects).agg(n.alias("projects"), count_if(in_range(c("created_at"), p)).alias("new_projects"), *[count_if(F.array_contains(modules, m)).alias(f"with_{m}") for m in ("ecommerce", "booking")])
    kinds = live(types).agg(n.alias("data_types"))
    rows = live(entries).agg(n.alias("entries"), *[count_if(c("status") == s).alias(s) for s in STATUS]).withColumn("publish_rate", rate(c("published"), c("entries")))
    rated = ratings.agg(n.alias("ratings"), mean(F.coalesce(F.sum("rating"), F.lit(0)), n).alias("avg_rating"))
    sets = collections.agg(n.alias("collections"))
    out = head
    for one in (kinds, rows, rated, sets):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def content_summary(types: DataFrame, entries: DataFrame) -> DataFrame:
    """Per data type: live entries by status, publish rate, mean of their averages, ratings; types without entries stay."""
    own = live(entries).groupBy("data_type").agg(
        F.count(F.lit(1)).alias("total"), *[count_if(c("status") == s).alias(s) for s in STATUS], F.sum("ratings_avg").alias("avg_sum"), F.count("ratings_avg").alias("averages"), F.sum("ratings_count").alias("ratings"),
    )
    out = live(types).join(own, "data_type", "left")
    zero = lambda s: F.coalesce(c(s), F.lit(0))
    return out.select("data_type", zero("total").alias("total"), *[zero(s).alias(s) for s in STATUS], rate(zero("published"), zero("total")).alias("publish_rate"), mean(zero("avg_sum"), zero("averages")).alias("avg_rating"), zero("ratings").alias("ratings"))


def collection_stats(collections: DataFrame) -> DataFrame:
    return collections.agg(F.count(F.lit(1)).alias("total"), *[count_if(c("type") == s).alias(s) for s in ("manual", "dynamic")], count_if(c("is_offer")).alias("offer_collections"), count_if(c("is_active")).alias("active"))


def growth(rows: DataFrame, column: str, p: ReportParams) -> DataFrame:
    """Rows per bucket of a time column."""
    return live(rows).where(in_range(c(column), p)).groupBy(bucket(c(column), p.period).alias("period")).agg(F.count(F.lit(1)).alias("count"))


def content_growth(entries: DataFrame, p: ReportParams) -> DataFrame:
    return growth(entries.where(c("status") == "published"), "published_at", p)


def top_rated(entries: DataFrame, limit: int) -> DataFrame:
    own = live(entries).where("ratings_count > 0")
    return own.orderBy(F.desc("ratings_avg"), F.desc("ratings_count"), "id").limit(limit).select("id", "data_type", c("ratings_avg").cast("double").alias("ratings_avg"), "ratings_count")


def ratings_summary(ratings: DataFrame, entries: DataFrame, p: ReportParams) -> DataFrame:
    own = ratings.where(in_range(c("created_at"), p) & (c("rateable_type") == "data")).join(live(entries).select(c("id").alias("rateable_id")), "rateable_id", "left_semi")
    n = F.count(F.lit(1))
    return own.agg(n.alias("total"), mean(F.coalesce(F.sum("rating"), F.lit(0)), n).alias("avg_rating"), count_if(c("review") != "").alias("with_review"))


def project_rating(ratings: DataFrame, p: ReportParams) -> DataFrame:
    """Ratings of the projects themselves, per project."""
    n = F.count(F.lit(1))
    return ratings.where(in_range(c("created_at"), p) & (c("rateable_type") == "project")).groupBy(c("rateable_id").alias("project_id")).agg(n.alias("total"), mean(F.sum("rating"), n).alias("avg_rating"))


def ratings_histogram(ratings: DataFrame) -> DataFrame:
    """All five stars, counted in one aggregate and then unpivoted."""
    total = ratings.agg(*[count_if(c("rating") == s).alias(str(s)) for s in range(1, 6)])
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stars"), c(str(s)).alias("count"), sum((c(str(t)) for t in range(1, 6)), F.lit(0)).alias("n")) for s in range(1, 6)])).alias("s")).select("s.*")
    return rows.select("stars", "count", rate(c("count"), c("n")).alias("percentage"))


def ratings_trend(ratings: DataFrame, p: ReportParams) -> DataFrame:
    n = F.count(F.lit(1))
    return ratings.where(in_range(c("created_at"), p)).groupBy(bucket(c("created_at"), p.period).alias("period")).agg(n.alias("count"), mean(F.sum("rating"), n).alias("avg_rating"))


def recompute_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating of each user counts; count and mean per rated entry."""
    last = ratings.groupBy("rateable_type", "rateable_id", "user_id").agg(F.max_by("rating", F.struct("created_at", "id")).alias("rating"))
    n = F.count(F.lit(1))
    return last.groupBy("rateable_type", "rateable_id").agg(n.alias("ratings_count"), mean(F.sum("rating"), n).alias("ratings_avg"))


# Entity-attribute-value records.


def eav_pivot(values: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row an entry, a typed column a field (name -> type); of several values the last id wins."""
    def cell(name: str, kind: str) -> Column:
        last = F.max_by(F.when(c("field") == name, c("value")), F.when(c("field") == name, c("id")))
        return (last.try_cast(kind) if kind != "string" else last).alias(name)

    return values.where(c("field").isin(*fields)).groupBy("entry_id").agg(*[cell(n, k) for n, k in fields.items()])


def language_fallback(values: DataFrame, language: str, fallback: str) -> DataFrame:
    """Per entry and field the value of the best language: asked, fallback, '0', none."""
    priority = F.when(c("language") == language, 0).when(c("language") == fallback, 1).when(c("language") == "0", 2).when(c("language").isNull(), 3)
    ranked = values.withColumn("_p", priority).where("_p is not null")
    return ranked.groupBy("entry_id", "field").agg(F.min_by("value", F.struct("_p", "id")).alias("value"))


def written(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Rows to insert from (entry_id, field, language, values array): one a value, default languages as null.

    A field that the entry's type lacks is an error, raised when the rows are computed.
    """
    language = F.when(c("language").isin("default", ""), None).otherwise(c("language"))
    rows = values.join(fields.select(c("name").alias("field"), c("id").alias("field_id")), "field", "left")
    known = F.when(c("field_id").isNull(), F.raise_error(F.concat(F.lit("Unknown field "), c("field")))).otherwise(c("field_id")).cast(fields.schema["id"].dataType)
    return rows.select("entry_id", "field", known.alias("field_id"), language.alias("language"), F.explode_outer("values").alias("value"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values after a partial write: each written (entry, field, language) replaces what it had.

    A field that is written in no language only becomes untranslated: all its languages go.
    """
    kinds = new.groupBy("entry_id", "field").agg(F.count_distinct(F.coalesce("language", F.lit(""))).alias("n"), F.bool_and(c("language").isNull()).alias("plain"))
    whole = kinds.where((c("n") == 1) & c("plain")).select("entry_id", "field")
    keys = new.select("entry_id", "field", c("language").alias("_l")).distinct()
    kept = old.join(whole, ["entry_id", "field"], "left_anti")
    same = (kept["entry_id"] == keys["entry_id"]) & (kept["field"] == keys["field"]) & kept["language"].eqNullSafe(keys["_l"])
    return kept.join(keys, same, "left_anti").unionByName(new.select(*old.columns) if set(old.columns) <= set(new.columns) else new, allowMissingColumns=True)


def record(entries: DataFrame, types: DataFrame, values: DataFrame, seo: DataFrame, now: str, language: str, fallback: str) -> DataFrame:
    """Visible entries with their type, one map of values, media lists, and SEO text in the asked language or else the fallback.

    ``values`` has (entry_id, field, type, language, value, id). Media fields list all
    their values; the others have the best language's.
    """
    at = F.lit(now).cast("timestamp_ntz")
    own = entries.where(c("scheduled_at").isNull() | (c("scheduled_at") <= at))
    usable = values.where(c("language").isin(language, fallback, "0") | c("language").isNull())
    media = c("type").isin("image", "file")
    texts = language_fallback(usable.where(~media), language, fallback).groupBy(c("entry_id").alias("_v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("values"))
    item = F.struct("id", c("value").alias("url"), F.substring_index("value", "/", -1).alias("name"), F.when(c("value").contains("."), F.substring_index("value", ".", -1)).otherwise("").alias("extension"))
    files = usable.where(media & (c("value") != "")).groupBy(c("entry_id").alias("_m"), "field").agg(F.sort_array(F.collect_list(item)).alias("items")).groupBy("_m").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "items")))).alias("media"))
    # The asked language sorts first.
    wanted = (c("language") == language).cast("int")
    best = seo.where(c("language").isin(language, fallback)).groupBy(c("entry_id").alias("_s")).agg(F.max_by(F.struct("language", "title", "description"), F.struct(wanted, -c("id"))).alias("seo"))
    out = own.join(types.select(c("id").alias("data_type_id"), c("slug").alias("data_type_slug"), c("name").alias("data_type_name")), "data_type_id")
    return out.join(texts, c("id") == c("_v"), "left").join(files, c("id") == c("_m"), "left").join(best, c("id") == c("_s"), "left").drop("_v", "_m", "_s")


def seo_of(seo: DataFrame, language: str) -> DataFrame:
    """SEO rows by entry, the asked language first, then by language."""
    return seo.orderBy("entry_id", (c("language") == language).desc(), "language")


PREDICATES: dict[str, Callable[[Column, object], Column]] = {
    "=": lambda v, x: v == x, "!=": lambda v, x: v != x, ">": lambda v, x: v > x, "<": lambda v, x: v < x, ">=": lambda v, x: v >= x, "<=": lambda v, x: v <= x,
    "between": lambda v, x: v.between(*x), "in": lambda v, x: v.isin(*x), "contains": lambda v, x: v.contains(x),
}


def register_predicate(op: str, build: Callable[[Column, object], Column]) -> None:
    PREDICATES[op] = build


def matching(values: DataFrame, field: str, op: str, value: object, kind: str = "string", items: DataFrame | None = None, collections: DataFrame | None = None) -> DataFrame:
    """Ids of entries for which a condition holds.

    ``not_contains`` is every entry but those that contain; ``incollection``
    takes collection slugs and follows ``collections`` to ``items``.
    """
    ids = values.select("entry_id").distinct()
    if op == "not_contains":
        return ids.join(matching(values, field, "contains", value), "entry_id", "left_anti")
    if op == "incollection":
        named = collections.where(c("slug").isin(*value)).select(c("id").alias("collection_id"))
        return items.join(named, "collection_id", "left_semi").select("entry_id").distinct()
    cell = c("value") if kind == "string" else c("value").try_cast(kind)
    return values.where((c("field") == field) & PREDICATES[op](cell, value)).select("entry_id").distinct()


def matching_within(values: DataFrame, within: DataFrame, *condition, **options) -> DataFrame:
    """``matching`` among the entries of ``within`` (entry_id) only; the values are cut first."""
    return matching(values.join(within.select("entry_id").distinct(), "entry_id", "left_semi"), *condition, **options)


def related_to(values: DataFrame, edges: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Ids of entries that refer to an entry with one of the values, and of all that refer to those in turn.

    ``edges`` has (entry_id, related_id, kind); only many-to-one relations lead on.
    """
    target = values.where(c("value").isin(*wanted)).select(c("entry_id").alias("related_id")).distinct()
    direct = edges.join(target, "related_id", "left_semi").select(c("entry_id").alias("id")).distinct()
    onward = edges.where(c("kind") == "many_to_one").select(c("related_id").alias("parent"), c("entry_id").alias("child"))
    return descendants(onward, direct).select(c("id").alias("entry_id"))


def collection(parts: Sequence[DataFrame], logic: str = "and", strict: bool = False) -> DataFrame:
    """Entries of a saved query. No condition gives nothing; unless ``strict``, with "or" too a condition that matches nothing gives nothing."""
    if logic == "and":
        return reduce(lambda a, b: a.join(b, "entry_id", "left_semi"), parts)
    found = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    if strict:
        return found
    tagged = reduce(lambda a, b: a.unionByName(b), [q.agg((F.count(F.lit(1)) > 0).alias("some")) for q in parts])
    return found.join(F.broadcast(tagged.agg(F.bool_and("some").alias("all_some")).where("all_some")))  # one row or none


def manual_items(items: DataFrame, entries: DataFrame) -> DataFrame:
    """A manual collection's live entries in order, renumbered from 1."""
    w = W.partitionBy("collection_id").orderBy("sort_order", "entry_id")
    own = items.join(live(entries).select(c("id").alias("entry_id")), "entry_id", "left_semi")
    return own.select("collection_id", "entry_id", F.row_number().over(w).alias("sort_order"))


def visible(entries: DataFrame, now: str) -> DataFrame:
    return live(entries).where(c("scheduled_at").isNull() | (c("scheduled_at") <= F.lit(now).cast("timestamp_ntz")))


def publish_due(entries: DataFrame, now: str) -> DataFrame:
    due = (c("status") == "scheduled") & (c("scheduled_at") <= F.lit(now).cast("timestamp_ntz"))
    return entries.withColumn("published_at", F.when(due, c("scheduled_at")).otherwise(c("published_at"))).withColumn("status", F.when(due, "published").otherwise(c("status")))


# Relations, as (parent, child) edges.


def closure(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(ancestor, descendant, distance) pairs, shortest distance, safe on cycles; walks until a round adds nothing.

    A round joins the newest pairs only. Each round's pairs are kept by checkpoint
    where the session has a folder for it, which cuts the lineage, and the frame
    before is let go; a session without one keeps them in memory and on disk.
    """
    step = edges.select(c("child").alias("parent"), c("parent").alias("child")) if reverse else edges.select("parent", "child")
    step = step.where("parent != child").distinct()
    context, folder = edges.sparkSession.sparkContext, edges.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    shared = bool(context.getCheckpointDir())
    known = step.select(c("parent").alias("ancestor"), c("child").alias("descendant"), F.lit(1).alias("distance"))
    front, distance = known, 1
    while True:
        distance += 1
        onward = front.join(step, c("descendant") == c("parent")).select("ancestor", c("child").alias("descendant")).where("ancestor != descendant").distinct()
        fresh = onward.join(known, ["ancestor", "descendant"], "left_anti").withColumn("distance", F.lit(distance))
        fresh = fresh.checkpoint() if shared else fresh.persist()
        if not fresh.limit(1).count():
            return known
        known, front = known.unionByName(fresh), fresh


def descendants(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (id) and all ids below them."""
    below = closure(edges).join(ids.select(c("id").alias("ancestor")), "ancestor", "left_semi").select(c("descendant").alias("id"))
    return ids.select("id").union(below).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """Ids that have children and are never a child."""
    return edges.select(c("parent").alias("id")).distinct().join(edges.select(c("child").alias("id")), "id", "left_anti")


def forest(edges: DataFrame) -> DataFrame:
    """(root, id, depth) of every tree: a root has children and is never a child; ids that a cycle alone holds are in none."""
    top = roots(edges).select(c("id").alias("ancestor"))
    below = closure(edges).join(top, "ancestor", "left_semi").select(c("ancestor").alias("root"), c("descendant").alias("id"), c("distance").alias("depth"))
    return top.select(c("ancestor").alias("root"), c("ancestor").alias("id"), F.lit(0).alias("depth")).unionByName(below)


def neighbours(edges: DataFrame) -> DataFrame:
    """Per id: its parents and children as sorted lists, and how many; an entry's relations are few."""
    up = edges.groupBy(c("child").alias("id")).agg(F.sort_array(F.collect_list("parent")).alias("parents"))
    down = edges.groupBy(c("parent").alias("id")).agg(F.sort_array(F.collect_list("child")).alias("children"))
    none = F.array().cast("array<bigint>")
    out = up.join(down, "id", "full").select("id", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))
    return out.withColumn("n_parents", F.size("parents")).withColumn("n_children", F.size("children"))


def dangling(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Relation writes whose related entry does not exist."""
    return edges.join(entries.select(c("id").alias("child")), "child", "left_anti")


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("entry_id").agg(F.max("version").alias("version"), F.max_by("snapshot", "version").alias("snapshot"), F.count(F.lit(1)).alias("versions"))


def version_page(versions: DataFrame, page: int, size: int) -> DataFrame:
    return versions.orderBy("entry_id", F.desc("version")).offset((page - 1) * size).limit(size)


def restore_values(snapshot: DataFrame, languages: Sequence[str] = ("en", "ar")) -> DataFrame:
    """A snapshot's flat ``field_lang`` keys as (entry_id, field, language, value) rows."""
    rows = snapshot.select("entry_id", F.explode(F.from_json("snapshot", "map<string,string>")).alias("key", "value"))
    suffix = rf"^(.*)_({'|'.join(languages)})$"
    has = c("key").rlike(suffix)
    return rows.select("entry_id", F.when(has, F.regexp_extract("key", suffix, 1)).otherwise(c("key")).alias("field"), F.when(has, F.regexp_extract("key", suffix, 2)).alias("language"), "value")
