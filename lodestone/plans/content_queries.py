"""Content, EAV, graph, version and rating queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content as ct, indexing as ix, upsert
from ..params import ReportParams
from ..sources.standin import mean, rate
from .catalog import register

P = ReportParams("2024-01-05", "2024-02-10", "weekly", 10)
IN = "BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-02-10 23:59:59'"
N = "COUNT(*)"
STATUS = ", ".join(f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}" for s in ct.STATUS)
LIVE = "s_entries WHERE deleted_at IS NULL"


register("admin_overview", f"SELECT *, {rate('published', 'entries')} AS publish_rate FROM (SELECT COUNT(*) AS projects, COUNT(*) FILTER (WHERE created_at {IN}) AS new_projects, COUNT(*) FILTER (WHERE id % 3 < 2) AS with_ecommerce, COUNT(*) FILTER (WHERE id % 3 = 1) AS with_booking FROM s_projects WHERE deleted_at IS NULL) a, (SELECT COUNT(*) AS data_types FROM s_types WHERE deleted_at IS NULL) b, (SELECT COUNT(*) AS entries, {STATUS} FROM {LIVE}) c, (SELECT COUNT(*) AS ratings, {mean('COALESCE(SUM(rating), 0)', N)} AS avg_rating FROM s_ratings) d, (SELECT COUNT(*) AS collections FROM s_collections) e", lambda t: ct.admin_overview(t("s_projects"), t("s_types"), t("s_entries"), t("s_ratings"), t("s_collections"), P))
register("projects_growth", f"SELECT strftime(created_at, '%G-W%V') AS period, COUNT(*) AS count FROM s_projects WHERE deleted_at IS NULL AND created_at {IN} GROUP BY 1", lambda t: ct.growth(t("s_projects"), "created_at", P))
register("collection_stats", "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE type = 'manual') AS manual, COUNT(*) FILTER (WHERE type = 'dynamic') AS dynamic, COUNT(*) FILTER (WHERE is_offer) AS offer_collections, COUNT(*) FILTER (WHERE is_active) AS active FROM s_collections", lambda t: ct.collection_stats(t("s_collections")))
register("project_rating", f"SELECT rateable_id AS project_id, COUNT(*) AS total, {mean('SUM(rating)', N)} AS avg_rating FROM s_ratings WHERE rateable_type = 'project' AND created_at {IN} GROUP BY 1", lambda t: ct.project_rating(t("s_ratings"), P))
register("content_summary", f"SELECT data_type, COUNT(*) AS total, {STATUS}, {rate('COUNT(*) FILTER (WHERE status = ' + chr(39) + 'published' + chr(39) + ')', N)} AS publish_rate, {mean('COALESCE(SUM(ratings_avg), 0)', 'COUNT(ratings_avg)')} AS avg_rating, CAST(SUM(ratings_count) AS BIGINT) AS ratings FROM {LIVE} GROUP BY 1", lambda t: ct.content_summary(t("s_entries").select("data_type").distinct(), t("s_entries")))
register("content_growth", f"SELECT strftime(published_at, '%G-W%V') AS period, COUNT(*) AS count FROM {LIVE} AND status = 'published' AND published_at {IN} GROUP BY 1", lambda t: ct.content_growth(t("s_entries"), P))
register("top_rated", f"SELECT id, data_type, CAST(ratings_avg AS DOUBLE) AS ratings_avg, ratings_count FROM {LIVE} AND ratings_count > 0 ORDER BY 3 DESC, 4 DESC, 1 LIMIT 10", lambda t: ct.top_rated(t("s_entries"), 10))
register("ratings_summary", f"SELECT COUNT(*) AS total, {mean('COALESCE(SUM(rating), 0)', N)} AS avg_rating, COUNT(*) FILTER (WHERE review <> '') AS with_review FROM s_ratings WHERE created_at {IN} AND rateable_type = 'data' AND rateable_id IN (SELECT id FROM {LIVE})", lambda t: ct.ratings_summary(t("s_ratings"), t("s_entries"), P))
register("ratings_histogram", f"SELECT CAST(stars AS INT) AS stars, COUNT(rating) AS count, {rate('COUNT(rating)', '(SELECT COUNT(*) FROM s_ratings)')} AS percentage FROM (SELECT UNNEST(range(1, 6)) AS stars) LEFT JOIN s_ratings ON rating = stars GROUP BY 1", lambda t: ct.ratings_histogram(t("s_ratings")))
register("ratings_trend", f"SELECT strftime(created_at, '%G-W%V') AS period, COUNT(*) AS count, {mean('SUM(rating)', N)} AS avg_rating FROM s_ratings WHERE created_at {IN} GROUP BY 1", lambda t: ct.ratings_trend(t("s_ratings"), P))
register("ratings_recompute", f"SELECT rateable_type, rateable_id, COUNT(*) AS ratings_count, {mean('SUM(rating)', N)} AS ratings_avg FROM (SELECT rateable_type, rateable_id, user_id, arg_max(rating, CAST(created_at AS VARCHAR) || lpad(CAST(id AS VARCHAR), 12, '0')) AS rating FROM s_ratings GROUP BY 1, 2, 3) GROUP BY 1, 2", lambda t: ct.recompute_ratings(t("s_ratings")))
register("visible_entries", "SELECT id, status FROM s_entries WHERE deleted_at IS NULL AND (scheduled_at IS NULL OR scheduled_at <= TIMESTAMP '2024-02-01 00:00:00')", lambda t: ct.visible(t("s_entries"), "2024-02-01 00:00:00").select("id", "status"))
register("publish_due", "SELECT CASE WHEN status = 'scheduled' AND scheduled_at <= TIMESTAMP '2024-02-01 00:00:00' THEN 'published' ELSE status END AS status, COUNT(*) AS n FROM s_entries GROUP BY 1", lambda t: ct.publish_due(t("s_entries"), "2024-02-01 00:00:00").groupBy("status").agg(F.count(F.lit(1)).alias("n")))

# EAV
LAST = "SELECT entry_id, field, arg_max(value, id) AS value FROM s_values GROUP BY 1, 2"
register("eav_pivot", f"SELECT entry_id, MAX(value) FILTER (WHERE field = 'name') AS name, MAX(value) FILTER (WHERE field = 'brand') AS brand, TRY_CAST(MAX(value) FILTER (WHERE field = 'size') AS DOUBLE) AS size FROM ({LAST}) GROUP BY 1", lambda t: ct.eav_pivot(t("s_values"), {"name": "string", "brand": "string", "size": "double"}))
register("eav_lang_fallback", "SELECT entry_id, field, arg_min(value, CAST(p AS BIGINT) * 1000000000 + id) AS value FROM (SELECT *, CASE WHEN language = 'fr' THEN 0 WHEN language = 'en' THEN 1 WHEN language = '0' THEN 2 WHEN language IS NULL THEN 3 END AS p FROM s_values) WHERE p IS NOT NULL GROUP BY 1, 2", lambda t: ct.language_fallback(t("s_values"), "fr", "en"))
CONDITIONS = {
    "eq": (("brand", "=", "Brand#2", "string"), "field = 'brand' AND value = 'Brand#2'"),
    "gt": (("size", ">", 40, "double"), "field = 'size' AND TRY_CAST(value AS DOUBLE) > 40"),
    "between": (("size", "between", (10, 20), "double"), "field = 'size' AND TRY_CAST(value AS DOUBLE) BETWEEN 10 AND 20"),
    "in": (("brand", "in", ("Brand#11", "Brand#12"), "string"), "field = 'brand' AND value IN ('Brand#11', 'Brand#12')"),
    "contains": (("name", "contains", "ar", "string"), "field = 'name' AND value LIKE '%ar%'"),
}
ID = "SELECT DISTINCT entry_id FROM s_values WHERE "
for name, (args, where) in CONDITIONS.items():
    register(f"eav_predicate_{name}", ID + where, lambda t, args=args: ct.matching(t("s_values"), *args))
register("eav_predicate_not_contains", f"SELECT DISTINCT entry_id FROM s_values EXCEPT {ID}{CONDITIONS['contains'][1]}", lambda t: ct.matching(t("s_values"), "name", "not_contains", "ar"))
register("eav_predicate_incollection", "SELECT DISTINCT c_custkey AS entry_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", lambda t: ct.matching(t("s_values"), "", "incollection", ["BUILDING", "MACHINERY"], items=t("customers").select(F.col("c_custkey").alias("entry_id"), F.col("c_mktsegment").alias("collection_id")), collections=t("customers").select(F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("slug")).distinct()))
register("eav_and", f"{ID}{CONDITIONS['gt'][1]} INTERSECT {ID}{CONDITIONS['contains'][1]}", lambda t: ct.collection([ct.matching(t("s_values"), *CONDITIONS[k][0]) for k in ("gt", "contains")]))
register("eav_or", f"{ID}{CONDITIONS['eq'][1]} UNION {ID}{CONDITIONS['gt'][1]}", lambda t: ct.collection([ct.matching(t("s_values"), *CONDITIONS[k][0]) for k in ("eq", "gt")], "or", strict=True))
EITHER = f"{ID}{CONDITIONS['gt'][1]} UNION {ID}field = 'brand' AND value = '{{0}}'"
register("eav_or_empty_condition", f"SELECT 'none' AS brand, COUNT(*) AS n FROM ({EITHER.format('none')}) WHERE EXISTS ({ID}field = 'brand' AND value = 'none') UNION ALL SELECT 'Brand#2', COUNT(*) FROM ({EITHER.format('Brand#2')}) WHERE EXISTS ({ID}field = 'brand' AND value = 'Brand#2')", lambda t: (lambda one: one("none").unionByName(one("Brand#2")))(lambda brand: ct.collection([ct.matching(t("s_values"), *CONDITIONS["gt"][0]), ct.matching(t("s_values"), "brand", "=", brand)], "or").agg(F.lit(brand).alias("brand"), F.count(F.lit(1)).alias("n"))))
for name, op in {"ne": "!=", "lt": "<", "ge": ">=", "le": "<="}.items():
    register(f"eav_predicate_{name}", f"{ID}field = 'size' AND TRY_CAST(value AS DOUBLE) {op} 25", lambda t, op=op: ct.matching(t("s_values"), "size", op, 25, "double"))
register("eav_within", f"{ID}{CONDITIONS['gt'][1]} AND entry_id % 4 = 1", lambda t: ct.matching_within(t("s_values"), t("parts").where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("entry_id")), *CONDITIONS["gt"][0]))
WRITE = "SELECT p_partkey AS entry_id, 'name' AS field, CASE WHEN p_partkey % 2 = 0 THEN 'default' ELSE 'fr' END AS language, p_type AS a, p_brand AS b FROM part WHERE p_partkey % 3 = 0"
register("eav_write", f"WITH n AS (SELECT entry_id, field, 0 AS field_id, CASE WHEN language = 'default' THEN NULL ELSE language END AS language, UNNEST([a, b]) AS value FROM ({WRITE})), o AS (SELECT entry_id, field, language, value FROM s_values) SELECT entry_id, field, language, value FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.entry_id = o.entry_id AND n.field = o.field AND (n.language IS NULL OR n.language IS NOT DISTINCT FROM o.language))", lambda t: ct.replaced(t("s_values").select("entry_id", "field", "language", "value"), ct.written(t("parts").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entry_id"), F.lit("name").alias("field"), F.when(F.col("p_partkey") % 2 == 0, "default").otherwise("fr").alias("language"), F.array("p_type", "p_brand").alias("values")), t("s_fields").where("data_type_id = 0 and id = 0"))))
AT = "TIMESTAMP '2024-02-01 00:00:00'"
BEST = "CASE WHEN language = 'fr' THEN 0 WHEN language = 'en' THEN 1 WHEN language = '0' THEN 2 WHEN language IS NULL THEN 3 END"
register("entry_record", f"SELECT e.id, data_type_slug, n_values, name, photos, first_photo, extension, seo_title FROM s_content e LEFT JOIN (SELECT entry_id, COUNT(DISTINCT field) AS n_values, arg_min(value, CAST({BEST} AS BIGINT) * 1000000000 + id) FILTER (WHERE field = 'name') AS name FROM s_typed WHERE type <> 'image' AND {BEST} IS NOT NULL GROUP BY 1) v ON v.entry_id = e.id LEFT JOIN (SELECT entry_id, COUNT(*) AS photos, arg_min(split_part(value, '/', 2), id) AS first_photo, 'png' AS extension FROM s_typed WHERE type = 'image' GROUP BY 1) m ON m.entry_id = e.id LEFT JOIN (SELECT entry_id, COALESCE(MAX(title) FILTER (WHERE language = 'fr'), MAX(title) FILTER (WHERE language = 'en')) AS seo_title FROM s_seo GROUP BY 1) s ON s.entry_id = e.id WHERE scheduled_at IS NULL OR scheduled_at <= {AT}", lambda t: ct.record(t("s_content").drop("entry_id", "data_type_slug"), t("s_content").select(F.col("data_type_id").alias("id"), F.col("data_type_slug").alias("slug"), F.col("data_type_slug").alias("name")).distinct(), t("s_typed"), t("s_seo"), "2024-02-01 00:00:00", "fr", "en").select("id", "data_type_slug", F.size("values").cast("long").alias("n_values"), F.col("values")["name"].alias("name"), F.size(F.col("media")["photo"]).cast("long").alias("photos"), F.col("media")["photo"][0]["name"].alias("first_photo"), F.col("media")["photo"][0]["extension"].alias("extension"), F.col("seo.title").alias("seo_title")))
register("seo_by_language", "SELECT id, entry_id, language FROM s_seo ORDER BY entry_id, language = 'fr' DESC, language LIMIT 50", lambda t: ct.seo_of(t("s_seo"), "fr").limit(50).select("id", "entry_id", "language"))
register("eav_relation_predicate", "WITH RECURSIVE target AS (SELECT DISTINCT entry_id FROM s_values WHERE value IN ('Brand#2', 'Brand#7')), w AS (SELECT entry_id FROM s_relations WHERE related_id IN (SELECT entry_id FROM target) UNION SELECT r.entry_id FROM w JOIN s_relations r ON r.related_id = w.entry_id AND r.kind = 'many_to_one') SELECT entry_id FROM w", lambda t: ct.related_to(t("s_values"), t("s_relations"), ["Brand#2", "Brand#7"]))
register("eav_number_map", f"SELECT entry_id, TRY_CAST(value AS DOUBLE) AS number FROM ({LAST}) WHERE field = 'size'", lambda t: ct.eav_pivot(t("s_values"), {"size": "double"}).withColumnRenamed("size", "number"))
register("manual_collection", "SELECT collection_id, entry_id, CAST(ROW_NUMBER() OVER (PARTITION BY collection_id ORDER BY sort_order, entry_id) AS INT) AS sort_order FROM (SELECT p_partkey % 10 AS collection_id, p_partkey AS entry_id, p_size AS sort_order FROM part) WHERE entry_id IN (SELECT id FROM s_entries WHERE deleted_at IS NULL)", lambda t: ct.manual_items(t("parts").select((F.col("p_partkey") % 10).alias("collection_id"), F.col("p_partkey").alias("entry_id"), F.col("p_size").alias("sort_order")), t("s_entries")))

# Graph
WALK = "WITH RECURSIVE w(ancestor, descendant, distance) AS (SELECT parent, child, 1 FROM s_edges UNION SELECT w.ancestor, e.child, w.distance + 1 FROM w JOIN s_edges e ON e.parent = w.descendant WHERE w.distance < 12) SELECT ancestor, descendant, CAST(MIN(distance) AS INT) AS distance FROM w WHERE ancestor <> descendant GROUP BY 1, 2"
register("graph_closure", WALK, lambda t: ct.closure(t("s_edges")))
register("tree_roots", "SELECT DISTINCT parent AS id FROM s_edges WHERE parent NOT IN (SELECT child FROM s_edges)", lambda t: ct.roots(t("s_edges")))
register("graph_neighbours", "SELECT COALESCE(u.id, d.id) AS id, COALESCE(parents, '') AS parents, COALESCE(children, '') AS children, COALESCE(u.n, 0) AS n_parents, COALESCE(d.n, 0) AS n_children FROM (SELECT child AS id, COUNT(*) AS n, array_to_string(list_sort(list(parent)), ',') AS parents FROM s_edges GROUP BY 1) u FULL JOIN (SELECT parent AS id, COUNT(*) AS n, array_to_string(list_sort(list(child)), ',') AS children FROM s_edges GROUP BY 1) d ON u.id = d.id", lambda t: ct.neighbours(t("s_edges")).withColumns({k: F.array_join(F.col(k).cast("array<string>"), ",") for k in ("parents", "children")} | {k: F.col(k).cast("long") for k in ("n_parents", "n_children")}))
register("entry_forest", "WITH RECURSIVE r AS (SELECT DISTINCT parent AS root FROM s_edges WHERE parent NOT IN (SELECT child FROM s_edges)), w(root, id, depth) AS (SELECT root, root, 0 FROM r UNION SELECT w.root, e.child, w.depth + 1 FROM w JOIN s_edges e ON e.parent = w.id WHERE w.depth < 12) SELECT root, id, CAST(MIN(depth) AS INT) AS depth FROM w GROUP BY 1, 2", lambda t: ct.forest(t("s_edges")))
register("relation_check", "SELECT parent, child FROM s_edges WHERE child NOT IN (SELECT 1000 + s_suppkey FROM supplier)", lambda t: ct.dangling(t("s_edges"), t("s_resources").select((F.col("id") + 1000).alias("id"))).select("parent", "child"))

# Versions
register("version_latest", "SELECT entry_id, MAX(version) AS version, arg_max(snapshot, version) AS snapshot, COUNT(*) AS versions FROM s_versions GROUP BY 1", lambda t: ct.latest_version(t("s_versions")))
register("version_page", "SELECT entry_id, version FROM s_versions ORDER BY entry_id, version DESC LIMIT 25 OFFSET 50", lambda t: ct.version_page(t("s_versions"), 3, 25).select("entry_id", "version"))
register("version_restore", "SELECT p_partkey AS entry_id, 'title' AS field, 'en' AS language, p_name AS value FROM part UNION ALL SELECT p_partkey, 'title', 'ar', p_brand FROM part UNION ALL SELECT p_partkey, 'type', NULL, p_type FROM part", lambda t: ct.restore_values(t("parts").select(F.col("p_partkey").alias("entry_id"), F.to_json(F.struct(F.col("p_name").alias("title_en"), F.col("p_brand").alias("title_ar"), F.col("p_type").alias("type"))).alias("snapshot"))))
register("entry_search_exists", "SELECT id FROM s_entries e WHERE EXISTS (SELECT 1 FROM s_values v WHERE v.entry_id = e.id AND value LIKE '%5%') AND published_at >= TIMESTAMP '2024-01-10 00:00:00' AND published_at < TIMESTAMP '2024-02-01 00:00:00'", lambda t: t("s_entries").where((F.col("published_at") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("published_at") < F.lit("2024-02-01").cast("timestamp_ntz"))).join(t("s_values").where(F.col("value").contains("5")).select(F.col("entry_id").alias("id")), "id", "left_semi").select("id"))
register("entries_by_type_page", "SELECT id, data_type FROM s_entries WHERE data_type = 'src1' AND deleted_at IS NULL ORDER BY published_at DESC, id LIMIT 20", lambda t: upsert.page(t("s_entries").where("data_type = 'src1' and deleted_at is null"), [F.desc("published_at"), "id"], 1, 20).select("id", "data_type"))

# Index
CLEAN = "trim(regexp_replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
TEXTS = f"""SELECT entry_id, language, {CLEAN.format("arg_min(value, id) FILTER (WHERE k = 0)")} AS title, COALESCE(string_agg({CLEAN.format("value")}, ' ' ORDER BY id) FILTER (WHERE k = 1), '') AS content, MIN(id) FILTER (WHERE k = 0) AS first FROM (SELECT *, CASE WHEN lower(type) IN ('text', 'string', 'title') THEN 0 WHEN type IN ('richtext', 'markdown') THEN 1 ELSE 2 END AS k FROM (SELECT id, entry_id, field, type, COALESCE(language, 'en') AS language, value FROM s_typed WHERE value <> '')) GROUP BY 1, 2"""
REST = f"SELECT v.entry_id, v.language, v.field, arg_max(v.value, v.id) AS value FROM (SELECT id, entry_id, field, type, COALESCE(language, 'en') AS language, value FROM s_typed WHERE value <> '') v JOIN ({TEXTS}) x ON x.entry_id = v.entry_id AND x.language = v.language WHERE v.type NOT IN ('richtext', 'markdown') AND v.id IS DISTINCT FROM x.first GROUP BY 1, 2, 3"
register("index_fields", f"SELECT x.entry_id, x.language, title, content, CAST(COUNT(m.field) AS INT) AS meta FROM ({TEXTS}) x LEFT JOIN ({REST}) m ON m.entry_id = x.entry_id AND m.language = x.language GROUP BY 1, 2, 3, 4", lambda t: ix.fields_of(t("s_typed")).withColumn("meta", F.size("meta")))
LANGUAGES = "CASE id % 3 WHEN 0 THEN ['en', 'fr'] ELSE ['en'] END"
INDEXED = f"SELECT e.entry_id, x.language, title, content, string_agg(m.value, ' ' ORDER BY m.field) AS meta FROM s_content e JOIN (SELECT id AS project_id, UNNEST({LANGUAGES}) AS language FROM s_projects) p ON p.project_id = e.project_id JOIN ({TEXTS}) x ON x.entry_id = e.entry_id AND x.language = p.language LEFT JOIN ({REST}) m ON m.entry_id = x.entry_id AND m.language = x.language WHERE e.status = 'published' AND deleted_at IS NULL AND title <> '' GROUP BY 1, 2, 3, 4"
SPOKEN = "trim(regexp_replace(lower(concat_ws(' ', title, CASE WHEN content <> '' THEN content END, meta)), '\\s+', ' ', 'g'))"
register("index_build", f"SELECT entry_id, language, title, content, {SPOKEN} AS search_text FROM ({INDEXED})", lambda t: ix.reindex(t("s_content"), t("s_typed"), t("s_projects")).select("entry_id", "language", "title", "content", "search_text"))
register("index_update", "SELECT p_partkey AS entry_id, 'en' AS language, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_name END AS title, p_size AS clicks FROM part", lambda t: ix.update_index(t("parts").select(F.col("p_partkey").alias("entry_id"), F.lit("en").alias("language"), F.col("p_name").alias("title"), F.col("p_size").alias("clicks")), t("parts").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("entry_id"), F.lit("en").alias("language"), F.col("p_type").alias("title"))))
