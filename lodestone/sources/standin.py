"""The driver's tables as the tables that reports read, in Spark SQL and in the oracle's SQL.

``FRAMES`` holds one SELECT a table; both engines run it, so a stand-in means
the same on either side. {x} marks what differs between the dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SPARK = {"plus_hours": "timestampadd(HOUR, CAST({1} AS INT), {0})", "plus_days": "timestampadd(DAY, CAST({1} AS INT), {0})", "ts": "TIMESTAMP_NTZ", "k": "get_json_object(props, '$.k')"}
DUCK = {"plus_hours": "({0} + to_hours(CAST({1} AS INT)))", "plus_days": "({0} + to_days(CAST({1} AS INT)))", "ts": "TIMESTAMP", "k": "json_extract_string(props, '$.k')"}

FRAMES = {
    "s_orders": "SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 0 THEN 'returned' WHEN o_orderstatus = 'F' AND o_orderkey % 10 = 1 THEN 'partially_returned' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'shipped' WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 1 THEN 'paid' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'cancelled' END AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS total_price, o_orderdate AS created_at FROM orders",
    "s_items": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS total, CAST(l_extendedprice - l_tax * 1000 AS DECIMAL(18,2)) AS price, l_returnflag = 'R' AS is_returned FROM lineitem",
    "s_returns": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CASE WHEN l_linestatus = 'F' THEN 'approved' WHEN l_linenumber = 1 THEN 'rejected' ELSE 'pending' END AS status, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'R'",
    "s_prices": "SELECT l_partkey AS entry_id, CAST(ROUND(l_discount * 100) AS BIGINT) AS offer_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS original_price, CAST(l_extendedprice AS DECIMAL(14,2)) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT)) / 100 AS raw_price, l_linenumber % 2 = 0 AS is_applied, l_linenumber % 3 = 0 AS is_code, l_orderkey, l_linenumber, l_shipdate AS created_at FROM lineitem",
    "s_offers": "SELECT p_partkey AS id, p_size % 3 <> 0 AS is_active, p_size % 5 = 0 AS is_code_offer, CASE WHEN p_size % 5 = 0 THEN CONCAT('CODE', CAST(p_partkey AS {string})) END AS code, CASE WHEN p_size % 2 = 0 THEN 'percentage' ELSE 'fixed_amount' END AS benefit_type, {plus_days(CAST('2024-01-01 00:00:00' AS {ts}), p_size)} AS end_at, CASE WHEN p_size % 11 = 0 THEN CAST('2024-01-01 00:00:00' AS {ts}) END AS deleted_at FROM part",
    "s_user_offers": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 50 AS offer_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 = 0",
    "s_resources": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'room' ELSE 'car' END AS type, CAST(1 + s_suppkey % 3 AS BIGINT) AS capacity, CASE WHEN s_suppkey % 10 = 0 THEN 'inactive' ELSE 'active' END AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'paid' ELSE 'free' END AS payment_type, CAST(s_suppkey % 7 AS DOUBLE) AS price, CASE WHEN s_suppkey % 17 = 0 THEN CAST('2024-01-01 00:00:00' AS {ts}) END AS deleted_at FROM supplier",
    "s_availability": "SELECT s_suppkey AS resource_id, CAST(d AS INT) AS day_of_week, 8 AS start_hour, CAST(12 + s_suppkey % 4 AS INT) AS end_hour, 60 AS slot_minutes, d <> 6 AS is_active FROM supplier CROSS JOIN (SELECT n_nationkey AS d FROM nation WHERE n_nationkey < 7) w",
    "s_bookings": "SELECT id, resource_id, user_id, start_at, {plus_hours(start_at, hours)} AS end_at, status, amount, refund_amount, created_at FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS resource_id, o_custkey AS user_id, {plus_hours(l_shipdate, 7 + l_orderkey % 8)} AS start_at, CASE WHEN l_linenumber = 7 THEN 30 ELSE 1 + l_orderkey % 3 END AS hours, CASE l_linenumber % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'completed' WHEN 3 THEN 'cancelled' ELSE 'no_show' END AS status, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_linenumber % 5 <> 1 AND l_quantity > 10 THEN CAST(l_quantity AS DECIMAL(18,2)) END AS refund_amount, o_orderdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x",
    "s_policies": "SELECT s_suppkey AS resource_id, h AS hours_before, CASE h WHEN 0 THEN 0 WHEN 24 THEN 50 ELSE 100 END AS refund_percentage FROM supplier CROSS JOIN (SELECT CAST(n_nationkey * 24 AS INT) AS h FROM nation WHERE n_nationkey IN (0, 1, 3)) w",
    "s_searches": "SELECT event_id AS id, user_id, CAST(user_id % 3 AS BIGINT) AS project_id, CONCAT(CASE WHEN user_id % 3 = 0 THEN 'Red ' WHEN user_id % 3 = 1 THEN 'blue ' ELSE '' END, event_type, CASE WHEN event_id % 2 = 0 THEN CONCAT(' k', {k}) WHEN event_id % 47 = 0 THEN ' +++ 14' ELSE '' END) AS keyword, CASE WHEN event_id % 4 = 0 THEN 'fr' ELSE 'en' END AS language, CAST(event_id % 6 AS BIGINT) AS results_count, CAST(event_id % 10 AS DOUBLE) / 10 AS intent_confidence, ts AS searched_at FROM events",
    "s_clicks": "SELECT event_id AS id, user_id, CASE WHEN event_id % 3 > 0 THEN event_id - 1 END AS search_log_id, CAST({k} AS BIGINT) AS entry_id, event_type AS type, CONCAT('text ', event_type, ' word', {k}) AS text, ts AS clicked_at FROM events WHERE event_type IN ('click', 'view')",
    "s_entries": "SELECT doc_id AS id, source AS data_type, lang, CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'archived' ELSE 'published' END AS status, {plus_days(CAST('2024-01-01 10:00:00' AS {ts}), doc_id % 45)} AS published_at, CASE WHEN doc_id % 3 = 0 THEN {plus_days(CAST('2024-01-20 00:00:00' AS {ts}), doc_id % 30)} END AS scheduled_at, CAST(doc_id % 7 AS BIGINT) AS ratings_count, CAST(CAST(doc_id % 50 AS DECIMAL(5,1)) / 10 AS DECIMAL(3,2)) AS ratings_avg, CAST(doc_id % 100 AS BIGINT) AS clicks, CAST(doc_id % 300 AS BIGINT) AS views, CASE WHEN doc_id % 13 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END AS deleted_at, text FROM documents",
    "s_ratings": "SELECT l.doc_id AS id, l.doc_id % 40 AS user_id, CASE WHEN l.doc_id % 9 = 0 THEN 'project' ELSE 'data' END AS rateable_type, l.doc_id % 200 AS rateable_id, CAST(1 + (l.doc_id * 7 + l.quality) % 5 AS BIGINT) AS rating, CASE WHEN l.toxic = 0 THEN 'fine' WHEN l.doc_id % 2 = 0 THEN '' END AS review, {plus_days(CAST('2024-01-01 12:00:00' AS {ts}), l.doc_id % 40)} AS created_at FROM labels l",
    "s_values": "SELECT p_partkey * 4 AS id, p_partkey AS entry_id, 'name' AS field, CASE WHEN p_partkey % 3 = 0 THEN 'en' WHEN p_partkey % 3 = 1 THEN '0' END AS language, p_name AS value FROM part UNION ALL SELECT p_partkey * 4 + 1, p_partkey, 'brand', CAST(NULL AS {string}), p_brand FROM part UNION ALL SELECT p_partkey * 4 + 2, p_partkey, 'size', 'fr', CAST(p_size AS {string}) FROM part UNION ALL SELECT p_partkey * 4 + 3, p_partkey, 'name', 'fr', CONCAT(p_name, ' fr') FROM part WHERE p_partkey % 2 = 0",
    "s_edges": "SELECT CAST(r_regionkey AS BIGINT) AS parent, CAST(100 + n_nationkey AS BIGINT) AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT CAST(100 + s_nationkey AS BIGINT), 1000 + s_suppkey FROM supplier UNION ALL SELECT 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT) FROM supplier WHERE s_suppkey % 25 = 0",
    "s_index": "SELECT doc_id AS id, doc_id AS entry_id, doc_id % 4 AS data_type_id, CASE doc_id % 4 WHEN 0 THEN 'products' WHEN 1 THEN 'articles' WHEN 2 THEN 'services' END AS data_type_slug, CAST(1 AS BIGINT) AS project_id, lang AS language, CASE WHEN doc_id % 9 = 0 THEN 'draft' ELSE 'published' END AS status, split_part(text, '.', 1) AS title, text AS content, lower(text) AS search_text, {plus_days(CAST('2024-01-01 10:00:00' AS {ts}), doc_id % 45)} AS published_at, CAST(doc_id % 100 AS BIGINT) AS clicks, CAST(doc_id % 300 AS BIGINT) AS views, CAST(doc_id % 70 AS DOUBLE) / 10 AS popularity, CAST(doc_id % 10 AS DOUBLE) / 10 AS ctr, CAST(doc_id % 5 AS DOUBLE) / 10 AS freshness FROM documents",
    "s_projects": "SELECT n_nationkey AS id, CONCAT('key-', n_name) AS public_id, CASE n_nationkey % 3 WHEN 0 THEN '[\"ecommerce\"]' WHEN 1 THEN '[\"booking\",\"ecommerce\"]' END AS enabled_modules, CASE n_nationkey % 3 WHEN 0 THEN '[\"en\",\"fr\"]' WHEN 1 THEN '[]' END AS supported_languages, {plus_days(CAST('2024-01-01 10:00:00' AS {ts}), n_nationkey * 3)} AS created_at, CASE WHEN n_nationkey % 8 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END AS deleted_at FROM nation",
    "s_types": "SELECT s_suppkey AS id, s_nationkey AS project_id, CONCAT('slug', CAST(s_suppkey % 7 AS {string})) AS slug, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END AS deleted_at FROM supplier",
    "s_collections": "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'manual' ELSE 'dynamic' END AS type, p_size % 5 = 0 AS is_offer, p_size % 3 = 0 AS is_active FROM part WHERE p_partkey % 4 = 0",
    "s_fields": "SELECT CAST(f AS BIGINT) AS id, CAST(f % 2 AS BIGINT) AS data_type_id, CASE f WHEN 0 THEN 'name' WHEN 1 THEN 'body' WHEN 2 THEN 'brand' WHEN 3 THEN 'photo' WHEN 4 THEN 'name' ELSE 'price' END AS name, CASE f WHEN 0 THEN 'Text' WHEN 1 THEN 'richtext' WHEN 2 THEN 'select' WHEN 3 THEN 'image' WHEN 4 THEN 'text' ELSE 'number' END AS type FROM (SELECT n_nationkey AS f FROM nation WHERE n_nationkey < 6) x",
    "s_typed": "SELECT p_partkey * 10 AS id, p_partkey AS entry_id, 'name' AS field, 'Text' AS type, CASE WHEN p_partkey % 3 = 0 THEN 'fr' WHEN p_partkey % 3 = 1 THEN 'en' END AS language, CONCAT('<b>', p_name, '</b> &amp; more') AS value FROM part UNION ALL SELECT p_partkey * 10 + 1, p_partkey, 'alias', 'string', 'en', p_type FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey * 10 + 2, p_partkey, 'body', 'richtext', 'en', CONCAT('<p>', p_brand, '</p>') FROM part UNION ALL SELECT p_partkey * 10 + 3, p_partkey, 'notes', 'markdown', CAST(NULL AS {string}), p_type FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey * 10 + 4, p_partkey, 'brand', 'select', 'en', p_brand FROM part UNION ALL SELECT p_partkey * 10 + 5 + d, p_partkey, 'photo', 'image', CAST(NULL AS {string}), CONCAT('media/', p_brand, CAST(d AS {string}), '.png') FROM part CROSS JOIN (SELECT n_nationkey AS d FROM nation WHERE n_nationkey < 2) y UNION ALL SELECT p_partkey * 10 + 8, p_partkey, 'empty', 'text', 'en', '' FROM part",
    "s_content": "SELECT p_partkey AS id, p_partkey AS entry_id, p_partkey % 9 AS data_type_id, CONCAT('type', CAST(p_partkey % 9 AS {string})) AS data_type_slug, CAST(p_partkey % 25 AS INT) AS project_id, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'published' END AS status, CASE WHEN p_size % 3 = 0 THEN {plus_days(CAST('2024-01-01 00:00:00' AS {ts}), p_size)} END AS scheduled_at, {plus_days(CAST('2024-01-01 10:00:00' AS {ts}), p_size)} AS published_at, CASE WHEN p_size % 13 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END AS deleted_at FROM part",
    "s_seo": "SELECT p_partkey * 2 AS id, p_partkey AS entry_id, 'en' AS language, p_name AS title, p_type AS description FROM part UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 'fr', CONCAT(p_name, ' fr'), p_type FROM part WHERE p_partkey % 2 = 0",
    "s_relations": "SELECT p_partkey AS entry_id, p_partkey - 7 AS related_id, CASE WHEN p_partkey % 5 = 0 THEN 'many_to_many' ELSE 'many_to_one' END AS kind FROM part WHERE p_partkey % 7 <> 3 UNION ALL SELECT p_partkey, p_partkey + 14, 'many_to_one' FROM part WHERE p_partkey % 50 = 0",
    "s_plans": "SELECT s_suppkey AS id, s_nationkey AS project_id, CONCAT('plan', CAST(s_suppkey % 9 AS {string})) AS slug, s_suppkey % 4 <> 0 AS is_active FROM supplier",
    "s_plan_features": "SELECT s_suppkey AS plan_id, CONCAT('feature', CAST((s_suppkey + d) % 5 AS {string})) AS feature, CAST(d * 10 AS BIGINT) AS feature_limit FROM supplier CROSS JOIN (SELECT n_nationkey AS d FROM nation WHERE n_nationkey < 3) x WHERE s_suppkey % 3 <> 0",
    "s_subscriptions": "SELECT o_orderkey AS id, o_custkey AS user_id, o_orderkey % 10 AS plan_id, CASE WHEN o_orderkey % 6 = 0 THEN 'cancelled' ELSE 'active' END AS status, o_orderkey % 2 = 0 AS auto_renew, CASE WHEN o_orderkey % 9 > 0 THEN {plus_days(o_orderdate, 30)} END AS ends_at FROM orders",
    "s_rules": "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey % 3 AS BIGINT) END AS project_id, CASE n_nationkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'purchase' END AS event_key, CONCAT('feature', CAST(n_nationkey % 5 AS {string})) AS feature, CASE n_nationkey % 3 WHEN 0 THEN 'check' WHEN 1 THEN 'increment' ELSE 'both' END AS mode, CAST(1 + n_nationkey % 2 AS BIGINT) AS amount, n_nationkey % 6 <> 0 AS is_active FROM nation",
    "s_sessions": "SELECT c_custkey AS id, CONCAT('t', CAST(c_custkey AS {string})) AS token, c_custkey AS user_id, {plus_days(CAST('2024-01-01 00:00:00' AS {ts}), c_custkey % 60)} AS expires_at, CASE WHEN c_custkey % 7 = 0 THEN CAST('2024-01-05 00:00:00' AS {ts}) END AS revoked_at FROM customer",
    "s_chats": "SELECT conv_id AS id, CAST(conv_id % 5 AS BIGINT) AS user_id, CASE WHEN conv_id % 4 = 0 THEN 'archived' ELSE 'active' END AS status, {plus_days(CAST('2024-01-01 00:00:00' AS {ts}), conv_id % 20)} AS created_at FROM (SELECT DISTINCT conv_id FROM conversations) x",
    "s_messages": "SELECT conv_id AS conversation_id, turn, text FROM conversations",
    "parts": "SELECT * FROM part",
    "customers": "SELECT * FROM customer",
    "nations": "SELECT * FROM nation",
    "web_pages": "SELECT * FROM pages",
    "event_log": "SELECT * FROM events",
    "s_versions": "SELECT conv_id AS entry_id, turn AS version, CONCAT(role, ':', COALESCE(text, '')) AS snapshot FROM conversations",
}
SPARK["string"], DUCK["string"] = "STRING", "VARCHAR"


def _fill(text: str, dialect: dict[str, str]) -> str:
    for name in ("ts", "k", "string"):
        text = text.replace("{" + name + "}", dialect[name])

    def call(m: re.Match) -> str:
        inner, depth, cut = m[2], 0, 0
        for i, ch in enumerate(inner):
            depth += (ch == "(") - (ch == ")")
            if ch == "," and not depth:
                cut = i
        return dialect[m[1]].format(inner[:cut].strip(), inner[cut + 1 :].strip())

    return re.sub(r"\{(plus_hours|plus_days)\((.*?)\)\}", call, text)


BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in over the parquet tables in ``sf_dir``; the tables are named in the query itself, not as views."""
    text = _fill(FRAMES[name], SPARK)
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", text)
    # The file's name stands for the table's, so qualified names need it as an alias.
    return spark.sql(text)


def oracle(body: str) -> str:
    """The oracle's SQL for a query that names stand-ins."""
    used = [n for n in FRAMES if re.search(rf"\b{n}\b", body)]
    ctes = [f"{n} AS ({_fill(FRAMES[n], DUCK)})" for n in used]
    body = body.strip()
    if m := re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}" + ", ".join([*ctes, body[m.end() :]])
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


def rate(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) > 0 THEN CAST((CAST(({n}) AS BIGINT) * 20000 + CAST(({d}) AS BIGINT)) // (CAST(({d}) AS BIGINT) * 2) AS DOUBLE) / 100 ELSE 0.0 END"


def mean(total: str, n: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN CAST((CAST(({total}) * 100 AS BIGINT) * 2 + CAST(({n}) AS BIGINT)) // (CAST(({n}) AS BIGINT) * 2) AS DOUBLE) / 100 ELSE 0.0 END"
