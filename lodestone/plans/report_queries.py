"""Sales, booking, pricing and access queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, bookings as bk, lookups, pricing, sales, upsert
from ..params import ReportParams
from ..sources.standin import mean, rate
from .catalog import register

A, B = "1996-01-01", "1998-12-31"
P = ReportParams(A, B, "monthly", 10, "2000-01-01 00:00:00")
IN = f"BETWEEN TIMESTAMP '{A} 00:00:00' AND TIMESTAMP '{B} 23:59:59'"
OWN = f"created_at {IN}"
LABEL = {"daily": "strftime({0}, '%Y-%m-%d')", "weekly": "strftime({0}, '%G-W%V')", "monthly": "strftime({0}, '%Y-%m')"}
N = "COUNT(*)"


def flags(*states: str, column: str = "status") -> str:
    return ", ".join(f"COUNT(*) FILTER (WHERE {column} = '{s}') AS {s}" for s in states)


register("sales_summary", f"""SELECT *, {rate("cancelled", "total_orders")} AS cancellation_rate, {rate("returned", "total_orders")} AS return_rate FROM
 (SELECT COUNT(*) AS total_orders, CAST(COALESCE(SUM(total_price), 0) AS DOUBLE) AS total_revenue, {mean("COALESCE(SUM(total_price), 0)", N)} AS avg_order_value, {flags("pending", "paid", "shipped", "delivered", "cancelled")}, COUNT(*) FILTER (WHERE status IN ('returned', 'partially_returned')) AS returned FROM s_orders WHERE {OWN}) a,
 (SELECT CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS items_sold, COUNT(DISTINCT product_id) AS distinct_products FROM s_items JOIN s_orders ON order_id = s_orders.id WHERE {OWN} AND status <> 'cancelled') b,
 (SELECT COUNT(*) AS returns_total, COUNT(*) FILTER (WHERE status = 'pending') AS returns_pending, COUNT(*) FILTER (WHERE status = 'approved') AS returns_approved, COUNT(*) FILTER (WHERE status = 'rejected') AS returns_rejected FROM s_returns WHERE {OWN}) c""",
    lambda t: sales.sales_summary(t("s_orders"), t("s_items"), t("s_returns"), P))
for period, label in LABEL.items():
    own = ReportParams(A, B, period)
    register(f"sales_trend_{period}", f"SELECT {label.format('created_at')} AS period, COUNT(*) AS orders, CAST(SUM(total_price) AS DOUBLE) AS revenue, {mean('SUM(total_price)', N)} AS avg_order_value FROM s_orders WHERE {OWN} AND status <> 'cancelled' GROUP BY 1", lambda t, own=own: sales.sales_trend(t("s_orders"), own))
PRODUCTS = f"SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS quantity_sold, CAST(SUM(total) AS DOUBLE) AS revenue, COUNT(DISTINCT order_id) AS orders, {mean('SUM(price)', N)} AS avg_price FROM s_items JOIN s_orders ON order_id = s_orders.id WHERE {OWN} AND status <> 'cancelled' GROUP BY 1"
register("top_products", f"WITH top AS ({PRODUCTS} ORDER BY quantity_sold DESC, product_id LIMIT 10), back AS (SELECT product_id, COUNT(*) AS n FROM s_returns WHERE status = 'approved' GROUP BY 1) SELECT top.*, COALESCE(n, 0) AS returns, {rate('COALESCE(n, 0)', 'quantity_sold')} AS return_rate FROM top LEFT JOIN back USING (product_id)", lambda t: sales.top_products(t("s_orders"), t("s_items"), t("s_returns"), P))
register("least_sold", f"SELECT product_id, quantity_sold, revenue, orders FROM ({PRODUCTS}) ORDER BY quantity_sold, product_id LIMIT 10", lambda t: sales.least_sold(t("s_orders"), t("s_items"), P))
register("top_customers", f"SELECT user_id, COUNT(*) AS orders, CAST(SUM(total_price) AS DOUBLE) AS spent, {mean('SUM(total_price)', N)} AS avg_order_value, MIN(created_at) AS first_order, MAX(created_at) AS last_order FROM s_orders WHERE {OWN} AND status <> 'cancelled' GROUP BY 1 ORDER BY SUM(total_price) DESC, user_id LIMIT 10", lambda t: sales.top_customers(t("s_orders"), P))
register("customer_new_vs_returning", f"WITH u AS (SELECT DISTINCT user_id FROM s_orders WHERE {OWN}), x AS (SELECT COUNT(*) AS unique_customers, COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s_orders o WHERE o.user_id = u.user_id AND o.created_at < TIMESTAMP '{A} 00:00:00')) AS new_customers FROM u) SELECT *, GREATEST(unique_customers - new_customers, 0) AS returning_customers, {rate('new_customers', 'unique_customers')} AS new_rate FROM x", lambda t: sales.new_and_returning(t("s_orders"), P))
register("returns_summary", f"SELECT *, {rate('approved', 'total')} AS approval_rate, {rate('total', 'orders')} AS return_vs_orders FROM (SELECT COUNT(*) AS total, {flags('pending', 'approved', 'rejected')}, CAST(COALESCE(SUM(quantity), 0) AS BIGINT) AS items_returned FROM s_returns WHERE {OWN}) a, (SELECT COUNT(*) AS orders FROM s_orders WHERE {OWN}) b", lambda t: sales.returns_summary(t("s_orders"), t("s_returns"), P))
register("most_returned", f"SELECT product_id, COUNT(*) AS requests, CAST(SUM(quantity) AS BIGINT) AS quantity, COUNT(*) FILTER (WHERE status = 'approved') AS approved FROM s_returns WHERE {OWN} GROUP BY 1 ORDER BY requests DESC, quantity DESC, product_id LIMIT 10", lambda t: sales.most_returned(t("s_returns"), P))
register("returns_trend", f"SELECT {LABEL['monthly'].format('created_at')} AS period, COUNT(*) AS requests FROM s_returns WHERE {OWN} GROUP BY 1", lambda t: sales.returns_trend(t("s_returns"), P))
register("offers_summary", "SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE is_active) AS active, COUNT(*) FILTER (WHERE is_code_offer) AS code_offers, COUNT(*) FILTER (WHERE NOT is_code_offer) AS automatic_offers FROM s_offers WHERE deleted_at IS NULL", lambda t: sales.offers_summary(t("s_offers")))
register("offers_code_subscribers", f"SELECT offer_id, code, COUNT(*) AS subscribers FROM s_user_offers u JOIN s_offers o ON o.id = u.offer_id WHERE u.created_at {IN} GROUP BY 1, 2", lambda t: sales.code_subscribers(t("s_user_offers"), t("s_offers"), P))


def prices(t):
    return t("s_prices").withColumn("final_price", F.col("raw_price").cast("decimal(14,2)"))


FINAL = "(SELECT *, CAST(original_price * (100 - offer_id) AS DECIMAL(18,2)) AS hundredfold FROM s_prices)"
CENTS = "CAST((CAST(original_price * 100 AS BIGINT) * (100 - offer_id) * 2 + 100) // 200 AS BIGINT)"
PERF = f"SELECT p.*, benefit_type, is_code_offer, code, is_active FROM (SELECT offer_id, COUNT(*) AS times_applied, CAST(SUM(CAST(original_price * 100 AS BIGINT) - c) AS DOUBLE) / 100 AS discount_given, CAST(SUM(c) AS DOUBLE) / 100 AS revenue_after, CAST((SUM(CAST(original_price * 100 AS BIGINT) - c) * 2 + COUNT(*)) // (COUNT(*) * 2) AS DOUBLE) / 100 AS avg_discount FROM (SELECT *, {CENTS} AS c FROM s_prices) WHERE is_applied AND created_at {IN} GROUP BY 1) p JOIN s_offers o ON o.id = p.offer_id"
register("offers_performance", PERF, lambda t: sales.offers_performance(prices(t), t("s_offers"), P))
register("offers_discount_total", f"SELECT COUNT(*) AS offers, CAST(SUM(times_applied) AS BIGINT) AS times_applied, ROUND(SUM(discount_given), 2) AS total_discount FROM ({PERF})", lambda t: sales.offers_discount_total(sales.offers_performance(prices(t), t("s_offers"), P)))
BEST = f"SELECT entry_id, offer_id, l_orderkey, l_linenumber, is_code, {CENTS} AS c FROM s_prices"
register("offer_best_price", f"SELECT entry_id, CAST(MIN(c) AS DOUBLE) / 100 AS best_price, (MIN(c * 1000 + offer_id)) % 1000 AS offer_id FROM ({BEST}) WHERE NOT is_code GROUP BY 1", lambda t: pricing.best_price(prices(t)).withColumn("best_price", F.col("best_price").cast("double")))
register("offer_flag_lowest", f"WITH p AS ({BEST}), b AS (SELECT entry_id, MIN(c * 1000 + offer_id) AS m FROM p WHERE NOT is_code GROUP BY 1) SELECT entry_id, COUNT(*) AS offers, COUNT(*) FILTER (WHERE NOT is_code AND offer_id = m % 1000) AS applied FROM p LEFT JOIN b USING (entry_id) GROUP BY 1", lambda t: pricing.flag_lowest(prices(t)).groupBy("entry_id").agg(F.count(F.lit(1)).alias("offers"), F.count_if("is_applied").alias("applied")))
register("offer_schedule", "SELECT id, (end_at >= TIMESTAMP '2024-01-25 00:00:00') AS is_active, (end_at >= TIMESTAMP '2024-01-25 00:00:00') <> is_active AS changed FROM s_offers", lambda t: pricing.schedule(t("s_offers").withColumn("start_at", F.lit(None).cast("timestamp_ntz")), "2024-01-25 00:00:00").select("id", "is_active", "changed"))
register("cart_total", "SELECT order_id AS cart_id, CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2)) * quantity) AS DOUBLE) AS total, CAST(SUM(quantity) AS BIGINT) AS items FROM s_items JOIN part ON p_partkey = product_id GROUP BY 1", lambda t: pricing.cart_total(t("s_items").select(F.col("order_id").alias("cart_id"), F.col("product_id").alias("entry_id"), "quantity"), t("parts").select(F.col("p_partkey").alias("entry_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"))))
register("return_state", "SELECT order_id, CASE WHEN BOOL_AND(is_returned) THEN 'returned' WHEN BOOL_OR(is_returned) THEN 'partially_returned' ELSE 'none' END AS state FROM s_items GROUP BY 1", lambda t: pricing.return_state(t("s_items")))
register("stock_decrement", "SELECT p_partkey AS entry_id, CAST(p_size * 20 AS BIGINT) - CASE WHEN COALESCE(q, 0) > p_size * 20 THEN 0 ELSE COALESCE(q, 0) END AS stock, CAST(COALESCE(q, 0) AS BIGINT) AS taken, COALESCE(q, 0) > p_size * 20 AS short FROM part LEFT JOIN (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS q FROM s_items GROUP BY 1) ON product_id = p_partkey", lambda t: pricing.decrement_stock(t("parts").select(F.col("p_partkey").alias("entry_id"), (F.col("p_size") * 20).cast("long").alias("stock")), t("s_items").select(F.col("product_id").alias("entry_id"), "quantity")))
register("order_stock_check", "SELECT CASE WHEN p_size <= 2 THEN 'out_of_stock' WHEN p_size - 2 < quantity THEN 'insufficient' ELSE 'ok' END AS state, COUNT(*) AS items FROM s_items JOIN part ON p_partkey = product_id GROUP BY 1", lambda t: pricing.checked_order(t("s_items").withColumnRenamed("product_id", "entry_id"), t("parts").select(F.col("p_partkey").alias("entry_id"), (F.col("p_size") - 2).alias("stock"))).groupBy("state").agg(F.count(F.lit(1)).alias("items")))
register("order_listing", "SELECT s_orders.id AS id, status, COUNT(order_id) AS items, COALESCE(MIN(product_id), 0) AS first_product FROM s_orders LEFT JOIN s_items ON order_id = s_orders.id GROUP BY 1, 2", lambda t: pricing.order_listing(t("s_orders"), t("s_items")).select("id", "status", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("items"), F.coalesce(F.element_at("items", 1)["product_id"], F.lit(0)).alias("first_product")))
register("wallet_balance", "SELECT user_id AS wallet_id, CAST(SUM(CASE WHEN status = 'delivered' THEN total_price ELSE -total_price END) AS DOUBLE) AS balance, COUNT(*) AS entries FROM s_orders GROUP BY 1", lambda t: pricing.ledger_balance(t("s_orders").select(F.col("user_id").alias("wallet_id"), F.when(F.col("status") == "delivered", "credit").otherwise("debit").alias("kind"), F.col("total_price").alias("amount"))))

# Bookings
STATES = flags(*bk.STATES)
register("booking_overview", f"SELECT *, {rate('completed', 'total')} AS completed_rate, {rate('cancelled', 'total')} AS cancelled_rate, {rate('no_show', 'total')} AS no_show_rate FROM (SELECT COUNT(*) AS total, CAST(COALESCE(SUM(amount), 0) AS DOUBLE) AS revenue, {mean('COALESCE(SUM(amount), 0)', N)} AS avg_amount, CAST(COALESCE(SUM(refund_amount) FILTER (WHERE status = 'cancelled'), 0) AS DOUBLE) AS refunded, {STATES} FROM s_bookings WHERE {OWN}) a, (SELECT COUNT(*) AS resources, COUNT(*) FILTER (WHERE status = 'active') AS active, COUNT(*) FILTER (WHERE payment_type = 'paid') AS paid, COUNT(*) FILTER (WHERE payment_type = 'free') AS free FROM s_resources WHERE deleted_at IS NULL) b", lambda t: bk.overview(t("s_bookings"), t("s_resources"), P))
register("booking_trend", f"SELECT {LABEL['monthly'].format('created_at')} AS period, COUNT(*) AS bookings, CAST(SUM(amount) AS DOUBLE) AS revenue, {mean('SUM(amount)', N)} AS avg_amount FROM s_bookings WHERE {OWN} AND status <> 'cancelled' GROUP BY 1", lambda t: bk.trend(t("s_bookings"), P))
register("resource_performance", f"""WITH s AS (SELECT resource_id, COUNT(*) AS bookings, {STATES}, CAST(COALESCE(SUM(amount) FILTER (WHERE status <> 'cancelled'), 0) AS DOUBLE) AS revenue, CAST(COALESCE(SUM(refund_amount) FILTER (WHERE status = 'cancelled'), 0) AS DOUBLE) AS refunded, SUM(date_sub('minute', start_at, end_at)) FILTER (WHERE status <> 'cancelled') AS minutes, COUNT(*) FILTER (WHERE status <> 'cancelled') AS held, SUM(date_sub('hour', start_at, end_at)) FILTER (WHERE status <> 'cancelled') AS h FROM s_bookings WHERE {OWN} GROUP BY 1), d AS (SELECT resource_id, SUM(end_hour - start_hour) AS daily FROM s_availability WHERE is_active GROUP BY 1), x AS (SELECT r.id AS resource_id, name, type, capacity, payment_type, price, {", ".join(f"COALESCE({s}, 0) AS {s}" for s in ("bookings", *bk.STATES))}, COALESCE(revenue, 0) AS revenue, COALESCE(refunded, 0) AS refunded, {mean("COALESCE(minutes, 0)", "COALESCE(held, 0)")} AS avg_minutes, COALESCE(daily, 0) * (DATE '{B}' - DATE '{A}' + 1) * capacity AS av, COALESCE(h, 0) AS h FROM s_resources r LEFT JOIN s ON s.resource_id = r.id LEFT JOIN d ON d.resource_id = r.id WHERE deleted_at IS NULL) SELECT * EXCLUDE (av, h), CAST(av AS DOUBLE) AS available_hours, CAST(h AS DOUBLE) AS booked_hours, {rate("h", "av")} AS occupancy_rate, {rate("cancelled", "bookings")} AS cancellation_rate FROM x""", lambda t: bk.resource_performance(t("s_resources"), t("s_bookings"), t("s_availability"), P))
CUT_REFUND = "refund_amount) FILTER (WHERE status = 'cancelled'"
register("cancellation_summary", f"SELECT *, {rate('cancellations', 'total')} AS cancellation_rate, {rate('CAST(ROUND(refunded * 100) AS BIGINT)', 'CAST(ROUND(amount * 100) AS BIGINT)')} AS refund_rate, {rate('no_shows', 'total')} AS no_show_rate FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'cancelled') AS cancellations, CAST(COALESCE(SUM(amount) FILTER (WHERE status = 'cancelled'), 0) AS DOUBLE) AS amount, CAST(COALESCE(SUM({CUT_REFUND}), 0) AS DOUBLE) AS refunded, {mean(f'COALESCE(SUM({CUT_REFUND}), 0)', f'COUNT({CUT_REFUND})')} AS avg_refund, COUNT(*) FILTER (WHERE status = 'no_show') AS no_shows, CAST(COALESCE(SUM(amount) FILTER (WHERE status = 'no_show'), 0) AS DOUBLE) AS lost FROM s_bookings WHERE {OWN})", lambda t: bk.cancellations(t("s_bookings"), P))
register("cancellation_by_resource", f"SELECT resource_id, name AS resource_name, type AS resource_type, COUNT(*) AS cancellations, CAST(COALESCE(SUM(refund_amount), 0) AS DOUBLE) AS refunded FROM s_bookings b JOIN s_resources r ON r.id = resource_id WHERE b.status = 'cancelled' AND {OWN} GROUP BY 1, 2, 3", lambda t: bk.cancellations_by_resource(t("s_bookings"), t("s_resources"), P))
register("cancellation_trend", f"SELECT {LABEL['monthly'].format('created_at')} AS period, COUNT(*) AS cancelled, CAST(COALESCE(SUM(refund_amount), 0) AS DOUBLE) AS refunded FROM s_bookings WHERE {OWN} AND status = 'cancelled' GROUP BY 1", lambda t: bk.cancellation_trend(t("s_bookings"), P))
HELD = f"FROM s_bookings WHERE start_at {IN} AND status <> 'cancelled'"
SUMS = "COUNT(*) AS bookings, CAST(SUM(amount) AS DOUBLE) AS revenue"
register("peak_dow", f"SELECT CAST(dayofweek(start_at) AS INT) AS day_of_week, dayname(start_at) AS day_name, {SUMS} {HELD} GROUP BY 1, 2", lambda t: bk.peak(t("s_bookings"), P, "dow"))
register("peak_hour", f"SELECT CAST(hour(start_at) AS INT) AS hour, strftime(start_at, '%H:00') AS label, {SUMS} {HELD} GROUP BY 1, 2", lambda t: bk.peak(t("s_bookings"), P, "hour"))
register("peak_month", f"SELECT strftime(start_at, '%Y-%m') AS month, {SUMS} {HELD} GROUP BY 1", lambda t: bk.peak(t("s_bookings"), P, "month"))
HOURS = "SUM(date_sub('hour', created_at, start_at))"
register("lead_time", f"SELECT resource_id, name, CASE WHEN h < 0 THEN -1 ELSE 1 END * (CAST((ABS(h) * 200 + n) // (n * 2) AS DOUBLE) / 100) AS lead_hours FROM (SELECT resource_id, {HOURS} AS h, COUNT(*) AS n {HELD} GROUP BY 1) JOIN s_resources ON id = resource_id ORDER BY lead_hours, resource_id LIMIT 10", lambda t: bk.lead_time(t("s_bookings"), t("s_resources"), P))
DAY = "1997-06-11"
register("slots", f"WITH s AS (SELECT resource_id, capacity, TIMESTAMP '{DAY} 00:00:00' + to_hours(CAST(h AS INT)) AS slot_start, TIMESTAMP '{DAY} 00:00:00' + to_hours(CAST(h + 1 AS INT)) AS slot_end FROM (SELECT resource_id, UNNEST(range(start_hour, end_hour)) AS h FROM s_availability WHERE is_active AND day_of_week = dayofweek(DATE '{DAY}')) JOIN s_resources ON id = resource_id WHERE deleted_at IS NULL) SELECT s.resource_id, slot_start, slot_end, capacity, COUNT(b.id) AS booked, COUNT(b.id) < capacity AND slot_start > TIMESTAMP '{DAY} 09:30:00' AS available FROM s LEFT JOIN s_bookings b ON b.resource_id = s.resource_id AND b.status IN ('confirmed', 'pending') AND b.start_at = slot_start GROUP BY 1, 2, 3, 4", lambda t: bk.slots(t("s_availability"), t("s_resources"), t("s_bookings"), DAY, f"{DAY} 09:30:00"))
REQ = "status = 'pending' AND start_at BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 23:59:59'"
register("overlap_conflicts", f"WITH q AS (SELECT * FROM s_bookings WHERE {REQ}) SELECT q.id, q.resource_id, capacity, COUNT(b.id) AS overlaps, COUNT(b.id) >= capacity AS conflict FROM q JOIN s_resources r ON r.id = q.resource_id LEFT JOIN s_bookings b ON b.resource_id = q.resource_id AND b.status <> 'cancelled' AND b.start_at < q.end_at AND b.end_at > q.start_at AND b.id <> q.id GROUP BY 1, 2, 3", lambda t: bk.conflicts(t("s_bookings").where((F.col("status") == "pending") & (F.year("start_at") == 1997)), t("s_bookings"), t("s_resources")))
register("availability_check", "SELECT id FROM s_bookings b WHERE EXISTS (SELECT 1 FROM s_availability a WHERE a.resource_id = b.resource_id AND is_active AND day_of_week = dayofweek(start_at) AND hour(start_at) * 60 + minute(start_at) >= start_hour * 60 AND hour(end_at) * 60 + minute(end_at) <= end_hour * 60)", lambda t: bk.within_availability(t("s_bookings"), t("s_availability")).select("id"))
CUT = "1997-06-01 12:00:00"
register("refund_tier", f"WITH b AS (SELECT id, resource_id, amount, date_sub('second', TIMESTAMP '{CUT}', start_at) AS seconds_left FROM s_bookings WHERE start_at BETWEEN TIMESTAMP '1997-05-25 00:00:00' AND TIMESTAMP '1997-06-15 00:00:00'), p AS (SELECT id, amount, seconds_left, CAST(COALESCE(arg_max(refund_percentage, hours_before), 0) AS INT) AS refund_percentage FROM b LEFT JOIN s_policies y ON y.resource_id = b.resource_id AND seconds_left > 0 AND seconds_left >= hours_before * 3600 GROUP BY 1, 2, 3) SELECT id, CAST(amount AS DOUBLE) AS amount, seconds_left, refund_percentage, CAST((CAST(amount * 100 AS BIGINT) * refund_percentage * 2 + 100) // 200 AS DOUBLE) / 100 AS refund FROM p", lambda t: bk.refunds(t("s_bookings").where(F.col("start_at").between(F.lit("1997-05-25 00:00:00").cast("timestamp_ntz"), F.lit("1997-06-15 00:00:00").cast("timestamp_ntz"))), t("s_policies"), CUT).withColumn("amount", F.col("amount").cast("double")))
register("resource_booked_by", "SELECT r.id, EXISTS (SELECT 1 FROM s_bookings b WHERE b.resource_id = r.id AND b.user_id = 7 AND b.status <> 'cancelled') AS is_booked FROM s_resources r", lambda t: bk.booked_flag(t("s_resources"), t("s_bookings"), 7).select("id", "is_booked"))

# Access and writes
register("usage_metering", "SELECT id, user_id, CAST(SUM(CAST(id % 3 + 1 AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, SUM(id % 3 + 1) OVER (PARTITION BY user_id, event_type ORDER BY ts, id ROWS UNBOUNDED PRECEDING) <= 12 AS allowed FROM (SELECT event_id AS id, user_id, event_type, ts FROM events)", lambda t: access.meter(t("event_log").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("feature"), "ts", (F.col("event_id") % 3 + 1).alias("amount")), t("event_log").select(F.col("event_type").alias("feature"), F.lit(12).alias("limit")).distinct()).select("id", "user_id", "used", "allowed"))
register("log_dedupe", "SELECT event_id, MIN(event_type) AS event_type FROM events WHERE event_id % 7 <> 0 GROUP BY 1", lambda t: upsert.insert_ignore(t("event_log").where("event_id % 7 = 0"), t("event_log").unionByName(t("event_log")), ["event_id"]).select("event_id", "event_type"))
register("log_filter_page", "SELECT event_id, user_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20", lambda t: upsert.page(t("event_log").where("event_type = 'error'").select("event_id", "user_id", "ts"), [F.desc("ts"), "event_id"], 2, 20))
register("log_retention", "SELECT COUNT(*) AS n, MIN(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'", lambda t: upsert.retain(t("event_log"), "ts", "2024-01-15 00:00:00").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest")))
register("counter_increment", "SELECT c_custkey AS id, c_nationkey + COALESCE(n, 0) AS views FROM customer LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey", lambda t: upsert.add_deltas(t("customers").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("views")), t("event_log").select(F.col("user_id").alias("id"), F.lit(1).alias("views")), "id", "views"))
register("upsert_rollup", "WITH n AS (SELECT user_id, COUNT(*) AS total FROM events GROUP BY 1) SELECT COALESCE(user_id, c_custkey) AS user_id, COALESCE(total, 0) AS total FROM customer FULL JOIN n ON user_id = c_custkey", lambda t: upsert.upsert(t("customers").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("total")), t("event_log").groupBy("user_id").agg(F.count(F.lit(1)).alias("total")), ["user_id"]))
register("notifications_unread", "SELECT user_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE event_type <> 'view') AS unread, MAX(ts) AS last FROM events GROUP BY 1", lambda t: access.notifications(t("event_log").select("user_id", F.when(F.col("event_type") == "view", F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))))

ENDED = "2000-01-01 00:00:00"
SUBS = f"SELECT * FROM s_subscriptions WHERE status = 'active' AND (ends_at IS NULL OR ends_at >= TIMESTAMP '{ENDED}')"
register("active_features", f"SELECT user_id, feature, feature_limit AS limit FROM ({SUBS}) JOIN s_plan_features USING (plan_id)", lambda t: access.active_features(t("s_subscriptions"), t("s_plan_features").withColumnRenamed("feature_limit", "limit"), ENDED))
register("content_access", f"WITH held AS (SELECT DISTINCT user_id, feature FROM ({SUBS}) JOIN s_plan_features USING (plan_id)), asked AS (SELECT c_custkey AS user_id, c_custkey % 40 AS entry_id FROM customer), rules AS (SELECT p_partkey AS entry_id, CONCAT('feature', CAST(p_size % 7 AS VARCHAR)) AS feature FROM part WHERE p_partkey % 3 > 0) SELECT user_id, entry_id, NOT EXISTS (SELECT 1 FROM rules r WHERE r.entry_id = a.entry_id) OR EXISTS (SELECT 1 FROM rules r JOIN held h ON h.feature = r.feature AND h.user_id = a.user_id WHERE r.entry_id = a.entry_id) AS allowed FROM asked a", lambda t: access.may_see(t("customers").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 40).alias("entry_id")), t("parts").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("feature"), (F.col("p_size") % 7).cast("string")).alias("feature")), access.active_features(t("s_subscriptions"), t("s_plan_features").withColumnRenamed("feature_limit", "limit"), ENDED)))
register("usage_reset", "SELECT id, CASE WHEN ends_at <= TIMESTAMP '1998-01-01 00:00:00' THEN 0 ELSE plan_id END AS used, CASE WHEN ends_at <= TIMESTAMP '1998-01-01 00:00:00' THEN CASE plan_id % 3 WHEN 0 THEN ends_at + INTERVAL 1 DAY WHEN 1 THEN ends_at + INTERVAL 7 DAY ELSE ends_at + INTERVAL 1 MONTH END ELSE ends_at END AS reset_at FROM s_subscriptions", lambda t: access.reset_due(t("s_subscriptions").select("id", F.col("plan_id").alias("used"), F.col("ends_at").alias("reset_at"), F.when(F.col("plan_id") % 3 == 0, "daily").when(F.col("plan_id") % 3 == 1, "weekly").otherwise("monthly").alias("period")), "1998-01-01 00:00:00").select("id", "used", "reset_at"))
register("renewal", f"SELECT id, CASE WHEN ends_at > TIMESTAMP '{ENDED}' THEN 'keep' WHEN auto_renew THEN 'renew' WHEN date_sub('day', ends_at, TIMESTAMP '{ENDED}') <= 3 THEN 'grace' ELSE 'expire' END AS action FROM s_subscriptions", lambda t: access.renewal(t("s_subscriptions"), ENDED).select("id", "action"))
register("valid_sessions", "SELECT id FROM s_sessions WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00' AND revoked_at IS NULL AND id % 11 <> 0", lambda t: access.valid_sessions(t("s_sessions"), t("s_sessions").where("id % 11 = 0"), "2024-01-20 00:00:00").select("id"))
register("members", "SELECT c_custkey AS user_id, CONCAT('role', CAST(c_nationkey % 4 AS VARCHAR)) AS role, CAST(c_nationkey % 3 AS INT) AS project_id FROM customer WHERE c_nationkey % 3 = 1 AND c_nationkey % 4 < 3", lambda t: access.members(t("customers").select(F.col("c_custkey").alias("user_id")), t("customers").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 4).alias("role_id"), (F.col("c_nationkey") % 3).alias("project_id")), t("nations").where("n_nationkey < 3").select(F.col("n_nationkey").alias("role_id"), F.concat(F.lit("role"), F.col("n_nationkey").cast("string")).alias("role")), 1))
RULED = "SELECT e.event_id AS id, e.user_id, r.feature, r.mode, r.amount, r.id AS rule, e.ts FROM events e JOIN s_rules r ON r.event_key = e.event_type AND r.is_active"
register("usage_by_rules", f"WITH RECURSIVE o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, feature ORDER BY ts, id, rule) AS k FROM ({RULED})), u AS (SELECT id, user_id, feature, k, CASE WHEN mode = 'increment' OR mode = 'both' AND amount <= 9 THEN amount ELSE 0 END AS used, mode = 'increment' OR amount <= 9 AS allowed FROM o WHERE k = 1 UNION ALL SELECT o.id, o.user_id, o.feature, o.k, u.used + CASE WHEN mode = 'increment' OR mode = 'both' AND u.used + amount <= 9 THEN amount ELSE 0 END, mode = 'increment' OR u.used + amount <= 9 FROM u JOIN o ON o.user_id = u.user_id AND o.feature = u.feature AND o.k = u.k + 1) SELECT id, user_id, feature, allowed, CAST(used AS BIGINT) AS used FROM u", lambda t: access.metered_by_rules(t("event_log").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("event_key"), "ts"), t("s_rules"), t("s_rules").select("feature", F.lit(9.0).alias("limit")).distinct()))
register("code_price", "SELECT entry_id, offer_id, l_orderkey FROM s_prices WHERE is_code AND offer_id IN (SELECT id FROM s_offers WHERE code = 'CODE2' OR code = 'CODE5')", lambda t: pricing.code_price(prices(t), t("s_offers"), "CODE2").unionByName(pricing.code_price(prices(t), t("s_offers"), "CODE5")).select("entry_id", "offer_id", "l_orderkey"))
register("entitled_price", f"SELECT entry_id, CAST(MIN(c) AS DOUBLE) / 100 AS best_price, (MIN(c * 1000 + offer_id)) % 1000 AS offer_id FROM ({BEST}) WHERE NOT is_code OR offer_id IN (SELECT offer_id FROM s_user_offers WHERE user_id = 7) GROUP BY 1", lambda t: pricing.best_price(prices(t), t("s_user_offers").where("user_id = 7")).withColumn("best_price", F.col("best_price").cast("double")))
register("discounts", "SELECT p_partkey AS entry_id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 100 * (100 - LEAST(GREATEST(p_size * 3 - 10, 0), 100)) // 100 AS DOUBLE) ELSE CAST(GREATEST(p_size * 100 - 2000, 0) AS DOUBLE) END AS price FROM part", lambda t: t("parts").select(F.col("p_partkey").alias("entry_id"), pricing.discounted(F.col("p_size") * 100, F.when(F.col("p_size") % 2 == 0, "percentage").otherwise("fixed_amount"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 3 - 10).otherwise(2000)).cast("double").alias("price")))
register("may_return", "SELECT order_id, product_id FROM s_items i WHERE order_id IN (SELECT id FROM s_orders WHERE status = 'delivered') AND NOT EXISTS (SELECT 1 FROM s_returns r WHERE r.status = 'pending' AND r.order_id = i.order_id AND r.product_id = i.product_id)", lambda t: pricing.may_return(t("s_items"), t("s_orders"), t("s_returns").where("status = 'pending'")).select("order_id", "product_id"))
register("installments", "SELECT id, CAST(LEAST(total - paid, CAST(total // 4 AS DECIMAL(14,2))) AS DOUBLE) AS next_amount, total - paid > 0 AND due < DATE '1998-01-01' AS overdue FROM (SELECT o_orderkey AS id, o_orderkey * 4 AS total, o_custkey AS paid, CAST(o_orderdate AS DATE) AS due FROM orders)", lambda t: pricing.installments(t("s_orders").select("id", (F.col("id") * 4).cast("decimal(14,2)").alias("total"), F.col("user_id").cast("decimal(14,2)").alias("paid"), F.lit(4).alias("parts"), F.to_date("created_at").alias("next_due_date")), "1998-01-01").select("id", F.col("next_amount").cast("double").alias("next_amount"), "overdue"))
register("wishlists", "SELECT c_custkey AS id, COALESCE(n, 0) AS items, COALESCE(last, 0) + 1 AS next_sort_order FROM customer LEFT JOIN (SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderkey) AS last FROM orders GROUP BY 1) ON k = c_custkey", lambda t: pricing.wishlists(t("customers").select(F.col("c_custkey").alias("id")), t("s_orders").select(F.col("user_id").alias("wishlist_id"), F.col("id").alias("sort_order"))))
# Lookups
register("plan_slug_taken", "SELECT COUNT(*) > 0 AS taken FROM s_plans WHERE project_id = 3 AND slug = 'plan2' AND id <> 0", lambda t: lookups.slug_taken(t("s_plans"), "plan2", 3, 0))
register("active_plans", "SELECT id, project_id, slug, is_active, COALESCE(features, '') AS features FROM s_plans LEFT JOIN (SELECT plan_id, array_to_string(list_sort(list(feature)), ',') AS features FROM s_plan_features GROUP BY 1) ON plan_id = id WHERE is_active", lambda t: lookups.active_plans(t("s_plans"), t("s_plan_features")).withColumn("features", F.array_join("features", ",")))
register("active_rules", "SELECT id, feature FROM s_rules WHERE is_active AND event_key = 'view' AND project_id = 1 UNION ALL SELECT id, feature FROM s_rules WHERE is_active AND event_key = 'purchase' AND project_id IS NULL", lambda t: lookups.active_rules(t("s_rules"), "view", 1).unionByName(lookups.active_rules(t("s_rules"), "purchase")).select("id", "feature"))
register("first_rule", "SELECT id FROM s_rules WHERE is_active AND event_key = 'view' AND project_id = 1 ORDER BY id LIMIT 1", lambda t: lookups.first_rule(t("s_rules"), "view", 1).select("id"))
register("repeated_fields", "SELECT data_type_id, name, COUNT(*) AS n FROM s_fields GROUP BY 1, 2 HAVING COUNT(*) > 1", lambda t: lookups.repeated_names(t("s_fields")))
register("field_name_taken", "SELECT COUNT(*) > 0 AS taken FROM s_fields WHERE data_type_id = 0 AND name = 'name' AND id <> 0", lambda t: lookups.name_taken(t("s_fields"), 0, "name", 0))
register("listed_types", "SELECT id, name, deleted_at IS NOT NULL AS trashed FROM s_types WHERE project_id = 15", lambda t: lookups.listed_types(t("s_types"), 15).unionByName(lookups.listed_types(t("s_types"), 15, True)).select("id", "name", F.col("deleted_at").isNotNull().alias("trashed")))
register("project_members", "SELECT DISTINCT c_custkey AS user_id FROM customer JOIN s_projects p ON p.id = c_nationkey WHERE public_id = 'key-NATION_2'", lambda t: lookups.is_member(t("customers").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("project_id")), t("s_projects"), "key-NATION_2"))
register("conversation_page", "WITH own AS (SELECT * FROM s_chats WHERE user_id = 2 AND status = 'active'), shown AS (SELECT * FROM own ORDER BY created_at DESC, id DESC LIMIT 5 OFFSET 5) SELECT shown.id, arg_max(text, turn) AS last_message, (SELECT COUNT(*) FROM own) AS total FROM shown JOIN s_messages m ON m.conversation_id = shown.id GROUP BY 1", lambda t: lookups.conversation_page(t("s_chats"), t("s_messages"), 2, 2, 5).select("id", "last_message", "total"))
register("returns_page", "SELECT r.id, i.product_id, CAST(price AS DOUBLE) AS price, (SELECT COUNT(*) FROM s_returns) AS total FROM (SELECT * FROM s_returns ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10) r LEFT JOIN s_items i ON i.id = r.order_item_id", lambda t: lookups.returns_page(t("s_returns").drop("product_id"), t("s_items"), 2).select("id", "product_id", F.col("price").cast("double").alias("price"), "total"))
