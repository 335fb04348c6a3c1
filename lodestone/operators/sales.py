"""Sales, product, offer, customer and return reports over orders and their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.exprs import bucket, count_if, in_range, live, mean, money, rate
from ..params import ReportParams

c = F.col


def sales_summary(orders: DataFrame, items: DataFrame, returns: DataFrame, p: ReportParams) -> DataFrame:
    """One row: orders, revenue, mean order, status counts and rates; items sold; returns by status."""
    own = orders.where(in_range(c("created_at"), p))
    head = own.agg(
        F.count(F.lit(1)).alias("total_orders"), money(c("total_price")).alias("total_revenue"),
        mean(F.coalesce(F.sum("total_price"), F.lit(0)), F.count(F.lit(1))).alias("avg_order_value"),
        *[count_if(c("status") == s).alias(s) for s in ("pending", "paid", "shipped", "delivered", "cancelled")],
        count_if(c("status").isin("returned", "partially_returned")).alias("returned"),
    ).withColumn("cancellation_rate", rate(c("cancelled"), c("total_orders"))).withColumn("return_rate", rate(c("returned"), c("total_orders")))
    sold = items.join(own.where(c("status") != "cancelled").select(c("id").alias("order_id")), "order_id").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("items_sold"), F.countDistinct("product_id").alias("distinct_products"))
    back = returns.where(in_range(c("created_at"), p)).agg(F.count(F.lit(1)).alias("returns_total"), *[count_if(c("status") == s).alias(f"returns_{s}") for s in ("pending", "approved", "rejected")])
    return head.crossJoin(F.broadcast(sold)).crossJoin(F.broadcast(back))  # one row each


def sales_trend(orders: DataFrame, p: ReportParams) -> DataFrame:
    """Orders that are not cancelled, by period."""
    n = F.count(F.lit(1))
    own = orders.where(in_range(c("created_at"), p) & (c("status") != "cancelled"))
    return own.groupBy(bucket(c("created_at"), p.period).alias("period")).agg(n.alias("orders"), money(c("total_price")).alias("revenue"), mean(F.sum("total_price"), n).alias("avg_order_value"))


def _product_sales(orders: DataFrame, items: DataFrame, p: ReportParams) -> DataFrame:
    own = orders.where(in_range(c("created_at"), p) & (c("status") != "cancelled")).select(c("id").alias("order_id"))
    return items.join(own, "order_id").groupBy("product_id").agg(
        F.sum("quantity").alias("quantity_sold"), money(c("total")).alias("revenue"), F.countDistinct("order_id").alias("orders"), mean(F.sum("price"), F.count("price")).alias("avg_price")
    )


def top_products(orders: DataFrame, items: DataFrame, returns: DataFrame, p: ReportParams) -> DataFrame:
    """Best sellers first cut to ``limit``, then enriched with approved returns of any date."""
    top = _product_sales(orders, items, p).orderBy(F.desc("quantity_sold"), "product_id").limit(p.limit)
    back = returns.where(c("status") == "approved").join(F.broadcast(top.select("product_id")), "product_id", "left_semi").groupBy("product_id").agg(F.count(F.lit(1)).alias("returns"))
    out = top.join(back, "product_id", "left").withColumn("returns", F.coalesce("returns", F.lit(0)))
    return out.withColumn("return_rate", rate(c("returns"), c("quantity_sold")))


def least_sold(orders: DataFrame, items: DataFrame, p: ReportParams) -> DataFrame:
    return _product_sales(orders, items, p).orderBy("quantity_sold", "product_id").limit(p.limit).drop("avg_price")


def offers_summary(offers: DataFrame) -> DataFrame:
    return live(offers).agg(F.count(F.lit(1)).alias("total"), count_if(c("is_active")).alias("active"), count_if(c("is_code_offer")).alias("code_offers"), count_if(~c("is_code_offer")).alias("automatic_offers"))


def offers_performance(prices: DataFrame, offers: DataFrame, p: ReportParams) -> DataFrame:
    """Per offer, deleted ones too: times applied within the range, discount given, revenue after, mean discount."""
    off = c("original_price") - c("final_price")
    n = F.count(F.lit(1))
    own = prices.where(c("is_applied") & in_range(c("created_at"), p)).groupBy("offer_id").agg(n.alias("times_applied"), money(off).alias("discount_given"), money(c("final_price")).alias("revenue_after"), mean(F.sum(off), n).alias("avg_discount"))
    return own.join(offers.select(c("id").alias("offer_id"), "benefit_type", "is_code_offer", "code", "is_active"), "offer_id")


def offers_discount_total(performance: DataFrame) -> DataFrame:
    return performance.agg(F.count(F.lit(1)).alias("offers"), F.sum("times_applied").alias("times_applied"), F.round(F.sum("discount_given"), 2).alias("total_discount"))


def code_subscribers(user_offers: DataFrame, offers: DataFrame, p: ReportParams) -> DataFrame:
    """Users who took an offer within the range, per offer."""
    own = user_offers.where(in_range(c("created_at"), p)).groupBy("offer_id").agg(F.count(F.lit(1)).alias("subscribers"))
    return own.join(offers.select(c("id").alias("offer_id"), "code"), "offer_id")


def top_customers(orders: DataFrame, p: ReportParams) -> DataFrame:
    n = F.count(F.lit(1))
    own = orders.where(in_range(c("created_at"), p) & (c("status") != "cancelled"))
    grouped = own.groupBy("user_id").agg(n.alias("orders"), F.sum("total_price").alias("spent"), mean(F.sum("total_price"), n).alias("avg_order_value"), F.min("created_at").alias("first_order"), F.max("created_at").alias("last_order"))
    return grouped.orderBy(F.desc("spent"), "user_id").limit(p.limit).withColumn("spent", c("spent").cast("double"))


def new_and_returning(orders: DataFrame, p: ReportParams) -> DataFrame:
    """Unique customers of the range (cancelled orders count too), and those without an earlier order."""
    own = orders.where(in_range(c("created_at"), p)).select("user_id").distinct()
    before = orders.where(c("created_at") < F.lit(f"{p.start} 00:00:00").cast("timestamp_ntz")).select("user_id").distinct()
    fresh = own.join(before, "user_id", "left_anti").agg(F.count(F.lit(1)).alias("new_customers"))
    out = own.agg(F.count(F.lit(1)).alias("unique_customers")).crossJoin(F.broadcast(fresh))
    return out.withColumn("returning_customers", F.greatest(c("unique_customers") - c("new_customers"), F.lit(0))).withColumn("new_rate", rate(c("new_customers"), c("unique_customers")))


def returns_summary(orders: DataFrame, returns: DataFrame, p: ReportParams) -> DataFrame:
    own = returns.where(in_range(c("created_at"), p)).agg(F.count(F.lit(1)).alias("total"), *[count_if(c("status") == s).alias(s) for s in ("pending", "approved", "rejected")], F.coalesce(F.sum("quantity"), F.lit(0)).alias("items_returned"))
    n = orders.where(in_range(c("created_at"), p)).agg(F.count(F.lit(1)).alias("orders"))
    return own.crossJoin(F.broadcast(n)).withColumn("approval_rate", rate(c("approved"), c("total"))).withColumn("return_vs_orders", rate(c("total"), c("orders")))


def most_returned(returns: DataFrame, p: ReportParams) -> DataFrame:
    return returns.where(in_range(c("created_at"), p)).groupBy("product_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("quantity").alias("quantity"), count_if(c("status") == "approved").alias("approved")).orderBy(F.desc("requests"), F.desc("quantity"), "product_id").limit(p.limit)


def returns_trend(returns: DataFrame, p: ReportParams) -> DataFrame:
    return returns.where(in_range(c("created_at"), p)).groupBy(bucket(c("created_at"), p.period).alias("period")).agg(F.count(F.lit(1)).alias("requests"))
