"""Offer prices, carts, orders, returns and stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

c = F.col
DISCOUNTS = {
    "percentage": lambda price, x: price * (100 - F.least(F.greatest(x, F.lit(0)), F.lit(100))) / 100,
    "fixed_amount": lambda price, x: F.greatest(price - x, F.lit(0)),
}


def register_discount(kind: str, build) -> None:
    DISCOUNTS[kind] = build


def discounted(price: Column, kind: Column, value: Column) -> Column:
    out = price
    for name, build in DISCOUNTS.items():
        out = F.when(kind == name, build(price, value)).otherwise(out)
    return out.cast("decimal(14,2)")


def compute_prices(offers: DataFrame, entries: DataFrame) -> DataFrame:
    """Price of every entry under its offers (entry_id, offer_id, kind, value, is_code), the lowest automatic one flagged."""
    rows = offers.join(entries.select("entry_id", "price"), "entry_id").withColumn("final_price", discounted(c("price"), c("kind"), c("value")))
    return flag_lowest(rows)


def flag_lowest(prices: DataFrame) -> DataFrame:
    """``is_applied`` on the cheapest non-code price of each entry, the smaller offer on ties: one aggregate, no window."""
    best = prices.where("not is_code").groupBy("entry_id").agg(F.min(F.struct("final_price", "offer_id")).alias("_b")).select("entry_id", c("_b.offer_id").alias("_o"))
    return prices.join(best, "entry_id", "left").withColumn("is_applied", F.coalesce((c("offer_id") == c("_o")) & ~c("is_code"), F.lit(False))).drop("_o")


def best_price(prices: DataFrame, entitled: DataFrame | None = None) -> DataFrame:
    """Cheapest of automatic prices and of code prices whose offer the user holds."""
    usable = prices.where("not is_code")
    if entitled is not None:
        usable = usable.unionByName(prices.where("is_code").join(entitled.select("offer_id").distinct(), "offer_id", "left_semi").select(usable.columns))
    return usable.groupBy("entry_id").agg(F.min("final_price").alias("best_price"), F.min_by("offer_id", F.struct("final_price", "offer_id")).alias("offer_id"))


def code_price(prices: DataFrame, offers: DataFrame, code: str) -> DataFrame:
    return prices.where("is_code").join(offers.where(c("code") == code).select(c("id").alias("offer_id")), "offer_id", "left_semi")


def schedule(offers: DataFrame, now: str) -> DataFrame:
    """Offers after the schedule ran: due ones on, ended ones off, and whether that changed them."""
    at = F.lit(now).cast("timestamp_ntz")
    on = (c("start_at").isNull() | (c("start_at") <= at)) & (c("end_at").isNull() | (c("end_at") >= at))
    return offers.withColumn("changed", on != c("is_active")).withColumn("is_active", on)


def cart_total(items: DataFrame, prices: DataFrame) -> DataFrame:
    return items.join(prices, "entry_id").groupBy("cart_id").agg(F.sum(c("price") * c("quantity")).cast("double").alias("total"), F.sum("quantity").alias("items"))


def checked_order(items: DataFrame, stock: DataFrame) -> DataFrame:
    """Items with their stock state; an order may be made if all of its items are ``ok``."""
    both = items.join(stock, "entry_id", "left")
    state = F.when(c("stock").isNull(), "unknown").when(c("stock") <= 0, "out_of_stock").when(c("stock") < c("quantity"), "insufficient").otherwise("ok")
    return both.withColumn("state", state)


def order_listing(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with their items as one array; an order's items are few."""
    nested = items.groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("product_id", "quantity"))).alias("items"))
    return orders.join(nested, orders["id"] == nested["order_id"], "left").drop("order_id")


def return_state(items: DataFrame) -> DataFrame:
    """``returned`` if all of an order's items are, ``partially_returned`` if some."""
    out = items.groupBy("order_id").agg(F.bool_and("is_returned").alias("a"), F.bool_or("is_returned").alias("s"))
    return out.select("order_id", F.when(c("a"), "returned").when(c("s"), "partially_returned").otherwise("none").alias("state"))


def may_return(requests: DataFrame, orders: DataFrame, pending: DataFrame) -> DataFrame:
    """Return requests for delivered orders without another pending one."""
    good = orders.where(c("status") == "delivered").select(c("id").alias("order_id"))
    return requests.join(good, "order_id", "left_semi").join(pending.select("order_id", "product_id"), ["order_id", "product_id"], "left_anti")


def decrement_stock(stock: DataFrame, sold: DataFrame) -> DataFrame:
    """Stock after a batch, and whether it would fall below 0 (then it stays)."""
    taken = sold.groupBy("entry_id").agg(F.sum("quantity").alias("taken"))
    out = stock.join(taken, "entry_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.withColumn("short", c("taken") > c("stock")).withColumn("stock", F.when(c("short"), c("stock")).otherwise(c("stock") - c("taken")))


def ledger_balance(entries: DataFrame) -> DataFrame:
    """Wallet balances: credits less debits."""
    return entries.groupBy("wallet_id").agg(F.sum(F.when(c("kind") == "credit", c("amount")).otherwise(-c("amount"))).cast("double").alias("balance"), F.count(F.lit(1)).alias("entries"))


def installments(plans: DataFrame, now: str) -> DataFrame:
    """Plans (id, total, paid, parts, next_due_date) with the next part and whether it is overdue."""
    left = c("total") - c("paid")
    return plans.withColumn("next_amount", F.least(left, (c("total") / c("parts")).cast("decimal(14,2)"))).withColumn("overdue", (left > 0) & (c("next_due_date") < F.lit(now).cast("date")))


def wishlists(lists: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy(c("wishlist_id").alias("id")).agg(F.count(F.lit(1)).alias("items"), F.max("sort_order").alias("last"))
    return lists.join(n, "id", "left").withColumn("items", F.coalesce("items", F.lit(0))).withColumn("next_sort_order", F.coalesce(c("last"), F.lit(0)) + 1).drop("last")
