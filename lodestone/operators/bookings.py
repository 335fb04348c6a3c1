"""Booking reports, slots, conflicts, availability and refunds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.exprs import bucket, count_if, half_up, hours_between, in_range, live, mean, minutes_between, money, rate
from ..params import ReportParams

c = F.col
STATES = ("pending", "confirmed", "completed", "cancelled", "no_show")


def overview(bookings: DataFrame, resources: DataFrame, p: ReportParams) -> DataFrame:
    """Totals, revenue of all bookings, refunds of cancelled ones, status counts and rates; and resource counts."""
    n = F.count(F.lit(1))
    head = live(bookings).where(in_range(c("created_at"), p)).agg(
        n.alias("total"), money(c("amount")).alias("revenue"), mean(F.coalesce(F.sum("amount"), F.lit(0)), F.count("amount")).alias("avg_amount"), money(F.when(c("status") == "cancelled", c("refund_amount"))).alias("refunded"), *[count_if(c("status") == s).alias(s) for s in STATES]
    )
    for s in ("completed", "cancelled", "no_show"):
        head = head.withColumn(f"{s}_rate", rate(c(s), c("total")))
    kinds = live(resources).agg(n.alias("resources"), count_if(c("status") == "active").alias("active"), count_if(c("payment_type") == "paid").alias("paid"), count_if(c("payment_type") == "free").alias("free"))
    return head.crossJoin(F.broadcast(kinds))


def trend(bookings: DataFrame, p: ReportParams) -> DataFrame:
    n = F.count(F.lit(1))
    own = live(bookings).where(in_range(c("created_at"), p) & (c("status") != "cancelled"))
    return own.groupBy(bucket(c("created_at"), p.period).alias("period")).agg(n.alias("bookings"), money(c("amount")).alias("revenue"), mean(F.sum("amount"), n).alias("avg_amount"))


def resource_performance(resources: DataFrame, bookings: DataFrame, availability: DataFrame, p: ReportParams) -> DataFrame:
    """Per resource: status counts, money, mean minutes, and occupancy = booked hours / (daily hours * days * capacity).

    Daily hours sum all active availability rows, whatever their weekday.
    """
    own = live(bookings).where(in_range(c("created_at"), p))
    hours = F.when(c("status") != "cancelled", hours_between(c("start_at"), c("end_at")))
    stats = own.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("bookings"), *[count_if(c("status") == s).alias(s) for s in STATES], money(F.when(c("status") != "cancelled", c("amount"))).alias("revenue"), money(F.when(c("status") == "cancelled", c("refund_amount"))).alias("refunded"),
        F.sum(F.when(c("status") != "cancelled", minutes_between(c("start_at"), c("end_at")))).alias("minutes"), count_if(c("status") != "cancelled").alias("held"), F.coalesce(F.sum(hours), F.lit(0)).alias("booked_hours"),
    )
    daily = availability.where("is_active").groupBy("resource_id").agg(F.sum(c("end_hour") - c("start_hour")).alias("daily_hours"))
    days = F.datediff(F.lit(p.end).cast("date"), F.lit(p.start).cast("date")) + 1
    out = live(resources).join(stats, c("id") == stats["resource_id"], "left").drop("resource_id").join(daily, c("id") == daily["resource_id"], "left")
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    available = zero("daily_hours") * days * c("capacity")
    return out.select(
        c("id").alias("resource_id"), *[c(s) for s in ("name", "type", "capacity", "payment_type", "price") if s in resources.columns], *[zero(s).alias(s) for s in ("bookings", *STATES)], *[F.coalesce(c(s), F.lit(0.0)).alias(s) for s in ("revenue", "refunded")],
        mean(zero("minutes"), zero("held")).alias("avg_minutes"), available.cast("double").alias("available_hours"), zero("booked_hours").cast("double").alias("booked_hours"), rate(zero("booked_hours"), available).alias("occupancy_rate"),
        rate(zero("cancelled"), zero("bookings")).alias("cancellation_rate"),
    )


def cancellations(bookings: DataFrame, p: ReportParams) -> DataFrame:
    """One row: cancelled and missed bookings, their money and their rates; the refund rate is money over money."""
    def part(s: str, value: Column) -> Column:
        return money(F.when(c("status") == s, value))

    refund = F.when(c("status") == "cancelled", c("refund_amount"))
    cents = lambda x: F.round(c(x) * 100).cast("long")
    out = live(bookings).where(in_range(c("created_at"), p)).agg(
        F.count(F.lit(1)).alias("total"), count_if(c("status") == "cancelled").alias("cancellations"), part("cancelled", c("amount")).alias("amount"), part("cancelled", c("refund_amount")).alias("refunded"),
        mean(F.coalesce(F.sum(refund), F.lit(0)), F.count(refund)).alias("avg_refund"), count_if(c("status") == "no_show").alias("no_shows"), part("no_show", c("amount")).alias("lost"),
    )
    return out.withColumn("cancellation_rate", rate(c("cancellations"), c("total"))).withColumn("refund_rate", rate(cents("refunded"), cents("amount"))).withColumn("no_show_rate", rate(c("no_shows"), c("total")))


def cancellations_by_resource(bookings: DataFrame, resources: DataFrame, p: ReportParams) -> DataFrame:
    """Cancelled bookings and their refunds, of every resource that has any."""
    own = live(bookings).where(in_range(c("created_at"), p) & (c("status") == "cancelled")).groupBy("resource_id").agg(F.count(F.lit(1)).alias("cancellations"), money(c("refund_amount")).alias("refunded"))
    return own.join(resources.select(c("id").alias("resource_id"), c("name").alias("resource_name"), c("type").alias("resource_type")), "resource_id")


def cancellation_trend(bookings: DataFrame, p: ReportParams) -> DataFrame:
    own = live(bookings).where(in_range(c("created_at"), p) & (c("status") == "cancelled"))
    return own.groupBy(bucket(c("created_at"), p.period).alias("period")).agg(F.count(F.lit(1)).alias("cancelled"), money(c("refund_amount")).alias("refunded"))


def peak(bookings: DataFrame, p: ReportParams, by: str) -> DataFrame:
    """Bookings and revenue by start: ``dow`` (0 = Sunday), ``hour`` or ``month``."""
    own = live(bookings).where(in_range(c("start_at"), p) & (c("status") != "cancelled"))
    if by == "dow":
        keys = [(F.dayofweek("start_at") - 1).alias("day_of_week"), F.date_format("start_at", "EEEE").alias("day_name")]
    elif by == "hour":
        keys = [F.hour("start_at").alias("hour"), F.concat(F.lpad(F.hour("start_at").cast("string"), 2, "0"), F.lit(":00")).alias("label")]
    else:
        keys = [F.date_format("start_at", "yyyy-MM").alias("month")]
    return own.groupBy(*keys).agg(F.count(F.lit(1)).alias("bookings"), money(c("amount")).alias("revenue"))


def lead_time(bookings: DataFrame, resources: DataFrame, p: ReportParams) -> DataFrame:
    """Mean whole hours from booking to start per resource, rounded to two digits, shortest first."""
    own = live(bookings).where(in_range(c("start_at"), p) & (c("status") != "cancelled"))
    stats = own.groupBy("resource_id").agg(half_up(F.sum(hours_between(c("created_at"), c("start_at"))), F.count(F.lit(1)), 2).alias("lead_hours"))
    return stats.join(resources.select(c("id").alias("resource_id"), "name"), "resource_id").orderBy("lead_hours", "resource_id").limit(p.limit)


def slots(availability: DataFrame, resources: DataFrame, bookings: DataFrame, day: str, now: str) -> DataFrame:
    """Slots of one day: from each availability, every ``slot_minutes``; with the confirmed and pending bookings that start there, and whether one may still book."""
    at = F.lit(day).cast("date")
    own = availability.where(c("is_active") & (c("day_of_week") == F.dayofweek(at) - 1)).join(live(resources).select(c("id").alias("resource_id"), "capacity"), "resource_id")
    start = F.explode(F.expr("sequence(start_hour * 60, end_hour * 60 - slot_minutes, slot_minutes)"))
    made = own.where(c("end_hour") * 60 - c("slot_minutes") >= c("start_hour") * 60).select("resource_id", "capacity", "slot_minutes", start.alias("minute"))
    base = F.lit(f"{day} 00:00:00").cast("timestamp_ntz")
    made = made.withColumn("slot_start", F.timestamp_add("MINUTE", c("minute"), base)).withColumn("slot_end", F.timestamp_add("MINUTE", c("minute") + c("slot_minutes"), base))
    held = live(bookings).where(c("status").isin("confirmed", "pending") & (c("start_at") >= base) & (c("start_at") < F.timestamp_add("DAY", F.lit(1), base)))
    booked = held.groupBy(c("resource_id"), c("start_at").alias("slot_start")).agg(F.count(F.lit(1)).alias("booked"))
    out = made.join(booked, ["resource_id", "slot_start"], "left").select("resource_id", "slot_start", "slot_end", "capacity", F.coalesce("booked", F.lit(0)).alias("booked"))
    return out.withColumn("available", (c("booked") < c("capacity")) & (c("slot_start") > F.lit(now).cast("timestamp_ntz")))


def conflicts(requests: DataFrame, bookings: DataFrame, resources: DataFrame) -> DataFrame:
    """Per request (id, resource_id, start_at, end_at): overlapping bookings that are not cancelled, and whether they reach capacity.

    Both sides meet by resource and day: a booking is dealt to every day that it
    touches, and a pair counts on the later of its two first days only. A busy
    resource is so compared day by day and not as a whole.
    """
    days = lambda a, b: F.explode(F.sequence(F.to_date(a), F.to_date(F.greatest(F.col(a), F.timestamp_add("SECOND", F.lit(-1), F.col(b))))))
    held = live(bookings).where(c("status") != "cancelled").select(c("resource_id").alias("r"), c("id").alias("bid"), c("start_at").alias("s"), c("end_at").alias("e"))
    held = held.withColumn("day", days("s", "e"))
    own = requests.select("id", "resource_id", "start_at", "end_at").withColumn("asked", days("start_at", "end_at"))
    once = c("asked") == F.to_date(F.greatest("s", "start_at"))
    hit = own.join(held, (c("resource_id") == c("r")) & (c("asked") == c("day")) & (c("s") < c("end_at")) & (c("e") > c("start_at")) & (c("bid") != c("id")) & once).groupBy("id", "resource_id").agg(F.count(F.lit(1)).alias("overlaps"))
    counted = requests.select("id", "resource_id").distinct().join(hit, ["id", "resource_id"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))
    return counted.join(resources.select(c("id").alias("resource_id"), "capacity"), "resource_id").withColumn("conflict", c("overlaps") >= c("capacity"))


def within_availability(requests: DataFrame, availability: DataFrame) -> DataFrame:
    """Requests whose times of day lie in an active window of the weekday on which they start."""
    second = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    own = availability.where("is_active").select(c("resource_id").alias("r"), "day_of_week", "start_hour", "end_hour")
    fits = (c("resource_id") == c("r")) & (F.dayofweek("start_at") - 1 == c("day_of_week")) & (second("start_at") >= c("start_hour") * 3600) & (second("end_at") <= c("end_hour") * 3600)
    return requests.join(own, fits, "left_semi")


def refunds(bookings: DataFrame, policies: DataFrame, now: str) -> DataFrame:
    """Refund of cancelling now: the tier with most hours that still fits, to the second; none once the booking has begun."""
    own = bookings.withColumn("seconds_left", F.timestamp_diff("SECOND", F.lit(now).cast("timestamp_ntz"), c("start_at")))
    tiers = policies.select(c("resource_id").alias("r"), "hours_before", "refund_percentage")
    hit = own.join(tiers, (c("resource_id") == c("r")) & (c("seconds_left") > 0) & (c("seconds_left") >= c("hours_before") * 3600), "left")
    best = hit.groupBy("id", "amount", "seconds_left").agg(F.coalesce(F.max_by("refund_percentage", "hours_before"), F.lit(0)).alias("refund_percentage"))
    return best.withColumn("refund", (c("amount") * c("refund_percentage") / 100).cast("decimal(18,2)").cast("double"))


def booked_flag(resources: DataFrame, bookings: DataFrame, user_id: int) -> DataFrame:
    mine = live(bookings).where((c("user_id") == user_id) & (c("status") != "cancelled")).select(c("resource_id").alias("id")).distinct().withColumn("is_booked", F.lit(True))
    return resources.join(mine, "id", "left").withColumn("is_booked", F.coalesce("is_booked", F.lit(False)))


def latest_booking(bookings: DataFrame) -> DataFrame:
    w = W.partitionBy("resource_id").orderBy(F.desc("created_at"), F.desc("id"))
    return bookings.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
