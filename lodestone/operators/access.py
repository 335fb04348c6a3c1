"""Subscriptions, visibility, metering, roles and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

c = F.col


def active_features(subscriptions: DataFrame, features: DataFrame, now: str) -> DataFrame:
    at = F.lit(now).cast("timestamp_ntz")
    own = subscriptions.where((c("status") == "active") & (c("ends_at").isNull() | (c("ends_at") >= at)))
    return own.select("user_id", "plan_id").join(features, "plan_id").select("user_id", "feature", "limit")


def visible_to(entries: DataFrame, rules: DataFrame, features: DataFrame, user_id: int) -> DataFrame:
    """Entries without a rule, or of whose rule's features the user holds any."""
    held = features.where(c("user_id") == user_id).agg(F.collect_set("feature").alias("held"))  # a plan's few features
    ruled = rules.groupBy("entry_id").agg(F.collect_set("feature").alias("needs"))
    out = entries.join(ruled, entries["id"] == ruled["entry_id"], "left").crossJoin(F.broadcast(held))
    return out.where(c("needs").isNull() | F.arrays_overlap("needs", "held")).drop("entry_id", "needs", "held")


def meter(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Usage in order per (user, feature): running use, and whether each event stays within the limit."""
    w = W.partitionBy("user_id", "feature").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    return events.join(limits, "feature", "left").withColumn("used", F.sum("amount").over(w)).withColumn("allowed", c("limit").isNull() | (c("used") <= c("limit")))


def reset_due(usages: DataFrame, now: str) -> DataFrame:
    due = c("reset_at") <= F.lit(now).cast("timestamp_ntz")
    step = lambda unit, n: F.timestamp_add(unit, F.lit(n), c("reset_at"))
    following = F.when(c("period") == "daily", step("DAY", 1)).when(c("period") == "weekly", step("DAY", 7)).otherwise(step("MONTH", 1))
    return usages.withColumn("used", F.when(due, 0).otherwise(c("used"))).withColumn("reset_at", F.when(due, following).otherwise(c("reset_at")))


def renewal(subscriptions: DataFrame, now: str, grace_days: int = 3) -> DataFrame:
    """renew, grace or expire for subscriptions that have ended; keep for the others."""
    at = F.lit(now).cast("timestamp_ntz")
    over = F.timestamp_diff("DAY", c("ends_at"), at)
    return subscriptions.withColumn("action", F.when(c("ends_at") > at, "keep").when(c("auto_renew"), "renew").when(over <= grace_days, "grace").otherwise("expire"))


def members(users: DataFrame, memberships: DataFrame, roles: DataFrame, project_id: int | None = None) -> DataFrame:
    own = memberships if project_id is None else memberships.where(c("project_id").isNull() | (c("project_id") == project_id))
    return users.join(own, "user_id").join(roles, "role_id").select("user_id", "role", "project_id")


def notifications(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("read_at").isNull()).alias("unread"), F.max("created_at").alias("last"))


def valid_sessions(sessions: DataFrame, blacklist: DataFrame, now: str) -> DataFrame:
    """Sessions that are neither over nor revoked and whose token is not on the list of blocked ones."""
    own = sessions.where((c("expires_at") > F.lit(now).cast("timestamp_ntz")) & c("revoked_at").isNull())
    return own.join(blacklist.select("token"), "token", "left_anti")


def may_see(entries: DataFrame, rules: DataFrame, held: DataFrame) -> DataFrame:
    """Per user and entry whether the user holds a feature that the entry asks for, or it asks for none.

    ``held`` has (user_id, feature); an entry's and a user's features are few.
    """
    needs = rules.groupBy("entry_id").agg(F.collect_set("feature").alias("needs"))
    mine = held.groupBy("user_id").agg(F.collect_set("feature").alias("mine"))
    asked = entries.select("user_id", "entry_id").join(needs, "entry_id", "left").join(mine, "user_id", "left")
    return asked.select("user_id", "entry_id", (c("needs").isNull() | F.coalesce(F.arrays_overlap("needs", "mine"), F.lit(False))).alias("allowed"))


def metered_by_rules(events: DataFrame, rules: DataFrame, limits: DataFrame) -> DataFrame:
    """Usage by the active rules of each event: ``check`` asks only, ``increment`` counts only, ``both`` asks and counts if there is room.

    Events are (id, user_id, event_key, ts), rules (id, event_key, feature, mode, amount),
    limits (feature, limit). Use is what earlier events of the user and feature have
    counted; an event within the limit counts in full. A limit that some event of
    ``both`` would pass is kept by counting those that still fit, in order.
    """
    own = events.join(rules.where("is_active").select("event_key", "feature", "mode", "amount", c("id").alias("rule")), "event_key").join(limits, "feature", "left")

    def run(rows):
        rows = rows.sort_values(["ts", "id", "rule"])
        used, out = 0, []
        for mode, amount, limit in zip(rows["mode"], rows["amount"], rows["limit"], strict=True):
            fits = limit != limit or limit is None or used + amount <= limit
            if mode == "increment" or mode == "both" and fits:
                used += amount
            out.append((mode == "increment" or fits, used))
        return rows.assign(allowed=[bool(a) for a, _ in out], used=[int(u) for _, u in out])[["id", "user_id", "feature", "allowed", "used"]]

    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.groupBy("user_id", "feature").applyInPandas(run, f"id {kind['id']}, user_id {kind['user_id']}, feature string, allowed boolean, used bigint")
