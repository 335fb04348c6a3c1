"""Small lookups: plans, rules, uniqueness, trash, membership, pages of conversations and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

c = F.col


def slug_taken(rows: DataFrame, slug: str, project_id: int, but: int | None = None) -> DataFrame:
    """One row: whether a row of the project, other than ``but``, has the slug."""
    own = rows.where((c("project_id") == project_id) & (c("slug") == slug))
    if but is not None:
        own = own.where(c("id") != but)
    return own.agg((F.count(F.lit(1)) > 0).alias("taken"))


def active_plans(plans: DataFrame, features: DataFrame, project_id: int | None = None) -> DataFrame:
    """Active plans with their features as a sorted list; a plan has a few."""
    own = plans.where("is_active") if project_id is None else plans.where(c("is_active") & (c("project_id") == project_id))
    held = features.groupBy("plan_id").agg(F.sort_array(F.collect_list("feature")).alias("features"))
    return own.join(held, own["id"] == held["plan_id"], "left").drop("plan_id").withColumn("features", F.coalesce("features", F.array().cast("array<string>")))


def active_rules(rules: DataFrame, event: str, project_id: int | None = None) -> DataFrame:
    """Active rules of an event; without a project those that have none."""
    return rules.where(c("is_active") & (c("event_key") == event) & c("project_id").eqNullSafe(F.lit(project_id)))


def first_rule(rules: DataFrame, event: str, project_id: int | None = None) -> DataFrame:
    return active_rules(rules, event, project_id).orderBy("id").limit(1)


def repeated_names(fields: DataFrame) -> DataFrame:
    """(data_type_id, name, n) of field names that a type has more than once."""
    return fields.groupBy("data_type_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def name_taken(fields: DataFrame, data_type_id: int, name: str, but: int | None = None) -> DataFrame:
    own = fields.where((c("data_type_id") == data_type_id) & (c("name") == name))
    return (own if but is None else own.where(c("id") != but)).agg((F.count(F.lit(1)) > 0).alias("taken"))


def listed_types(types: DataFrame, project_id: int, trashed: bool = False) -> DataFrame:
    """A project's data types by name, or its deleted ones."""
    gone = c("deleted_at").isNotNull()
    return types.where((c("project_id") == project_id) & (gone if trashed else ~gone)).orderBy("name", "id")


def is_member(members: DataFrame, projects: DataFrame, project_key: str) -> DataFrame:
    """Users of the project with a public key."""
    return members.join(projects.where(c("public_id") == project_key).select(c("id").alias("project_id")), "project_id", "left_semi").select("user_id").distinct()


def conversation_page(conversations: DataFrame, messages: DataFrame, user_id: int, page: int, size: int) -> DataFrame:
    """A user's active conversations, newest first, with the last message of each, and the total."""
    own = conversations.where((c("user_id") == user_id) & (c("status") == "active"))
    total = own.agg(F.count(F.lit(1)).alias("total"))
    shown = own.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    last = messages.join(F.broadcast(shown.select(c("id").alias("conversation_id"))), "conversation_id", "left_semi").groupBy("conversation_id").agg(F.max_by("text", "turn").alias("last_message"))  # a page
    return shown.join(last, shown["id"] == last["conversation_id"], "left").drop("conversation_id").crossJoin(F.broadcast(total))


def returns_page(requests: DataFrame, items: DataFrame, page: int, size: int = 10) -> DataFrame:
    """Return requests, newest first, with their order item, and the total."""
    total = requests.agg(F.count(F.lit(1)).alias("total"))
    shown = requests.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size)
    return shown.join(items.select(c("id").alias("order_item_id"), "product_id", "price"), "order_item_id", "left").crossJoin(F.broadcast(total))
