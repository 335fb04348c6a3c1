"""Writes as DataFrame transforms: upsert, insert-ignore, deltas and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key is not in it. Null keys are never equal."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is unknown, one for each key."""
    return new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")


def add_deltas(rows: DataFrame, deltas: DataFrame, key: str, column: str) -> DataFrame:
    """Counters after all increments of a batch, added up by key first."""
    summed = deltas.groupBy(key).agg(F.sum(column).alias("_d"))
    return rows.join(summed, key, "left").withColumn(column, F.col(column) + F.coalesce("_d", F.lit(0))).drop("_d")


def retain(rows: DataFrame, column: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(column) >= F.lit(cutoff).cast("timestamp_ntz"))


def page(rows: DataFrame, order: Sequence, number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
