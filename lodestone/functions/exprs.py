"""Column helpers that reports share. Rounding is exact: integers in, half up, double out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..params import ReportParams


def in_range(ts: Column, p: ReportParams) -> Column:
    """Closed range of whole days: from 00:00:00 of the first to 23:59:59 of the last."""
    at = lambda day, time: F.lit(f"{day} {time}").cast("timestamp_ntz")
    return ts.between(at(p.start, "00:00:00"), at(p.end, "23:59:59"))


def bucket(ts: Column, period: str) -> Column:
    """Day, ISO year and week (2025-W01), or month, as text."""
    if period == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    return F.date_format(ts, "yyyy-MM" if period == "monthly" else "yyyy-MM-dd")


def _div(n: Column, d: Column) -> Column:
    """Integer division that gives 0 for a divisor of 0."""
    return F.call_function("div", n.cast("long"), F.when(d != 0, d).otherwise(1).cast("long"))


def rate(n: Column, d: Column) -> Column:
    """round(n / d * 100, 2), 0 if d is 0."""
    return F.when(d > 0, _div(n * 20000 + d, d * 2) / F.lit(100.0)).otherwise(F.lit(0.0))


def half_up(n: Column, d: Column, digits: int) -> Column:
    """round(n / d, digits) of integers, exact and away from zero at the half; 0 if d is 0."""
    scale = 2 * 10**digits
    cut = _div(F.abs(n) * scale + d, d * 2) / F.lit(float(10**digits))
    return F.when(d > 0, F.when(n < 0, -cut).otherwise(cut)).otherwise(F.lit(0.0))


def mean(total: Column, n: Column) -> Column:
    """round(total / n, 2) of a decimal total with two digits, 0 if n is 0."""
    return half_up((total * 100).cast("long"), n * 100, 2)


def money(c: Column) -> Column:
    """A sum that is 0 over no rows, as double at the output's edge."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def count_if(c: Column) -> Column:
    return F.coalesce(F.count_if(c), F.lit(0))


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    """Rows that are not softly deleted; opt-in for each query."""
    return df.where(F.col(column).isNull()) if column in df.columns else df


def hours_between(start: Column, end: Column) -> Column:
    """Whole hours, cut towards zero."""
    return F.timestamp_diff("HOUR", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)
