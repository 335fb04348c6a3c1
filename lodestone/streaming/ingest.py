"""Event ingestion on Structured Streaming; each function also takes a batch frame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ..functions import lexicon

EVENT = "event_id string, module string, event_type string, user_id bigint, project_id bigint, occurred_at timestamp, payload string"


def decode(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): JSON that does not parse, or lacks an id, is set aside and not lost."""
    parsed = raw.withColumn("e", F.from_json(F.col(column), EVENT))
    good = F.col("e").isNotNull() & F.col("e.event_id").isNotNull()
    return parsed.where(good).select("e.*"), parsed.where(~F.coalesce(good, F.lit(False))).select(column)


def dedupe(events: DataFrame, key: str = "event_id", ts: str = "occurred_at", delay: str = "1 day") -> DataFrame:
    """One event for each id; in a stream the state is dropped behind the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def route(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(logs, audit): events of type audit go to their own sink."""
    audit = F.col("event_type").startswith("audit")
    return events.where(~audit), events.where(audit)


def write_both(events: DataFrame, logs: str, audit: str, checkpoint: str):
    """Start the consumer: deduplicated events to two parquet sinks, at least once with idempotent batches."""
    def sink(batch: DataFrame, number: int) -> None:
        for part, path in zip(route(batch), (logs, audit), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return dedupe(events).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, width: str, slide: str | None = None, delay: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling or sliding counts (an extension; the rolling counts over 24 h, 7 d and 30 d are windows of those widths)."""
    own = events.withWatermark(ts, delay) if events.isStreaming else events
    return own.groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    own = events.withWatermark(ts, delay) if events.isStreaming else events
    return own.groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def notifications(raw: DataFrame, key: str = "routing_key", value: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(handled, unknown, corrupt) messages of the notification queue.

    Known routing keys are handled; unknown ones are acknowledged and only told
    apart; JSON that does not parse is dropped from the queue and set aside here.
    """
    parsed = raw.withColumn("data", F.from_json(F.col(value), "user_id bigint, _meta struct<source: string, event: string, published_at: string>"))
    good = parsed.where(F.coalesce(F.col("data").isNotNull() & F.try_parse_json(F.col(value)).isNotNull(), F.lit(False)))
    known = F.col(key).isin(*lexicon.NOTIFICATIONS)
    rows = good.select(F.col("data.user_id").alias("user_id"), F.col(key).alias("kind"), F.element_at(F.split(key, r"\."), 1).alias("service"), F.col(value).alias("payload"))
    bad = parsed.where(~F.coalesce(F.col("data").isNotNull() & F.try_parse_json(F.col(value)).isNotNull(), F.lit(False)))
    return rows.where(F.col("kind").isin(*lexicon.NOTIFICATIONS)), rows.where(~F.col("kind").isin(*lexicon.NOTIFICATIONS)), bad.select(key, value).withColumn("known", known)


def published(payloads: DataFrame, key: str, source: str, now: str) -> DataFrame:
    """(routing_key, value): rows as JSON messages with where, what and when they come from."""
    meta = F.struct(F.lit(source).alias("source"), F.lit(key).alias("event"), F.lit(now).alias("published_at"))
    return payloads.select(F.lit(key).alias("routing_key"), F.to_json(F.struct(*payloads.columns, meta.alias("_meta"))).alias("value"))


#: Maintenance jobs and the minutes between their runs; a day's job has the hour it starts at.
JOBS = {"reindex": ("daily", 2), "recompute_popular": ("every", 60), "update_signals": ("every", 60), "update_popularity": ("every", 60), "reset_usage": ("every", 60), "renew_subscriptions": ("every", 1)}


def due(last: dict[str, datetime], now: datetime, jobs: dict[str, tuple[str, int]] = JOBS) -> list[str]:
    """Jobs that should run now, given when each last began; a job that never ran is due at its next time."""
    out = []
    for name, (kind, n) in jobs.items():
        if kind == "daily":
            slot = now.replace(hour=n, minute=0, second=0, microsecond=0)
            slot = slot if slot <= now else slot - timedelta(days=1)
        else:
            slot = datetime.min + ((now - datetime.min) // timedelta(minutes=n)) * timedelta(minutes=n)
        if name not in last or last[name] < slot:
            out.append(name)
    return out


def micro_batch(stream: DataFrame, run, checkpoint: str):
    """A scheduled job over what is new since its last run: one batch, then the query ends."""
    return stream.writeStream.foreachBatch(lambda batch, number: run(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rest(state) -> None:
    state.remove()


def metered(events: DataFrame, limit: int, reset_seconds: int, delay: str = "1 hour"):
    """Keyed counters with expiry in a stream of (user_id, amount, ts): each event with its running use and verdict.

    A user's counter is dropped once the watermark passes its reset.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(key, batches, state):
        if state.hasTimedOut:
            _rest(state)
            return
        used, until = state.get if state.exists else (0, 0)
        for pdf in batches:
            pdf, out = pdf.sort_values("ts"), []
            for ts, amount in zip(pdf["ts"], pdf["amount"], strict=True):
                at = int(pd.Timestamp(ts).timestamp())
                if at >= until:
                    used, until = 0, at + reset_seconds
                allowed = used + amount <= limit
                used += amount if allowed else 0
                out.append((key[0], ts, used, bool(allowed)))
            yield pd.DataFrame(out, columns=["user_id", "ts", "used", "allowed"])
        state.update((int(used), int(until)))
        state.setTimeoutTimestamp(max(until * 1000, state.getCurrentWatermarkMs() + 1))

    own = events.withWatermark("ts", delay)
    return own.groupBy("user_id").applyInPandasWithState(count, "user_id bigint, ts timestamp, used bigint, allowed boolean", "used bigint, until bigint", "append", GroupStateTimeout.EventTimeTimeout)


@dataclass
class Breaker:
    """A circuit breaker: closed, open after ``threshold`` failures for ``wait`` seconds, then half-open until the next report."""

    state: str = "closed"
    failures: int = 0
    retry_at: int = 0
    threshold: int = 5
    wait: int = 300

    def report(self, kind: str, at: int) -> bool:
        """Takes an ``attempt``, ``failure`` or ``success`` at a second; says whether calls may proceed."""
        if kind == "success":
            self.state, self.failures, self.retry_at = "closed", 0, 0
        elif kind == "failure" and self.state != "open":
            self.failures += self.state == "closed"
            if self.state == "half-open" or self.failures >= self.threshold:
                self.state, self.retry_at = "open", at + self.wait
        elif kind == "attempt" and self.state == "open" and at > self.retry_at:
            self.state = "half-open"
        return self.state != "open"


def breakers(events: DataFrame, threshold: int = 5, wait: int = 300) -> DataFrame:
    """Each event of (service, ts, kind, id) in a batch with its service's state after it and whether calls may proceed."""
    import pandas as pd

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "id"])
        breaker, out = Breaker(threshold=threshold, wait=wait), []
        for kind, ts in zip(rows["kind"], rows["ts"], strict=True):
            allowed = breaker.report(kind, int(pd.Timestamp(ts).timestamp()))
            out.append((breaker.state, allowed))
        return rows.assign(state=[s for s, _ in out], allowed=[a for _, a in out])[["service", "id", "state", "allowed"]]

    kind = events.schema["id"].dataType.simpleString()
    return events.groupBy("service").applyInPandas(run, f"service string, id {kind}, state string, allowed boolean")


def breaker_stream(events: DataFrame, threshold: int = 5, wait: int = 300, delay: str = "1 hour"):
    """The same over a stream of (service, ts, kind); a service's state rests once the watermark is an hour past its retry."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            _rest(state)
            return
        breaker = Breaker(*(state.get if state.exists else ("closed", 0, 0)), threshold=threshold, wait=wait)
        last = 0
        for pdf in batches:
            pdf, out = pdf.sort_values("ts"), []
            for kind, ts in zip(pdf["kind"], pdf["ts"], strict=True):
                last = int(pd.Timestamp(ts).timestamp())
                allowed = breaker.report(kind, last)
                out.append((key[0], ts, breaker.state, allowed))
            yield pd.DataFrame(out, columns=["service", "ts", "state", "allowed"])
        state.update((breaker.state, int(breaker.failures), int(breaker.retry_at)))
        state.setTimeoutTimestamp(max((max(last, breaker.retry_at) + 3600) * 1000, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", delay).groupBy("service").applyInPandasWithState(run, "service string, ts timestamp, state string, allowed boolean", "state string, failures bigint, retry_at bigint", "append", GroupStateTimeout.EventTimeTimeout)
