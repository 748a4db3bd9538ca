"""Structured Streaming jobs over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, every: str, by: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window; works on a batch, or on a stream with a watermark."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, every).alias("w"), by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding_counts(events: DataFrame, time: str, length: str, step: str, by: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, length, step).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), by, "n"
    )


def session_counts(events: DataFrame, time: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), by, "n"
    )


def once_by_key(events: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Idempotent delivery on a stream: later rows of a key within the watermark are dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def outbox_updates(
    log: DataFrame, key: str, time: str, most: int, base: float = 2.0, cap: float = 600.0, answer: float = 60.0, late: str = "10 minutes",
) -> DataFrame:
    """The outbox of `operators.memory.outbox` kept on a stream: key, seq, state, failures, delay, reason; write it in update mode.

    log: key, a time and status (queued, inflight, error, ack), on a stream. A message's state is its number of acknowledgements and failures and whether it's in flight.
    Each batch that has rows of a message gives its new state (reason `log`). A pending message has a timer: when the watermark passes its back-off after the latest
    row, it is `due`; one in flight without an answer for `answer` seconds is `released`, back to pending. State and timers are in the query's checkpoint, so a query that
    is started again goes on where it stopped, and the timers that ran out meanwhile fire then. Per message the update with the highest `seq` counts; replays of a batch give
    the same numbers. Acknowledgements after a failure count; rows that come more than `late` behind the newest are dropped.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    key_type = log.schema[key].dataType.simpleString()
    rows = log.select(F.col(key).alias("_key"), F.col(time).cast("timestamp").alias("_time"), F.col("status").alias("_status"))
    rows = rows.withColumn("_at", (F.unix_micros("_time") / 1000).cast("long"))

    def step(keys, frames, held):
        import pandas as pd

        acks, failures, flying, last, seq = held.get if held.exists else (0, 0, False, 0, 0)
        if held.hasTimedOut:
            reason, flying = "released" if flying else "due", False
        else:
            reason = "log"
            for f in frames:
                acks, failures = acks + int((f["_status"] == "ack").sum()), failures + int((f["_status"] == "error").sum())
                newest = f.sort_values(["_at", "_status"]).iloc[-1]
                if newest["_at"] >= last:
                    last, flying = int(newest["_at"]), newest["_status"] == "inflight"
        state = "sent" if acks else "failed" if failures >= most else "pending"
        delay = min(cap, base**failures) if state == "pending" else None
        held.update((acks, failures, bool(flying), last, seq + 1))
        if state == "pending" and reason == "log":
            wait = int(1000 * (answer if flying else delay))
            held.setTimeoutTimestamp(max(last + wait, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [keys[0]], "seq": [seq + 1], "state": [state], "failures": [failures], "delay": [delay], "reason": [reason]})

    return rows.withWatermark("_time", late).groupBy("_key").applyInPandasWithState(
        step, f"`{key}` {key_type}, seq long, state string, failures long, delay double, reason string",
        "acks long, failures long, flying boolean, last long, seq long", "update", GroupStateTimeout.EventTimeTimeout,
    )
