"""Event memory: validation by authority, application to a frozen baseline, digests, outbox states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_digest(*columns: str) -> Column:
    """SHA-256 of a row as compact JSON with keys in order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def table_digest(*columns: str) -> Column:
    """An aggregate that tells whether two sets of rows are equal, whatever their order: the sum of 32 bits of each row's
    MD5 over texts of the columns; a null counts as an empty text."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"))


def checked_events(events: DataFrame, as_of: Column, authorities: dict[str, list[str]], required: list[str]) -> DataFrame:
    """events with `error`, the first rule that an event breaks, or null.

    events: event_id, record_time, subject, kind, authority, affects (array of subjects) and further required columns.
    Rules in order: a required field is null; recorded at or before the baseline; an earlier event (by record time) has
    the same id; the kind asks for an authority that the event hasn't; it affects another subject.
    """
    again = F.row_number().over(Window.partitionBy("event_id").orderBy("record_time", "subject")) > 1
    incomplete = F.lit(False)
    for c in required:
        incomplete = incomplete | F.col(c).isNull()
    unfit = F.lit(False)
    for kind, allowed in authorities.items():
        unfit = unfit | ((F.col("kind") == kind) & ~F.coalesce(F.col("authority").isin(allowed), F.lit(False)))
    other = F.size(F.array_except(F.coalesce("affects", F.array().cast("array<long>")), F.array("subject"))) > 0
    error = (
        F.when(incomplete, "incomplete").when(F.col("record_time") <= as_of, "before_baseline").when(again, "repeated_id")
        .when(unfit, "authority").when(other, "other_subject")
    )
    return events.withColumn("error", error)


def applied(baseline: DataFrame, events: DataFrame, silent: list[str]) -> DataFrame:
    """subject, before, after, event_id, proposals, changed: the state after events, replayed by (record_time, event_id).

    baseline: subject, status. events: subject, event_id, record_time, kind, ambiguous, status; valid ones only. Kinds in
    `silent` and ambiguous events are proposals and change nothing. The last change wins, so that a partial maximum by
    subject replaces the replay, in any order of rows. Subjects of either side are returned.
    """
    proposal = F.col("kind").isin(silent) | F.coalesce("ambiguous", F.lit(False))
    last = F.max(F.when(~proposal, F.struct("record_time", "event_id", "status")))
    by = events.groupBy("subject").agg(last.alias("last"), F.count_if(proposal).alias("proposals"))
    both = baseline.select("subject", F.col("status").alias("before")).join(by, "subject", "full")
    return both.select(
        "subject", "before", F.coalesce(F.col("last.status"), F.col("before")).alias("after"), F.col("last.event_id").alias("event_id"),
        F.coalesce("proposals", F.lit(0)).alias("proposals"), F.col("last").isNotNull().alias("changed"),
    )


def outbox(log: DataFrame, key: str, most: int, base: float = 2.0, cap: float = 600.0) -> DataFrame:
    """key, state, failures, delay: `sent` if ever acknowledged (late acknowledgements count), `failed` after `most`
    failures, else `pending` with the seconds to wait; messages in flight without an answer are released as pending.

    log: key and status (queued, inflight, error, ack)."""
    by = log.groupBy(key).agg(F.count_if(F.col("status") == "ack").alias("acks"), F.count_if(F.col("status") == "error").alias("failures"))
    state = F.when(F.col("acks") > 0, "sent").when(F.col("failures") >= most, "failed").otherwise("pending")
    delay = F.least(F.lit(cap), F.pow(F.lit(base), F.col("failures")))
    return by.select(key, state.alias("state"), "failures", F.when(state == "pending", delay).alias("delay"))
