"""The outbox on a stream that is stopped and started again, against the batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import memory
from weft.streaming import jobs

SF = "/root/testdata/sf0.001"


def _log(events):
    kind, slot = F.col("event_type"), F.hour("ts")
    status = F.when((kind == "purchase") & (slot % 4 == 0), "ack").when(kind == "error", "error").when(kind == "click", "inflight").otherwise("queued")
    return events.select((F.col("user_id") * 100 + slot).alias("message"), "ts", status.alias("status"))


def test_a_restarted_outbox_equals_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    place, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    parts = events.withColumn("part", F.ntile(4).over(Window.orderBy("ts", "event_id"))).cache()

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)
        updates = jobs.outbox_updates(_log(stream), "message", "ts", 5)
        query = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
            lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        ).start()
        query.awaitTermination()

    seen = []
    for some in ((1, 2), (3, 4)):  # the query stops in between, with messages in flight
        for p in some:
            parts.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(place)
        run()
        seen.append(spark.read.parquet(out).count())
    assert 0 < seen[0] < seen[1]
    updates = spark.read.parquet(out)
    last = updates.groupBy("message").agg(F.max(F.struct("seq", "state", "failures", "delay")).alias("u")).select("message", "u.state", "u.failures", "u.delay")
    expected = {tuple(r) for r in memory.outbox(_log(events), "message", 5).collect()}
    assert {tuple(r) for r in last.collect()} == expected
    # each update of a message has its own number, also across the restart, and timers fired
    assert updates.select("message", "seq").distinct().count() == updates.count()
    assert {r["reason"] for r in updates.select("reason").distinct().collect()} == {"log", "due", "released"}
