"""Progress events of running tasks: throttles and checkpoints, over a stream or
a table alike where the plan allows it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INTERVAL, RESPONSE_INTERVAL, TTL = "10 seconds", "8 seconds", "20 minutes"


def latest(events: DataFrame, interval: str = INTERVAL, by: list[str] | None = None, late: str | None = None) -> DataFrame:
    """The latest event of each task in each interval: what a throttled
    publisher sends. On a stream give ``late``, how long to wait for stragglers."""
    by = by or ["task_id"]
    rows = events.withWatermark("ts", late) if late else events
    body = F.struct(*[c for c in events.columns if c not in (*by, "ts")])
    return rows.groupBy(*by, F.window("ts", interval)).agg(F.max_by(body, F.struct("ts", body)).alias("e"), F.max("ts").alias("ts")).select(*by, F.col("window.start").alias("start"), "ts", "e.*")


def monotone(events: DataFrame, by: list[str], ratio: str = "completed_ratio", order: list[str] | None = None, cap: int = 100) -> DataFrame:
    """Adds ``progress``, which never falls (and is ``cap`` at most), and
    ``checkpoint``: whether it reaches the next tenth."""
    w = W.partitionBy(*by).orderBy(*(order or ["ts"]))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = events.withColumn("progress", F.least(F.max(ratio).over(upto), F.lit(cap)))
    tenth = F.floor(F.col("progress") / 10)
    return out.withColumn("checkpoint", F.coalesce(tenth > F.lag(tenth).over(w), tenth > 0))


def sessions(events: DataFrame, by: list[str], gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """by, start, end, n: runs of events without a longer pause."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(*by, F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(*by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def highest(events: DataFrame, late: str = TTL) -> DataFrame:
    """On a stream: each task's highest ratio so far. State goes ``late`` after a task's last event."""
    return events.withWatermark("ts", late).groupBy("task_id").agg(F.max("completed_ratio").alias("progress"), F.max("ts").alias("ts"))


def publish(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, mode: str = "append"):
    """Starts a query that hands each micro-batch to ``send`` (which should be
    idempotent by batch number: a batch may come again after a failure)."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=INTERVAL)).start()
