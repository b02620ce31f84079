"""Live views of journals and ledgers.

The delay after which late rows are dropped is ten minutes unless given. Functions take and return streaming frames;
the same code runs on a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import patterns as P
from ..operators.ledger import request_key, usage_ledger

DELAY = "10 minutes"


def journal_stream(spark: SparkSession, path: str) -> DataFrame:
    """New lines of JSON-lines journals, one row per line."""
    return spark.readStream.text(path)


def live_journal(events: DataFrame, keys: list[str], time: str = "ts", delay: str = DELAY) -> DataFrame:
    """Each event once: repeats that arrive within the delay are dropped, and their state with them."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def live_usage(calls: DataFrame, window: str, slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Calls, failures and tokens per provider and time window; windows are tumbling unless `slide` is given."""
    ledger = usage_ledger(calls.withColumn("started_at", F.col("ts").cast("double"))).withColumn("ts", F.timestamp_seconds("started_at"))
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        ledger.withWatermark("ts", delay).groupBy(span.alias("w"), "provider")
        .agg(F.count("*").alias("count"), F.count_if(F.col("state") == "FAILED").alias("failed"),
             F.sum("input").alias("input"), F.sum("output").alias("output"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "provider", "count", "failed", "input", "output"))


def live_status(calls: DataFrame, span: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Latest state per request and span of time; an update stream for `write_updates`, to be read by `latest_status`.

    Spans that the watermark has passed leave the state, so it does not grow with all requests ever made.
    """
    return request_key(calls).withWatermark("ts", delay).groupBy(F.window("ts", span)["start"].alias("span"), "run_id", "purpose", "request").agg(
        F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def latest_status(rows: DataFrame) -> DataFrame:
    """The latest state per request over all spans."""
    return rows.groupBy("run_id", "purpose", "request").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def activity_sessions(events: DataFrame, gap: str, delay: str = DELAY) -> DataFrame:
    """Spans of activity per run, closed by a gap."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "run_id").agg(F.count("*").alias("events"))
        .select("run_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events"))


def live_attempts(calls: DataFrame, span: str = "1 day", delay: str = DELAY) -> DataFrame:
    """Repairs per task and span of time; an update stream, to be read by `all_attempts`."""
    repairs = calls.filter(F.col("repair") & F.col("task_id").isNotNull()).withWatermark("ts", delay)
    return repairs.groupBy(F.window("ts", span)["start"].alias("span"), "run_id", "task_id", "purpose").agg(F.count("*").alias("used"))


def all_attempts(rows: DataFrame, cap: int = P.REPAIR_LIMIT) -> DataFrame:
    """Repairs per task so far and whether the cap is reached."""
    return rows.groupBy("run_id", "task_id", "purpose").agg(F.sum("used").alias("used")).withColumn("exhausted", F.col("used") >= cap)


def repair_limits(calls: DataFrame, expire: str = "30 days", delay: str = DELAY, cap: int = P.REPAIR_LIMIT,
                  reference_cap: int = P.REFERENCE_REPAIR_LIMIT) -> DataFrame:
    """One row for each task whose repairs reach its cap, at the repair that reaches it: `used`, `ts` and `seq` of that call.

    The state of a task is one count. A call with a later `repair_epoch` starts it anew, so the cap can be reached again;
    a task without a repair for the time of `expire`, by the watermark, is forgotten. Calls of one arrival are counted in
    the order of (ts, seq), ten thousand at a time; arrivals follow each other. Late calls are dropped by `delay`.
    """
    keys = ["run_id", "task_id", "purpose"]
    span = int(calls.sparkSession.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00+00' + INTERVAL {expire})").first()[0])
    repairs = calls.filter(F.col("repair") & F.col("task_id").isNotNull()).withWatermark("ts", delay)
    rows = repairs.select(*keys, "ts", F.unix_millis("ts").alias("ms"), F.col("seq").cast("bigint").alias("seq"), F.col("repair_epoch").cast("bigint").alias("repair_epoch"))

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, used, latest = state.get if state.exists else (-1, 0, 0)
        limit = reference_cap if key[2] == "references" else cap
        reached = []
        for batch in batches:
            for ms, seq, own, ts in sorted(zip(batch["ms"], batch["seq"], batch["repair_epoch"], batch["ts"])):
                if own > epoch:
                    epoch, used = own, 0
                # A repair of an epoch that is over does not count.
                used += own == epoch
                latest = max(latest, ms)
                if used == limit and own == epoch:
                    reached.append((*key, int(own), int(used), ts, int(seq)))
        state.update((int(epoch), int(used), int(latest)))
        state.setTimeoutTimestamp(max(int(latest) + span, state.getCurrentWatermarkMs() + 1))
        if reached:
            yield pd.DataFrame(reached, columns=[*keys, "repair_epoch", "used", "ts", "seq"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", repair_epoch bigint, used bigint, ts timestamp, seq bigint"
    return rows.groupBy(*keys).applyInPandasWithState(count, out, "epoch bigint, used bigint, latest bigint", "append", GroupStateTimeout.EventTimeTimeout)


# --- sinks ------------------------------------------------------------------


def write_appends(stream: DataFrame, path: str, checkpoint: str):
    """Start an append query that handles what is there and ends; the checkpoint makes a restart continue."""
    return stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_updates(stream: DataFrame, path: str, checkpoint: str):
    """Start an update query. Each epoch replaces its own folder, so a repeated epoch changes nothing."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current row per key of a table written by `write_updates`."""
    rows = spark.read.parquet(path).drop("batch")
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "epoch").alias("r")).select(*keys, "r.*").drop("epoch")
