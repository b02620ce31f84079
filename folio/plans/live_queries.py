"""Streaming queries: the events table is read as a stream and the sink is read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import stage_folder
from ..streaming import live as V
from . import corpora as C
from .registry import Registry

REGISTRY = Registry()
CALLS = C.duck(C.CALLS)
# The watermark is the latest event minus ten minutes, in milliseconds; windows that end later are still open.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"


def _events(spark, sf):
    schema = C.load(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    if schema["ts"].dataType.typeName() == "timestamp_ntz":
        # Event time must be an instant; wall-clock values are read as UTC whatever the session's zone.
        rows = rows.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts))"))
    return rows


def _calls(spark, sf):
    _events(spark, sf).createOrReplaceTempView("folio_live_events")
    return spark.sql(re.sub(r"@events", "folio_live_events", C.CALLS))


def _finish(spark, stream, updates_by=None):
    base = f"{stage_folder(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    if updates_by:
        V.write_updates(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
        return V.read_updates(spark, f"{base}/out", updates_by)
    V.write_appends(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@REGISTRY.add("live_journal", "SELECT event_id, event_type FROM events")
def live_journal(spark, sf):
    """Every event sent three times, kept once."""
    sent = _events(spark, sf).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return _finish(spark, V.live_journal(sent, ["event_id"]).select("event_id", "event_type"))


@REGISTRY.add("live_usage", f"""
SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts))::BIGINT AS start, connection_id AS provider, count(*) AS count, count(*) FILTER (WHERE state = 'FAILED') AS failed
FROM {CALLS} WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= {_MARK} GROUP BY ALL""")
def live_usage(spark, sf):
    found = _finish(spark, V.live_usage(_calls(spark, sf), "6 hours"))
    return found.select(F.unix_timestamp("start").alias("start"), "provider", "count", "failed")


@REGISTRY.add("live_sliding_usage", f"""
SELECT epoch(s)::BIGINT AS start, connection_id AS provider, count(*) AS count, CAST(sum(i) AS BIGINT) AS input FROM (
 SELECT c.*, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s,
  coalesce(CAST(json_extract(usage, '$.input_tokens') AS BIGINT), CAST(json_extract(usage, '$.prompt_tokens') AS BIGINT), CAST(json_extract(usage, '$.tokens.total.inputTokens') AS BIGINT), CAST(json_extract(usage, '$.promptTokenCount') AS BIGINT)) AS i FROM {CALLS} c)
WHERE s + INTERVAL 12 HOUR <= {_MARK} GROUP BY ALL""")
def live_sliding_usage(spark, sf):
    found = _finish(spark, V.live_usage(_calls(spark, sf), "12 hours", "6 hours"))
    return found.select(F.unix_timestamp("start").alias("start"), "provider", "count", "input")


@REGISTRY.add("live_status", f"SELECT run_id, purpose, coalesce(task_id, input_hash, id) AS request, arg_max(state, seq) AS state, max(seq) AS seq FROM {CALLS} GROUP BY ALL")
def live_status(spark, sf):
    return V.latest_status(_finish(spark, V.live_status(_calls(spark, sf)), ["span", "run_id", "purpose", "request"]))


@REGISTRY.add("activity_sessions", f"""
SELECT run_id, min(epoch_us(ts)) AS start, count(*) AS events FROM (
 SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, seq) AS n FROM (
  SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY ts, seq) AS before FROM {CALLS}))
GROUP BY run_id, n HAVING max(ts) + INTERVAL 2 HOUR <= {_MARK}""")
def activity_sessions(spark, sf):
    found = _finish(spark, V.activity_sessions(_calls(spark, sf), "2 hours"))
    return found.select("run_id", F.unix_micros("start").alias("start"), "events")


@REGISTRY.add("live_attempts", f"SELECT run_id, task_id, purpose, count(*) AS used, count(*) >= 8 AS exhausted FROM {CALLS} WHERE repair AND task_id IS NOT NULL GROUP BY ALL")
def live_attempts(spark, sf):
    return V.all_attempts(_finish(spark, V.live_attempts(_calls(spark, sf)), ["span", "run_id", "task_id", "purpose"]))


@REGISTRY.add("live_repair_limits", f"""
SELECT run_id, task_id, purpose, used, seq FROM (
 SELECT run_id, task_id, purpose, seq, row_number() OVER (PARTITION BY run_id, task_id, purpose ORDER BY epoch_ms(ts), seq) AS used FROM {CALLS} WHERE repair AND task_id IS NOT NULL)
WHERE used = CASE purpose WHEN 'references' THEN {P.REFERENCE_REPAIR_LIMIT} ELSE {P.REPAIR_LIMIT} END""")
def live_repair_limits(spark, sf):
    """Tasks that reach their cap, with the repair that does."""
    calls = _calls(spark, sf).withColumn("repair_epoch", F.lit(0))
    return _finish(spark, V.repair_limits(calls)).select("run_id", "task_id", "purpose", "used", "seq")
