"""Queries on the ledger of calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..operators import ledger as L
from . import corpora as C
from .registry import Registry

REGISTRY = Registry()
CALLS = C.duck(C.CALLS)
RUNS = C.duck(C.RUNS)
TASKS = C.duck(C.TASKS)
NOW = 600000.0


def _calls(spark, sf):
    return C.frame(spark, sf, C.CALLS)


def _runs(spark, sf):
    return C.frame(spark, sf, C.RUNS)


def _tasks(spark, sf):
    return C.frame(spark, sf, C.TASKS)


@REGISTRY.add("run_summaries", f"""
SELECT id, book_id, revision, state, 'conversion' AS kind, start_page || '-' || end_page AS pages, pages_per_task, workflow_version <> '0.7' AS legacy FROM {C.duck(C.BOOK_RUNS)}""")
def run_summaries(spark, sf):
    return L.run_summary(C.frame(spark, sf, C.BOOK_RUNS), "0.7").withColumn("pages", F.array_join("pages", "-"))


ROWS = f"""(SELECT id, run_id, seq, task_id, input_hash, coalesce(attempt, 1) AS attempt, repair, validation_state, validation_code, validation_message, retry_exhausted,
 state, purpose, model_id AS model, effort, round_even(coalesce(finished_at, {NOW}) - started_at, 2) AS seconds, error_code AS error, error_message FROM {CALLS})"""


@REGISTRY.add("call_rows", f"SELECT * FROM {ROWS}")
def call_rows(spark, sf):
    return L.call_rows(_calls(spark, sf), NOW)


_REASON = "CASE WHEN contains(lower(coalesce({m}, '')), 'at capacity') THEN '" + P.CAPACITY_REASON + "' ELSE coalesce(CASE coalesce({c}, CASE WHEN {s} = 'RESULT_UNKNOWN' THEN 'RESULT_UNKNOWN' END) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in P.FAILURE_REASONS.items()) + " END, CASE WHEN {s} = 'FAILED' THEN '" + P.OTHER_FAILURE_REASON + "' ELSE '' END) END"


@REGISTRY.add("failure_reasons", f"""
SELECT id, {_REASON.format(m='error_message', c='error_code', s='state')} AS reason, coalesce(error_code IN ('RATE_LIMITED', 'RESULT_UNKNOWN'), false) OR k % 10 = 0 AS retryable FROM {CALLS}""")
def failure_reasons(spark, sf):
    return _calls(spark, sf).select(
        "id", L.failure_reason(F.col("state"), F.col("error_code"), F.col("error_message")).alias("reason"),
        L.is_retryable(F.col("error_code"), F.col("k") % 10 == 0).alias("retryable"))


@REGISTRY.add("recent_calls", f"SELECT id, run_id, started_at FROM {CALLS} WHERE started_at >= {NOW} - 6 * 86400")
def recent_calls(spark, sf):
    return L.since(_calls(spark, sf), 6, NOW).select("id", "run_id", "started_at")


@REGISTRY.add("tasks_by_state", f"SELECT run_id, id, state FROM {TASKS} WHERE stage = 'seams' AND state IN ('RUNNING', 'PENDING')")
def tasks_by_state(spark, sf):
    return L.by_state(_tasks(spark, sf), "seams", ["RUNNING", "PENDING"]).select("run_id", "id", "state")


# --- usage ---------------------------------------------------------------------------------------------------

_J = lambda path: f"CAST(json_extract(usage, '{path}') AS BIGINT)"
USAGE = f"""(SELECT id, run_id, seq, state, connection_id AS provider, model_id AS model, purpose, started_at,
 coalesce({_J('$.input_tokens')}, {_J('$.prompt_tokens')}, {_J('$.tokens.total.inputTokens')}, {_J('$.promptTokenCount')}) AS input,
 coalesce({_J('$.output_tokens')}, {_J('$.completion_tokens')}, {_J('$.tokens.total.outputTokens')}, {_J('$.candidatesTokenCount')}) AS output,
 CASE WHEN coalesce({_J('$.tokens.total.cachedInputTokens')}, {_J('$.cachedContentTokenCount')}, 0) <> 0 THEN coalesce({_J('$.tokens.total.cachedInputTokens')}, {_J('$.cachedContentTokenCount')})
  ELSE {_J('$.input_tokens_details.cached_tokens')} END AS cached FROM {CALLS})"""


@REGISTRY.add("usage_ledger", f"SELECT * FROM {USAGE}")
def usage_ledger(spark, sf):
    return L.usage_ledger(_calls(spark, sf))


def _usage_view(dim: str, label: str) -> str:
    return f"SELECT '{dim}' AS dim, {label} AS label, count(*) AS count, count(*) FILTER (WHERE state = 'FAILED') AS failed, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cached) AS BIGINT) AS cached FROM {USAGE} GROUP BY ALL"


@REGISTRY.add("usage_by", " UNION ALL ".join([
    _usage_view("provider", "CASE WHEN provider = '' THEN 'unknown' ELSE provider END"), _usage_view("model", "model"), _usage_view("purpose", "purpose"),
    _usage_view("day", "strftime(to_timestamp(started_at) AT TIME ZONE 'UTC', '%Y-%m-%d')")]))
def usage_by(spark, sf):
    return L.usage_by(L.usage_ledger(_calls(spark, sf)))


_DEEP = "json_extract(usage, '$.tokens.total') IS NOT NULL"
_FLAT = "(json_extract(usage, '$.input_tokens') IS NOT NULL OR json_extract(usage, '$.prompt_tokens') IS NOT NULL)"


def _tok(deep: str, *flat: str) -> str:
    paths = ", ".join(f if f.startswith("(") else _J(f) for f in flat)
    return f"CAST(sum(CASE WHEN {_DEEP} THEN coalesce({_J('$.tokens.total.' + deep)}, 0) WHEN {_FLAT} THEN coalesce({paths}, 0) ELSE 0 END) AS BIGINT)"


@REGISTRY.add("token_totals", f"""
SELECT run_id, {_tok('inputTokens', '$.input_tokens', '$.prompt_tokens')} AS input, {_tok('outputTokens', '$.output_tokens', '$.completion_tokens')} AS output,
 {_tok('reasoningOutputTokens', '$.reasoning_tokens')} AS reasoning, {_tok('cachedInputTokens', '$.cached_input_tokens')} AS cached_input,
 {_tok('totalTokens', '$.total_tokens', '(coalesce(' + _J('$.input_tokens') + ', 0) + coalesce(' + _J('$.output_tokens') + ', 0))')} AS total,
 count(*) FILTER (WHERE {_DEEP} OR {_FLAT}) AS reported_calls FROM {CALLS} GROUP BY run_id""")
def token_totals(spark, sf):
    return L.token_totals(_calls(spark, sf))


@REGISTRY.add("message_usage", f"""
SELECT run_id AS call_id, CAST(sum(k + k % 7 + k % 3) AS BIGINT) AS input_tokens, CAST(sum(k % 5) AS BIGINT) AS output_tokens, CAST(sum(2 * k) AS BIGINT) AS total_tokens,
 CAST(sum(k % 7) AS BIGINT) AS cached_input_tokens, CAST(sum(CASE WHEN k % 2 = 0 THEN k END) AS BIGINT) AS reasoning_tokens
FROM {CALLS} WHERE (state = 'COMPLETED' OR state = 'FAILED') GROUP BY run_id""")
def message_usage(spark, sf):
    """Agent messages: completed calls stand for assistant messages, failed ones for compactions."""
    usage = F.struct(
        F.col("k").alias("input"), (F.col("k") % 5).alias("output"), (F.col("k") % 7).alias("cache_read"), (F.col("k") % 3).alias("cache_write"),
        (2 * F.col("k")).alias("total"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("reasoning"))
    kind = F.when(F.col("state") == "FAILED", "compaction_end").otherwise("message_end")
    role = F.when(F.col("state") == "COMPLETED", "assistant").otherwise("user")
    return L.message_usage(_calls(spark, sf).select(F.col("run_id").alias("call_id"), kind.alias("type"), role.alias("role"), usage.alias("usage")))


@REGISTRY.add("counter_deltas", f"""
SELECT run_id, seq, greatest(0, total - coalesce(lag(total) OVER (PARTITION BY run_id ORDER BY seq), 100)) AS delta FROM (SELECT run_id, seq, seq * 3 + k AS total FROM {CALLS})""")
def counter_deltas(spark, sf):
    totals = _calls(spark, sf).select("run_id", "seq", (F.col("seq") * 3 + F.col("k")).alias("total"), F.lit(100).cast("bigint").alias("baseline"))
    found = L.counter_deltas(totals, ["run_id"], "seq", "total", F.floor(F.col("seq") / 65536))
    return found.select("run_id", "seq", "delta")


# --- requests ------------------------------------------------------------------------------------------------

@REGISTRY.add("purpose_counts", f"SELECT run_id, purpose, count(*) AS n FROM {CALLS} GROUP BY ALL")
def purpose_counts(spark, sf):
    return L.purpose_counts(_calls(spark, sf))


@REGISTRY.add("task_states", f"SELECT run_id, state, count(*) AS n FROM {TASKS} GROUP BY ALL")
def task_states(spark, sf):
    return L.task_states(_tasks(spark, sf))


@REGISTRY.add("run_progress", f"SELECT run_id, count(*) FILTER (WHERE state = 'PASSED') AS done, count(*) AS total, count(*) FILTER (WHERE state = 'PASSED') * 100.0::DOUBLE / count(*) AS progress FROM {TASKS} GROUP BY run_id")
def run_progress(spark, sf):
    return L.progress(_tasks(spark, sf)).withColumn("progress", F.col("progress").cast("double"))


GROUPED = f"""(
WITH r AS (SELECT *, coalesce(task_id, input_hash, id) AS request, coalesce(error = 'SCHEMA_ERROR', false) AS schema_error FROM {ROWS}),
f AS (SELECT *, state IN ('FAILED', 'RESULT_UNKNOWN') AND NOT schema_error AS failed, validation_code IS NOT NULL OR schema_error AS invalid FROM r),
g AS (SELECT run_id, purpose, request, max(seq) AS seq, count(*) AS attempt_count, count(*) FILTER (WHERE failed) AS failed_count, count(*) FILTER (WHERE invalid) AS validation_failed_count,
  count(*) FILTER (WHERE repair AND attempt = 1) AS repair_count, max(seq) FILTER (WHERE failed) AS fseq, max(seq) FILTER (WHERE invalid) AS vseq FROM f GROUP BY ALL),
j AS (SELECT g.*, l.id AS latest_id, l.task_id, l.state AS ls, l.error AS le, l.error_message AS lm, l.retry_exhausted AS lx, l.repair AS lr, l.validation_state AS lv,
  coalesce(ff.state, l.state) AS rs, coalesce(ff.error, CASE WHEN ff.seq IS NULL THEN l.error END) AS re, coalesce(ff.error_message, CASE WHEN ff.seq IS NULL THEN l.error_message END) AS rm,
  coalesce(v.validation_code, v.error) AS vc, CASE WHEN v.validation_code IS NOT NULL THEN v.validation_message ELSE v.error_message END AS vm,
  u.state = 'RUNNING' AND NOT u.pause_requested AS active, t.state AS ts, t.error_code AS tc, t.error_message AS tm, coalesce(t.repairing, false) AS tr
 FROM g JOIN f l ON l.seq = g.seq LEFT JOIN f ff ON ff.seq = g.fseq LEFT JOIN f v ON v.seq = g.vseq LEFT JOIN {RUNS} u ON u.run_id = g.run_id
 LEFT JOIN {TASKS} t ON t.run_id = g.run_id AND t.id = l.task_id),
s1 AS (SELECT *, CASE ls WHEN 'COMPLETED' THEN 'RETURNED' WHEN 'RESERVED' THEN CASE WHEN NOT active THEN 'RESULT_UNKNOWN' WHEN failed_count > 0 THEN 'RETRYING' ELSE 'RUNNING' END
  ELSE CASE WHEN lx THEN 'RETRY_EXHAUSTED' WHEN active AND coalesce(ts, '') = 'RUNNING' THEN 'RETRYING' ELSE ls END END AS a FROM j),
s2 AS (SELECT *, CASE WHEN coalesce(lv, '') = 'FAILED' OR coalesce(le, '') = 'SCHEMA_ERROR' THEN CASE WHEN active AND coalesce(ts, '') = 'RUNNING' THEN 'REPAIRING' ELSE 'VALIDATION_FAILED' END ELSE a END AS b FROM s1),
s3 AS (SELECT *, CASE WHEN ts IN ({", ".join(f"'{x}'" for x in P.SETTLED_TASK_STATES)}) THEN CASE WHEN coalesce(tc, '') = 'REPAIR_LIMIT' THEN 'REPAIR_EXHAUSTED' ELSE ts END
  WHEN coalesce(ts, '') = 'RUNNING' AND active AND (tr OR lr AND ls = 'RESERVED') THEN 'REPAIRING'
  WHEN coalesce(ts, '') = 'RUNNING' AND ls = 'COMPLETED' AND b = 'RETURNED' THEN 'VALIDATING' ELSE b END AS state FROM s2)
SELECT run_id, purpose || ':' || request AS group_id, purpose, latest_id, task_id, seq, state, attempt_count, failed_count, validation_failed_count, repair_count,
 CASE WHEN tc IS NOT NULL THEN CASE state {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.REVIEW_REASONS.items())} ELSE '{P.OTHER_REVIEW_REASON}' END
  WHEN validation_failed_count > 0 THEN '{P.VALIDATION_REASON}' ELSE {_REASON.format(m='rm', c='re', s='rs')} END AS reason,
 CASE WHEN tc IS NOT NULL THEN tc WHEN validation_failed_count > 0 THEN vc ELSE re END AS error,
 CASE WHEN tc IS NOT NULL THEN tm WHEN validation_failed_count > 0 THEN vm ELSE rm END AS error_message FROM s3)"""


def _requests(spark, sf):
    return L.group_requests(L.call_rows(_calls(spark, sf), NOW), _runs(spark, sf), _tasks(spark, sf))


@REGISTRY.add("grouped_requests", f"SELECT * FROM {GROUPED}")
def grouped_requests(spark, sf):
    return _requests(spark, sf)


@REGISTRY.add("request_states", f"SELECT run_id, state, count(*) AS n FROM {GROUPED} GROUP BY ALL")
def request_states(spark, sf):
    return L.request_states(_requests(spark, sf))


@REGISTRY.add("request_attempts", f"SELECT id, purpose || ':' || coalesce(task_id, input_hash, id) AS group_id FROM {ROWS}")
def request_attempts(spark, sf):
    return L.request_attempts(L.call_rows(_calls(spark, sf), NOW)).select("id", "group_id")


@REGISTRY.add("requests_page", f"SELECT group_id, run_id, seq, state FROM {GROUPED} ORDER BY seq DESC LIMIT 50 OFFSET 100")
def requests_page(spark, sf):
    return L.page_of(_requests(spark, sf), [F.desc("seq")], 100, 50).select("group_id", "run_id", "seq", "state")


@REGISTRY.add("newest_calls", f"SELECT id, seq FROM {CALLS} ORDER BY seq DESC LIMIT 100")
def newest_calls(spark, sf):
    return L.newest(_calls(spark, sf), 100).select("id", "seq")


@REGISTRY.add("latest_attempts", f"SELECT run_id, purpose, arg_max(id, seq) AS id, arg_max(state, seq) AS state, max(seq) AS seq FROM {CALLS} GROUP BY ALL")
def latest_attempts(spark, sf):
    return L.latest_attempt(_calls(spark, sf).select("run_id", "purpose", "id", "state", "seq"), ["run_id", "purpose"])


@REGISTRY.add("last_six_calls", f"SELECT run_id, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM {CALLS}) WHERE r <= 6")
def last_six_calls(spark, sf):
    return L.last_n(_calls(spark, sf).select("run_id", "id", "seq"), ["run_id"], "seq")


@REGISTRY.add("repair_budget", f"""
SELECT c.run_id, CASE WHEN purpose <> 'counter_repair' THEN task_id END AS task_id, purpose, count(*) AS used, count(*) >= CASE purpose WHEN 'references' THEN 6 ELSE 8 END AS exhausted
FROM {CALLS} c JOIN {RUNS} r ON r.run_id = c.run_id WHERE revision >= repair_epoch AND (purpose = 'counter_repair' OR repair AND task_id IS NOT NULL) GROUP BY 1, 2, 3""")
def repair_budget(spark, sf):
    return L.repair_budget(_calls(spark, sf), _runs(spark, sf))


# --- matches -------------------------------------------------------------------------------------------------

_FEEDBACK = f"""
SELECT run_id, seq, task_id, purpose, concat('out', CAST(k % 8 AS STRING)) AS output_hash, 'REJECTED' AS code, concat('note ', CAST(seq AS STRING)) AS message FROM ({C.CALLS}) c WHERE repair
"""
MATCHED = f"""(SELECT f.run_id, f.task_id, f.purpose, f.output_hash, f.seq, f.code, f.message, c.id AS call_id FROM {C.duck(_FEEDBACK)} f JOIN LATERAL (
 SELECT id FROM {CALLS} c WHERE c.run_id = f.run_id AND c.task_id IS NOT DISTINCT FROM f.task_id AND c.purpose = f.purpose AND c.output_hash = f.output_hash AND c.seq < f.seq ORDER BY c.seq DESC LIMIT 1) c ON true)"""


@REGISTRY.add("matched_rejections", f"SELECT * FROM {MATCHED}")
def matched_rejections(spark, sf):
    return L.match_rejections(_calls(spark, sf), C.frame(spark, sf, _FEEDBACK), F.floor(F.col("_order") / 131072))


@REGISTRY.add("calls_with_rejections", f"""
SELECT c.id, coalesce(c.validation_state, CASE WHEN m.call_id IS NOT NULL THEN 'FAILED' END) AS validation_state, coalesce(c.validation_code, m.code) AS validation_code, coalesce(c.validation_message, m.message) AS validation_message
FROM {CALLS} c LEFT JOIN (SELECT call_id, arg_min(code, seq) AS code, arg_min(message, seq) AS message FROM {MATCHED} GROUP BY ALL) m ON m.call_id = c.id""")
def calls_with_rejections(spark, sf):
    calls = _calls(spark, sf)
    matches = L.match_rejections(calls, C.frame(spark, sf, _FEEDBACK), F.floor(F.col("_order") / 131072))
    return L.with_rejections(calls, matches).select("id", "validation_state", "validation_code", "validation_message")


_OUTCOMES = "SELECT DISTINCT concat('r', CAST(CAST(floor(user_id / 6) AS BIGINT) AS STRING)) AS run_id, concat('t', CAST(user_id AS STRING)) AS task_id, concat('out', CAST(user_id % 8 AS STRING)) AS output_hash, CASE WHEN user_id % 2 = 0 THEN 'UNRESOLVED_REFERENCE' END AS code, CAST(NULL AS STRING) AS message FROM @events"


@REGISTRY.add("attached_validations", f"""
SELECT c.id, CASE WHEN o.code IS NULL THEN 'PASSED' ELSE 'FAILED' END AS validation_state, o.code FROM {C.duck(_OUTCOMES)} o
JOIN (SELECT run_id, task_id, output_hash, arg_max(id, seq) AS id FROM {CALLS} WHERE state = 'COMPLETED' GROUP BY ALL) c ON c.run_id = o.run_id AND c.task_id = o.task_id AND c.output_hash = o.output_hash""")
def attached_validations(spark, sf):
    return L.attach_validation(_calls(spark, sf), C.frame(spark, sf, _OUTCOMES)).select("id", "validation_state", "code")


@REGISTRY.add("memo_lookups", f"""
SELECT r.id, c.id AS memo_call, c.output_hash AS memo_output FROM {CALLS} r LEFT JOIN (
 SELECT run_id, input_hash, model_id, connection_id, effort, arg_max(id, seq) AS id, arg_max(output_hash, seq) AS output_hash FROM {CALLS} WHERE state = 'COMPLETED' GROUP BY ALL) c
 ON c.run_id = r.run_id AND c.input_hash IS NOT DISTINCT FROM r.input_hash AND c.model_id = r.model_id AND c.connection_id = r.connection_id AND c.effort = r.effort WHERE r.state <> 'COMPLETED'""")
def memo_lookups(spark, sf):
    calls = _calls(spark, sf)
    return L.memo_lookup(calls.filter("state <> 'COMPLETED'").select("id", *L.MEMO_KEYS), calls).select("id", "memo_call", "memo_output")


@REGISTRY.add("blocking_unknowns", f"""
SELECT id, run_id, input_hash FROM {CALLS} c WHERE state IN ('RESERVED', 'RESULT_UNKNOWN') AND agent IS NULL AND NOT retry_exhausted
 AND NOT EXISTS (SELECT 1 FROM {CALLS} d WHERE d.run_id = c.run_id AND d.state = 'COMPLETED' AND d.input_hash IS NOT DISTINCT FROM c.input_hash)""")
def blocking_unknowns(spark, sf):
    return L.blocking_unknowns(_calls(spark, sf)).select("id", "run_id", "input_hash")


# --- upserts -------------------------------------------------------------------------------------------------

@REGISTRY.add("upserted_tasks", f"""
WITH c AS (SELECT run_id, task_id AS id, arg_max(state, seq) AS state, max(seq) AS seq FROM {CALLS} WHERE task_id IS NOT NULL AND k % 5 = 0 GROUP BY ALL)
SELECT coalesce(c.run_id, t.run_id) AS run_id, coalesce(c.id, t.id) AS id, CASE WHEN c.id IS NULL THEN t.state ELSE c.state END AS state FROM {TASKS} t FULL JOIN c ON c.run_id = t.run_id AND c.id = t.id""")
def upserted_tasks(spark, sf):
    base = _tasks(spark, sf).select("run_id", "id", "state", F.lit(-1).cast("bigint").alias("seq"))
    changes = _calls(spark, sf).filter("task_id IS NOT NULL AND k % 5 = 0").select("run_id", F.col("task_id").alias("id"), "state", "seq")
    return L.upsert(base, changes, ["run_id", "id"], "seq").select("run_id", "id", "state")


@REGISTRY.add("first_operations", f"SELECT run_id, input_hash AS op_id, arg_min(id, seq) AS payload FROM {CALLS} WHERE input_hash IS NOT NULL GROUP BY ALL")
def first_operations(spark, sf):
    ops = _calls(spark, sf).filter("input_hash IS NOT NULL").select("run_id", F.col("input_hash").alias("op_id"), F.col("id").alias("payload"), "seq")
    return L.first_operation(ops).select("run_id", "op_id", "payload")


@REGISTRY.add("revision_checks", f"""
SELECT c.id, CASE WHEN r.run_id IS NULL THEN 'NOT_FOUND' WHEN c.revision <> 2 THEN 'STALE_REVISION' END AS problem FROM {CALLS} c LEFT JOIN (SELECT * FROM {RUNS} WHERE state = 'RUNNING') r ON r.run_id = c.run_id""")
def revision_checks(spark, sf):
    runs = _runs(spark, sf).filter("state = 'RUNNING'").select("run_id", F.col("repair_epoch").alias("revision"))
    return L.check_revision(_calls(spark, sf).select("id", "run_id", "revision"), runs).select("id", "problem")


@REGISTRY.add("operation_conflicts", f"SELECT run_id || '/' || input_hash AS request_id, count(*) AS n, 'OPERATION_CONFLICT' AS code FROM {CALLS} WHERE input_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model_id) > 1")
def operation_conflicts(spark, sf):
    rows = _calls(spark, sf).filter("input_hash IS NOT NULL").select(F.concat_ws("/", "run_id", "input_hash").alias("request_id"), F.col("model_id").alias("payload_hash"))
    return L.id_conflicts(rows)


@REGISTRY.add("abandoned_calls", f"""
SELECT c.id, CASE WHEN r.run_id IS NOT NULL AND c.state IN ('RESERVED', 'RESULT_UNKNOWN') THEN 'ABANDONED' ELSE c.state END AS state,
 CASE WHEN r.run_id IS NOT NULL AND c.state IN ('RESERVED', 'RESULT_UNKNOWN') THEN c.state END AS previous_state FROM {CALLS} c LEFT JOIN (SELECT run_id FROM {RUNS} WHERE state = 'PAUSED') r ON r.run_id = c.run_id""")
def abandoned_calls(spark, sf):
    commands = _runs(spark, sf).filter("state = 'PAUSED'").select("run_id", F.concat(F.lit("op-"), "run_id").alias("op_id"), F.lit(1).alias("seq"))
    return L.abandon(_calls(spark, sf), commands).select("id", "state", "previous_state")


@REGISTRY.add("exhausted_calls", f"""
SELECT id, retry_exhausted OR state IN ('FAILED', 'RESULT_UNKNOWN') AND EXISTS (SELECT 1 FROM {CALLS} x WHERE x.run_id = c.run_id AND x.input_hash = c.input_hash AND x.retry_exhausted) AS retry_exhausted FROM {CALLS} c""")
def exhausted_calls(spark, sf):
    calls = _calls(spark, sf)
    return L.mark_exhausted(calls, calls.filter("retry_exhausted")).select("id", "retry_exhausted")


_OBJECT = "concat(chr(123), {}, chr(125))"
_N = "'\"n\": ', CAST(k AS STRING), '{}'"
_ANSWER = f"""CASE k % 7 WHEN 0 THEN concat('```json', chr(10), {_OBJECT.format(_N.format(', "ok": true'))}, chr(10), '```')
 WHEN 1 THEN {_OBJECT.format(_N.format(', "ok": false'))} WHEN 2 THEN {_OBJECT.format("'\"n\": 1, \"ok\": true, \"x\": 2'")}
 WHEN 3 THEN 'no json' WHEN 4 THEN {_OBJECT.format("'\"n\": \"abc\", \"ok\": 1'")} WHEN 5 THEN {_OBJECT.format("'\"n\": null, \"ok\": true'")}
 ELSE {_OBJECT.format("'\"n\": 1.5, \"k\": true'")} END"""
_RECEIPTS = f"SELECT id AS call_id, seq, k, {_ANSWER} AS text, usage, k % 8 = 7 AS upstream FROM ({C.CALLS}) c WHERE k % 3 <> 2"


@REGISTRY.add("reconciled_calls", f"""
SELECT c.id, CASE WHEN good THEN 'COMPLETED' ELSE state END AS state, CASE WHEN good THEN 'RECOVERED' ELSE 'UNKNOWN' END AS status,
 CASE WHEN NOT good AND NOT coalesce(upstream, false) THEN 'NO_UPSTREAM_RECEIPT' END AS reason
FROM (SELECT c.*, coalesce(r.k % 7 IN (0, 1), false) AS good, r.upstream FROM {CALLS} c LEFT JOIN {C.duck(_RECEIPTS)} r ON r.call_id = c.id) c
WHERE state IN ('RESERVED', 'RESULT_UNKNOWN') AND agent IS NULL""")
def reconciled_calls(spark, sf):
    found = L.reconcile(_calls(spark, sf), C.frame(spark, sf, _RECEIPTS), "n bigint, ok boolean")
    return found.select("id", "state", "status", "reason")


@REGISTRY.add("parsed_results", f"""
SELECT call_id, CASE WHEN k % 7 IN (0, 1) THEN k END AS n, CASE WHEN k % 7 IN (0, 1) THEN k % 7 = 0 END AS ok,
 CASE k % 7 WHEN 2 THEN 'extra_forbidden /x additionalProperties' WHEN 3 THEN 'JSON_SYNTAX  json' WHEN 4 THEN 'type /n integer;type /ok boolean'
  WHEN 5 THEN 'type /n integer' WHEN 6 THEN 'missing /ok required;extra_forbidden /k additionalProperties;type /n integer' ELSE '' END AS problems FROM {C.duck(_RECEIPTS)}""")
def parsed_results(spark, sf):
    rows = C.frame(spark, sf, _RECEIPTS)
    value = J.parse_result(F.col("text"), "n bigint, ok boolean")
    problems = F.transform(J.schema_problems(F.col("text"), "n bigint, ok boolean"), lambda p: F.concat_ws(" ", p["code"], p["path"], p["rule"]))
    return rows.select("call_id", value["n"].alias("n"), value["ok"].alias("ok"), F.array_join(problems, ";").alias("problems"))


@REGISTRY.add("asset_reviews", f"""
WITH l AS (SELECT run_id, purpose AS asset_id, arg_max(s, seq) AS state, arg_max(a, seq) AS attempts, max(seq) AS seq FROM (
 SELECT *, CASE k % 4 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'DEFERRED' WHEN 2 THEN 'RUNNING' ELSE 'DEFERRED' END AS s, attempt AS a FROM {CALLS}) GROUP BY ALL)
SELECT run_id, asset_id, state, state = 'PASSED' OR state = 'DEFERRED' AND coalesce(attempts, 1) >= 3 AS final FROM (
 SELECT c.run_id, c.purpose AS asset_id, CASE k % 4 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'DEFERRED' WHEN 2 THEN 'RUNNING' ELSE 'DEFERRED' END AS state, attempt AS attempts
 FROM {CALLS} c JOIN l ON l.seq = c.seq)""")
def asset_reviews(spark, sf):
    state = F.when(F.col("k") % 4 == 0, "PASSED").when(F.col("k") % 4 == 2, "RUNNING").otherwise("DEFERRED")
    checks = _calls(spark, sf).select("run_id", F.col("purpose").alias("asset_id"), "seq", state.alias("state"), F.col("attempt").alias("attempts"))
    return L.asset_review_state(checks).select("run_id", "asset_id", "state", "final")


# --- JSON ----------------------------------------------------------------------------------------------------

_Q = "chr(34)"


def _obj(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


_PROVIDER = """
SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'gemini' WHEN 2 THEN 'chat_completions' ELSE 'responses' END AS protocol,
 doc_id % 7 <> 0 AS done, concat(lang, ' ', source) AS answer FROM @documents
"""


def _response(spark, sf):
    rows = C.frame(spark, sf, _PROVIDER)
    half = F.concat("answer", F.lit("+"))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    js = lambda s: F.to_json(s)
    n = F.col("doc_id")
    claude = js(F.struct(F.when(F.col("done"), "end_turn").otherwise("max_tokens").alias("stop_reason"),
                         F.array(part("text", half), part("thinking", F.lit("x")), part("text", F.col("answer"))).alias("content"), F.struct(n.alias("input_tokens")).alias("usage")))
    gemini = js(F.struct(F.array(F.struct(F.when(F.col("done"), "STOP").otherwise("MAX").alias("finishReason"), F.struct(F.array(
        F.struct(F.lit("no").alias("text"), F.lit(True).alias("thought")), F.struct(half.alias("text"), F.lit(False).alias("thought")),
        F.struct(F.col("answer").alias("text"), F.lit(False).alias("thought"))).alias("parts")).alias("content"))).alias("candidates"), F.struct(n.alias("promptTokenCount")).alias("usageMetadata")))
    chat = js(F.struct(F.array(F.struct(F.when(F.col("done"), "stop").otherwise("length").alias("finish_reason"), F.struct(F.concat(half, "answer").alias("content")).alias("message"))).alias("choices"),
                       F.struct(n.alias("prompt_tokens")).alias("usage")))
    output = F.array(
        F.struct(F.lit("reasoning").alias("type"), F.array(part("output_text", F.lit("no"))).alias("content")),
        F.struct(F.lit("message").alias("type"), F.array(part("output_text", half), part("refusal", F.lit("no")), part("output_text", F.col("answer"))).alias("content")))
    responses = js(F.struct(F.when(F.col("done"), "completed").otherwise("incomplete").alias("status"), output.alias("output"), F.struct(n.alias("input_tokens")).alias("usage")))
    p = F.col("protocol")
    return rows.withColumn("response", F.when(p == "anthropic", claude).when(p == "gemini", gemini).when(p == "chat_completions", chat).otherwise(responses))


@REGISTRY.add("answer_texts", f"""
SELECT doc_id, CASE WHEN done THEN answer || '+' || answer END AS text, CASE WHEN NOT done THEN 'TRUNCATED' END AS problem,
 CASE WHEN done THEN '{{"' || CASE protocol WHEN 'gemini' THEN 'promptTokenCount' WHEN 'chat_completions' THEN 'prompt_tokens' ELSE 'input_tokens' END || '":' || doc_id || '}}' END AS usage FROM {C.duck(_PROVIDER)}""")
def answer_texts(spark, sf):
    """Answer text of every provider's response shape."""
    return _response(spark, sf).select("doc_id", J.result_text(F.col("protocol"), F.col("response")).alias("r")).select("doc_id", "r.*")


@REGISTRY.add("previews", """
SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '… [truncated]' ELSE text END AS preview,
 '/' || replace(replace(source || '/a~b', '~', '~0'), '/', '~1') || '/' || lang AS pointer FROM documents""")
def previews(spark, sf):
    return C.load(spark, sf, "documents").select(
        "doc_id", J.preview(F.col("text")).alias("preview"), J.pointer(F.array(F.concat("source", F.lit("/a~b")), F.col("lang"))).alias("pointer"))


@REGISTRY.add("row_digests", """
SELECT doc_id, sha256('{"doc":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') AS digest FROM documents""")
def row_digests(spark, sf):
    return C.load(spark, sf, "documents").select("doc_id", J.digest(source=F.col("source"), lang=F.col("lang"), doc=F.col("doc_id")).alias("digest"))
