"""The ledger of model calls: projections, usage, requests, matches, budgets, upserts.

Calls have id, run_id, seq (ledger order), revision, state and typed metadata: purpose, task_id, input_hash,
output_hash, attempt, repair, retry_exhausted, connection_id, model_id, effort, agent, prompt_version, error_code,
error_message, validation_state, validation_code, validation_message, started_at, finished_at and usage (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..functions.scan import Running, running


# --- projections and filters ------------------------------------------------


def run_summary(runs: DataFrame, current_version: str) -> DataFrame:
    """The public view of a run: page pair, kind with its default, and whether an older version wrote it."""
    return runs.select(
        "id", "book_id", "revision", "state", F.coalesce("kind", F.lit("conversion")).alias("kind") if "kind" in runs.columns
        else F.lit("conversion").alias("kind"),
        F.array("start_page", "end_page").alias("pages"), "pages_per_task",
        (~F.col("workflow_version").eqNullSafe(F.lit(current_version))).alias("legacy"))


def call_rows(calls: DataFrame, now: float) -> DataFrame:
    """One display row per call, defaults filled in; a call that has not finished is timed against `now`."""
    return calls.select(
        "id", "run_id", "seq", "task_id", "input_hash", F.coalesce("attempt", F.lit(1)).cast("bigint").alias("attempt"),
        F.coalesce("repair", F.lit(False)).alias("repair"), "validation_state", "validation_code", "validation_message",
        F.coalesce("retry_exhausted", F.lit(False)).alias("retry_exhausted"), "state", "purpose",
        F.col("model_id").alias("model"), "effort",
        F.bround(F.coalesce("finished_at", F.lit(now)) - F.coalesce("started_at", F.lit(0.0)), 2).alias("seconds"),
        F.col("error_code").alias("error"), "error_message")


def failure_reason(state: Column, code: Column, message: Column) -> Column:
    effective = F.coalesce(F.nullif(code, F.lit("")), F.when(state == "RESULT_UNKNOWN", "RESULT_UNKNOWN"))
    named = F.create_map(*[F.lit(x) for kv in P.FAILURE_REASONS.items() for x in kv])
    return F.when(F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit("at capacity")), P.CAPACITY_REASON).otherwise(
        F.coalesce(F.try_element_at(named, F.coalesce(effective, F.lit(""))), F.when(state == "FAILED", P.OTHER_FAILURE_REASON).otherwise("")))


def is_retryable(code: Column, flag: Column) -> Column:
    return F.coalesce(code.isin("RATE_LIMITED", "RESULT_UNKNOWN"), F.lit(False)) | F.coalesce(flag, F.lit(False))


def since(calls: DataFrame, days: int, now: float) -> DataFrame:
    """Calls of the last `days` days; 0 keeps all. The comparison is on the bare column, so parquet can skip groups."""
    return calls.filter(F.col("started_at") >= F.lit(now - days * 86400.0 if days else 0.0))


def by_state(rows: DataFrame, stage: str | None, states: list[str]) -> DataFrame:
    kept = rows.filter(F.col("state").isin(states))
    return kept.filter(F.col("stage") == stage) if stage else kept


# --- usage ------------------------------------------------------------------


def usage_ledger(calls: DataFrame) -> DataFrame:
    """Input, output and cached tokens of every call under one set of names; null where nothing was reported."""
    usage = J.normal_usage(F.col("usage"))
    return calls.select("id", "run_id", "seq", "state", F.coalesce("connection_id", F.lit("")).alias("provider"),
                        F.coalesce("model_id", F.lit("")).alias("model"), F.coalesce("purpose", F.lit("")).alias("purpose"),
                        F.coalesce("started_at", F.lit(0.0)).alias("started_at"), usage.alias("u")).select("*", "u.*").drop("u")


def usage_by(ledger: DataFrame, zone: str = "UTC") -> DataFrame:
    """Usage by provider, model, purpose and day, all four views in one pass; an empty name counts as unknown."""
    # Wall-clock arithmetic, so that the session's own zone plays no part.
    clock = F.expr("timestampadd(SECOND, cast(floor(started_at) as bigint), TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    day = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), clock), "yyyy-MM-dd")
    named = ledger.select(
        *[F.when(F.col(c) == "", "unknown").otherwise(F.col(c)).alias(c) for c in ("provider", "model", "purpose")],
        day.alias("day"), "state", "input", "output", "cached")
    views = ["provider", "model", "purpose", "day"]
    sets = named.groupingSets([[F.col(v)] for v in views], *[F.col(v) for v in views]).agg(
        F.count("*").alias("count"), F.count_if(F.col("state") == "FAILED").alias("failed"),
        *[F.sum(c).alias(c) for c in ("input", "output", "cached")],
        *[F.grouping(v).alias("_g_" + v) for v in views])
    dim = F.coalesce(*[F.when(F.col("_g_" + v) == 0, v) for v in views])
    label = F.coalesce(*[F.when(F.col("_g_" + v) == 0, F.col(v)) for v in views])
    return sets.select(dim.alias("dim"), label.alias("label"), "count", "failed", "input", "output", "cached")


def token_totals(calls: DataFrame) -> DataFrame:
    """Token sums per run in the two reported shapes, and how many calls reported any. Missing counts are zero here."""
    u = F.col("usage")
    nested = F.get_json_object(u, "$.tokens.total")
    deep = nested.isNotNull() & (nested != "{}")
    names = J.keys_of(u)
    flat = ~deep & (F.array_contains(names, "input_tokens") | F.array_contains(names, "prompt_tokens"))
    num = lambda path: F.coalesce(F.get_json_object(u, path).try_cast("bigint"), F.lit(0))

    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(u, p).try_cast("bigint") for p in paths], F.lit(0))

    def pick(a: Column, b: Column) -> Column:
        return F.when(F.coalesce(deep, F.lit(False)), a).when(F.coalesce(flat, F.lit(False)), b).otherwise(0)

    total = F.coalesce(F.get_json_object(u, "$.total_tokens").try_cast("bigint"), num("$.input_tokens") + num("$.output_tokens"))
    columns = {
        "input": pick(num("$.tokens.total.inputTokens"), first("$.input_tokens", "$.prompt_tokens")),
        "output": pick(num("$.tokens.total.outputTokens"), first("$.output_tokens", "$.completion_tokens")),
        "reasoning": pick(num("$.tokens.total.reasoningOutputTokens"), num("$.reasoning_tokens")),
        "cached_input": pick(num("$.tokens.total.cachedInputTokens"), num("$.cached_input_tokens")),
        "total": pick(num("$.tokens.total.totalTokens"), total),
    }
    reported = F.coalesce(deep, F.lit(False)) | F.coalesce(flat, F.lit(False))
    return calls.groupBy("run_id").agg(*[F.sum(c).alias(n) for n, c in columns.items()], F.count_if(reported).alias("reported_calls"))


def message_usage(events: DataFrame) -> DataFrame:
    """Usage of an agent's messages per call. Cache reads and writes count as input.

    `events` has call_id, type, role and usage (struct of input, output, cache_read, cache_write, total, reasoning).
    """
    counted = ((F.col("type") == "message_end") & (F.col("role") == "assistant")) | (F.col("type") == "compaction_end")
    n = lambda c: F.coalesce(F.col("usage." + c), F.lit(0))
    return events.filter(counted & F.col("usage").isNotNull()).groupBy("call_id").agg(
        F.sum(n("input") + n("cache_read") + n("cache_write")).alias("input_tokens"), F.sum(n("output")).alias("output_tokens"),
        F.sum(n("total")).alias("total_tokens"), F.sum(n("cache_read")).alias("cached_input_tokens"),
        F.sum("usage.reasoning").alias("reasoning_tokens"))


def counter_deltas(events: DataFrame, keys: list[str], order: str, value: str, block: Column) -> DataFrame:
    """Per-turn growth of a cumulative counter, never below zero; the first row counts from the `baseline` column."""
    seen = running(events, keys, [order], block, [Running("_before", "last", F.col(value), inclusive=False)])
    return seen.withColumn("delta", F.greatest(F.lit(0), F.col(value) - F.coalesce("_before", "baseline", F.lit(0)))).drop("_before")


# --- requests ---------------------------------------------------------------


def request_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("request", F.coalesce("task_id", "input_hash", "id"))


def purpose_counts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "purpose").agg(F.count("*").alias("n"))


def task_states(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("run_id", "state").agg(F.count("*").alias("n"))


def progress(tasks: DataFrame) -> DataFrame:
    done = F.count_if(F.col("state") == "PASSED")
    return tasks.groupBy("run_id").agg(done.alias("done"), F.count("*").alias("total"), (done * 100.0 / F.count("*")).alias("progress"))


def latest_attempt(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Newest row per group, as an aggregate: each map task sends one row per group."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, "r.*")


def last_n(rows: DataFrame, keys: list[str], order: str, n: int = 6) -> DataFrame:
    from pyspark.sql import Window

    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.filter(F.col("_r") <= n).drop("_r")


def group_requests(rows: DataFrame, runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per logical request from its attempts (`call_rows`): counts, derived state and reason.

    Attempts of a request are aggregated, not collected; `request_attempts` lists them. The state ladder is: state of
    the newest call, then retry and validation, then the state of the task, which wins.
    """
    keyed = request_key(rows)
    schema_error = F.coalesce(F.col("error") == "SCHEMA_ERROR", F.lit(False))
    invalid = F.col("validation_code").isNotNull() | schema_error
    failed = F.col("state").isin("FAILED", "RESULT_UNKNOWN") & ~schema_error
    newest = F.struct("id", "task_id", "state", "error", "error_message", "retry_exhausted", "repair", "validation_state")
    problem = F.struct("state", "error", "error_message")
    rejection = F.struct(
        F.coalesce("validation_code", "error").alias("code"),
        F.when(F.col("validation_code").isNotNull(), F.col("validation_message")).otherwise(F.col("error_message")).alias("message"))
    grouped = keyed.groupBy("run_id", "purpose", "request").agg(
        F.max_by(newest, "seq").alias("latest"), F.max("seq").alias("seq"),
        F.count("*").alias("attempt_count"), F.count_if(failed).alias("failed_count"), F.count_if(invalid).alias("validation_failed_count"),
        F.count_if(F.col("repair") & (F.col("attempt") == 1)).alias("repair_count"),
        F.max_by(problem, F.when(failed, F.col("seq"))).alias("failure"), F.max_by(rejection, F.when(invalid, F.col("seq"))).alias("rejection"))
    run_state = runs.select("run_id", ((F.col("state") == "RUNNING") & ~F.coalesce("pause_requested", F.lit(False))).alias("active"))
    task = tasks.select("run_id", F.col("id").alias("_task"), F.col("state").alias("task_state"), "error_code",
                        F.col("error_message").alias("task_message"), "repairing")
    # Exactly what an error record of a task makes true: it exists.
    joined = grouped.join(run_state, "run_id", "left").join(
        task, (grouped["run_id"] == task["run_id"]) & (F.col("latest.task_id") == F.col("_task")), "left").drop(task["run_id"])
    active = F.coalesce("active", F.lit(False))
    state, latest = F.col("latest.state"), F.col("latest")
    running_task = F.coalesce(F.col("task_state") == "RUNNING", F.lit(False))
    review = F.col("error_code").isNotNull()
    base = (
        F.when(state == "COMPLETED", "RETURNED")
        .when(state == "RESERVED", F.when(~active, "RESULT_UNKNOWN").when(F.col("failed_count") > 0, "RETRYING").otherwise("RUNNING"))
        .when(state.isin("FAILED", "RESULT_UNKNOWN"),
              F.when(latest["retry_exhausted"], "RETRY_EXHAUSTED").when(active & running_task, "RETRYING").otherwise(state))
        .otherwise(state))
    rejected = F.coalesce(latest["validation_state"] == "FAILED", F.lit(False)) | F.coalesce(latest["error"] == "SCHEMA_ERROR", F.lit(False))
    checked = F.when(rejected, F.when(active & running_task, "REPAIRING").otherwise("VALIDATION_FAILED")).otherwise(base)
    repairing = active & (F.coalesce("repairing", F.lit(False)) | (latest["repair"] & (state == "RESERVED")))
    settled = F.coalesce(F.col("task_state").isin(P.SETTLED_TASK_STATES), F.lit(False))
    final = (
        F.when(settled, F.when(F.coalesce(F.col("error_code") == "REPAIR_LIMIT", F.lit(False)), "REPAIR_EXHAUSTED").otherwise(F.col("task_state")))
        .when(running_task & repairing, "REPAIRING")
        .when(running_task & (state == "COMPLETED") & (checked == "RETURNED"), "VALIDATING")
        .otherwise(checked))
    recent = F.coalesce(F.col("failure"), F.struct(latest["state"].alias("state"), latest["error"].alias("error"), latest["error_message"].alias("error_message")))
    reviewed = F.create_map(*[F.lit(x) for kv in P.REVIEW_REASONS.items() for x in kv])
    invalid_any = F.col("validation_failed_count") > 0
    named = joined.withColumn("final_state", final).withColumn("_recent", recent)
    reason = (
        F.when(review, F.coalesce(F.try_element_at(reviewed, F.col("final_state")), F.lit(P.OTHER_REVIEW_REASON)))
        .when(invalid_any, P.VALIDATION_REASON)
        .otherwise(failure_reason(F.col("_recent.state"), F.col("_recent.error"), F.col("_recent.error_message"))))
    pick = lambda of_task, of_check, of_call: F.when(review, of_task).when(invalid_any, of_check).otherwise(of_call)
    return named.select(
        "run_id", F.concat_ws(":", "purpose", "request").alias("group_id"), "purpose", F.col("latest.id").alias("latest_id"),
        F.col("latest.task_id").alias("task_id"), "seq", F.col("final_state").alias("state"),
        "attempt_count", "failed_count", "validation_failed_count", "repair_count", reason.alias("reason"),
        pick(F.col("error_code"), F.col("rejection.code"), F.col("_recent.error")).alias("error"),
        pick(F.col("task_message"), F.col("rejection.message"), F.col("_recent.error_message")).alias("error_message"))


def request_attempts(rows: DataFrame) -> DataFrame:
    """Every attempt with the id of its request."""
    return request_key(rows).withColumn("group_id", F.concat_ws(":", "purpose", "request")).drop("request")


def request_states(requests: DataFrame) -> DataFrame:
    return requests.groupBy("run_id", "state").agg(F.count("*").alias("n"))


def page_of(requests: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of rows; Spark keeps offset + limit rows per task, never the whole table."""
    return requests.orderBy(*order).offset(offset).limit(limit)


def newest(objects: DataFrame, n: int = 100, order: str = "seq") -> DataFrame:
    return objects.orderBy(F.desc(order)).limit(n)


def repair_budget(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """Repairs used per task since the run's epoch, and whether the limit is reached. Counter repairs count per run."""
    kept = calls.join(runs.select("run_id", "repair_epoch"), "run_id").filter(
        (F.col("repair_epoch") == 0) | (F.col("revision") >= F.col("repair_epoch"))).filter(F.col("purpose") != "compile_repair")
    counter = F.col("purpose") == "counter_repair"
    used = kept.filter(counter | (F.coalesce("repair", F.lit(False)) & F.col("task_id").isNotNull()))
    limit = F.when(F.col("purpose") == "references", P.REFERENCE_REPAIR_LIMIT).otherwise(P.REPAIR_LIMIT)
    return used.groupBy("run_id", F.when(~counter, F.col("task_id")).alias("task_id"), "purpose").agg(F.count("*").alias("used")).withColumn(
        "exhausted", F.col("used") >= limit)


# --- matches ----------------------------------------------------------------


def match_rejections(calls: DataFrame, feedback: DataFrame, block: Column) -> DataFrame:
    """Each rejection with the latest earlier call of the same (run, task, purpose, output hash).

    `feedback` has run_id, seq, task_id, purpose, output_hash, code and message. Calls and rejections lie in one
    sequence; at one seq a rejection comes before a call, since it answers an earlier one.
    """
    keys = ["run_id", "task_id", "purpose", "output_hash"]
    made = calls.filter(F.col("output_hash").isNotNull()).select(*keys, "seq", F.col("id").alias("_call"), F.lit(1).alias("_kind"),
                                                                F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message"))
    asked = feedback.filter(F.col("output_hash").isNotNull()).select(*keys, "seq", F.lit(None).cast("string").alias("_call"), F.lit(0).alias("_kind"), "code", "message")
    both = made.unionByName(asked).withColumn("_order", F.col("seq") * 2 + F.col("_kind"))
    seen = running(both, keys, ["_order"], block, [Running("call_id", "last", F.col("_call"))])
    return seen.filter((F.col("_kind") == 0) & F.col("call_id").isNotNull()).select(*keys, "seq", "code", "message", "call_id")


def with_rejections(calls: DataFrame, matches: DataFrame) -> DataFrame:
    """Calls with the first rejection recorded for them; what a call already states is kept."""
    first = matches.groupBy(F.col("call_id").alias("id")).agg(F.min_by(F.struct("code", "message"), "seq").alias("_m"))
    joined = calls.join(first, "id", "left")
    return (
        joined.withColumn("validation_code", F.when(F.col("_m").isNotNull() & F.col("validation_code").isNull(), F.col("_m.code")).otherwise(F.col("validation_code")))
        .withColumn("validation_message", F.when(F.col("_m").isNotNull() & F.col("validation_message").isNull(), F.col("_m.message")).otherwise(F.col("validation_message")))
        .withColumn("validation_state", F.when(F.col("_m").isNotNull(), F.coalesce("validation_state", F.lit("FAILED"))).otherwise(F.col("validation_state")))
        .drop("_m"))


def attach_validation(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcome → latest completed call with the same (run, task, output hash). Outcomes without a call are dropped."""
    keys = ["run_id", "task_id", "output_hash"]
    latest = calls.filter(F.col("state") == "COMPLETED").groupBy(*keys).agg(F.max_by("id", "seq").alias("id"))
    return outcomes.join(latest, keys).select(
        "id", F.when(F.col("code").isNotNull(), "FAILED").otherwise("PASSED").alias("validation_state"), "code", "message")


MEMO_KEYS = ["run_id", "input_hash", "model_id", "connection_id", "effort", "prompt_version"]


def memo_lookup(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Each request with the latest completed call that asked the same thing; nulls match nulls."""
    latest = calls.filter(F.col("state") == "COMPLETED").groupBy(*[F.col(k).alias("_" + k) for k in MEMO_KEYS]).agg(
        F.max_by(F.struct(F.col("id").alias("call_id"), "output_hash"), "seq").alias("_r"))
    match = F.col(MEMO_KEYS[0]).eqNullSafe(F.col("_" + MEMO_KEYS[0]))
    for k in MEMO_KEYS[1:]:
        match = match & F.col(k).eqNullSafe(F.col("_" + k))
    return requests.join(latest, match, "left").select(*requests.columns, F.col("_r.call_id").alias("memo_call"), F.col("_r.output_hash").alias("memo_output"))


def blocking_unknowns(calls: DataFrame) -> DataFrame:
    """Open or unknown calls that no completed call of the same input has replaced; a null hash equals a null hash."""
    done = calls.filter(F.col("state") == "COMPLETED").select(F.col("run_id").alias("_run"), F.col("input_hash").alias("_hash")).distinct()
    waiting = calls.filter(
        F.col("state").isin("RESERVED", "RESULT_UNKNOWN") & ~F.coalesce(F.col("agent").isin("codex", "pi"), F.lit(False))
        & ~F.coalesce("retry_exhausted", F.lit(False)))
    return waiting.join(done, (F.col("run_id") == F.col("_run")) & F.col("input_hash").eqNullSafe(F.col("_hash")), "left_anti")


# --- upserts ----------------------------------------------------------------


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace by key: the row with the highest `order` wins, changes before base rows."""
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    others = [c for c in base.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("_side", order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def first_operation(operations: DataFrame, order: str = "seq") -> DataFrame:
    """The first payload of each (run, operation) is the one that happened."""
    others = [c for c in operations.columns if c not in ("run_id", "op_id")]
    return operations.groupBy("run_id", "op_id").agg(F.min_by(F.struct(*others), order).alias("r")).select("run_id", "op_id", "r.*")


def check_revision(commands: DataFrame, runs: DataFrame) -> DataFrame:
    """Commands with NOT_FOUND or STALE_REVISION, or null where they may go ahead."""
    found = runs.select("run_id", F.col("revision").alias("_now"))
    return commands.join(found, "run_id", "left").withColumn(
        "problem", F.when(F.col("_now").isNull(), "NOT_FOUND").when(F.col("revision") != F.col("_now"), "STALE_REVISION")).drop("_now")


def id_conflicts(requests: DataFrame) -> DataFrame:
    """OPERATION_CONFLICT: one request id with different payloads. Two hashes are enough to tell, so min and max do."""
    return requests.groupBy("request_id").agg(F.min("payload_hash").alias("a"), F.max("payload_hash").alias("b"), F.count("*").alias("n")).filter(
        F.col("a") != F.col("b")).select("request_id", "n", F.lit("OPERATION_CONFLICT").alias("code"))


def abandon(calls: DataFrame, commands: DataFrame) -> DataFrame:
    """Open and unknown calls of runs whose retry was authorised become ABANDONED, their old state kept beside."""
    allowed = commands.groupBy("run_id").agg(F.min_by("op_id", "seq").alias("_op"))
    joined = calls.join(allowed, "run_id", "left")
    hit = F.col("_op").isNotNull() & F.col("state").isin("RESERVED", "RESULT_UNKNOWN")
    return (
        joined.withColumn("previous_state", F.when(hit, F.col("state"))).withColumn("retry_operation_id", F.when(hit, F.col("_op")))
        .withColumn("state", F.when(hit, "ABANDONED").otherwise(F.col("state"))).drop("_op"))


def mark_exhausted(calls: DataFrame, inputs: DataFrame) -> DataFrame:
    """Failed and unknown calls of the given (run, input hash) can be retried no more."""
    spent = inputs.select("run_id", "input_hash").distinct().withColumn("_spent", F.lit(True))
    joined = calls.join(spent, ["run_id", "input_hash"], "left")
    hit = F.coalesce("_spent", F.lit(False)) & F.col("state").isin("FAILED", "RESULT_UNKNOWN")
    return joined.withColumn("retry_exhausted", F.coalesce("retry_exhausted", F.lit(False)) | hit).select(*calls.columns)


def reconcile(calls: DataFrame, receipts: DataFrame, schema: str) -> DataFrame:
    """Open calls with a saved answer that parses become COMPLETED and RECOVERED; the rest stay and are UNKNOWN.

    `receipts` has call_id, text, usage and upstream, whether the provider's own receipt was saved too.
    """
    waiting = calls.filter(F.col("state").isin("RESERVED", "RESULT_UNKNOWN") & ~F.coalesce(F.col("agent").isin("codex", "pi"), F.lit(False)))
    found = receipts.select(F.col("call_id").alias("id"), J.parse_result(F.col("text"), schema).alias("_value"), F.col("usage").alias("_usage"), "upstream")
    joined = waiting.join(found, "id", "left")
    ok = F.col("_value").isNotNull()
    return joined.select(
        "id", "run_id", F.when(ok, "COMPLETED").otherwise(F.col("state")).alias("state"),
        F.when(ok, "RECOVERED").otherwise("UNKNOWN").alias("status"),
        F.when(~ok & ~F.coalesce("upstream", F.lit(False)), "NO_UPSTREAM_RECEIPT").alias("reason"),
        F.when(ok, F.sha2(F.to_json("_value"), 256)).alias("output_hash"), F.when(ok, F.col("_usage")).alias("usage"))


def asset_review_state(checks: DataFrame) -> DataFrame:
    """Latest review of each image and whether it is final: decided, failed, or put off too often."""
    latest = latest_attempt(checks, ["run_id", "asset_id"])
    done = F.col("state").isin("PASSED", "FIXED", "FAILED") | ((F.col("state") == "DEFERRED") & (F.coalesce("attempts", F.lit(1)) >= P.IMAGE_ATTEMPT_LIMIT))
    return latest.withColumn("final", F.coalesce(done, F.lit(False)))
