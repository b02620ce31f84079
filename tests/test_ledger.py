import json

from pyspark.sql import functions as F

from folio.functions import jsonx as J
from folio.functions import patterns as P
from folio.operators import ledger as L
from folio.operators import library as LB
from folio.operators import snapshots as S

CALL = (
    "id string, run_id string, seq bigint, revision bigint, state string, purpose string, task_id string, input_hash string, output_hash string, attempt bigint, "
    "repair boolean, retry_exhausted boolean, connection_id string, model_id string, effort string, agent string, prompt_version string, error_code string, "
    "error_message string, validation_state string, validation_code string, validation_message string, started_at double, finished_at double, usage string"
)


def calls(spark, *rows):
    names = [f.split()[0] for f in CALL.split(", ")]
    base = {"run_id": "r", "purpose": "convert", "revision": 1}
    data = [tuple({**base, "id": f"c{n}", "seq": n, **row}.get(k) for k in names) for n, row in enumerate(rows, 1)]
    return spark.createDataFrame(data, CALL)


def grouped(spark, ledger, run_state, task):
    runs = spark.createDataFrame([("r", run_state, False)], "run_id string, state string, pause_requested boolean")
    tasks = spark.createDataFrame(task, "run_id string, id string, state string, error_code string, error_message string, repairing boolean")
    return L.group_requests(L.call_rows(ledger, 100.0), runs, tasks).orderBy("task_id").collect()


def test_exhausted_attempts_collapse_per_batch(spark):
    rows = [{"task_id": f"batch-{b}", "state": "FAILED", "attempt": a, "error_code": "RATE_LIMITED", "error_message": "429: slow down", "retry_exhausted": True} for b in (1, 2) for a in range(1, 6)]
    got = grouped(spark, calls(spark, *rows), "PENDING", [("r", "batch-1", "PENDING", None, None, False), ("r", "batch-2", "PENDING", None, None, False)])
    assert [(r.state, r.attempt_count, r.failed_count, r.error_message) for r in got] == [("RETRY_EXHAUSTED", 5, 5, "429: slow down")] * 2
    assert "429" in got[0].reason


def test_retry_then_recovery(spark):
    task = [("r", "b", "RUNNING", None, None, False)]
    failed = {"task_id": "b", "state": "FAILED", "error_code": "REQUEST_FAILED", "error_message": "Selected model is at capacity."}
    assert grouped(spark, calls(spark, failed), "RUNNING", task)[0].state == "RETRYING"
    row = grouped(spark, calls(spark, failed, {"task_id": "b", "state": "RESERVED", "attempt": 2}), "RUNNING", task)[0]
    assert row.state == "RETRYING" and row.reason == P.CAPACITY_REASON
    done = calls(spark, failed, {"task_id": "b", "state": "COMPLETED", "attempt": 2, "usage": json.dumps({"prompt_tokens": 11, "completion_tokens": 7, "total_tokens": 18})})
    row = grouped(spark, done, "RUNNING", task)[0]
    assert (row.state, row.attempt_count, row.failed_count) == ("VALIDATING", 2, 1) and "at capacity" in row.error_message
    totals = L.token_totals(done).first()
    assert (totals.total, totals.reported_calls) == (18, 1)


def test_usage_of_every_provider(spark):
    usages = [
        {"tokens": {"total": {"inputTokens": 5, "outputTokens": 2, "cachedInputTokens": 1}}}, {"input_tokens": 3, "output_tokens": 4, "input_tokens_details": {"cached_tokens": 2}},
        {"promptTokenCount": 7, "candidatesTokenCount": 1, "cachedContentTokenCount": 0}, {"input_tokens": "many", "prompt_tokens": 9}, {}, None, [1],
    ]
    ledger = L.usage_ledger(calls(spark, *[{"state": "COMPLETED", "usage": None if u is None else json.dumps(u)} for u in usages]))
    got = [(r.input, r.output, r.cached) for r in ledger.orderBy("seq").collect()]
    assert got == [(5, 2, 1), (3, 4, 2), (7, 1, None), (9, None, None), (None, None, None), (None, None, None), (None, None, None)]
    views = L.usage_by(ledger).filter("dim = 'provider'").first()
    assert (views.label, views["count"], views.input) == ("unknown", 7, 24)
    nothing = L.usage_by(ledger.filter("input IS NULL")).filter("dim = 'provider'").first()
    assert nothing.input is None


def test_rejections_find_the_latest_earlier_call(spark):
    rows = [{"state": "COMPLETED", "task_id": None, "output_hash": "o"}, {"state": "COMPLETED", "output_hash": "o"}, {"state": "FAILED"}, {"state": "COMPLETED", "output_hash": "o"}]
    feedback = spark.createDataFrame([("r", 3, None, "convert", "o", "X", "m"), ("r", 1, None, "convert", "o", "X", "m")],
                                     "run_id string, seq bigint, task_id string, purpose string, output_hash string, code string, message string")
    found = L.match_rejections(calls(spark, *rows), feedback, F.floor(F.col("_order") / 2))
    assert [(r.seq, r.call_id) for r in found.collect()] == [(3, "c2")]
    marked = {r.id: r.validation_code for r in L.with_rejections(calls(spark, *rows), found).collect()}
    assert marked == {"c1": None, "c2": "X", "c3": None, "c4": None}


def test_answers_parse_by_single_block_then_whole_text(spark):
    schema = "n bigint, name string"
    good, bad = '{"n": 1, "name": "x"}', '{"n": 1}'
    texts = [good, f"Here:\n```json\n{good}\n```\nBye", f"```\n{good}\n```\n```\n{good}\n```", bad, '{"n": 1, "name": "x", "extra": 0}', "plain", f"```json\n{bad}\n```"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "i int, t string")
    got = [r.v is not None for r in df.select("i", J.parse_result(F.col("t"), schema).alias("v")).orderBy("i").collect()]
    assert got == [True, True, False, False, False, False, False]


def test_open_receipts_reconcile(spark):
    ledger = calls(spark, {"state": "RESERVED"}, {"state": "RESULT_UNKNOWN"}, {"state": "RESERVED", "agent": "codex"}, {"state": "COMPLETED"})
    receipts = spark.createDataFrame([("c1", '{"n": 4}', "{}", False)], "call_id string, text string, usage string, upstream boolean")
    got = {r.id: (r.state, r.status, r.reason) for r in L.reconcile(ledger, receipts, "n bigint").collect()}
    assert got == {"c1": ("COMPLETED", "RECOVERED", None), "c2": ("RESULT_UNKNOWN", "UNKNOWN", "NO_UPSTREAM_RECEIPT")}


def test_null_inputs_match_each_other(spark):
    ledger = calls(spark, {"state": "RESERVED"}, {"state": "COMPLETED"}, {"state": "RESERVED", "input_hash": "a"})
    assert [r.id for r in L.blocking_unknowns(ledger).collect()] == ["c3"]
    memo = L.memo_lookup(ledger.filter("id = 'c1'").select("id", *L.MEMO_KEYS), ledger).first()
    assert memo.memo_call == "c2"


def test_set_digest_ignores_order_and_sees_changes(spark):
    rows = [("p", "a", "1"), ("p", "b", "2")]
    frame = lambda r: spark.createDataFrame(r, "project_id string, path string, sha256 string")
    one, two = S.content_hash(frame(rows)).first(), S.content_hash(frame(rows[::-1])).first()
    assert one.content_hash == two.content_hash
    assert S.content_hash(frame([("p", "a", "2"), ("p", "b", "1")])).first().content_hash != one.content_hash


def test_provenance_stops_at_assets_ends_and_cycles(spark):
    runs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x"), ("n", None)], "run_id string, source_run_id string")
    assets = spark.createDataFrame([("c",), ("c",)], "run_id string")
    got = {r.run_id: (r.source_run, r.depth) for r in LB.provenance(runs, assets).collect()}
    assert got == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0), "x": (None, None), "y": (None, None), "n": (None, None)}


def test_titles_sort_by_number(spark):
    books = spark.createDataFrame([(1, "Book 10", 5), (2, "Book 9", 7), (3, "book 1", 7)], "id int, title string, page_count int")
    assert [r.id for r in LB.sort_library(books, "title").collect()] == [3, 2, 1]
    assert [r.id for r in LB.sort_library(books, "pages").collect()] == [3, 2, 1]


def test_provenance_of_a_very_long_chain(spark):
    n = 10_000
    runs = spark.range(n).select(F.col("id").alias("run_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("source_run_id"))
    rings = spark.createDataFrame([(n, n + 1), (n + 1, n + 2), (n + 2, n), (n + 3, n + 1), (n + 4, 999_999)], "run_id bigint, source_run_id bigint")
    assets = spark.createDataFrame([(0,), (7_000,)], "run_id bigint")
    got = {r.run_id: (r.source_run, r.depth) for r in LB.provenance(runs.union(rings), assets).collect()}
    assert len(got) == n + 5 and all(got[n + i] == (None, None) for i in range(5))
    assert all(got[i] == ((0, i) if i < 7_000 else (7_000, i - 7_000)) for i in range(n))


def test_digit_runs_of_any_length_sort_by_value(spark):
    titles = ["Vol 10", "Vol 9", "Vol 0010", "Vol 1" + "0" * 30, "Vol 1" + "0" * 30 + "1", "Vol 2" + "0" * 29, "安", "李", "张"]
    books = spark.createDataFrame([(i, t, 1) for i, t in enumerate(titles)], "id bigint, title string, page_count bigint")
    order = [r.title for r in LB.sort_library(books, "title").collect()]
    latin = [t for t in order if t.startswith("Vol")]
    assert latin == ["Vol 9", "Vol 10", "Vol 0010", "Vol 2" + "0" * 29, "Vol 1" + "0" * 30, "Vol 1" + "0" * 30 + "1"]
    assert [t for t in order if not t.startswith("Vol")] == ["安", "李", "张"]


def test_answers_are_checked_at_every_depth(spark):
    schema = "title string, `a/b~c` array<bigint>, box struct<x: double, tags: array<string>>"
    good = {"title": "t", "a/b~c": [1, 2], "box": {"x": 1, "tags": []}}
    cases = [
        (good, []),
        (good | {"a/b~c": [1, "wrong"], "extra": True}, [("extra_forbidden", "/extra"), ("type", "/a~1b~0c/1")]),
        ({"title": 1, "a/b~c": {}, "box": {"x": "1", "tags": ["a", None]}}, [("type", "/title"), ("type", "/a~1b~0c"), ("type", "/box/x"), ("type", "/box/tags/1")]),
        ({"title": None, "box": {"tags": [], "y": 2, "x": 0.5}}, [("missing", "/a~1b~0c"), ("type", "/title"), ("extra_forbidden", "/box/y")]),
        ([1], [("type", "")]), (3, [("type", "")]), (None, [("type", "")]),
    ]
    rows = [(i, json.dumps(v)) for i, (v, _) in enumerate(cases)] + [(len(cases), "{"), (len(cases) + 1, "")]
    table = spark.createDataFrame(rows, "i int, t string")
    got = table.select("i", J.schema_problems(F.col("t"), schema).alias("p"), J.parse_result(F.col("t"), schema).alias("v")).orderBy("i").collect()
    for row, want in zip(got, [w for _, w in cases] + [[("JSON_SYNTAX", "")]] * 2):
        assert [(p.code, p.path) for p in row.p] == want and (row.v is not None) == (want == [])
    assert got[1].p[1].rule == "integer" and got[1].p[1].actual == '"wrong"'
