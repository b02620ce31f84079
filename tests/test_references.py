import random
from difflib import get_close_matches

from pyspark.sql import functions as F

from folio.functions import similarity as SIM
from folio.operators import edits as ED
from folio.operators import references as R
from folio.operators import rules as Q
from folio.operators import search as SE


def symbol_frame(spark, rows):
    """rows of (book, page, id, category, key)."""
    df = spark.createDataFrame(rows, "book_id bigint, page bigint, id string, category string, key string")
    return df.withColumn("kind", F.substring_index("key", ":", 1)).withColumn("number", F.get(F.split("key", ":"), F.lit(1))).withColumn(
        "namespace", F.substring_index("key", ":", 2)).withColumn("command", F.when(F.col("category") == "label", "label").otherwise("ref")).withColumn(
        "start", F.lit(0)).withColumn("end", F.lit(1))


def test_near_keys_equal_brute_force(spark, monkeypatch):
    # Small chunks make several of them meet.
    monkeypatch.setattr(SIM, "CHUNK", 4)
    rng = random.Random(1)
    kinds = ["theorem", "lemma", "claim", "equation", "exercise", "problem"]
    key = lambda: f"{rng.choice(kinds)}:{rng.randint(1, 3)}.{rng.randint(1, 30)}" + rng.choice(["", "", ":appendix", ":sec" + str(rng.randint(1, 9))])
    rows = [(1, n, f"l{n}", "label", key()) for n in range(90)] + [(1, n, f"r{n}", "reference", key()) for n in range(60)]
    got = {}
    for r in R.near_keys(symbol_frame(spark, rows)).orderBy("rank").collect():
        got.setdefault(r.key, []).append(r.near_key)
    family = lambda k: {"exercise": "exercise", "problem": "exercise", "equation": "equation"}.get(k.split(":")[0], "statement")
    labels = {r[4] for r in rows if r[3] == "label"}
    for k in {r[4] for r in rows if r[3] == "reference"} - labels:
        want = get_close_matches(k, sorted(x for x in labels if family(x) == family(k)), n=5, cutoff=0.6)
        assert got.get(k, []) == want


def test_near_keys_of_a_large_family_are_few_pairs(spark, monkeypatch):
    """Scored pairs grow with the keys, not with their square, and nothing is left for the chunks."""
    left, scored = [], []
    chunks = SIM.near_keys_in_chunks
    monkeypatch.setattr(SIM, "near_keys_in_chunks", lambda rest, *more: left.append(rest.count()) or chunks(rest, *more))
    for size in (20, 40):
        labels = [f"theorem:{a}.{b}" for a in range(10, 10 + size) for b in range(10, 10 + 2 * size, 2)]
        asked = [f"theorem:{a}.{b}" for a in range(10, 10 + size) for b in (13, 25)]
        frame = lambda keys: spark.createDataFrame([(1, "statement", k) for k in keys], "book_id int, family string, key string")
        got = {}
        for r in SIM.near_keys_by_deletions(frame(asked), frame(labels), 5, 0.6).orderBy("rank").collect():
            got.setdefault(r.key, []).append(r.near_key)
        for k in asked[::9]:
            assert got[k] == get_close_matches(k, labels, n=5, cutoff=0.6)
        assert left[-1] == 0
        pairs = SIM._neighbourhood(frame(asked), "_w").join(SIM._neighbourhood(frame(labels), "_o").withColumnRenamed("key", "near_key"), ["book_id", "family", "_left"]).filter("_w + _o <= 2")
        scored.append(pairs.select("key", "near_key").distinct().count() / len(asked))
    assert scored[1] < 1.5 * scored[0] + 1 < 40


def test_groups_share_a_namespace_and_evidence_stays_read_only(spark):
    rows = [(1, 1, "a", "label", "lemma:1:x"), (1, 2, "b", "label", "lemma:1:x"), (1, 3, "c", "label", "lemma:1:y"), (1, 4, "d", "label", "lemma:1:y"),
            (1, 5, "e", "label", "lemma:1"), (1, 6, "r", "reference", "lemma:1:x"), (1, 7, "m", "reference", "lemma:9")]
    symbols = symbol_frame(spark, rows)
    group = R.reference_groups(symbols, "duplicates").collect()
    assert len(group) == 1 and (group[0].keys, group[0].references, group[0].editable_labels, group[0].targets) == (2, 1, 4, 5)
    roles = {r.id: r.role for r in R.group_members(symbols, "duplicates").collect()}
    assert roles == {"a": "label", "b": "label", "c": "label", "d": "label", "e": "evidence", "r": "reference"}
    assert [r.grp for r in R.reference_groups(symbols, "missing").collect()] == ["lemma:9"]
    assert R.resolve(symbols).filter("resolved").count() == 0


def test_candidates_share_family_and_primes(spark):
    rows = [(1, 1, "a", "label", "theorem:1prime"), (1, 2, "b", "label", "claim:1'"), (1, 3, "c", "label", "equation:1'"), (1, 4, "r", "reference", "lemma:1′")]
    row = R.candidate_counts(symbol_frame(spark, rows)).first()
    assert (row.key, row.candidates, row.candidate_keys) == ("lemma:1′", 2, 2)
    assert R.candidate_pools(symbol_frame(spark, rows)).count() == 3


def test_group_check_reasons(spark):
    rows = [(1, 1, "a", "label", "lemma:1"), (1, 2, "b", "label", "lemma:1"), (1, 3, "r1", "reference", "lemma:1"), (1, 4, "r2", "reference", "lemma:1"), (1, 5, "z", "label", "claim:7")]
    symbols = symbol_frame(spark, rows)
    edit = lambda *e: spark.createDataFrame([(1, *x) for x in e], "book_id bigint, category string, id string, key string")
    none = spark.createDataFrame([], "book_id bigint, id string")
    reasons = lambda e, pending=none: {r.id: r.reason for r in R.check_group(symbols, e, pending).collect()}
    assert reasons(edit(("label", "a", "lemma:1:s"))) == {}
    assert reasons(edit(("label", "a", "lemma:1:s"), ("label", "b", "lemma:1:t"))) == {"r1": "missing_target", "r2": "missing_target"}
    got = reasons(edit(("label", "a", "lemma:1:s"), ("reference", "r1", "claim:7"), ("reference", "z", "claim:8")))
    assert got == {"r1": "target_not_in_context", "z": "not_owned"}
    both = edit(("label", "a", "lemma:1:s"), ("label", "b", "lemma:1:t"), ("reference", "r1", "lemma:1:t"))
    later = R.deferrable(symbols, both)
    assert [r.id for r in later.collect()] == ["r2"] and reasons(both, later) == {}


def test_unconfirmed_needs_a_missing_unedited_reference_with_reason(spark):
    rows = [(1, 1, "a", "label", "lemma:1"), (1, 2, "ok", "reference", "lemma:2"), (1, 3, "has", "reference", "lemma:1"), (1, 4, "bib", "reference", "bibliography:x")]
    symbols = symbol_frame(spark, rows)
    items = spark.createDataFrame([(1, "ok", "looked", False), (1, "has", "looked", False), (1, "bib", "looked", True), (1, "gone", "looked", False)],
                                  "book_id bigint, id string, reason string, bibliography boolean")
    edits = spark.createDataFrame([], "book_id bigint, category string, id string, key string")
    got = {r.id: r.problem for r in R.check_unconfirmed(items, symbols, edits, items.limit(0)).collect()}
    assert got == {"ok": None, "has": "REFERENCE_REVIEW", "bib": None, "gone": "REFERENCE_REVIEW"}
    blank = items.filter("id = 'ok'").withColumn("reason", F.lit(" \n"))
    assert R.check_unconfirmed(blank, symbols, edits, items.limit(0)).first().problem == "REFERENCE_REVIEW"


def test_paging_of_hits(spark):
    hits = spark.createDataFrame([(1, 1, p, 1) for p in range(1, 2000, 3)], "query_id int, book_id bigint, page bigint, line int")
    asked = spark.createDataFrame([(1, 300, 2)], "query_id int, offset int, limit int")
    got = SE.page_hits(hits, asked).orderBy("page").collect()
    assert [(r.page, r["rank"], r.total, r.next_offset) for r in got] == [(901, 301, 667, 302), (904, 302, 667, 302)]
    assert SE.page_hits(hits, asked.withColumn("offset", F.lit(666))).first().next_offset is None


def test_namespaced_ids_avoid_taken_names(spark):
    rows = spark.createDataFrame([(1, 0, "headings", 1, "a.b"), (1, 0, "headings", 2, "headings-1"), (1, 0, "headings", 3, "c_d"), (1, 0, "assets", 1, "x y")],
                                 "book_id bigint, batch_no bigint, grp string, ord int, id string")
    got = {r.id: r.new_id for r in ED.namespace_ids(rows, F.lit("b")).collect()}
    assert got == {"a.b": "b-headings-2", "headings-1": "b-headings-1", "c_d": "b-headings-3", "x y": "b-assets-1"}
    pages = spark.createDataFrame([(1, 0, 1, "\\BAHeading{a.b}\\BAHeading{headings-1}\\BAFigure{a.b}")], "book_id bigint, batch_no bigint, page bigint, tex string")
    assert ED.rename_records(pages, ED.namespace_ids(rows, F.lit("b"))).first().tex == "\\BAHeading{b-headings-2}\\BAHeading{b-headings-1}\\BAFigure{a.b}"


def test_registered_rules_and_bounds(spark):
    Q.register_rule("MINE", lambda pages: pages)
    assert {"UNSAFE_TEX", "COUNTER_RULE", "MINE"} <= set(Q.RULES)
    rows = spark.createDataFrame([(1, n, "C", str(n)) for n in range(11)] + [(2, n, "C", "x") for n in range(10)], "book_id bigint, page bigint, code string, detail string")
    got = {r.book_id: (len(r.errors), r.has_more) for r in Q.bounded(rows).collect()}
    assert got == {1: (10, True), 2: (10, False)}


def test_staleness_broadcasts_no_side_that_grows(spark):
    table = symbol_frame(spark, [(1, n, f"p{n}-label-0", "label", f"lemma:{n}.1") for n in range(1, 5)])
    later = table.withColumn("key", F.when(F.col("page") == 2, "lemma:9.9").otherwise(F.col("key"))).filter("page < 4")
    pages = spark.createDataFrame([(1, n, f"text {n}") for n in range(1, 5)], "book_id bigint, page bigint, tex string")
    now = pages.withColumn("tex", F.when(F.col("page") == 3, "other").otherwise(F.col("tex")))
    edits = R.check_edits(table.select("book_id", "category", "id", F.concat("key", F.lit(":a")).alias("key")), table).filter("problem IS NULL")
    found = R.stale_edits(edits.select("book_id", "id"), pages, now, table, later)
    assert {r.id: r.stale for r in found.collect()} == {"p1-label-0": False, "p2-label-0": True, "p3-label-0": True, "p4-label-0": True}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
