import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from folio.operators import edits as ED
from folio.operators import rebase as RB
from folio.operators import rules as Q
from folio.operators import seams as SM
from folio.operators import search as SE


def aligned(text, part, suffix):
    """Brute force over the allowed edge differences, mirrored for the beginning of a text."""
    if not suffix:
        # A beginning that is too long loses its end, not its beginning, so only the search direction differs.
        if text.startswith(part):
            return part
        for cut in range(1, 9):
            head = part[: len(part) - cut]
            if len(head) >= max(8, len(part) // 2) and text.startswith(head):
                return head
        at = text.find(part)
        return text[: at + len(part)] if len(part) >= 8 and 0 < at <= 8 else None
    if text.endswith(part):
        return part
    for cut in range(1, 9):
        head = part[: len(part) - cut]
        if len(head) >= max(8, len(part) // 2) and text.endswith(head):
            return head
    at = text.rfind(part)
    return text[at:] if len(part) >= 8 and at >= 0 and 0 < len(text) - at - len(part) <= 8 else None


def test_alignment_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        text = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 40)))
        at, size = rng.randint(0, max(0, len(text) - 1)), rng.randint(0, 24)
        part = rng.choice([text[-size:] if size else "", text[:size], text[at:at + size], text[at:], text[:at]]) + rng.choice(["", "", "z", "zzzz", "zzzzzzzzz"])
        rows.append((text, part))
    df = spark.createDataFrame(rows, "t string, p string")
    out = df.select("t", "p", SM.align_suffix(F.col("t"), F.col("p")).alias("s"), SM.align_prefix(F.col("t"), F.col("p")).alias("b"))
    for r in out.collect():
        assert r.s == aligned(r.t, r.p, True) and r.b == aligned(r.t, r.p, False), r


def patch(spark, left, right, a, b, new):
    df = spark.createDataFrame([(left, right, a, b, new)], "left_tex string, right_tex string, left_suffix string, right_prefix string, replacement string")
    return SM.apply_seam(df).first()


@pytest.mark.parametrize("a, b, new, problem", [
    ("", "", "", None), ("", "", "x", "INVALID_PATCH"), ("is the end.", "And on", "is the end. And on", None),
    ("is the end", "And on", "X", None), ("no such place at all", "And on", "X", "STALE_PATCH"),
    ("is the end.", "", "\\input{x}", "UNSAFE_TEX"), ("is the end.", "", "\\tag{1}", "AUTOMATIC_NUMBERING"),
    ("\\label{a:1} is the end.", "", "is the end.", "ANCHOR_CHANGE"),
])
def test_patch_problems(spark, a, b, new, problem):
    assert patch(spark, "Here \\label{a:1} is the end.", "And on it goes", a, b, new).problem == problem


def test_patch_ignores_line_end_space_and_cuts_source_text(spark):
    row = patch(spark, "Start of it  \nlast line\t\nof page", "next", "of it\nlast line\nof page", "", "NEW")
    assert row.problem is None and row.new_left == "Start NEW"
    row = patch(spark, "x", "first  \nline goes on", "", "first\nline", "")
    assert row.new_right == " goes on"


def test_mismatch_is_located_in_the_source(spark):
    df = spark.createDataFrame([("one \nTWO three four", "one\nTWO XX")], "t string, p string")
    row = SM.seam_mismatch(df, "t", "p", False).first()
    assert (row.text_offset, row.part_offset, row.line, row.column, row.code_point) == (9, 8, 2, 5, ord("t"))
    tail = spark.createDataFrame([("one two three", "one TWO three")], "t string, p string")
    assert SM.seam_mismatch(tail, "t", "p", True).first().text_offset == 6


def test_tokens_follow_replacements(spark):
    text = "aa \\begin{proof} one \\begin{proof} two"
    pages = spark.createDataFrame([(1, 1, text)], "book_id bigint, page bigint, tex string")
    nodes = spark.createDataFrame([(1, "x", 1, 3, "\\begin{proof}"), (1, "y", 1, text.rindex("\\begin"), "\\begin{proof}")], "book_id bigint, id string, page bigint, offset int, token string")

    def follow(*edits):
        rows = spark.createDataFrame([(1, 1, n, o, w) for n, (o, w) in enumerate(edits)], "book_id bigint, page bigint, seq int, old string, new string")
        return {r.id: (r.new_offset, r.problem) for r in RB.rebase_nodes(nodes, pages, rows).collect()}

    assert follow(("aa ", "a ")) == {"x": (2, None), "y": (20, None)}
    assert follow(("aa \\begin{proof}", "aa ")) == {"x": (None, None), "y": (8, None)}
    assert follow((" one \\begin{proof} two", " one more \\begin{proof} two"))["y"] == (text.rindex("\\begin") + 5, None)
    first_only = (text[text.rindex("\\begin"):], "two")
    assert follow(first_only, ("\\begin{proof}", "\\begin{proof}\\begin{proof}"))["x"][1] == "SEAM_TARGET_AMBIGUOUS"
    assert follow(("proof", "lemma"))["x"][1] == "STALE_PATCH"


def test_line_ranges_follow_pages(spark):
    rows = [("a\nb\nc\n", "new\na\nb\nc\n", 2, 3), ("a\nb\nc\n", "a\nc\n", 2, 2), ("a\nb\nc\n", "a\nb\nc\n", 2, 0), ("", "x\ny\n", 1, 1)]
    df = spark.createDataFrame(rows, "original string, current string, start_line int, end_line int")
    got = {(r.original, r.current): (r.new_start, r.new_end, r.problem) for r in RB.rebase_ranges(df).collect()}
    assert got[rows[0][:2]] == (3, 4, None) and got[rows[1][:2]] == (None, None, "REFERENCE_REPAIR_CONFLICT")
    assert got[rows[2][:2]] == (2, 3, None) and got[rows[3][:2]] == (1, 2, None)


def test_fragments_apply_from_the_bottom(spark):
    pages = spark.createDataFrame([(1, 1, "a\nb\nc\nd")], "book_id bigint, page bigint, tex string")
    parts = spark.createDataFrame([(1, 1, 1, 1, "A\nA2"), (1, 1, 3, 4, "end")], "book_id bigint, page bigint, start_line int, end_line int, tex string")
    assert ED.apply_fragments(pages, parts).first().tex == "A\nA2\nb\nend"
    bad = parts.withColumn("tex", F.lit("\\BAFigure{x}"))
    assert ED.apply_fragments(pages, bad).first().problem == "REFERENCE_REPAIR_SCOPE"


def test_width_edits_keep_other_options(spark):
    tex = "\\includegraphics*[angle=90, width=3cm,scale=.5]{assets/f1.png} % \\BAFigure{f1}\n\\BAFigure{f1}\\BAFigure{f2}"
    pages = spark.createDataFrame([(1, 1, tex)], "book_id bigint, page bigint, tex string")
    wanted = spark.createDataFrame([(1, "f1", Decimal("0.500000"))], "book_id bigint, asset_id string, ratio decimal(10,6)")
    new = "[{}width=0.5\\linewidth,height=.8\\textheight,keepaspectratio]{{assets/f1.png}}"
    assert ED.width_edits(pages, wanted).first().tex == "\\includegraphics*" + new.format("angle=90,") + " % \\BAFigure{f1}\n\\includegraphics" + new.format("") + "\\BAFigure{f2}"


def test_pair_fixes_are_verified(spark):
    frame = lambda *pages: spark.createDataFrame([(1, n, t) for n, t in enumerate(pages, 1)], "book_id bigint, page bigint, tex string")
    before = frame("\\begin{proof}Text.", "more\\begin{lemma}", "\\end{lemma}")
    action = lambda **kw: spark.createDataFrame([(1, "e", "unclosed", "proof", 1, 0, kw.get("at", 0), kw.get("resolved", True), kw.get("more", False), kw.get("closing", 2), [1, 2])],
        "book_id bigint, id string, kind string, name string, page bigint, offset int, new_offset int, resolved boolean, reads_more boolean, closing_page bigint, seen array<bigint>")
    judge = lambda after, **kw: ED.verify_pairs(action(**kw), before, after).first().problem
    fixed = frame("\\begin{proof}Text.", "more\\end{proof}\\begin{lemma}", "\\end{lemma}")
    assert judge(fixed) is None and judge(fixed, closing=3) == "SEAM_TODO_PENDING" and judge(before) == "SEAM_TODO_PENDING"
    assert judge(before, resolved=False, more=True) is None
    assert judge(frame("Text.", "more\\begin{lemma}", "\\end{lemma}"), at=None) == "SEAM_OPENING_REMOVED"
    assert judge(frame("\\begin{proof}Text.", "more\\end{proof}", "\\end{lemma}")) == "SEAM_ENVIRONMENT_MISMATCH"


def test_pair_fixes_search_changed_pages_only(spark, monkeypatch):
    searched, tokens_of = [], ED.env_tokens
    monkeypatch.setattr(ED, "env_tokens", lambda pages, *more: searched.append(pages.count()) or tokens_of(pages, *more))
    frame = lambda *pages: spark.createDataFrame(pages, "book_id bigint, page bigint, tex string")
    before = frame((1, 1, "\\begin{proof}Text."), (1, 2, "more"), (1, 3, "\\begin{lemma}"), (1, 4, "\\end{proof}"), (2, 1, "\\begin{proof}"))
    # A page is added, one is gone, one is changed, one stays.
    after = frame((1, 1, "\\begin{proof}Text."), (1, 2, "more\\begin{proof}"), (1, 3, "\\begin{lemma}"), (1, 5, "\\end{proof}\\end{proof}"), (2, 1, "\\begin{proof}"))
    schema = "book_id bigint, id string, kind string, name string, page bigint, offset int, new_offset int, resolved boolean, reads_more boolean, closing_page bigint, seen array<bigint>"
    act = lambda book, i, kind, page, closing: (book, i, kind, "proof", page, 0, 0, True, False, closing, [closing])
    asked = [act(1, "a", "unclosed", 1, 5), act(1, "b", "unclosed", 1, 4), act(1, "c", "unclosed", 3, 5), act(1, "d", "unmatched_end", 5, 5), act(1, "e", "unmatched_end", 4, 4), act(2, "f", "unclosed", 1, 1)]
    got = {r.id: r.problem for r in ED.verify_pairs(spark.createDataFrame(asked, schema), before, after).collect()}
    assert got == {"a": None, "b": "SEAM_TODO_PENDING", "c": "SEAM_OPENING_REMOVED", "d": None, "e": "SEAM_TODO_PENDING", "f": "SEAM_TODO_PENDING"}
    assert searched == [5, 2]


def test_batches_cover_a_long_book(spark):
    runs = spark.createDataFrame([("r", 1, 532, 3)], "id string, start_page int, end_page int, pages_per_task int")
    rows = SM.assign_batches(runs).orderBy("batch_no").collect()
    assert len(rows) == 178 and rows[-1].pages == [532] and rows[0].batch_id == "batch-0001"


def test_exploded_pages_of_tasks_are_not_broadcast(spark):
    runs = spark.createDataFrame([(n, 1, 20, 3) for n in range(5)], "id bigint, start_page bigint, end_page bigint, pages_per_task bigint")
    asked = runs.select(F.col("id").alias("run_id"), F.explode(F.array(F.lit(1).cast("bigint"), F.lit(20).cast("bigint"), F.lit(21).cast("bigint"))).alias("page"))
    found = SM.task_of_page(SM.assign_batches(runs).withColumnRenamed("batch_id", "id"), asked)
    assert sorted({(r.page, r.task_id) for r in found.collect()}, key=str) == [(1, "batch-0001"), (20, "batch-0007"), (21, None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stitching_changes_both_ends_of_a_page(spark):
    pages = spark.createDataFrame([(1, 1, "one two"), (1, 2, "three four"), (1, 3, "five six")], "book_id bigint, page bigint, tex string")
    pairs = spark.createDataFrame([(1, 1, 2, "one two", "three four", "two", "three", "2-3"), (1, 2, 3, "three four", "five six", "four", "five", "4-5")],
                                  "book_id bigint, left_page bigint, right_page bigint, left_tex string, right_tex string, left_suffix string, right_prefix string, replacement string")
    got = {r.page: r.tex for r in SM.stitch(pages, SM.apply_seam(pairs)).collect()}
    assert got == {1: "one 2-3", 2: " 4-5", 3: " six"}


def test_boxes_and_reads(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.5, 1.0],), ([0.0, 0.0, 0.5],), ([0.0, float("nan"), 0.5, 1.0],), ([0.0, 0.0, 0.001, 1.0],)], "b array<double>")
    got = [(r.v, r.p) for r in df.select(Q.valid_box(F.col("b")).alias("v"), Q.pixel_box(F.col("b"), F.lit(5), F.lit(3)).alias("p")).collect()]
    assert got == [(True, [0, 0, 2, 3]), (False, None), (False, None), (True, None)]
    pages = spark.createDataFrame([(1, 1, "a\nb\r\nc\n")], "book_id bigint, page bigint, tex string")
    reads = spark.createDataFrame([(1, 1, 1, 2, 0), (2, 1, 1, 1, 9), (3, 1, 1, 3, 2)], "read_id int, book_id bigint, page bigint, start_line int, end_line int")
    assert {r.read_id: (r.text, r.total_lines) for r in SE.read_lines(pages, reads).collect()} == {1: ("b\nc", 3), 2: ("a\nb\nc", 3), 3: ("", 3)}


def test_conflicting_edits_are_reported_and_not_written(spark):
    schema = "book_id int, page int, id string, start int, end int, command string, key string"
    frame = lambda *rows: spark.createDataFrame([(1, 1, f"r{a}", a, b, "ref", k) for a, b, k in rows], schema)
    tex = "\\ref{a:1} \\ref{b:1} \\ref{c:1}"
    pages = spark.createDataFrame([(1, 1, tex)], "book_id int, page int, tex string")
    groups = [frame((0, 9, "y:1"), (10, 19, "b:2")), frame((0, 9, "z:1"), (10, 19, "b:2")), frame((20, 29, "c:2"))]
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        merged = ED.merge_edits(*[groups[i] for i in order])
        assert sorted((r.start, r.key, r.problem) for r in merged.collect()) == [(0, "y:1", "EDIT_CONFLICT"), (0, "z:1", "EDIT_CONFLICT"), (10, "b:2", None), (20, "c:2", None)]
        assert ED.apply_symbol_edits(pages, merged).first().tex == "\\ref{a:1} \\ref{b:2} \\ref{c:2}"
    inside = ED.merge_edits(frame((0, 29, "x")), frame((5, 9, "y"), (9, 12, "z")), frame((40, 50, "w")))
    assert sorted((r.start, r.problem) for r in inside.collect()) == [(0, "EDIT_CONFLICT"), (5, "EDIT_CONFLICT"), (9, "EDIT_CONFLICT"), (40, None)]
    touching = ED.merge_edits(frame((0, 9, "x")), frame((9, 12, "y")))
    assert {r.problem for r in touching.collect()} == {None}
