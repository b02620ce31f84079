import random
import re

from pyspark.sql import functions as F

from folio.functions import text as X
from folio.functions.scan import position
from folio.operators import environments as E
from folio.operators import markup as M
from folio.operators import scope as S
from folio.plans import reference_queries as RQ

PIECES = ["\\begin{proof}", "\\end{proof}", "\\begin{align*}", "\\end{align*}", "\\[", "\\]", "\\label{equation:1}", "\\label{proof:2}", "text ", "\n", "% note ", "\\% ", "\\\\% ", "é∑", "\\\\[", "\\ref{lemma:1.2}", "\\BAHeading{h1}"]


def documents(seed, books=3, pages=60):
    rng = random.Random(seed)
    out = []
    for book in range(books):
        page = 0
        for _ in range(pages):
            page += rng.choice([1, 2, 90])
            out.append((book, page, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "book_id bigint, page bigint, tex string")


def cut_comment(line):
    at = 0
    while (at := line.find("%", at)) >= 0:
        slashes = len(line[:at]) - len(line[:at].rstrip("\\"))
        if slashes % 2 == 0:
            return line[:at]
        at += 1
    return line


def tokens(tex):
    """Plain reading of the token rules, line by line: (op, name, offset, line)."""
    at, found = 0, []
    for number, line in enumerate(tex.split("\n"), 1):
        for m in re.finditer(r"(?<!\\)\\(?:(begin|end|label)\{([^{}\s]+)\}|(\[|\]))", cut_comment(line)):
            op = m[1] or ("begin" if m[3] == "[" else "end")
            found.append((op, m[2] or "displaymath", at + m.start(), number))
        at += len(line) + 1
    return found


def test_offsets_lines_and_comment_rules(spark):
    rows = documents(1)
    got = {}
    for r in M.env_tokens(frame(spark, rows)).collect():
        got.setdefault((r.book_id, r.page), []).append((r.op, r.name, r.start, r.line))
    for book, page, tex in rows:
        assert sorted(got.get((book, page), []), key=lambda t: t[2]) == tokens(tex)


def test_masking_keeps_offsets_and_differs_after_double_backslash(spark):
    df = spark.createDataFrame([("a\\\\% b\nc % d\n\\% e",)], "t string")
    row = df.select(X.mask_comments(F.col("t")).alias("m"), X.strip_comments(F.col("t")).alias("s")).first()
    assert row.m == "a\\\\% b\nc    \n\\% e" and row.s == "a\\\\\nc \n\\% e"


def test_symbol_ids_context_and_offsets(spark):
    tex = "% \\label{theorem:0}\n\\label{theorem:1.1} and \\ref{lemma:1.2} \\label{lemma:1.2}"
    rows = {r.id: r for r in M.symbols(frame(spark, [(1, 4, tex)])).collect()}
    assert set(rows) == {"p4-label-0", "p4-reference-0", "p4-label-1"}
    first = rows["p4-label-0"]
    assert tex[first.start:first.end] == "\\label{theorem:1.1}" and (first.kind, first.number, first.namespace) == ("theorem", "1.1", "theorem:1.1")
    assert first.context == " " * 19 + tex[19:]


def model(rows, strict):
    """Pairs by reduction: take out an opening and a closing of one name with nothing of the sequence left between them.

    Strictly, a closing that meets another name's opening is taken out alone. Otherwise each name is a sequence.
    """
    nodes, unmatched, labels = {}, [], {}
    for book in sorted({r[0] for r in rows}):
        sequence = []
        for _, page, tex in sorted(r for r in rows if r[0] == book):
            numbers = {"begin": 0}
            for op, name, offset, _ in tokens(tex):
                if op == "begin":
                    numbers["begin"] += 1
                    nodes[book, f"env-{page}-{numbers['begin']}"] = {"name": name, "label": "", "end": None}
                sequence.append((op, name, page, offset, f"env-{page}-{numbers['begin']}"))
        names = [{t[1] for t in sequence if t[0] != "label"}] if strict else [{n} for n in {t[1] for t in sequence if t[0] != "label"}]
        spans, lone = [], []
        for own in names:
            left = [t for t in sequence if t[0] != "label" and t[1] in own]
            while (at := next((i for i, t in enumerate(left) if t[0] == "end"), None)) is not None:
                if at and left[at - 1][1] == left[at][1]:
                    nodes[book, left[at - 1][4]]["end"] = left[at][2:4]
                    spans.append((left[at - 1], left[at]))
                    del left[at - 1:at + 1]
                else:
                    lone.append(left.pop(at))
            spans += [(t, None) for t in left]
        counts = {}
        for _, name, page, offset, _ in sorted(lone, key=lambda t: t[2:4]):
            counts[page] = counts.get(page, 0) + 1
            unmatched.append((book, f"end-{page}-{counts[page]}", name, page, offset))
        if strict:
            for op, key, page, offset, _ in sequence:
                around = [b for b, e in spans if op == "label" and b[2:4] < (page, offset) and (e is None or (page, offset) < e[2:4])]
                if around:
                    inner = max(around, key=lambda b: b[2:4])
                    kind = inner[1].rstrip("*")
                    if key.split(":")[0] == {"align": "equation", "displaymath": "equation"}.get(kind, kind):
                        labels.setdefault((book, inner[4]), key)
    for at, key in labels.items():
        nodes[at]["label"] = key
    return nodes, sorted(unmatched)


def test_independent_pairing_equals_stacks(spark):
    for seed in (3, 4):
        rows = documents(seed)
        nodes, unmatched = E.pair_independent(M.env_tokens(frame(spark, rows)))
        want, stray = model(rows, strict=False)
        got = {(r.book_id, r.id): (r.end_page, r.end_offset) if r.end_page is not None else None for r in nodes.collect()}
        assert got == {k: v["end"] for k, v in want.items()}
        assert sorted((r.book_id, r.id, r.name, r.page, r.offset) for r in unmatched.collect()) == stray


def test_strict_pairing_and_labels_equal_one_stack(spark):
    for seed in (5, 6, 7):
        rows = documents(seed)
        nodes, unmatched = E.pair_strict(frame(spark, rows))
        want, stray = model(rows, strict=True)
        got = {(r.book_id, r.id): ((r.end_page, r.end_offset) if r.end_page is not None else None, r.label) for r in nodes.collect()}
        assert got == {k: (v["end"], v["label"]) for k, v in want.items()}
        assert sorted((r.book_id, r.id, r.name, r.page, r.offset) for r in unmatched.collect()) == stray


def test_proof_behind_open_alignment_differs_by_rule(spark):
    df = frame(spark, [(1, 1, "\\begin{proof}Text.\\begin{align*}x=1"), (1, 2, "\\end{proof}")])
    strict, stray = E.pair_strict(df)
    assert {r.id: r.end_page for r in strict.collect()} == {"env-1-1": None, "env-1-2": None} and stray.first().name == "proof"
    free, none = E.pair_independent(M.env_tokens(df))
    assert {r.id: r.end_page for r in free.collect()} == {"env-1-1": 2, "env-1-2": None} and none.count() == 0


def test_scope_equals_a_stack(spark):
    rng = random.Random(8)
    levels = ["part", "chapter", "section", "subsection", "subsubsection"]
    rows, heads, page = [], [], 0
    for n in range(120):
        page += rng.choice([1, 300])
        rows.append((1, page, f"\\BAHeading{{h{n}}} \\label{{lemma:{n}}}"))
        heads.append((1, page, f"h{n}", rng.choice(levels), str(n), "t"))
    headings = spark.createDataFrame(heads, "book_id bigint, page bigint, id string, level string, number string, title string")
    scoped = S.heading_scope(M.markers(frame(spark, rows)), headings)
    got = {r.key: [s.id for s in r.scope] for r in scoped.filter("command = 'label'").collect()}
    stack = []
    for n, head in enumerate(heads):
        level = levels.index(head[3])
        stack = [s for s in stack if s[0] < level] + [(level, head[2])]
        assert got[f"lemma:{n}"] == [s[1] for s in stack]


def test_places_share_the_scope_of_their_last_heading(spark, sf_dir):
    rng = random.Random(9)
    rows, heads, page = [], [], 0
    for n in range(80):
        page += rng.choice([0, 1, 300])
        heads.append((1, page, f"h{n}", rng.choice(["part", "section", "subsection"]), "", "t"))
        rows.append((1, page, f"\\label{{lemma:{n}a}} \\BAHeading{{h{n}}} \\label{{lemma:{n}}} \\label{{claim:{n}}}"))
    pages = {}
    for _, at, tex in rows:
        pages[at] = pages.get(at, "") + tex
    headings = spark.createDataFrame(heads, "book_id bigint, page bigint, id string, level string, number string, title string")
    marks = M.markers(frame(spark, [(1, at, tex) for at, tex in pages.items()] + [(2, 1, "\\label{lemma:x}")]))
    want = {(r.book_id, r.key): [s.id for s in r.scope] for r in S.heading_scope(marks, headings).filter("command = 'label'").collect()}
    places = marks.filter("command = 'label'").select("book_id", "key", position(F.col("page"), F.col("start")).alias("pos"))
    scopes = {r.pos: [s.id for s in r.scope] for r in S.heading_scope(marks.filter("command = 'BAHeading'"), headings).collect()}
    got = {(r.book_id, r.key): scopes.get(r.heading, []) for r in S.last_headings(places, marks).collect()}
    assert got == want and len(got) == 241
    plan = RQ.group_scope_headings(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "scope:array" not in plan


def counters(spark, events, rules, seeds=(), documentclass="article", appendix=None):
    steps = spark.createDataFrame([(1, p, 0, i, c) for p, i, c in events], "book_id bigint, page bigint, start int, id string, counter string")
    setups = spark.createDataFrame([(1, documentclass)], "book_id bigint, documentclass string")
    own = spark.createDataFrame([(1, *r) for r in rules], "book_id bigint, name string, reset_by string, shared_with string, style string, prefix_parent boolean")
    seeded = spark.createDataFrame([(1, *s) for s in seeds], "book_id bigint, name string, value bigint")
    start = spark.createDataFrame([(1, appendix)], "book_id bigint, id string") if appendix else None
    out = S.materialise_counters(steps, S.effective_rules(own, setups), seeded, start)
    return {r.id: r.visible_number for r in out.collect()}


RULES = [("theorem", "section", "", "arabic", True), ("equation", "section", "", "arabic", True)]


def test_shared_counters_reset_and_prefix(spark):
    events = [(1, "s1", "section"), (2, "t1", "theorem"), (3, "l1", "lemma"), (400, "s2", "section"), (401, "t2", "theorem"), (402, "e1", "equation")]
    assert counters(spark, events, RULES) == {"s1": "1", "t1": "1.1", "l1": "1.2", "s2": "2", "t2": "2.1", "e1": "2.1"}
    more = [*events[:2], (2, "x", "theorem")]
    more = [(1, "s1", "section"), (2, "t1", "theorem"), (3, "t1b", "theorem"), (4, "l1", "lemma")]
    assert counters(spark, more, RULES)["l1"] == "1.3"


def test_appendix_letters_seeds_and_styles(spark):
    events = [(1, "s1", "section"), (2, "a", "section"), (3, "e", "equation"), (4, "b", "section"), (5, "l", "lemma")]
    got = counters(spark, events, RULES, seeds=[("section", 4)], appendix="a")
    assert got == {"s1": "5", "a": "A", "e": "A.1", "b": "B", "l": "B.1"}
    styled = counters(spark, [(1, "p", "part"), (2, "c", "chapter"), (3, "c2", "chapter"), (4, "f", "figure")], [("chapter", "part", "", "roman", False)], documentclass="book")
    assert styled == {"p": "I", "c": "i", "c2": "ii", "f": "ii.1"}


def test_rule_maps_of_books_are_not_broadcast(spark):
    """Their files are small, the maps are not: the driver would hold those of all books at once."""
    steps = spark.createDataFrame([(b, 1, 0, "t", "theorem") for b in range(50)], "book_id bigint, page bigint, start int, id string, counter string")
    setups = spark.createDataFrame([(b, "book") for b in range(50)], "book_id bigint, documentclass string")
    own = spark.createDataFrame([], "book_id bigint, name string, reset_by string, shared_with string, style string, prefix_parent boolean")
    out = S.materialise_counters(steps, S.effective_rules(own, setups), spark.createDataFrame([], "book_id bigint, name string, value bigint"))
    assert [r.visible_number for r in out.collect()] == ["1"] * 50
    depth = None
    for line in out._jdf.queryExecution().executedPlan().toString().splitlines():
        here = len(line) - len(line.lstrip(" :+-"))
        depth = here if "BroadcastExchange" in line else None if depth is not None and here <= depth else depth
        assert depth is None or "chains#" not in line


def test_fragments_move_once_to_their_page(spark, sf_dir):
    from folio.plans import corpora

    plan = corpora.tex_pages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
