"""Line diffs, rebased places and indexed search against plain models."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions import alignment as A
from folio.functions import matching as MA
from folio.functions import text as X
from folio.operators import library as L
from folio.operators import rebase as RB
from folio.operators import search as SE
from folio.plans import content_queries as CQ


def blocks(a, b):
    """Longest common block first, earliest in a, then in b; then the same on both sides."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    if not n:
        return []
    return blocks(a[:i], b[:j]) + [(i, j, n)] + [(i + n + x, j + n + y, z) for x, y, z in blocks(a[i + n:], b[j + n:])]


def operations(a, b):
    joined = []
    for i, j, n in blocks(a, b):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (*joined[-1][:2], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    out, x, y = [], 0, 0
    for i, j, n in [*joined, (len(a), len(b), 0)]:
        if x < i or y < j:
            out.append(("replace" if x < i and y < j else "delete" if x < i else "insert", x, i, y, j))
        if n:
            out.append(("equal", i, i + n, j, j + n))
        x, y = i + n, j + n
    return out


def pairs(n=600):
    """Pages of few different lines, so most lines repeat, and versions with lines added, dropped, doubled and moved."""
    draw = random.Random(4)
    rows = []
    for _ in range(n):
        was = [draw.choice("abcdé") for _ in range(draw.randrange(0, 11))]
        now = list(was)
        for _ in range(draw.randrange(0, 5)):
            at = draw.randrange(0, len(now) + 1)
            now[at:at + draw.randrange(0, 3)] = [draw.choice("abcdZY") for _ in range(draw.randrange(0, 3))]
        rows.append((was, now))
    return rows


def mapped(was, now, start, end):
    if not was:
        return 1, max(1, len(now))

    def border(at, right):
        for tag, a, b, c, d in operations(was, now):
            if a <= at < b or a == b == at:
                return c if at == a else c + at - a if tag == "equal" else d if right else c
        return len(now)

    low, high = border(start - 1, False), border(end or len(was), True)
    return (low + 1, high) if high > low else None


def text(lines):
    return "".join(x + "\n" for x in lines)


def test_operations_on_repeated_lines():
    for was, now in pairs():
        assert A.operations(was, now) == operations(was, now)


def test_line_diffs_and_ranges(spark):
    rows, want, diffs = [], {}, {}
    for n, (was, now) in enumerate(pairs()):
        diffs[n] = operations(was, now)
        for start in range(1, max(2, len(was) + 1)):
            for end in {0, start, min(start + 1, max(1, len(was)))}:
                rows.append((n, text(was), text(now), start, end))
                want[n, start, end] = mapped(was, now, start, end)
    table = spark.createDataFrame(rows, "n int, original string, current string, start_line int, end_line int")
    got = RB.rebase_ranges(table).collect()
    assert {(r.n, r.start_line, r.end_line): None if r.problem else (r.new_start, r.new_end) for r in got} == want
    assert sum(v is None for v in want.values()) > 20
    found = RB.line_diff(table.dropDuplicates(["n"]).select("n", "original", "current")).collect()
    back = {}
    for r in sorted(found, key=lambda r: (r.n, r.old_start, r.new_start)):
        back.setdefault(r.n, []).append((r.tag, r.old_start, r.old_end, r.new_start, r.new_end))
    assert back == {n: sorted(d, key=lambda o: (o[1], o[3])) for n, d in diffs.items() if d}


def test_a_grant_is_not_widened_by_repeated_lines(spark):
    row = [("a\nb\na\nb\nc\n", "Z\na\nb\na\nb\nc\nY\n", 1, 2), (None, "x\n", 1, 0), ("x\n", None, 1, 0)]
    got = RB.rebase_ranges(spark.createDataFrame(row, "original string, current string, start_line int, end_line int")).collect()
    assert [(r.new_start, r.new_end, r.problem) for r in got] == [(1, 3, None), (1, 1, None), (None, None, "REFERENCE_REPAIR_CONFLICT")]


def test_tokens_follow_edits(spark):
    """Against the alignment read from both ends, over edits whose texts repeat the token."""
    draw = random.Random(9)
    token = "\\[x"
    nodes, pages, edits, want = [], [], [], {}

    def place(old, new, low, high):
        return next((j + low - i for tag, i, e, j, _ in operations(old, new) if tag == "equal" and i <= low and high <= e), None)

    for n in range(300):
        tex = "".join(draw.choice(["a", "b", " ", token, "\n"]) for _ in range(12)) + token + "end"
        at = tex.index(token)
        left = draw.randrange(0, len(tex) - 2)
        old = tex[left:left + draw.randrange(2, 9)]
        new = "".join(draw.choice(["a", token, old, old[:2], old[2:]]) for _ in range(draw.randrange(0, 3)))
        nodes.append((n, "t", 1, at, token))
        pages.append((n, 1, tex))
        edits.append((n, 1, 1, old, new))
        start = tex.find(old)
        if sum(tex.startswith(old, i) for i in range(len(tex))) > 1 and tex.count(old) != 1:
            want[n] = (None, "STALE_PATCH")
        elif at >= start + len(old):
            want[n] = (at + len(new) - len(old), None)
        elif at + len(token) <= start:
            want[n] = (at, None)
        else:
            low, high = at - start, at - start + len(token)
            one, two = place(old, new, low, high), place(old[::-1], new[::-1], len(old) - high, len(old) - low)
            two = None if two is None else len(new) - two - len(token)
            want[n] = (None, "SEAM_TARGET_AMBIGUOUS") if one != two else (None if one is None else start + one, None)
    frame = spark.createDataFrame
    got = RB.rebase_nodes(frame(nodes, "book_id int, id string, page int, offset int, token string"), frame(pages, "book_id int, page int, tex string"),
                          frame(edits, "book_id int, page int, seq int, old string, new string")).collect()
    assert {r.book_id: (r.new_offset, r.problem) for r in got} == want
    assert {p for _, p in want.values()} == {None, "STALE_PATCH", "SEAM_TARGET_AMBIGUOUS"}


TEXTS = ["Straße und Weg", "the End.", "x", "STRASSE", "weg weg weg", "İstanbul", "ﬁnal oﬃce", "ΟΔΟΣ ὁδός σ", "", None, "ß" * 3, "😀 Ω end", "ſeaſide", "aaa", "line\nfeed", "Ꭰ ꭰ"]
ASKED = ["strasse", "WEG", "x", "nd", "zzz", "i̇stanbul", "FINAL", "office", "οδοσ", "SSSS", "😀", "😀 ω", "seaside", "aaaa", "aa", "e\nf", "ꭰ", "", "ς", "ß"]


def test_folding_is_full():
    assert all(v == k.casefold() for k, v in X._foldings().items()) and "ß" in X._foldings()


def test_search_by_the_index_equals_a_scan(spark):
    lines = spark.createDataFrame([(1, 1, n, t) for n, t in enumerate(TEXTS)] + [(2, 1, 0, TEXTS[0]), (None, 1, 0, TEXTS[0])], "book_id bigint, page bigint, line int, text string")
    queries = spark.createDataFrame([(n, q) for n, q in enumerate(ASKED)] + [(99, "WEG")], "query_id int, query string")
    got = sorted((str(r.book_id), r.line, r.query_id) for r in SE.contains_ci(lines, F.col("text"), queries, ["book_id", "page", "line"]).collect())
    rows = [("1", n, t) for n, t in enumerate(TEXTS)] + [("2", 0, TEXTS[0]), ("None", 0, TEXTS[0])]
    want = sorted((b, n, k) for b, n, t in rows for k, q in [*enumerate(ASKED), (99, "WEG")] if t is not None and q and q.casefold() in t.casefold())
    assert got == want


def test_random_search_equals_a_scan(spark):
    draw = random.Random(2)
    rows = [(1, n, "".join(draw.choice("abAß ") for _ in range(draw.randrange(0, 40)))) for n in range(300)]
    asked = [(n, "".join(draw.choice("abß ") for _ in range(draw.randrange(1, 6)))) for n in range(60)]
    pages = spark.createDataFrame(rows, "book_id int, page int, tex string")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    got = sorted((r.query_id, r.page) for r in SE.search_pages(pages, queries).collect())
    assert got == sorted((k, p) for k, q in asked for _, p, t in rows if q.casefold() in t.casefold())


def test_no_query_meets_all_rows(spark):
    pages = spark.createDataFrame([(1, 1, "some text")], "book_id int, page int, tex string")
    queries = spark.createDataFrame([(1, "text"), (2, "so")], "query_id int, query string")
    plan = SE.contains_ci(pages, F.col("tex"), queries, ["book_id", "page"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert SE.contains_ci(pages, F.col("tex"), queries.limit(0), ["book_id", "page"]).count() == 0


def test_texts_are_read_once_and_stay_where_they_are(spark, sf_dir):
    for query in (CQ.line_search, CQ.search_evidence, CQ.search_with_errors):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        # Only counts per query and book move.
        assert all("tex" not in line and "_own" not in line for line in plan.splitlines() if "Exchange hash" in line)
        assert "SortMergeJoin" not in plan


@pytest.mark.parametrize("piece, bitmap", [(1 << 17, None), (40, None), (40, 0)])
def test_matching_equals_a_scan(monkeypatch, piece, bitmap):
    monkeypatch.setattr(MA, "PIECE", piece)
    if bitmap is not None:
        # All bytes hash alike, so every window does.
        monkeypatch.setattr(MA, "_BYTES", np.ones(256, np.uint64))
    draw = random.Random(3)
    texts = ["".join(draw.choice("abß😀 ") for _ in range(draw.randrange(0, 60))) for _ in range(200)] + ["", None, "b" * 500]
    terms = sorted({"".join(draw.choice("abß😀 ") for _ in range(draw.randrange(1, 20))) for _ in range(150)} | {"b" * n for n in (1, 2, 31, 32, 33, 499, 501)})
    got = MA.Terms(terms).held(pa.array(["cut", *texts])[1:]).to_pylist()
    assert [sorted(x) for x in got] == [[t for t in terms if t in (x or "")] for x in texts]
    assert MA.Terms([]).held(pa.array(texts)).to_pylist() == [[]] * len(texts)
    assert MA.Terms(terms).held(pa.array([], pa.string())).to_pylist() == []


def test_blocks_of_terms_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(SE, "BLOCK", 3)
    pages = spark.createDataFrame([(1, n, t) for n, t in enumerate(TEXTS)], "book_id int, page int, tex string")
    queries = spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")
    want = sorted((n, p) for n, q in enumerate(ASKED) for p, t in enumerate(TEXTS) if t and q and any(q.casefold() in line for line in t.casefold().split("\n")))
    assert sorted((r.query_id, r.page) for r in SE.search_pages(pages, queries).collect()) == want


@pytest.mark.parametrize("query, found", [("strasse", 2), (" STRASSE ", 2), ("ΟΔΟΣ", 1), ("nowhere", 0)])
def test_titles_are_folded(spark, query, found):
    books = spark.createDataFrame([(1, "Straße"), (2, "Strasse 2"), (3, "ὁδός οδος"), (4, None)], "book_id int, title string")
    assert L.title_filter(books, query).count() == found
