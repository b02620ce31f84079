"""Queries on search, page boundaries, positional edits and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import edits as ED
from ..operators import environments as E
from ..operators import markup as M
from ..operators import references as R
from ..operators import rebase as RB
from ..operators import rules as Q
from ..operators import search as SE
from ..operators import seams as SM
from ..session import cut_lineage
from . import corpora as C
from .markup_queries import _pairs_sql
from .reference_queries import _CHECKED, SEEDS, SETUPS, SYM, _edits, symbol_table
from .registry import Registry

REGISTRY = Registry()

# --- search --------------------------------------------------------------------------------------------------

DOCS = "SELECT source AS book_id, doc_id AS page, text AS tex FROM @documents"
SEARCHES = "SELECT item_id AS query_id, replace(substr(text, 1, 8), 't', 'T') AS query, item_id % 3 AS skip, 1 + item_id % 4 AS take FROM @benchmark"


def _fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


DUCK_LINES = """(SELECT book_id, page, generate_subscripts(l, 1) AS line, unnest(l) AS text FROM (
 SELECT source AS book_id, doc_id AS page, string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)) AS l
 FROM documents WHERE text <> ''))"""
_AT = f"(instr({_fold('l.text')}, {_fold('q.query')}) - 1)"
DUCK_HITS = f"""(SELECT q.query_id, l.book_id, l.page, l.line,
 substr(l.text, greatest(0, {_AT} - 120) + 1, {_AT} + length({_fold('q.query')}) + 240 - greatest(0, {_AT} - 120)) AS text
FROM {DUCK_LINES} l JOIN {C.duck(SEARCHES)} q ON contains({_fold('l.text')}, {_fold('q.query')}))"""


def _queries(spark, sf):
    return C.frame(spark, sf, SEARCHES).withColumnsRenamed({"skip": "offset", "take": "limit"})


@REGISTRY.add("line_search", f"SELECT * FROM {DUCK_HITS}")
def line_search(spark, sf):
    hits = SE.search_pages(C.frame(spark, sf, DOCS), _queries(spark, sf))
    return hits.withColumn("line", F.col("line").cast("bigint"))


@REGISTRY.add("line_search_pages", f"""
SELECT query_id, book_id, page, line, rank, total, skip AS "offset", CASE WHEN skip + take < total THEN skip + take END AS next_offset FROM (
 SELECT h.*, q.skip, q.take, row_number() OVER (PARTITION BY h.query_id, book_id ORDER BY page, line) AS rank, count(*) OVER (PARTITION BY h.query_id, book_id) AS total
 FROM {DUCK_HITS} h JOIN {C.duck(SEARCHES)} q ON q.query_id = h.query_id) WHERE rank > skip AND rank <= skip + take""")
def line_search_pages(spark, sf):
    hits = cut_lineage(SE.search_pages(C.frame(spark, sf, DOCS), _queries(spark, sf)).drop("text"))
    paged = SE.page_hits(hits, _queries(spark, sf))
    return SE.order_hits(paged.withColumn("line", F.col("line").cast("bigint")))


LABEL_QUERIES = "SELECT s_suppkey AS query_id, concat('LEMMA:', CAST(s_suppkey % 12 AS STRING), '.', CAST(s_suppkey % 5 AS STRING)) AS query FROM @supplier"


@REGISTRY.add("label_search", f"""
SELECT q.query_id, s.book_id, s.id FROM (
 SELECT s.*, substr(masked, greatest(0, start - 100) + 1, s."end" + 100 - greatest(0, start - 100)) AS context
 FROM {SYM} s JOIN (SELECT book_id, page, string_agg(CASE WHEN kind = 3 AND flag = 'A' THEN repeat(' ', length(frag) - 1) || chr(10) ELSE frag END, '' ORDER BY seq) AS masked
  FROM {C.duck(C.FRAGMENTS)} GROUP BY ALL) t ON s.book_id = t.book_id AND s.page = t.page WHERE category = 'label') s
JOIN {C.duck(LABEL_QUERIES)} q ON contains(lower(s.key || ' ' || s.context), lower(q.query))""")
def label_search(spark, sf):
    symbols = M.symbols(C.tex_pages(spark, sf))
    return SE.search_labels(symbols, C.frame(spark, sf, LABEL_QUERIES)).select("query_id", "book_id", "id")


DOC_READS = """SELECT concat('d', CAST(doc_id AS STRING)) AS read_id, source AS book_id, doc_id AS page,
 CAST(1 + doc_id % 3 AS INT) AS start_line, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 3 + doc_id % 5 END AS INT) AS end_line FROM @documents"""


@REGISTRY.add("line_range_reads", f"""
SELECT read_id, book_id, page, CAST(start_line AS BIGINT) AS start_line, least(CASE WHEN end_line = 0 THEN n ELSE end_line END, n) AS end_line, n AS total_lines,
 coalesce(array_to_string(list_slice(l, start_line, least(CASE WHEN end_line = 0 THEN n ELSE end_line END, n)), chr(10)), '') AS text
FROM (SELECT r.*, string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10)) AS l, len(l) AS n
 FROM {C.duck(DOC_READS)} r JOIN documents d ON d.doc_id = r.page)""")
def line_range_reads(spark, sf):
    found = SE.read_lines(C.frame(spark, sf, DOCS), C.frame(spark, sf, DOC_READS))
    return found.select("read_id", "book_id", "page", *[F.col(c).cast("bigint") for c in ("start_line", "end_line", "total_lines")], "text")


@REGISTRY.add("request_checks", f"""
SELECT CAST(query_id AS VARCHAR) AS request_id, 'SEARCH_QUERY' AS code FROM {C.duck(SEARCHES)} WHERE query_id % 5 = 0
UNION ALL SELECT read_id, 'READ_RANGE' FROM (SELECT r.*, len(string_split(CASE WHEN ends_with(text, chr(10)) THEN substr(text, 1, length(text) - 1) ELSE text END, chr(10))) AS n
 FROM {C.duck(DOC_READS)} r LEFT JOIN documents d ON d.doc_id = r.page AND doc_id % 6 <> 0) WHERE n IS NULL OR start_line > greatest(1, n) OR end_line <> 0 AND end_line < start_line
UNION ALL SELECT 'v' || doc_id, 'PAGE_SCOPE' FROM documents WHERE NOT (doc_id % 30 BETWEEN 1 AND 20)""")
def request_checks(spark, sf):
    """Blank queries (every fifth), bad line ranges (also on pages left out) and views outside a 20-page book."""
    searches = C.frame(spark, sf, SEARCHES).withColumn("query", F.when(F.col("query_id") % 5 == 0, "  ").otherwise(F.col("query")))
    docs = C.frame(spark, sf, DOCS)
    views = docs.select(F.concat(F.lit("v"), "page").alias("view_id"), "book_id", (F.col("page") % 30).alias("page"))
    books = docs.groupBy("book_id").agg(F.lit(20).alias("page_count"))
    return SE.check_requests(searches, C.frame(spark, sf, DOC_READS), views, docs.filter(F.col("page") % 6 != 0), books)


@REGISTRY.add("search_evidence", f"""
SELECT query_id, book_id, CAST(to_json([{{'request': query, 'total': total, 'error': NULL}}]) AS VARCHAR) AS search FROM (
 SELECT q.query_id, book_id, q.query, count(*) AS total FROM {DUCK_HITS} h JOIN {C.duck(SEARCHES)} q ON q.query_id = h.query_id GROUP BY ALL)""")
def search_evidence(spark, sf):
    """History of searches without page bodies."""
    hits = SE.search_pages(C.frame(spark, sf, DOCS), _queries(spark, sf)).groupBy("query_id", "book_id").agg(
        F.count("*").alias("total"), F.max("text").alias("body"))
    result = F.array(F.struct(F.col("query").alias("request"), "total", F.lit(None).cast("string").alias("error"), F.col("body")))
    history = hits.join(_queries(spark, sf), "query_id").select("query_id", "book_id", result.alias("search_results"))
    return SE.evidence(history).select("query_id", "book_id", F.to_json("search", {"ignoreNullFields": "false"}).alias("search"))


@REGISTRY.add("search_with_errors", f"""
SELECT query_id, book_id, count(page) AS hits, NULL AS error FROM {DUCK_HITS} WHERE book_id NOT LIKE '%3' GROUP BY ALL
UNION ALL SELECT query_id, book_id, 0, 'no text' FROM {C.duck(SEARCHES)}, (SELECT DISTINCT source AS book_id FROM documents WHERE source LIKE '%3')""")
def search_with_errors(spark, sf):
    docs = C.frame(spark, sf, DOCS)
    sources = docs.select("book_id").distinct().withColumn("error", F.when(F.col("book_id").endswith("3"), "no text"))
    found = SE.search_with_errors(docs, _queries(spark, sf), sources)
    return found.groupBy("query_id", "book_id", "error").agg(F.count("page").alias("hits"))


# --- batches and seams ---------------------------------------------------------------------------------------

@REGISTRY.add("page_batches", f"""
SELECT run_id, 'batch-' || lpad(CAST(n + 1 AS VARCHAR), CAST(greatest(4, length(CAST(n + 1 AS VARCHAR))) AS INTEGER), '0') AS batch_id, n + 1 AS batch_no,
 array_to_string(range(start_page + n * pages_per_task, least(start_page + (n + 1) * pages_per_task, end_page + 1)), ',') AS pages
FROM (SELECT id AS run_id, start_page, end_page, pages_per_task, unnest(range(0, (end_page - start_page) // pages_per_task + 1)) AS n FROM {C.duck(C.BOOK_RUNS)} WHERE end_page >= start_page)""")
def page_batches(spark, sf):
    rows = SM.assign_batches(C.frame(spark, sf, C.BOOK_RUNS))
    return rows.select("run_id", "batch_id", F.col("batch_no").cast("bigint"), F.array_join("pages", ",").alias("pages"))


@REGISTRY.add("page_owners", f"""
SELECT run_id, page, CASE WHEN page BETWEEN start_page AND end_page THEN 'batch-' || lpad(CAST((page - start_page) // pages_per_task + 1 AS VARCHAR), 4, '0') END AS task_id
FROM (SELECT id AS run_id, start_page, end_page, pages_per_task, unnest([start_page, end_page, end_page + 1]) AS page FROM {C.duck(C.BOOK_RUNS)})""")
def page_owners(spark, sf):
    """The batch that owns the first, last and first foreign page of every run."""
    runs = C.frame(spark, sf, C.BOOK_RUNS)
    asked = runs.select(F.col("id").alias("run_id"), F.explode(F.array("start_page", "end_page", F.col("end_page") + 1)).alias("page"))
    tasks = SM.assign_batches(runs).withColumnRenamed("batch_id", "id")
    return SM.task_of_page(tasks, asked).select("run_id", "page", "task_id")


def _pairs(spark, sf):
    pages = C.tex_pages(spark, sf)
    batches = C.frame(spark, sf, C.BATCH_PAGES).join(pages, ["book_id", "page"])
    return SM.page_pairs(batches.select("book_id", "batch_no", "page", "first_page", "last_page", "head", "tail", "tex"))


PAIRS = f"""(SELECT l.book_id, l.batch_no, l.page AS left_page, r.page AS right_page, l.tail AS left_tail, r.head AS right_head, lt.tex AS left_tex, rt.tex AS right_tex
FROM {C.duck(C.BATCH_PAGES)} l JOIN {C.duck(C.BATCH_PAGES)} r ON l.book_id = r.book_id AND r.batch_no = l.batch_no + 1 AND l.page = l.last_page AND r.page = r.first_page
JOIN ({C.TEX_PAGES}) lt ON lt.book_id = l.book_id AND lt.page = l.page JOIN ({C.TEX_PAGES}) rt ON rt.book_id = r.book_id AND rt.page = r.page)"""


@REGISTRY.add("page_pairs", f"SELECT book_id, batch_no, left_page, right_page, left_tail, right_head FROM {PAIRS}")
def page_pairs(spark, sf):
    return _pairs(spark, sf).select("book_id", "batch_no", "left_page", "right_page", "left_tail", "right_head")


_NET = f"""(SELECT book_id, CAST(floor((page - 1) / 3) AS BIGINT) AS batch_no, CAST(sum(CASE op WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) AS BIGINT) AS net FROM ({C.DUCK_ENV_TOKENS}) GROUP BY ALL)"""


@REGISTRY.add("open_seams", f"""
SELECT p.book_id, p.batch_no, left_page, right_page FROM {PAIRS} p LEFT JOIN {_NET} n ON n.book_id = p.book_id AND n.batch_no = p.batch_no
WHERE NOT (left_tail = 'closed' AND right_head = 'closed' AND greatest(0, coalesce(net, 0)) = 0)""")
def open_seams(spark, sf):
    """Seams with work left; what a batch leaves open is counted here as openings above closings."""
    tokens = M.env_tokens(C.tex_pages(spark, sf)).withColumn("batch_no", F.floor((F.col("page") - 1) / 3))
    step = F.when(F.col("op") == "begin", 1).when(F.col("op") == "end", -1).otherwise(0)
    counts = tokens.groupBy("book_id", "batch_no").agg(F.greatest(F.lit(0), F.sum(step)).alias("open_count"))
    return SM.open_seams(_pairs(spark, sf), counts).select("book_id", "batch_no", "left_page", "right_page")


def _patched(spark, sf):
    """Patches cut from the true edges, then made exact, short, long, foreign or unsafe by batch number."""
    n = F.col("batch_no") % 7
    left, right = F.col("left_tex"), F.col("right_tex")
    a = F.right(left, F.least(F.length(left), F.lit(20)))
    b = F.left(right, F.least(F.length(right), F.lit(20)))
    suffix = F.when(n == 1, F.left(a, F.length(a) - 3)).when(n == 2, F.concat(a, F.lit("zz"))).when(n == 3, F.lit("nothing like it")).when(n == 5, "").otherwise(a)
    prefix = F.when(n == 4, F.concat(b, F.lit("zzz"))).when(n == 5, "").otherwise(b)
    bare = F.regexp_replace(F.concat(suffix, prefix), P.MARKER, "")
    fixed = F.when(n.isin(2, 4), F.concat(a, b)).otherwise(F.concat(suffix, prefix))
    new = F.when(n == 5, F.when(F.col("batch_no") % 2 == 0, "").otherwise("more")).when(n == 6, bare).otherwise(fixed)
    return SM.apply_seam(_pairs(spark, sf).withColumn("left_suffix", suffix).withColumn("right_prefix", prefix).withColumn("replacement", new))


def _equal_start(a, b):
    """SQL: number of equal characters at the beginning of two texts."""
    return f"coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda z: {a}[z] <> {b}[z])) - 1, least(length({a}), length({b})))"


def _edge_sql(text: str, part: str, suffix: bool) -> str:
    """SQL: the part adjusted to the edge of the text, as the operator's docstrings say."""
    at_edge = "ends_with" if suffix else "starts_with"
    short = (f"list_filter(list_transform(range(1, 9), lambda c: length({part}) - c), "
             f"lambda k: k >= greatest(8, length({part}) // 2) AND {at_edge}({text}, substr({part}, 1, k)))[1]")
    if suffix:
        place = f"length({text}) - length({part}) - position(reverse({part}) in reverse({text})) + 1"
        gap, longer = f"length({text}) - ({place}) - length({part})", f"substr({text}, {place} + 1)"
    else:
        gap, longer = f"position({part} in {text}) - 1", f"substr({text}, 1, position({part} in {text}) - 1 + length({part}))"
    return (f"CASE WHEN {at_edge}({text}, {part}) THEN {part} WHEN {short} IS NOT NULL THEN substr({part}, 1, {short}) "
            f"WHEN length({part}) >= 8 AND contains({text}, {part}) AND {gap} BETWEEN 1 AND 8 THEN {longer} END")


def _view_sql(text: str) -> str:
    return f"regexp_replace({text}, '[ \\t]+(\\r?\\n)', '\\1', 'g')"


def _kept_sql(text: str) -> str:
    """SQL: positions of the characters that stay without space at line ends."""
    return f"list_filter(range(1, length({text}) + 1), lambda z: NOT regexp_matches(substr({text}, z), '^[ \\t]+\\r?\\n'))"


_LONE = "(?:[^A-Za-z]|$)"
_UNSAFE_SQL = f"""CASE WHEN contains(new, '^^') OR regexp_matches(new, '{P.BODY_FORBIDDEN.replace("(?![A-Za-z])", _LONE)}') THEN 'UNSAFE_TEX'
 WHEN contains(new, chr(92) || 'begin{{document}}') OR contains(new, chr(92) || 'end{{document}}') THEN 'BODY_REQUIRED'
 WHEN regexp_matches(new, '{P.MANUAL_NUMBERING.replace("(?![A-Za-z])", _LONE)}') THEN 'AUTOMATIC_NUMBERING' END"""
_PATCHED = f"""(
WITH q AS (SELECT *, batch_no % 7 AS n, right(left_tex, least(length(left_tex), 20)) AS a, left(right_tex, least(length(right_tex), 20)) AS b FROM {PAIRS}),
r AS (SELECT *, CASE n WHEN 1 THEN substr(a, 1, greatest(0, length(a) - 3)) WHEN 2 THEN a || 'zz' WHEN 3 THEN 'nothing like it' WHEN 5 THEN '' ELSE a END AS suffix,
  CASE n WHEN 4 THEN b || 'zzz' WHEN 5 THEN '' ELSE b END AS prefix FROM q),
v AS (SELECT *, CASE WHEN n = 5 THEN CASE WHEN batch_no % 2 = 0 THEN '' ELSE 'more' END WHEN n = 6 THEN regexp_replace(suffix || prefix, '{P.MARKER}', '', 'g')
   WHEN n IN (2, 4) THEN a || b ELSE suffix || prefix END AS new,
  {_view_sql("left_tex")} AS lv, {_view_sql("suffix")} AS sv, {_view_sql("right_tex")} AS rv, {_view_sql("prefix")} AS pv FROM r),
f AS (SELECT *, {_edge_sql("left_tex", "suffix", True)} AS da, {_edge_sql("right_tex", "prefix", False)} AS db,
  length({_edge_sql("lv", "sv", True)}) AS ka, length({_edge_sql("rv", "pv", False)}) AS kb FROM v),
g AS (SELECT *, CASE WHEN suffix = '' THEN '' ELSE coalesce(da, CASE WHEN ka > 0 THEN substr(left_tex, {_kept_sql("left_tex")}[length(lv) - ka + 1]) END) END AS ea,
  CASE WHEN prefix = '' THEN '' ELSE coalesce(db, CASE WHEN kb > 0 THEN substr(right_tex, 1, {_kept_sql("right_tex")}[kb]) END) END AS eb FROM f),
h AS (SELECT *, CASE WHEN suffix = '' AND prefix = '' THEN CASE WHEN new <> '' THEN 'INVALID_PATCH' END WHEN ea IS NULL OR eb IS NULL THEN 'STALE_PATCH'
  WHEN {_UNSAFE_SQL} IS NOT NULL THEN {_UNSAFE_SQL}
  WHEN regexp_extract_all(ea || eb, '{P.MARKER}') <> regexp_extract_all(new, '{P.MARKER}') THEN 'ANCHOR_CHANGE' END AS problem FROM g)
SELECT book_id, batch_no, left_page, right_page, left_tex, right_tex, suffix, new, problem,
 CASE WHEN problem IS NULL AND NOT (suffix = '' AND prefix = '') THEN substr(left_tex, 1, length(left_tex) - length(ea)) || new ELSE left_tex END AS new_left,
 CASE WHEN problem IS NULL AND NOT (suffix = '' AND prefix = '') THEN substr(right_tex, length(eb) + 1) ELSE right_tex END AS new_right FROM h)"""


@REGISTRY.add("seam_patches", f"SELECT book_id, batch_no, problem, new_left, new_right FROM {_PATCHED}")
def seam_patches(spark, sf):
    """Applied seams with their problem."""
    return _patched(spark, sf).select("book_id", "batch_no", "problem", "new_left", "new_right")


@REGISTRY.add("exact_seam_patches", f"""
SELECT book_id, batch_no, substr(left_tex, 1, length(left_tex) - 10) || '~' || right(left_tex, 10) || left(right_tex, 10) AS new_left, substr(right_tex, 11) AS new_right
FROM {PAIRS} WHERE length(left_tex) >= 10 AND length(right_tex) >= 10
 AND len(regexp_extract_all(right(left_tex, 10) || left(right_tex, 10), '{{')) = 0""")
def exact_seam_patches(spark, sf):
    """Exact patches on seams whose ten edge characters hold no argument."""
    a, b = F.right("left_tex", F.lit(10)), F.left("right_tex", F.lit(10))
    pairs = _pairs(spark, sf).filter((F.length("left_tex") >= 10) & (F.length("right_tex") >= 10) & ~F.contains(F.concat(a, b), F.lit("{")))
    patched = SM.apply_seam(pairs.withColumn("left_suffix", a).withColumn("right_prefix", b).withColumn("replacement", F.concat(F.lit("~"), a, b)))
    return patched.filter(F.col("problem").isNull()).select("book_id", "batch_no", "new_left", "new_right")


@REGISTRY.add("stitched_pages", f"""
WITH s AS MATERIALIZED (SELECT * FROM {_PATCHED} WHERE problem IS NULL),
j AS (SELECT p.book_id, p.page, p.tex, coalesce(length(r.right_tex) - length(r.new_right), 0) AS cut, l.new_left, length(l.new_left) - length(l.new) AS kept
 FROM ({C.TEX_PAGES}) p LEFT JOIN s r ON r.book_id = p.book_id AND r.right_page = p.page LEFT JOIN s l ON l.book_id = p.book_id AND l.left_page = p.page)
SELECT book_id, page, CASE WHEN new_left IS NOT NULL AND cut <= kept THEN substr(new_left, cut + 1) ELSE substr(tex, cut + 1) END AS tex,
 new_left IS NOT NULL AND cut > kept AS stale FROM j""")
def stitched_pages(spark, sf):
    """Pages after every applicable seam of the book."""
    pages = C.tex_pages(spark, sf)
    return SM.stitch(pages, cut_lineage(_patched(spark, sf)))


def _mismatch_sql(text: str, part: str, suffix: bool) -> str:
    """SQL: where a part first differs from the edge of a text, both seen without space at line ends."""
    turned = "reverse({})" if suffix else "{}"
    at = lambda seen: f"length({seen}) - common - 1" if suffix else "common"
    place = lambda source, seen: (f"CASE WHEN {at(seen)} < 0 THEN -1 WHEN {at(seen)} >= length({seen}) THEN length({source}) "  # noqa: E731
                                  f"ELSE {_kept_sql(source)}[{at(seen)} + 1] - 1 END")
    gap = "position(reverse(sv) in reverse(tv)) - 1" if suffix else "position(sv in tv) - 1"
    return f"""(WITH x AS (SELECT *, {_view_sql(text)} AS tv, {_view_sql(part)} AS sv FROM stale),
 y AS (SELECT *, {_equal_start(turned.format("tv"), turned.format("sv"))} AS common FROM x),
 z AS (SELECT *, {place(text, "tv")} AS text_offset, {place(part, "sv")} AS part_offset FROM y)
 SELECT book_id, batch_no, '{part}' AS side, CAST(text_offset AS INTEGER) AS text_offset, CAST(part_offset AS INTEGER) AS part_offset,
  CAST(1 + length(substr({text}, 1, greatest(0, text_offset))) - length(replace(substr({text}, 1, greatest(0, text_offset)), chr(10), '')) AS INTEGER) AS line,
  CAST(1 + length(string_split(substr({text}, 1, greatest(0, text_offset)), chr(10))[-1]) AS INTEGER) AS "column",
  CASE WHEN text_offset BETWEEN 0 AND length({text}) - 1 THEN unicode(substr({text}, CAST(text_offset AS INTEGER) + 1, 1)) END AS code_point,
  CASE WHEN length(sv) > 0 AND contains(tv, sv) THEN CAST({gap} AS INTEGER) END AS gap FROM z)"""


@REGISTRY.add("seam_mismatches", f"""
WITH stale AS MATERIALIZED (SELECT *, suffix AS left_part, substr(right_tex, 4, 20) || 'nothing' AS right_part FROM {_PATCHED} WHERE problem = 'STALE_PATCH')
SELECT * FROM {_mismatch_sql("left_tex", "left_part", True)} UNION ALL SELECT * FROM {_mismatch_sql("right_tex", "right_part", False)}""")
def seam_mismatches(spark, sf):
    """First difference of each stale patch on both sides, in offsets of the page; right parts here begin too late."""
    stale = _patched(spark, sf).filter(F.col("problem") == "STALE_PATCH").select(
        "book_id", "batch_no", "left_tex", "right_tex", F.col("left_suffix").alias("left_part"),
        F.concat(F.substr("right_tex", F.lit(4), F.lit(20)), F.lit("nothing")).alias("right_part"))
    keys = ["book_id", "batch_no"]
    left = SM.seam_mismatch(stale.select(*keys, F.lit("left_part").alias("side"), "left_tex", "left_part"), "left_tex", "left_part", True)
    right = SM.seam_mismatch(stale.select(*keys, F.lit("right_part").alias("side"), "right_tex", "right_part"), "right_tex", "right_part", False)
    return left.drop("left_tex", "left_part").unionByName(right.drop("right_tex", "right_part"))


@REGISTRY.add("stale_seams", f"""
SELECT p.book_id, p.batch_no, true AS report_changed, CAST(NULL AS VARCHAR) AS problem FROM {PAIRS} p JOIN {_NET} n ON n.book_id = p.book_id AND n.batch_no = p.batch_no
WHERE net > 0 AND p.batch_no % 2 = 0""")
def stale_seams(spark, sf):
    """Seams whose left report changed since the request (here: open counts of even batches were recorded as zero)."""
    tokens = M.env_tokens(C.tex_pages(spark, sf)).withColumn("batch_no", F.floor((F.col("page") - 1) / 3))
    step = F.when(F.col("op") == "begin", 1).when(F.col("op") == "end", -1).otherwise(0)
    now = cut_lineage(tokens.groupBy("book_id", "batch_no").agg(F.array(F.greatest(F.lit(0), F.sum(step))).alias("report")))
    then = now.withColumn("report", F.when(F.col("batch_no") % 2 == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("report")))
    pairs = _pairs(spark, sf).withColumn("problem", F.lit(None).cast("string"))
    return SM.stale_seams(then, now, pairs)


@REGISTRY.add("markers_conserved", f"""
SELECT DISTINCT book_id, page FROM {C.duck(C.FRAGMENTS)} WHERE kind = 4 AND flag = 'R'""")
def markers_conserved(spark, sf):
    """Pages whose markers change when figures are dropped."""
    pages = C.tex_pages(spark, sf)
    return SM.markers_conserved(pages, pages.withColumn("tex", F.regexp_replace("tex", r"\\BAFigure\{[^{}]+\}", "")))


# --- edits ---------------------------------------------------------------------------------------------------

@REGISTRY.add("edited_pages", f"""
SELECT book_id, page, string_agg(CASE WHEN new_key IS NULL THEN piece ELSE '{{' || new_key || '}}' END, '' ORDER BY seq, n) AS tex FROM (
 SELECT f.book_id, f.page, f.seq, f.n, f.piece, g.key AS new_key FROM (
  SELECT book_id, page, seq, base, generate_subscripts(p, 1) AS n, unnest(p) AS piece,
   unnest(list_transform(p, lambda x, i: CAST(base + coalesce(list_sum(list_transform(p[1:i - 1], lambda y: length(y))), 0) AS BIGINT))) AS at FROM (
   SELECT *, regexp_extract_all(frag, '[{{][^{{}}]*[}}]|[^{{}}]+') AS p FROM ({C._PLACED}))) f
 LEFT JOIN (SELECT * FROM {_CHECKED} WHERE problem IS NULL) g ON g.book_id = f.book_id AND g.page = f.page AND g."end" = f.at + length(f.piece))
GROUP BY ALL""")
def edited_pages(spark, sf):
    """Pages with all valid key edits written at their occurrences."""
    table = symbol_table(spark, sf)
    good = R.check_edits(_edits(table), table).filter(F.col("problem").isNull())
    half = F.col("category") == "label"
    merged = ED.merge_edits(good.filter(half), good.filter(~half), good.filter(half))
    return ED.apply_symbol_edits(C.tex_pages(spark, sf), merged)


@REGISTRY.add("conflicting_edits", f"""
SELECT e.book_id, e.id, e.page, e.key || x.tail AS key, CASE WHEN e.page % 4 = 0 THEN 'EDIT_CONFLICT' END AS problem
FROM (SELECT * FROM {_CHECKED} WHERE problem IS NULL) e, (VALUES (''), (':again')) AS x(tail) WHERE x.tail = '' OR e.page % 4 = 0""")
def conflicting_edits(spark, sf):
    """Edits of two groups that agree but on every fourth page, where the second writes other keys."""
    table = symbol_table(spark, sf)
    good = cut_lineage(R.check_edits(_edits(table), table).filter(F.col("problem").isNull()))
    other = good.withColumn("key", F.when(F.col("page") % 4 == 0, F.concat("key", F.lit(":again"))).otherwise(F.col("key")))
    return ED.merge_edits(good, other).select("book_id", "id", "page", "key", "problem")


@REGISTRY.add("stale_edits", f"""
SELECT e.book_id, e.id, CASE WHEN s.id IS NULL THEN true ELSE
 EXISTS (SELECT 1 FROM {C.duck(C.FRAGMENTS)} f WHERE f.book_id = s.book_id AND f.page = s.page AND f.kind = 5)
 OR (s.kind = 'lemma' AND s.command = 'label') END AS stale
FROM (SELECT * FROM {_CHECKED} WHERE problem IS NULL) e LEFT JOIN {SYM} s ON s.book_id = e.book_id AND s.id = e.id""")
def stale_edits(spark, sf):
    """Edits that lost their base: pages gained a word after each theorem, and lemma labels were renamed."""
    pages = C.tex_pages(spark, sf)
    now = pages.withColumn("tex", F.regexp_replace(F.regexp_replace("tex", r"\\end\{theorem\}", r"\\end{theorem} more"), r"\\label\{lemma:", r"\\label{lemma:x"))
    before, after = symbol_table(spark, sf), cut_lineage(M.symbols(now, with_context=False))
    good = R.check_edits(_edits(before), before).filter(F.col("problem").isNull()).select("book_id", "id")
    return R.stale_edits(good, pages, now, before, after).select("book_id", "id", "stale")


def _page_edits(pages):
    """Move each page's first `\\end{proof}` text around, with wrong edits of every sort by page number."""
    n = F.col("page") % 6
    old = F.when(n == 0, "We argue.").when(n == 1, "Opening words.").when(n == 2, "x=1").when(n == 3, "no such text").otherwise("Opening words.\n")
    new = (
        F.when(n == 0, "We argue.\\end{proof}").when(n == 1, "Opening words.").when(n == 2, "x=2")
        .when(n == 4, "\\begin{lemma}Opening words.\n").otherwise("Opening  words.\n")
    )
    return pages.select("book_id", "page", F.lit(1).alias("seq"), old.alias("old"), new.alias("new"), (F.col("page") % 11 != 0).alias("seen"))


@REGISTRY.add("unique_replacements", f"""
WITH e AS (SELECT *, CASE page % 6 WHEN 0 THEN 'We argue.' WHEN 1 THEN 'Opening words.' WHEN 2 THEN 'x=1' WHEN 3 THEN 'no such text' ELSE 'Opening words.' || chr(10) END AS old,
  CASE page % 6 WHEN 0 THEN 'We argue.' || chr(92) || 'end{{proof}}' WHEN 4 THEN chr(92) || 'begin{{lemma}}Opening words.' || chr(10) ELSE 'Opening  words.' || chr(10) END AS new FROM ({C.TEX_PAGES})),
c AS (SELECT *, CASE WHEN page % 11 = 0 THEN 'SEAM_PAGE_SCOPE' WHEN (length(tex) - length(replace(tex, old, ''))) / length(old) <> 1 THEN 'STALE_PATCH'
  WHEN page % 6 = 1 THEN 'EMPTY_PATCH' WHEN page % 6 = 2 THEN 'SEAM_CONTENT_CHANGE' END AS problem FROM e)
SELECT book_id, page, CASE WHEN bool_or(problem IS NOT NULL) OVER (PARTITION BY book_id, page // 2) THEN tex ELSE replace(tex, old, new) END AS tex, problem FROM c""")
def unique_replacements(spark, sf):
    """Each action edits two neighbouring pages, or none of them."""
    pages = C.tex_pages(spark, sf)
    return ED.apply_page_edits(pages, _page_edits(pages).withColumn("action_id", F.floor(F.col("page") / 2)))


def _count(text, part):
    return f"((length({text}) - length(replace({text}, {part}, ''))) // length({part}))"


def _aligned_sql(source: str, name: str) -> str:
    """SQL: tables that align `a` and `b` of each `k` of a source, recursively by the longest common block.

    `{name}` has one row per block: k, i, j, n. `{name}_cells` holds equal elements with the run that begins there.
    """
    return f"""
{name}_cells AS MATERIALIZED (
 SELECT k, i, j, max(i) OVER (PARTITION BY k, i - j, i - place) - i + 1 AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY k, i - j ORDER BY i) AS place FROM (
   SELECT k, i, unnest(range(0, len(b))) AS j, a, b FROM (SELECT k, a, b, unnest(range(0, len(a))) AS i FROM {source})) WHERE a[i + 1] = b[j + 1])),
{name}_parts AS (
 SELECT k, CAST(0 AS BIGINT) AS alo, CAST(len(a) AS BIGINT) AS ahi, CAST(0 AS BIGINT) AS blo, CAST(len(b) AS BIGINT) AS bhi, false AS own,
  CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS n FROM {source}
 UNION ALL
 SELECT k, CASE WHEN own THEN alo ELSE i + n END, CASE WHEN own THEN i ELSE ahi END, CASE WHEN own THEN blo ELSE j + n END, CASE WHEN own THEN j ELSE bhi END, own, i, j, n
 FROM (SELECT k, alo, ahi, blo, bhi, -m.x AS i, -m.y AS j, m.n AS n, unnest([true, false]) AS own FROM (
  SELECT p.k, alo, ahi, blo, bhi, max({{'n': least(run, ahi - c.i, bhi - c.j), 'x': -c.i, 'y': -c.j}}) AS m FROM {name}_parts p
  JOIN {name}_cells c ON c.k = p.k AND c.i >= alo AND c.i < ahi AND c.j >= blo AND c.j < bhi GROUP BY p.k, alo, ahi, blo, bhi))),
{name}_found AS (SELECT DISTINCT k, i, j, n FROM {name}_parts WHERE own),
-- Blocks that touch on both sides are one.
{name} AS (SELECT k, min(i) AS i, min(j) AS j, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS grp FROM (
   SELECT *, coalesce(lag(i + n) OVER w = i AND lag(j + n) OVER w = j, false) AS joined FROM {name}_found WINDOW w AS (PARTITION BY k ORDER BY i))) GROUP BY k, grp)"""


def _token_edits(pages):
    """One replacement per page: of a token by two, of a piece of one, of text around one, of one that is not there."""
    n = F.col("page") % 6
    old, new = (F.element_at(F.array(*[F.lit(x[at]) for x in _TOKEN_EDITS]), (n + 1).cast("int")) for at in (0, 1))
    return pages.select("book_id", "page", F.lit(1).alias("seq"), old.alias("old"), new.alias("new"))


_TOKEN_EDITS = [
    ("\\begin{theorem}", "\\begin{theorem}\\begin{theorem}"), ("words.\n\\beg", "words, more words.\n\n\\beg"), ("\\[x=1", "first \\[y=2\\] and \\[x=1"),
    ("no such text", "nothing"), ("\n\\begin{theorem}\\label", "\nA \\begin{lemma}\\begin{theorem}\\label"), ("\\begin{proof}We argue.", "We \\begin{proof}argue. \\begin{proof}"),
]
_QUOTED = ["'" + x.replace("\n", "' || chr(10) || '").replace("\\", "' || chr(92) || '") + "'" for pair in _TOKEN_EDITS for x in pair]


@REGISTRY.add("rebased_tokens", f"""
WITH RECURSIVE v AS (SELECT * FROM (VALUES {", ".join(f"({n}, {_QUOTED[2 * n]}, {_QUOTED[2 * n + 1]})" for n in range(6))}) AS x(n, old, new)),
v1 AS (SELECT n AS k, string_split(old, '') AS a, string_split(new, '') AS b FROM v),
v2 AS (SELECT n AS k, string_split(reverse(old), '') AS a, string_split(reverse(new), '') AS b FROM v),
{_aligned_sql("v1", "ahead")}, {_aligned_sql("v2", "back")},
t AS (SELECT book_id, page, CAST(start AS BIGINT) AS start, CASE WHEN name = 'displaymath' THEN chr(92) || '[' ELSE chr(92) || 'begin{{' || name || '}}' END AS token
  FROM ({C.DUCK_ENV_TOKENS}) WHERE op = 'begin'),
j AS (SELECT t.*, v.*, length(old) AS n_old, length(new) AS n_new, position(old in tex) - 1 AS lft,
  (length(tex) - length(replace(tex, old, ''))) // length(old) <> 1 AS stale, start - (position(old in tex) - 1) AS low, start - (position(old in tex) - 1) + length(token) AS high
  FROM t JOIN ({C.TEX_PAGES}) p ON p.book_id = t.book_id AND p.page = t.page JOIN v ON v.n = t.page % 6),
m AS (SELECT j.*, x.j + low - x.i AS one, n_new - (y.j + n_old - high - y.i) - length(token) AS two, start < lft + n_old AND start + length(token) > lft AS inside
  FROM j LEFT JOIN ahead x ON x.k = j.n AND x.i <= low AND high <= x.i + x.n LEFT JOIN back y ON y.k = j.n AND y.i <= n_old - high AND n_old - low <= y.i + y.n),
u AS (SELECT *, CASE WHEN stale THEN 'STALE_PATCH' WHEN inside AND one IS DISTINCT FROM two THEN 'SEAM_TARGET_AMBIGUOUS' END AS problem FROM m)
SELECT book_id, page || '-' || start AS id, CAST(CASE WHEN problem IS NOT NULL THEN NULL WHEN inside THEN lft + one
  WHEN start >= lft + n_old THEN start + n_new - n_old ELSE start END AS BIGINT) AS new_offset, problem FROM u""")
def rebased_tokens(spark, sf):
    """Environment tokens followed through replacements, on every page."""
    pages = cut_lineage(C.tex_pages(spark, sf))
    tokens = M.env_tokens(pages).filter(F.col("op") == "begin")
    nodes = tokens.select("book_id", F.concat_ws("-", "page", "start").alias("id"), "page", F.col("start").alias("offset"),
                          F.when(F.col("name") == "displaymath", "\\[").otherwise(F.concat(F.lit("\\begin{"), "name", F.lit("}"))).alias("token"))
    return RB.rebase_nodes(nodes, pages, _token_edits(pages))


# Two versions of each page whose lines repeat: the page twice, and lines added, taken out, doubled or turned round.
_VERSIONS = f"""SELECT concat(book_id, '-', page) AS k, book_id, page, concat(tex, tex) AS original, CASE page % 4 WHEN 0 THEN concat('New first line.', chr(10), tex, tex)
 WHEN 1 THEN replace(concat(tex, tex), concat('Opening words.', chr(10)), '') WHEN 2 THEN concat(tex, 'Between.', chr(10), tex, tex) ELSE concat('Opening words.', chr(10), tex, 'End.') END AS current
 FROM ({C.TEX_PAGES}) t"""


def _versions(spark, sf):
    tex, twice = F.col("tex"), F.concat("tex", "tex")
    n = F.col("page") % 4
    current = (F.when(n == 0, F.concat(F.lit("New first line.\n"), twice)).when(n == 1, F.replace(twice, F.lit("Opening words.\n"), F.lit("")))
               .when(n == 2, F.concat(tex, F.lit("Between.\n"), twice)).otherwise(F.concat(F.lit("Opening words.\n"), tex, F.lit("End."))))
    return C.tex_pages(spark, sf).select("book_id", "page", twice.alias("original"), current.alias("current"))


_LINES = f"""v AS MATERIALIZED ({_VERSIONS}),
l AS MATERIALIZED (SELECT k, book_id, page, {", ".join(f"regexp_extract_all({c}, '[^{chr(92)}n]*{chr(92)}n|[^{chr(92)}n]+') AS {x}" for c, x in (("original", "a"), ("current", "b")))} FROM v)"""


@REGISTRY.add("line_diffs", f"""
WITH RECURSIVE {_LINES}, {_aligned_sql("l", "blocks")},
e AS (SELECT k, i, j, n FROM blocks UNION ALL SELECT k, len(a), len(b), 0 FROM l),
g AS (SELECT *, coalesce(lag(i + n) OVER w, 0) AS pi, coalesce(lag(j + n) OVER w, 0) AS pj FROM e WINDOW w AS (PARTITION BY k ORDER BY i, j, n DESC)),
o AS (SELECT k, 'equal' AS tag, i AS a1, i + n AS a2, j AS b1, j + n AS b2 FROM e WHERE n > 0
 UNION ALL SELECT k, CASE WHEN pi < i AND pj < j THEN 'replace' WHEN pi < i THEN 'delete' ELSE 'insert' END, pi, i, pj, j FROM g WHERE pi < i OR pj < j)
SELECT book_id, page, tag, CAST(a1 AS INTEGER) AS old_start, CAST(a2 AS INTEGER) AS old_end, CAST(b1 AS INTEGER) AS new_start, CAST(b2 AS INTEGER) AS new_end FROM o JOIN l USING (k)""")
def line_diffs(spark, sf):
    """The operations between two versions of each page."""
    return RB.line_diff(_versions(spark, sf))


def _carried_sql(at: str, right: bool) -> str:
    """SQL: a border before line `at`, by the blocks of its page as the list `bs`, which ends with an empty one at both ends."""
    inside = f"list_filter(bs, lambda x: x.i < {at} AND {at} < x.i + x.n)"
    ends = f"list_filter(bs, lambda x: x.n > 0 AND x.i + x.n <= {at})"
    last = f"CASE WHEN len({ends}) = 0 THEN {{'i': 0, 'j': 0}} ELSE {{'i': {ends}[-1].i + {ends}[-1].n, 'j': {ends}[-1].j + {ends}[-1].n}} END"
    following = f"list_filter(bs, lambda x: x.i >= {at})[1]"
    return f"""CASE WHEN len({inside}) > 0 THEN {inside}[1].j + {at} - {inside}[1].i WHEN ({last}).i = {at} THEN ({last}).j
 WHEN {at} = len(a) THEN len(b) WHEN {following}.i = {at} THEN {following}.j ELSE {following + ".j" if right else f"({last}).j"} END"""


@REGISTRY.add("rebased_ranges", f"""
WITH RECURSIVE {_LINES}, {_aligned_sql("l", "blocks")},
e AS (SELECT k, list({{'i': i, 'j': j, 'n': n}} ORDER BY i, j, n DESC) AS bs FROM (SELECT k, i, j, n FROM blocks UNION ALL SELECT k, len(a), len(b), 0 FROM l) GROUP BY k),
r AS (SELECT l.*, bs, s.first, CASE WHEN s.last = 0 THEN len(a) ELSE s.last END AS stop, s.last FROM l JOIN e USING (k), (VALUES (1, 2), (2, 3), (3, 0)) AS s(first, last) WHERE len(a) >= 3),
w AS (SELECT book_id, page, first, last, {_carried_sql("(first - 1)", False)} AS low, {_carried_sql("stop", True)} AS high FROM r)
SELECT book_id, page, CAST(first AS INTEGER) AS start_line, CAST(CASE WHEN high > low THEN low + 1 END AS BIGINT) AS new_start, CAST(CASE WHEN high > low THEN high END AS BIGINT) AS new_end,
  CASE WHEN NOT high > low THEN 'REFERENCE_REPAIR_CONFLICT' END AS problem FROM w""")
def rebased_ranges(spark, sf):
    """Line ranges mapped onto pages whose lines repeat and that gained or lost some."""
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("start_line"), F.lit(b).alias("end_line")) for a, b in ((1, 2), (2, 3), (3, 0))]))
    ranges = _versions(spark, sf).withColumn("r", asked).select("book_id", "page", "original", "current", "r.*")
    usable = ranges.filter(F.size(X.keep_lines(F.col("original"))) >= 3)
    return RB.rebase_ranges(usable).select("book_id", "page", "start_line", "new_start", "new_end", "problem")


@REGISTRY.add("fragment_edits", f"""
WITH l AS (SELECT book_id, page, tex, string_split(rtrim(tex, chr(10)), chr(10)) AS ls FROM ({C.TEX_PAGES}))
SELECT book_id, page, CASE WHEN len(ls) < 2 OR page % 2 = 1 THEN tex WHEN contains(ls[2], chr(92) || 'BAHeading{{') OR contains(ls[2], chr(92) || 'BAFigure{{') THEN tex
 ELSE ls[1] || chr(10) || 'Second line.' || chr(10) || coalesce(array_to_string(ls[3:], chr(10)) || CASE WHEN len(ls) > 2 THEN chr(10) ELSE '' END, '') END AS tex,
 CASE WHEN len(ls) >= 2 AND page % 2 = 0 AND (contains(ls[2], chr(92) || 'BAHeading{{') OR contains(ls[2], chr(92) || 'BAFigure{{')) THEN 'REFERENCE_REPAIR_SCOPE' END AS problem
FROM l""")
def fragment_edits(spark, sf):
    """The second line of every even page replaced."""
    pages = C.tex_pages(spark, sf)
    chosen = pages.filter((F.col("page") % 2 == 0) & (F.size(X.split_lines(F.col("tex"))) >= 2))
    fragments = chosen.select("book_id", "page", F.lit(2).alias("start_line"), F.lit(2).alias("end_line"), F.lit("Second line.").alias("tex"))
    return ED.apply_fragments(pages, fragments)


@REGISTRY.add("grant_differences", """
WITH g AS (SELECT DISTINCT l_orderkey AS book_id, l_linenumber AS page, l_suppkey AS start_line, l_partkey AS end_line FROM lineitem WHERE l_returnflag <> 'R'),
r AS (SELECT l_orderkey AS book_id, l_linenumber AS page, l_suppkey AS start_line, l_partkey AS end_line FROM lineitem WHERE l_returnflag <> 'N')
SELECT book_id, page, start_line, end_line, 'not_granted_or_repeated' AS problem FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM g)
UNION ALL SELECT *, 'not_returned' FROM (SELECT * FROM g EXCEPT ALL SELECT * FROM r)""")
def grant_differences(spark, sf):
    rows = C.load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("book_id"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").alias("start_line"), F.col("l_partkey").alias("end_line"), "l_returnflag")
    return ED.same_grants(rows.filter("l_returnflag <> 'R'"), rows.filter("l_returnflag <> 'N'"))


@REGISTRY.add("id_differences", """
WITH s AS (SELECT o_custkey AS book_id, o_orderpriority AS id FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT o_custkey AS book_id, o_orderpriority AS id FROM orders WHERE o_orderstatus <> 'O')
SELECT book_id, id, 'not_selected' AS problem FROM (SELECT * FROM r EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'not_reported' FROM (SELECT * FROM s EXCEPT SELECT * FROM r)""")
def id_differences(spark, sf):
    rows = C.load(spark, sf, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderpriority").alias("id"), "o_orderstatus")
    return ED.same_ids(rows.filter("o_orderstatus <> 'P'"), rows.filter("o_orderstatus <> 'O'"))


# Record ids as a converter returns them: some with characters that need a new name.
RECORDS = f"""
SELECT book_id, CAST(floor((page - 1) / 3) AS BIGINT) AS batch_no, page, 'headings' AS grp, CASE WHEN id LIKE '%3' THEN concat(id, '.a') ELSE id END AS id FROM ({C.HEADINGS}) h
UNION ALL SELECT book_id, CAST(floor((page - 1) / 3) AS BIGINT), page, 'assets', CASE WHEN id LIKE '%7' THEN concat(id, '_b') ELSE id END FROM ({C.ASSETS}) a
"""


@REGISTRY.add("renamed_records", f"""
SELECT book_id, batch_no, grp, id, 'b' || batch_no || '-' || CASE WHEN regexp_full_match(id, '[A-Za-z0-9-]+') THEN id ELSE grp || '-' || ord END AS new_id
FROM (SELECT *, row_number() OVER (PARTITION BY book_id, batch_no, grp ORDER BY page, id) AS ord FROM {C.duck(RECORDS)})""")
def renamed_records(spark, sf):
    """New ids per batch. Local names are never taken in this corpus; tests cover taken ones."""
    return ED.namespace_ids(_records(spark, sf), F.concat(F.lit("b"), "batch_no"))


def _records(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("book_id", "batch_no", "grp").orderBy("page", "id")
    return C.frame(spark, sf, RECORDS).withColumn("ord", F.row_number().over(order))


@REGISTRY.add("renamed_pages", f"""
SELECT book_id, page, string_agg(CASE WHEN kind = 1 THEN replace(frag, '{{h', '{{b' || CAST(floor((page - 1) / 3) AS BIGINT) || '-h')
 WHEN kind = 4 AND flag = 'R' THEN replace(frag, 'BAFigure{{f', 'BAFigure{{b' || CAST(floor((page - 1) / 3) AS BIGINT) || '-f') ELSE frag END, '' ORDER BY seq) AS tex
FROM {C.duck(C.FRAGMENTS)} GROUP BY ALL""")
def renamed_pages(spark, sf):
    records = C.frame(spark, sf, C.HEADINGS).select("book_id", "page", F.lit("headings").alias("grp"), "id").unionByName(
        C.frame(spark, sf, C.ASSETS).select("book_id", "page", F.lit("assets").alias("grp"), "id"))
    from pyspark.sql import Window

    batch = F.floor((F.col("page") - 1) / 3)
    order = Window.partitionBy("book_id", "batch_no", "grp").orderBy("page", "id")
    names = ED.namespace_ids(records.withColumn("batch_no", batch).withColumn("ord", F.row_number().over(order)), F.concat(F.lit("b"), "batch_no"))
    return ED.rename_records(C.tex_pages(spark, sf).withColumn("batch_no", batch), names).select("book_id", "page", "tex")


@REGISTRY.add("insertion_widths", f"""
SELECT book_id, page, string_agg(CASE WHEN kind = 4 AND flag = 'R' AND partkey % 2 = 0 THEN
 replace(frag, chr(92) || 'BAFigure{{f' || rid || '}}', chr(92) || 'includegraphics[width=0.' || (1 + partkey % 9) || chr(92) || 'linewidth,height=.8' || chr(92) || 'textheight,keepaspectratio]{{assets/f' || rid || '.png}}') ELSE frag END, '' ORDER BY seq) AS tex
FROM {C.duck(C.FRAGMENTS)} f GROUP BY book_id, page HAVING bool_or(kind = 4 AND flag = 'R' AND partkey % 2 = 0)""")
def insertion_widths(spark, sf):
    """Figures of even parts set to a new width."""
    figures = C.tex_fragments(spark, sf).filter("kind = 4 AND flag = 'R' AND partkey % 2 = 0").select(
        "book_id", F.concat(F.lit("f"), "rid").alias("asset_id"), ((1 + F.col("partkey") % 9) / 10).cast("decimal(10,6)").alias("ratio")).distinct()
    return ED.width_edits(C.tex_pages(spark, sf), figures)


_ARGUED = f"""(SELECT book_id, page, position('We argue.' in tex) AS spot, (length(tex) - length(replace(tex, 'We argue.', ''))) // 9 AS times FROM ({C.TEX_PAGES}) WHERE page % 6 = 0)"""
# The added closing stands before whatever began at its place.
_CLOSED = f"""{C.DUCK_ENV_TOKENS} UNION ALL BY NAME SELECT book_id, page, 'end' AS op, 'proof' AS name, spot + 7.5 AS start, 0 AS line FROM {_ARGUED} WHERE times = 1 AND page % 11 <> 0"""


@REGISTRY.add("verified_pairs", f"""
SELECT b.book_id, b.id, CASE WHEN g.times <> 1 THEN 'SEAM_OPENING_REMOVED' WHEN a.end_page IS NULL OR a.end_page <> b.begin_page THEN 'SEAM_TODO_PENDING' END AS problem
FROM ({_pairs_sql(C.DUCK_ENV_TOKENS)}) b JOIN ({_pairs_sql(_CLOSED)}) a ON a.book_id = b.book_id AND a.name = b.name AND a.begin_page = b.begin_page AND a.begin_offset = b.begin_offset
LEFT JOIN {_ARGUED} g ON g.book_id = b.book_id AND g.page = b.begin_page
WHERE b.end_page IS NULL AND b.name = 'proof'""")
def verified_pairs(spark, sf):
    """Claimed fixes of unclosed proofs, judged before and after the replacements."""
    before = cut_lineage(C.tex_pages(spark, sf))
    edits = _page_edits(before).filter(F.col("page") % 6 == 0)
    after = cut_lineage(ED.apply_page_edits(before, edits).drop("problem"))
    tokens = cut_lineage(M.env_tokens(before))
    # A name is paired by itself, so proofs need no other tokens.
    nodes = cut_lineage(E.pair_independent(tokens.filter("name = 'proof'"))[0].filter("end_page IS NULL"))
    tracked = nodes.select("book_id", "id", F.col("begin_page").alias("page"), F.col("begin_offset").alias("offset"), F.lit("\\begin{proof}").alias("token"))
    moved = RB.rebase_nodes(tracked, before, edits).select("book_id", "id", "new_offset")
    actions = nodes.select(
        "book_id", "id", F.lit("unclosed").alias("kind"), "name", F.col("begin_page").alias("page"), F.col("begin_offset").alias("offset"),
        F.lit(True).alias("resolved"), F.lit(False).alias("reads_more"), F.col("begin_page").alias("closing_page"), F.array("begin_page").alias("seen"))
    return ED.verify_pairs(cut_lineage(actions.join(moved, ["book_id", "id"])), before, after, tokens)


# --- rules ---------------------------------------------------------------------------------------------------

_BODY = """SELECT source AS book_id, doc_id AS page, concat(text, CASE doc_id % 9 WHEN 0 THEN concat(chr(92), 'input{x}') WHEN 1 THEN concat(chr(92), 'inputs') WHEN 2 THEN 'a^^b'
 WHEN 3 THEN concat(chr(92), 'begin{document}') WHEN 4 THEN concat(chr(92), 'tag{1}') WHEN 5 THEN concat(chr(92), 'label{bad key}') WHEN 6 THEN concat(chr(92), 'ref{lemma:1}') ELSE '' END) AS tex FROM @documents"""


@REGISTRY.add("body_rules", """
SELECT source AS book_id, doc_id AS page, CASE doc_id % 9 WHEN 0 THEN 'UNSAFE_TEX' WHEN 2 THEN 'UNSAFE_TEX' WHEN 3 THEN 'BODY_REQUIRED' WHEN 4 THEN 'AUTOMATIC_NUMBERING' ELSE 'LABEL_NAME' END AS code,
 CASE doc_id % 9 WHEN 0 THEN chr(92) || 'input' WHEN 4 THEN chr(92) || 'tag' WHEN 5 THEN 'bad key' ELSE '' END AS detail FROM documents WHERE doc_id % 9 IN (0, 2, 3, 4, 5)""")
def body_rules(spark, sf):
    pages = C.frame(spark, sf, _BODY)
    return Q.all_violations(Q.check_body(pages), Q.check_manual_numbers(pages), Q.marker_violations(pages))


@REGISTRY.add("registered_rules", """
SELECT source AS book_id, doc_id AS page, CASE doc_id % 9 WHEN 0 THEN 'UNSAFE_TEX' WHEN 2 THEN 'UNSAFE_TEX' WHEN 3 THEN 'BODY_REQUIRED' WHEN 4 THEN 'AUTOMATIC_NUMBERING' ELSE 'LABEL_NAME' END AS code,
 CASE doc_id % 9 WHEN 0 THEN chr(92) || 'input' WHEN 4 THEN chr(92) || 'tag' WHEN 5 THEN 'bad key' ELSE '' END AS detail FROM documents WHERE doc_id % 9 IN (0, 2, 3, 4, 5)
UNION ALL SELECT source, doc_id, 'LONG_PAGE', CAST(length(text) AS VARCHAR) FROM documents WHERE length(text) > 4000""")
def registered_rules(spark, sf):
    """All rules on page texts that are registered, one of them added here."""
    pages = C.frame(spark, sf, _BODY)

    def long_pages(raw: DataFrame) -> DataFrame:
        return raw.filter(F.length("text") > 4000).select(
            F.col("source").alias("book_id"), F.col("doc_id").alias("page"), F.lit("LONG_PAGE").alias("code"), F.length("text").cast("string").alias("detail"))

    Q.register_rule("LONG_PAGE", long_pages)
    return Q.run_rules(["UNSAFE_TEX", "AUTOMATIC_NUMBERING", "LABEL_NAME", "LONG_PAGE"], pages=pages, raw=C.load(spark, sf, "documents"))


@REGISTRY.add("bounded_violations", """
SELECT book_id, code, CAST(to_json(list({'page': page, 'detail': detail} ORDER BY page, detail) FILTER (WHERE n <= 10)) AS VARCHAR) AS errors, count(*) > 10 AS has_more FROM (
 SELECT *, row_number() OVER (PARTITION BY book_id, code ORDER BY page, detail) AS n FROM (
  SELECT CAST(l_suppkey % 5 AS BIGINT) AS book_id, l_returnflag AS code, l_orderkey AS page, concat(l_partkey, ':', l_linenumber) AS detail FROM lineitem)) GROUP BY ALL""")
def bounded_violations(spark, sf):
    """First ten findings per book and code, with a flag for more; a code here covers a third of all rows."""
    rows = C.load(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 5).alias("book_id"), F.col("l_returnflag").alias("code"), F.col("l_orderkey").alias("page"),
        F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("detail"))
    return Q.bounded(rows).withColumn("errors", F.to_json("errors"))


@REGISTRY.add("public_rules", """
SELECT c_custkey AS book_id, CAST(NULL AS BIGINT) AS page, CASE WHEN c_custkey % 4 = 0 THEN 'UNSAFE_TEX' ELSE 'PREAMBLE_REQUIRED' END AS code, '' AS detail FROM customer WHERE c_custkey % 4 IN (0, 1)""")
def public_rules(spark, sf):
    tex = F.when(F.col("c_custkey") % 4 == 0, "\\openin5").when(F.col("c_custkey") % 4 == 1, "\\end{document}").otherwise("\\newcommand{\\a}{b}")
    return Q.check_public(C.load(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), F.concat("c_name", tex).alias("public_tex")))


@REGISTRY.add("page_coverage", f"""
SELECT book_id, min(coalesce(want, got)) AS page, 'PAGE_COVERAGE' AS code, CAST(batch_no AS VARCHAR) AS detail FROM (
 SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.batch_no, b.batch_no) AS batch_no, a.page AS got, b.page AS want
 FROM (SELECT book_id, batch_no, page, row_number() OVER (PARTITION BY book_id, batch_no ORDER BY page % 100) AS o FROM {C.duck(C.BATCH_PAGES)} WHERE page % 17 <> 0) a
 FULL JOIN (SELECT book_id, batch_no, page, row_number() OVER (PARTITION BY book_id, batch_no ORDER BY page) AS o FROM {C.duck(C.BATCH_PAGES)}) b
 ON a.book_id = b.book_id AND a.batch_no = b.batch_no AND a.o = b.o) WHERE got IS DISTINCT FROM want GROUP BY ALL""")
def page_coverage(spark, sf):
    """Batches whose returned pages (every 17th missing, hundreds out of order) are not the owned ones in order."""
    from pyspark.sql import Window

    owned = C.frame(spark, sf, C.BATCH_PAGES).select("book_id", "batch_no", "page")
    number = lambda order: F.row_number().over(Window.partitionBy("book_id", "batch_no").orderBy(order))
    returned = owned.filter(F.col("page") % 17 != 0).withColumn("ord", number(F.col("page") % 100))
    return Q.page_coverage(returned, owned.withColumn("ord", number(F.col("page"))))


@REGISTRY.add("record_ids", f"""
WITH r AS (SELECT book_id, batch_no, page, CASE WHEN page % 13 = 0 THEN 'same' WHEN page % 19 = 0 THEN 'a b' ELSE id END AS id FROM {C.duck(RECORDS)})
SELECT book_id, min(page) AS page, 'INVALID_ID' AS code, id AS detail FROM r GROUP BY book_id, batch_no, id HAVING count(*) > 1
UNION ALL SELECT book_id, page, 'INVALID_ID', id FROM r WHERE id = 'a b'""")
def record_ids(spark, sf):
    bad = F.when(F.col("page") % 13 == 0, "same").when(F.col("page") % 19 == 0, "a b").otherwise(F.col("id"))
    return Q.check_ids(C.frame(spark, sf, RECORDS).withColumn("id", bad))


_ANCHORS = f"""
SELECT book_id, page, 'BAHeading' AS command, CASE WHEN page % 10 = 0 THEN concat(id, 'x') ELSE id END AS id FROM ({C.HEADINGS}) h
UNION ALL SELECT book_id, page, 'BAFigure', id FROM ({C.ASSETS}) a
"""


@REGISTRY.add("anchor_rules", f"""
WITH m AS (SELECT book_id, page, command, key, CAST(floor((page - 1) / 3) AS BIGINT) AS batch_no FROM ({C.DUCK_MARKERS}) WHERE command IN ('BAHeading', 'BAFigure')),
r AS (SELECT book_id, command, id, CAST(floor((page - 1) / 3) AS BIGINT) AS batch_no, CASE WHEN page % 7 = 0 THEN page + 3 WHEN page % 7 = 1 AND page % 3 = 1 THEN page + 1 ELSE page END AS page, page % 7 <> 0 AS in_batch FROM {C.duck(_ANCHORS)}),
u AS (SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(q, p) AS page, coalesce(a.key, b.key) AS key, a.n AS used, b.n AS listed FROM
 (SELECT book_id, batch_no, command, key, count(*) AS n, min(page) AS p FROM m GROUP BY ALL) a FULL JOIN
 (SELECT book_id, batch_no, command, id AS key, count(*) AS n, min(page) AS q FROM r GROUP BY ALL) b ON a.book_id = b.book_id AND a.batch_no = b.batch_no AND a.command = b.command AND a.key = b.key)
SELECT book_id, page, 'MISSING_ANCHOR' AS code, key AS detail FROM u WHERE coalesce(used, 0) <> coalesce(listed, 0)
UNION ALL SELECT book_id, page, 'PAGE_SCOPE', id FROM r WHERE NOT in_batch
UNION ALL SELECT book_id, page, 'ANCHOR_PAGE', id FROM r WHERE in_batch AND EXISTS (SELECT 1 FROM m WHERE m.book_id = r.book_id AND m.batch_no = r.batch_no AND m.command = r.command AND m.key = r.id)
 AND NOT EXISTS (SELECT 1 FROM m WHERE m.book_id = r.book_id AND m.batch_no = r.batch_no AND m.command = r.command AND m.key = r.id AND m.page = r.page)""")
def anchor_rules(spark, sf):
    """Records against markers, with renamed headings, pages outside the batch and pages one off."""
    batch = F.floor((F.col("page") - 1) / 3)
    marks = M.markers(C.tex_pages(spark, sf)).filter("category = 'record'").withColumn("batch_no", batch)
    moved = F.when(F.col("page") % 7 == 0, F.col("page") + 3).when((F.col("page") % 7 == 1) & (F.col("page") % 3 == 1), F.col("page") + 1).otherwise(F.col("page"))
    records = C.frame(spark, sf, _ANCHORS).withColumn("batch_no", batch).withColumn("in_batch", F.col("page") % 7 != 0).withColumn("page", moved)
    return Q.check_anchors(marks, records)


@REGISTRY.add("image_boxes", f"""
SELECT book_id, page, id, x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1 AS valid,
 CASE WHEN x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1 THEN concat_ws(',', CAST(round_even(x0 * 800, 0) AS INT), CAST(round_even(y0 * 1100, 0) AS INT), CAST(round_even(x1 * 800, 0) AS INT), CAST(round_even(y1 * 1100, 0) AS INT)) END AS pixels
FROM {C.duck(C.ASSETS)}""")
def image_boxes(spark, sf):
    rows = C.frame(spark, sf, C.ASSETS).withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    return rows.select("book_id", "page", "id", Q.valid_box(F.col("bbox")).alias("valid"),
                       F.array_join(Q.pixel_box(F.col("bbox"), F.lit(800), F.lit(1100)), ",").alias("pixels"))


@REGISTRY.add("image_regions", f"""
SELECT book_id, page, 'IMAGE_REGION' AS code, id AS detail FROM {C.duck(C.ASSETS)} WHERE NOT (x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1)""")
def image_regions(spark, sf):
    return Q.check_boxes(C.frame(spark, sf, C.ASSETS).withColumn("bbox", F.array("x0", "y0", "x1", "y1")))


@REGISTRY.add("repairable_assets", f"""
SELECT book_id, id, page <= 200 AND x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1 AS repairable FROM {C.duck(C.ASSETS)}""")
def repairable_assets(spark, sf):
    assets = C.frame(spark, sf, C.ASSETS).withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    books = assets.select("book_id").distinct().withColumn("page_count", F.lit(200))
    return Q.repairable(assets, books).select("book_id", "id", "repairable")


_ODD_RULES = f"""
SELECT book_id, 'section' AS name, CASE WHEN book_id % 3 = 1 THEN 'section' ELSE 'subsection' END AS reset_by, '' AS shared_with, 'arabic' AS style, false AS prefix_parent, 0 AS ord FROM ({SETUPS}) a
UNION ALL SELECT book_id, 'subsection', 'section', '', 'arabic', false, 1 FROM ({SETUPS}) b WHERE book_id % 3 <> 1
UNION ALL SELECT book_id, 'equation', 'chapter', '', 'arabic', false, 2 FROM ({SETUPS}) c
UNION ALL SELECT book_id, 'lemma', '', 'section', 'arabic', false, 3 FROM ({SETUPS}) d WHERE book_id % 2 = 0
UNION ALL SELECT book_id, 'lemma', '', 'claim', 'arabic', false, 4 FROM ({SETUPS}) e WHERE book_id % 4 = 0
"""


@REGISTRY.add("counter_rule_checks", f"""
WITH s AS (SELECT * FROM {C.duck(SETUPS)})
SELECT book_id, CAST(NULL AS BIGINT) AS page, 'COUNTER_RULE' AS code, d AS detail FROM (
 SELECT book_id, 'repeated rule lemma' AS d FROM s WHERE book_id % 4 = 0
 UNION ALL SELECT book_id, 'level of section' FROM s WHERE book_id % 3 = 1
 UNION ALL SELECT book_id, 'level of equation' FROM s WHERE documentclass = 'article'
 UNION ALL SELECT book_id, 'share of lemma' FROM s WHERE book_id % 2 = 0
 UNION ALL SELECT book_id, 'cycle at section' FROM s
 UNION ALL SELECT book_id, 'cycle at subsection' FROM s WHERE book_id % 3 <> 1
 UNION ALL SELECT book_id, 'cycle at lemma' FROM s WHERE book_id % 4 = 2
 UNION ALL SELECT book_id, 'repeated seed section' FROM s WHERE book_id % 2 = 0
 UNION ALL SELECT book_id, 'seed of chapter' FROM s WHERE documentclass = 'article')""")
def counter_rule_checks(spark, sf):
    setups = C.frame(spark, sf, SETUPS)
    seeds = C.frame(spark, sf, SEEDS).unionByName(setups.filter("book_id % 2 = 0").select("book_id", F.lit("section").alias("name"), F.lit(1).cast("bigint").alias("value")))
    seeds = seeds.unionByName(setups.select("book_id", F.lit("chapter").alias("name"), F.lit(1).cast("bigint").alias("value")))
    return Q.check_counters(C.frame(spark, sf, _ODD_RULES), seeds, setups)


_ORD = "row_number() OVER (PARTITION BY book_id ORDER BY page, id)"
PATCHES = f"SELECT *, CAST({_ORD} AS BIGINT) AS ord FROM (SELECT book_id, page, CASE WHEN book_id % 3 = 2 AND page > 100 THEN concat(id, '?') ELSE id END AS id, 'section' AS level FROM ({C.HEADINGS}) h WHERE NOT (book_id % 3 = 1 AND page > 200)) p"


@REGISTRY.add("heading_coverage", f"""
WITH h AS (SELECT *, {_ORD} AS ord FROM {C.duck(C.HEADINGS)}), p AS (SELECT * FROM {C.duck(PATCHES)}),
w AS (SELECT coalesce(h.book_id, p.book_id) AS book_id, coalesce(h.ord, p.ord) AS ord, h.id AS was, p.id AS got, h.page FROM h FULL JOIN p ON h.book_id = p.book_id AND h.ord = p.ord WHERE h.id IS DISTINCT FROM p.id)
SELECT book_id, arg_min(page, ord) AS page, 'HEADING_COVERAGE' AS code, concat_ws(' ', min(ord), coalesce(arg_min(was, ord), '-'), coalesce(arg_min(coalesce(got, '-'), ord), '-')) AS detail FROM w GROUP BY book_id""")
def heading_coverage(spark, sf):
    return Q.heading_patch(_ordered_headings(spark, sf), C.frame(spark, sf, PATCHES))[1]


def _ordered_headings(spark, sf):
    return C.frame(spark, sf, f"SELECT *, CAST({_ORD} AS BIGINT) AS ord FROM ({C.HEADINGS}) h")


@REGISTRY.add("patched_headings", f"""
SELECT h.book_id, h.id, 'section' AS level, h.number FROM {C.duck(C.HEADINGS)} h WHERE h.book_id NOT IN (
 SELECT a.book_id FROM {C.duck(C.HEADINGS)} a WHERE a.book_id % 3 = 2 AND a.page > 100 OR a.book_id % 3 = 1 AND a.page > 200)""")
def patched_headings(spark, sf):
    merged, _ = Q.heading_patch(_ordered_headings(spark, sf), C.frame(spark, sf, PATCHES))
    return merged.select("book_id", "id", "level", "number")


@REGISTRY.add("appendix_rules", f"""
WITH s AS (SELECT s.book_id, documentclass, min(h.id) AS start FROM {C.duck(SETUPS)} s JOIN {C.duck(C.HEADINGS)} h ON h.book_id = s.book_id GROUP BY ALL)
SELECT s.book_id, CAST(NULL AS BIGINT) AS page, 'APPENDIX_HEADING' AS code, start AS detail FROM s JOIN {C.duck(C.HEADINGS)} h ON h.book_id = s.book_id AND h.id = start
WHERE level <> CASE documentclass WHEN 'book' THEN 'chapter' ELSE 'section' END""")
def appendix_rules(spark, sf):
    headings = C.frame(spark, sf, C.HEADINGS)
    starts = headings.groupBy("book_id").agg(F.min("id").alias("appendix_start"))
    return Q.check_appendix(headings, C.frame(spark, sf, SETUPS).join(starts, "book_id"))


_RANGES = """SELECT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS seq,
 CAST(l_quantity AS BIGINT) AS start_line, CAST(l_quantity AS BIGINT) + l_linenumber AS end_line FROM @lineitem"""


@REGISTRY.add("overlapping_ranges", f"""
SELECT book_id, page, seq FROM (SELECT *, max(end_line) OVER (PARTITION BY book_id, page ORDER BY start_line, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM {C.duck(_RANGES)}) WHERE far >= start_line""")
def overlapping_ranges(spark, sf):
    return Q.overlaps(C.frame(spark, sf, _RANGES)).select("book_id", "page", "seq")


@REGISTRY.add("grant_rules", f"""
WITH q AS (SELECT *, seq % 5 = 0 AS mixed, seq % 3 <> 0 AS viewed, CASE WHEN page % 5 = 0 THEN 'duplicates' ELSE 'missing' END AS phase FROM
 (SELECT book_id, page, seq, start_line % 4 AS s, CASE WHEN end_line % 4 = 3 THEN 0 ELSE end_line % 4 + 1 END AS e FROM {C.duck(_RANGES)})),
z AS (SELECT q.*, greatest(1, len(string_split(rtrim(tex, chr(10)), chr(10)))) AS n, CASE WHEN e = 0 THEN n ELSE e END AS e2 FROM q JOIN ({C.TEX_PAGES}) t ON t.book_id = q.book_id AND t.page = q.page)
SELECT book_id, page, 'REFERENCE_REPAIR_SCOPE' AS code, seq || ':' || s AS detail FROM z WHERE phase <> 'missing' OR NOT viewed OR NOT (1 <= s AND s <= e2 AND e2 <= n)
UNION ALL SELECT book_id, page, 'REFERENCE_ACTION', seq || ':' || s FROM z WHERE mixed
UNION ALL SELECT book_id, page, 'REFERENCE_REPAIR_SCOPE', seq || ':' || s || ' overlap' FROM (SELECT *, max(e2) OVER (PARTITION BY book_id, page ORDER BY s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM z) WHERE far >= s""")
def grant_rules(spark, sf):
    end = F.col("end_line") % 4
    rows = C.frame(spark, sf, _RANGES).withColumn("start_line", F.col("start_line") % 4).withColumn("end_line", F.when(end == 3, 0).otherwise(end + 1))
    requests = (
        rows.withColumn("mixed", F.col("seq") % 5 == 0).withColumn("viewed", F.col("seq") % 3 != 0)
        .withColumn("phase", F.when(F.col("page") % 5 == 0, "duplicates").otherwise("missing")).withColumn("reason", F.lit("seen on the page"))
    )
    return Q.check_grants(requests, C.tex_pages(spark, sf))


@REGISTRY.add("run_page_scope", f"""
SELECT r.id AS request_id, CASE WHEN end_page > page_count OR start_page + 15 > page_count THEN 'PAGE_SCOPE' END AS code
FROM {C.duck(C.BOOK_RUNS)} r JOIN {C.duck(C.BOOKS)} b ON b.id = r.book_id""")
def run_page_scope(spark, sf):
    """Requests inside and outside their book."""
    requests = C.frame(spark, sf, C.BOOK_RUNS).select(
        F.col("id").cast("string").alias("request_id"), "book_id", "end_page", F.array("start_page", F.col("start_page") + 15).alias("setup_pages"))
    good, bad = Q.in_page_scope(requests, C.frame(spark, sf, C.BOOKS).select(F.col("id").alias("book_id"), "page_count"))
    rows = good.select("request_id", F.lit(None).cast("string").alias("code")).union(bad.select("detail", "code"))
    return rows.withColumn("request_id", F.col("request_id").cast("bigint"))
