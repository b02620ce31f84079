"""Queries on tokens, environments and section scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import environments as E
from ..operators import markup as M
from ..operators import scope as S
from ..session import cut_lineage
from . import corpora as C
from .registry import Registry

REGISTRY = Registry()


@REGISTRY.add("page_markers", f'SELECT book_id, page, command, key, start, "end" FROM ({C.DUCK_MARKERS})')
def page_markers(spark, sf):
    found = M.markers(C.tex_pages(spark, sf))
    return found.select("book_id", "page", "command", "key", F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@REGISTRY.add("symbol_index", f'''
SELECT s.book_id, s.page, id, category, command, s.key, kind, number, kind || ':' || number AS namespace, s.start, s."end",
 substr(masked, greatest(0, start - 100) + 1, s."end" + 100 - greatest(0, start - 100)) AS context
FROM ({C.DUCK_SYMBOLS}) s JOIN (
 SELECT book_id, page, string_agg(CASE WHEN kind = 3 AND flag = 'A' THEN repeat(' ', length(frag) - 1) || chr(10) ELSE frag END, '' ORDER BY seq) AS masked
 FROM {C.duck(C.FRAGMENTS)} GROUP BY ALL) t ON s.book_id = t.book_id AND s.page = t.page''')
def symbol_index(spark, sf):
    found = M.symbols(C.tex_pages(spark, sf))
    return found.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


@REGISTRY.add("compact_symbols", f"SELECT book_id, page, id, category, command, key, kind, number, kind || ':' || number AS namespace FROM ({C.DUCK_SYMBOLS})")
def compact_symbols(spark, sf):
    return M.compact(M.symbols(C.tex_pages(spark, sf), with_context=False))


@REGISTRY.add("visible_markers", f"""
SELECT book_id, page, command, count(*) AS n FROM ({C.DUCK_MARKERS}) m
WHERE NOT (command = 'ref' AND key LIKE 'lemma:%' AND EXISTS (
  SELECT 1 FROM {C.duck(C.FRAGMENTS)} f WHERE f.book_id = m.book_id AND f.page = m.page AND f.seq = m.seq AND f.kind = 3 AND f.flag = 'R'))
GROUP BY ALL""")
def visible_markers(spark, sf):
    found = M.visible_markers(C.tex_pages(spark, sf))
    return found.groupBy("book_id", "page", "command").agg(F.count("*").alias("n"))


@REGISTRY.add("comment_rules", f"""
SELECT book_id, page,
 string_agg(CASE WHEN kind = 3 AND flag = 'A' THEN repeat(' ', length(frag) - 1) || chr(10) ELSE frag END, '' ORDER BY seq) AS masked,
 string_agg(CASE WHEN kind = 3 AND flag = 'A' THEN chr(10) WHEN kind = 3 AND flag = 'R' THEN chr(92) || chr(92) || chr(10) ELSE frag END, '' ORDER BY seq) AS stripped
FROM {C.duck(C.FRAGMENTS)} GROUP BY ALL""")
def comment_rules(spark, sf):
    """The two comment rules, which differ after a doubled backslash."""
    return C.tex_pages(spark, sf).select(
        "book_id", "page", X.mask_comments(F.col("tex")).alias("masked"), X.strip_comments(F.col("tex")).alias("stripped"))


@REGISTRY.add("environment_tokens", f"""
SELECT book_id, page, op, name, start, line,
 CASE op WHEN 'begin' THEN row_number() OVER (PARTITION BY book_id, page, op ORDER BY start) END AS ordinal
FROM ({C.DUCK_ENV_TOKENS})""")
def environment_tokens(spark, sf):
    found = M.env_tokens(C.tex_pages(spark, sf))
    return found.select("book_id", "page", "op", "name", *[F.col(c).cast("bigint") for c in ("start", "line", "ordinal")])


@REGISTRY.add("page_lines", f"""
SELECT book_id, page, line, text FROM (
 SELECT book_id, page, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (
  SELECT book_id, page, string_split(rtrim(tex, chr(10)), chr(10)) AS l FROM ({C.TEX_PAGES})))""")
def page_lines(spark, sf):
    return M.lines(C.tex_pages(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


@REGISTRY.add("document_offsets", f"""
SELECT book_id, page, length(tex) AS length,
 CAST(sum(length(tex)) OVER (PARTITION BY book_id ORDER BY page) - length(tex) AS BIGINT) AS "offset" FROM ({C.TEX_PAGES})""")
def document_offsets(spark, sf):
    return M.document_offsets(C.tex_pages(spark, sf))


@REGISTRY.add("label_line_numbers", f"""
SELECT m.book_id, m.page, m.start, length(substr(tex, 1, start)) - length(replace(substr(tex, 1, start), chr(10), '')) + 1 AS line
FROM ({C.DUCK_MARKERS}) m JOIN ({C.TEX_PAGES}) t ON m.book_id = t.book_id AND m.page = t.page WHERE command = 'label'""")
def label_line_numbers(spark, sf):
    pages = C.tex_pages(spark, sf)
    labels = M.markers(pages).filter(F.col("command") == "label").select("book_id", "page", "start")
    return labels.join(pages, ["book_id", "page"]).select(
        "book_id", "page", F.col("start").cast("bigint"), X.line_of(F.col("tex"), F.col("start")).cast("bigint").alias("line"))


@REGISTRY.add("layout_fingerprints", f"""
SELECT book_id, page, sha256(string_agg(replace(replace(CASE
  WHEN kind IN (2, 3, 4, 6, 7) THEN regexp_replace(frag, chr(92) || chr(92) || '(label|ref|eqref|nameref)' || chr(92) || '{{[^{{}}]+' || chr(92) || '}}', chr(92) || '1{{}}', 'g') ELSE frag END, '', ''), '', ''), '' ORDER BY seq)) AS layout
FROM {C.duck(C.FRAGMENTS)} GROUP BY ALL""")
def layout_fingerprints(spark, sf):
    return M.layout_fingerprint(C.tex_pages(spark, sf))


@REGISTRY.add("line_end_space", """
SELECT doc_id, replace(replace(regexp_replace(spaced, '[ \\t]+\\n', chr(10), 'g'), '', ''), '', '') AS "view",
 length(spaced) - length(regexp_replace(spaced, '[ \\t]+\\n', chr(10), 'g')) AS removed
FROM (SELECT doc_id, replace(text, '. ', '. ' || chr(9) || chr(10)) AS spaced FROM documents)""")
def line_end_space(spark, sf):
    docs = C.load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit(". \t\n")).alias("spaced"))
    viewed = M.space_view(docs, "spaced")
    last = F.element_at("runs", -1)
    return viewed.select("doc_id", "view", (last["source"] - last["view"]).cast("bigint").alias("removed"))


# --- environments -------------------------------------------------------------------------------------------

_DEPTH = """
SELECT *, CASE op WHEN 'begin' THEN s - floor_s ELSE s + 1 - floor_s END AS depth FROM (
 SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY book_id, name ORDER BY page, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS floor_s FROM (
  SELECT *, sum(CASE op WHEN 'begin' THEN 1 ELSE -1 END) OVER (PARTITION BY book_id, name ORDER BY page, start) AS s FROM (
   SELECT *, CASE op WHEN 'begin' THEN row_number() OVER (PARTITION BY book_id, page, op ORDER BY start) END AS ordinal
   FROM ({tokens}) WHERE op <> 'label')))
"""


def _pairs_sql(tokens: str) -> str:
    depth = _DEPTH.format(tokens=tokens)
    return f"""
SELECT book_id, name, 'env-' || page || '-' || ordinal AS id, page AS begin_page, line AS begin_line, start AS begin_offset,
 CASE WHEN next_op = 'end' THEN next_page END AS end_page, CASE WHEN next_op = 'end' THEN next_line END AS end_line, CASE WHEN next_op = 'end' THEN next_start END AS end_offset
FROM (SELECT *, lead(op) OVER w AS next_op, lead(page) OVER w AS next_page, lead(line) OVER w AS next_line, lead(start) OVER w AS next_start
 FROM ({depth}) WHERE depth > 0 WINDOW w AS (PARTITION BY book_id, name, depth ORDER BY page, start))
WHERE op = 'begin'"""


def _unmatched_sql(tokens: str) -> str:
    return f"""
SELECT book_id, 'end-' || page || '-' || row_number() OVER (PARTITION BY book_id, page ORDER BY start) AS id, name, page, line, start AS "offset"
FROM ({_DEPTH.format(tokens=tokens)}) WHERE depth <= 0"""


def _wide(nodes):
    return nodes.select(*[
        F.col(c).cast("bigint").alias(c) if c.split("_")[-1] in ("page", "line", "offset") else F.col(c) for c in nodes.columns])


@REGISTRY.add("paired_environments", _pairs_sql(C.DUCK_ENV_TOKENS))
def paired_environments(spark, sf):
    return _wide(E.pair_independent(M.env_tokens(C.tex_pages(spark, sf)))[0])


@REGISTRY.add("unmatched_ends", _unmatched_sql(C.DUCK_ENV_TOKENS))
def unmatched_ends(spark, sf):
    return _wide(E.pair_independent(M.env_tokens(C.tex_pages(spark, sf)))[1])


_HTML = "</?[A-Za-z][A-Za-z0-9]*[^<>]*>"
_VOID = "('br', 'meta', 'img', 'hr', 'input', 'link')"
DUCK_HTML_TOKENS = f"""
SELECT book_id, 1 AS page, CASE WHEN starts_with(token, '</') THEN 'end' ELSE 'begin' END AS op, name, n AS start, CAST(0 AS BIGINT) AS line
FROM (SELECT book_id, token, n, regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1) AS name FROM (
 SELECT book_id, unnest(t) AS token, generate_subscripts(t, 1) AS n FROM (
  SELECT page_id AS book_id, regexp_extract_all(html, '{_HTML}') AS t FROM pages)))
WHERE lower(name) NOT IN {_VOID}"""


@REGISTRY.add("html_tag_pairs", f"""
SELECT book_id, name, count(*) AS opened, count(end_page) AS closed FROM ({_pairs_sql(DUCK_HTML_TOKENS)}) GROUP BY ALL""")
def html_tag_pairs(spark, sf):
    """The pairing rule pointed at HTML: opened and closed tags per page and name."""
    nodes, _ = E.pair_independent(M.env_tokens(C.frame(spark, sf, C.HTML_PAGES), M.HTML))
    return nodes.groupBy("book_id", "name").agg(F.count("*").alias("opened"), F.count("end_page").alias("closed"))


# The strict rule as a recursive walk over each book's tokens, one token per step.
_STRICT = f"""
WITH RECURSIVE toks AS (
 SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, start) AS i,
  CASE op WHEN 'begin' THEN row_number() OVER (PARTITION BY book_id, page, op ORDER BY start) END AS ordinal FROM ({C.DUCK_ENV_TOKENS})),
walk AS (
 SELECT book_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(name VARCHAR, id VARCHAR, label VARCHAR)[]) AS stack,
  CAST(NULL AS VARCHAR) AS closed, CAST(NULL AS VARCHAR) AS closed_label, CAST(NULL AS VARCHAR) AS bad
 FROM (SELECT DISTINCT book_id FROM toks)
 UNION ALL
 SELECT w.book_id, t.i,
  CASE
   WHEN t.op = 'begin' THEN list_append(w.stack, {{'name': t.name, 'id': 'env-' || t.page || '-' || t.ordinal, 'label': ''}})
   WHEN t.op = 'end' AND len(w.stack) > 0 AND w.stack[-1].name = t.name THEN w.stack[1:len(w.stack) - 1]
   WHEN t.op = 'label' AND len(w.stack) > 0 AND w.stack[-1].label = ''
    AND split_part(t.name, ':', 1) = CASE w.stack[-1].name WHEN 'displaymath' THEN 'equation' ELSE w.stack[-1].name END
    THEN list_append(w.stack[1:len(w.stack) - 1], {{'name': w.stack[-1].name, 'id': w.stack[-1].id, 'label': t.name}})
   ELSE w.stack END,
  CASE WHEN t.op = 'end' AND len(w.stack) > 0 AND w.stack[-1].name = t.name THEN w.stack[-1].id END,
  CASE WHEN t.op = 'end' AND len(w.stack) > 0 AND w.stack[-1].name = t.name THEN w.stack[-1].label END,
  CASE WHEN t.op = 'end' AND NOT (len(w.stack) > 0 AND w.stack[-1].name = t.name) THEN t.name END
 FROM walk w JOIN toks t ON t.book_id = w.book_id AND t.i = w.i + 1)
"""


@REGISTRY.add("strict_pairs", _STRICT + """
SELECT w.book_id, closed AS id, closed_label AS label, t.page AS end_page, t.start AS end_offset
FROM walk w JOIN toks t ON t.book_id = w.book_id AND t.i = w.i WHERE closed IS NOT NULL
UNION ALL
SELECT book_id, s.id, s.label, NULL, NULL FROM (
 SELECT book_id, unnest(stack) AS s FROM walk w WHERE i = (SELECT max(i) FROM toks t WHERE t.book_id = w.book_id))""")
def strict_pairs(spark, sf):
    nodes, _ = E.pair_strict(C.tex_pages(spark, sf))
    return _wide(nodes).select("book_id", "id", "label", "end_page", "end_offset")


@REGISTRY.add("strict_unmatched", _STRICT + """
SELECT w.book_id, 'end-' || t.page || '-' || row_number() OVER (PARTITION BY w.book_id, t.page ORDER BY t.start) AS id, t.name, t.page, t.line, t.start AS "offset"
FROM walk w JOIN toks t ON t.book_id = w.book_id AND t.i = w.i WHERE bad IS NOT NULL""")
def strict_unmatched(spark, sf):
    return _wide(E.pair_strict(C.tex_pages(spark, sf))[1])


@REGISTRY.add("open_environments", _STRICT + """
SELECT book_id, s.name, s.label, CAST(split_part(s.id, '-', 2) AS BIGINT) AS begin_page, count(*) AS n FROM (
 SELECT book_id, unnest(stack) AS s FROM walk w WHERE i = (SELECT max(i) FROM toks t WHERE t.book_id = w.book_id)) GROUP BY ALL""")
def open_environments(spark, sf):
    report = E.open_report(E.pair_strict(C.tex_pages(spark, sf))[0])
    return report.groupBy("book_id", "name", "label", "begin_page").agg(F.count("*").alias("n"))


_OBLIGATIONS = f"""
SELECT n.book_id, n.id, n.name, n.begin_page, n.begin_line, n.begin_offset, n.end_page,
 CASE WHEN NOT b.is_last AND (n.end_page IS NULL OR n.end_page > b.last_page) THEN b.last_page WHEN n.end_page IS NULL THEN n.begin_page END AS boundary_page
FROM ({_pairs_sql(C.DUCK_ENV_TOKENS)}) n JOIN {C.duck(C.BATCH_PAGES)} b ON n.book_id = b.book_id AND n.begin_page = b.page"""


@REGISTRY.add("seam_obligations", f"""
SELECT book_id, id, name, begin_page, boundary_page, CASE WHEN end_page IS NULL THEN 'pending' ELSE 'resolved' END AS status
FROM ({_OBLIGATIONS}) WHERE boundary_page IS NOT NULL""")
def seam_obligations(spark, sf):
    nodes, _ = E.pair_independent(M.env_tokens(C.tex_pages(spark, sf)))
    return E.obligations(nodes, C.frame(spark, sf, C.BATCH_PAGES)).select(
        "book_id", "id", "name", "begin_page", "boundary_page", "status")


def _pairs(spark, sf):
    """Pairs and unmatched closings as stage tables: several operators read them."""
    nodes, unmatched = E.pair_independent(cut_lineage(M.env_tokens(C.tex_pages(spark, sf))))
    return cut_lineage(nodes), cut_lineage(unmatched)


def _todos(spark, sf):
    nodes, unmatched = _pairs(spark, sf)
    batches = C.frame(spark, sf, C.BATCH_PAGES)
    return E.todos(nodes, unmatched, batches), nodes, unmatched, batches


_TODOS = f"""
SELECT book_id, id, name, 'unclosed' AS kind, begin_page, begin_line, begin_offset AS "offset", boundary_page
FROM ({_OBLIGATIONS}) WHERE end_page IS NULL
UNION ALL SELECT book_id, id, name, 'unmatched_end', page, line, "offset", page FROM ({_unmatched_sql(C.DUCK_ENV_TOKENS)})"""


@REGISTRY.add("environment_verdict", f"""
SELECT book_id, CAST(count(*) FILTER (WHERE NOT (begin_page % 2 = 0 AND kind = 'unclosed')) AS BIGINT) AS pending,
 CASE WHEN count(*) FILTER (WHERE NOT (begin_page % 2 = 0 AND kind = 'unclosed')) > 0 THEN 'PENDING' ELSE 'PASSED' END AS status
FROM ({_TODOS}) GROUP BY book_id""")
def environment_verdict(spark, sf):
    """Todos joined to recorded resolutions (here: unclosed ones on even pages), and the verdict per book."""
    pending, *_ = _todos(spark, sf)
    done = pending.filter((F.col("kind") == "unclosed") & (F.col("begin_page") % 2 == 0)).select(
        "book_id", "id", F.col("boundary_page").alias("closing_page"))
    return E.env_verdict(E.todo_status(pending, done))


@REGISTRY.add("todo_neighbourhood", f"""
SELECT t.book_id, id, kind, array_to_string(list_filter([CASE WHEN kind = 'unmatched_end' THEN prev_page END, boundary_page, next_page], lambda x: x IS NOT NULL), ',') AS pages
FROM ({_TODOS}) t JOIN (
 SELECT book_id, page, lag(page) OVER (PARTITION BY book_id ORDER BY page) AS prev_page, lead(page) OVER (PARTITION BY book_id ORDER BY page) AS next_page
 FROM {C.duck(C.BATCH_PAGES)}) b ON t.book_id = b.book_id AND t.boundary_page = b.page""")
def todo_neighbourhood(spark, sf):
    from ..operators.seams import page_neighbours

    pending, _, _, batches = _todos(spark, sf)
    near = E.neighbourhood(pending, page_neighbours(batches.select("book_id", "page")))
    return near.select("book_id", "id", "kind", F.array_join("pages", ",").alias("pages"))


@REGISTRY.add("nearest_closed_pair", f"""
SELECT u.book_id, u.id, u.name, u.page, u.line, n.begin_page AS near_begin_page, n.begin_line AS near_begin_line, n.end_page AS near_end_page, n.end_line AS near_end_line
FROM ({_unmatched_sql(C.DUCK_ENV_TOKENS)}) u LEFT JOIN LATERAL (
 SELECT * FROM ({_pairs_sql(C.DUCK_ENV_TOKENS)}) n WHERE n.book_id = u.book_id AND n.name = u.name AND n.end_page IS NOT NULL
  AND (n.end_page < u.page OR (n.end_page = u.page AND n.end_line < u.line))
 ORDER BY n.end_page DESC, n.end_line DESC, n.begin_page, n.begin_offset LIMIT 1) n ON true""")
def nearest_closed_pair(spark, sf):
    nodes, unmatched = _pairs(spark, sf)
    return _wide(E.nearest_closed(unmatched, nodes))


@REGISTRY.add("nearest_opening", f"""
SELECT book_id, id, name, begin_page, begin_line, begin_offset FROM (
 SELECT t.book_id, t.id, t.name, t.begin_page, n.begin_line, n.begin_offset,
  row_number() OVER (PARTITION BY t.book_id, t.id ORDER BY abs(n.begin_line - t.begin_line - 1), n.begin_offset) AS r
 FROM ({_TODOS}) t JOIN ({_pairs_sql(C.DUCK_ENV_TOKENS)}) n ON t.book_id = n.book_id AND t.name = n.name AND t.begin_page = n.begin_page
 WHERE t.kind = 'unclosed') WHERE r = 1""")
def nearest_opening(spark, sf):
    """Openings found again when their recorded line is one too low."""
    pending, nodes, *_ = _todos(spark, sf)
    moved = pending.filter(F.col("kind") == "unclosed").withColumn("begin_line", F.col("begin_line") + 1)
    return _wide(E.nearest_opening(moved, nodes))


@REGISTRY.add("tracked_pairs", f"""
SELECT t.book_id, t.id AS token_id, n.id AS env_id, n.end_page FROM ({_TODOS}) t LEFT JOIN ({_pairs_sql(C.DUCK_ENV_TOKENS)}) n
ON t.book_id = n.book_id AND t.name = n.name AND ((t.kind = 'unclosed' AND n.begin_page = t.begin_page AND n.begin_offset = t."offset")
 OR (t.kind = 'unmatched_end' AND n.end_page = t.begin_page AND n.end_offset = t."offset"))""")
def tracked_pairs(spark, sf):
    pending, nodes, *_ = _todos(spark, sf)
    found = E.pair_of(pending.withColumnRenamed("begin_page", "page"), nodes)
    return found.select("book_id", "token_id", "env_id", "end_page")


# --- scope and counters -------------------------------------------------------------------------------------

_LEVEL = "list_position(['part', 'chapter', 'section', 'subsection', 'subsubsection'], level) - 1"
_MARKED = f"""
SELECT m.book_id, m.page, m.command, m.key, m.start, CAST(m.page * 4294967296 + m.start AS BIGINT) AS pos, h.number AS hnumber,
 CASE WHEN m.command = 'BAHeading' THEN {_LEVEL} END AS lvl
FROM ({C.DUCK_MARKERS}) m LEFT JOIN {C.duck(C.HEADINGS)} h ON m.book_id = h.book_id AND m.key = h.id AND m.command = 'BAHeading'"""
_LAST = ", ".join(
    f"last_value(CASE WHEN lvl = {n} THEN {{'pos': pos, 's': lvl || '/' || hnumber || '/' || key}} END IGNORE NULLS) OVER w AS s{n}" for n in range(5))
_OPEN = ", ".join(
    f"CASE WHEN s{n}.pos > " + ("greatest(" + ", ".join(f"coalesce(s{m}.pos, -1)" for m in range(n)) + ", -1)" if n else "-1") + f" THEN s{n}.s END"
    for n in range(5))


@REGISTRY.add("heading_scope", f"""
SELECT book_id, page, command, key, start, array_to_string(list_filter([{_OPEN}], lambda x: x IS NOT NULL), ' > ') AS scope
FROM (SELECT *, {_LAST} FROM ({_MARKED}) WINDOW w AS (PARTITION BY book_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""")
def heading_scope(spark, sf):
    scoped = S.heading_scope(M.markers(C.tex_pages(spark, sf)), C.frame(spark, sf, C.HEADINGS))
    shown = F.transform("scope", lambda s: F.concat_ws("/", s["level"].cast("string"), s["number"], s["id"]))
    return scoped.select("book_id", "page", "command", "key", F.col("start").cast("bigint"), F.array_join(shown, " > ").alias("scope"))


@REGISTRY.add("marker_headings", f"""
SELECT m.book_id, m.page, m.key, m.start, h.level, h.number, h.title FROM ({C.DUCK_MARKERS}) m
JOIN {C.duck(C.HEADINGS)} h ON m.book_id = h.book_id AND m.key = h.id WHERE command = 'BAHeading'""")
def marker_headings(spark, sf):
    found = M.markers(C.tex_pages(spark, sf)).filter(F.col("command") == "BAHeading")
    return S.with_headings(found, C.frame(spark, sf, C.HEADINGS)).select(
        "book_id", "page", "key", F.col("start").cast("bigint"), "level", "number", "title")
