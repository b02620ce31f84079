"""Queries on project files, bodies, logs, the library, provenance, scans and renderings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scan import ranked
from ..operators import library as LB
from ..operators import snapshots as S
from ..session import cut_lineage, stage_folder
from ..sources import readers as RD
from ..sources import sinks as SK
from . import corpora as C
from .reference_queries import RULES, SEEDS, SETUPS
from .registry import Registry

REGISTRY = Registry()
BEFORE = C.duck(C.FILES_BEFORE)
AFTER = C.duck(C.FILES_AFTER)


def _files(spark, sf, sql):
    return C.frame(spark, sf, sql).withColumn("sha256", F.sha2("content", 256))


def _scratch(spark) -> str:
    return f"{stage_folder(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"


# --- snapshots -----------------------------------------------------------------------------------------------

_MEMBER = "sha256(path || chr(0) || sha256(content))"


def _hash_sql(files: str) -> str:
    """A plain Merkle root: leaves by the first six hex digits of their hash, then nodes by four, two and none."""
    out = f"(SELECT project_id, {_MEMBER} AS node, {_MEMBER} AS digest, 1 AS n FROM {files})"
    for digits in (6, 4, 2, 0):
        out = (f"(SELECT project_id, substr(node, 1, {digits}) AS node, sha256('{digits}:' || string_agg(digest, '' ORDER BY node, digest)) AS digest, sum(n) AS n "
               f"FROM {out} GROUP BY project_id, substr(node, 1, {digits}))")
    return f"SELECT project_id, digest AS content_hash, CAST(n AS BIGINT) AS files FROM {out}"


@REGISTRY.add("content_hashes", _hash_sql(BEFORE))
def content_hashes(spark, sf):
    return S.content_hash(_files(spark, sf, C.FILES_BEFORE))


@REGISTRY.add("manifest_diff", f"""
SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'added' ELSE 'changed' END AS status
FROM {BEFORE} a FULL JOIN {AFTER} b ON a.project_id = b.project_id AND a.path = b.path WHERE a.content IS DISTINCT FROM b.content""")
def manifest_diff(spark, sf):
    return S.manifest_diff(_files(spark, sf, C.FILES_BEFORE), _files(spark, sf, C.FILES_AFTER))


@REGISTRY.add("unlisted_files", f"SELECT project_id, path FROM {AFTER} a WHERE NOT EXISTS (SELECT 1 FROM {BEFORE} b WHERE b.project_id = a.project_id AND b.path = a.path)")
def unlisted_files(spark, sf):
    return S.unlisted_files(_files(spark, sf, C.FILES_AFTER), _files(spark, sf, C.FILES_BEFORE)).select("project_id", "path")


_ODD_PATHS = """SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS project_id, CASE p_partkey % 11
 WHEN 0 THEN concat('a/.git/', p_name, '.tex') WHEN 1 THEN concat(p_name, '-session.json') WHEN 2 THEN concat('x/', p_name, '.EXE') WHEN 3 THEN concat('/abs/', p_name, '.tex')
 WHEN 4 THEN concat('a/../', p_name, '.tex') WHEN 5 THEN concat('a/CON.tex') WHEN 6 THEN concat('b/', p_name, '.PNG') WHEN 7 THEN concat('notes/', p_name, '.md')
 WHEN 8 THEN concat('q/what?.tex') WHEN 9 THEN concat('dir./', p_name, '.tex') ELSE concat(p_name, '.tex') END AS path, p_partkey FROM @part"""


@REGISTRY.add("project_files", f"SELECT project_id, p_partkey, path FROM {C.duck(_ODD_PATHS)} WHERE p_partkey % 11 IN (3, 4, 5, 6, 8, 9, 10) AND NOT (p_partkey % 11 = 4)")
def project_files(spark, sf):
    return S.project_files(C.frame(spark, sf, _ODD_PATHS)).select("project_id", "p_partkey", "path")


@REGISTRY.add("safe_paths", f"SELECT p_partkey, path, p_partkey % 11 IN (1, 6, 7, 10) AS safe FROM {C.duck(_ODD_PATHS)}")
def safe_paths(spark, sf):
    return C.frame(spark, sf, _ODD_PATHS).select("p_partkey", "path", S.safe_path(F.col("path")).alias("safe"))


@REGISTRY.add("reassembled_bodies", f"""
SELECT a.project_id, coalesce(a.body = b.body, false) AS same FROM (SELECT project_id, string_agg(content, '' ORDER BY ord) AS body FROM {BEFORE} GROUP BY ALL) a
LEFT JOIN (SELECT project_id, string_agg(content, '' ORDER BY ord) AS body FROM {AFTER} GROUP BY ALL) b ON a.project_id = b.project_id""")
def reassembled_bodies(spark, sf):
    """Whether the later parts of a project, cut anew in the middle of their lines, still add up to the earlier body."""
    middle = F.floor(F.length("content") / 2).cast("int")
    halves = F.array(F.left("content", middle), F.substr("content", middle + 1, F.length("content")))
    parts = _files(spark, sf, C.FILES_AFTER).select("project_id", "ord", F.posexplode(halves).alias("half", "content"))
    return S.reassembles(parts.withColumn("ord", F.col("ord") * 2 + F.col("half")), _files(spark, sf, C.FILES_BEFORE))


@REGISTRY.add("boundary_errors", f"""
SELECT project_id, path FROM {BEFORE} b WHERE p_size % 6 = 0 AND ord < (SELECT max(ord) FROM {BEFORE} c WHERE c.project_id = b.project_id)""")
def boundary_errors(spark, sf):
    cut = F.when(F.col("p_size") % 6 == 0, F.regexp_replace("content", r"\n$", "")).otherwise(F.col("content"))
    return S.boundary_errors(_files(spark, sf, C.FILES_BEFORE).withColumn("content", cut)).select("project_id", "path")


def _manifest(spark, sf):
    """A project as it was (body.tex with all text) and reorganised (a manifest and its parts), with some damage."""
    parts = _files(spark, sf, C.FILES_BEFORE).filter(F.endswith("path", F.lit(".tex")))
    joined = parts.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("ord", "content", "path"))).alias("p"))
    body = joined.select("project_id", F.lit("body.tex").alias("path"), F.array_join(F.transform("p", lambda x: x["content"]), "").alias("content"))
    extra = joined.select("project_id", F.lit("main.tex").alias("path"), F.lit("main").alias("content"))
    before = body.unionByName(extra).withColumn("sha256", F.sha2("content", 256))
    names = F.transform("p", lambda x: F.concat(F.lit("\\input{"), F.regexp_replace(x["path"], r"\.tex$", ""), F.lit("}\n")))
    manifest = joined.select("project_id", F.lit("body.tex").alias("path"), F.concat(F.array_join(names, ""), F.when(F.col("project_id") % 9 == 1, "stray text").otherwise("")).alias("content"))
    n = F.col("project_id") % 9
    kept = parts.select("project_id", "path", F.when((n == 2) & (F.col("ord") % 20 == 1), F.concat("content", F.lit("!\n"))).otherwise(F.col("content")).alias("content"))
    main = extra.withColumn("content", F.when(n == 3, "changed").otherwise("main"))
    strange = joined.filter(n == 4).select("project_id", F.lit("new.tex").alias("path"), F.lit("x").alias("content"))
    after = kept.unionByName(main).unionByName(strange).unionByName(manifest).withColumn("sha256", F.sha2("content", 256))
    return before, after, manifest.select("project_id", "content")


@REGISTRY.add("structure_checks", f"""
WITH p AS (SELECT project_id, bool_or(ord % 20 = 1) AS hit FROM {BEFORE} WHERE path LIKE '%.tex' GROUP BY ALL)
SELECT project_id, 'STRUCTURE_MANIFEST' AS code, 'body.tex' AS path FROM p WHERE project_id % 9 = 1
UNION ALL SELECT project_id, 'STRUCTURE_CONTENT', 'body.tex' FROM p WHERE project_id % 9 = 2 AND hit
UNION ALL SELECT project_id, 'STRUCTURE_CHANGED', 'main.tex' FROM p WHERE project_id % 9 = 3
UNION ALL SELECT project_id, 'STRUCTURE_FILES', 'new.tex' FROM p WHERE project_id % 9 = 4""")
def structure_checks(spark, sf):
    return S.check_structure(*_manifest(spark, sf))


@REGISTRY.add("template_checks", f"""
SELECT project_id, 'TEMPLATE_CONTENT_CHANGED' AS code, path FROM (
 SELECT a.project_id, a.path, a.p_size, b.content AS now, a.content AS was FROM {BEFORE} a LEFT JOIN {AFTER} b ON a.project_id = b.project_id AND a.path = b.path WHERE a.path NOT LIKE 'sections/red-%') WHERE now IS DISTINCT FROM was
UNION ALL SELECT DISTINCT project_id, 'TEMPLATE_CONTENT_CHANGED', 'main.tex' FROM {BEFORE} WHERE project_id % 4 IN (1, 2)""")
def template_checks(spark, sf):
    """Files changed outside the style layer; the main file may gain one hook before the document begins."""
    before, after = _files(spark, sf, C.FILES_BEFORE), _files(spark, sf, C.FILES_AFTER)
    layer = lambda f: f.withColumn("path", F.regexp_replace("path", "^sections/red-", "style/red-"))
    hook, n = "\\input{style-hook.tex}", F.col("project_id") % 4
    main = before.select("project_id").distinct().withColumn("path", F.lit("main.tex")).withColumn("content", F.lit("a\n\\begin{document}\nb"))
    late = F.lit("a\n\\begin{document}\n" + hook + "\nb")
    hooked = F.when(n == 0, F.lit("a\n" + hook + "\n\\begin{document}\nb")).when(n == 1, late).when(n == 2, F.lit(hook + hook + "a\n\\begin{document}\nb")).otherwise(F.col("content"))
    keep = ["project_id", "path", "content"]
    return S.check_template(layer(before).select(*keep).unionByName(main), layer(after).select(*keep).unionByName(main.withColumn("content", hooked)), hook, ("style",))


@REGISTRY.add("output_checks", f"""
SELECT a.project_id, 'OUTPUT_CHANGED' AS code FROM ({_hash_sql(BEFORE)}) a LEFT JOIN ({_hash_sql(AFTER)}) b ON a.project_id = b.project_id WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def output_checks(spark, sf):
    return S.check_output(S.content_hash(_files(spark, sf, C.FILES_BEFORE)), _files(spark, sf, C.FILES_AFTER))


@REGISTRY.add("retained_snapshots", f"""
SELECT b.project_id, b.content_hash, b.files, b.project_id || '-' || substr(b.content_hash, 1, 16) AS id, b.project_id % 3 = 0 AND a.content_hash = b.content_hash AS reused
FROM ({_hash_sql(AFTER)}) b JOIN ({_hash_sql(BEFORE)}) a ON a.project_id = b.project_id""")
def retained_snapshots(spark, sf):
    kept = S.content_hash(_files(spark, sf, C.FILES_BEFORE)).filter("project_id % 3 = 0")
    return S.retain(_files(spark, sf, C.FILES_AFTER), kept)


@REGISTRY.add("changed_sources", "SELECT p_partkey AS id, 'SOURCE_CHANGED' AS code FROM part WHERE p_size % 9 = 0 OR p_size % 8 = 0")
def changed_sources(spark, sf):
    rows = C.load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("sha256"), "p_size")
    now = rows.filter("p_size % 8 <> 0").withColumn("sha256", F.when(F.col("p_size") % 9 == 0, "other").otherwise(F.col("sha256")))
    return S.changed_sources(rows.select("id", "sha256"), now.select("id", "sha256"))


# --- the library ---------------------------------------------------------------------------------------------

BOOKS = C.duck(C.BOOKS)


def _books(spark, sf):
    return C.frame(spark, sf, C.BOOKS)


@REGISTRY.add("library_split", f"SELECT id, coalesce(deleted, false) AS trash FROM {BOOKS}")
def library_split(spark, sf):
    books = _books(spark, sf)
    return LB.split_library(books, False).select("id", F.lit(False).alias("trash")).union(LB.split_library(books, True).select("id", F.lit(True).alias("trash")))


@REGISTRY.add("title_matches", f"SELECT id, title FROM {BOOKS} WHERE contains(lower(title), 'omer#00000001')")
def title_matches(spark, sf):
    return LB.title_filter(_books(spark, sf), " OMER#00000001 ").select("id", "title")


@REGISTRY.add("library_order", f"""
SELECT id, row_number() OVER (ORDER BY id DESC) AS recent, row_number() OVER (ORDER BY id) AS title, row_number() OVER (ORDER BY page_count DESC, id DESC) AS pages FROM {BOOKS}""")
def library_order(spark, sf):
    """Places of all books in the three orders; titles carry their numbers without padding."""
    books = _books(spark, sf).withColumn("title", F.concat(F.lit("Book "), F.col("id").cast("string"))).select("id", "title", "page_count")
    for key in ("recent", "title", "pages"):
        placed, _ = ranked(books, LB.library_keys(key), "_place")
        books = placed.withColumn(key + "_place", F.col("_place") + 1).drop("_place")
    return books.select("id", *[F.col(k + "_place").alias(k) for k in ("recent", "title", "pages")])


@REGISTRY.add("sorted_library", f"SELECT id, title, page_count FROM {BOOKS} ORDER BY page_count DESC, id DESC")
def sorted_library(spark, sf):
    return LB.sort_library(_books(spark, sf), "pages").select("id", "title", "page_count")


@REGISTRY.add("book_states", f"""
SELECT b.id, CASE WHEN EXISTS (SELECT 1 FROM {C.duck(C.BOOK_RUNS)} r WHERE r.book_id = b.id AND r.state = 'RUNNING') THEN 'running' WHEN has_result THEN 'has_result' ELSE 'none' END AS state FROM {BOOKS} b""")
def book_states(spark, sf):
    return LB.book_state(_books(spark, sf), C.frame(spark, sf, C.BOOK_RUNS)).select("id", "state")


@REGISTRY.add("setup_pages", f"""
SELECT r.id, r.book_id, array_to_string(list_sort(list_distinct(CASE WHEN r.id % 2 = 0 THEN [start_page] ELSE [1, 2, 3] END || [page_count - 2, page_count - 1, page_count])), ',') AS pages
FROM {C.duck(C.BOOK_RUNS)} r JOIN {BOOKS} b ON b.id = r.book_id""")
def setup_pages(spark, sf):
    runs = C.frame(spark, sf, C.BOOK_RUNS).withColumn("chosen", F.when(F.col("id") % 2 == 0, F.array("start_page")).otherwise(F.expr("cast(array() as array<bigint>)")))
    return LB.setup_pages(runs, _books(spark, sf)).withColumn("pages", F.array_join("pages", ","))


@REGISTRY.add("latest_outputs", """
SELECT o_custkey AS run_id, 'runs/' || o_custkey || '/r' || max(o_orderkey % 12) || '/out/main.tex' AS path, CAST(max(o_orderkey % 12) AS INTEGER) AS revision FROM orders GROUP BY o_custkey""")
def latest_outputs(spark, sf):
    paths = C.load(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.concat(F.lit("runs/"), "o_custkey", F.lit("/r"), F.col("o_orderkey") % 12, F.lit("/out/main.tex")).alias("path"))
    return LB.latest_output(paths)


_REVIEWS = "SELECT o_custkey AS run_id, concat('p', CAST(o_orderkey AS STRING)) AS id, concat('lemma:', CAST(o_orderkey % 10 AS STRING)) AS key, CAST(o_orderkey % 90 AS BIGINT) AS page, concat(o_orderpriority, ' <why> & \"', o_orderstatus, '\"') AS reason FROM @orders WHERE o_orderkey % 3 = 0"


@REGISTRY.add("review_counts", f"SELECT run_id, count(*) AS n FROM {C.duck(_REVIEWS)} GROUP BY ALL")
def review_counts(spark, sf):
    return LB.review_counts(C.frame(spark, sf, _REVIEWS))


@REGISTRY.add("review_rows", f"""
SELECT run_id, id, '<tr><td>' || key || '</td><td>' || page || '</td><td>' || replace(replace(replace(replace(reason, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td></tr>' AS html FROM {C.duck(_REVIEWS)}""")
def review_rows(spark, sf):
    return SK.review_rows(C.frame(spark, sf, _REVIEWS))


# --- logs ----------------------------------------------------------------------------------------------------

# One log per customer from its orders: warnings, errors and plain lines, in order of the keys.
_LOG_LINE = """CASE o_orderkey % 5 WHEN 0 THEN concat('LaTeX Warning: Reference `lemma:', CAST(o_orderkey % 10 AS STRING), chr(39), ' on page 1 undefined on input line 3.')
 WHEN 1 THEN concat('body.tex:', CAST(o_orderkey AS STRING), ': Missing $ inserted') WHEN 2 THEN 'Package x Info: fine.' WHEN 3 THEN concat('[', CAST(o_orderkey AS STRING), ']') ELSE 'Overfull box' END"""
_LOGS = f"SELECT o_custkey AS run_id, o_orderkey AS ord, {_LOG_LINE} AS line, CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS exit_code FROM @orders"


def _logs(spark, sf):
    rows = C.frame(spark, sf, _LOGS)
    return rows.groupBy("run_id", "exit_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("log"))


@REGISTRY.add("log_errors", f"SELECT run_id, 'body.tex' AS file, ord AS line, 'Missing $ inserted' AS message FROM {C.duck(_LOGS)} WHERE ord % 5 = 1")
def log_errors(spark, sf):
    return RD.log_errors(_logs(spark, sf)).drop("ord")


@REGISTRY.add("warning_triage", f"""
SELECT run_id, 'lemma:' || ord % 10 AS key, EXISTS (SELECT 1 FROM {C.duck(_REVIEWS)} r WHERE r.run_id = l.run_id AND r.key = 'lemma:' || l.ord % 10) AS deferred, count(*) AS n FROM {C.duck(_LOGS)} l WHERE ord % 5 = 0 GROUP BY ALL""")
def warning_triage(spark, sf):
    warnings = RD.log_warnings(_logs(spark, sf))
    active, deferred = LB.active_warnings(warnings, C.frame(spark, sf, _REVIEWS))
    counts = warnings.groupBy("run_id", "key").agg(F.count("*").alias("n"))
    rows = active.select("run_id", "key", F.lit(False).alias("deferred")).distinct().union(deferred.select("run_id", "key", F.lit(True)))
    return rows.join(counts, ["run_id", "key"])


@REGISTRY.add("compile_verdicts", f"""
SELECT run_id, CASE WHEN max(exit_code) <> 0 THEN 'TEX_ERROR' WHEN bool_or(ord % 5 = 0 AND NOT EXISTS (SELECT 1 FROM {C.duck(_REVIEWS)} r WHERE r.run_id = l.run_id AND r.key = 'lemma:' || l.ord % 10)) THEN 'REFERENCE_ERROR' END AS code
FROM {C.duck(_LOGS)} l GROUP BY run_id""")
def compile_verdicts(spark, sf):
    return RD.compile_verdict(_logs(spark, sf), C.frame(spark, sf, _REVIEWS)).select("run_id", "code")


# --- provenance and assets -----------------------------------------------------------------------------------

_CHAIN = "SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN CAST(NULL AS BIGINT) WHEN o_orderkey % 97 = 1 THEN o_orderkey + 1 WHEN o_orderkey % 97 = 2 THEN o_orderkey - 1 ELSE o_orderkey - 1 END AS source_run_id, o_orderkey % 7 = 0 AS has FROM @orders"


@REGISTRY.add("run_provenance", f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT * FROM {C.duck(_CHAIN)}),
w AS (SELECT run_id, run_id AS at, source_run_id AS next, has, 0 AS depth, [run_id] AS seen FROM c
 UNION ALL SELECT w.run_id, c.run_id, c.source_run_id, c.has, w.depth + 1, list_append(w.seen, c.run_id) FROM w JOIN c ON c.run_id = w.next WHERE NOT w.has AND NOT list_contains(w.seen, c.run_id))
SELECT c.run_id, w.at AS source_run, w.depth FROM c LEFT JOIN (SELECT * FROM w WHERE has) w ON w.run_id = c.run_id""")
def run_provenance(spark, sf):
    runs = C.frame(spark, sf, _CHAIN)
    return LB.provenance(runs.select("run_id", "source_run_id"), runs.filter("has").select("run_id"))


@REGISTRY.add("asset_inventory", f"""
WITH m AS (SELECT DISTINCT book_id, key AS id FROM ({C.DUCK_MARKERS}) WHERE command = 'BAFigure'), a AS (SELECT * FROM {C.duck(C.ASSETS)}),
f AS (SELECT book_id, id || CASE WHEN page % 8 = 0 THEN '~' ELSE '' END AS id, page % 2 = 0 AS used FROM a WHERE page % 3 <> 0),
k AS (SELECT coalesce(m.book_id, f.book_id) AS book_id, coalesce(m.id, f.id) AS id, f.id IS NOT NULL AS available FROM m FULL JOIN f ON f.book_id = m.book_id AND f.id = m.id WHERE m.id IS NOT NULL OR f.used)
SELECT k.book_id, k.id, a.page, available, coalesce(a.page <= 200 AND x0 >= 0 AND x0 < x1 AND x1 <= 1 AND y0 >= 0 AND y0 < y1 AND y1 <= 1, false) AS repairable
FROM k LEFT JOIN a ON a.book_id = k.book_id AND a.id = k.id WHERE k.id NOT LIKE '%~'""")
def asset_inventory(spark, sf):
    from ..operators import markup as M

    assets = cut_lineage(C.frame(spark, sf, C.ASSETS).withColumn("bbox", F.array("x0", "y0", "x1", "y1")))
    marks = M.markers(C.tex_pages(spark, sf)).filter("command = 'BAFigure'").select("book_id", F.col("key").alias("id"))
    files = assets.filter("page % 3 <> 0").select("book_id", F.when(F.col("page") % 8 == 0, F.concat("id", F.lit("~"))).otherwise(F.col("id")).alias("id"), (F.col("page") % 2 == 0).alias("used"))
    books = assets.select("book_id").distinct().withColumn("page_count", F.lit(200))
    return LB.asset_inventory(assets, marks, files, books)


# --- bodies and renderings -----------------------------------------------------------------------------------

_BODIES = f"SELECT book_id, string_agg('% PDF page ' || page || chr(10) || ' ' || tex || chr(10), '' ORDER BY page) AS body FROM ({C.TEX_PAGES}) GROUP BY book_id"


def _bodies(spark, sf):
    """Bodies as a reader finds them: one text per book of 250 pages."""
    pages = C.tex_pages(spark, sf)
    one = F.concat(F.lit("% PDF page "), "page", F.lit("\n "), "tex", F.lit("\n"))
    return pages.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", one.alias("t")))), lambda x: x["t"]), "").alias("body"))


@REGISTRY.add("split_bodies", f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page) - 1 AS ord, page, trim(tex, ' ' || chr(10)) AS tex FROM ({C.TEX_PAGES})")
def split_bodies(spark, sf):
    return RD.split_pages(_bodies(spark, sf)).select("book_id", F.col("ord").cast("bigint"), "page", "tex")


@REGISTRY.add("source_maps", f"""
SELECT book_id, page, CAST(1 + coalesce(sum(n) OVER (PARTITION BY book_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line
FROM (SELECT book_id, page, 2 + length(tex) - length(replace(tex, chr(10), '')) AS n FROM ({C.TEX_PAGES}))""")
def source_maps(spark, sf):
    return RD.source_map(_bodies(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


@REGISTRY.add("strict_bodies", f"SELECT DISTINCT book_id, 'PAGE_COVERAGE' AS code FROM ({C.TEX_PAGES}) WHERE page % 249 = 0")
def strict_bodies(spark, sf):
    """Bodies whose markers are not the expected pages (page 249 was not expected)."""
    from pyspark.sql import Window

    wanted = C.tex_pages(spark, sf).filter("page % 249 <> 0").select("book_id", "page")
    expected = wanted.withColumn("ord", F.row_number().over(Window.partitionBy("book_id").orderBy("page")) - 1)
    return RD.strict_coverage(_bodies(spark, sf), expected)


@REGISTRY.add("project_bodies", f"""
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY ord) - 1 AS ord, path, content FROM {BEFORE} WHERE path LIKE '%.tex' AND project_id % 2 = 0
UNION ALL SELECT project_id, 0, 'body.tex', 'plain ' || project_id FROM {BEFORE} WHERE path LIKE '%.tex' AND project_id % 2 = 1 GROUP BY project_id""")
def project_bodies(spark, sf):
    _, after, manifest = _manifest(spark, sf)
    names = F.regexp_replace("content", "stray text$", "")
    bodies = manifest.select("project_id", F.when(F.col("project_id") % 2 == 0, names).otherwise(F.concat(F.lit("plain "), "project_id")).alias("content"))
    originals = _files(spark, sf, C.FILES_BEFORE)
    parts, _ = RD.read_project_body(bodies, originals)
    return parts.withColumn("ord", F.col("ord").cast("bigint"))


@REGISTRY.add("rendered_pages", f"""
SELECT p.book_id, p.page, '% PDF page ' || p.page || chr(10) || coalesce(n, '') || tex || chr(10) AS text FROM ({C.TEX_PAGES}) p LEFT JOIN (
 SELECT book_id, page, string_agg('% BA source {{"type":"headings","id":"' || id || '","page":' || page || ',"level":"' || level || '","number":"' || number || '","title":"' || title || '"}}' || chr(10), '' ORDER BY id) AS n
 FROM {C.duck(C.HEADINGS)} GROUP BY ALL) h ON h.book_id = p.book_id AND h.page = p.page""")
def rendered_pages(spark, sf):
    return SK.render_pages(C.tex_pages(spark, sf), C.frame(spark, sf, C.HEADINGS)).select("book_id", "page", "text")


@REGISTRY.add("rendered_lines", f"""
SELECT p.book_id, p.page, CAST(2 + h + coalesce(sum(n + h) OVER (PARTITION BY p.book_id ORDER BY p.page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line FROM (
 SELECT p.*, 2 + length(tex) - length(replace(tex, chr(10), '')) AS n, (SELECT count(*) FROM {C.duck(C.HEADINGS)} h WHERE h.book_id = p.book_id AND h.page = p.page) AS h FROM ({C.TEX_PAGES}) p) p""")
def rendered_lines(spark, sf):
    rendered = SK.render_pages(C.tex_pages(spark, sf), C.frame(spark, sf, C.HEADINGS))
    return RD.rendered_lines(rendered).withColumn("line", F.col("line").cast("bigint"))


@REGISTRY.add("heading_definitions", f"""
SELECT h.book_id, h.page, h.id, chr(92) || 'expandafter' || chr(92) || 'def' || chr(92) || 'csname bah' || id || chr(92) || 'endcsname{{' || CASE WHEN id = first THEN chr(92) || 'appendix' ELSE '' END || chr(92)
 || CASE WHEN documentclass = 'article' AND level = 'chapter' THEN 'section' ELSE level END || CASE WHEN number = '' THEN '*' ELSE '' END || '{{' || title || '}}}}' AS line
FROM {C.duck(C.HEADINGS)} h JOIN {C.duck(SETUPS)} s ON s.book_id = h.book_id JOIN (SELECT book_id AS b, min(id) AS first FROM {C.duck(C.HEADINGS)} GROUP BY ALL) ON b = h.book_id""")
def heading_definitions(spark, sf):
    headings = C.frame(spark, sf, C.HEADINGS)
    setups = C.frame(spark, sf, SETUPS).join(headings.groupBy("book_id").agg(F.min("id").alias("appendix_start")), "book_id")
    return SK.render_headings(headings, setups)


_BS = "chr(92) || "
_DECLARED = ", ".join(f"({i}, '{t}')" for i, t in enumerate(P.THEOREMS))
_LEVELS = ", ".join(f"({i}, '{h}')" for i, h in enumerate(P.HEADINGS[:4]))
_NATIVE = ", ".join(f"'{n}'" for n in P.BUILTIN_COUNTERS)


@REGISTRY.add("counter_preambles", f"""
WITH r AS (SELECT *, CASE name WHEN 'theorem' THEN 1 WHEN 'lemma' THEN 2 WHEN 'equation' THEN 3 ELSE 4 END AS o FROM {C.duck(RULES)}),
t AS (SELECT s.book_id, d.i, d.n, upper(left(d.n, 1)) || substr(d.n, 2) AS title, coalesce(r.reset_by, '') AS parent,
  CASE WHEN r.name IS NOT NULL THEN r.shared_with WHEN d.n = 'theorem' THEN '' ELSE 'theorem' END AS shared
 FROM {C.duck(SETUPS)} s CROSS JOIN (VALUES {_DECLARED}) d(i, n) LEFT JOIN r ON r.book_id = s.book_id AND r.name = d.n),
own AS (SELECT r.*, s.documentclass FROM r JOIN {C.duck(SETUPS)} s ON s.book_id = r.book_id WHERE r.shared_with = ''),
l AS (
 SELECT book_id, 0 AS a, i AS b, 0 AS c, CASE WHEN shared <> '' THEN {_BS}'newtheorem{{' || n || '}}[' || shared || ']{{' || title || '}}'
  ELSE {_BS}'newtheorem{{' || n || '}}{{' || title || '}}' || CASE WHEN parent <> '' THEN '[' || parent || ']' ELSE '' END END AS line FROM t
 UNION ALL SELECT book_id, 0, i, 1, {_BS}'newtheorem*{{' || n || '*}}{{' || title || '}}' FROM t
 UNION ALL SELECT book_id, 1, o, v.i, {_BS}'counterwithout*{{' || name || '}}{{' || v.h || '}}' FROM own JOIN (VALUES {_LEVELS}) v(i, h)
  ON name IN ({_NATIVE}) AND v.h <> name AND NOT (documentclass = 'article' AND v.h = 'chapter')
 UNION ALL SELECT book_id, 1, o, 8, {_BS}'counterwithin*{{' || name || '}}{{' || reset_by || '}}' FROM own WHERE name IN ({_NATIVE}) AND reset_by <> ''
 UNION ALL SELECT book_id, 1, o, 9, {_BS}'renewcommand{{' || {_BS}'the' || name || '}}{{' || CASE WHEN reset_by <> '' AND prefix_parent THEN {_BS}'the' || reset_by || '.' ELSE '' END
  || {_BS}style || '{{' || name || '}}}}' FROM own)
SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY a, b, c) - 1 AS INTEGER) AS ord, line FROM l""")
def counter_preambles(spark, sf):
    """Declarations of each book's counters."""
    rules = C.frame(spark, sf, RULES).withColumn("ord", F.when(F.col("name") == "theorem", 1).when(F.col("name") == "lemma", 2).when(F.col("name") == "equation", 3).otherwise(4))
    return SK.counter_preamble(rules, C.frame(spark, sf, SETUPS))


@REGISTRY.add("initial_counters", f"SELECT book_id, name, chr(92) || 'setcounter{{' || name || '}}{{' || value || '}}' AS line FROM {C.duck(SEEDS)}")
def initial_counters(spark, sf):
    return SK.initial_counters(C.frame(spark, sf, SEEDS))


# --- scans of files that Spark writes from the tables ----------------------------------------------------------

@REGISTRY.add("catalog_scan", f"SELECT CAST(id AS VARCHAR) AS id, title, sha256(title) AS sha256, CAST(page_count AS INTEGER) AS page_count, size_bytes FROM {BOOKS}")
def catalog_scan(spark, sf):
    """Books of nested catalogues, a catalogue per segment of the library."""
    books = _books(spark, sf).withColumn("shelf", F.col("id") % 8)
    entry = F.struct(F.col("id").cast("string").alias("id"), "title", F.sha2("title", 256).alias("sha256"), F.col("page_count").cast("int").alias("page_count"), "size_bytes")
    path = _scratch(spark)
    books.groupBy("shelf", F.floor(F.col("id") / 4096)).agg(F.collect_list(entry).alias("books")).select(F.lit("1").alias("schema_version"), F.to_json(F.struct("books")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return RD.read_catalog(spark, path).select("id", "title", "sha256", "page_count", "size_bytes")


@REGISTRY.add("file_inventory", f"SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) AS size_bytes, count(*) AS rows FROM (SELECT text || chr(10) AS text FROM benchmark)")
def file_inventory(spark, sf):
    """Sizes of files as the inventory sees them, against what was written."""
    path = _scratch(spark)
    rows = C.load(spark, sf, "benchmark")
    rows.select(F.col("text").alias("value")).repartition(4).write.text(path)
    files = RD.file_inventory(spark, path, "*.txt").filter(F.length("sha256") == 64)
    return files.agg(F.sum("size_bytes").alias("size_bytes")).withColumn("rows", rows.agg(F.count("*")).scalar())


@REGISTRY.add("batch_scan", f"""
SELECT 'batch-' || book_id || '-' || floor((page - 1) / 3)::BIGINT AS task_id, CAST(page AS INTEGER) AS page, tex, (SELECT count(*) FROM {C.duck(C.HEADINGS)} h WHERE h.book_id = p.book_id AND h.page = p.page) AS headings FROM ({C.TEX_PAGES}) p""")
def batch_scan(spark, sf):
    """Batches written as JSON, read back and exploded."""
    batch = F.floor((F.col("page") - 1) / 3)
    pages = C.tex_pages(spark, sf).groupBy("book_id", batch.alias("b")).agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "tex"))).alias("pages"))
    heads = C.frame(spark, sf, C.HEADINGS).groupBy("book_id", batch.alias("b")).agg(
        F.collect_list(F.struct("id", F.col("page").cast("int").alias("page"), "level", "number", "title")).alias("headings"))
    path = _scratch(spark)
    both = pages.join(heads, ["book_id", "b"], "left").select(F.concat_ws("-", F.lit("batch"), "book_id", "b").alias("task_id"), "pages", "headings", F.lit("closed").alias("head"), F.lit("closed").alias("tail"))
    both.write.json(path)
    found = RD.read_batches(spark, path, by_line=True)
    counts = RD.batch_headings(found).groupBy("task_id", "page").agg(F.count("*").alias("headings"))
    return RD.batch_pages(found).join(counts, ["task_id", "page"], "left").select("task_id", "page", "tex", F.coalesce("headings", F.lit(0)).alias("headings"))


@REGISTRY.add("ledger_scan", f"SELECT id, run_id, state, purpose FROM {C.duck(C.CALLS)} WHERE state = 'FAILED'")
def ledger_scan(spark, sf):
    """Calls written with JSON metadata and scanned back; the state filter reaches the files."""
    path = _scratch(spark)
    calls = C.frame(spark, sf, C.CALLS)
    calls.select("id", "run_id", "seq", "state", F.to_json(F.struct("purpose", "task_id", "usage")).alias("metadata")).write.parquet(path)
    found = RD.read_ledger(spark, path, "purpose string, task_id string, usage string")
    return found.filter("state = 'FAILED'").select("id", "run_id", "state", "metadata.purpose")


@REGISTRY.add("receipt_scan", """
SELECT CAST(doc_id AS VARCHAR) AS receipt, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS code FROM documents WHERE doc_id % 3 <> 2""")
def receipt_scan(spark, sf):
    """Feedback inside prompts and beside them, among plain-text receipts."""
    docs = C.load(spark, sf, "documents")
    body = F.struct(F.struct(F.col("doc_id").cast("string").alias("receipt")).alias("candidate"), F.col("lang").alias("code"), F.col("doc_id").cast("string").alias("error"))
    inside = F.to_json(F.struct(F.to_json(F.struct(body.alias("repair_feedback"))).alias("prompt")))
    beside = F.to_json(F.struct(body.alias("feedback")))
    n = F.col("doc_id") % 3
    receipts = docs.select(
        F.col("doc_id").cast("string").alias("call_id"), F.when(n == 0, "request").otherwise("repair").alias("kind"),
        F.try_parse_json(F.when(n == 0, inside).when(n == 1, beside).otherwise(F.col("text"))).alias("value"))
    return RD.receipt_feedback(receipts).select(F.col("message").alias("receipt"), "code")


@REGISTRY.add("journal_scan", "SELECT CASE event_type WHEN 'click' THEN 'item/started' WHEN 'view' THEN 'turn/completed' ELSE 'error' END AS method, event_id FROM events WHERE event_type IN ('click', 'view', 'error')")
def journal_scan(spark, sf):
    """Journal lines of known methods; half-written lines are dropped."""
    path = _scratch(spark)
    kind = F.col("event_type")
    method = F.when(kind == "click", "item/started").when(kind == "view", "turn/completed").when(kind == "error", "error").otherwise("other")
    line = F.to_json(F.struct(method.alias("method"), F.struct("event_id").alias("data")))
    C.load(spark, sf, "events").select(F.when(kind == "signup", F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return RD.read_events(spark, path).select("method", F.try_variant_get("event", "$.data.event_id", "bigint").alias("event_id"))


@REGISTRY.add("table_sink", f"SELECT run_id, id, state FROM {C.duck(C.TASKS)}")
def table_sink(spark, sf):
    """A table replaced twice and read back."""
    path = _scratch(spark)
    tasks = C.frame(spark, sf, C.TASKS)
    SK.write_table(tasks.limit(1), path)
    SK.write_table(tasks, path)
    return SK.read_table(spark, path).select("run_id", "id", "state")


@REGISTRY.add("body_sink", f"""
SELECT book_id, count(*) AS lines FROM (SELECT book_id, unnest(string_split('% PDF page ' || page || chr(10) || tex, chr(10))) AS line FROM ({C.TEX_PAGES})) GROUP BY ALL""")
def body_sink(spark, sf):
    """Rendered bodies written as text and read back; lines per book."""
    path = _scratch(spark)
    nothing = C.frame(spark, sf, C.HEADINGS).filter("false")
    SK.write_body(SK.render_pages(C.tex_pages(spark, sf), nothing), path)
    return spark.read.text(path).groupBy(F.col("book_id").cast("bigint").alias("book_id")).agg(F.count("*").alias("lines"))


@REGISTRY.add("review_sink", f"SELECT run_id, id, key FROM {C.duck(_REVIEWS)}")
def review_sink(spark, sf):
    path = _scratch(spark)
    reviews = C.frame(spark, sf, _REVIEWS).withColumn("owner", F.col("run_id")).withColumn("run_id", F.col("run_id") % 16)
    SK.review_export(reviews, path)
    return spark.read.json(path).select(F.col("owner").alias("run_id"), "id", "key")
