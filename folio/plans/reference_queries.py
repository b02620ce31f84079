"""Queries on labels, references, groups, edits and counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.scan import position
from ..operators import markup as M
from ..operators import references as R
from ..operators import scope as S
from ..session import cut_lineage
from . import corpora as C
from .registry import Registry

REGISTRY = Registry()
SYM = f"({C.DUCK_SYMBOLS})"
LABELS = f"(SELECT * FROM {SYM} WHERE category = 'label')"
REFS = f"(SELECT * FROM {SYM} WHERE category = 'reference')"
COUNTS = f"(SELECT book_id, key, count(*) AS n_targets FROM {LABELS} GROUP BY ALL)"
DUP_KEYS = f"(SELECT book_id, key, split_part(key, ':', 1) || ':' || split_part(key, ':', 2) AS grp FROM {COUNTS} WHERE n_targets > 1)"
MISSING = f"(SELECT * FROM {REFS} r WHERE NOT EXISTS (SELECT 1 FROM {COUNTS} c WHERE c.book_id = r.book_id AND c.key = r.key))"


def symbol_table(spark, sf, with_context=False):
    """The symbol index as a stage table: parsing happens once, however many operators read it."""
    return cut_lineage(M.symbols(C.tex_pages(spark, sf), with_context))


@REGISTRY.add("symbol_summary", f"""
SELECT book_id, CAST(sum(labels) AS BIGINT) AS labels, CAST(sum(refs) AS BIGINT) AS "references",
 CAST(sum(CASE WHEN labels = 1 THEN refs ELSE 0 END) AS BIGINT) AS resolved, count(*) FILTER (WHERE labels > 1) AS duplicate_keys,
 CAST(sum(CASE WHEN labels <> 1 THEN refs ELSE 0 END) AS BIGINT) AS unresolved
FROM (SELECT book_id, key, count(*) FILTER (WHERE category = 'label') AS labels, count(*) FILTER (WHERE category = 'reference') AS refs FROM {SYM} GROUP BY ALL)
GROUP BY book_id""")
def symbol_summary(spark, sf):
    return R.symbol_summary(M.symbols(C.tex_pages(spark, sf), with_context=False))


@REGISTRY.add("symbol_cube", f"""
SELECT book_id, kind, count(*) FILTER (WHERE category = 'label') AS labels, count(*) FILTER (WHERE category = 'reference') AS "references",
 CAST(grouping(book_id) AS INTEGER) AS all_books, CAST(grouping(kind) AS INTEGER) AS all_kinds FROM {SYM} GROUP BY CUBE (book_id, kind)""")
def symbol_cube(spark, sf):
    cube = R.symbol_cube(M.symbols(C.tex_pages(spark, sf), with_context=False))
    return cube.withColumn("all_books", F.col("all_books").cast("int")).withColumn("all_kinds", F.col("all_kinds").cast("int"))


@REGISTRY.add("duplicate_labels", f"SELECT book_id, key, n_targets FROM {COUNTS} WHERE n_targets > 1")
def duplicate_labels(spark, sf):
    return R.duplicate_labels(M.symbols(C.tex_pages(spark, sf), with_context=False))


@REGISTRY.add("resolved_references", f"""
SELECT r.book_id, r.id, r.key, coalesce(n_targets, 0) AS n_targets, coalesce(n_targets, 0) = 1 AS resolved
FROM {REFS} r LEFT JOIN {COUNTS} c ON r.book_id = c.book_id AND r.key = c.key""")
def resolved_references(spark, sf):
    return R.resolve(symbol_table(spark, sf)).select("book_id", "id", "key", "n_targets", "resolved")


@REGISTRY.add("missing_references", f"SELECT book_id, id, key, page FROM {MISSING}")
def missing_references(spark, sf):
    return R.missing_refs(symbol_table(spark, sf)).select("book_id", "id", "key", "page")


_HEX = "CAST('0x' || substr(sha256(key), {at}, 15) AS BIGINT)"
_DIGEST = f"substr(sha256(concat_ws(':', CAST(count(DISTINCT key) AS VARCHAR), CAST(sum({_HEX.format(at=1)}) AS VARCHAR), CAST(sum({_HEX.format(at=16)}) AS VARCHAR))), 1, 16)"


@REGISTRY.add("duplicate_groups", f"""
SELECT g.book_id, g.grp, 'reference-duplicates-' || digest AS group_id, keys, CAST("references" AS BIGINT) AS "references", CAST(editable_labels AS BIGINT) AS editable_labels,
 (SELECT count(*) FROM {LABELS} t WHERE t.book_id = g.book_id AND t.kind || ':' || t.number = g.grp) AS targets
FROM (SELECT d.book_id, grp, {_DIGEST.replace('key', 'd.key')} AS digest, count(*) AS keys,
  sum((SELECT count(*) FROM {REFS} r WHERE r.book_id = d.book_id AND r.key = d.key)) AS "references",
  sum((SELECT n_targets FROM {COUNTS} c WHERE c.book_id = d.book_id AND c.key = d.key)) AS editable_labels
 FROM {DUP_KEYS} d GROUP BY d.book_id, grp) g""")
def duplicate_groups(spark, sf):
    return R.reference_groups(symbol_table(spark, sf), "duplicates")


@REGISTRY.add("missing_groups", f"""
SELECT book_id, key AS grp, 'reference-missing-' || {_DIGEST} AS group_id, CAST(1 AS BIGINT) AS keys, CAST(max(n) AS BIGINT) AS "references", CAST(0 AS BIGINT) AS editable_labels
FROM (SELECT book_id, key, count(*) AS n FROM {MISSING} GROUP BY ALL) GROUP BY book_id, key""")
def missing_groups(spark, sf):
    return R.reference_groups(symbol_table(spark, sf), "missing")


# The corpus has no third key part, so every label of a duplicate namespace is writable: evidence stays empty there.
@REGISTRY.add("duplicate_group_members", f"""
SELECT s.book_id, d.grp, s.id, s.key, s.category AS role FROM {SYM} s JOIN {DUP_KEYS} d ON s.book_id = d.book_id AND s.key = d.key""")
def duplicate_group_members(spark, sf):
    return R.group_members(symbol_table(spark, sf), "duplicates")


_FAMILY = "CASE WHEN kind IN ('theorem', 'lemma', 'proposition', 'corollary', 'definition', 'remark', 'example', 'claim') THEN 'statement' ELSE kind END"


@REGISTRY.add("candidate_targets", f"""
SELECT m.book_id, m.key, count(t.id) AS candidates, count(DISTINCT t.key) AS candidate_keys, min(t.key) AS first_key
FROM (SELECT DISTINCT book_id, key, {_FAMILY} AS fam, number FROM {MISSING}) m
LEFT JOIN (SELECT *, {_FAMILY} AS fam FROM {LABELS}) t ON t.book_id = m.book_id AND t.fam = m.fam AND t.number = m.number
GROUP BY m.book_id, m.key""")
def candidate_targets(spark, sf):
    return R.candidate_counts(symbol_table(spark, sf))


@REGISTRY.add("candidate_pools", f"""
WITH m AS (SELECT DISTINCT book_id, key, {_FAMILY} AS fam, number FROM {MISSING})
SELECT book_id, fam AS pool_family, number AS pool_number, 'missing' AS role, NULL AS id, key FROM m
UNION ALL SELECT book_id, {_FAMILY}, number, 'target', id, key FROM {LABELS} t
WHERE EXISTS (SELECT 1 FROM m WHERE m.book_id = t.book_id AND m.fam = {_FAMILY.replace('kind', 't.kind')} AND m.number = t.number)""")
def candidate_pools(spark, sf):
    return R.candidate_pools(symbol_table(spark, sf))


@REGISTRY.add("near_keys")
def near_keys(spark, sf):
    """Most similar keys of a missing one. SQL has no matching-block ratio; tests compare with a brute-force search."""
    return R.near_keys(symbol_table(spark, sf))


@REGISTRY.add("group_scope_headings", f"""
WITH marked AS (SELECT *, CASE WHEN command = 'BAHeading' THEN CAST(page * 4294967296 + start AS BIGINT) END AS hpos FROM ({C.DUCK_MARKERS})),
h AS (SELECT m.book_id, m.key, m.hpos, h.level, list_position(['part', 'chapter', 'section', 'subsection', 'subsubsection'], h.level) AS lvl
 FROM marked m JOIN {C.duck(C.HEADINGS)} h ON m.book_id = h.book_id AND m.key = h.id WHERE hpos IS NOT NULL),
s AS (SELECT s.*, CAST(page * 4294967296 + start AS BIGINT) AS pos FROM {SYM} s),
open AS (SELECT s.book_id, s.id, h.key AS hid FROM s JOIN {DUP_KEYS} d ON s.book_id = d.book_id AND s.key = d.key
  JOIN h ON h.book_id = s.book_id AND h.hpos < s.pos
 WHERE NOT EXISTS (SELECT 1 FROM h h2 WHERE h2.book_id = s.book_id AND h2.hpos > h.hpos AND h2.hpos < s.pos AND h2.lvl <= h.lvl))
SELECT d.book_id, d.grp, count(DISTINCT hid) AS headings FROM open JOIN {SYM} s ON s.book_id = open.book_id AND s.id = open.id
JOIN {DUP_KEYS} d ON d.book_id = s.book_id AND d.key = s.key GROUP BY ALL""")
def group_scope_headings(spark, sf):
    """Only places move: a member knows its last heading, and only headings know their scope."""
    headings = C.frame(spark, sf, C.HEADINGS)
    place = position(F.col("page"), F.col("start"))
    marks = cut_lineage(M.markers(C.tex_pages(spark, sf)).select("book_id", "page", "start", "command", "category", "key"))
    symbols = marks.filter(F.col("category") != "record").select("book_id", place.alias("id"), "key", "category")
    members = R.group_members(symbols, "duplicates").select("book_id", "grp", F.col("id").alias("pos"))
    under = S.last_headings(members, marks).select("book_id", "grp", F.col("heading").alias("id"))
    heads = marks.filter(F.col("command") == P.HEADING_COMMAND).drop("category")
    scoped = S.heading_scope(heads, headings).select("book_id", F.col("pos").alias("id"), "scope")
    return R.open_headings(under, scoped).groupBy("book_id", "grp").agg(F.count("*").alias("headings"))


# Line-range reads: one per page with three or more lines of the source table.
READS = """
SELECT concat('q', CAST(l_orderkey AS STRING)) AS read_id, CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 CAST(min(l_linenumber) AS INT) AS start_line, CAST(CASE WHEN max(l_linenumber) = 7 THEN 0 ELSE max(l_linenumber) END AS INT) AS end_line
FROM @lineitem GROUP BY l_orderkey HAVING count(*) >= 3
"""


@REGISTRY.add("targets_in_lines", f"""
SELECT r.read_id, s.book_id, s.page, s.id, s.line FROM (
 SELECT s.*, length(substr(tex, 1, start)) - length(replace(substr(tex, 1, start), chr(10), '')) + 1 AS line
 FROM {LABELS} s JOIN ({C.TEX_PAGES}) t ON s.book_id = t.book_id AND s.page = t.page) s
JOIN {C.duck(READS)} r ON r.book_id = s.book_id AND r.page = s.page AND s.line >= r.start_line AND (r.end_line = 0 OR s.line <= r.end_line)""")
def targets_in_lines(spark, sf):
    pages = C.tex_pages(spark, sf)
    symbols = M.symbols(pages, with_context=False).join(pages, ["book_id", "page"]).withColumn("line", X.line_of(F.col("tex"), F.col("start")).cast("bigint"))
    return R.targets_in_lines(C.frame(spark, sf, READS), symbols)


@REGISTRY.add("targets_seen", f"""
SELECT DISTINCT book_id, id FROM {LABELS} WHERE kind = 'lemma' OR page % 10 = 0
UNION SELECT book_id, id FROM {LABELS} WHERE page % 25 = 0 OR kind = 'equation' AND page % 2 = 0""")
def targets_seen(spark, sf):
    """Targets known from hits (lemmas) and viewed pages (every tenth), grown by a second round."""
    table = symbol_table(spark, sf)
    hits = table.filter(F.col("kind") == "lemma").select("book_id", "id")
    views = table.filter(F.col("page") % 10 == 0).select("book_id", "page")
    first = R.targets_seen(hits, views, table)
    more = R.targets_seen(table.filter((F.col("kind") == "equation") & (F.col("page") % 2 == 0)), table.filter(F.col("page") % 25 == 0), table)
    return R.grow_known(first, more)


# --- edits ---------------------------------------------------------------------------------------------------

def _edits(symbols):
    """Edits derived from the index: scoped labels for duplicates, plus some wrong ones of every sort."""
    label = F.col("category") == "label"
    n = F.conv(F.substr(F.sha2("id", 256), F.lit(1), F.lit(6)), 16, 10).cast("bigint") % 10
    new_key = (
        F.when(label & (n == 0), F.concat(F.lit("claim:"), F.col("number")))
        .when(n == 1, F.concat(F.col("key"), F.lit(" bad")))
        .when(label, F.concat(F.col("namespace"), F.lit(":s"), (F.col("page") % 3).cast("string")))
        .otherwise(F.concat(F.col("namespace"), F.lit(":s1")))
    )
    chosen = symbols.filter(F.col("page") % 4 < 2)
    return chosen.select("book_id", "category", F.when(n == 2, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), new_key.alias("key"))


EDITS = f"""(SELECT book_id, category, CASE WHEN n = 2 THEN id || 'x' ELSE id END AS id,
 CASE WHEN category = 'label' AND n = 0 THEN 'claim:' || number WHEN n = 1 THEN key || ' bad'
  WHEN category = 'label' THEN kind || ':' || number || ':s' || (page % 3) ELSE kind || ':' || number || ':s1' END AS key
FROM (SELECT *, CAST('0x' || substr(sha256(id), 1, 6) AS BIGINT) % 10 AS n FROM {SYM}) WHERE page % 4 < 2)"""

_CHECKED = f"""(SELECT e.*, s.key AS old_key, s.page, s.command, s.start, s."end",
 CASE WHEN s.key IS NULL THEN 'unknown_id' WHEN e.key LIKE '% %' THEN 'bad_key'
  WHEN e.category = 'label' AND split_part(e.key, ':', 1) || split_part(e.key, ':', 2) <> s.kind || s.number THEN 'changed_kind_or_number' END AS problem
FROM {EDITS} e LEFT JOIN {SYM} s ON s.book_id = e.book_id AND s.category = e.category AND s.id = e.id)"""


@REGISTRY.add("edit_checks", f"SELECT book_id, category, id, key, problem FROM {_CHECKED}")
def edit_checks(spark, sf):
    table = symbol_table(spark, sf)
    return R.check_edits(_edits(table), table).select("book_id", "category", "id", "key", "problem")


def _good_edits(table):
    return cut_lineage(R.check_edits(_edits(table), table).filter(F.col("problem").isNull()).select("book_id", "category", "id", "key"))


GOOD = f"(SELECT * FROM {_CHECKED} WHERE problem IS NULL)"
AFTER = f"""(SELECT book_id, key, count(*) AS n FROM (
 SELECT s.book_id, coalesce(g.key, s.key) AS key FROM {LABELS} s LEFT JOIN {GOOD} g ON g.book_id = s.book_id AND g.id = s.id AND g.category = 'label') GROUP BY ALL)"""


@REGISTRY.add("key_counts_after_edits", f"""
SELECT k.book_id, k.key, coalesce(n, 0) AS n_targets FROM (
 SELECT DISTINCT book_id, key FROM {LABELS} UNION SELECT book_id, key FROM {GOOD} WHERE category = 'label') k
LEFT JOIN {AFTER} a ON a.book_id = k.book_id AND a.key = k.key""")
def key_counts_after_edits(spark, sf):
    table = symbol_table(spark, sf)
    return R.key_counts_after(table, _good_edits(table))


DEFERRABLE = f"""(SELECT r.book_id, r.id, r.key FROM {REFS} r JOIN {DUP_KEYS} d ON d.book_id = r.book_id AND d.key = r.key
WHERE NOT EXISTS (SELECT 1 FROM {AFTER} a WHERE a.book_id = r.book_id AND a.key = r.key)
 AND NOT EXISTS (SELECT 1 FROM {GOOD} g WHERE g.book_id = r.book_id AND g.id = r.id AND g.category = 'reference'))"""


@REGISTRY.add("deferrable_references", f"SELECT * FROM {DEFERRABLE}")
def deferrable_references(spark, sf):
    table = symbol_table(spark, sf)
    return R.deferrable(table, _good_edits(table))


@REGISTRY.add("unconfirmed_references", f"""
SELECT r.book_id, r.id, r.page % 5 = 0 AS bibliography, CASE WHEN r.page % 7 = 0 THEN ' ' ELSE 'not found' END AS reason,
 CASE WHEN r.page % 5 = 0 THEN 'BIBLIOGRAPHY_REVIEW'
  WHEN (EXISTS (SELECT 1 FROM {COUNTS} c WHERE c.book_id = r.book_id AND c.key = r.key)
     AND NOT EXISTS (SELECT 1 FROM {DEFERRABLE} d WHERE d.book_id = r.book_id AND d.id = r.id))
   OR EXISTS (SELECT 1 FROM {GOOD} g WHERE g.book_id = r.book_id AND g.id = r.id) OR r.page % 7 = 0 THEN 'REFERENCE_REVIEW' END AS problem
FROM {REFS} r WHERE r.kind <> 'theorem'""")
def unconfirmed_references(spark, sf):
    table = symbol_table(spark, sf)
    edits = _good_edits(table)
    items = R.references_of(table).filter(F.col("kind") != "theorem").select(
        "book_id", "id", (F.col("page") % 5 == 0).alias("bibliography"), F.when(F.col("page") % 7 == 0, " ").otherwise("not found").alias("reason"))
    return R.check_unconfirmed(items, table, edits, R.deferrable(table, edits))


@REGISTRY.add("group_checks", f"""
WITH mem AS (SELECT s.book_id, d.grp, s.id, s.key, s.category AS role, coalesce(g.key, s.key) AS new_key FROM {SYM} s
 JOIN {DUP_KEYS} d ON s.book_id = d.book_id AND s.key = d.key LEFT JOIN {GOOD} g ON g.book_id = s.book_id AND g.id = s.id),
c AS (SELECT m.*, coalesce(a.n, 0) AS n FROM mem m LEFT JOIN {AFTER} a ON a.book_id = m.book_id AND a.key = m.new_key)
SELECT book_id, grp, id, new_key, CASE WHEN n > 1 THEN 'ambiguous_target' WHEN n = 0 THEN 'missing_target' ELSE 'target_not_in_context' END AS reason
FROM c WHERE role = 'reference' AND (n <> 1 OR NOT EXISTS (SELECT 1 FROM mem x WHERE x.book_id = c.book_id AND x.grp = c.grp AND x.role = 'label' AND x.new_key = c.new_key))
 AND NOT EXISTS (SELECT 1 FROM {DEFERRABLE} d WHERE d.book_id = c.book_id AND d.id = c.id)
UNION ALL SELECT book_id, grp, id, new_key, 'duplicate_label' FROM c WHERE role = 'label' AND n <> 1
UNION ALL SELECT g.book_id, NULL, g.id, g.key, 'not_owned' FROM {GOOD} g WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.book_id = g.book_id AND m.id = g.id)""")
def group_checks(spark, sf):
    """What is still wrong in each duplicate group after the edits, deferrable references left out."""
    table = symbol_table(spark, sf)
    edits = _good_edits(table)
    return R.check_group(table, edits, R.deferrable(table, edits), "duplicates")


@REGISTRY.add("owned_edits", f"""
SELECT g.book_id, g.id, EXISTS (SELECT 1 FROM {SYM} s JOIN {DUP_KEYS} d ON s.book_id = d.book_id AND s.key = d.key WHERE s.book_id = g.book_id AND s.id = g.id) AS inside FROM {GOOD} g""")
def owned_edits(spark, sf):
    table = symbol_table(spark, sf)
    inside, outside = R.owned(_good_edits(table), R.group_members(table, "duplicates"))
    return inside.select("book_id", "id", F.lit(True).alias("inside")).union(outside.select("book_id", "id", F.lit(False).alias("inside")))


@REGISTRY.add("groups_resolved", f"""
WITH after AS (SELECT s.book_id, s.category, coalesce(g.key, s.key) AS key FROM {SYM} s LEFT JOIN {GOOD} g ON g.book_id = s.book_id AND g.id = s.id)
SELECT d.book_id, d.grp, bool_and(CASE WHEN x.refs_before = 0 THEN NULL ELSE x.t = 1 OR x.r = 0 END) IS NOT NULL AND
 coalesce(bool_and(CASE WHEN x.refs_before = 0 THEN NULL ELSE x.t = 1 OR x.r = 0 END), false) AS resolved
FROM {DUP_KEYS} d JOIN LATERAL (SELECT
  (SELECT count(*) FROM {REFS} r WHERE r.book_id = d.book_id AND r.key = d.key) AS refs_before,
  (SELECT count(*) FROM after a WHERE a.book_id = d.book_id AND a.key = d.key AND a.category = 'label') AS t,
  (SELECT count(*) FROM after a WHERE a.book_id = d.book_id AND a.key = d.key AND a.category = 'reference') AS r) x ON true
GROUP BY d.book_id, d.grp""")
def groups_resolved(spark, sf):
    """Whether each duplicate group is settled by the edits."""
    table = symbol_table(spark, sf)
    edits = _good_edits(table)
    new = edits.select("book_id", "id", F.col("key").alias("_new"))
    after = cut_lineage(table.join(new, ["book_id", "id"], "left").withColumn("key", F.coalesce("_new", "key")).drop("_new"))
    return R.group_resolved(R.group_members(table, "duplicates"), after)


# --- counters ------------------------------------------------------------------------------------------------

# One setup per book; two counters get rules of their own, three books have a cycle.
SETUPS = "SELECT DISTINCT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CASE WHEN floor(l_orderkey / 250) % 3 = 0 THEN 'article' ELSE 'book' END AS documentclass FROM @lineitem"
RULES = f"""
SELECT book_id, 'theorem' AS name, 'section' AS reset_by, '' AS shared_with, 'arabic' AS style, true AS prefix_parent FROM ({SETUPS}) a
UNION ALL SELECT book_id, 'lemma', CASE WHEN book_id % 2 = 0 THEN '' ELSE 'chapter' END, CASE WHEN book_id % 2 = 0 THEN 'theorem' ELSE '' END, 'roman', false FROM ({SETUPS}) b
UNION ALL SELECT book_id, 'equation', 'section', '', CASE WHEN book_id % 4 = 1 THEN 'Roman' ELSE 'arabic' END, true FROM ({SETUPS}) c
UNION ALL SELECT book_id, 'section', CASE WHEN book_id % 5 = 4 THEN 'subsection' ELSE 'part' END, '', 'arabic', book_id % 2 = 1 FROM ({SETUPS}) d
"""
SEEDS = f"SELECT book_id, 'section' AS name, CAST(3 AS BIGINT) AS value FROM ({SETUPS}) a UNION ALL SELECT book_id, 'theorem', CAST(10 AS BIGINT) FROM ({SETUPS}) b WHERE book_id % 2 = 1"


def _native(documentclass: str) -> str:
    rows = []
    resets = S.NATIVE_RESETS_BOOK if documentclass == "book" else S.NATIVE_RESETS_ARTICLE
    from ..functions import patterns as P

    for n in P.BUILTIN_COUNTERS:
        rows.append(f"('{documentclass}', '{n}', '{resets.get(n, '')}', '', '{'Roman' if n == 'part' else 'arabic'}', {str(n in resets and n in S.NATIVE_PREFIXED).lower()})")
    for n in P.THEOREMS:
        rows.append(f"('{documentclass}', '{n}', '', '{'' if n == 'theorem' else 'theorem'}', 'arabic', false)")
    return ", ".join(rows)


_EFFECTIVE = f"""(SELECT s.book_id, d.name, coalesce(r.reset_by, d.reset_by) AS reset_by, coalesce(r.shared_with, d.shared_with) AS shared_with,
 coalesce(r.style, d.style) AS style, coalesce(r.prefix_parent, d.prefix_parent) AS prefix_parent
FROM {C.duck(SETUPS)} s JOIN (VALUES {_native('book')}, {_native('article')}) d(class, name, reset_by, shared_with, style, prefix_parent) ON d.class = s.documentclass
LEFT JOIN {C.duck(RULES)} r ON r.book_id = s.book_id AND r.name = d.name)"""


@REGISTRY.add("effective_rules", f"SELECT * FROM {_EFFECTIVE}")
def effective_rules(spark, sf):
    return S.effective_rules(C.frame(spark, sf, RULES), C.frame(spark, sf, SETUPS))


@REGISTRY.add("counter_closure", f"""
WITH RECURSIVE eff AS MATERIALIZED (SELECT book_id, name, CASE WHEN shared_with <> '' THEN shared_with ELSE reset_by END AS up FROM {_EFFECTIVE}),
walk AS (SELECT book_id, name, name AS at, [name] AS seen, false AS cyclic FROM eff
 UNION ALL SELECT w.book_id, w.name, CASE WHEN list_contains(w.seen, e.up) THEN w.at ELSE e.up END, CASE WHEN list_contains(w.seen, e.up) THEN w.seen ELSE list_append(w.seen, e.up) END, list_contains(w.seen, e.up)
 FROM walk w JOIN eff e ON e.book_id = w.book_id AND e.name = w.at WHERE NOT w.cyclic AND e.up <> '')
SELECT book_id, name, arg_max(seen, len(seen) * 2 + cyclic::INT)[-1] AS root, max(len(seen)) - 1 AS depth, bool_or(cyclic) AS cyclic FROM walk GROUP BY ALL""")
def counter_closure(spark, sf):
    rules = S.effective_rules(C.frame(spark, sf, RULES), C.frame(spark, sf, SETUPS))
    return S.counter_closure(rules).withColumn("depth", F.col("depth").cast("bigint"))


# Counted elements: headings by level, theorem and lemma openings, labelled displays.
_STEPS = f"""(SELECT m.book_id, m.page, m.start, h.level AS counter FROM ({C.DUCK_MARKERS}) m JOIN {C.duck(C.HEADINGS)} h ON m.book_id = h.book_id AND m.key = h.id WHERE command = 'BAHeading'
UNION ALL SELECT book_id, page, start, CASE name WHEN 'displaymath' THEN 'equation' ELSE name END FROM ({C.DUCK_ENV_TOKENS}) WHERE op = 'begin' AND name <> 'proof')"""

# Every fifth book's rules have a cycle.
_ROOT = "CASE WHEN e.shared_with <> '' THEN e.shared_with ELSE e.name END"


@REGISTRY.add("counter_values", f"""
WITH RECURSIVE eff AS MATERIALIZED (SELECT * FROM {_EFFECTIVE} WHERE book_id % 5 <> 4),
up AS (SELECT book_id, name, reset_by AS above FROM eff WHERE shared_with = '' AND reset_by <> ''
 UNION ALL SELECT u.book_id, u.name, e.reset_by FROM up u JOIN eff e ON e.book_id = u.book_id AND e.name = u.above WHERE e.reset_by <> ''),
st AS MATERIALIZED (SELECT s.*, CAST(s.page * 4294967296 + s.start AS BIGINT) AS pos, {_ROOT} AS root FROM {_STEPS} s JOIN eff e ON e.book_id = s.book_id AND e.name = s.counter),
seg AS (SELECT s.*, (SELECT coalesce(max(r.pos), -1) FROM st r JOIN up u ON u.book_id = r.book_id AND u.name = s.root AND u.above = r.root WHERE r.book_id = s.book_id AND r.pos < s.pos) AS reset_at FROM st s)
SELECT book_id, page, start, counter, CAST(row_number() OVER (PARTITION BY book_id, root, reset_at ORDER BY pos) + CASE WHEN reset_at = -1 THEN coalesce(seed, 0) ELSE 0 END AS BIGINT) AS value, false AS cyclic
FROM seg LEFT JOIN (SELECT book_id AS sb, name AS sn, value AS seed FROM {C.duck(SEEDS)}) z ON sb = book_id AND sn = root
UNION ALL SELECT book_id, page, start, counter, NULL, true FROM {_STEPS} WHERE book_id % 5 = 4""")
def counter_values(spark, sf):
    return _counted(spark, sf).select("book_id", "page", "start", "counter", "value", "cyclic")


def _counted(spark, sf):
    pages = C.tex_pages(spark, sf)
    headings = C.frame(spark, sf, C.HEADINGS)
    marks = S.with_headings(M.markers(pages).filter(F.col("command") == "BAHeading"), headings).select(
        "book_id", "page", F.col("start").cast("bigint"), F.col("key").alias("id"), F.col("level").alias("counter"))
    opens = M.env_tokens(pages).filter((F.col("op") == "begin") & (F.col("name") != "proof")).select(
        "book_id", "page", F.col("start").cast("bigint"), F.concat(F.lit("env-"), "page", F.lit("-"), "ordinal").alias("id"),
        F.when(F.col("name") == "displaymath", "equation").otherwise(F.col("name")).alias("counter"))
    steps = cut_lineage(marks.unionByName(opens))
    rules = S.effective_rules(C.frame(spark, sf, RULES), C.frame(spark, sf, SETUPS))
    return S.materialise_counters(steps, rules, C.frame(spark, sf, SEEDS))


@REGISTRY.add("visible_numbers")
def visible_numbers(spark, sf):
    """Printed numbers with parent prefixes and styles; tests check them against a small counting model."""
    return _counted(spark, sf)
