"""Corpora that the registered queries run on, derived from the given tables.

The derivations are SQL that Spark and the checking engine both run, so they agree by construction; the operators
under test are DataFrame code on one side and separate SQL on the other. `@table` marks an input table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BS = "chr(92)"
NL = "chr(10)"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a shared derivation on Spark."""
    for table in set(re.findall(r"@(\w+)", sql)):
        load(spark, sf_dir, table).createOrReplaceTempView(f"folio_input_{table}")
    return spark.sql(re.sub(r"@(\w+)", r"folio_input_\1", sql))


def duck(sql: str) -> str:
    """The same derivation as a subquery for the checking engine."""
    return "(" + re.sub(r"@(\w+)", r"\1", sql) + ")"


def _cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _s(text: str) -> str:
    """A string literal that means the same in both engines: backslashes and line ends are spelt out."""
    pieces = []
    for piece in re.split(r"([\\\n])", text):
        if piece == "\\":
            pieces.append(BS)
        elif piece == "\n":
            pieces.append(NL)
        elif piece:
            pieces.append("'" + piece.replace("'", "''") + "'")
    return ", ".join(pieces)


# --- pages of TeX from lineitem: an order is a page, 250 orders are a book ---------------------------------

_N = "concat(CAST(l_partkey % 12 AS STRING), '.', CAST(l_suppkey % 5 AS STRING))"
_ID = "concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING))"

_FRAGMENT_TEXT = f"""
CASE
 WHEN l_linenumber = 1 THEN {_cat(_s(chr(92) + 'BAHeading{h'), _ID, _s('}' + chr(10) + 'Opening words.' + chr(10)))}
 WHEN l_linenumber = 2 THEN {_cat(_s(chr(92) + 'begin{theorem}' + chr(92) + 'label{theorem:'), _N, _s('}' + chr(10)))}
 WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN {_cat(_s('% see ' + chr(92) + 'ref{lemma:'), _N, _s('} ' + chr(92) + 'end{proof}' + chr(10)))}
 WHEN l_linenumber = 3 AND l_returnflag = 'N' THEN {_cat(_s(chr(92) + '% see ' + chr(92) + 'ref{lemma:'), _N, _s('} ' + chr(92) + 'end{proof}' + chr(10)))}
 WHEN l_linenumber = 3 THEN {_cat(_s(chr(92) * 2 + '% see ' + chr(92) + 'ref{lemma:'), _N, _s('} ' + chr(92) + 'end{proof}' + chr(10)))}
 WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN {_cat(_s('See ' + chr(92) + 'ref{theorem:'), _N, _s('} and ' + chr(92) + 'BAFigure{f'), _ID, _s('}' + chr(10)))}
 WHEN l_linenumber = 4 THEN {_cat(_s('See ' + chr(92) + 'ref{theorem:'), _N, _s('}.' + chr(10)))}
 WHEN l_linenumber = 5 THEN {_cat(_s(chr(92) + 'end{theorem}' + chr(10)))}
 WHEN l_linenumber = 6 AND l_linestatus = 'O' THEN {_cat(_s(chr(92) + 'begin{lemma}' + chr(92) + 'label{lemma:'), _N, _s('} ' + chr(92) + '[x=1' + chr(92) + 'label{equation:'), _N, _s('}' + chr(92) + ']' + chr(10)))}
 WHEN l_linenumber = 6 THEN {_cat(_s(chr(92) + 'begin{proof}We argue.' + chr(10)))}
 WHEN l_linestatus = 'O' THEN {_cat(_s(chr(92) + 'end{lemma} ' + chr(92) + 'eqref{equation:'), _N, _s('}' + chr(10)))}
 ELSE {_cat(_s(chr(92) + 'end{proof} ' + chr(92) + 'nameref{section:'), _N, _s('}' + chr(10)))}
END
"""

# book_id, page, seq of the fragment in its page, kind and flags, key number, record id, text.
FRAGMENTS = f"""
SELECT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 l_orderkey AS orderkey, l_partkey AS partkey, l_suppkey AS suppkey,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS seq,
 CAST(l_linenumber AS BIGINT) AS kind, l_returnflag AS flag, l_linestatus AS status,
 {_N} AS num, {_ID} AS rid, {_FRAGMENT_TEXT} AS frag
FROM @lineitem
"""


def tex_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, FRAGMENTS)


# The order of the fragments of a page, as in FRAGMENTS.
_FRAGMENT_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def tex_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of TeX; the fragments of one order are few, so joining them is a bounded group.

    They move once, to their page, and are sorted there by what numbers them in FRAGMENTS.
    """
    rows = frame(spark, sf_dir, f"""
SELECT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 {", ".join(_FRAGMENT_ORDER)}, {_FRAGMENT_TEXT} AS frag
FROM @lineitem""")
    return (
        rows.repartition("book_id", "page")
        .groupBy("book_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct(*_FRAGMENT_ORDER, "frag"))).alias("parts"))
        .select("book_id", "page", F.array_join(F.transform("parts", lambda p: p["frag"]), "").alias("tex"))
    )


# The same pages for the checking engine.
TEX_PAGES = f"SELECT book_id, page, string_agg(frag, '' ORDER BY seq) AS tex FROM {duck(FRAGMENTS)} GROUP BY book_id, page"

# Tokens by construction: the checking side never parses, it knows what each fragment holds and adds up lengths.
_PLACED = f"""
SELECT *, CAST(coalesce(sum(length(frag)) OVER w - length(frag), 0) AS BIGINT) AS base,
 CAST(coalesce(sum(length(frag) - length(replace(frag, {NL}, ''))) OVER w - (length(frag) - length(replace(frag, {NL}, ''))), 0) AS BIGINT) AS base_line
FROM {duck(FRAGMENTS)}
WINDOW w AS (PARTITION BY book_id, page ORDER BY seq ROWS UNBOUNDED PRECEDING)
"""


def _token(where: str, command: str, key: str, at: str) -> str:
    return (
        f"SELECT book_id, page, seq, '{command}' AS command, {key} AS key, "
        f"base + {at} AS start, base + {at} + length('{command}') + length({key}) + 3 AS \"end\" "
        f"FROM placed WHERE {where}"
    )


def _at(literal: str) -> str:
    return f"(instr(frag, {_cat(_s(literal))}) - 1)"


DUCK_MARKERS = f"""
WITH placed AS ({_PLACED})
{_token("kind = 1", "BAHeading", "'h' || rid", "0")}
UNION ALL {_token("kind = 2", "label", "'theorem:' || num", "length('xbegin{theorem}')")}
UNION ALL {_token("kind = 3 AND flag <> 'A'", "ref", "'lemma:' || num", _at(chr(92) + 'ref{'))}
UNION ALL {_token("kind = 4", "ref", "'theorem:' || num", "4")}
UNION ALL {_token("kind = 4 AND flag = 'R'", "BAFigure", "'f' || rid", _at(chr(92) + 'BAFigure{'))}
UNION ALL {_token("kind = 6 AND status = 'O'", "label", "'lemma:' || num", "length('xbegin{lemma}')")}
UNION ALL {_token("kind = 6 AND status = 'O'", "label", "'equation:' || num", _at(chr(92) + 'label{equation'))}
UNION ALL {_token("kind = 7 AND status = 'O'", "eqref", "'equation:' || num", _at(chr(92) + 'eqref{'))}
UNION ALL {_token("kind = 7 AND status <> 'O'", "nameref", "'section:' || num", _at(chr(92) + 'nameref{'))}
"""

DUCK_SYMBOLS = f"""
SELECT book_id, page,
 'p' || page || '-' || category || '-' || (row_number() OVER (PARTITION BY book_id, page, category ORDER BY start) - 1) AS id,
 category, command, key, split_part(key, ':', 1) AS kind, split_part(key, ':', 2) AS number, start, "end"
FROM (SELECT *, CASE command WHEN 'label' THEN 'label' ELSE 'reference' END AS category
      FROM ({DUCK_MARKERS}) WHERE command NOT IN ('BAHeading', 'BAFigure'))
"""


def _env(where: str, op: str, name: str, at: str) -> str:
    return (
        f"SELECT book_id, page, '{op}' AS op, {name} AS name, base + {at} AS start, base_line + 1 AS line "
        f"FROM placed WHERE {where}"
    )


DUCK_ENV_TOKENS = f"""
WITH placed AS ({_PLACED})
{_env("kind = 2", "begin", "'theorem'", "0")}
UNION ALL {_env("kind = 2", "label", "'theorem:' || num", "length('xbegin{theorem}')")}
UNION ALL {_env("kind = 3 AND flag = 'N'", "end", "'proof'", _at(chr(92) + 'end{proof}'))}
UNION ALL {_env("kind = 5", "end", "'theorem'", "0")}
UNION ALL {_env("kind = 6 AND status = 'O'", "begin", "'lemma'", "0")}
UNION ALL {_env("kind = 6 AND status = 'O'", "label", "'lemma:' || num", "length('xbegin{lemma}')")}
UNION ALL {_env("kind = 6 AND status = 'O'", "begin", "'displaymath'", _at(chr(92) + '['))}
UNION ALL {_env("kind = 6 AND status = 'O'", "label", "'equation:' || num", _at(chr(92) + 'label{equation'))}
UNION ALL {_env("kind = 6 AND status = 'O'", "end", "'displaymath'", _at(chr(92) + ']'))}
UNION ALL {_env("kind = 6 AND status <> 'O'", "begin", "'proof'", "0")}
UNION ALL {_env("kind = 7 AND status = 'O'", "end", "'lemma'", "0")}
UNION ALL {_env("kind = 7 AND status <> 'O'", "end", "'proof'", "0")}
"""

# Heading records: the id fixes level, number and title.
HEADINGS = f"""
SELECT DISTINCT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 concat('h', {_ID}) AS id,
 CASE l_partkey % 5 WHEN 0 THEN 'part' WHEN 1 THEN 'chapter' WHEN 2 THEN 'section' WHEN 3 THEN 'subsection' ELSE 'subsubsection' END AS level,
 CASE WHEN l_partkey % 3 = 0 THEN '' ELSE concat(CAST(l_partkey % 12 AS STRING), '.', CAST(l_partkey % 4 AS STRING)) END AS number,
 concat('Title ', CAST(l_partkey AS STRING)) AS title
FROM @lineitem WHERE l_linenumber = 1
"""

# Figure records; the last of every seven carries a broken box.
ASSETS = f"""
SELECT DISTINCT CAST(floor(l_orderkey / 250) AS BIGINT) AS book_id, CAST(l_orderkey % 250 + 1 AS BIGINT) AS page,
 concat('f', {_ID}) AS id,
 CAST(l_partkey % 7 AS DOUBLE) / 10 AS x0, CAST(l_partkey % 5 AS DOUBLE) / 10 AS y0,
 CAST(l_partkey % 7 + l_partkey % 4 AS DOUBLE) / 8 AS x1, CAST(l_partkey % 5 + 3 AS DOUBLE) / 8 AS y1
FROM @lineitem WHERE l_linenumber = 4 AND (l_returnflag = 'R' OR l_partkey % 11 = 0)
"""

# One row per page with its batch of three pages and the claims of the batch about its edges.
BATCH_PAGES = """
SELECT book_id, page, CAST(floor((page - 1) / 3) AS BIGINT) AS batch_no,
 min(page) OVER (PARTITION BY book_id, floor((page - 1) / 3)) AS first_page,
 max(page) OVER (PARTITION BY book_id, floor((page - 1) / 3)) AS last_page,
 floor((page - 1) / 3) = floor((max_page - 1) / 3) AS is_last, head, tail
FROM (SELECT CAST(floor(o_orderkey / 250) AS BIGINT) AS book_id, CAST(o_orderkey % 250 + 1 AS BIGINT) AS page,
        CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'paragraph' END AS head,
        CASE WHEN o_orderstatus = 'O' THEN 'math' ELSE 'closed' END AS tail
      FROM @orders WHERE o_orderkey IN (SELECT l_orderkey FROM @lineitem)) p
JOIN (SELECT CAST(floor(l_orderkey / 250) AS BIGINT) AS b, max(l_orderkey % 250 + 1) AS max_page FROM @lineitem GROUP BY 1) m ON b = book_id
"""

# --- pages of HTML -----------------------------------------------------------------------------------------

HTML_PAGES = "SELECT page_id AS book_id, CAST(1 AS BIGINT) AS page, html AS tex FROM @pages"

# --- the ledger from events: a user is a task, six users are a run -----------------------------------------

_CALL_BASE = """
SELECT event_id, user_id, event_type, value, ts,
 CAST(replace(replace(replace(props, chr(123), ''), chr(125), ''), '"k": ', '') AS BIGINT) AS k,
 CAST(floor(user_id / 6) AS BIGINT) AS run_no
FROM @events
"""

# One row per call in ledger order `seq`, with typed metadata and the provider's usage as JSON.
CALLS = f"""
SELECT concat('c', CAST(event_id AS STRING)) AS id, event_id AS seq, concat('r', CAST(run_no AS STRING)) AS run_id,
 CAST(1 + k % 4 AS BIGINT) AS revision,
 CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'RESERVED'
  WHEN 'error' THEN 'FAILED' ELSE 'RESULT_UNKNOWN' END AS state,
 CASE k % 5 WHEN 0 THEN 'convert' WHEN 1 THEN 'seams' WHEN 2 THEN 'headings' WHEN 3 THEN 'references' ELSE 'counter_repair' END AS purpose,
 CASE WHEN k % 13 = 0 THEN CAST(NULL AS STRING) ELSE concat('t', CAST(user_id AS STRING)) END AS task_id,
 CASE WHEN k % 17 = 0 THEN CAST(NULL AS STRING) ELSE concat('in', CAST(user_id % 6 AS STRING), '-', CAST(k % 10 AS STRING)) END AS input_hash,
 CASE WHEN event_type IN ('purchase', 'click') THEN concat('out', CAST(k % 8 AS STRING)) END AS output_hash,
 CASE WHEN k % 6 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(1 + k % 3 AS BIGINT) END AS attempt,
 k % 3 = 0 AS repair, k % 19 = 0 AND event_type = 'error' AS retry_exhausted,
 CASE WHEN k % 11 = 0 THEN '' ELSE concat('conn', CAST(k % 3 AS STRING)) END AS connection_id,
 concat('model', CAST(k % 4 AS STRING)) AS model_id, CASE WHEN k % 2 = 0 THEN 'medium' ELSE 'high' END AS effort,
 CASE WHEN k % 9 = 0 THEN 'codex' END AS agent, '0.7.0' AS prompt_version,
 CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'RATE_LIMITED' WHEN 1 THEN 'SCHEMA_ERROR' WHEN 2 THEN 'REQUEST_FAILED' ELSE 'OTHER' END END AS error_code,
 CASE WHEN event_type = 'error' AND k % 7 = 0 THEN 'Selected model is At Capacity' WHEN event_type = 'error' THEN concat('failure ', CAST(k AS STRING)) END AS error_message,
 CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'FAILED' WHEN event_type = 'purchase' THEN 'PASSED' END AS validation_state,
 CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN 'UNRESOLVED_REFERENCE' END AS validation_code,
 CASE WHEN event_type = 'purchase' AND k % 4 = 0 THEN concat('rejected ', CAST(k AS STRING)) END AS validation_message,
 CAST(event_id AS DOUBLE) * 60 AS started_at,
 CASE WHEN event_type = 'view' THEN CAST(NULL AS DOUBLE) ELSE CAST(event_id AS DOUBLE) * 60 + value END AS finished_at,
 k,
 CASE k % 6
  WHEN 0 THEN concat('{{"tokens":{{"total":{{"inputTokens":', CAST(k * 3 AS STRING), ',"outputTokens":', CAST(k AS STRING), ',"reasoningOutputTokens":2,"cachedInputTokens":1,"totalTokens":', CAST(k * 4 AS STRING), '}}}}}}')
  WHEN 1 THEN concat('{{"input_tokens":', CAST(k * 2 AS STRING), ',"output_tokens":', CAST(k + 1 AS STRING), ',"input_tokens_details":{{"cached_tokens":', CAST(k AS STRING), '}}}}')
  WHEN 2 THEN concat('{{"prompt_tokens":', CAST(k + 5 AS STRING), ',"completion_tokens":', CAST(k AS STRING), ',"total_tokens":', CAST(2 * k + 5 AS STRING), '}}')
  WHEN 3 THEN concat('{{"promptTokenCount":', CAST(k AS STRING), ',"candidatesTokenCount":7,"cachedContentTokenCount":', CAST(k AS STRING), '}}')
  WHEN 4 THEN '{{"note":"unknown"}}' END AS usage, ts
FROM ({_CALL_BASE}) base
"""

RUNS = """
SELECT DISTINCT concat('r', CAST(CAST(floor(user_id / 6) AS BIGINT) AS STRING)) AS run_id,
 CASE WHEN floor(user_id / 6) % 3 = 0 THEN 'PAUSED' ELSE 'RUNNING' END AS state,
 floor(user_id / 6) % 5 = 1 AS pause_requested, CAST(2 AS BIGINT) AS repair_epoch
FROM @events
"""

TASKS = """
SELECT DISTINCT concat('r', CAST(CAST(floor(user_id / 6) AS BIGINT) AS STRING)) AS run_id, concat('t', CAST(user_id AS STRING)) AS id,
 CASE user_id % 5 WHEN 0 THEN 'convert' WHEN 1 THEN 'seams' WHEN 2 THEN 'headings' WHEN 3 THEN 'references' ELSE 'counter_repair' END AS stage,
 CASE user_id % 9 WHEN 0 THEN 'PASSED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'WAITING_MERGE' WHEN 3 THEN 'DEFERRED' WHEN 4 THEN 'NEEDS_REVIEW'
  WHEN 5 THEN 'RUNNING' WHEN 6 THEN 'PENDING' WHEN 7 THEN 'PAUSED' ELSE 'RUNNING' END AS state,
 CASE WHEN user_id % 9 = 4 THEN 'REPAIR_LIMIT' WHEN user_id % 9 = 3 THEN 'REFERENCE_REVIEW' WHEN user_id % 9 = 5 THEN 'SCHEMA_ERROR' END AS error_code,
 CASE WHEN user_id % 9 IN (3, 4, 5) THEN concat('task note ', CAST(user_id AS STRING)) END AS error_message,
 user_id % 9 = 5 AS repairing, user_id * 3 + 1 AS first_page
FROM @events
"""

# --- project files from part -------------------------------------------------------------------------------

FILES_BEFORE = """
SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS project_id,
 concat('sections/', replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), CASE p_size % 4 WHEN 0 THEN '.png' ELSE '.tex' END) AS path,
 concat(p_name, ' ', p_brand, chr(10), p_type, chr(10)) AS content, p_partkey AS ord, p_size
FROM @part
"""

FILES_AFTER = """
SELECT CAST(floor(p_partkey / 20) AS BIGINT) AS project_id,
 concat(CASE WHEN p_size % 13 = 0 THEN 'added/' ELSE 'sections/' END, replace(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), CASE p_size % 4 WHEN 0 THEN '.png' ELSE '.tex' END) AS path,
 concat(p_name, ' ', CASE WHEN p_size % 7 = 0 THEN 'changed' ELSE p_brand END, chr(10), p_type, chr(10)) AS content, p_partkey AS ord, p_size
FROM @part WHERE p_size % 10 <> 0
"""

# --- a library of books from customer, their runs from orders ----------------------------------------------

BOOKS = """
SELECT c_custkey AS id, c_name AS title, CAST(10 + c_custkey % 400 AS BIGINT) AS page_count, c_custkey * 1000 AS size_bytes,
 CASE WHEN c_custkey % 7 = 0 THEN CAST(NULL AS BOOLEAN) ELSE c_acctbal < 0 END AS deleted, c_mktsegment = 'BUILDING' AS has_result
FROM @customer
"""

BOOK_RUNS = """
SELECT o_orderkey AS id, o_custkey AS book_id, o_totalprice AS price,
 CASE o_orderstatus WHEN 'O' THEN 'COMPLETED' WHEN 'P' THEN 'RUNNING' ELSE 'PAUSED' END AS state,
 CAST(1 + o_orderkey % 6 AS BIGINT) AS revision, CAST(1 + o_orderkey % 20 AS BIGINT) AS start_page,
 CAST(1 + o_orderkey % 20 + o_orderkey % 37 AS BIGINT) AS end_page, CAST(1 + o_orderkey % 5 AS BIGINT) AS pages_per_task,
 CASE WHEN o_orderkey % 9 = 0 THEN '0.6' ELSE '0.7' END AS workflow_version
FROM @orders
"""
