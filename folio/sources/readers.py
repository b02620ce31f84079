"""Scans: catalogues, files, batches, ledgers, receipts, journals, bodies, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.scan import Running, page_block, position, running

CATALOG = (
    "schema_version string, default_book string, books array<struct<id:string,title:string,path:string,"
    "source_filename:string,sha256:string,page_count:int,size_bytes:bigint,scope:string>>"
)
BATCH = (
    "task_id string, pages array<struct<page:int,tex:string>>, "
    "headings array<struct<id:string,page:int,level:string,number:string,title:string>>, "
    "assets array<struct<id:string,page:int,bbox:array<double>>>, head string, tail string, "
    "unclosed_environments array<struct<name:string,label:string,begin_page:int,begin_line:int>>"
)
EVENT = "method string, data string, type string, message string"
JOURNAL_METHODS = ["item/started", "item/completed", "turn/completed", "thread/tokenUsage/updated", "error"]


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Books of nested JSON catalogues."""
    found = spark.read.schema(CATALOG).option("multiLine", True).json(path)
    return found.select("schema_version", "default_book", F.explode("books").alias("b")).select("schema_version", "default_book", "b.*")


def catalog_mismatches(catalog: DataFrame, inventory: DataFrame) -> DataFrame:
    """Catalogue entries whose file has another hash or is missing."""
    seen = inventory.select(F.substring_index("path", "/", -1).alias("_name"), F.col("sha256").alias("_now"))
    named = catalog.withColumn("_name", F.substring_index("path", "/", -1))
    return named.join(seen, "_name", "left").filter(~F.col("sha256").eqNullSafe(F.col("_now"))).select("id", F.lit("SOURCE_CHANGED").alias("code"))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "modificationTime")


def read_batches(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """Batches of JSON files, one row per batch, with the file each came from; a file is a batch, or each of its lines."""
    return spark.read.schema(BATCH).option("multiLine", not by_line).json(path).withColumn("file", F.input_file_name())


def batch_pages(batches: DataFrame) -> DataFrame:
    return batches.select("task_id", "head", "tail", F.posexplode("pages").alias("ord", "p")).select("task_id", "head", "tail", "ord", "p.page", "p.tex")


def batch_headings(batches: DataFrame) -> DataFrame:
    return batches.select("task_id", F.posexplode("headings").alias("ord", "h")).select("task_id", "ord", "h.*")


def batch_assets(batches: DataFrame) -> DataFrame:
    return batches.select("task_id", F.posexplode("assets").alias("ord", "a")).select("task_id", "ord", "a.*")


def read_ledger(spark: SparkSession, path: str, metadata_schema: str | None = None) -> DataFrame:
    """Calls from parquet, JSON metadata parsed where a schema is given."""
    calls = spark.read.parquet(path)
    if metadata_schema:
        calls = calls.withColumn("metadata", F.from_json("metadata", metadata_schema))
    return calls


def read_ledger_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int) -> DataFrame:
    """A ledger table of a database, read in parallel ranges of a number column."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper,
                                          numPartitions=partitions).load())


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """Saved requests, answers and feedback, one row per file; plain text stays, its `value` is null."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    return files.select(
        F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("call_id"), F.regexp_extract("file", r"/([^/]+)\.[^/.]+$", 1).alias("kind"),
        F.col("value").alias("text"), F.try_parse_json("value").alias("value"))


def receipt_feedback(receipts: DataFrame) -> DataFrame:
    """Structured feedback in receipts: inside the prompt of a request, or beside it. Anything else is no evidence."""
    prompt = F.try_parse_json(F.try_variant_get("value", "$.prompt", "string"))
    inside = F.try_variant_get(prompt, "$.repair_feedback", "variant")
    beside = F.try_variant_get("value", "$.feedback", "variant")
    found = receipts.withColumn("_f", F.when(F.col("kind") == "request", inside).otherwise(beside))
    candidate = F.try_variant_get("_f", "$.candidate", "variant")
    return found.filter(candidate.isNotNull() & ~F.is_variant_null(candidate)).select(
        "call_id", F.sha2(F.to_json(candidate), 256).alias("output_hash"),
        F.try_variant_get("_f", "$.code", "string").alias("code"), F.try_variant_get("_f", "$.error", "string").alias("message"))


def read_events(spark: SparkSession, path: str, methods: list[str] | None = None) -> DataFrame:
    """Journal lines of the wanted methods."""
    return journal(spark.read.text(path), methods)


def journal(lines: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Events from JSON lines; broken lines (a writer died) are dropped."""
    parsed = lines.select(F.try_parse_json("value").alias("event")).filter(F.col("event").isNotNull())
    kind = F.coalesce(F.try_variant_get("event", "$.method", "string"), F.try_variant_get("event", "$.type", "string"))
    return parsed.select(kind.alias("method"), "event").filter(F.col("method").isin(methods or JOURNAL_METHODS))


# --- bodies -----------------------------------------------------------------


def split_pages(bodies: DataFrame) -> DataFrame:
    """Pages of assembled bodies (book_id, body) by their page marker lines, trimmed, with the marker's line."""
    marks = F.regexp_extract_all("body", F.lit(P.PAGE_MARKER), F.lit(1))
    pieces = F.split("body", P.PAGE_MARKER, -1)
    trimmed = F.transform(F.slice(pieces, 2, 2147483646), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+\z", ""))
    placed = F.transform(X.matches(F.col("body"), P.PAGE_MARKER), lambda m: m["line"])
    rows = F.zip_with(F.arrays_zip(marks.alias("mark"), trimmed.alias("tex")), placed, lambda a, line: F.struct(a["mark"].alias("page"), a["tex"].alias("tex"), line.alias("line")))
    return bodies.select("book_id", F.posexplode(rows).alias("ord", "p")).select("book_id", "ord", F.col("p.page").cast("bigint").alias("page"), "p.tex", "p.line")


def source_map(bodies: DataFrame) -> DataFrame:
    """Page → line of its marker, from 1."""
    return split_pages(bodies).select("book_id", "page", "line")


def strict_coverage(bodies: DataFrame, expected: DataFrame) -> DataFrame:
    """PAGE_COVERAGE: bodies whose markers are not the expected pages in order (book_id, ord, page)."""
    got = split_pages(bodies).select("book_id", "ord", F.col("page").alias("_got"))
    rows = got.join(expected.select("book_id", "ord", F.col("page").alias("_want")), ["book_id", "ord"], "full")
    return rows.filter(~F.col("_got").eqNullSafe(F.col("_want"))).select("book_id", F.lit("PAGE_COVERAGE").alias("code")).distinct()


ENTRY = r"\\input\{([A-Za-z0-9_./-]+)\}\r?\n"


def read_project_body(bodies: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, violations) of project bodies (project_id, content) whose text is only a list of inputs.

    Parts come in order (project_id, ord, path, content); another body is its own single part. STRUCTURE_PATH reports
    unsafe and missing names.
    """
    names = F.regexp_extract_all("content", F.lit(ENTRY), F.lit(1))
    pure = (F.size(names) > 0) & (F.regexp_replace("content", ENTRY, "") == "")
    plain = bodies.filter(~pure).select("project_id", F.lit(0).alias("ord"), F.lit("body.tex").alias("path"), "content")
    listed = bodies.filter(pure).select("project_id", F.posexplode(names).alias("ord", "name"))
    unsafe = F.exists(F.split("name", "/"), lambda p: p.isin("", ".", ".."))
    paths = listed.withColumn("unsafe", unsafe).withColumn("path", F.concat("name", F.lit(".tex")))
    joined = paths.join(files.select("project_id", "path", "content"), ["project_id", "path"], "left")
    bad = joined.filter(F.col("unsafe") | F.col("content").isNull()).select("project_id", F.lit("STRUCTURE_PATH").alias("code"), "path")
    good = joined.filter(~F.col("unsafe") & F.col("content").isNotNull()).select("project_id", "ord", "path", "content")
    return plain.unionByName(good), bad


# --- logs -------------------------------------------------------------------


def log_errors(logs: DataFrame) -> DataFrame:
    """File, line and message of errors in compile logs (run_id, log)."""
    group = lambda n: F.regexp_extract_all("log", F.lit(P.LOG_FILE_ERROR), F.lit(n))
    rows = F.arrays_zip(group(1).alias("file"), group(2).alias("line"), group(3).alias("message"))
    return logs.select("run_id", F.posexplode(rows).alias("ord", "e")).select("run_id", "ord", "e.file", F.col("e.line").cast("bigint").alias("line"), "e.message")


def log_warnings(logs: DataFrame) -> DataFrame:
    """Keys of undefined-reference warnings, white space removed."""
    found = F.regexp_extract_all("log", F.lit(P.LOG_UNDEFINED), F.lit(0))
    return logs.select("run_id", F.posexplode(found).alias("ord", "w")).select(
        "run_id", "ord", F.regexp_replace(F.regexp_extract("w", P.LOG_UNDEFINED_KEY, 1), r"\s+", "").alias("key"))


def compile_verdict(logs: DataFrame, reviews: DataFrame, tail: int | None = None) -> DataFrame:
    """TEX_ERROR, REFERENCE_ERROR or null per log (run_id, log, exit_code), warnings awaiting a person left aside.

    The log comes back whole, or its last `tail` characters.

    Keys waiting for a person are few per run; they ride along as one array.
    """
    waiting = reviews.groupBy("run_id").agg(F.collect_set("key").alias("_keys"))
    joined = logs.join(waiting, "run_id", "left").withColumn("_keys", F.coalesce("_keys", F.expr("cast(array() as array<string>)")))
    pieces = F.split("log", P.LOG_UNDEFINED, -1)
    found = F.regexp_extract_all("log", F.lit(P.LOG_UNDEFINED), F.lit(0))

    def known(w: Column) -> Column:
        return F.array_contains(F.col("_keys"), F.regexp_replace(F.regexp_extract(w, P.LOG_UNDEFINED_KEY, 1), r"\s+", ""))

    kept = F.array_join(F.zip_with(pieces, found, lambda p, w: F.concat(p, F.when(known(w), "").otherwise(F.coalesce(w, F.lit(""))))), "")
    deferred = F.exists(found, known)
    active = F.when(deferred, F.replace(kept, F.lit(P.LOG_SUMMARY_WARNING), F.lit(""))).otherwise(kept)
    rows = joined.withColumn("active", active)
    rerun = F.col("active").rlike(P.LOG_RERUN)
    broken = F.col("active").rlike(P.LOG_UNDEFINED) | F.col("active").rlike(P.LOG_REFERENCE)
    code = F.when(F.col("exit_code") != 0, "TEX_ERROR").when(rerun | broken, "REFERENCE_ERROR")
    return rows.select("run_id", code.alias("code"), rerun.alias("rerun"), (F.right("active", F.lit(tail)) if tail else F.col("active")).alias("log"),
                       F.array_sort(F.array_distinct(F.transform(F.filter(found, known), lambda w: F.regexp_replace(F.regexp_extract(w, P.LOG_UNDEFINED_KEY, 1), r"\s+", "")))).alias("deferred"))


# --- rendered line positions ------------------------------------------------


def rendered_lines(rendered: DataFrame) -> DataFrame:
    """First line of each page's text inside its book's rendered body (book_id, page, marker, text)."""
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    sized = rendered.withColumn("_n", breaks("text").cast("bigint"))
    pos = position(F.col("page"), F.lit(0))
    summed = running(sized, ["book_id"], ["page"], page_block(pos), [Running("_upto", "sum", F.col("_n"))])
    return summed.select("book_id", "page", (1 + F.col("_upto") - F.col("_n") + breaks("marker")).alias("line"))
