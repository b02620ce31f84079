"""The library of books and the provenance of their runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage


def split_library(books: DataFrame, deleted: bool) -> DataFrame:
    return books.filter(F.coalesce("deleted", F.lit(False)) == deleted)


def title_filter(books: DataFrame, query: str) -> DataFrame:
    """Case-insensitive part of the title; blanks around the query do not count."""
    return books.filter(F.contains(X.fold_case(F.col("title")), F.lit(query.strip().casefold())))


def numeric_key(title: Column) -> Column:
    """Sort key in which runs of digits compare as numbers: without leading zeros, after their length in eight digits."""
    runs = F.regexp_extract_all(title, F.lit(r"\d+|\D+"), F.lit(0))

    def number(digits: Column) -> Column:
        return F.concat(F.lpad(F.length(digits).cast("string"), 8, "0"), digits)

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(F.ltrim(r, F.lit("0")))).otherwise(r)), "")


def library_keys(key: str) -> list[Column]:
    """Sort columns of an order: recent (newest first), title (numbers by value, Chinese by pronunciation) or pages."""
    if key == "title":
        return [F.collate(numeric_key(F.col("title")), P.TITLE_COLLATION), F.col("id")]
    return [F.desc("page_count"), F.desc("id")] if key == "pages" else [F.desc("id")]


def sort_library(books: DataFrame, key: str) -> DataFrame:
    return books.orderBy(*library_keys(key))


def book_state(books: DataFrame, runs: DataFrame) -> DataFrame:
    """running, has_result or none."""
    busy = runs.groupBy(F.col("book_id").alias("id")).agg(F.max(F.col("state") == "RUNNING").alias("_busy"))
    state = F.when(F.coalesce("_busy", F.lit(False)), "running").when(F.coalesce("has_result", F.lit(False)), "has_result").otherwise("none")
    return books.join(busy, "id", "left").withColumn("state", state).drop("_busy")


def setup_pages(runs: DataFrame, books: DataFrame) -> DataFrame:
    """Pages to study first: the chosen ones, or the first three, together with the last three.

    `runs` has id, book_id and chosen (array of pages, possibly empty).
    """
    joined = runs.join(books.select(F.col("id").alias("book_id"), "page_count"), "book_id")
    count = F.col("page_count").cast("int")
    first = F.sequence(F.lit(1), F.least(F.lit(3), count))
    chosen = F.when(F.size("chosen") > 0, F.transform("chosen", lambda p: p.cast("int"))).otherwise(first)
    last = F.sequence(F.greatest(F.lit(1), count - 2), count)
    return joined.select("id", "book_id", F.array_sort(F.array_distinct(F.concat(chosen, last))).alias("pages"))


def latest_output(paths: DataFrame) -> DataFrame:
    """The output of the highest revision r<N> per run."""
    revision = F.regexp_extract("path", r"(?:^|/)r(\d+)/", 1).try_cast("int")
    return paths.groupBy("run_id").agg(F.max_by("path", revision).alias("path"), F.max(revision).alias("revision"))


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("run_id").agg(F.count("*").alias("n"))


def active_warnings(warnings: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active, deferred) undefined-key warnings: those whose key, without white space, waits for a person are deferred."""
    keyed = warnings.withColumn("key", F.regexp_replace("key", r"\s+", ""))
    waiting = reviews.select("run_id", "key").distinct()
    return keyed.join(waiting, ["run_id", "key"], "left_anti"), keyed.join(waiting, ["run_id", "key"], "left_semi").select("run_id", "key").distinct()


def provenance(runs: DataFrame, assets: DataFrame) -> DataFrame:
    """For each run, the nearest run on its source chain that has assets, and its distance. Null where there is none,
    also on a chain that runs into a cycle.

    `runs` has run_id and source_run_id (null at the end of a chain). Every run points up its chain, and each round
    doubles how far: a pointer continues where the run it points to has got. A run with assets points to itself. Rounds
    are about the logarithm of the longest chain; they end when no more runs arrive, and what is left goes in circles.
    """
    owners = assets.select("run_id").distinct().withColumn("has", F.lit(True))
    has = F.coalesce("has", F.lit(False))
    own = runs.select("run_id", "source_run_id").join(owners, "run_id", "left")
    now = cut_lineage(own.select("run_id", F.when(has, F.col("run_id")).otherwise(F.col("source_run_id")).alias("at"),
                                 F.when(has, 0).otherwise(1).alias("depth"), (has | F.col("source_run_id").isNull()).alias("done")))
    moving = None
    while True:
        left = now.filter(~F.col("done")).agg(F.count("*").alias("n")).first()["n"]
        if not left or left == moving:
            break
        moving = left
        up = now.select(F.col("run_id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        further = now.filter(~F.col("done")).join(up, "at", "left").select(
            "run_id", F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.coalesce("_done", F.lit(True)).alias("done"))
        now = cut_lineage(now.filter("done").unionByName(further))
    there = F.col("done") & F.col("at").isNotNull()
    return now.select("run_id", F.when(there, F.col("at")).alias("source_run"), F.when(there, F.col("depth")).alias("depth"))


def asset_inventory(manifest: DataFrame, markers: DataFrame, files: DataFrame, books: DataFrame) -> DataFrame:
    """Images known from markers or from files in use, with their record where there is one.

    `manifest`: book_id, id, page, bbox. `markers`: book_id, id. `files`: book_id, id, used (mentioned in the text).
    """
    from .rules import valid_box

    keys = ["book_id", "id"]
    mentioned = markers.select(*keys).distinct().withColumn("_marker", F.lit(True))
    present = files.groupBy(*keys).agg(F.max("used").alias("_used")).withColumn("_file", F.lit(True))
    joined = mentioned.join(present, keys, "full").filter(F.coalesce("_marker", F.lit(False)) | F.coalesce("_used", F.lit(False)))
    joined = joined.filter(F.col("id").rlike("^(?:" + P.ASSET_ID + r")\z")).join(manifest.select(*keys, "page", "bbox"), keys, "left")
    known = F.col("page").isNotNull() & F.col("page").between(F.lit(1), F.col("page_count")) & valid_box(F.col("bbox"))
    return joined.join(books.select("book_id", "page_count"), "book_id", "left").select(
        *keys, "page", F.coalesce("_file", F.lit(False)).alias("available"), F.coalesce(known, F.lit(False)).alias("repairable"))
