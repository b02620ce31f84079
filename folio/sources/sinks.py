"""Sinks: tables, rendered bodies, headings and counter declarations, review exports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the versions of a table: all, and those that are complete."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    named = [(int(f.getName()[1:]), f) for f in found if re.fullmatch(r"v\d+", f.getName())]
    return [n for n, _ in named], [n for n, f in named if files.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]


def write_table(df: DataFrame, path: str) -> None:
    """Replace a table: a new version beside the old ones, which readers see once it is complete.

    A write that fails changes nothing. Old versions stay until someone deletes them. One writer at a time is assumed.
    """
    known, _ = _versions(df.sparkSession, path)
    df.write.parquet(f"{path}/v{max(known, default=0) + 1}")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The latest complete version of a table."""
    _, complete = _versions(spark, path)
    return spark.read.parquet(f"{path}/v{max(complete)}")


def render_pages(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """Each page as it appears in the body: its marker line, one source note per heading record, its text.

    Notes of a page are few; the body of a book is never one value, `write_body` writes it in order.
    """
    note = F.concat(
        F.lit("% BA source "),
        F.to_json(F.struct(F.lit("headings").alias("type"), "id", F.col("page").cast("int").alias("page"), "level", "number", "title")), F.lit("\n"))
    notes = headings.groupBy("book_id", "page").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), note.alias("n")))), lambda x: x["n"]), "").alias("_notes"))
    joined = pages.join(notes, ["book_id", "page"], "left")
    marker = F.concat(F.lit("% PDF page "), F.col("page").cast("string"), F.lit("\n"), F.coalesce("_notes", F.lit("")))
    return joined.select("book_id", "page", marker.alias("marker"), F.concat(marker, F.col("tex"), F.lit("\n")).alias("text"))


def write_body(rendered: DataFrame, path: str) -> None:
    """Bodies as text, one folder per book; part files in name order give the body."""
    ordered = rendered.repartitionByRange("book_id", "page").sortWithinPartitions("book_id", "page")
    ordered.select("book_id", F.regexp_replace("text", r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def render_headings(headings: DataFrame, setups: DataFrame) -> DataFrame:
    """Definition line of each heading: articles have no chapters, unnumbered ones get a star, the appendix its switch."""
    joined = headings.join(setups.select("book_id", "documentclass", "appendix_start"), "book_id")
    level = F.when((F.col("documentclass") == "article") & (F.col("level") == "chapter"), "section").otherwise(F.col("level"))
    command = F.concat(F.lit("\\"), level, F.when(F.col("number") != "", "").otherwise("*"), F.lit("{"), F.col("title"), F.lit("}"))
    switched = F.when(F.col("id").eqNullSafe(F.col("appendix_start")), F.concat(F.lit("\\appendix"), command)).otherwise(command)
    return joined.select(
        "book_id", "page", "id",
        F.concat(F.lit("\\expandafter\\def\\csname bah"), F.col("id"), F.lit("\\endcsname{"), switched, F.lit("}")).alias("line"))


def _braced(command: str, *args: Column) -> Column:
    parts: list[Column] = [F.lit("\\" + command)]
    for a in args:
        parts += [F.lit("{"), a, F.lit("}")]
    return F.concat(*parts)


def counter_preamble(rules: DataFrame, setups: DataFrame) -> DataFrame:
    """Declaration lines of each book's counters in order (book_id, ord, line), from its own rules.

    The theorem-like names come first, each after the counter it shares; then the print form of each own counter.
    Rules of a book are at most 18, so they travel as one map.
    """
    entry = F.struct("name", F.struct("reset_by", "shared_with", "style", "prefix_parent", "ord").alias("rule"))
    own = rules.groupBy("book_id").agg(F.map_from_entries(F.collect_set(entry)).alias("rules"))
    books = setups.select("book_id", "documentclass").join(own, "book_id", "left").withColumn(
        "rules", F.coalesce("rules", F.expr("cast(map() as map<string,struct<reset_by:string,shared_with:string,style:string,prefix_parent:boolean,ord:int>>)")))
    rule = lambda n: F.try_element_at(F.col("rules"), n)
    theorems = F.array(*[F.lit(t) for t in P.THEOREMS])

    def shared(n: Column) -> Column:
        return F.when(rule(n).isNotNull(), rule(n)["shared_with"]).when(n == "theorem", "").otherwise("theorem")

    # A name is declared after the one it shares: follow the sharing first, then keep first appearances.
    def upwards(n: Column) -> Column:
        return F.reverse(F.aggregate(
            F.sequence(F.lit(1), F.lit(len(P.THEOREMS))), F.array(n),
            lambda acc, _: F.when(shared(F.element_at(acc, -1)) == "", acc).otherwise(F.concat(acc, F.array(shared(F.element_at(acc, -1)))))))

    order = F.array_distinct(F.flatten(F.transform(theorems, upwards)))
    declared = books.withColumn("_order", order)

    def theorem_lines(n: Column) -> Column:
        title = F.initcap(n)
        parent = F.coalesce(rule(n)["reset_by"], F.lit(""))
        plain = F.concat(_braced("newtheorem", n, title), F.when(parent != "", F.concat(F.lit("["), parent, F.lit("]"))).otherwise(""))
        sharing = F.concat(_braced("newtheorem", n), F.lit("["), shared(n), F.lit("]{"), title, F.lit("}"))
        return F.array(F.when(shared(n) != "", sharing).otherwise(plain), _braced("newtheorem*", F.concat(n, F.lit("*")), title))

    names = F.transform(F.array_sort(F.transform(F.filter(F.map_entries("rules"), lambda e: e["value"]["shared_with"] == ""),
                                                 lambda e: F.struct(e["value"]["ord"], e["key"].alias("key")))), lambda e: e["key"])

    def print_lines(n: Column) -> Column:
        parent = rule(n)["reset_by"]
        levels = F.filter(F.array(*[F.lit(x) for x in P.HEADINGS[:4]]), lambda a: (a != n) & ~((F.col("documentclass") == "article") & (a == "chapter")))
        cleared = F.transform(levels, lambda a: F.concat(F.lit("\\counterwithout*{"), n, F.lit("}{"), a, F.lit("}")))
        within = F.when(parent != "", F.array(_braced("counterwithin*", n, parent))).otherwise(F.expr("cast(array() as array<string>)"))
        native = F.when(n.isin(P.BUILTIN_COUNTERS), F.concat(cleared, within)).otherwise(F.expr("cast(array() as array<string>)"))
        prefix = F.when((parent != "") & rule(n)["prefix_parent"], F.concat(F.lit("\\the"), parent, F.lit("."))).otherwise("")
        shown = F.concat(F.lit("\\renewcommand{\\the"), n, F.lit("}{"), prefix, F.lit("\\"), rule(n)["style"], F.lit("{"), n, F.lit("}}"))
        return F.concat(native, F.array(shown))

    lines = F.concat(F.flatten(F.transform("_order", theorem_lines)), F.flatten(F.transform(names, print_lines)))
    return declared.select("book_id", F.posexplode(lines).alias("ord", "line"))


def initial_counters(seeds: DataFrame) -> DataFrame:
    return seeds.select("book_id", "name", F.concat(F.lit("\\setcounter{"), "name", F.lit("}{"), F.col("value").cast("string"), F.lit("}")).alias("line"))


def review_rows(reviews: DataFrame) -> DataFrame:
    """Pending references as escaped HTML table rows (run_id, id, html); the page around them is a viewer's business."""
    def escape(c: Column) -> Column:
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    cell = lambda c: F.concat(F.lit("<td>"), escape(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    return reviews.select("run_id", "id", F.concat(
        F.lit("<tr>"), cell(F.col("key")), cell(F.col("page").cast("string")), cell(F.col("reason")), F.lit("</tr>")).alias("html"))


def review_export(reviews: DataFrame, path: str) -> None:
    """Pending references as JSON lines, a folder per run."""
    reviews.write.mode("overwrite").partitionBy("run_id").json(path)
