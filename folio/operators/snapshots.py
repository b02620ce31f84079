"""Project files: hashes, manifest differences, exact reassembly, retained results and their checks.

File tables have project_id, path and sha256 (or content). Nothing here gathers a project into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.digests import merkle_roots
from ..functions.scan import Running, running


def content_hash(files: DataFrame) -> DataFrame:
    """Merkle root of each project's path → hash map: the same for any order, and safe to trust when a snapshot is reused."""
    member = F.concat(F.col("path"), F.lit("\u0000"), F.col("sha256"))
    return merkle_roots(files, ["project_id"], member, "content_hash", "files")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were changed, removed or added."""
    a = before.select("project_id", "path", F.col("sha256").alias("_a"))
    b = after.select("project_id", "path", F.col("sha256").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, ["project_id", "path"], "full").withColumn("status", status).filter(F.col("status").isNotNull()).drop("_a", "_b")


def unlisted_files(after: DataFrame, allowed: DataFrame) -> DataFrame:
    return after.join(allowed.select("project_id", "path").distinct(), ["project_id", "path"], "left_anti")


def suffix_of(path: Column) -> Column:
    """Lower-case suffix of the last path part; a leading dot starts a name, not a suffix."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def project_files(files: DataFrame) -> DataFrame:
    """Files that belong to a project: known suffix, no hidden part, no session file, no symbolic link."""
    hidden = F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit(".")))
    link = F.coalesce(F.col("is_symlink"), F.lit(False)) if "is_symlink" in files.columns else F.lit(False)
    return files.filter(suffix_of(F.col("path")).isin(P.PROJECT_SUFFIXES) & ~hidden & ~F.endswith("path", F.lit("-session.json")) & ~link)


def safe_path(path: Column, suffixes: list[str] | None = None) -> Column:
    """Relative, portable and of an allowed kind."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: (
        p.isin("", ".", "..") | F.startswith(p, F.lit(".")) | F.endswith(p, F.lit(" ")) | F.endswith(p, F.lit("."))
        | p.rlike(r'[<>:"|?*\x00-\x1f]') | F.upper(F.substring_index(p, ".", 1)).isin(P.RESERVED_STEMS)))
    return F.coalesce(
        (path != "") & ~F.contains(path, F.lit("\\")) & ~bad & suffix_of(path).isin([*(suffixes or P.PROJECT_SUFFIXES), ".md"]), F.lit(False))


# Characters that are compared at once.
BLOCK = 4096


def _blocks(parts: DataFrame, order: str) -> DataFrame:
    """The text of each project, cut into blocks of equal length wherever its parts were cut."""
    sized = parts.select("project_id", order, "content", F.length("content").cast("bigint").alias("_n"))
    placed = running(sized, ["project_id"], [order], F.floor(F.col(order) / 1024), [Running("_end", "sum", F.col("_n"))]).filter("_n > 0")
    spread = placed.withColumn("_start", F.col("_end") - F.col("_n")).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("_start") / BLOCK), F.floor((F.col("_end") - 1) / BLOCK))))
    low, high = F.greatest("_start", F.col("block") * BLOCK), F.least("_end", (F.col("block") + 1) * BLOCK)
    pieces = spread.select("project_id", "block", F.struct(
        low.alias("at"), F.substr("content", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("text")).alias("piece"))
    return pieces.groupBy("project_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["text"]), "").alias("text"))


def reassembles(fragments: DataFrame, originals: DataFrame, order: str = "ord") -> DataFrame:
    """Whether the fragments of each project, in order, give the original body exactly, wherever they are cut.

    Both sides are compared block by block, so no project is glued together.
    """
    a, b = (_blocks(x, order).withColumnRenamed("text", n) for x, n in ((fragments, "_a"), (originals, "_b")))
    differ = a.join(b, ["project_id", "block"], "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("project_id").distinct()
    known = fragments.select("project_id").union(originals.select("project_id")).distinct()
    return known.join(differ.withColumn("_differs", F.lit(True)), "project_id", "left").select("project_id", F.col("_differs").isNull().alias("same"))


def boundary_errors(fragments: DataFrame, order: str = "ord") -> DataFrame:
    """Fragments that stop inside a line, the last one of a project excepted."""
    last = fragments.groupBy("project_id").agg(F.max(order).alias("_last"))
    return fragments.join(last, "project_id").filter((F.col(order) < F.col("_last")) & ~F.endswith("content", F.lit("\n"))).drop("_last")


MANIFEST_LINE = r"\\input\{([^{}]+)\}\r?\n?"


def manifest_entries(bodies: DataFrame) -> DataFrame:
    """Entries of each manifest body (project_id, content): their order, name and whether the whole body is a manifest."""
    names = F.regexp_extract_all("content", F.lit(MANIFEST_LINE), F.lit(1))
    pure = (F.regexp_replace("content", MANIFEST_LINE, "") == "") & (F.size(names) > 0) & (F.regexp_count("content", F.lit(r"\\input\{[^{}]+\}(?!\r?\n|$)")) == 0)
    return bodies.select("project_id", pure.alias("pure"), F.posexplode_outer(names).alias("ord", "name"))


def check_structure(before: DataFrame, after: DataFrame, bodies: DataFrame) -> DataFrame:
    """Coded rejections of a reorganised project (project_id, code, path).

    `before` and `after` have project_id, path, sha256; `after` also content. `bodies` is the new body of each project,
    and its original text is the `content` of body.tex in `before`.
    """
    kept = before.filter(F.col("path") != "body.tex")
    diff = manifest_diff(kept.select("project_id", "path", "sha256"), after.select("project_id", "path", "sha256"))
    changed = diff.filter(F.col("status").isin("changed", "missing")).select("project_id", F.lit("STRUCTURE_CHANGED").alias("code"), "path")
    entries = manifest_entries(bodies)
    impure = entries.filter(~F.col("pure") | F.col("name").isNull()).select("project_id", F.lit("STRUCTURE_MANIFEST").alias("code"), F.lit("body.tex").alias("path")).distinct()
    named = entries.filter(F.col("name").isNotNull()).withColumn("path", F.concat("name", F.lit(".tex")))
    unsafe = ~F.col("name").rlike(r"^[A-Za-z0-9_./-]+\z") | F.exists(F.split("name", "/"), lambda p: p.isin("", ".", "..")) | F.endswith("name", F.lit(".tex"))
    twice = named.groupBy("project_id", "path").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keys = ["project_id", "path"]
    path_rows = (
        named.filter(unsafe).select(*keys).union(twice.select(*keys)).union(named.join(before.select(*keys), keys, "left_semi").select(*keys))
        .union(named.join(after.select(*keys), keys, "left_anti").select(*keys)).distinct())
    paths = path_rows.select("project_id", F.lit("STRUCTURE_PATH").alias("code"), "path")
    parts = named.join(after.select(*keys, "content"), keys).select("project_id", "path", "ord", "content")
    boundary = boundary_errors(parts).select("project_id", F.lit("STRUCTURE_BOUNDARY").alias("code"), "path")
    original = before.filter(F.col("path") == "body.tex").select("project_id", F.lit(0).cast("bigint").alias("ord"), "content")
    differs = reassembles(parts.withColumn("ord", F.col("ord").cast("bigint")), original).filter(~F.col("same")).select(
        "project_id", F.lit("STRUCTURE_CONTENT").alias("code"), F.lit("body.tex").alias("path"))
    allowed = before.select(*keys).union(named.select(*keys)).union(before.select("project_id", F.lit("main.pdf").alias("path")).distinct())
    extra = unlisted_files(project_files(after), allowed).select("project_id", F.lit("STRUCTURE_FILES").alias("code"), "path")
    return changed.union(impure).union(paths).union(boundary).union(differs).union(extra)


def check_template(before: DataFrame, after: DataFrame, hook: str, layer: tuple[str, ...]) -> DataFrame:
    """TEMPLATE_CONTENT_CHANGED: files other than the style layer and the output that a restyling touched.

    The main file may gain `hook` once, before the document begins. `layer` lists path prefixes of the style layer.
    """
    layered = F.lit(False)
    for prefix in layer:
        layered = layered | (F.col("path") == prefix) | F.startswith("path", F.lit(prefix + "/"))
    kept = before.filter(~layered & (F.col("path") != "main.pdf"))
    joined = kept.select("project_id", "path", F.col("content").alias("_a")).join(
        after.select("project_id", "path", F.col("content").alias("_b")), ["project_id", "path"], "left")
    a, b = F.col("_a"), F.col("_b")
    once = (X.occurrences(b, F.lit(hook)) == 1) & ~F.contains(a, F.lit(hook))
    early = (F.locate(hook, b) > 0) & (F.locate(hook, b) < F.locate("\\begin{document}", b))
    undone = [F.replace(b, F.lit(h), F.lit("")) == a for h in (hook, hook + "\n", hook + "\r\n", "\n" + hook, "\r\n" + hook)]
    restored = undone[0]
    for u in undone[1:]:
        restored = restored | u
    hooked = (F.col("path") == "main.tex") & once & early & restored
    same = b.isNotNull() & (a.eqNullSafe(b) | hooked)
    return joined.filter(~F.coalesce(same, F.lit(False))).select("project_id", F.lit("TEMPLATE_CONTENT_CHANGED").alias("code"), "path")


def changed_sources(recorded: DataFrame, observed: DataFrame) -> DataFrame:
    """SOURCE_CHANGED: sources whose hash is not the recorded one, or which are gone."""
    now = observed.select("id", F.col("sha256").alias("_now"))
    return recorded.join(now, "id", "left").filter(~F.col("sha256").eqNullSafe(F.col("_now"))).select("id", F.lit("SOURCE_CHANGED").alias("code"))


def check_output(results: DataFrame, files: DataFrame) -> DataFrame:
    """OUTPUT_CHANGED: the files of a project no longer have the hash noted when it was accepted."""
    now = content_hash(files).select("project_id", F.col("content_hash").alias("_now"))
    return results.filter(F.col("content_hash").isNotNull()).join(now, "project_id", "left").filter(
        ~F.col("content_hash").eqNullSafe(F.col("_now"))).select("project_id", F.lit("OUTPUT_CHANGED").alias("code"))


def retain(files: DataFrame, results: DataFrame) -> DataFrame:
    """Snapshots to keep: the id is the project and its content hash; a snapshot already kept is reused."""
    now = content_hash(files).withColumn("id", F.concat_ws("-", F.col("project_id").cast("string"), F.left("content_hash", F.lit(16))))
    known = results.select("project_id", "content_hash", F.lit(True).alias("_kept"))
    return now.join(known, ["project_id", "content_hash"], "left").withColumn("reused", F.coalesce("_kept", F.lit(False))).drop("_kept")
