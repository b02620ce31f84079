"""Page batches, neighbouring pages and the alignment of patches at page boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..functions.scan import Running, page_block, position, running


def page_neighbours(pages: DataFrame) -> DataFrame:
    """Each page with the pages before and after it in its book, gaps allowed."""
    pos = position(F.col("page"), F.lit(0))
    after = -position(F.col("page"), F.lit(0))
    before = running(pages, ["book_id"], ["page"], page_block(pos), [Running("prev_page", "max", F.col("page"), inclusive=False)])
    turned = before.withColumn("_back", after)
    return running(turned, ["book_id"], ["_back"], page_block(F.col("_back")),
                   [Running("next_page", "min", F.col("page"), inclusive=False)]).drop("_back")


def assign_batches(runs: DataFrame) -> DataFrame:
    """Fixed-size page batches of each run's page range, with zero-padded ids.

    The range is contiguous, so a batch follows from its first page; nothing is numbered across rows.
    """
    starts = F.sequence(F.lit(0), F.floor((F.col("end_page") - F.col("start_page")) / F.col("pages_per_task")).cast("int"))
    rows = runs.filter(F.col("end_page") >= F.col("start_page")).select(
        F.col("id").alias("run_id"), "start_page", "end_page", "pages_per_task", F.explode(starts).alias("n"))
    first = F.col("start_page") + F.col("n") * F.col("pages_per_task")
    last = F.least(first + F.col("pages_per_task") - 1, F.col("end_page"))
    return rows.select(
        "run_id", F.format_string("batch-%04d", F.col("n") + 1).alias("batch_id"),
        (F.col("n") + 1).alias("batch_no"), F.sequence(first, last).alias("pages"))


def task_of_page(tasks: DataFrame, pages: DataFrame) -> DataFrame:
    """The task that owns each asked page of a run.

    Spark takes the exploded pages for as small as their table of tasks, so the hint keeps them from being broadcast.
    """
    owners = tasks.select("run_id", F.col("id").alias("task_id"), F.explode("pages").alias("page"))
    return pages.join(owners.hint("merge"), ["run_id", "page"], "left")


def page_pairs(batches: DataFrame) -> DataFrame:
    """Last page of a batch next to the first page of the following one.

    `batches` has book_id, batch_no (dense), page, first_page, last_page and page columns to carry. Batch numbers are
    dense, so neighbours meet by number instead of in one ordered window per book.
    """
    carried = [c for c in batches.columns if c not in ("book_id", "batch_no", "first_page", "last_page", "is_last")]
    left = batches.filter(F.col("page") == F.col("last_page")).select(
        "book_id", "batch_no", *[F.col(c).alias("left_" + c) for c in carried])
    right = batches.filter(F.col("page") == F.col("first_page")).select(
        "book_id", (F.col("batch_no") - 1).alias("batch_no"), *[F.col(c).alias("right_" + c) for c in carried])
    return left.join(right, ["book_id", "batch_no"])


def open_seams(pairs: DataFrame, open_counts: DataFrame) -> DataFrame:
    """Pairs that need work: the left edge or the right edge is not closed, or the left batch leaves something open.

    `open_counts` has book_id, batch_no and open_count.
    """
    counted = pairs.join(open_counts, ["book_id", "batch_no"], "left")
    quiet = (F.col("left_tail") == "closed") & (F.col("right_head") == "closed") & (F.coalesce("open_count", F.lit(0)) == 0)
    return counted.filter(~quiet)


# --- alignment --------------------------------------------------------------


def _shorter(text: Column, part: Column, suffix: bool) -> Column:
    """The longest beginning of `part`, up to SEAM_SLACK characters short, that still fits the edge of `text`."""
    floor = F.greatest(F.lit(8), F.floor(F.length(part) / 2).cast("int"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(P.SEAM_SLACK)), lambda cut: F.length(part) - cut)

    def fits(keep: Column) -> Column:
        head = F.substr(part, F.lit(1), keep)
        return (keep >= floor) & (F.endswith(text, head) if suffix else F.startswith(text, head))

    return F.substr(part, F.lit(1), F.get(F.filter(cuts, fits), F.lit(0)))


def align_suffix(text: Column, part: Column) -> Column:
    """`part` adjusted to the true end of `text`, or null: exact, a few characters long, or a few characters short."""
    last = F.length(text) - F.length(part) - F.position(F.reverse(part), F.reverse(text)) + 1
    gap = F.length(text) - last - F.length(part)
    found = (F.length(part) >= 8) & F.contains(text, part) & gap.between(1, P.SEAM_SLACK)
    return (
        F.when(F.endswith(text, part), part)
        .otherwise(F.coalesce(_shorter(text, part, True), F.when(found, F.substr(text, last + 1))))
    )


def align_prefix(text: Column, part: Column) -> Column:
    """`part` adjusted to the true beginning of `text`, or null."""
    first = F.position(part, text) - 1
    found = (F.length(part) >= 8) & first.between(1, P.SEAM_SLACK)
    return (
        F.when(F.startswith(text, part), part)
        .otherwise(F.coalesce(_shorter(text, part, False), F.when(found, F.substr(text, F.lit(1), first + F.length(part)))))
    )


_GAP = r"[ \t]+(?=\r?\n)"


def _source_length(text: Column, kept: Column) -> Column:
    """Length of the shortest beginning of `text` whose view without line-end space has `kept` characters."""
    gaps = X.matches(text, _GAP)
    removed = F.aggregate(
        gaps, F.lit(0), lambda acc, g: F.when(g["start"] - acc < kept, acc + F.length(g["token"])).otherwise(acc))
    return kept + removed


def align_seam(text: Column, part: Column, suffix: bool) -> Column:
    """Alignment on the text as it is, then on both texts without line-end space; the result is source text."""
    direct = align_suffix(text, part) if suffix else align_prefix(text, part)
    view, copied = X.space_view(text), X.space_view(part)
    fixed = align_suffix(view, copied) if suffix else align_prefix(view, copied)
    kept = F.length(fixed)
    if suffix:
        start = _source_length(text, F.length(view) - kept + 1) - 1
        mapped = F.substr(text, start + 1)
    else:
        mapped = F.substr(text, F.lit(1), _source_length(text, kept))
    return F.coalesce(direct, F.when(kept > 0, mapped))


def seam_mismatch(frame: DataFrame, text: str, part: str, suffix: bool) -> DataFrame:
    """Where an unaligned patch first differs, in source offsets: offset, line, column, code point and gap to the edge.

    Meant for the few rows that failed to align. The comparison skips line-end space on both sides.
    """
    view, copied = X.space_view(F.col(text)), X.space_view(F.col(part))
    a, b = (F.reverse(view), F.reverse(copied)) if suffix else (view, copied)
    chars_a, chars_b = F.split(F.col("_a"), "(?!^)(?!$)"), F.split(F.col("_b"), "(?!^)(?!$)")
    count = F.least(F.length("_a"), F.length("_b"))
    same = F.zip_with(F.slice(chars_a, F.lit(1), count), F.slice(chars_b, F.lit(1), count), lambda x, y: x == y)
    first = F.array_position(F.col("_same"), F.lit(False))
    common = F.when(first > 0, first - 1).otherwise(count).cast("int")
    edge = F.when(F.lit(suffix), F.length("_view") - F.length("_copied") - F.col("_found")).otherwise(F.col("_found"))
    found = F.when(
        (F.length("_copied") > 0) & F.contains(F.col("_view"), F.col("_copied")),
        (F.length("_view") - F.length("_copied") - F.position(F.reverse("_copied"), F.reverse("_view")) + 1) if suffix
        else (F.position("_copied", "_view") - 1),
    )
    rows = (
        frame.withColumn("_view", view).withColumn("_copied", copied).withColumn("_a", a).withColumn("_b", b)
        .withColumn("_same", same).withColumn("_common", common).withColumn("_found", found)
    )

    def place(source: Column, seen: Column) -> Column:
        at = F.length(seen) - F.col("_common") - 1 if suffix else F.col("_common")
        return F.when(at < 0, -1).when(at >= F.length(seen), F.length(source)).otherwise(_source_length(source, at + 1) - 1)

    rows = rows.withColumn("text_offset", place(F.col(text), F.col("_view"))).withColumn("part_offset", place(F.col(part), F.col("_copied")))
    before = F.substr(F.col(text), F.lit(1), F.greatest(F.lit(0), F.col("text_offset")))
    return rows.select(
        *frame.columns, "text_offset", "part_offset",
        X.line_of(F.col(text), F.greatest(F.lit(0), F.col("text_offset"))).alias("line"),
        (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"),
        F.when(F.col("text_offset").between(0, F.length(F.col(text)) - 1), F.ascii(F.substr(F.col(text), F.col("text_offset") + 1, F.lit(1)))).alias("code_point"),
        edge.alias("gap"),
    )


def marker_list(tex: Column) -> Column:
    return F.regexp_extract_all(tex, F.lit(P.MARKER), F.lit(0))


def unsafe(tex: Column) -> Column:
    """First rule that a piece of body text breaks, or null."""
    return (
        F.when(F.contains(tex, F.lit("^^")) | tex.rlike(P.BODY_FORBIDDEN), "UNSAFE_TEX")
        .when(F.contains(tex, F.lit("\\begin{document}")) | F.contains(tex, F.lit("\\end{document}")), "BODY_REQUIRED")
        .when(tex.rlike(P.MANUAL_NUMBERING), "AUTOMATIC_NUMBERING")
    )


def apply_seam(pairs: DataFrame) -> DataFrame:
    """Apply one patch per page pair: left_tex, right_tex, left_suffix, right_prefix, replacement.

    Adds new_left, new_right and `problem`; texts stay as they were where there is one. Markers must survive in order.
    """
    a, b, new = F.col("left_suffix"), F.col("right_prefix"), F.col("replacement")
    rows = pairs.withColumn("_a", F.when(a == "", "").otherwise(align_seam(F.col("left_tex"), a, True))).withColumn(
        "_b", F.when(b == "", "").otherwise(align_seam(F.col("right_tex"), b, False)))
    nothing = (a == "") & (b == "")
    moved = marker_list(F.concat("_a", "_b")) != marker_list(new)
    problem = (
        F.when(nothing & (new != ""), "INVALID_PATCH").when(nothing, F.lit(None).cast("string"))
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "STALE_PATCH")
        .when(unsafe(new).isNotNull(), unsafe(new)).when(moved, "ANCHOR_CHANGE")
    )
    ok = F.col("problem").isNull()
    left = F.substr("left_tex", F.lit(1), F.length("left_tex") - F.length("_a"))
    return (
        rows.withColumn("problem", problem)
        .withColumn("new_left", F.when(ok & ~nothing, F.concat(left, new)).otherwise(F.col("left_tex")))
        .withColumn("new_right", F.when(ok & ~nothing, F.substr("right_tex", F.length("_b") + 1)).otherwise(F.col("right_tex")))
        .drop("_a", "_b")
    )


def stitch(pages: DataFrame, patched: DataFrame) -> DataFrame:
    """Pages after all seams. A page that is both a right and a left side loses its beginning and changes its end.

    Both changes are cut out of the same original text, so their order does not matter; where they overlap the later
    seam is stale and its page keeps the earlier change only.
    """
    right = patched.filter(F.col("problem").isNull()).select(
        "book_id", F.col("right_page").alias("page"), (F.length("right_tex") - F.length("new_right")).alias("_cut"))
    left = patched.filter(F.col("problem").isNull()).select(
        "book_id", F.col("left_page").alias("page"), F.col("left_tex").alias("_old"), F.col("new_left").alias("_new"), F.col("replacement").alias("_added"))
    joined = pages.join(right, ["book_id", "page"], "left").join(left, ["book_id", "page"], "left")
    cut = F.coalesce("_cut", F.lit(0))
    kept = F.length("_new") - F.length("_added")
    tex = (
        F.when(F.col("_new").isNull(), F.substr("tex", cut + 1))
        .when(cut <= kept, F.substr("_new", cut + 1))
        .otherwise(F.substr("tex", cut + 1))
    )
    return joined.select("book_id", "page", tex.alias("tex"), (F.col("_new").isNotNull() & (cut > kept)).alias("stale"))


def stale_seams(reports_then: DataFrame, reports_now: DataFrame, patched: DataFrame) -> DataFrame:
    """Seams to ask for again: the open report of the left batch changed, or the patch no longer fits.

    Reports have book_id, batch_no and `report`, an array of (name, label, begin_page, begin_line).
    """
    then = reports_then.select("book_id", "batch_no", F.col("report").alias("_then"))
    now = reports_now.select("book_id", "batch_no", F.col("report").alias("_now"))
    joined = patched.join(then, ["book_id", "batch_no"], "left").join(now, ["book_id", "batch_no"], "left")
    changed = ~F.col("_then").eqNullSafe(F.col("_now"))
    return joined.filter(changed | (F.coalesce("problem", F.lit("")) == "STALE_PATCH")).select(
        "book_id", "batch_no", changed.alias("report_changed"), "problem")


def markers_conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages whose ordered marker list changed."""
    was = before.select("book_id", "page", marker_list(F.col("tex")).alias("_was"))
    now = after.select("book_id", "page", marker_list(F.col("tex")).alias("_now"))
    return was.join(now, ["book_id", "page"], "full").filter(~F.col("_was").eqNullSafe(F.col("_now"))).select("book_id", "page")
