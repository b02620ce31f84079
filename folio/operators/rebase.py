"""Positions followed through edits: tokens through replacements, line ranges and line diffs of a changed page.

All rest on one alignment, `functions/alignment.py`, that Arrow batches of pages compute in the tasks; a page is one value,
so its two versions meet in one row. Only rows that an edit touches reach Python.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alignment as A


def _follow(tex: str, offset: int | None, token: str, edits) -> tuple[int | None, str | None]:
    """A token's offset after the edits of its page (None once it is removed), or the problem that ended the walk."""
    for edit in edits:
        old, new = edit["old"], edit["new"]
        if not old or tex.count(old) != 1:
            return None, "STALE_PATCH"
        left = tex.index(old)
        right = left + len(old)
        if offset is not None and offset >= right:
            offset += len(new) - len(old)
        elif offset is not None and offset + len(token) > left:
            low, high = offset - left, offset - left + len(token)
            # Read from both ends: only a place that both ways agree on is sure.
            ahead = A.kept_at(old, new, low, high)
            back = A.kept_at(old[::-1], new[::-1], len(old) - high, len(old) - low)
            if ahead != (None if back is None else len(new) - back - len(token)):
                return None, "SEAM_TARGET_AMBIGUOUS"
            offset = None if ahead is None else left + ahead
        tex = tex[:left] + new + tex[right:]
    return offset, None


def rebase_nodes(nodes: DataFrame, pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Tracked tokens after the edits of their page: `new_offset` (null when removed) and `problem`.

    `nodes` has book_id, id, page, offset and token; `edits` has book_id, page, seq, old and new. A token before an edit
    stays, one behind it moves by the difference in length. One that an edit covers is where the alignment of old and new
    keeps it; if alignments from the left and from the right disagree, it is SEAM_TARGET_AMBIGUOUS.
    """
    per_page = edits.groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("_edits"))
    touched = nodes.join(per_page, ["book_id", "page"]).join(pages.select("book_id", "page", "tex"), ["book_id", "page"])

    @F.pandas_udf("at bigint, problem string")
    def moved(tex: pd.Series, offset: pd.Series, token: pd.Series, changes: pd.Series) -> pd.DataFrame:
        rows = [_follow(t, None if pd.isna(o) else int(o), k, e) for t, o, k, e in zip(tex, offset, token, changes)]
        return pd.DataFrame({"at": pd.array([r[0] for r in rows], "Int64"), "problem": pd.Series([r[1] for r in rows], dtype=object)})

    changed = touched.withColumn("_s", moved("tex", F.col("offset").cast("bigint"), "token", "_edits")).select(
        "book_id", "id", F.col("_s.at").alias("new_offset"), F.col("_s.problem").alias("problem"))
    still = nodes.join(per_page.select("book_id", "page"), ["book_id", "page"], "left_anti").select(
        "book_id", "id", F.col("offset").cast("bigint").alias("new_offset"), F.lit(None).cast("string").alias("problem"))
    return changed.unionByName(still)


def line_diff(versions: DataFrame, old: str = "original", new: str = "current") -> DataFrame:
    """One row per operation between the lines of two texts: `tag` and the ranges `old_start`–`old_end`, `new_start`–`new_end`.

    Ranges count lines from 0 and are half open. Lines keep their ends. The other columns of `versions` are kept.
    """
    kind = "array<struct<tag:string,old_start:int,old_end:int,new_start:int,new_end:int>>"

    @F.pandas_udf(kind)
    def compared(was: pd.Series, now: pd.Series) -> pd.Series:
        names = ("tag", "old_start", "old_end", "new_start", "new_end")
        return pd.Series([[dict(zip(names, o)) for o in A.operations(a.splitlines(keepends=True), b.splitlines(keepends=True))] for a, b in zip(was, now)])

    kept = [c for c in versions.columns if c not in (old, new)]
    text = [F.coalesce(F.col(c), F.lit("")) for c in (old, new)]
    return versions.withColumn("_o", F.explode(compared(*text))).select(*kept, "_o.*")


def rebase_ranges(ranges: DataFrame) -> DataFrame:
    """Line ranges mapped from `original` to `current`; a range deleted meanwhile is REFERENCE_REPAIR_CONFLICT.

    Both borders are carried over the line diff: one inside a changed piece goes to the piece's outer end. An end of 0
    means the last line. A page without lines gives the whole page.
    """
    @F.pandas_udf("low bigint, high bigint")
    def mapped(was: pd.Series, now: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, first, last in zip(was, now, start, end):
            before, after = a.splitlines(keepends=True), b.splitlines(keepends=True)
            if not before:
                out.append((0, max(1, len(after))))
                continue
            steps = A.operations(before, after)
            out.append((A.carried(steps, len(after), int(first) - 1, False), A.carried(steps, len(after), int(last) or len(before), True)))
        return pd.DataFrame(out, columns=["low", "high"], dtype="int64")

    text = [F.coalesce(F.col(c), F.lit("")) for c in ("original", "current")]
    done = ranges.withColumn("_r", mapped(*text, "start_line", "end_line"))
    there = F.col("_r.high") > F.col("_r.low")
    return done.select(
        *ranges.columns, F.when(there, F.col("_r.low") + 1).alias("new_start"), F.when(there, F.col("_r.high")).alias("new_end"),
        F.when(~there, F.lit("REFERENCE_REPAIR_CONFLICT")).alias("problem"))
