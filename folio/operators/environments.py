"""Pairing of openings and closings inside a book.

Two rules are kept apart: `pair_independent` pairs every name by itself; `pair_strict` lets a closing end only the
innermost open environment.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.scan import Running, page_block, position, running, stack_height
from ..session import cut_lineage
from .markup import TEX, MarkupDialect, env_token_array, env_tokens


def _env_id(prefix: str, page: Column, ordinal: Column) -> Column:
    return F.concat(F.lit(prefix), page.cast("string"), F.lit("-"), ordinal.cast("string"))


def _number_unmatched(ends: DataFrame) -> DataFrame:
    """Unmatched closings are numbered per page, a bounded group."""
    from pyspark.sql import Window

    order = Window.partitionBy("book_id", "page").orderBy("start")
    return ends.select(
        "book_id", _env_id("end-", F.col("page"), F.row_number().over(order)).alias("id"),
        "name", "page", "line", F.col("start").alias("offset"),
    )


def _independent_depth(tokens: DataFrame) -> DataFrame:
    """Depth of each token in the stack of its own name; 0 marks a closing without an opening."""
    steps = tokens.filter(F.col("op") != "label").withColumn("pos", position(F.col("page"), F.col("start")))
    opens = F.col("op") == "begin"
    high = stack_height(steps, ["book_id", "name"], ["pos"], page_block(F.col("pos")), F.when(opens, 1).otherwise(-1), "_height")
    return high.withColumn("depth", F.when(opens, F.col("_height") + 1).otherwise(F.col("_height"))).drop("_height")


def pair_independent(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, unmatched): last in, first out per name, whatever other names do in between.

    An opening and its closing share the running count of openings at their depth, so one grouping brings them together.
    """
    deep = _independent_depth(tokens)
    opens = F.col("op") == "begin"
    ranked = running(
        deep.filter(F.col("depth") > 0), ["book_id", "name", "depth"], ["pos"], page_block(F.col("pos")),
        [Running("nth", "sum", F.when(opens, 1).otherwise(0).cast("bigint"))],
    )
    place = F.struct("page", "line", "start", "ordinal")
    pairs = ranked.groupBy("book_id", "name", "depth", "nth").agg(
        F.max(F.when(opens, place)).alias("b"), F.max(F.when(~opens, place)).alias("e"))
    nodes = pairs.select(
        "book_id", "name", _env_id("env-", F.col("b.page"), F.col("b.ordinal")).alias("id"),
        F.col("b.page").alias("begin_page"), F.col("b.line").alias("begin_line"), F.col("b.start").alias("begin_offset"),
        F.col("e.page").alias("end_page"), F.col("e.line").alias("end_line"), F.col("e.start").alias("end_offset"),
    )
    return nodes, _number_unmatched(deep.filter(F.col("depth") <= 0))


# --- strict pairing ---------------------------------------------------------

_COLUMNS = (
    ("grp", "bigint"), ("role", "string"), ("name", "string"), ("label", "string"), ("begin_page", "bigint"),
    ("begin_line", "int"), ("begin_offset", "int"), ("ordinal", "int"), ("end_page", "bigint"), ("end_line", "int"),
    ("end_offset", "int"), ("pos", "bigint"),
)
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _claim(role: Column, name: Column) -> Column:
    """The kind a label names before its colon, or the kind of label an opening takes."""
    plain = F.rtrim(name, F.lit("*"))
    kind = F.when(plain.isin(*P.EQUATION_FAMILY), "equation").otherwise(plain)
    return F.when(role == "label", F.substring_index(name, ":", 1)).otherwise(kind)


class _Fold:
    """One stack over tokens in order. What depends on an unknown earlier stack stays as residue.

    While something is open here, a closing or label concerns only what is open here, so it is decided at once. On
    an empty stack it would concern an earlier opening, so it is kept, in order, for the next wider fold.
    """

    def __init__(self) -> None:
        self.stack: list[list] = []
        self.out: list[tuple] = []

    def begin(self, row: list) -> None:
        self.stack.append(row)

    def end(self, row: list, last: bool) -> None:
        name, page, line, offset, pos = row
        if self.stack:
            top = self.stack[-1]
            if top[0] == name:
                self.stack.pop()
                self.out.append(("node", top[0], top[1], *top[2:6], page, line, offset, top[6]))
                return
        role = "unmatched" if self.stack or last else "end"
        self.out.append((role, name, "", None, None, None, None, page, line, offset, pos))

    def label(self, key: str, claim: str, pos: int, last: bool) -> None:
        """The innermost opening keeps the first label that claims its kind."""
        if self.stack:
            top = self.stack[-1]
            top[1] = top[1] or (key if claim == top[7] else "")
        elif not last:
            self.out.append(("label", key, "", None, None, None, None, None, None, None, pos))

    def close(self, last: bool) -> list[tuple]:
        role = "unclosed" if last else "begin"
        for top in self.stack:
            self.out.append((role, top[0], top[1], *top[2:6], None, None, None, top[6]))
        rows, self.stack, self.out = self.out, [], []
        return rows


def _batch(rows: list[tuple], book_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * (len(_COLUMNS) + 1)
    types = [book_type, *[_ARROW[t] for _, t in _COLUMNS]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["book_id", *[n for n, _ in _COLUMNS]])


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First fold: one page row at a time, where its tokens already are."""
    for batch in batches:
        rows: list[tuple] = []
        books, pages, blocks, lists = (batch.column(c) for c in ("book_id", "page", "block", "tokens"))
        tokens = list(zip(*[lists.values.field(f).to_pylist() for f in ("op", "name", "start", "line", "claim")]))
        ends = lists.offsets.to_pylist()
        for n, (book, page, block) in enumerate(zip(books.to_pylist(), pages.to_pylist(), blocks.to_pylist())):
            fold, ordinal = _Fold(), 0
            for op, name, start, line, claim in tokens[ends[n]:ends[n + 1]]:
                pos = (page << 32) + start
                if op == "begin":
                    ordinal += 1
                    fold.begin([name, "", page, line, start, ordinal, pos, claim])
                elif op == "end":
                    fold.end([name, page, line, start, pos], last=False)
                else:
                    fold.label(name, claim, pos, last=False)
            rows.extend((book, block, *r) for r in fold.close(last=False))
        yield _batch(rows, batch.schema.field("book_id").type)


_RESIDUE = ("begin", "end", "label")
# Nodes that one wider fold joins, as a power of two.
FAN_BITS = 4


def _fold_sorted(last: bool):
    """Wider fold over residue that arrives sorted by (book, group, position); only the open stack is kept in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, current, kind = _Fold(), None, None
        for batch in batches:
            kind = batch.schema.field("book_id").type
            rows: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                book, group, role, name, label, *place, claim = r
                if (book, group) != current:
                    if current is not None:
                        rows.extend((*current, *x) for x in fold.close(last))
                    current = (book, group)
                if role == "begin":
                    fold.begin([name, label, *place[:4], place[7], claim])
                elif role == "end":
                    fold.end([name, *place[4:8]], last)
                else:
                    fold.label(name, claim, place[7], last)
            rows.extend((*current, *x) for x in fold.out)
            fold.out = []
            yield _batch(rows, kind)
        if current is not None:
            yield _batch([(*current, *x) for x in fold.close(last)], kind)

    return run


def _widen(residue: DataFrame, schema: str, group: Column, last: bool) -> DataFrame:
    # An explicit number of partitions: the work is in the fold, not in the bytes by which they would be merged.
    tasks = int(residue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["book_id", "grp"]
    claimed = residue.withColumn("claim", _claim(F.col("role"), F.col("name")))
    marked = claimed.withColumn("grp", group.cast("bigint")).repartition(tasks, *keys).sortWithinPartitions(*keys, "pos")
    return marked.mapInArrow(_fold_sorted(last), schema)


def pair_strict(pages: DataFrame, dialect: MarkupDialect = TEX) -> tuple[DataFrame, DataFrame]:
    """(nodes, unmatched): a closing ends only the top of one shared stack; a bad closing pops nothing.

    Folding runs per page, then per block of pages, then per 16 neighbours of the level below, until one node of the tree
    holds a book. Each step writes what it settled and passes on only what it could not decide, so a task reads the
    undecided rows of 16 nodes, however long the book is.
    """
    book = pages.schema["book_id"].dataType.simpleString()
    schema = f"book_id {book}, " + ", ".join(f"{n} {t}" for n, t in _COLUMNS)
    block = page_block(position(F.col("page"), F.lit(0)))
    found = F.transform(env_token_array(F.col("tex"), dialect), lambda t: t.withField("claim", _claim(t["op"], t["name"])))
    tokens = pages.select("book_id", F.col("page").cast("bigint").alias("page"), block.alias("block"), found.alias("tokens"))
    undecided = F.col("role").isin(*_RESIDUE)
    level = cut_lineage(tokens.mapInArrow(_fold_pages, schema))
    settled = level.filter(~undecided)
    # The number of the last block of any book: the depth of the tree.
    highest, wide = level.agg(F.max("grp")).first()[0] or 0, 0
    while True:
        last = highest == 0
        wider = _widen(level.filter(undecided), schema, F.shiftright("grp", wide), last)
        if last:
            settled = settled.unionByName(wider)
            break
        level = cut_lineage(wider)
        settled = settled.unionByName(level.filter(~undecided))
        # The first wider fold joined the pages of a block, the next ones join neighbours.
        highest, wide = highest >> FAN_BITS, FAN_BITS
    nodes = settled.filter(F.col("role").isin("node", "unclosed")).select(
        "book_id", "name", _env_id("env-", F.col("begin_page"), F.col("ordinal")).alias("id"), "label",
        "begin_page", "begin_line", "begin_offset", "end_page", "end_line", "end_offset",
    )
    ends = settled.filter(F.col("role") == "unmatched").select(
        "book_id", "name", F.col("end_page").alias("page"), F.col("end_line").alias("line"),
        F.col("end_offset").alias("start"),
    )
    return nodes, _number_unmatched(ends)


def open_report(nodes: DataFrame) -> DataFrame:
    """Environments still open at the end of their book."""
    return nodes.filter(F.col("end_page").isNull()).select("book_id", "name", "label", "begin_page", "begin_line")


# --- obligations ------------------------------------------------------------


def obligations(nodes: DataFrame, batches: DataFrame) -> DataFrame:
    """Openings pending at a batch boundary, with the first such boundary.

    `batches` has one row per page: book_id, page, last_page of its batch and is_last for the final batch. The first
    boundary at or after an opening is the last page of its own batch, so a page lookup replaces a range join.
    """
    pages = batches.select("book_id", F.col("page").alias("begin_page"), "last_page", "is_last")
    joined = nodes.join(pages, ["book_id", "begin_page"], "left")
    crosses = ~F.col("is_last") & (F.col("end_page").isNull() | (F.col("end_page") > F.col("last_page")))
    boundary = F.when(crosses, F.col("last_page")).when(F.col("end_page").isNull(), F.col("begin_page"))
    return (
        joined.withColumn("boundary_page", boundary)
        .filter(F.col("boundary_page").isNotNull())
        .withColumn("status", F.when(F.col("end_page").isNull(), "pending").otherwise("resolved"))
        .drop("last_page", "is_last")
    )


def todos(nodes: DataFrame, unmatched: DataFrame, batches: DataFrame) -> DataFrame:
    """Pending work: unclosed openings and closings without an opening."""
    unclosed = obligations(nodes, batches).filter(F.col("status") == "pending").select(
        "book_id", "id", "name", F.lit("unclosed").alias("kind"), "begin_page", "begin_line",
        F.col("begin_offset").alias("offset"), "boundary_page",
    )
    ends = unmatched.select(
        "book_id", "id", "name", F.lit("unmatched_end").alias("kind"), F.col("page").alias("begin_page"),
        F.col("line").alias("begin_line"), "offset", F.col("page").alias("boundary_page"),
    )
    return unclosed.unionByName(ends)


def todo_status(pending: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Todos with their recorded resolution."""
    found = resolutions.select("book_id", "id", "closing_page", F.lit(True).alias("_done"))
    return (
        pending.join(found, ["book_id", "id"], "left")
        .withColumn("status", F.when(F.col("_done"), "resolved").otherwise("pending"))
        .drop("_done")
    )


def env_verdict(statuses: DataFrame) -> DataFrame:
    pending = F.count_if(F.col("status") == "pending")
    return statuses.groupBy("book_id").agg(
        pending.alias("pending"), F.when(pending > 0, "PENDING").otherwise("PASSED").alias("status")
    )


def nearest_closed(unmatched: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each unmatched closing, the closest earlier closed pair of the same name, by (page, line) of its end."""
    # Line order decides, and equal lines do not count as earlier, so openings sort after closings of a line.
    place = F.shiftleft(F.col("page").cast("bigint"), 32) + F.col("line") * 2
    ends = nodes.filter(F.col("end_page").isNotNull()).select(
        "book_id", "name", F.col("end_page").alias("page"), F.col("end_line").alias("line"),
        F.lit(None).cast("string").alias("id"), F.lit(1).alias("_closed"),
        F.struct(F.col("begin_page"), F.col("begin_line"), F.col("end_page"), F.col("end_line"), F.col("begin_offset")).alias("_pair"),
    )
    # Several pairs may end on one line: the first in document order is kept, as a strict maximum would.
    firsts = ends.groupBy("book_id", "name", "page", "line", "id", "_closed").agg(
        F.min_by("_pair", F.struct(F.col("_pair.begin_page"), F.col("_pair.begin_offset"))).alias("_pair")
    )
    asks = unmatched.select(
        "book_id", "name", "page", "line", "id", F.lit(0).alias("_closed"),
        F.lit(None).cast(ends.schema["_pair"].dataType).alias("_pair"),
    )
    both = firsts.unionByName(asks).withColumn("_place", place + F.col("_closed"))
    seen = running(both, ["book_id", "name"], ["_place"], page_block(F.col("_place")),
                   [Running("nearest", "last", F.col("_pair"))])
    return seen.filter(F.col("_closed") == 0).select(
        "book_id", "id", "name", "page", "line",
        F.col("nearest.begin_page").alias("near_begin_page"), F.col("nearest.begin_line").alias("near_begin_line"),
        F.col("nearest.end_page").alias("near_end_page"), F.col("nearest.end_line").alias("near_end_line"),
    )


def nearest_opening(pending: DataFrame, nodes: DataFrame) -> DataFrame:
    """The opening of the same name and page that is closest by line; ties go to the earlier one."""
    wanted = pending.select("book_id", "id", "name", "begin_page", F.coalesce("begin_line", F.lit(1)).alias("_line"))
    found = nodes.select("book_id", "name", "begin_page", F.col("begin_line").alias("_at"), F.col("begin_offset").alias("_off"))
    return (
        wanted.join(found, ["book_id", "name", "begin_page"])
        .groupBy("book_id", "id", "name", "begin_page")
        .agg(F.min(F.struct(F.abs(F.col("_at") - F.col("_line")).alias("gap"), F.col("_off"), F.col("_at"))).alias("m"))
        .select("book_id", "id", "name", "begin_page", F.col("m._at").alias("begin_line"), F.col("m._off").alias("begin_offset"))
    )


def neighbourhood(pending: DataFrame, batches: DataFrame) -> DataFrame:
    """Pages to look at first: the boundary page, the next one, and for a stray closing the one before.

    `batches` must hold each page with the pages before and after it in document order (prev_page, next_page).
    """
    pages = batches.select("book_id", F.col("page").alias("boundary_page"), "prev_page", "next_page")
    before = F.when(F.col("kind") == "unmatched_end", F.col("prev_page"))
    return pending.join(pages, ["book_id", "boundary_page"]).select(
        "book_id", "id", "kind",
        F.filter(F.array(before, F.col("boundary_page"), F.col("next_page")), lambda p: p.isNotNull()).alias("pages"),
    )


def pair_of(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pair of one tracked token: by its opening for an unclosed one, by its closing otherwise."""
    by_begin = nodes.select("book_id", "name", F.lit("unclosed").alias("kind"), F.col("begin_page").alias("page"),
                            F.col("begin_offset").alias("offset"), F.col("id").alias("env_id"), "begin_page", "begin_line", "end_page", "end_line")
    by_end = nodes.filter(F.col("end_page").isNotNull()).select(
        "book_id", "name", F.lit("unmatched_end").alias("kind"), F.col("end_page").alias("page"),
        F.col("end_offset").alias("offset"), F.col("id").alias("env_id"), "begin_page", "begin_line", "end_page", "end_line")
    wanted = tokens.select("book_id", "name", "kind", "page", "offset", F.col("id").alias("token_id"))
    return wanted.join(by_begin.unionByName(by_end), ["book_id", "name", "kind", "page", "offset"], "left")
