"""Running values over ordered groups of any size.

A plain window keeps a whole group in one task, and adaptive execution does not split it. Here a group is cut into
blocks of its order column. Each block is scanned by itself, one summary row per block is carried along the
group, and the carry is joined back. The largest window is one block of rows, or one group of block summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# A document position is page * 2^32 + offset, so one BIGINT sorts like (page, offset).
PAGE_SHIFT = 32
# 256 pages per block.
BLOCK_SHIFT = 40


def position(page: Column, offset: Column) -> Column:
    return F.shiftleft(page.cast("bigint"), PAGE_SHIFT) + offset.cast("bigint")


def page_block(pos: Column) -> Column:
    return F.shiftright(pos, BLOCK_SHIFT)


@dataclass(frozen=True)
class Running:
    """One running value: `kind` is sum, min, max or last (last non-null)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _aggregate(spec: Running, order: list[Column]) -> Column:
    if spec.kind == "last":
        return F.max_by(spec.value, F.when(spec.value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](spec.value)


def _over(spec: Running, value: Column, window) -> Column:
    if spec.kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "min": F.min, "max": F.max}[spec.kind](value).over(window)


def _combine(spec: Running, carry: Column, local: Column) -> Column:
    if spec.kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if spec.kind == "last":
        return F.coalesce(local, carry)
    pick = F.least if spec.kind == "min" else F.greatest
    return pick(carry, local)


def _one_exchange(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*[F.col(k) for k in keys], F.col("_block"))


def _block_totals(marked: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """One row per block. Reading every column here keeps the shuffle below identical to that of the row scan, so
    Spark evaluates and shuffles the input once and reuses it."""
    payload = F.max(F.xxhash64(*[F.col(c) for c in marked.columns if not c.startswith("_l_")])).alias("_whole")
    return marked.groupBy(*keys, "_block").agg(*aggregates, payload).filter(F.col("_whole").isNotNull()).drop("_whole")


def _join_carry(scanned: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    match = F.col("_block").eqNullSafe(F.col("_k_block"))
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col("_k_" + k))
    return scanned.join(carry, match, "left")


def _carry_keys(keys: list[str]) -> list[Column]:
    return [*[F.col(k).alias("_k_" + k) for k in keys], F.col("_block").alias("_k_block")]


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, specs: list[Running]) -> DataFrame:
    """Add one column per spec: its running value inside `keys`, in the order of `order`.

    `block` must be non-decreasing in `order`. Rows with equal order values must not matter to each other.
    """
    order_cols = [F.col(c) for c in order]
    marked = _one_exchange(df.withColumn("_block", block), keys)
    local = Window.partitionBy(*keys, "_block").orderBy(*order_cols)
    carried = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    totals = _block_totals(marked, keys, [_aggregate(s, order_cols).alias("_t_" + s.name) for s in specs])
    carry = totals.select(
        *_carry_keys(keys), *[_over(s, F.col("_t_" + s.name), carried).alias("_c_" + s.name) for s in specs])
    scanned = marked
    for s in specs:
        frame = local.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        scanned = scanned.withColumn("_l_" + s.name, _over(s, s.value, frame))
    joined = _join_carry(scanned, carry, keys)
    for s in specs:
        joined = joined.withColumn(s.name, _combine(s, F.col("_c_" + s.name), F.col("_l_" + s.name)))
    return joined.select(*df.columns, *[s.name for s in specs])


def stack_height(df: DataFrame, keys: list[str], order: list[str], block: Column, step: Column, name: str) -> DataFrame:
    """Height of a stack before each row, where `step` is 1 for a push and -1 for a pop that an empty stack ignores.

    The height is the running sum above the lowest sum so far, and both carry over from block to block together.
    """
    order_cols = [F.col(c) for c in order]
    marked = _one_exchange(df.withColumn("_block", block).withColumn("_step", step.cast("bigint")), keys)
    local = Window.partitionBy(*keys, "_block").orderBy(*order_cols)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    carried = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    scanned = marked.withColumn("_l_sum", F.sum("_step").over(upto))
    totals = _block_totals(scanned, keys, [F.sum("_step").alias("_t_sum"), F.min("_l_sum").alias("_t_low")])
    carry = totals.withColumn("_c_sum", F.coalesce(F.sum("_t_sum").over(carried), F.lit(0))).select(
        *_carry_keys(keys), "_c_sum",
        F.min(F.col("_c_sum") + F.col("_t_low")).over(carried).alias("_c_low"),
    )
    joined = _join_carry(scanned.withColumn("_l_low", F.min("_l_sum").over(before)), carry, keys)
    low = F.least(F.lit(0), F.col("_c_low"), F.col("_c_sum") + F.col("_l_low"))
    return joined.withColumn(name, F.col("_c_sum") + F.col("_l_sum") - F.col("_step") - low).select(*df.columns, name)


def ordinal(df: DataFrame, keys: list[str], order: list[str], block: Column, name: str) -> DataFrame:
    """1-based row number inside `keys`, without one window per group."""
    return running(df, keys, order, block, [Running(name, "sum", F.lit(1).cast("bigint"))])


def free_name(df: DataFrame, stem: str) -> str:
    """`stem`, with underscores before it until no column of the table has that name."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def ranked(df: DataFrame, order: list[Column], rank: str) -> tuple[DataFrame, int]:
    """All rows with their place from 0 in a global order, and the number of rows.

    A range shuffle sorts, the sorted table is written once, and each partition adds the number of rows before it. No
    task holds more than its range; the driver sees one count per partition. Rows equal in every key may swap places.
    """
    part, at = free_name(df, "_part"), free_name(df, "_at")
    cut = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn(part, F.spark_partition_id())
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r[0]: r[1] for r in cut.groupBy(part).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offsets = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    return cut.withColumn(rank, F.element_at(offsets, F.col(part) + 1) + F.col(at)).drop(part, at), total
