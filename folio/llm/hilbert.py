"""Sharding along a Hilbert curve: quantise metadata, sort by the curve, cut runs of equal row counts.

Neighbours on the curve are near in every dimension, so each file covers a small box and readers can skip files by the
minimum and maximum of any of the dimensions.

Null values lie in cell 0 of their dimension. Rows that are equal in all sort columns may swap places. An empty table
gives an empty result. Columns of the input named `curve`, `shard` or `slot` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, stage, unused


def curve_index(cells: list[Column], bits: int) -> Column:
    """The place of a cell (one number of `bits` bits per dimension) on the Hilbert curve.

    The rotations of the curve from the coarsest bit to the finest, then the Gray code, then the bits interleaved, all as
    array expressions; the number of dimensions is free.
    """
    n = len(cells)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def turn(x: Column, step: Column) -> Column:
        low, i = step["q"] - 1, step["i"]
        first = F.get(x, F.lit(0))
        own = F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = own.bitwiseAND(step["q"]) != 0
        return F.transform(x, lambda v, j: F.when(inverted, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
                           .otherwise(F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    plan = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps]) if steps else \
        F.array().cast("array<struct<q:int,i:int>>")
    axes = F.aggregate(plan, F.array(*[c.cast("int") for c in cells]), turn)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), axes, lambda x, i: F.transform(
        x, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(x, i - 1))).otherwise(v))) if n > 1 else axes
    masks = [1 << b for b in range(bits - 1, 0, -1)]

    def finish(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        flip = F.lit(0)
        for m in masks:
            flip = flip.bitwiseXOR(F.when(last.bitwiseAND(F.lit(m)) != 0, F.lit(m - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v: v.bitwiseXOR(flip))

    final = F.transform(F.array(gray), finish)[0]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b")) for b in range(bits - 1, -1, -1) for i in range(n)])
    # Bound once: the axes are computed before the bits are read from them.
    return F.transform(F.array(final), lambda x: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: (
        acc * 2 + F.call_function("shiftright", F.get(x, p["i"]), p["b"]).bitwiseAND(F.lit(1)).cast("long"))))[0]


def quantised(df: DataFrame, column: str, bits: int, out: str) -> DataFrame:
    """`out`: the column's value as a number of `bits` bits, in order, with about equally many rows per number.

    Numbers are cut at approximate quantiles. Other values are counted, and a value's cell is the share of rows before it
    in code-point order; that table has one row per distinct value, so use it for dictionary-like columns.
    """
    cells = 1 << bits
    if isinstance(df.schema[column].dataType, T.NumericType):
        cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / cells for i in range(1, cells)], 10000)).first()[0] or []
        value = F.col(column).cast("double")
        return df.withColumn(out, F.coalesce(sum(((value >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0)), F.lit(0)))
    value, at = unused(df, "_value"), unused(df, "_count")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(value)).agg(F.count("*").alias(at))
    numbered = counts.withColumn(out, (
        (F.sum(at).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)) * cells)
        / F.sum(at).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).cast("int")).select(
        value, F.coalesce(F.col(out), F.lit(0)).alias(out))
    return df.join(numbered, F.col(column).cast("string") == F.col(value), "left").drop(value).withColumn(out, F.coalesce(out, F.lit(0)))


def _indexed(docs: DataFrame, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """The rows with `curve`; input columns of the names of results are left out."""
    kept = [c for c in docs.columns if c.lower() not in ("curve", "shard", "slot")]
    cells = docs.select(*kept)
    names = []
    for d in dimensions:
        names.append(unused(cells, f"_cell_{d}"))
        cells = quantised(cells, d, bits, names[-1])
    return cells.withColumn("curve", curve_index([F.col(c) for c in names], bits)).drop(*names)


def shard(docs: DataFrame, shards: int, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5,
          ties: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows with `curve`, `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    Shards are consecutive runs of the curve; their row counts differ by one at most. `ties` order the rows of a cell.
    """
    indexed = _indexed(docs, dimensions, bits)
    rank = unused(indexed, "_rank")
    placed, total = ranked(indexed, [F.col("curve"), *[F.col(t) for t in ties]], rank)
    base, wide = divmod(total, shards)
    edge = wide * (base + 1)
    at = F.col(rank)
    early = at < edge
    return (placed
            .withColumn("shard", F.when(early, F.expr(f"`{rank}` div {base + 1}")).otherwise(
                F.lit(wide) + F.expr(f"(`{rank}` - {edge}) div {max(base, 1)}")).cast("int"))
            .withColumn("slot", F.when(early, at % (base + 1)).otherwise((at - edge) % max(base, 1)))
            .drop(rank))


def clustered(docs: DataFrame, shards: int, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows with `curve` and `shard`, dealt out and sorted along the curve, ready to be written as files.

    The borders between shards come from narrow rows (place, id, a hash of the text); whole rows move once. Rows equal in
    all three stay together, so shards differ by one row and by such copies at most.
    """
    indexed = _indexed(docs, dimensions, bits)
    keys = ["curve", unused(indexed, "_id"), unused(indexed, "_hash")]
    full = indexed.withColumn(keys[1], F.col(id_column)).withColumn(keys[2], F.xxhash64(text_column))
    narrow = stage(full.select(*keys))
    rank = unused(narrow, "_rank")
    placed, total = ranked(narrow, [F.col(k) for k in keys], rank)
    base, wide = divmod(total, shards)
    # The last rows of all shards but the last: at most one row per shard goes to the driver.
    ends = [n * base + min(n, wide) - 1 for n in range(1, shards)]
    borders = placed.where(F.col(rank).isin([e for e in ends if e >= 0])).select(rank, *keys).orderBy(rank).collect()
    kind = narrow.schema
    at = F.lit(sum(e < 0 for e in ends))
    for b in borders:
        here = F.lit(False)
        for k in reversed(keys):
            value = F.lit(b[k]).cast(kind[k].dataType)
            # Nulls come first, as in the sort.
            above = F.coalesce(F.col(k) > value, F.col(k).isNotNull() & value.isNull(), F.lit(False)) if b[k] is not None else F.col(k).isNotNull()
            here = above | (F.col(k).eqNullSafe(value) & here)
        at = at + here.cast("int")
    out = full.withColumn("shard", at.cast("int"))
    return out.repartitionByRange("shard", *keys).sortWithinPartitions("shard", *keys).drop(*keys[1:])
