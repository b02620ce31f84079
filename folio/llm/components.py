"""Connected components by alternating stars, as joins and minima over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage


def _lowest(rows: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself; written, so that Spark can split a hub in the join after it."""
    return stage(rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """`u`, `v` → `node`, `root` for every node of an edge; the root is the smallest node reachable.

    Each round joins the larger neighbours of every node to the smallest one, then the smaller neighbours. The number of
    edges never grows, rounds are about the logarithm of the largest diameter, and the end is a star per component. A
    hub meets no task whole: minima combine before the shuffle, and its rows only meet one row in the joins.
    """
    now, before, count = stage(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi != lo").distinct()), None, -1
    while True:
        rows = now.count()
        # Distinct rows, as many as before and none that is new: the same rows.
        if not rows or (rows == count and not now.join(before, ["hi", "lo"], "left_anti").limit(1).count()):
            break
        if before is not None:
            drop_stage(before)
        before, count = now, rows
        lows = _lowest(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))))
        large = stage(now.join(lows, F.col("lo") == F.col("u")).select("hi", F.col("m").alias("lo")).distinct())
        first, lows = lows, _lowest(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        met = large.join(lows, F.col("hi") == F.col("u"))
        now = stage(met.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo")
                    .union(met.select("hi", F.col("m").alias("lo"))).distinct())
        drop_stage(first, lows, large)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
