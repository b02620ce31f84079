"""Digests of sets that no one can forge: Merkle roots whose tree follows the members' own hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of a member's hash that name its node, from the lowest level to the root; 256 children at most above the first.
LEVELS = (6, 4, 2, 0)


def merkle_roots(members: DataFrame, keys: list[str], member: Column, out: str, count: str) -> DataFrame:
    """`keys` with the Merkle root of their members in `out` and the number of members in `count`.

    A leaf is the SHA-256 of a member. A node is the SHA-256 of its level and its children in ascending order; nodes are
    named by the first digits of the leaves, so equal sets have equal trees, whatever their order, without ranks. A task
    holds the leaves of one node of 16 million, then at most 256 children; each level is one grouping of narrow rows.
    """
    rows = members.select(*keys, F.sha2(member, 256).alias("_node"), F.sha2(member, 256).alias("_digest"), F.lit(1).cast("bigint").alias("_n"))
    for digits in LEVELS:
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_node", "_digest"))), lambda c: c["_digest"]), "")
        rows = rows.withColumn("_up", F.substr("_node", F.lit(1), F.lit(digits))).groupBy(*keys, "_up").agg(
            F.sha2(F.concat(F.lit(f"{digits}:"), children), 256).alias("_digest"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_node")
    return rows.select(*keys, F.col("_digest").alias(out), F.col("_n").alias(count))
