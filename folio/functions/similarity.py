"""Similarity of keys by matching blocks: by deletion neighbourhoods, then over bounded chunks of distinct keys.

The ratio of two keys is 1 - d / (sum of their lengths), where d is at least the number of characters that must be deleted
from both to make them equal. Keys with d up to NEAR share a string that up to NEAR deletions in all leave of both, so an
equi-join of such strings finds them. A key whose best matches are above anything that d > NEAR allows is done; the others
are compared chunk by chunk, as are families that fit into one chunk.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 256
# Deletions in both keys together that the join covers.
NEAR = 2


def _bounds(keys, pool) -> np.ndarray:
    """Upper bound of the ratio for each pair: twice the shared characters, whatever their order, over both lengths."""
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(keys)) | set("".join(pool))))}

    def counts(strings) -> np.ndarray:
        table = np.zeros((len(strings), len(alphabet)), dtype=np.int16)
        for row, text in enumerate(strings):
            for ch in text:
                table[row, alphabet[ch]] += 1
        return table

    a, b = counts(keys), counts(pool)
    shared = np.zeros((len(keys), len(pool)), dtype=np.int32)
    for column in range(len(alphabet)):
        shared += np.minimum(a[:, column, None], b[None, :, column])
    lengths = a.sum(axis=1, dtype=np.int32)[:, None] + b.sum(axis=1, dtype=np.int32)[None, :]
    return 2.0 * shared / np.maximum(lengths, 1)


def _best(wanted: pd.Series, offered: pd.Series, n: int, cutoff: float) -> pd.Series:
    """Best `n` of each chunk pair. Pairs are scored from the best bound down, until no bound can still get in."""
    out = []
    for keys, pool in zip(wanted, offered):
        rows = []
        limits = _bounds(keys, pool)
        for key, row in zip(keys, limits):
            matcher = SequenceMatcher()
            matcher.set_seq2(key)
            top: list[tuple[float, str]] = []
            for at in np.argsort(-row, kind="stable"):
                if row[at] < cutoff or (len(top) == n and row[at] < top[0][0]):
                    break
                matcher.set_seq1(pool[at])
                item = (matcher.ratio(), pool[at])
                if item[0] >= cutoff:
                    if len(top) < n:
                        heappush(top, item)
                    else:
                        heappushpop(top, item)
            rows.extend({"key": key, "near_key": other, "score": score} for score, other in top)
        out.append(rows)
    return pd.Series(out)


def _chunks(frame: DataFrame, name: str) -> DataFrame:
    """Distinct keys of a block in arrays of about CHUNK keys of one length, so that no array grows with the data."""
    sized = frame.withColumn("length", F.length("key"))
    counts = sized.groupBy("book_id", "family", "length").agg(F.count("*").alias("_n"))
    parts = sized.join(counts, ["book_id", "family", "length"]).withColumn(
        "part", F.pmod(F.xxhash64("key"), F.ceil(F.col("_n") / CHUNK).cast("bigint")))
    return parts.groupBy("book_id", "family", "length", "part").agg(F.collect_list("key").alias(name)).withColumnsRenamed(
        {"length": f"{name}_length", "part": f"{name}_part"})


def _length_ratio(a: Column, b: Column) -> Column:
    return 2 * F.least(a, b) / (a + b)


def near_keys_in_chunks(wanted: DataFrame, offered: DataFrame, n: int, cutoff: float) -> DataFrame:
    """Best `n` offered keys per wanted key inside (book, family), exact.

    Chunks of both sides meet, not keys: a task scores one chunk against another and returns at most `n` rows per
    wanted key, which a second aggregation reduces to the best `n`. Chunks whose lengths alone rule out the cutoff
    never meet. Ties go to the larger key.
    """
    @F.pandas_udf("array<struct<key:string,near_key:string,score:double>>")
    def best(a: pd.Series, b: pd.Series) -> pd.Series:
        return _best(a, b, n, cutoff)

    pairs = _chunks(wanted, "wanted").join(_chunks(offered, "offered"), ["book_id", "family"]).filter(
        _length_ratio(F.col("wanted_length"), F.col("offered_length")) >= cutoff)
    # Spread the chunk pairs of a large book over the cluster before the scoring. The number is explicit because the
    # work is in the scoring, not in the bytes by which partitions would be merged.
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartition(tasks, "book_id", "family", "wanted_length", "wanted_part", "offered_length", "offered_part")
    found = spread.select("book_id", "family", F.explode(best("wanted", "offered")).alias("m")).select("book_id", "m.*")
    # Spark keeps at most `n` rows per key on the map side of this rank.
    order = Window.partitionBy("book_id", "key").orderBy(F.desc("score"), F.desc("near_key"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
        "book_id", "key", "rank", "near_key", "score")


def _shorter(key: Column) -> Column:
    """Every string that one deletion leaves, once."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.concat(
        F.substr(key, F.lit(1), i - 1), F.substr(key, i + 1))))


def _hashed(deletions: int):
    return lambda x: F.struct(F.lit(deletions).alias("n"), F.xxhash64(x).alias("h"))


def _neighbourhood(keys: DataFrame, level: str) -> DataFrame:
    """One row per key and string that up to NEAR deletions leave: `_left` as a hash, and the number of deletions."""
    rounds = [F.array("key")]
    for _ in range(NEAR):
        rounds.append(F.when(F.length("key") >= len(rounds), F.array_distinct(F.flatten(F.transform(rounds[-1], _shorter)))).otherwise(F.array().cast("array<string>")))
    each = F.concat(*[F.transform(r, _hashed(deletions)) for deletions, r in enumerate(rounds)])
    return keys.withColumn("_v", F.explode(each)).select("book_id", "family", "key", F.col("_v.n").alias(level), F.col("_v.h").alias("_left"))


def near_keys_by_deletions(wanted: DataFrame, offered: DataFrame, n: int, cutoff: float) -> DataFrame:
    """As `near_keys_in_chunks`, exact too; only keys with fewer than `n` close neighbours meet the chunks of their book."""

    @F.pandas_udf("double")
    def ratio(keys: pd.Series, others: pd.Series) -> pd.Series:
        matcher, out = SequenceMatcher(), []
        for key, other in zip(keys, others):
            if key is not matcher.b:
                matcher.set_seq2(key)
            matcher.set_seq1(other)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    # In a family of one chunk, comparing is cheaper than the join.
    large = offered.groupBy("book_id", "family").agg(F.count("*").alias("_n")).filter(F.col("_n") > CHUNK).select("book_id", "family")
    left, right = (_neighbourhood(side.join(large, ["book_id", "family"], "left_semi"), level) for side, level in ((wanted, "_w"), (offered, "_o")))
    right = right.withColumnRenamed("key", "near_key")
    pairs = left.join(right, ["book_id", "family", "_left"]).filter(F.col("_w") + F.col("_o") <= NEAR).select("book_id", "family", "key", "near_key").distinct()
    scored = pairs.withColumn("score", ratio("key", "near_key")).filter(F.col("score") >= cutoff)
    order = Window.partitionBy("book_id", "key").orderBy(F.desc("score"), F.desc("near_key"))
    best = cut_lineage(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("book_id", "key", "rank", "near_key", "score"))
    # The highest ratio that more deletions leave: the other key is longer by as many.
    most = 1 - F.lit(float(NEAR + 1)) / (2 * F.length("key") + NEAR + 1)
    done = best.filter((F.col("rank") == n) & (F.col("score") > most + 1e-12)).select("book_id", "key")
    rest = cut_lineage(wanted.join(done, ["book_id", "key"], "left_anti"))
    sure = best.join(done, ["book_id", "key"], "left_semi")
    return sure.unionByName(near_keys_in_chunks(rest, offered, n, cutoff))
