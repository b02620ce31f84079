"""Document fingerprints by one-permutation MinHash.

All shingles of a text are hashed once. The hash range is cut into bins, and each bin keeps its smallest hash. A bin
without a hash borrows from another bin, found by that bin's own fixed random order (optimal densification), so texts
with equal shingles borrow alike. Of each bin only low-order bits are stored, packed. Two unequal bins agree by chance
once in 2^bits cases; the likeness of two fingerprints is corrected for that.

Shingles are runs of words of the ASCII-lower-cased text; a shorter text is one shingle. Null texts count as empty; a
text without words has an empty fingerprint, like 1 to another such and like 0 to any other text. Rows with equal ids
follow each other in the order of their texts' hashes, a null id comes first. The only row of a table is its own
neighbour. Other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SHINGLE, BINS, BITS, SEED = 5, 512, 4, 7
# Smallest hashes are kept as numbers below 2^LOW.
LOW = 48


@lru_cache
def _orders(bins: int) -> np.ndarray:
    """For each bin, the fixed random order in which it asks the other bins."""
    random = np.random.Generator(np.random.PCG64(SEED))
    return np.argsort(random.random((bins, bins)), axis=1).astype(np.int32)


def minima(text: str, shingle: int = SHINGLE, bins: int = BINS) -> np.ndarray | None:
    """The densified bins of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return None
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    values = np.sort(np.array(hashes, dtype=np.uint64))
    # The high bits choose the bin, so the first of each bin in sorted order is its smallest.
    at = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate(([True], at[1:] != at[:-1]))
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[at[first]], filled[at[first]] = values[first] & np.uint64((1 << LOW) - 1), True
    empty, asked, have = np.flatnonzero(~filled), 0, filled.copy()
    while len(empty):
        source = _orders(bins)[empty, asked]
        met = have[source]
        out[empty[met]] = out[source[met]]
        empty, asked = empty[~met], asked + 1
    return out


def packed(values: np.ndarray | None, bits: int = BITS) -> np.ndarray:
    """The low bits of a mixed hash of each bin, several to a byte."""
    if values is None:
        return np.zeros(0, np.uint8)
    # The bin takes part, so that bins that borrowed one hash don't all agree by the same chance.
    mixed = (values + np.arange(len(values), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
    flags = (mixed[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little")


def likeness_of(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> float:
    """The share of equal bins, less what chance gives."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    differ = np.unpackbits(a ^ b, bitorder="little").reshape(-1, bits).any(axis=1)
    chance = 1 / (1 << bits)
    return max(0.0, (1.0 - float(differ.mean()) - chance) / (1 - chance))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text column, in hexadecimal."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: packed(minima(t)).tobytes().hex())

    return of(text_of(text))


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of common shingles of two fingerprints."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness_of(np.frombuffer(bytes.fromhex(p), np.uint8), np.frombuffer(bytes.fromhex(q), np.uint8)) for p, q in zip(x, y)],
                         dtype="float64")

    return of(a, b)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the following text's first ones, or all of them."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document by id.

    Ids are cut into ranges. A range is read in order by one task, and the first document of each range goes to the
    range before it as well, the very first one to the last; so every task sees what follows its last document, and
    texts are shuffled once. The driver sees the ranges' first ids.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), text_of("text").alias("text"))
    ranges = 4 * parts
    found = rows.agg(F.min("place"), F.percentile_approx("place", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()
    firsts = np.array(sorted({v for v in [found[0], *(found[1] or [])] if v is not None}), np.int64)

    @F.pandas_udf("array<int>")
    def ranges_of(places: pd.Series) -> pd.Series:
        at = np.searchsorted(firsts, places.to_numpy(), "right") - 1
        # Even numbers: the range itself; odd ones: the range before, which this document follows.
        return pd.Series([[2 * b] + ([2 * ((b - 1) % len(firsts)) + 1] if firsts[b] == p else []) for b, p in zip(at, places)], dtype=object)

    dealt = (rows.select("doc_id", "place", "text", F.explode(ranges_of("place")).alias("code"))
             .select("doc_id", F.shiftright("code", 1).alias("range"), (F.col("code") % 2).alias("after"), "place", "text")
             .repartition(parts, "range").sortWithinPartitions("range", "after", "place", F.xxhash64("text")))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for doc_id, where, after, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if after and (held is None or held[1] != where):
                    # More rows with the id that follows; the first of them is the next document.
                    continue
                now = packed(minima(text))
                if held is not None and held[1] == where:
                    own, print_ = held[2], held[3]
                    edited = edited_text(own, text)
                    changed = packed(minima(edited))
                    out.append((held[0], len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_.tobytes().hex(),
                                changed.tobytes().hex(), likeness_of(print_, changed), likeness_of(print_, now)))
                held = None if after else (doc_id, where, text, now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], EDITED_NAMES)

    return dealt.mapInArrow(follow, EDITED)


EDITED_NAMES = [c.split(" ")[0] for c in EDITED.split(", ")]
