"""SimHash near-duplicates by self-joins of binary tries.

Fingerprints of 64 bits link when they differ in few bits. All distinct fingerprints form a binary trie. The self-join
walks pairs of its nodes downwards, adds up the bits in which their paths differ, and drops a pair as soon as it has
spent more than the budget.

To share the work out, the bits are put in several orders, and the fingerprints below one prefix of an order are one
task's trie. The search is exact: the bits are cut into bands, a linked pair agrees in all but `budget` bands, and each
choice of bands that may agree comes first once.

A prefix with very many fingerprints is cut into chunks, and chunk meets chunk. Only trees of links leave a task, never
all pairs of a group, and copies count once.

Null texts count as empty. A text without words has fingerprint 0, which links like any other. Rows with a null id have
links too; a component without any id has a null `component_id`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of
from .components import components

# Words of an ASCII-lower-cased text are joined by a space and hashed with this seed (fixed by the contract).
SEED = 42
# Fingerprints in one chunk of a prefix group, and node pairs a task holds at once.
CHUNK, FRONTIER = 8192, 1 << 20


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64)


def _majority(values: np.ndarray) -> int:
    """Bit i is set if more than half of the values have it; as a signed number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(values), 1 << 16):
        part = values[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprint_bytes(text: bytes, shingle: int) -> int:
    """The fingerprint of a text; 0 without words."""
    return _majority(_shingle_hashes(text, shingle))


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_bytes(t.encode("utf-8", "surrogatepass"), shingle) for t in texts], dtype="int64")

    return of(text_of(text))


def trie_pairs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of keys that differ in `budget` bits at most; each [start, end) is one trie of sorted keys."""
    # Numbers of set bits before each key, for every bit: a node's children are cut off by counting.
    todo = [(bits - 1, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    ones = {}
    while todo:
        bit, alo, ahi, blo, bhi, spent = todo.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            todo += [(bit, alo[:half], ahi[:half], blo[:half], bhi[:half], spent[:half]),
                     (bit, alo[half:], ahi[half:], blo[half:], bhi[half:], spent[half:])]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            a, b = alo[single], blo[single]
            a, b = a[a != b], b[a != b]
            near = np.bitwise_count(keys[a] ^ keys[b]) <= budget
            yield a[near], b[near]
            rest = ~single
            alo, ahi, blo, bhi, spent = alo[rest], ahi[rest], blo[rest], bhi[rest], spent[rest]
        if not len(alo):
            continue
        if bit < 0:
            # Equal keys of different nodes: every element of one range with every element of the other.
            width = bhi - blo
            count = (ahi - alo) * width
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            a, b = np.repeat(alo, count) + at // np.repeat(width, count), np.repeat(blo, count) + at % np.repeat(width, count)
            yield a[a < b], b[a < b]
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        before = ones[bit]
        amid, bmid = ahi - (before[ahi] - before[alo]), bhi - (before[bhi] - before[blo])
        other = alo != blo
        pairs = [(alo, amid, blo, bmid, spent), (amid, ahi, bmid, bhi, spent), (alo, amid, bmid, bhi, spent + 1),
                 (amid[other], ahi[other], blo[other], bmid[other], spent[other] + 1)]
        new = [np.concatenate(x) for x in zip(*pairs)]
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)
        todo.append((bit - 1, *(x[keep].astype(x.dtype) for x in new)))


def _join_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index reachable from each of n points."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


class Orders(NamedTuple):
    """Orders of the 64 bits, highest first, and how many of them make up the prefix."""

    bits: list[list[int]]
    prefix: list[int]


def exact_orders(budget: int) -> Orders:
    """Every choice of all but `budget` of `budget` + 2 bands, followed by the other bands."""
    count = budget + 2
    edges = [64 * i // count for i in range(count + 1)]
    bands = [list(range(high - 1, low - 1, -1)) for low, high in zip(edges, edges[1:])]
    bits, prefix = [], []
    for chosen in combinations(range(count), count - budget):
        bits.append([b for i in [*chosen, *(i for i in range(count) if i not in chosen)] for b in bands[i]])
        prefix.append(sum(len(bands[i]) for i in chosen))
    return Orders(bits, prefix)


def _turned(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros_like(values)
    for b in bits:
        out = (out << np.uint64(1)) | ((values >> np.uint64(b)) & np.uint64(1))
    return out


def links(distinct: DataFrame, orders: Orders, budget: int) -> DataFrame:
    """`node`, its own fingerprint → `u`, `v`: links of nodes whose components are those of all pairs within the budget."""
    below = 64 - min(orders.prefix)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for n, (bits, head) in enumerate(zip(orders.bits, orders.prefix)):
                prefix = _turned(values, bits[:head]).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(values), n, np.int32)), pa.array(prefix), *batch.columns], ["choice", "prefix", "node"])

    keyed = stage(distinct.select("node").mapInArrow(spread, "choice int, prefix long, node long"))
    large = keyed.groupBy("choice", "prefix").count().where(F.col("count") > CHUNK).select(
        F.col("choice").alias("_c"), F.col("prefix").alias("_p"), F.ceil(F.col("count") / CHUNK).alias("_k"))
    # A chunk meets every chunk of its group, itself included; a group of one chunk is one cell.
    chunk = F.pmod(F.xxhash64("node"), F.col("_k"))
    cells = F.when(F.col("_k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), lambda j: F.least(j, chunk) * F.col("_k") + F.greatest(j, chunk)))
    tasks = keyed.join(large, (F.col("choice") == F.col("_c")) & (F.col("prefix") == F.col("_p")), "left").select(
        "choice", "prefix", F.explode(cells).alias("cell"), "node")
    dealt = tasks.repartition("choice", "prefix", "cell").sortWithinPartitions("choice", "prefix", "cell")

    def joined(held: list[np.ndarray]) -> pa.RecordBatch:
        choice, prefix, cell, node = held
        edge = np.flatnonzero((choice[1:] != choice[:-1]) | (prefix[1:] != prefix[:-1]) | (cell[1:] != cell[:-1])) + 1
        sizes = np.diff(np.concatenate(([0], edge, [len(node)])))
        # Fingerprints that share a prefix with no other are done.
        many = np.repeat(sizes > 1, sizes)
        choice, node, sizes = choice[many], node[many].view(np.uint64), sizes[sizes > 1]
        turned = np.zeros_like(node)
        for n in np.unique(choice).tolist():
            here = choice == n
            turned[here] = _turned(node[here], orders.bits[n][orders.prefix[n]:])
        order = np.lexsort((turned, np.repeat(np.arange(len(sizes)), sizes)))
        node, turned = node[order], turned[order]
        ends = np.cumsum(sizes)
        starts = ends - sizes

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a, b in trie_pairs(turned, starts, ends, below, budget):
                near = np.bitwise_count(node[a] ^ node[b]) <= budget
                yield a[near], b[near]

        root = _join_roots(len(node), pairs())
        own = np.flatnonzero(root != np.arange(len(node)))
        return pa.record_batch([pa.array(node[own].view(np.int64)), pa.array(node[root[own]].view(np.int64))], ["u", "v"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            # The last trie may go on in the next batch.
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            first = int(np.argmax(same))
            if first:
                yield joined([x[:first] for x in held])
                held = [x[first:] for x in held]
        if held is not None:
            yield joined(held)

    return dealt.mapInArrow(walk, "u long, v long")


def _classes(rows: DataFrame, distinct: DataFrame, found: DataFrame) -> DataFrame:
    """`doc_id`, `fp`, `component_id` of each row from its node."""
    named = distinct.join(components(found), "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = stage(named.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = stage(named.join(smallest, "root").select(F.col("node").alias("_node"), "component_id"))
    return rows.join(classes, F.col("node") == F.col("_node")).select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, budget: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id`, `fp`, `component_id` for each row: the fingerprint and the smallest id of its component."""
    rows = stage(docs.select(F.col(id_column).alias("doc_id"), fingerprints(F.col(text_column), shingle).alias("fp")).withColumn("node", F.col("fp")))
    distinct = stage(rows.groupBy("node").agg(F.min("doc_id").alias("first_id")))
    return _classes(rows, distinct, links(distinct, exact_orders(budget), budget))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

