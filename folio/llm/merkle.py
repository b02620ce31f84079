"""A Merkle manifest of a table whose parents keep the hash states before each of their children.

A leaf is the SHA-256 of a row's fields. The leaves of a group, in the order of their ids, are folded eight at a time, and
so are the groups' roots. A digest in hex is exactly one block of SHA-256, so the state before any child is eight words.
A parent retains a copy of the state before each child's slot. To fold a changed row upwards, the state before its slot is
resumed with the new digest and the siblings on its right; what is on its left is in the state already.

One task builds four levels over 4,096 neighbours, so levels need log4096(n) shuffles, each 4,096 times smaller than
the one before. Folding meets each 4,096 rows with their own parents and the one path above them.

Groups and ids are ordered by value (strings by their UTF-8 bytes), nulls first; rows with equal ids by their digest. A
null group is a group, a null id is a field like others. Texts may be empty or of any length and are hashed whole. Equal
rows are leaves of their own. An empty table has no leaves, no root and gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stage

# Children of a node as a power of two, and levels that one task builds.
ARITY_BITS, LEVELS = 3, 4
ARITY = 1 << ARITY_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _root(x: int, power: int) -> int:
    """The whole part of a root."""
    low, high = 0, 1 << (x.bit_length() // power + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** power <= x else (low, mid - 1)
    return low


# SHA-256's constants: 32 bits behind the point of square and cube roots of primes.
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = [np.uint32(_root(p << 96, 3) & 0xFFFFFFFF) for p in _primes(64)]
HEX = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)


def _turn(x: np.ndarray, *by: int) -> np.ndarray:
    """The exclusive or of x turned right by several distances."""
    out = np.zeros_like(x)
    for k in by:
        out ^= x >> np.uint32(k)
        out ^= x << np.uint32(32 - k)
    return out


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """One block of SHA-256 for many messages at once: (8, n) states and (16, n) words → (8, n) states."""
    w = np.empty((64, block.shape[1]), np.uint32)
    w[:16] = block
    for t in range(16, 64):
        near, far = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + (_turn(near, 7, 18) ^ (near >> np.uint32(3))) + w[t - 7] + (_turn(far, 17, 19) ^ (far >> np.uint32(10)))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        first = h + _turn(e, 6, 11, 25) + ((e & f) ^ (~e & g)) + ROUND[t] + w[t]
        second = _turn(a, 2, 13, 22) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return state + np.stack((a, b, c, d, e, f, g, h))


def _block(digests: np.ndarray) -> np.ndarray:
    """(n, 32) digests → (16, n) words of their hex text."""
    return HEX[digests].reshape(-1, 16, 4).copy().view(">u4")[..., 0].T.astype(np.uint32)


def _finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """(n, 32) digests of messages of so many whole blocks."""
    end = np.zeros((16, state.shape[1]), np.uint32)
    end[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    end[14], end[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return _bytes(compress(state, end))


def _bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def _words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").reshape(-1, 8).T.astype(np.uint32)


def _states(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


class Parents(NamedTuple):
    """Nodes of one level: digests (n, 32), states before each slot (n, 8, 32), children (n, 8, 32) and their number."""

    digest: np.ndarray
    slots: np.ndarray
    children: np.ndarray
    count: np.ndarray


def parents_of(digests: np.ndarray) -> Parents:
    """The parents of a run of nodes that begins a run of eight."""
    n = -(-len(digests) // ARITY)
    children = np.zeros((n * ARITY, 32), np.uint8)
    children[:len(digests)] = digests
    children = children.reshape(n, ARITY, 32)
    count = np.full(n, ARITY)
    count[-1] = len(digests) - (n - 1) * ARITY
    slots = np.zeros((n, ARITY, 32), np.uint8)
    state = _states(n)
    for k in range(ARITY):
        there = count > k
        if not there.any():
            break
        slots[there, k] = _bytes(state[:, there])
        state[:, there] = compress(state[:, there], _block(children[there, k]))
    return Parents(_finish(state, count), slots, children, count)


def resumed(parents: Parents, at: np.ndarray, slot: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The digest of the parent `at` with another child in a slot: its state there, the replacement, the right siblings."""
    state = compress(_words(parents.slots[at, slot]), _block(digests))
    for k in range(1, ARITY):
        right = (slot < k) & (k < parents.count[at])
        if right.any():
            state[:, right] = compress(state[:, right], _block(parents.children[at[right], k]))
    return _finish(state, parents.count[at])


def _column(values: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(values).reshape(len(values), -1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


NODES = "tree long, level int, pos long, digest binary, slots binary, children binary, height int"


def _grown(base: int):
    """Up to four levels over the nodes of one cell; a cell's first node begins a run on each of them."""

    def grow(cell: pa.Table) -> pa.Table:
        cell = cell.sort_by("pos")
        tree, first, height = cell["tree"][0].as_py(), cell["pos"][0].as_py(), cell["height"][0].as_py()
        digests, out = _digests(cell["digest"]), []
        for level in range(base + 1, min(base + LEVELS, height) + 1):
            made = parents_of(digests)
            digests, first, n = made.digest, first >> ARITY_BITS, len(made.digest)
            children = [made.children[i, :made.count[i]].tobytes() for i in range(n)]
            out.append(pa.table({
                "tree": pa.array([tree] * n, pa.int64()), "level": pa.array([level] * n, pa.int32()), "pos": pa.array(range(first, first + n), pa.int64()),
                "digest": _column(digests), "slots": _column(made.slots), "children": pa.array(children, pa.binary()),
                "height": pa.array([height] * n, pa.int32())}))
        return pa.concat_tables(out)

    return grow


def _cell(pos: str = "pos") -> Column:
    return F.shiftright(F.col(pos), ARITY_BITS * LEVELS)


def height_of(count: Column) -> Column:
    """Levels above so many leaves."""
    powers = F.array(*[F.lit(ARITY ** k).cast("long") for k in range(21)])
    return F.size(F.filter(powers, lambda p: p < count)).cast("int")


def grown(leaves: DataFrame) -> DataFrame:
    """`tree`, `pos` (gapless from 0), `digest`, `height` → all parents of all trees, a written table."""
    highest = leaves.agg(F.max("height")).first()[0] or 0
    nodes, levels = leaves.select("tree", "pos", "digest", "height"), []
    for base in range(0, highest, LEVELS):
        more = nodes.where(F.col("height") > base).withColumn("cell", _cell())
        levels.append(stage(more.groupBy("tree", "cell").applyInArrow(_grown(base), NODES)))
        nodes = levels[-1].where(F.col("level") == base + LEVELS).select("tree", "pos", "digest", "height")
    out = leaves.sparkSession.createDataFrame([], NODES)
    for level in levels:
        out = out.union(level)
    return out


class Manifest(NamedTuple):
    """`leaves`: tree, pos, height, group, id, leaf, other; `parents` of the groups' trees and `top` of the tree over them."""

    leaves: DataFrame
    parents: DataFrame
    top: DataFrame
    top_height: int


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else its number of bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", other: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table. `other` replaces fields by other values; the leaf these give is kept beside the true one."""
    changed = [(other or {}).get(c, F.col(c)) for c in fields]
    rows = stage(docs.select(F.col(group).alias("grp"), F.col(order).alias("id"), leaf([F.col(c) for c in fields]).alias("leaf"), leaf(changed).alias("other")))
    placed, _ = ranked(rows, [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf")], "_rank")
    groups = placed.groupBy("grp").agg(F.count("*").alias("n"), F.min("_rank").alias("start"))
    numbered, count = ranked(groups, [F.col("grp").asc_nulls_first()], "tree")
    trees = stage(numbered.select(F.col("grp").alias("_grp"), "tree", "start", height_of(F.col("n")).alias("height")))
    leaves = stage(placed.join(trees, F.col("grp").eqNullSafe(F.col("_grp"))).select(
        "tree", (F.col("_rank") - F.col("start")).alias("pos"), "height", "grp", "id", "leaf", "other"))
    parents = grown(leaves.withColumnRenamed("leaf", "digest"))
    roots = leaves.where("height = 0").select("tree", F.col("leaf").alias("digest")).union(
        parents.where("level = height").select("tree", "digest"))
    top_height = next(k for k in range(64) if ARITY ** k >= max(count, 1))
    over = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(top_height).alias("height"))
    return Manifest(leaves, parents, grown(stage(over)), top_height)


def _lookup(nodes: pa.Table) -> tuple[Parents, dict[tuple[int, int], int]]:
    """The retained nodes of a cell and their places, by level and position."""
    n = nodes.num_rows
    children, count = np.zeros((n, ARITY * 32), np.uint8), np.zeros(n, np.int64)
    for i, c in enumerate(nodes["children"].to_pylist()):
        children[i, :len(c)] = np.frombuffer(c, np.uint8)
        count[i] = len(c) // 32
    slots = np.frombuffer(b"".join(nodes["slots"].to_pylist()), np.uint8).reshape(n, ARITY, 32)
    places = {key: i for i, key in enumerate(zip(nodes["level"].to_pylist(), nodes["pos"].to_pylist()))}
    return Parents(_digests(nodes["digest"]), slots, children.reshape(n, ARITY, 32), count), places


FOLDED = "grp string, id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _hex(digests: np.ndarray) -> pa.Array:
    return pa.array([bytes(r).hex() for r in digests], pa.string())


def _fold(top_height: int):
    def fold(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        n, height, tree = rows.num_rows, rows["height"][0].as_py(), rows["tree"][0].as_py()
        pos = rows["pos"].to_numpy()
        leaves, digests = _digests(rows["leaf"]), _digests(rows["other"]).copy()
        proof, blocks = _states(n), np.zeros(n, np.int64)
        held, places = _lookup(nodes)
        subroot = leaves
        for level in range(1, height + top_height + 1):
            # Above the rows of a group, the position is that of the group.
            at = pos if level <= height else np.full(n, tree)
            up = level if level <= height else level - height
            slot = (at >> (ARITY_BITS * (up - 1))) & (ARITY - 1)
            known, back = np.unique(at >> (ARITY_BITS * up), return_inverse=True)
            node = np.array([places[level, p] for p in known.tolist()])[back]
            for k in range(ARITY):
                beside = (slot != k) & (k < held.count[node])
                if beside.any():
                    proof[:, beside] = compress(proof[:, beside], _block(held.children[node[beside], k]))
                    blocks[beside] += 1
            digests = resumed(held, node, slot, digests)
            if level == height:
                subroot = held.digest[node]
        root = held.digest[node] if top_height else subroot
        return pa.table([rows["grp"].cast(pa.string()), rows["id"], _hex(leaves), _hex(subroot), _hex(root), _hex(_finish(proof, blocks)), _hex(digests)],
                        ["grp", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    return fold


def folded(kept: Manifest) -> DataFrame:
    """Each row's leaf, its roots, the digest of its siblings up to the root, and the root its other leaf folds to.

    `verified` tells whether that is the root: the row has not changed.
    """
    leaves = kept.leaves.withColumn("cell", _cell())
    low = (F.least(F.lit(LEVELS), "height") - F.col("level")) * ARITY_BITS
    own = kept.parents.where(F.col("level") <= LEVELS).withColumn("cell", F.call_function("shiftright", "pos", low))
    # The path above a cell: one node on each higher level of its tree, and on each level of the tree of trees.
    cells = stage(leaves.groupBy("tree", "cell", "height").agg(F.count("*").alias("_n")))
    above = cells.withColumn("level", F.explode(F.expr(f"sequence({LEVELS + 1}, greatest(height, {LEVELS + 1}))"))).where("level <= height").withColumn(
        "pos", F.call_function("shiftright", "cell", (F.col("level") - LEVELS) * ARITY_BITS)).select("tree", "cell", "level", "pos")
    columns = ["tree", "cell", "level", "pos", "digest", "slots", "children"]
    paths = own.select(columns).union(above.join(kept.parents.drop("height"), ["tree", "level", "pos"]).select(columns))
    if kept.top_height:
        over = cells.withColumn("up", F.explode(F.sequence(F.lit(1), F.lit(kept.top_height)))).select(
            "tree", "cell", "height", "up", F.call_function("shiftright", "tree", F.col("up") * ARITY_BITS).alias("pos"))
        met = over.join(kept.top.select(F.col("level").alias("up"), "pos", "digest", "slots", "children"), ["up", "pos"])
        paths = paths.union(met.withColumn("level", (F.col("height") + F.col("up")).cast("int")).select(columns))
    kind = kept.leaves.schema["id"].dataType.simpleString()
    out = leaves.groupBy("tree", "cell").cogroup(paths.groupBy("tree", "cell")).applyInArrow(_fold(kept.top_height), FOLDED.format(id=kind))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    upper = "".join(chr(c) for c in range(65, 91))
    return F.translate(text, upper, upper.lower())


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of documents, folded with the texts of every third id (by checksum) in lower case.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A null id is left alone.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    made = manifest(docs, other={"text": F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))})
    return folded(made).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
