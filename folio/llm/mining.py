"""Hard negatives by an inverted multi-index: near rows of another label, just below an anchor's positives.

The vector space is cut into two halves, each with a codebook; the pairs of code words are the cells of the index. A row of
a half is nowhere farther from its code word than the word's radius, so the half's product with an anchor is at most that
of the word plus radius times the anchor's length. For an anchor the words of each half are put in the order of these
bounds, and a heap walks the cells by the sum of both (the multi-sequence algorithm). A search ends when its window is
certified: no cell that is left can hold a row that would still get in. So results are exact, whatever the codebooks are.

Rows are dealt to blocks by a hash of the id and the anchors to blocks of their own; every block of rows meets every block
of anchors in a task, indexes its rows and returns a few rows per anchor, and the best of all blocks are merged. That is
done twice, for the positives and for the negatives in the windows below them.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as
filled up with zeros. Scores are whole numbers, so components of an inner product must keep it below 2^63. Rows with the
id of the anchor are not among its positives. Rows that repeat an id count one by one, as anchors once per label, with the
smallest vector. Empty tables and anchors without a positive give no rows. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# Rows that the codebooks are fitted on, and their words per half.
SAMPLE_ROWS, WORDS = 4096, 16
# Rows and anchors of a block, about.
ROW_BLOCK, ANCHOR_BLOCK = 32768, 4096
# Cells are scored together until they have so many rows.
STEP = 512


class Codebooks(NamedTuple):
    first: np.ndarray
    second: np.ndarray


def _means(points: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Centres of points by Lloyd's rounds, from points that are far from each other."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    chosen = [0]
    away = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < words and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centres = points[chosen]
    for _ in range(rounds):
        own = _nearest(points, centres)
        for k in np.unique(own).tolist():
            centres[k] = points[own == k].mean(axis=0)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width."""
    out = np.zeros((len(column), width), np.int64)
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values) == out.size and (sizes == width).all():
        return values.reshape(out.shape)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def fit(vectors: DataFrame, words: int = WORDS, sample_rows: int = SAMPLE_ROWS) -> tuple[Codebooks, int]:
    """Codebooks of a bounded sample, chosen by a hash of the id, and the largest number of components of any row."""
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    rows = vectors.orderBy(F.xxhash64("id"), "id", "label").limit(sample_rows).select("v").toArrow()
    points = _matrix(rows["v"], width).astype(float)
    half = width // 2
    return Codebooks(_means(points[:, :half], words), _means(points[:, half:], words)), width


class Index:
    """A block of rows, sorted by cell."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, books: Codebooks):
        self.books, half = books, books.first.shape[1]
        halves = (v[:, :half].astype(float), v[:, half:].astype(float))
        words = [_nearest(x, b) for x, b in zip(halves, books)]
        cell = words[0] * len(books.second) + words[1]
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.edges = np.searchsorted(cell[order], np.arange(len(books.first) * len(books.second) + 1))
        self.radii = []
        for x, b, w in zip(halves, books, words):
            radius = np.full(len(b), -np.inf)
            np.maximum.at(radius, w, np.sqrt(((x - b[w]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        most = max(int(v.max(initial=0)), -int(v.min(initial=0)))
        # Floating sums of whole numbers below 2^53 are exact, and faster.
        self.exact = np.float64 if v.shape[1] * most * most < 1 << 53 else np.int64
        self.most = most
        self.v = v[order].astype(self.exact)

    def walk(self, q: np.ndarray):
        """Ranges of rows and a bound of what comes after them, in the order of the cells' bounds.

        The bounds allow for rounding: they are never below a row's score.
        """
        half = self.books.first.shape[1]
        bounds, orders = [], []
        for part, book, radius in zip((q[:half].astype(float), q[half:].astype(float)), self.books, self.radii):
            bound = book @ part + radius * np.sqrt((part ** 2).sum()) if len(part) else np.where(radius < 0, -np.inf, 0.0)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > -np.inf]
            bounds.append((bound[order] + 1e-9 * np.abs(bound[order]) + 1).tolist())
            orders.append(order.tolist())
        one, two = bounds
        heap = [(-(one[0] + two[0]), 0, 0)] if one and two else []
        step: list[tuple[int, int]] = []
        rows = 0
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = orders[0][i] * len(self.books.second) + orders[1][j]
            if self.edges[cell] < self.edges[cell + 1]:
                step.append((int(self.edges[cell]), int(self.edges[cell + 1])))
                rows += step[-1][1] - step[-1][0]
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
            if rows >= STEP or not heap:
                yield step, -heap[0][0] if heap else -np.inf
                step, rows = [], 0

    def scored(self, q: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows in the ranges and their scores."""
        at = np.concatenate([np.arange(a, b) for a, b in ranges])
        kind = self.exact if len(q) * self.most * int(np.abs(q).max(initial=0)) < 1 << 53 else np.int64
        return at, np.concatenate([self.v[a:b].astype(kind, copy=False) @ q.astype(kind) for a, b in ranges]).astype(np.int64)

    def positives(self, anchor: int, label: int, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best other rows of the label: ids and scores."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for ranges, after in self.walk(q):
            if ranges:
                at, s = self.scored(q, ranges)
                fit_ = (self.labels[at] == label) & (self.ids[at] != anchor)
                ids, scores = _best(np.concatenate((ids, self.ids[at[fit_]])), np.concatenate((scores, s[fit_])), n)
            if len(ids) == n and scores[-1] > after:
                break
        return ids, scores

    def windows(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score) the best rows of other labels inside."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        todo = [k for k, (low, high) in enumerate(windows) if low <= high]
        for ranges, after in self.walk(q):
            if ranges and todo:
                at, s = self.scored(q, ranges)
                other = (self.labels[at] != label) & (s >= min(windows[k][0] for k in todo)) & (s <= max(windows[k][1] for k in todo))
                at, s = at[other], s[other]
                for k in todo if len(at) else ():
                    inside = (s >= windows[k][0]) & (s <= windows[k][1])
                    if inside.any():
                        found[k] = _best(np.concatenate((found[k][0], self.ids[at[inside]])), np.concatenate((found[k][1], s[inside])), n)
            # Certified: nothing left is as high as the lowest score kept, or as the window.
            todo = [k for k in todo if after >= windows[k][0] and (len(found[k][0]) < n or after >= found[k][1][-1])]
            if not todo:
                break
        return found


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:n]
    return ids[order], scores[order]


def _index(rows: pa.Table, books: Codebooks, width: int) -> Index:
    return Index(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["v"], width), books)


def _met(rows: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors."""
    sizes = [max(1, -(-t.count() // block)) for t, block in ((rows, ROW_BLOCK), (anchors, ANCHOR_BLOCK))]

    def dealt(table: DataFrame, own: str, other: str, k: int) -> DataFrame:
        return table.withColumn(own, F.pmod(F.xxhash64("id", F.lit(7)), F.lit(sizes[k]))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sizes[1 - k] - 1).cast("long"))))

    left = dealt(rows, "_rows", "_anchors", 0).groupBy("_rows", "_anchors")
    right = dealt(anchors, "_anchors", "_rows", 1).groupBy("_rows", "_anchors")
    return left.cogroup(right).applyInArrow(search, schema)


def _top(found: DataFrame, keys: list[str], id_column: str, score: str, n: int) -> DataFrame:
    """The best rows of each key with their rank; Spark keeps no more than these on the map side of the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id_column)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def usable(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0) -> DataFrame:
    """`id`, `label`, `v`: rows with an id, a label and finite components, as whole numbers."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = table.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return kept.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
                   words: int = WORDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    `vectors` has `id`, `label` and `v` (whole numbers). A negative's score is from `share[0]` percent of the positive's to
    `share[1]` percent. Ties go to smaller ids.
    """
    rows = stage(vectors)
    books, width = fit(rows, words, sample_rows)
    anchors = stage(rows.where(is_anchor).groupBy("id", "label").agg(F.min("v").alias("v")))

    def nearest(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if block.num_rows and asked.num_rows:
            index = _index(block, books, width)
            for a, label, q in zip(asked["id"].to_pylist(), asked["label"].to_pylist(), _matrix(asked["v"], width)):
                ids, scores = index.positives(a, label, q, positives)
                out += [(a, label, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return _table(out, ["anchor_id", "label", "positive_id", "positive_score"])

    found = _met(rows, anchors, nearest, "anchor_id long, label long, positive_id long, positive_score long")
    best = stage(_top(found, ["anchor_id", "label"], "positive_id", "positive_score", positives).drop("rank"))
    low, high = share
    # At most `positives` windows an anchor.
    asked = best.groupBy("anchor_id", "label").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("w"))
    queries = anchors.join(asked.select(F.col("anchor_id").alias("_id"), F.col("label").alias("_label"), "w"),
                           (F.col("id") == F.col("_id")) & (F.col("label") == F.col("_label"))).select("id", "label", "v", "w")

    def mined(block: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int, int]] = []
        if block.num_rows and asked.num_rows:
            index = _index(block, books, width)
            for a, label, wanted, q in zip(asked["id"].to_pylist(), asked["label"].to_pylist(), asked["w"].to_pylist(), _matrix(asked["v"], width)):
                windows = [(-(-low * w["positive_score"] // 100), high * w["positive_score"] // 100) for w in wanted]
                for w, (ids, scores) in zip(wanted, index.windows(label, q, windows, negatives)):
                    out += [(a, label, w["positive_id"], w["positive_score"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return _table(out, ["anchor_id", "label", "positive_id", "positive_score", "negative_id", "negative_score"])

    inside = _met(rows, stage(queries), mined, "anchor_id long, label long, positive_id long, positive_score long, negative_id long, negative_score long")
    return _top(inside, ["anchor_id", "label", "positive_id", "positive_score"], "negative_id", "negative_score", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})
