"""Benchmark decontamination with spaced seeds.

A seed is a window of tokens of which a fixed mask ignores some; windows with equal tokens at the other positions have
the same hash. So a hit survives substituted tokens, and several masks ignore different ones. Seeds of the benchmark
are joined with seeds of the documents; each hit names a document, an item and the shift between them, and there the
two token sequences are compared position by position. A document is contaminated by an item if in some run of
`window` item tokens (or in the whole of a shorter item) at least `overlap` of the tokens are equal.

Which masks an item is searched with depends on its number of tokens: to the given ones come others, until every
tolerated choice of different tokens leaves one mask that fits between them. A run in which nothing may differ is one
key. So no contamination is lost, also of items of a few tokens.

Tokens are runs of letters and digits, in lower case. Null texts count as empty. Equal rows of an item or of a document count once. Documents without an id are reported under a
null id, and so are items without one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unused

# 1: the token counts; 0: it may differ.
MASKS = ("11101011", "1101100111", "10110101101")
# Tokens that a mask found by enumeration compares at most; patterns up to which masks are enumerated.
WEIGHT, PATTERNS = 6, 5000
# Benchmark seeds in one broadcast; more are joined block by block. A row has 28 bytes.
BLOCK = 200_000


def tokens(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def _hit(mask: str, length: int) -> set[tuple[int, ...]]:
    """For each place of the mask in a run of so many tokens, the positions it compares."""
    return {tuple(at + i for i, m in enumerate(mask) if m == "1") for at in range(length - len(mask) + 1)}


@lru_cache(None)
def covering(masks: tuple[str, ...], length: int, overlap: float) -> tuple[str, ...]:
    """Masks of which one has a hit in a run of `length` tokens, whichever of them differ as far as `overlap` tolerates."""
    equal = max(1, ceil(length * overlap))
    differ = length - equal
    if not differ:
        return ("1" * length,)
    if comb(length, differ) > PATTERNS:
        # Some stretch between the differing tokens is that long.
        return ("1" * ceil(equal / (differ + 1)),)
    chosen = [m for m in masks if len(m) <= length]
    left = {frozenset(p) for p in combinations(range(length), differ)}
    left = {p for p in left if all(p.intersection(at) for m in chosen for at in _hit(m, length))}
    weight = min(WEIGHT, equal)
    places = {}
    for at in combinations(range(length), weight) if left else ():
        if not at[0]:
            mask = "".join("1" if i in at else "0" for i in range(at[-1] + 1))
            places[mask] = [set(x) for x in _hit(mask, length)]
    while left:
        best = max(places, key=lambda m: (sum(any(not p & at for at in places[m]) for p in left), -len(m), m))
        chosen.append(best)
        left = {p for p in left if all(p & at for at in places[best])}
    return tuple(chosen)


def seeds(rows: DataFrame, hashes: str, masks: tuple[str, ...], lengths: dict[str, list[int]] | None = None, window: int = 0) -> DataFrame:
    """One row per window and mask: the columns of `rows` but the hashes, `at` (from 0) and `seed`.

    With `lengths`, a mask is for rows of these numbers of tokens only; `window` stands for itself and above.
    """
    own = [c for c in rows.columns if c != hashes]
    # The outer form, as the plain one makes Spark compute the tokens once more in a filter on their number.
    placed = rows.select(*own, hashes, F.posexplode_outer(hashes).alias("at", "_token"))

    def of(n: int, mask: str) -> Column:
        offsets = [i for i, m in enumerate(mask) if m == "1"]
        picked = [F.get(F.col(hashes), F.col("at") + i) for i in offsets[1:]]
        inside = F.col("at") + len(mask) <= F.size(hashes)
        if lengths is not None:
            inside = inside & F.least(F.size(hashes), F.lit(window)).isin(lengths[mask])
        return F.when(inside, F.xxhash64(F.lit(n), F.col("_token"), *picked))

    hashed = placed.select(*own, "at", F.explode_outer(F.array(*[of(n, m) for n, m in enumerate(masks)])).alias("seed"))
    return hashed.where("seed IS NOT NULL")


def contaminations(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = 13, overlap: float = 0.8,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`doc_id`, `item_id`, `matched`, `compared`, `item_tokens`: the best run of each contaminated document and item."""
    items = stage(benchmark.select("item_id", token_hashes(F.col("text")).alias("_item")).distinct())
    # An item's row may occur with several texts under one id: texts are told apart by their tokens.
    keyed = items.select("item_id", F.xxhash64("_item").alias("_text"), "_item")
    lengths: dict[str, list[int]] = {}
    for r in items.select(F.least(F.size("_item"), F.lit(window)).alias("n")).where("n > 0").distinct().orderBy("n").collect():
        for mask in covering(tuple(masks), r.n, overlap):
            lengths.setdefault(mask, []).append(r.n)
    masks = tuple(lengths) or tuple(masks)
    probes = stage(seeds(keyed, "_item", masks, {m: lengths.get(m, []) for m in masks}, window).select(
        "item_id", "_text", F.col("at").alias("_at"), F.col("seed").alias("_seed")))
    rows = docs.select(F.col(id_column).alias("doc_id"), token_hashes(F.col(text_column)).alias("_doc"))
    hashed = seeds(rows, "_doc", masks)
    blocks = max(1, ceil(probes.count() / BLOCK))
    hits = None
    for b in range(blocks):
        # At most about BLOCK rows at a time, whatever the size of the benchmark.
        block = F.broadcast(probes.where(F.pmod(F.col("_seed"), F.lit(blocks)) == b))
        part = hashed.join(block, F.col("seed") == F.col("_seed")).select("doc_id", "item_id", "_text", (F.col("at") - F.col("_at")).alias("_shift"))
        hits = part if hits is None else hits.union(part)
    found = stage(hits.groupBy("doc_id", "item_id", "_text", "_shift").count())
    there = found.select(F.col("doc_id").alias("_id"), F.col("item_id"), "_text", "_shift")
    sides = (docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("_body"))
             .join(there, F.col("doc_id").eqNullSafe(F.col("_id")))
             .join(keyed.select(F.col("item_id").alias("_item_id"), F.col("_text").alias("_key"), "_item"),
                   (F.col("_text") == F.col("_key")) & F.col("item_id").eqNullSafe(F.col("_item_id"))))
    # Position by position along the shift.
    # The document's tokens are bound once, as the only element of an array.
    equal = F.transform(F.array(token_hashes(F.col("_body"))), lambda body: F.transform("_item", lambda h, i: (
        (i + F.col("_shift") >= 0) & h.eqNullSafe(F.get(body, i + F.col("_shift")))).cast("int")))[0]
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_equal") - F.col("compared") + 1), lambda i: F.aggregate(
        F.slice("_equal", i, F.col("compared")), F.lit(0), lambda a, e: a + e)))
    checked = (sides.select("doc_id", "item_id", F.size("_item").alias("item_tokens"), equal.alias("_equal"),
                            F.least(F.size("_item"), F.lit(window)).alias("compared"))
               .select("doc_id", "item_id", "item_tokens", "compared", best.alias("matched"), F.aggregate(
                   "_equal", F.lit(0), lambda a, e: a + e).alias("equal_tokens")))
    # The best run of the best shift: longest agreement first, the same on every run.
    top = F.max(F.struct("matched", "equal_tokens", "compared", "item_tokens")).alias("_best")
    return (checked.where(F.col("matched") >= F.ceil(F.col("compared") * F.lit(overlap))).groupBy("doc_id", "item_id").agg(top)
            .select("doc_id", "item_id", "_best.matched", "_best.compared", "_best.equal_tokens", "_best.item_tokens"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no benchmark item contaminates. Documents without an id go together: all, or none."""
    bad = unused(docs, "_bad")
    ids = contaminations(docs, benchmark, **options).select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(ids, F.col(options.get("id_column", "doc_id")).eqNullSafe(F.col(bad)), "left_anti")
