"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed hash. A source that is to give a fraction of its words gives the documents whose hash is
below a threshold; the thresholds of growing budgets are nested, so a larger budget only adds documents. Finding one
needs no sort: sum words by source and hash bucket, find the bucket in which the budget ends, and refine only that
bucket, until it holds a single hash.

Null texts and texts without a word have size 0 and are taken with whatever part of the hash range they fall in. A null
source is a source of its own, after all others. Rows with equal ids share a hash and go together. An empty table gives
an empty result. Columns of the input with the names of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, stage, uniform_hash, unused, word_count

HASH_BITS, LEVEL_BITS = 60, 12


def target_words(totals: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """`source`, `source_size` → the same with `target`.

    Weights repeat over the sources in code-point order. Together the sources are to give as many words as there are;
    no source gives more than `cap` times its own, and what is over goes to the others by weight. The driver sees
    three sums per round.
    """
    numbered, _ = ranked(totals, [F.col("source").asc_nulls_last()], "_rank")
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    numbered = stage(numbered.select("source", "source_size", F.element_at(
        kinds, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_weight")))
    ceiling = F.col("source_size") * F.lit(float(cap))
    level = 0.0
    closed = F.lit(False)
    known = -1
    while True:
        row = numbered.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(closed, ceiling)).alias("fixed"),
            F.sum(F.when(~closed, F.col("_weight"))).alias("open"),
            F.count(F.when(closed, True)).alias("n")).first()
        if row["n"] == known or not row["open"]:
            break
        known = row["n"]
        level = ((row["all"] or 0) - (row["fixed"] or 0.0)) / row["open"]
        closed = F.col("_weight") * F.lit(level) > ceiling
    return numbered.select("source", "source_size", F.least(ceiling, F.col("_weight") * F.lit(level)).alias("target"))


def thresholds(sizes: DataFrame, need: DataFrame) -> DataFrame:
    """`source`, `_hash`, `size` and `source`, `_need` → `source`, `_below`: documents with a smaller hash are taken.

    The words below the threshold are as near to the need as whole documents allow; of two equally near budgets the
    smaller one holds.
    """
    bounds = stage(need.select("source", "_need", F.lit(0).cast("long").alias("_lo"), F.lit(0).cast("long").alias("_got"),
                               F.lit(0).cast("long").alias("_sum"), F.lit(False).alias("_one")))
    left = HASH_BITS
    while left > 0:
        left -= LEVEL_BITS
        width = 1 << left
        inside = sizes.alias("s").join(bounds.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))
                                       & F.col("s._hash").between(F.col("b._lo"), F.col("b._lo") + (width << LEVEL_BITS) - 1))
        buckets = inside.groupBy(F.col("b.source").alias("source"), "_need", "_lo", "_got",
                                 F.shiftright(F.col("_hash") - F.col("_lo"), left).alias("_bucket")).agg(
            F.sum("size").alias("_sum"), (F.min("_hash") == F.max("_hash")).alias("_one"), F.min("_hash").alias("_first"))
        # At most 4,096 buckets a source, whatever the number of documents.
        order = Window.partitionBy("source").orderBy("_bucket")
        run = buckets.withColumn("_run", F.col("_got") + F.sum("_sum").over(order))
        pick = F.struct("_bucket", "_run", "_sum", "_one", "_first")
        bounds = stage(run.groupBy("source", "_need", "_lo").agg(
            F.coalesce(F.min(F.when(F.col("_run") >= F.col("_need"), pick)), F.max(pick)).alias("_at")).select(
            "source", "_need",
            F.when(F.col("_at._one"), F.col("_at._first")).otherwise(F.col("_lo") + F.col("_at._bucket") * width).alias("_lo"),
            (F.col("_at._run") - F.col("_at._sum")).alias("_got"), F.col("_at._sum").alias("_sum"), F.col("_at._one").alias("_one")))
        if not bounds.where(~F.col("_one")).limit(1).count():
            break
    more = F.abs(F.col("_got") + F.col("_sum") - F.col("_need")) < F.abs(F.col("_got") - F.col("_need"))
    return bounds.select("source", (F.col("_lo") + more.cast("long")).alias("_below"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The documents with `size`, `source_size`, `target`, `copies` and `taken` words (`copies` times `size`)."""
    size: Column = word_count(F.col(text_column))
    sizes = stage(docs.select(F.col(source_column).alias("source"), uniform_hash(F.col(id_column), seed).alias("_hash"), size.alias("size")))
    goal = stage(target_words(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = F.floor(ratio)
    need = goal.withColumn("_need", F.col("target") - full * F.col("source_size"))
    below = thresholds(sizes, need.where("_need > 0").select("source", "_need"))
    s, g, f, b, h = (unused(docs, n) for n in ("_source", "_goal", "_full", "_below", "_hash"))
    plan = goal.alias("g").join(below.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source")), "left").select(
        F.col("g.source").alias(s), F.struct("source_size", "target").alias(g), full.alias(f), F.coalesce("_below", F.lit(0)).alias(b))
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    copies = F.col(f) + (F.col(h) < F.col(b)).cast("long")
    return (docs.select(*kept, size.alias("size"), uniform_hash(F.col(id_column), seed).alias(h))
            .join(plan, F.col(source_column).eqNullSafe(F.col(s)))
            .select(*kept, "size", F.col(f"{g}.source_size").alias("source_size"), F.col(f"{g}.target").alias("target"),
                    copies.alias("copies"), (F.col("size") * copies).alias("taken")))


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all columns it came with."""
    held = unused(docs, "_row")
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(source_column).alias("source"), F.struct(*docs.columns).alias(held))
    out = mix(narrow, id_column="id", text_column="text", source_column="source", **options).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{held}.*")
