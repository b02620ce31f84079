"""Line dedup by distinct-site spread: lines that many sites share are boilerplate, and go.

Every line hash gets a HyperLogLog sketch of its sites; sketches combine before and after the shuffle. An estimate far
from the threshold decides at once. Lines near it get an exact count of distinct sites. So the result is that of exact
counts, and only few lines cost one.

Lines are what stands between line feeds, of any length, compared without white space (ASCII) at both ends; lines of white
space alone stay. Lines are told apart by 128 bits. Null texts count as empty, long ones are read whole. A null site is one
site, apart from the empty one. Repeated documents count once per site. An empty table gives an empty result. Columns of the
input named `lines`, `removed` or `kept_text` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unused

BLANKS = " \t\r\x0b\x0c"
# A sketch of 2^12 registers errs by about 1.6%; six times that decides without an exact count.
REGISTERS, MARGIN = 12, 0.1


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """`key`, `site` rows → the keys on `min_sites` or more distinct sites."""
    low, high = int(min_sites * (1 - MARGIN)) - 1, int(min_sites * (1 + MARGIN)) + 1
    sketches = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"))
    spread = stage(sketches.select("key", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    near = spread.where(F.col("sites") <= high).select(F.col("key").alias("_near"))
    exact = (lines.join(near, F.col("key") == F.col("_near"), "left_semi").groupBy("key", "site").agg(F.lit(1).alias("_one"))
             .groupBy("key").count().where(F.col("count") >= min_sites).select("key"))
    return stage(spread.where(F.col("sites") > high).select("key").union(exact))


def without_boilerplate(docs: DataFrame, min_sites: int = 5, id_column: str = "doc_id", text_column: str = "text",
                        site_column: str = "source") -> DataFrame:
    """The documents with `lines`, `removed` (numbers of lines) and `kept_text`."""
    text = text_of(text_column)
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(trimmed, lambda x: F.when(F.length(x) > 0, F.unhex(F.md5(x))))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_column).cast("string")), F.lit(""))
    placed = stage(docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("body"), site.alias("site"),
                               F.posexplode_outer(hashed).alias("at", "key")).where("key IS NOT NULL"))
    keys = boilerplate(placed.select("key", "site"), min_sites).withColumnRenamed("key", "_key")
    found = placed.join(keys, F.col("key") == F.col("_key"), "left_semi").groupBy("id", "body").agg(F.collect_set("at").alias("gone"))
    i, b, g, h = (unused(docs, n) for n in ("_id", "_body", "_gone", "_hash"))
    kept = [c for c in docs.columns if c.lower() not in ("lines", "removed", "kept_text")]
    met = docs.select(*kept, F.xxhash64(text).alias(h)).join(
        found.select(F.col("id").alias(i), F.col("body").alias(b), F.col("gone").alias(g)),
        F.col(id_column).eqNullSafe(F.col(i)) & (F.col(h) == F.col(b)), "left")
    parts = F.split(text, "\n", -1)
    stays = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(g)))
    rest = F.when(F.col(g).isNull(), text).otherwise(F.transform(F.array(F.struct(parts.alias("p"), stays.alias("s"))), lambda x: F.array_join(
        F.transform(x["s"], lambda n: F.get(x["p"], n)), "\n"))[0])
    return met.select(*kept, F.size(parts).alias("lines"), F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).alias("removed"), rest.alias("kept_text"))
