"""What several operators share: stage tables, global ranks, names that clash with no column, hash keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.scan import free_name as unused
from folio.functions.scan import ranked
from folio.session import cut_lineage, drop_stage

__all__ = ["WORD", "bound", "drop_stage", "filter_of", "ranked", "stage", "text_of", "uniform_hash", "unused", "word_count"]

# Words are runs of anything but these ASCII spaces (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"

# Bits of a filter of keys: 4 MB, however many keys there are.
FILTER_BITS = 25


def stage(df: DataFrame) -> DataFrame:
    """A written table in the shared folder: evaluated once, and safe when executors are lost."""
    return cut_lineage(df)


def text_of(column: str | Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def uniform_hash(key: Column, seed: int = 0) -> Column:
    """60 bits of MD5 of the key as text; any SQL engine can compute the same number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bound(value: Column, use) -> Column:
    """`use(value)` with the value computed once; a plain column may be computed again wherever a lambda names it."""
    return F.transform(F.array(value), use)[0]


def filter_of(keys: DataFrame):
    """A column function that is true for all values of the only column, a long, and for few others: a bitmap of fixed size."""
    key = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(1 << FILTER_BITS))
    words = keys.select(F.shiftright(key, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (key % 64).cast("int")).alias("b"))
    found = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bitmap[found["i"].to_numpy()] = found["b"].to_numpy()

    @F.pandas_udf("boolean")
    def passes(at: pd.Series) -> pd.Series:
        place = at.to_numpy()
        return pd.Series((bitmap[place >> 6] >> (place & 63)) & 1 == 1)

    return lambda column: passes(F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)))
