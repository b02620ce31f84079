"""Token counts as rollups that deltas maintain.

Totals by source, language and tokenizer version are sums of signed rows: an insert adds, a delete subtracts, a revision
does both. A batch of changes is compared with the last known counts of its documents only, so the corpus is never read
again. Batches have ids, and a batch that is committed once changes nothing when it is sent again.

A store is a folder: `ledger` has the counts of each document and version as of each batch, `deltas` the signed sums of
each batch, `commits` one row per batch. The row is written last. What a batch wrote without one is not read, and the
next attempt replaces it. One writer at a time is assumed.

Null texts have no tokens. Null sources and languages are groups of their own. A batch holds one change per document and
version; of several the one largest by (deleted last, tokens, characters, source, language) holds. Rows with a null
id are one document. Deleting what is not there changes nothing. An empty batch is committed too.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_of, text_of

FOLDER = "/opt/tokenizers"
# How byte-level vocabularies cut a text before merging (fixed value, part of these vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]


@lru_cache
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Tokens per text; the file's ending tells the library. Strings of special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoder.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e) for t in texts for e in tokenizer.encode_batch([t], add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(pieces.encode(t)) for t in texts]


def token_count(text: Column, version: str, folder: str = FOLDER) -> Column:
    """Tokens of a text under the tokenizer in the file `version` of the folder, which every executor has."""
    path = os.path.join(folder, version)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(path)(texts.tolist()), dtype="int64")

    return count(text_of(text))


def insertions(docs: DataFrame, version: str, folder: str = FOLDER, ids: DataFrame | None = None) -> DataFrame:
    """Changes that give documents their counts, whether they had some or not.

    With `ids` (a stage table of distinct `doc_id`), only those documents are counted. Texts are read where they are: a
    filter of fixed size lets hardly any others through to the tokenizer, and the join meets the counts, not the texts.
    """
    if ids is not None:
        likely = docs.where(filter_of(ids.select("doc_id"))(F.col("doc_id")))
        return insertions(likely, version, folder).join(ids.select(F.col("doc_id").alias("_id")), F.col("doc_id") == F.col("_id")).drop("_id")
    return docs.select("doc_id", F.lit(version).alias("version"), F.lit(True).alias("alive"), "source", "lang",
                       token_count(F.col("text"), version, folder).alias("tokens"), F.length(text_of("text")).cast("long").alias("chars"))


def deletions(ids: DataFrame, version: str) -> DataFrame:
    """Changes that take documents' counts away."""
    return ids.select("doc_id", F.lit(version).alias("version"), F.lit(False).alias("alive"), F.lit(None).cast("string").alias("source"),
                      F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("chars"))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> dict[str, int]:
        """Batch ids in the order of their commits."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = {}
        if files.exists(path):
            for found in files.listStatus(path):
                if files.exists(jvm.org.apache.hadoop.fs.Path(found.getPath(), "_SUCCESS")):
                    number, _, batch = found.getPath().getName().partition("-")
                    done[bytes.fromhex(batch).decode()] = int(number)
        return done

    def _read(self, table: str, done: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.folder}/{table}/{b.encode().hex()}" for b in done]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch. False if it was committed before; then nothing changes."""
        done = self._committed()
        if batch in done:
            return False
        number, name = len(done), batch.encode().hex()
        order = F.struct((~F.col("alive")).alias("gone"), "tokens", "chars", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
        after = changes.groupBy("doc_id", "version").agg(F.max_by(F.struct("alive", "source", "lang", "tokens", "chars"), order).alias("s")).select(
            "doc_id", "version", F.lit(number).alias("seq"), "s.*")
        ledger = f"{self.folder}/ledger/{name}"
        after.write.mode("overwrite").parquet(ledger)
        after = self.spark.read.parquet(ledger)
        signed = after.where("alive").select(*KEYS, F.lit(1).alias("sign"), "tokens", "chars")
        earlier = self._read("ledger", done)
        if earlier is not None:
            touched = after.select(F.col("doc_id").alias("_id"), F.col("version").alias("_version"))
            before = (earlier.join(touched, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("version").eqNullSafe(F.col("_version")), "left_semi")
                      .groupBy("doc_id", "version").agg(F.max_by(F.struct("alive", "source", "lang", "tokens", "chars"), "seq").alias("s"))
                      .select("version", "s.*").where("alive"))
            signed = signed.union(before.select(*KEYS, F.lit(-1).alias("sign"), "tokens", "chars"))
        deltas = signed.groupBy(*KEYS).agg(F.sum("sign").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
                                           F.sum(F.col("sign") * F.col("chars")).alias("chars"))
        deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/{name}")
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(number).alias("seq")).write.mode("overwrite").parquet(
            f"{self.folder}/commits/{number}-{name}")
        return True

    def totals(self) -> DataFrame:
        """Documents, tokens and characters of every group that has documents."""
        deltas = self._read("deltas", self._committed())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, version string, docs long, tokens long, chars long")
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs != 0")
