"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, exactly.

Two such sets of n and m shingles share at least 0.8 n, so they share one of the n - ceil(0.8 n) + 1 shingles that come
first in any one order of all shingles. Here rare shingles come first: their rarity is read from a sketch of fixed size
that counts all shingles of the corpus. So a text is found by what is its own, and the text of a template, which many
share, is in nobody's first shingles while there is enough else. Members of a first shingle's bucket are compared if their
sizes and the places of the shingle allow enough overlap, and then by the shingles of the whole texts.

Links come first from the trie self-join of SimHash fingerprints (`simhash.links`), here of five-word shingles: each member
of a class of linked fingerprints meets one of them and stays linked if the texts are similar enough. At a similarity of
0.8 fingerprints differ in some ten of 64 bits, and a trie walk with room for twice as many finds nearly everything, so
what the trie cannot reach is left to the shared first shingles.

The members of a bucket then meet one of them, the one that shares most with others, a new one each round, as long as
that spares many pairs: members that links already join need not meet again. What is left then meets pair by pair, if
the parities of both sets, a few words per text, leave room for the similarity. So the components are those of all links,
while a large group of near copies costs about one row per copy.

Words are runs of anything but ASCII spaces, in ASCII lower case; a text of fewer than five words is one shingle. Null
texts count as empty, and texts without words are copies of each other. Long texts are read whole. Equal texts are one
node, told apart by 128 bits. A component is named by its smallest id; ids may be null or repeat. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, filter_of, stage, text_of, unused
from .components import components
from .simhash import _majority, _shingle_hashes, exact_orders, links

SHINGLE, SIMILARITY = 5, 0.8
# Counters of the sketch of shingles: 4 MB, however large the corpus is.
COUNTER_BITS = 19
# Pairs per member of a bucket above which members meet one of them first.
PAIRS_PER_MEMBER = 8
# Bits in which linked fingerprints differ at most.
BUDGET = 3
# Words of 64 parities of a text's shingles.
PARITIES = 4


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    found = np.unique(_shingle_hashes(text.encode("utf-8", "surrogatepass"), shingle))
    return found if len(found) else np.zeros(1, np.uint64)


def text_key(column: str) -> Column:
    """128 bits for a text."""
    return F.unhex(F.md5(text_of(column)))


def rarity(texts: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many texts have a shingle, by the first bits of its hash, added up over all that share them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(counts, shingle_set(t.as_py(), shingle) >> np.uint64(64 - COUNTER_BITS), 1)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["i", "c"])

    found = texts.mapInArrow(counted, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[found["i"].to_numpy()] = found["c"].to_numpy()
    return out


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each place: sets that differ in d shingles differ in d places at most."""
    places = np.bincount((shingles % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(places.astype(np.uint8), bitorder="little").view("<i8")


def _nodes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """One row per distinct text: `node`, `key`, `first_id`, `n`, `fp`, `odd` and `prefix`, its first shingles; a written table."""
    counts = rarity(docs.select("text"), shingle)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, prints, odd = [], [], [], []
            for t in batch.column(2):
                found = shingle_set(t.as_py(), shingle)
                prints.append(_majority(found))
                odd.append(parities(found))
                order = np.lexsort((found, counts[found >> np.uint64(64 - COUNTER_BITS)]))
                sizes.append(len(found))
                first.append(found[order[:prefix_length(len(found), similarity)]].view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()),
                                   pa.array(odd, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                                  ["first_id", "key", "n", "fp", "odd", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "key", "text").mapInArrow(prefixes, f"first_id {kind}, key binary, n int, fp long, odd array<long>, prefix array<long>")
    once = rows.groupBy("key").agg(F.min("first_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "fp", "odd", "prefix")])
    return stage(once.withColumn("node", F.monotonically_increasing_id()))


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The `u`, `v` of `pairs` whose texts are so similar; `texts` has `node`, `text`."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def shingles(text: str) -> np.ndarray:
            return shingle_set(text, shingle)

        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = shingles(x.as_py()), shingles(y.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    # Only texts of these pairs move.
    pairs = stage(pairs)
    met = [texts.where(filter_of(pairs.select(c))(F.col("node"))) for c in ("u", "v")]
    left, right = (t.select(F.col("node").alias(c), F.col("text").alias(x)) for t, c, x in zip(met, ("u", "v"), ("_a", "_b")))
    found = stage(pairs.join(left, "u").join(right, "v").select("u", "v", "_a", "_b").mapInArrow(checked, "u long, v long"))
    drop_stage(pairs)
    return found


def _buckets(nodes: DataFrame) -> DataFrame:
    """`shingle`, `node`, `n`, `pos`, `root`, `weight`: the members of first shingles that several nodes have.

    Near copies share most of their first shingles, so many buckets have the same members. Of these, only the one of the
    first shingle stays: nodes have their shingles in one order, so no pair in such buckets first meets in another one.
    Members are told apart by 128 bits, the sum without carry of their hashes.

    A node's weight is the number of members of all its buckets: the more a text shares, the less it has of its own.
    """
    postings = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    several = stage(postings.select("shingle").groupBy("shingle").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("shingle").alias("_shingle"), "_c"))
    likely = postings.where(filter_of(several.select("_shingle"))(F.col("shingle")))
    met = stage(likely.join(several, F.col("shingle") == F.col("_shingle")).drop("_shingle"))
    weights = met.groupBy(F.col("node").alias("_node")).agg(F.sum("_c").alias("weight"))
    sets = met.groupBy("shingle").agg(
        F.count("*").alias("c"), *[F.bit_xor(F.xxhash64(F.lit(seed), "node")).alias(f"x{seed}") for seed in (1, 2)], F.sum(F.col("pos").cast("long")).alias("place"))
    first = sets.groupBy("c", "x1", "x2").agg(F.min_by("shingle", F.struct("place", "shingle")).alias("_first"))
    kept = met.join(first.select("_first"), F.col("shingle") == F.col("_first"), "left_semi")
    found = stage(kept.join(weights, F.col("node") == F.col("_node")).select("shingle", "node", "n", "pos", F.col("node").alias("root"), "weight"))
    drop_stage(several, met)
    return found


def _members(docs: DataFrame, nodes: DataFrame, buckets: DataFrame) -> DataFrame:
    """`node`, `text` of all members of buckets. One row of a text is looked up by its id, so copies meet in no task."""
    wanted = stage(nodes.join(buckets.select(F.col("node").alias("_node")).distinct(), F.col("node") == F.col("_node"), "left_semi").select(
        "node", F.col("first_id").alias("_id"), F.col("key").alias("_key"), F.xxhash64("key").alias("_hash")))
    likely = docs.where(filter_of(wanted.select("_hash"))(F.xxhash64("key")))
    once = likely.groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    return stage(once.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "text"))


def _trie_links(nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """`u`, `v`: the similar ones of the pairs of each node with one node of its class of linked fingerprints."""
    prints = stage(nodes.select(F.col("fp").alias("node")).distinct())
    near = components(links(prints, exact_orders(BUDGET), BUDGET)).select(F.col("node").alias("_fp"), "root")
    classed = stage(nodes.join(near, F.col("fp") == F.col("_fp"), "left").select("node", F.coalesce("root", "fp").alias("class")))
    hubs = stage(classed.groupBy("class").agg(F.min("node").alias("hub"), F.count("*").alias("c")).where("c > 1").select(F.col("class").alias("_class"), "hub"))
    met = classed.join(hubs, F.col("class") == F.col("_class")).where("node != hub")
    found = similar(met.select(F.col("hub").alias("u"), F.col("node").alias("v")), texts, shingle, similarity)
    drop_stage(prints, classed, hubs)
    return found


def _links(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """`u`, `v`: links of nodes whose components are those of all links."""
    buckets = _buckets(nodes)
    texts = _members(docs, nodes, buckets)
    found: list[DataFrame] = [_trie_links(nodes, texts, shingle, similarity)]
    linked = stage(components(found[0]).select(F.col("node").alias("_node"), F.col("root").alias("_to")))
    now = buckets.join(linked, F.col("node") == F.col("_node"), "left").select("shingle", "node", "n", "pos", F.coalesce("_to", "node").alias("root"), "weight")
    share = F.lit(similarity / (1 + similarity))
    # The shared shingle and what comes after it on both sides is all that the sets can have in common, or an earlier
    # shingle is shared and its bucket finds them.
    possible = (F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9) & (
        F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("_pos")) >= share * (F.col("n") + F.col("m")) - 1e-9)
    # Sets so similar differ in this many shingles at most, and so in as many parities.
    apart_by = sum((F.bit_count(F.col(f"o{i}").bitwiseXOR(F.col(f"_o{i}"))) for i in range(PARITIES)), F.lit(0))
    alike = apart_by <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("n") + F.col("m")) + 1e-9
    before = math.inf
    while True:
        # Buckets whose members are not all joined yet, and the pairs they still have.
        parts = now.groupBy("shingle", "root").agg(F.count("*").alias("c"))
        unlike = stage(parts.groupBy("shingle").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count("*").alias("roots"))
                       .where("roots > 1").select(F.col("shingle").alias("_shingle"), ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), "all"))
        members, pairs = unlike.agg(F.sum("all"), F.sum("pairs")).first()
        if not members:
            break
        old, now = now, stage(now.join(unlike, F.col("shingle") == F.col("_shingle"), "left_semi"))
        drop_stage(old, unlike, buckets)
        # Rounds go on as long as each spares a quarter of the pairs.
        last = pairs <= PAIRS_PER_MEMBER * members or pairs > 0.75 * before
        other = now if last else stage(now.groupBy("shingle").agg(F.max_by(F.struct("node", "n", "pos", "root"), F.struct("weight", "node")).alias("h")).select("shingle", "h.*"))
        if last:
            odd = nodes.select(F.col("node").alias("_node"), *[F.col("odd")[i].alias(f"o{i}") for i in range(PARITIES)])
            old, now = now, stage(now.join(odd, F.col("node") == F.col("_node")).drop("_node", "weight"))
            drop_stage(old)
            other = now
        other = other.select(F.col("shingle").alias("_shingle"), F.col("node").alias("_node"), F.col("n").alias("m"), F.col("pos").alias("_pos"), F.col("root").alias("_root"),
                             *[F.col(f"o{i}").alias(f"_o{i}") for i in range(PARITIES) if last])
        apart = (F.col("root") < F.col("_root")) & alike if last else F.col("root") != F.col("_root")
        met = now.join(other, (F.col("shingle") == F.col("_shingle")) & apart & possible)
        found.append(similar(met.select(F.least("node", "_node").alias("u"), F.greatest("node", "_node").alias("v")).distinct(), texts, shingle, similarity))
        if last:
            break
        joined = stage(components(reduce(DataFrame.union, found))).select(F.col("node").alias("_node"), F.col("root").alias("_to"))
        # The one that all have met is done with this bucket.
        rest = now.join(other.select("_shingle", F.col("_node").alias("_hub")), (F.col("shingle") == F.col("_shingle")) & (F.col("node") == F.col("_hub")), "left_anti")
        old, now = now, stage(rest.join(joined, F.col("node") == F.col("_node"), "left").select("shingle", "node", "n", "pos", F.coalesce("_to", "node").alias("root"), "weight"))
        drop_stage(old, joined)
        before = pairs
    drop_stage(now, texts, linked, buckets)
    return reduce(DataFrame.union, found)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), text_key(text_column).alias("key"), text_of(text_column).alias("text"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """`key`, `first_id`, `root` for each distinct text: 128 bits of it, its smallest id, and the node that names its component.

    A component is named by the node with the smallest id, of these the one with the smallest key.
    """
    keyed = _keyed(docs, id_column, text_column)
    nodes = _nodes(keyed, shingle, similarity)
    named = nodes.join(components(_links(keyed, nodes, shingle, similarity)).withColumnRenamed("root", "_root"), "node", "left").select(
        "key", "first_id", F.coalesce("_root", "node").alias("root"))
    return stage(named)


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """One document of each component: the one with the smallest id, null ids last; of equal ids the smallest text key.

    Of rows with equal id and text, the first one by the other columns stays.
    """
    id_column, text_column = options.get("id_column", "doc_id"), options.get("text_column", "text")
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("b")
    kept = near_copies(docs, **options).groupBy("root").agg(best).select(F.col("b.first_id").alias("_kept_id"), F.col("b.key").alias("_kept_key"))
    key = unused(docs, "_key")
    others = [F.col(f.name) for f in docs.schema.fields if f.name not in (id_column, text_column) and not re.search("map<|variant", f.dataType.simpleString())]
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct(F.col(text_column).isNull(), *others)).alias("_row")
    once = docs.groupBy(F.col(id_column).alias("_one_id"), text_key(text_column).alias(key)).agg(row)
    return once.join(kept, F.col("_one_id").eqNullSafe(F.col("_kept_id")) & (F.col(key) == F.col("_kept_key")), "left_semi").select("_row.*")
