"""Language-model scores by deleted interpolation.

The model mixes a uniform share, word frequencies and frequencies after the word before:

    P(w | v) = m0 / (V + 1) + m1 c(w) / N + m2 c(v w) / c(v)

The weights m depend on how often the context v was seen (a bucket per power of two). Expectation maximisation learns
them on held-out counts: each training token is predicted from the counts without itself (the "deleted" estimate).

Counting moves packed arrays instead of rows. Texts are cut into chunks. Of a chunk's distinct words and word pairs,
sorted by hash, each range of hashes goes with its training counts to one task as one compressed value. That task
adds up the counts of all chunks and answers every chunk with the totals; the answers meet the chunk's words, which are
read a second time instead of being shuffled twice. So the input has to give the same rows in the same partitions
each time, as a scan of files does; write other inputs to a table first. A difference is noticed and ends the job.
All counts are over all documents. Only sums, and a histogram of fixed size for the weights, reach the driver.

Tokens are words of the ASCII-lower-cased text, then one end per text; 62 bits of a hash stand for a word or pair. Null
texts count as empty. Rows with a null id are training rows. Repeated rows count each time. Without training rows every
count is 0 and a score is that of the uniform share. Other columns of the input are left out. A text and the words of
one hash range have to fit into a task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of

CHUNK_BYTES, RANGE_BYTES, MOST_RANGES = 4 << 20, 8 << 20, 4096
BUCKETS, RATES, COUNTS = 24, 80, 160
END, BEGIN = b"\n", np.uint64(4 * 0x5851F42D4C957F2D & ((1 << 64) - 4)) | np.uint64(1)
CHUNK, ANSWER, TOTALS = 0, 1, 2


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of equal rank side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and pair keys of all tokens of a chunk; the low bits tell words from pairs."""
    word = (hashes & ~np.uint64(3)) | np.uint64(1)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(lengths) - lengths] = BEGIN
    pair = (_mix(context * np.uint64(0x9E3779B97F4A7C15) + word) & ~np.uint64(3)) | np.uint64(2)
    return word, context, pair


def _request(word: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """All distinct keys of a chunk, in order."""
    keys = np.sort(np.concatenate((word, pair, [BEGIN])))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))]


def _edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins in sorted keys; and their number at the end."""
    cuts = np.array([(i << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)]))


def _read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of a chunk, the tokens as indexes into them, and the number of tokens of each text."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    tokens, lengths = [], []
    for text in texts:
        words = text.lower().split()
        tokens.append(np.fromiter(map(known.__getitem__, words), np.uint32, len(words)))
        tokens.append(np.array([known[END]], np.uint32))
        lengths.append(len(words) + 1)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    return hashes, np.concatenate(tokens), np.array(lengths, np.int64)


SENT = "range int, chunk long, kind int, first int, keys binary, counts binary, rest binary"
SENT_NAMES = [c.split(" ")[0] for c in SENT.split(", ")]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of a partition in numbered chunks; the same rows give the same chunks when they are read again."""
    chunk, size = None, 0
    held: list[tuple] = []
    for batch in batches:
        for *row, part in zip(*(c.to_pylist() for c in batch.columns)):
            chunk = part << 32 if chunk is None else chunk
            held.append(row)
            size += len(row[1])
            if size >= CHUNK_BYTES:
                yield chunk, held
                held, size, chunk = [], 0, chunk + 1
    if held:
        yield chunk, held


def _tokens_of(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _read([text.encode("utf-8", "surrogatepass") for _, text, _ in rows])


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], SENT_NAMES)


def _requests(ranges: int):
    """Distinct keys of each chunk with their training counts, a row for each range of hashes."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _chunks(batches):
            training = [r[2] for r in rows]
            hashes, tokens, lengths = _tokens_of(rows)
            word, _, pair = _keys(hashes[tokens], lengths)
            learned = np.repeat(np.array(training, bool), lengths)
            keys = _request(word, pair)
            counts = np.zeros(len(keys), np.uint32)
            seen = np.sort(np.concatenate((word[learned], pair[learned])))
            if len(seen):
                starts = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1])))
                counts[np.searchsorted(keys, seen[starts])] = np.diff(np.append(starts, len(seen)))
            counts[np.searchsorted(keys, BEGIN)] = sum(training)
            edges = _edges(keys, ranges)
            sent = []
            for r in np.flatnonzero(edges[1:] > edges[:-1]):
                a, b = edges[r], edges[r + 1]
                steps = np.diff(keys[a:b], prepend=np.uint64(0))
                sent.append((int(r), chunk, ANSWER, int(a), _squeeze(steps), _squeeze(counts[a:b]), None))
            yield _sent(sent)

    return send


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each chunk, and which rows they are of."""
    for chunk, rows in _chunks(batches):
        ids, _, training = zip(*rows)
        hashes, tokens, lengths = _tokens_of(rows)
        meta = pa.BufferOutputStream()
        table = pa.record_batch([pa.array(ids, pa.int64()), pa.array(training, pa.bool_()), pa.array(lengths)], ["id", "training", "tokens"])
        with pa.ipc.new_stream(meta, table.schema) as out:
            out.write_batch(table)
        yield _sent([(0, chunk, CHUNK, -1, _squeeze(hashes), _squeeze(tokens), meta.getvalue().to_pybytes())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range of hashes, the total counts, given to every chunk that asked."""
    def answer(asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(_expand(r[4], np.uint64), dtype=np.uint64) for r in asked]
        sizes = np.array([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        counts = np.concatenate([_expand(r[5], np.uint32) for r in asked])[order].astype(np.int64)
        totals = np.add.reduceat(counts, np.flatnonzero(first))
        own = np.empty(len(every), np.int64)
        own[order] = totals[np.cumsum(first) - 1]
        words = ((ranked[first] & np.uint64(3)) == 1) & (ranked[first] != BEGIN) & (totals > 0)
        out = [(r[0], r[1], ANSWER, r[3], None, _squeeze(part.astype(np.uint32)), None) for r, part in zip(asked, np.split(own, np.cumsum(sizes)[:-1]))]
        out.append((asked[0][0], -1, TOTALS, 0, None, None, np.array([words.sum(), totals[words].sum()], np.int64).tobytes()))
        yield _sent(out)

    asked: list[tuple] = []
    for row in _rows(batches):
        if asked and asked[0][0] != row[0]:
            yield from answer(asked)
            asked = []
        asked.append(row)
    if asked:
        yield from answer(asked)


COUNTED = "chunk long, rows binary, word binary, pair binary, begun long, totals array<long>, cells array<long>, seen array<long>"
COUNTED_NAMES = [c.split(" ")[0] for c in COUNTED.split(", ")]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0: never seen; then one per power of two."""
    return np.minimum(np.ceil(np.log2(context.astype(float) + 1)).astype(np.int64), BUCKETS - 1)


def _before(own: np.ndarray, lengths: np.ndarray, begun: int) -> np.ndarray:
    """Counts of the contexts: of the word before, or of texts begun."""
    out = np.empty_like(own)
    out[1:] = own[:-1]
    out[np.cumsum(lengths) - lengths] = begun
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of every token of a chunk, and of its training tokens the histogram from which weights are learned."""
    def join(chunk: tuple, parts: list[np.ndarray]) -> tuple:
        hashes, tokens = _expand(chunk[4], np.uint64), _expand(chunk[5], np.uint32)
        rows = pa.ipc.open_stream(chunk[6]).read_all()
        lengths = rows["tokens"].to_numpy()
        word, context, pair = _keys(hashes[tokens], lengths)
        keys, counts = _request(word, pair), np.concatenate([np.zeros(0, np.uint32), *parts])
        if len(keys) != len(counts):
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
        # Words repeat, so their place is looked up once each.
        own = counts[np.searchsorted(keys, (hashes & ~np.uint64(3)) | np.uint64(1))][tokens]
        begun = int(counts[np.searchsorted(keys, BEGIN)])
        before = _before(own, lengths, begun)
        both = counts[np.searchsorted(keys, pair)]
        learned = np.repeat(rows["training"].to_numpy(zero_copy_only=False), lengths)
        c, b, p = own[learned].astype(np.int64) - 1, before[learned].astype(np.int64) - 1, both[learned].astype(np.int64) - 1
        rate = np.where(p > 0, 1 + np.clip(-4 * np.log2(np.maximum(p, 1) / np.maximum(b, 1)), 0, RATES - 2), 0).astype(np.int64)
        often = np.where(c > 0, 1 + np.clip(4 * np.log2(np.maximum(c, 1)), 0, COUNTS - 2), 0).astype(np.int64)
        cells, seen = np.unique((_bucket(np.maximum(b, 0)) * RATES + rate) * COUNTS + often, return_counts=True)
        return (chunk[1], chunk[6], _squeeze(own), _squeeze(both), begun, None, cells.tolist(), seen.tolist())

    def packed(row: tuple) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], COUNTED_NAMES)

    chunk, parts = None, []
    for row in _rows(batches):
        if row[2] == TOTALS:
            yield packed((-1, None, None, None, None, np.frombuffer(row[6], np.int64).tolist(), None, None))
            continue
        if row[2] == CHUNK:
            if chunk:
                yield packed(join(chunk, parts))
            chunk, parts = row, []
        else:
            parts.append(_expand(row[5], np.uint32))
    if chunk:
        yield packed(join(chunk, parts))


def mixture_weights(histogram: dict[int, int], n: int, v: int, rounds: int = 100) -> np.ndarray:
    """Three weights per bucket of the context's count, by expectation maximisation over the deleted counts."""
    weights = np.tile([0.1, 0.9, 0.0], (BUCKETS, 1))
    cells = np.array(sorted(histogram), np.int64)
    seen = np.array([histogram[c] for c in cells.tolist()], float)
    bucket, rate, often = cells // (RATES * COUNTS), cells // COUNTS % RATES, cells % COUNTS
    each = np.column_stack((
        np.full(len(cells), 1.0 / (v + 1)),
        np.where(often > 0, np.exp2((often - 0.5) / 4) / max(n - 1, 1), 0.0),
        np.where(rate > 0, np.exp2(-(rate - 0.5) / 4), 0.0)))
    for b in range(BUCKETS):
        here = bucket == b
        if not here.any():
            continue
        rates, times = each[here], seen[here]
        w = np.array([0.2, 0.5, 0.3]) if b else np.array([0.3, 0.7, 0.0])
        for _ in range(rounds):
            share = rates * w
            share /= share.sum(axis=1, keepdims=True)
            # One more token for the uniform and the word share, so that no weight of theirs becomes 0.
            w = (share * times[:, None]).sum(axis=0) + np.array([0.5, 0.5, 0.0])
            w /= w.sum()
        weights[b] = w
    for b in range(1, BUCKETS):
        if not (bucket == b).any():
            weights[b] = weights[b - 1]
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
SCORED_NAMES = [c.split(" ")[0] for c in SCORED.split(", ")]


def _scorer(weights: np.ndarray, n: int, v: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _rows(batches):
            rows = pa.ipc.open_stream(chunk[0]).read_all()
            lengths = rows["tokens"].to_numpy()
            starts = np.cumsum(lengths) - lengths
            own, both = (_expand(chunk[i], np.uint32).astype(np.int64) for i in (1, 2))
            before = _before(own, lengths, chunk[3])
            base = np.log10((own + 1.0) / (n + v + 1.0))
            w = weights[_bucket(before)]
            # Where the context was never seen, its bucket gives the pair no weight.
            p = w[:, 0] / (v + 1.0) + w[:, 1] * own / max(n, 1) + w[:, 2] * both / np.maximum(before, 1)
            sums = (np.add.reduceat(x, starts) for x in ((own > 0).astype(np.int64), base, np.log10(p)))
            known, base_sum, score_sum = sums
            yield pa.RecordBatch.from_arrays([
                rows["id"].combine_chunks(), pa.array(~rows["training"].to_numpy(zero_copy_only=False)), pa.array(lengths), pa.array(known),
                pa.array(base_sum), pa.array(score_sum)], SCORED_NAMES)

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def scores(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` → per row `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`."""
    rows = docs.select("doc_id", text_of("text").alias("text"), (~held_out(F.col("doc_id"))).alias("training"),
                       F.spark_partition_id().alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(MOST_RANGES, max(parts, ceil(size / RANGE_BYTES)))
    asked = rows.mapInArrow(_requests(ranges), SENT)
    answers = asked.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(_answers, SENT)
    met = answers.union(rows.mapInArrow(_contents, SENT)).repartition(ranges, "chunk").sortWithinPartitions("chunk", "kind", "first")
    counted = stage(met.mapInArrow(_counted, COUNTED))
    v, n = counted.where("totals IS NOT NULL").agg(F.sum(F.get("totals", F.lit(0))), F.sum(F.get("totals", F.lit(1)))).first()
    v, n = int(v or 0), int(n or 0)
    histogram = {r[0]: r[1] for r in counted.select(F.explode(F.arrays_zip("cells", "seen")).alias("x")).groupBy("x.cells").agg(F.sum("x.seen")).collect()}
    weights = mixture_weights(histogram, n, v)
    done = counted.where("rows IS NOT NULL").select("rows", "word", "pair", "begun").mapInArrow(_scorer(weights, n, v), SCORED)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
