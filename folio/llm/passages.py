"""A quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words, the label is that of the document. Every passage of the whole text is encoded;
a gated attention, learned with the encoder from document labels alone, says how much each passage counts, and the score is
that of the weighted passage representation:

    h = tanh(W x + b),  a = softmax over passages of u · (tanh(V h) * sigmoid(G h)),  score = sigmoid(c · Σ a h + d)

The numbers x of a passage are shares of letters, capitals, digits and signs, lengths of words, and repetitions: words that
repeat in the passage, follow themselves, or stand in a run of three words that the document had before.

The fit uses a bounded sample of labelled rows: at most SAMPLE_ROWS rows by a hash of their id, without documents of more
than FIT_PASSAGES passages. Scoring takes every text whole. Labels serve in fitting only; language, source and id are no
inputs. Null texts count as empty; an empty text is one passage without words. Rows with a null id cannot be labelled and
are scored like others; of several labels of an id the largest counts. With labels of one class, or none, every score is
the share of labels 1 (0 without labels). Equal texts have equal scores. An empty table gives an empty result; columns
of the input with the names of the result are replaced, others are kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, unused

PASSAGE_WORDS = 64
# Bounds of the fit, and its steps.
SAMPLE_ROWS, FIT_PASSAGES, STEPS = 4000, 256, 400
HIDDEN, GATE, DECAY, RATE = 12, 8, 1e-3, 0.02
# Codes that are looked up; letters beyond count as signs.
CODES = 1 << 16
NUMBERS = 16


@cache
def _kinds() -> tuple[np.ndarray, ...]:
    """For each code: letter, capital, digit, blank of a word's edge, sentence end."""
    names = [unicodedata.category(chr(i)) for i in range(CODES)]
    letter = np.array([n[0] in "LM" for n in names])
    blank = np.zeros(CODES, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    end = np.zeros(CODES, bool)
    end[[ord(c) for c in ".!?…。"]] = True
    return letter, np.array([n == "Lu" for n in names]), np.array([n == "Nd" for n in names]), blank, end


def encoded(text: str) -> np.ndarray:
    """One row of numbers per passage."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), CODES - 1)
    letter, capital, digit, blank, end = (k[codes] for k in _kinds())
    word = ~blank
    starts = np.flatnonzero(word & np.concatenate(([True], blank[:-1]))) if len(codes) else np.zeros(0, np.int64)
    n = len(starts)
    if not n:
        return np.zeros((1, NUMBERS), np.float32)
    at = np.cumsum(np.bincount(starts, minlength=len(codes))) - 1
    inside = np.flatnonzero(word)
    of = at[inside]
    size = np.bincount(of, minlength=n)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=mask[inside], minlength=n)

    letters, capitals, digits, ends = (per_word(m) for m in (letter, capital, digit, end))
    foreign = per_word(letter & (codes > 127))
    signs = size - letters - digits
    # A hash of each word, then of each run of three words.
    powers = np.cumprod(np.full(int(size.max()), 0x100000001B3, np.uint64))
    mixed = (codes[inside].astype(np.uint64) + np.uint64(1)) * powers[inside - starts[of]]
    keys = np.add.reduceat(mixed, np.concatenate(([0], np.cumsum(size)[:-1])))
    keys ^= keys >> np.uint64(31)
    runs = keys.copy()
    for ahead in (1, 2):
        runs[:n - ahead] = runs[:n - ahead] * np.uint64(0x9E3779B97F4A7C15) + keys[ahead:]
    first = np.unique(runs[:max(n - 2, 0)], return_index=True)[1]
    again = np.zeros(n)
    again[:max(n - 2, 0)] = 1
    again[first] = 0
    follows = np.concatenate(([0.0], keys[1:] == keys[:-1]))

    passage = np.arange(n) // PASSAGE_WORDS
    count = int(passage[-1]) + 1

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(passage, weights=values, minlength=count)

    words = total(np.ones(n))
    order = np.lexsort((keys, passage))
    new = np.ones(n, bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], weights=new, minlength=count)
    chars, alphas = total(size.astype(float)), total(letters)
    mean = chars / words
    spread = np.sqrt(np.maximum(total(size.astype(float) ** 2) / words - mean ** 2, 0))
    some = np.maximum(alphas, 1)
    lines = np.bincount(np.minimum(at[codes == 10], n - 1).clip(0) // PASSAGE_WORDS, minlength=count)
    return np.column_stack((
        total(capitals) / some, total((capitals > 1) & (capitals == letters)) / words, total(digits) / chars, total(signs) / chars,
        total(signs > 1) / words, total(letters == 0) / words, total(foreign) / some, total(ends) / words,
        mean / 10, spread / 10, total((size > 25).astype(float)) / words, distinct / words,
        total(follows) / words, total(again) / words, np.minimum(lines / words, 1), np.log1p(words) / 5)).astype(np.float32)


class Model(NamedTuple):
    """Weights by name, the numbers' means and spreads; without weights every score is `base`."""

    base: float
    weights: dict[str, np.ndarray] | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Pass(NamedTuple):
    """What a forward pass leaves for the gradient."""

    h: np.ndarray
    t: np.ndarray
    g: np.ndarray
    a: np.ndarray
    z: np.ndarray
    p: np.ndarray


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> _Pass:
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["G"])
    e = (t * g) @ w["u"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return _Pass(h, t, g, a, z, _sigmoid(z @ w["c"] + w["d"]))


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss with a penalty on all weights but the offsets."""
    f = _forward(w, x, starts, bag)
    miss = (f.p - y) / len(y)
    dz = miss[:, None] * w["c"]
    da = (dz[bag] * f.h).sum(axis=1)
    de = f.a * (da - np.add.reduceat(f.a * da, starts)[bag])
    du = de[:, None] * w["u"]
    dt, dg = du * f.g * (1 - f.t ** 2), du * f.t * f.g * (1 - f.g)
    dh = (f.a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["G"].T) * (1 - f.h ** 2)
    out = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": f.h.T @ dt, "G": f.h.T @ dg, "u": (f.t * f.g).T @ de, "c": f.z.T @ miss, "d": miss.sum()}
    return {k: v + (DECAY * w[k] if k not in ("b", "d") else 0) for k, v in out.items()}


def trained(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Model:
    """A model from the passages of all bags, one after the other, the bags' sizes and labels; Adam over the whole sample."""
    base = float(y.mean()) if len(y) else 0.0
    if base in (0.0, 1.0):
        return Model(base)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / spread
    starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    random = np.random.Generator(np.random.PCG64(42))
    shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "G": (HIDDEN, GATE), "u": (GATE,), "c": (HIDDEN,), "d": ()}
    w = {k: random.normal(0, 0.3, s) if k not in ("b", "d") else np.zeros(s) for k, s in shapes.items()}
    w["d"] = np.array(np.log(base / (1 - base)))
    one, two = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in _gradient(w, x, starts, bag, y).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            w[k] = w[k] - rate * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(base, w, mean, spread)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
        fit_passages: int = FIT_PASSAGES) -> Model:
    """A model from labelled documents (`doc_id`, `text`; `doc_id` and the label), of which `usable` may leave out some."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    if usable is not None:
        known = known.where(usable)
    # At most `sample_rows` ids, so the broadcast is bounded.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, y, encoded(t)) for i, y, t in zip(*[c.to_pylist() for c in batch.columns])]
            rows = [(i, y, x) for i, y, x in rows if len(x) <= fit_passages]
            yield pa.record_batch([pa.array([i for i, _, _ in rows], batch.schema.types[0]), pa.array([y for _, y, _ in rows], pa.int32()),
                                   pa.array([x.tobytes() for _, _, x in rows], pa.binary())], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    # Sorted, so that the fit is the same in each run; ids that repeat do not widen the sample.
    data = rows.mapInArrow(passages, f"doc_id {kind}, y int, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).toArrow()
    bags = [np.frombuffer(b, np.float32).reshape(-1, NUMBERS) for b in data["x"].to_pylist()]
    y = np.array(data["y"].to_pylist(), float)
    return trained(np.concatenate(bags).astype(float) if bags else np.zeros((0, NUMBERS)), np.array([len(b) for b in bags], int), y)


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    bags = [encoded(t) for t in texts]
    sizes = np.array([len(b) for b in bags])
    x = (np.concatenate(bags).astype(float) - model.mean) / model.spread
    return _forward(model.weights, x, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)).p


def scorer(model: Model):
    """A column function: text → probability of the label 1."""
    if model.weights is None:
        return lambda text: F.lit(model.base)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        # A few texts at once: a long one has many passages. Rounded, as sums may end differently by what stands beside.
        out = [probabilities(model, texts.iloc[i:i + 64].tolist()) for i in range(0, len(texts), 64)]
        return pd.Series(np.round(np.concatenate(out), 9) if out else [], dtype="float64")

    return lambda text: score(text_of(text))


def held_out(doc_id: Column) -> Column:
    """Ids whose checksum leaves 2 on division by 4 are kept from fitting. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents with `held_out`, `score` and `predicted` (1 from `least` on); columns of these names are replaced."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = docs.select(*kept, held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that are predicted to be good, with the columns they came with."""
    score = unused(docs, "_score")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return docs.withColumn(score, scorer(model)(F.col("text"))).where(F.col(score) >= least).select(*docs.columns)
