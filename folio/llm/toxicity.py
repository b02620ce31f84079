"""Toxicity scores: a lexicon learned from labels, matched with its misspellings, and weighed by context.

1. Lexicon. From labelled rows: words, and word beginnings with many endings, that are much likelier in toxic texts.
2. Matching. The lexicon is a trie. A word is run through the trie and a Levenshtein automaton at once: a state is the set
   of (node, edits) that the letters so far can have reached, and transitions are kept once computed. Longer terms may have
   more edits. Words that clean labelled texts use are no misspellings.
3. Context. A hit with quotation marks on both sides or a word of reporting near it counts as quoted, for less.
4. Score. Logistic regression on counts and shares of the hits.

Labels serve in fitting only; language, source and id are no inputs. Null and empty texts get the score of a text without
a hit. Rows with a null id cannot be labelled and are scored like others. If the labels have one class only, or there are
none, every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, text_of, unused

# Labelled rows that a fit may use, in the order of a hash of the id.
SAMPLE_ROWS = 8000
LEXICON_TERMS = 5000
STEM_LENGTHS = range(3, 8)
WINDOW = 6
QUOTES_OPEN, QUOTES_CLOSE = "\"“„«‘'‚›", "\"”“»’'‘‹"
# Words of reporting in the languages of the corpus.
REPORTING = frozenset("said says wrote writes called quoted quote quotes sagte schrieb zitat zitiert dit écrit citation dijo escribió cita".split())
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¿¡"


class Lexicon:
    """A trie of terms that is walked with edits. A term with a star matches every word that begins with it."""

    def __init__(self, weights: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[str, float, int]] = {}
        self.stem: dict[int, tuple[str, float]] = {}
        self.room = [0]
        for term in sorted(weights):
            node, letters = 0, term.rstrip("*")
            edits = 0 if term.endswith("*") or len(letters) < 5 else 1 if len(letters) < 9 else 2
            for c in letters:
                self.room[node] = max(self.room[node], edits)
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.room.append(0)
            self.room[node] = max(self.room[node], edits)
            if term.endswith("*"):
                self.stem[node] = (term, weights[term])
            else:
                self.term[node] = (term, weights[term], edits)
        self._forget()

    def _forget(self) -> None:
        """No state but the first one: for each its nodes, its transitions, the stem it stands on, and its best term."""
        self._states: list[dict[int, int]] = []
        self._numbers: dict[frozenset, int] = {}
        self._next: list[dict[str, int]] = []
        self._stems: list[tuple[str, float, int] | None] = []
        self._best: list[tuple[int, float, str] | None] = []
        self._start = self._number(self._closed({0: 0}))

    def _closed(self, state: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving out letters of a term."""
        todo = list(state.items())
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits + 1 <= self.room[child] and state.get(child, 99) > edits + 1:
                    state[child] = edits + 1
                    todo.append((child, edits + 1))
        return state

    def _number(self, state: dict[int, int]) -> int:
        key = frozenset(state.items())
        if key not in self._numbers:
            self._numbers[key] = len(self._states)
            self._states.append(state)
            self._next.append({})
            # Only one node is reached without an edit.
            self._stems.append(next(((*self.stem[n], -1) for n, edits in state.items() if not edits and n in self.stem), None))
            self._best.append(min(((edits, -self.term[n][1], self.term[n][0]) for n, edits in state.items() if n in self.term and edits <= self.term[n][2]), default=None))
        return self._numbers[key]

    def _step(self, number: int, letter: str) -> int:
        reached: dict[int, int] = {}
        for node, edits in self._states[number].items():
            for c, child in self.children[node].items():
                cost = edits + (c != letter)
                if cost <= self.room[child] and reached.get(child, 99) > cost:
                    reached[child] = cost
            if edits + 1 <= self.room[node] and reached.get(node, 99) > edits + 1:
                reached[node] = edits + 1
        out = self._number(self._closed(reached)) if reached else -1
        self._next[number][letter] = out
        return out

    def find(self, word: str) -> tuple[str, float, int] | None:
        """The best term for a word: fewest edits, then most weight, then the term itself; -1 edits marks a stem."""
        now, best = self._start, None
        for at, letter in enumerate(word):
            if len(self._states) > 50_000:
                # Transitions are a cache; a fresh one gives the same answers.
                self._forget()
                return self.find(word)
            following = self._next[now].get(letter)
            now = self._step(now, letter) if following is None else following
            if now < 0:
                break
            if self._stems[now] and at + 1 < len(word):
                best = self._stems[now]
        if now >= 0 and self._best[now]:
            edits, weight, term = self._best[now]
            if not (edits and best):
                return term, -weight, edits
        return best


def words_of(text: str) -> list[str]:
    """Runs between white space, in lower case, with their punctuation."""
    return text.lower().split()


def bare(word: str) -> str:
    return word.strip(EDGE)


@dataclass
class Model:
    """What a fit found; small, and sent to every task."""

    weights: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    coefficients: list[float] = field(default_factory=list)
    base: float = 0.0


FEATURES = ["plain", "plain_share", "near", "near_share", "stem", "stem_share", "quoted", "strongest"]


class Matcher:
    def __init__(self, model: Model):
        self.lexicon, self.clean = Lexicon(model.weights), model.clean
        self.known: dict[str, tuple[str, float, int] | None] = {}

    def match(self, raw: str) -> tuple[str, float, int] | None:
        if raw not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            word = bare(raw)
            found = self.lexicon.find(word) if word else None
            if found and found[2] > 0 and word in self.clean:
                found = None
            self.known[raw] = found
        return self.known[raw]

    def features(self, text: str) -> list[float]:
        words = words_of(text)
        distinct = {w: m for w in set(words) if (m := self.match(w))}
        if not distinct:
            return [0.0] * len(FEATURES)
        sums, quoted, strongest = [0.0, 0.0, 0.0], 0.0, 0.0
        for i, w in enumerate(words):
            m = distinct.get(w)
            if not m:
                continue
            left, right = words[max(0, i - WINDOW):i], words[i + 1:i + 1 + WINDOW]
            inside = (w[0] in QUOTES_OPEN or any(x[0] in QUOTES_OPEN for x in left)) and (
                any(c in QUOTES_CLOSE for c in w[-3:]) or any(c in QUOTES_CLOSE for x in right for c in x[-3:]))
            if inside or any(bare(x) in REPORTING for x in left + right):
                quoted += m[1]
                continue
            kind = 2 if m[2] < 0 else 1 if m[2] else 0
            sums[kind] += m[1]
            strongest = max(strongest, m[1] if kind != 2 else 0.0)
        n = len(words)
        shares = [min(1.0, 20 * s / n) for s in sums]
        return [np.log1p(sums[0]), shares[0], np.log1p(sums[1]), shares[1], np.log1p(sums[2]), shares[2], np.log1p(quoted), strongest]


def _terms(text: str) -> set[str]:
    """The words of a text and their beginnings; a star marks a beginning."""
    out = set()
    for raw in set(words_of(text)):
        word = bare(raw)
        if word and len(word) <= 40:
            out.add(word)
            out.update(word[:k] + "*" for k in STEM_LENGTHS if len(word) > k)
    return out


def _lexicon(sample: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Terms far likelier in toxic texts, with the logarithm of that ratio."""

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(_terms(t)))

    counts = sample.select("toxic", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.1) / F.lit(positives + 0.2)) - F.log((F.col("good") + 0.1) / F.lit(negatives + 0.2))
    word, stem = ~F.col("term").endswith("*"), F.col("term").endswith("*")
    rows = counts.withColumn("odds", odds).where(
        (word & (F.col("bad") >= 4) & (F.col("odds") >= 3.0)) | (stem & (F.col("bad") >= 6) & (F.col("odds") >= 2.0))).orderBy(
        F.col("bad").desc(), "term").limit(4 * LEXICON_TERMS).collect()
    found = {r["term"]: (float(r["odds"]), r["bad"]) for r in rows}
    kept: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        odds_of, bad = found[term]
        letters = term.rstrip("*")
        shorter = [letters[:k] + "*" for k in range(len(letters) - 1, 0, -1)]
        covered = next((found[s] for s in shorter if s in kept), None)
        if term.endswith("*"):
            # One word's beginnings say no more than the word; a longer beginning must say more than a shorter one.
            if max((found[w][1] for w in (letters,) if w in found), default=0) >= 0.8 * bad or (covered and covered[0] > odds_of - 1.0):
                continue
            single = max((n for w, (_, n) in found.items() if not w.endswith("*") and w.startswith(letters)), default=0)
            if single >= 0.8 * bad:
                continue
        elif covered and covered[0] >= odds_of - 1.0:
            continue
        kept[term] = odds_of
    best = sorted(kept, key=lambda t: (-kept[t], t))[:LEXICON_TERMS]
    return {t: round(kept[t], 6) for t in best}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Intercept and weights, by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labelled documents (`doc_id`, `text`; `doc_id`, `toxic`), of which `usable` may leave out some."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    if usable is not None:
        known = known.where(usable)
    # A bounded, documented sample of labelled rows; an id decides by its hash.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = stage(docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id"))
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    positives, rows = int(totals[0] or 0), int(totals[1])
    if not positives or positives == rows:
        return Model(base=positives / rows if rows else 0.0)
    model = Model(weights=_lexicon(sample, positives, rows - positives), base=positives / rows)
    matched = Lexicon(model.weights)

    @F.pandas_udf("array<string>")
    def near(texts: pd.Series) -> pd.Series:
        def of(text: str) -> list[str]:
            bares = {bare(w) for w in words_of(text)}
            return sorted(w for w in bares if w and (m := matched.find(w)) and m[2] > 0)
        return texts.map(of)

    # At most the distinct words of the sample within an edit or two of a term.
    clean = sample.where("toxic = 0").select(F.explode(near(F.col("text"))).alias("w")).groupBy("w").count().where("count >= 2").collect()
    model.clean = frozenset(r["w"] for r in clean)
    # At most `sample_rows` rows of a few numbers; sorted, so that sums agree between runs.
    data = sorted(sample.select("toxic", _features(model)(F.col("text")).alias("x")).collect(), key=lambda r: (r["toxic"], r["x"]))
    model.coefficients = _logistic(np.array([r["x"] for r in data]), np.array([r["toxic"] for r in data], float))
    return model


def _features(model: Model):
    held: dict[str, Matcher] = {}

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        matcher = held.setdefault("m", Matcher(model))
        return pd.Series([matcher.features(t) for t in texts], dtype=object)

    return features


def scorer(model: Model):
    """A column function: text → probability of the label 1."""
    if not model.coefficients:
        return lambda text: F.lit(float(model.base))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, w = Matcher(model), np.array(model.coefficients)
        for texts in batches:
            x = np.array([matcher.features(t) for t in texts], float).reshape(len(texts), len(w) - 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return lambda text: score(text_of(text))


def held_out(doc_id: Column) -> Column:
    """Every fifth id by its checksum is kept from fitting. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with `held_out`, `score` and `predicted`; columns of these names are replaced."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    kept = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = docs.select(*kept, held_out(F.col("doc_id")).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def civil_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with the columns they came with."""
    score = unused(docs, "_score")
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    return docs.withColumn(score, scorer(model)(F.col("text"))).where(F.col(score) < 0.5).select(*docs.columns)
