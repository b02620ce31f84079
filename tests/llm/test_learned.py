"""Toxicity, SimHash, token counts, MinHash and language-model scores, against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import copies, lm, minhash, simhash, token_counts, toxicity

from .conftest import hard_rows, prose


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lexicon_finds_what_edit_distance_finds():
    terms = {"idiot": 3.0, "worthless": 2.0, "scum": 4.0, "idiotic": 1.0, "réeux*": 2.5}
    lexicon = toxicity.Lexicon(terms)
    allowed = {t: 0 if len(t) < 5 else 1 if len(t) < 9 else 2 for t in terms if "*" not in t}
    words = ["idiot", "idoit", "1diot", "idiots", "diot", "worthles", "wortless", "w0rthl3ss", "wrthlss", "scum", "scun", "idiotix", "xidiotxx", "", "i", "réeuxment", "réeux"]
    words += [w[:i] + c + w[i:] for w in allowed for i in range(len(w) + 1) for c in "az"]
    for w in words:
        best = min(((d, -terms[t], t) for t, k in allowed.items() if (d := edits(w, t)) <= k), default=None)
        got = lexicon.find(w)
        if w.startswith("réeux") and len(w) > 5:
            assert got == ("réeux*", 2.5, -1)
        else:
            assert got == (None if best is None else (best[2], -best[1], best[0])), w


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        text, toxic = prose(i, 40).split(), int(i % 5 == 2)
        if toxic:
            for k in (5, 15, 25):
                text[k] = ["wretch", "dimwit", "blockhead"][(i + k) % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    labels += [(None, 1), (3, None), (12, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark, labelled, hard, empty, crowded):
    docs, labels = labelled
    rows = toxicity.scored(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 40 and sum(r.predicted == int(r.doc_id % 5 == 2) for r in out) / len(out) > 0.97
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    score = toxicity.Matcher(model).features
    assert score("you blockhaed and dimwitt") != score("nothing at all") == score("") == [0.0] * len(toxicity.FEATURES)
    said, plain = score('she said “dimwit” to me'), score("what a dimwit this is")
    assert said[6] > 0 == said[0] and plain[0] > 0 == plain[6]
    assert toxicity.scored(empty, labels).count() == 0
    scored = toxicity.scored(crowded, labels).collect()
    assert len(scored) == hard.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in toxicity.scored(hard, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.predicted for r in toxicity.scored(hard, labels.limit(0)).collect()} == {0}


def simhash_model(rows, budget=2):
    prints = []
    for _, text, *_ in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted((str(rows[i][0]), f"{prints[i]:016x}", str(least[find(i)])) for i in range(len(rows)))


def test_simhash_matches_brute_force(hard, empty, crowded):
    for table in (hard, crowded):
        got = simhash.simhash_components(table).select("doc_id", simhash.hex_fingerprint(F.col("fp")), "component_id").collect()
        assert sorted((str(a), b, str(c)) for a, b, c in map(tuple, got)) == simhash_model(hard_rows())
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("chunk", [16, 100_000])
def test_dense_fingerprints_lose_no_link(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    random = np.random.Generator(np.random.PCG64(1))
    centres = random.integers(0, 1 << 63, 6, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in random.integers(0, 64, int(random.integers(0, 5)))) for c in centres for _ in range(60)}
    values = np.array(sorted(values), np.uint64).view(np.int64)
    nodes = spark.createDataFrame([(int(v), int(v), 0) for v in values], "node long, fp long, more long")
    found = simhash.components(simhash.links(nodes, simhash.exact_orders(2), 2)).collect()
    root = {r.node: r.root for r in found}
    got = [root.get(int(v), int(v)) for v in values]
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 2
    want = np.arange(len(values))
    for _ in range(len(values)):
        new = np.where(near, want[None, :], len(values)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert len(set(got)) == len(set(want.tolist())) == len(set(zip(got, want.tolist())))


def test_one_of_each_group_of_edited_copies_stays(spark, hard, empty):
    base = prose(7, 300).split()
    rows = [(i, " ".join(base[:10 * i] + ["edited"] + base[10 * i + 1:])) for i in range(1, 25)]
    rows += [(100 + i, prose(1000 + i, 200)) for i in range(30)] + [(1, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_per_component(table).collect()) == [1, *range(100, 130)]
    kept = copies.one_per_component(hard)
    assert kept.columns == hard.columns and 47 not in {r.doc_id for r in kept.collect()} and copies.one_per_component(empty).count() == 0


FIRST, SECOND = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"


def totals_of(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}


def test_token_totals_follow_every_batch(spark, hard, empty, tmp_path):
    rows = {r[0]: r for r in hard_rows() if r[0] is not None}
    docs = hard.where("doc_id IS NOT NULL")

    def want(state):
        sums = Counter()
        for (i, version), text in state.items():
            key = (rows[i][3], rows[i][2], version)
            sums[key, 0] += 1
            sums[key, 1] += token_counts._counter(f"/opt/tokenizers/{version}")([text or ""])[0]
            sums[key, 2] += len(text or "")
        return {k: (sums[k, 0], sums[k, 1], sums[k, 2]) for k, _ in list(sums)}

    rollup = token_counts.Rollup(spark, str(tmp_path / "store"))
    assert totals_of(rollup) == {}
    assert rollup.commit("load", token_counts.insertions(docs, FIRST))
    state = {(i, FIRST): r[1] for i, r in rows.items()}
    assert totals_of(rollup) == want(state)
    assert not rollup.commit("load", token_counts.insertions(docs, FIRST)) and totals_of(rollup) == want(state)
    assert rollup.commit("drop", token_counts.deletions(docs.where("doc_id < 9 OR doc_id = 45"), FIRST))
    state = {k: t for k, t in state.items() if not (k[0] < 9 or k[0] == 45)}
    assert totals_of(rollup) == want(state)
    some = docs.where("doc_id BETWEEN 5 AND 12")
    rollup.commit("recount", token_counts.deletions(some, FIRST).union(token_counts.insertions(some, SECOND)))
    state = {k: t for k, t in state.items() if not 5 <= k[0] <= 12} | {(i, SECOND): rows[i][1] for i in range(5, 13)}
    assert totals_of(rollup) == want(state)
    rollup.commit("none", token_counts.insertions(empty, FIRST))
    rollup.commit("again", token_counts.insertions(docs.where("doc_id = 3"), FIRST))
    state |= {(3, FIRST): rows[3][1]}
    # What a batch wrote before it failed is not read.
    (tmp_path / "store/deltas" / b"half".hex()).mkdir()
    assert totals_of(token_counts.Rollup(spark, str(tmp_path / "store"))) == want(state)


def test_token_counts_take_nulls(hard):
    row = hard.where("doc_id IS NULL").select(token_counts.token_count(F.col("text"), FIRST).alias("n")).collect()
    assert sorted(r.n for r in row)[0] == 0


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_minhash_follows_the_next_document(spark, hard, empty, crowded):
    rows = sorted({(r[0], r[1] or "") for r in hard_rows() if r[0] is not None})
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in minhash.edited_fingerprints(table).collect()}
    assert sorted(got) == [i for i, _ in rows]
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        edited = text[:len(text) - len(text) // 4] + following[:len(text) // 4]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, edited)) < 0.12 and abs(r.near_next - jaccard(text, following)) < 0.12
    assert len({got[i].fingerprint for i in (3, *range(47, 52))}) == 1
    assert minhash.edited_fingerprints(crowded).count() == hard.count()
    assert minhash.edited_fingerprints(empty).count() == 0
    one = minhash.edited_fingerprints(table.where("doc_id = 9")).first()
    assert one.near_next == 1.0


def test_likeness_is_unbiased():
    errors = []
    for i in range(60):
        words = prose(i, 400).split()
        other = words[:300 - 4 * i] + prose(i + 1000, 100 + 4 * i).split()
        a, b = " ".join(words), " ".join(other)
        errors.append(minhash.likeness_of(minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b))) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035
    few = [minhash.likeness_of(minhash.packed(minhash.minima(f"w{i}")), minhash.packed(minhash.minima(f"v{i}"))) for i in range(50)]
    assert max(few) < 0.1


def test_scores_match_counts(spark, hard, empty, crowded, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 3000)
    rows = hard_rows()
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [b"\n"]) for r in rows]
    training = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in tokens]
    words, pairs, starts = Counter(), Counter(), Counter()
    for (_, t), use in zip(tokens, training):
        if use:
            words.update(t)
            pairs.update(zip([None, *t[:-1]], t))
            starts.update([None, *t[:-1]])
    n, v = sum(words.values()), len(words)
    for table in (hard, crowded):
        got = sorted(((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.held_out) for r in lm.scores(table).collect()))
        assert got == sorted((str(i), len(t), sum(words[w] > 0 for w in t), round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), 6), not use)
                             for (i, t), use in zip(tokens, training))
    # The weights are what the driver learned; with them, the score is the formula.
    learned = {}
    whole = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda h, a, b: learned.setdefault("w", whole(h, a, b)))
    scored = lm.scores(hard).collect()
    assert {r.train_tokens for r in scored} == {n}
    w = learned["w"]
    assert np.allclose(w.sum(axis=1), 1) and w[0][2] == 0

    def log10(t):
        total = 0.0
        for before, word in zip([None, *t[:-1]], t):
            c = starts[before] if before is None else words[before]
            m = w[min(math.ceil(math.log2(c + 1)), lm.BUCKETS - 1)]
            total += math.log10(m[0] / (v + 1) + m[1] * words[word] / n + m[2] * pairs[before, word] / max(c, 1))
        return total

    assert sorted((str(r.doc_id), round(r.score, 6)) for r in scored) == sorted((str(i), round(log10(t), 6)) for i, t in tokens)
    assert lm.scores(empty).count() == 0
    alone = lm.scores(hard.where(lm.held_out(F.col("doc_id")))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 for r in alone)


def test_columns_of_civil_documents_stay(spark, hard):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    clashing = hard.select("*", *[F.lit(f"own {n}").alias(n) for n in ("score", "held_out", "predicted", "_score")])
    got = toxicity.civil_documents(clashing, labels).collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in ("score", "held_out", "predicted", "_score"))


def test_counts_of_listed_documents(spark, hard, tmp_path):
    """Recounting by a list of ids counts those documents and no others, null languages included."""
    from folio.llm.common import stage

    ids = stage(spark.createDataFrame([(i,) for i in (0, 2, 5, 40, 42, 46, 999)], "doc_id long"))
    got = token_counts.insertions(hard, FIRST, ids=ids).collect()
    want = [r for r in token_counts.insertions(hard, FIRST).collect() if r.doc_id in (0, 2, 5, 40, 42, 46)]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(r.lang is None for r in got)
