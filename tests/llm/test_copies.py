"""Near copies against brute force over all pairs."""

from collections import Counter

import numpy as np
import pytest

from folio.llm import copies

from .conftest import hard_rows, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_model(rows):
    sets, parent = [shingles(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (n, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), n), n)
    return sorted({n for i, (n, *_) in enumerate(rows) if least[find(i)] == n})


def edited(seed, words, edits, end):
    """A text of which `edits` words, far from each other and after the start, are others; or its end is."""
    out = prose(seed, words).split()
    for i in range(edits):
        out[10 + i * (words // (edits + 1))] = f"edit{seed}x{i}"
    return " ".join(out[:words - end] + prose(seed + 5000, end).split())


def corpus():
    rows = []
    for s in range(20):
        rows += [(s * 100, edited(s, 300, 0, 0)), (s * 100 + 1, edited(s, 300, 4 + s % 14, 0)), (s * 100 + 2, edited(s, 300, 0, 20 + 4 * s))]
    # A chain: each one near the next, the ends not near each other.
    rows += [(5000 + i, " ".join(prose(77, 400).split()[20 * i:20 * i + 250])) for i in range(6)]
    return rows + [(6000 + i, t) for i, t in enumerate(["a b c d", "A  b c d", "a b c e", "", None, " \n"])]


@pytest.mark.parametrize("per_member", [8, 0])
def test_only_links_of_the_similarity_join(spark, monkeypatch, per_member):
    monkeypatch.setattr(copies, "PAIRS_PER_MEMBER", per_member)
    rows = corpus()
    sims = Counter()
    sets = [shingles(t) for _, t in rows]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a | b:
                sims[int(10 * len(a & b) / len(a | b))] += 1
    assert sims[6] > 5 and sims[7] > 5 and sims[8] > 5
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_per_component(table).collect()) == kept_model(rows)


def test_hard_rows_match_brute_force(spark, hard):
    rows = [r for r in hard_rows() if r[0] is not None]
    got = copies.one_per_component(hard.where("doc_id IS NOT NULL")).collect()
    assert sorted({r.doc_id for r in got}) == kept_model(rows)


def test_texts_of_a_template_are_no_candidates(spark, monkeypatch):
    """Families whose texts share 100 of 120 words: similar to 0.6 or so, never linked, and hardly ever compared."""
    compared, similar = [], copies.similar
    monkeypatch.setattr(copies, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    for size in (50, 100, 200):
        compared.clear()
        rows = [(i, prose(31, 100) + " " + " ".join(f"own{i}x{k}" for k in range(20))) for i in range(size)]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert copies.one_per_component(table).count() == size
        assert sum(compared) <= size


def test_sizes_of_prefixes_are_exact():
    for n in range(1, 400):
        # The least overlap of a set of n with any similar set.
        least = next(k for k in range(n + 1) if 10 * k >= 8 * n)
        assert copies.prefix_length(n, 0.8) == n - least + 1


def test_repeated_ids_and_other_columns(spark):
    """A copy under an id that another row also has goes; rows equal in id and text leave the same one on every run."""
    base = prose(1, 80)
    rows = [(1, base, "b"), (1, base, "a"), (2, base, "c"), (2, prose(2, 80), "d"), (3, prose(3, 80), "e"), (3, base + " more", "f"), (None, prose(3, 80), "g"), (None, prose(4, 80), "h")]
    table = spark.createDataFrame(rows, "doc_id long, text string, other string").repartition(4)
    want = sorted([rows[1], rows[3], rows[4], rows[7]], key=repr)
    assert sorted(map(tuple, copies.one_per_component(table).collect()), key=repr) == want


def test_links_come_from_the_trie_first(spark, monkeypatch):
    """Copies with one word changed are linked by their fingerprints; the buckets have nothing left to compare."""
    compared, similar = [], copies.similar
    monkeypatch.setattr(copies, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    rows = [(s * 10 + i, edited(s, 400, 0, 0) + f" end{i}") for s in range(6) for i in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_per_component(table).collect()) == kept_model(rows)
    assert compared[0] >= 10 and sum(compared[1:]) <= 4


def test_parities_never_part_similar_sets():
    rows = [np.unique(copies.shingle_set(t)) for _, t in corpus() if t]
    for i, a in enumerate(rows):
        for b in rows[:i]:
            unlike = len(np.setxor1d(a, b))
            assert int(np.bitwise_count((copies.parities(a) ^ copies.parities(b)).view(np.uint64)).sum()) <= unlike


def test_last_round_compares_no_pairs_that_parities_part(spark, monkeypatch):
    """Texts that share all first shingles but not enough of the rest, as where the sketch sees no rarity."""
    compared, similar = [], copies.similar
    monkeypatch.setattr(copies, "similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    monkeypatch.setattr(copies, "rarity", lambda texts, shingle: np.zeros(1 << copies.COUNTER_BITS, np.int64))
    for size in (30, 60):
        compared.clear()
        rows = [(i, prose(31, 120) + " " + " ".join(f"own{i}x{k}" for k in range(60))) for i in range(size)]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        assert copies.one_per_component(table).count() == size
        assert compared[-1] <= size


def test_buckets_of_the_same_members_are_one(spark):
    """Three near copies share scores of first shingles, by all or by two; each set of members meets once, in its first bucket."""
    rows = [(i, prose(31, 400) + " " + end) for i, end in enumerate(["one two three four five six", "one two three four five seven", "other words at the end of it"])]
    nodes = copies._nodes(copies._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), 5, 0.8)
    held = {r.node: list(r.prefix) for r in nodes.collect()}
    shared = {}
    for node, prefix in held.items():
        for at, x in enumerate(prefix):
            shared.setdefault(x, {})[node] = at
    first = {}
    for x, members in shared.items():
        if len(members) > 1:
            kept = first.setdefault(frozenset(members), members)
            if sum(members.values()) < sum(kept.values()):
                first[frozenset(members)] = members
    assert sum(len(m) > 1 for m in shared.values()) > 20 > 3 >= len(first)
    got = {}
    for r in copies._buckets(nodes).collect():
        got.setdefault(r.shingle, {})[r.node] = r.pos
    assert sorted(map(sorted, (m.items() for m in got.values()))) == sorted(sorted(m.items()) for m in first.values())


def test_only_texts_of_pairs_are_read_for_a_comparison(spark, monkeypatch):
    wanted, filter_of = [], copies.filter_of
    monkeypatch.setattr(copies, "filter_of", lambda keys: wanted.append(sorted(r[0] for r in keys.collect())) or filter_of(keys))
    texts = spark.createDataFrame([(i, prose(i // 2, 50)) for i in range(40)], "node long, text string")
    found = copies.similar(spark.createDataFrame([(0, 1), (2, 5)], "u long, v long"), texts, 5, 0.8)
    assert [tuple(r) for r in found.collect()] == [(0, 1)] and wanted == [[0, 2], [1, 5]]
