"""The Merkle manifest, hard negatives and passage attention against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import merkle, mining, passages

from .conftest import DOCUMENTS, hard_rows


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def _climb(levels, at, digest, seen):
    for nodes in levels[:-1]:
        run = nodes[at // 8 * 8:at // 8 * 8 + 8]
        seen += run[:at % 8] + run[at % 8 + 1:]
        run[at % 8] = digest
        digest, at = _h(*run), at // 8
    return digest


def _model(rows):
    """Rows as the contract says, one after the other."""
    groups = {}
    for r in rows:
        doc_id, text, lang, source, n_chars = r
        leaf = _leaf((doc_id, source, lang, n_chars, text))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(lang, []).append((doc_id, leaf, _leaf((doc_id, source, lang, n_chars, low if hit else text))))
    key = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    langs = sorted(groups, key=key)
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (key(r[0]), r[1]))
        trees[g] = _up([r[1] for r in groups[g]])
    top = _up([trees[g][-1][0] for g in langs])
    out = []
    for n, g in enumerate(langs):
        for at, (doc_id, leaf, other) in enumerate(groups[g]):
            seen = []
            folded = _climb(top, n, _climb(trees[g], at, other, seen), seen)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], _h(*seen), folded, folded == top[-1][0]))
    return out


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


def test_constants_and_blocks_are_those_of_sha_256():
    digests = np.array([list(hashlib.sha256(bytes([i])).digest()) for i in range(19)], np.uint8)
    made = merkle.parents_of(digests)
    texts = [bytes(d).hex() for d in digests]
    assert [bytes(d).hex() for d in made.digest] == [_h(*texts[i:i + 8]) for i in (0, 8, 16)]
    got = merkle.resumed(made, np.array([0, 1, 2]), np.array([7, 3, 0]), digests[[9, 9, 9]])
    for parent, slot, digest in zip((0, 1, 2), (7, 3, 0), got):
        run = texts[8 * parent:8 * parent + 8]
        run[slot] = texts[9]
        assert bytes(digest).hex() == _h(*run)


@pytest.mark.parametrize("rows", [
    hard_rows(),
    hard_rows()[:1],
    [(i, f"Text {i}", f"l{i % 11:02d}", None, i) for i in range(300)],
    [(i, f"Text {i}", "en", "s", i) for i in range(9000)]], ids=["hard", "one", "many groups", "two cells"])
def test_manifest_equals_a_sequential_tree(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    got = merkle.audited(docs.withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(1))).collect()
    assert _sorted(got) == _sorted(_model(rows))
    if len(rows) > 1:
        assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_nothing(empty):
    assert merkle.audited(empty).collect() == []


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def _vectors(n=900, width=6):
    random = np.random.Generator(np.random.PCG64(5))
    rows = []
    for i in range(n):
        v = random.normal(0, 0.3, width).astype("f4").tolist()
        rows.append((i, v, int(random.integers(0, 4))))
    same = rows[1][1]
    # A third of all rows is one vector, so most scores are ties.
    rows += [(n + i, same, i % 4) for i in range(n // 2)]
    rows += [(5000, None, 1), (5001, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (5002, [float("nan")] * 6, 2), (5003, [float("inf")] * 6, 2),
             (5004, same, None), (5100, same, 2), (5200, [0.0] * 6, 9), (5300, [], 1), (5400, [0.5], 1), (None, same, 1), (5005, same[:3], 1)]
    return rows


def _brute(rows, positives=5, negatives=5):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v] + [0] * (6 - len(v))))
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(va, vb)), b, lb) for b, lb, vb in kept))
        for s, p, _ in [r for r in scores if r[2] == la and r[1] != a][:positives]:
            found = [(n, ns) for ns, n, ln in scores if ln != la and -80 * s <= -100 * ns <= -100 * s][:negatives]
            out += [(a, p, k + 1, n, -s, -ns) for k, (n, ns) in enumerate(found)]
    return out


def _mined(table, **options):
    rows = mining.usable(table)
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0, **options)


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    rows = _vectors()
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = sorted(_brute(rows))
    assert len(want) > 100
    assert sorted(map(tuple, _mined(table.withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))).collect())) == want
    # Several blocks, other codebooks: the same rows.
    monkeypatch.setattr(mining, "ROW_BLOCK", 300)
    monkeypatch.setattr(mining, "ANCHOR_BLOCK", 6)
    assert sorted(map(tuple, _mined(table, words=3, sample_rows=50).collect())) == want


def test_cells_come_in_the_order_of_their_bounds_and_search_stops_early():
    random = np.random.Generator(np.random.PCG64(1))
    centres = random.normal(0, 100, (8, 16))
    v = np.floor(np.repeat(centres, 500, axis=0) + random.normal(0, 2, (4000, 16))).astype(np.int64)
    books = mining.Codebooks(mining._means(v[::9, :8].astype(float), 8), mining._means(v[::9, 8:].astype(float), 8))
    index = mining.Index(np.arange(4000), np.repeat(np.arange(8) % 2, 500), v, books)
    seen, after = 0, np.inf
    for ranges, bound in index.walk(v[0]):
        assert bound <= after
        assert not ranges or (index.scored(v[0], ranges)[1] <= after).all()
        after, seen = bound, seen + sum(b - a for a, b in ranges)
    assert seen == 4000
    scored = []
    index.scored, plain = lambda q, r: (scored.append(sum(b - a for a, b in r)), plain(q, r))[1], index.scored
    ids, scores = index.positives(0, 0, v[0], 5)
    assert sum(scored) < 2500
    order = sorted(((-int(s), i) for i, s in enumerate(v @ v[0]) if i != 0 and (i // 500) % 2 == 0))[:5]
    assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == order


def test_large_components_are_exact():
    v = np.array([[3 * 10 ** 8, 1], [3 * 10 ** 8, 2], [1, 1]], np.int64)
    index = mining.Index(np.arange(3), np.zeros(3, np.int64), v, mining.Codebooks(np.zeros((1, 1)), np.zeros((1, 1))))
    assert index.positives(2, 0, np.array([3 * 10 ** 8, 1]), 2)[1].tolist() == [9 * 10 ** 16 + 2, 9 * 10 ** 16 + 1]


def test_mining_of_nothing(spark):
    assert _mined(spark.createDataFrame([], VECTORS)).collect() == []
    assert _mined(spark.createDataFrame([(100, [1.0], 1), (101, None, 1)], VECTORS)).collect() == []


def test_passage_numbers():
    text = "one two three one two three " + "Word " * 70 + "\nABC abc12 |"
    x = passages.encoded(text)
    assert x.shape == (2, passages.NUMBERS)
    words = text.split()
    part = words[64:]
    assert x[1, 1] == pytest.approx(1 / len(part))
    assert x[1, 11] == pytest.approx(len(set(part)) / len(part))
    assert x[0, 12] == pytest.approx(sum(a == b for a, b in zip(words[:63], words[1:64])) / 64)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    assert x[0, 13] == pytest.approx(sum(r in runs[:i] for i, r in enumerate(runs[:64])) / 64)
    assert (passages.encoded("") == 0).all() and passages.encoded(" \n").shape == (1, passages.NUMBERS)
    assert passages.encoded("😀 \ud800").shape == (1, passages.NUMBERS)


def test_gradient_is_that_of_the_loss():
    random = np.random.Generator(np.random.PCG64(3))
    sizes = np.array([1, 4, 2, 3])
    starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(4), sizes)
    x, y = random.normal(0, 1, (10, 5)), np.array([0, 1, 1, 0.0])
    shapes = {"W": (5, 4), "b": (4,), "V": (4, 3), "G": (4, 3), "u": (3,), "c": (4,), "d": ()}
    w = {k: np.array(random.normal(0, 0.5, s)) for k, s in shapes.items()}

    def loss():
        p = passages._forward(w, x, starts, bag).p
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + passages.DECAY / 2 * sum((w[k] ** 2).sum() for k in w if k not in "bd")

    got = passages._gradient(w, x, starts, bag, y)
    for k, g in got.items():
        flat = w[k].reshape(-1)
        for i in range(flat.size):
            keep, step = flat[i], 1e-5
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert (up - down) / (2 * step) == pytest.approx(np.asarray(g).reshape(-1)[i], abs=1e-7)


def test_attention_finds_the_bad_passage():
    """Bags of good passages, some with one bad one among them: only the weighting can tell."""
    random = np.random.Generator(np.random.PCG64(8))
    sizes = random.integers(2, 9, 600)
    y = random.integers(0, 2, 600).astype(float)
    bags = []
    for n, good in zip(sizes, y):
        bag = random.normal(0, 0.3, (n, 4))
        if not good:
            bag[random.integers(0, n), 0] = 3
        bags.append(bag)
    model = passages.trained(np.concatenate(bags), sizes, y)
    x = (np.concatenate(bags) - model.mean) / model.spread
    f = passages._forward(model.weights, x, np.cumsum(sizes) - sizes, np.repeat(np.arange(600), sizes))
    assert ((f.p >= 0.5) == (y == 1)).mean() > 0.97
    bad = np.concatenate([b[:, 0] > 2 for b in bags])
    assert (f.a * np.repeat(sizes, sizes))[bad].mean() > 1.5


def test_quality_of_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = passages.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 50
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in out)


def test_quality_of_hard_rows(spark, hard, crowded, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (40, 1)], "doc_id long, quality int")
    out = passages.scored(crowded, labels).collect()
    assert len(out) == hard.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    by_text = {}
    for r in out:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert set(crowded.columns) - {"score", "held_out"} <= set(out[0].asDict())
    # Columns that the documents bring stay theirs.
    assert {r["score"] for r in passages.good_documents(crowded, labels, least=0.0).collect()} == {"score"}
    assert passages.scored(empty, labels).collect() == []
    one_class = passages.scored(hard, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one_class} == {1.0}
    assert {r["score"] for r in passages.scored(hard, labels.limit(0)).collect()} == {0.0}
