"""Chat formatting, line dedup, decontamination, mixture and shards."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import chat, decontaminate, hilbert, lines, mixture

from .conftest import hard_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_chat_reads_back_what_was_written(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "\\", "\\\\<s>\\", "<\\s>", "<|end|<|end|>>", "[[INST]]", "a\nb", "", "😀", "$1 \\Q \\E"]
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "system", None), (2, 0, "system", None), (2, None, None, "first"), (2, 5, "<|says|>", "odd role"), (None, 1, "assistant", "no id")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.formatted(table)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"),
                                            chat.learned_text(F.col("segments")).alias("learned")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3]) for r in rows[:len(nasty)]]
    assert got[1].learned == "".join(r[3] for r in rows[:len(nasty)] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("", "first"), ("system", ""), ("system", ""), ("<|says|>", "odd role")]
    assert [(t.role, t.text) for t in got[None].turns] == [("assistant", "no id")]
    for r in got.values():
        assert "".join(s.chunk for s in r.segments) == r.formatted
        body = "".join(s.chunk for s in r.segments if s.learned)
        assert not any(c in body for c in chat.Template().controls)
    assert chat.formatted(table.limit(0)).count() == 0


def test_chat_merges_neighbours_only(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")]
    text = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first().formatted
    assert text == "<|turn|>user<|says|>a<|also|>b<|end|><|turn|>assistant<|says|>c<|end|><|turn|>user<|says|>d<|end|>"


def test_templates_with_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat.Template(turn="ab", says="ba")


def spread_model(rows, least):
    bare = lambda x: x.strip(" \t\r\x0b\x0c")
    sites = defaultdict(set)
    for _, text, _, source, _ in rows:
        for line in (text or "").split("\n"):
            if bare(line):
                sites[bare(line)].add(source)
    gone = {k for k, v in sites.items() if len(v) >= least}
    return sorted((str(i), len(p := (t or "").split("\n")), sum(bare(x) in gone for x in p), "\n".join(x for x in p if bare(x) not in gone))
                  for i, t, *_ in rows)


@pytest.mark.parametrize("least", [1, 3, 5, 40])
def test_lines_on_many_sites_go(spark, least):
    common, rare = "This line stands on very many sites.", "This one stands on four of them only."
    rows = [(i, "\n".join([prose(i, 8), common if i % 2 else "  " + common, rare if i < 4 else prose(i + 100, 9), "short", "tab\t" if i % 2 else "\ttab\r", ""]), "en", f"s{i}" if i else None, 0)
            for i in range(50)]
    rows += [(99, None, None, None, None), rows[1], (None, common, "en", "s1", 1), (100, common, "en", "s1", 1), (101, "\n" + rare, "en", "s1", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = lines.without_boilerplate(table, least).select("doc_id", "lines", "removed", "kept_text").collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in map(tuple, got)) == spread_model(rows, least)


def test_lines_of_hard_tables(hard, empty, crowded):
    assert lines.without_boilerplate(empty).count() == 0
    assert lines.without_boilerplate(crowded).count() == hard.count()


def test_substituted_benchmark_passages_are_found(spark, hard, empty, crowded):
    items = [(1, prose(900, 40)), (2, prose(901, 16)), (3, "too short"), (4, None), (5, ""), (1, prose(900, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    long_item, short_item = items[0][1].split(), items[1][1].split()

    def changed(words, step):
        return " ".join("other" if i % step == step - 1 else w for i, w in enumerate(words))

    rows = [(1, prose(1, 30) + " " + changed(long_item, 6) + " " + prose(2, 30)), (2, changed(short_item, 7).upper() + "!"), (3, prose(3, 200)),
            (4, " ".join(long_item[10:26]) + " " + prose(4, 50)), (5, changed(long_item, 2)), (6, " ".join(long_item[:7]) + " " + prose(6, 40)),
            (7, None), (None, items[0][1]), (1, prose(1, 30) + " " + changed(long_item, 6) + " " + prose(2, 30))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(table, bench).collect()}
    assert found == {(1, 1), (2, 2), (4, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontaminate.clean_documents(table, bench).collect()) == [3, 5, 6, 7]
    assert decontaminate.contaminations(empty, bench).count() == 0
    assert decontaminate.contaminations(hard, bench.limit(0)).count() == 0
    assert decontaminate.clean_documents(crowded, bench).columns == crowded.columns


def test_benchmark_blocks_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, prose(i, 30)) for i in range(8)], "item_id long, text string")
    table = spark.createDataFrame([(i, prose(i + 50, 20) + " " + prose(i, 30)) for i in range(12)], "doc_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminations(table, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert sorted(map(tuple, decontaminate.contaminations(table, bench).collect())) == whole and len(whole) == 8


def mixture_model(rows, weights=(5, 2, 1), cap=3.0):
    """The budgets, by sharing the excess out again until none is left, and the mix, by sorting the hashes."""
    size = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    totals = Counter()
    for r, n in zip(rows, size):
        totals[r[3]] += n
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(totals.values())
    while True:
        rest = total - sum(cap * totals[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: cap * totals[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if target[s] > cap * totals[s] + 1e-9}
        if not over:
            break
        full |= over
    taken = {}
    for s in names:
        key = lambda i: int(hashlib.md5(f"0:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()[:15], 16)
        mine = sorted((i for i in range(len(rows)) if rows[i][3] == s), key=key)
        times = int(target[s] // totals[s]) if totals[s] else 0
        need, best, run, i = target[s] - times * totals[s], 0, 0, 0
        cuts = [(0, 0)]
        while i < len(mine):
            j = i
            while j < len(mine) and key(mine[j]) == key(mine[i]):
                run += size[mine[j]]
                j += 1
            cuts.append((run, j))
            i = j
        if need > 0:
            best = min(cuts, key=lambda c: (abs(c[0] - need), c[1]))[1]
        for n, i in enumerate(mine):
            taken[i] = size[i] * (times + (n < best))
    return sorted((str(rows[i][0]), size[i], totals[rows[i][3]], round(target[rows[i][3]], 6), taken[i]) for i in range(len(rows)))


def test_mixture_matches_sorting(hard, crowded):
    for table in (hard, crowded):
        got = mixture.mix(table).select("doc_id", "size", "source_size", "target", "taken").collect()
        assert sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in map(tuple, got)) == mixture_model(hard_rows())


def test_mixture_repeats_documents(hard, empty):
    per = {(r.doc_id, r.text): r.copies for r in mixture.mix(hard).select("doc_id", "text", "copies").distinct().collect()}
    times = Counter((r.doc_id, r.text) for r in hard.collect())
    got = Counter((r.doc_id, r.text) for r in mixture.mixed_documents(hard).collect())
    assert got == Counter({k: per[k] * n for k, n in times.items() if per[k]})
    assert mixture.mix(empty).count() == 0


def test_mixture_with_one_source_and_without_words(spark):
    rows = [(i, "a b c", None) for i in range(10)]
    assert {r.taken for r in mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()} == {3}
    blank = mixture.mix(spark.createDataFrame([(1, "", "x"), (2, None, "y")], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


def test_hilbert_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2), (1, 4)):
        cells = spark.range(1 << (n * bits)).select(*[((F.col("id") / (1 << (bits * i))).cast("long") % (1 << bits)).alias(f"c{i}") for i in range(n)])
        rows = cells.withColumn("h", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (n * bits)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_shards_are_even_and_gapless(hard, empty, crowded):
    total = hard.count()
    for table, shards in ((hard, 7), (crowded, 24), (hard, 100)):
        rows = hilbert.shard(table, shards).collect()
        assert len(rows) == total
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
        sizes = [len(slots[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1
        ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    assert hilbert.shard(empty, 5).count() == 0


def test_clustered_shards_equal_a_plain_sort(hard, empty, spark):
    rows = hilbert.clustered(hard.withColumn("_id", F.lit("x")), 7).collect()
    assert len(rows) == hard.count() and set(rows[0].asDict()) == {*hard.columns, "_id", "curve", "shard"}
    hashes = {r.text: r.h for r in hard.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    key = lambda r: (r.curve, r.doc_id is not None, r.doc_id or 0, hashes[r.text])
    ordered = sorted(rows, key=key)
    base, wide = divmod(len(rows), 7)
    ends = [n * base + min(n, wide) for n in range(1, 7)]
    want, at = [], 0
    for i, r in enumerate(ordered):
        # A border between equal rows moves behind them.
        while at < 6 and i >= ends[at] and key(r) != key(ordered[ends[at] - 1]):
            at += 1
        want.append(at)
    assert [r.shard for r in ordered] == want
    assert hilbert.clustered(empty, 7).count() == 0 and {r.shard for r in hilbert.clustered(hard.limit(3), 7).collect()} <= set(range(7))


def test_columns_of_the_mix_stay(hard, crowded):
    """Input columns with names of results are those of the input afterwards, as often as without them."""
    names = ["size", "target", "copies", "source_size", "taken", "_row", "_copy"]
    clashing = hard.select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    got = mixture.mixed_documents(clashing).collect()
    assert got and all(r[n] == f"own {n}" for r in got for n in names)
    plain = Counter(tuple(r) for r in mixture.mixed_documents(hard).collect())
    assert Counter(tuple(r)[:5] for r in got) == plain
