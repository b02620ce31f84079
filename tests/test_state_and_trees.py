"""State that outlives a stream's restart, folds in trees and roots of sets, against plain models."""

import hashlib
import random

from pyspark.sql import functions as F

from folio.functions.digests import merkle_roots
from folio.operators import environments as E
from folio.streaming import live as V

from .test_markup import frame, model


def test_strict_pairing_of_a_very_long_book(spark):
    """Pages far apart make blocks by the hundred, so the tree has three levels above them."""
    draw = random.Random(6)
    rows = []
    for n in range(400):
        parts = [draw.choice(["\\begin{lemma}", "\\end{lemma}", "\\begin{proof}", "\\end{proof}", "\\label{lemma:1.2}", "text "]) for _ in range(draw.randrange(0, 5))]
        rows.append((1, 1 + n * 3000, "".join(parts)))
    rows += [(2, 1, "\\begin{proof}"), (2, 900_000, "\\end{proof}\\end{proof}")]
    nodes, unmatched = E.pair_strict(frame(spark, rows))
    want, stray = model(rows, strict=True)
    got = {(r.book_id, r.id): ((r.end_page, r.end_offset) if r.end_page is not None else None, r.label) for r in nodes.collect()}
    assert got == {k: (v["end"], v["label"]) for k, v in want.items()} and len(got) > 100
    assert sorted((r.book_id, r.id, r.name, r.page, r.offset) for r in unmatched.collect()) == stray


def test_caps_are_reached_once_across_restarts(spark, tmp_path):
    """Eight repairs in three arrivals, with the query restarted in between; a later epoch counts anew."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "run_id string, task_id string, purpose string, repair boolean, seq bigint, repair_epoch bigint, ts timestamp"

    def send(*rows):
        table = spark.createDataFrame([(r, t, p, ok, n, e) for r, t, p, ok, n, e in rows], "run_id string, task_id string, purpose string, repair boolean, seq bigint, repair_epoch bigint")
        table.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60)).coalesce(1).write.mode("append").parquet(source)
        V.write_appends(V.repair_limits(spark.readStream.schema(schema).parquet(source), expire="2 hours"), out, checkpoint).awaitTermination()
        found = spark.read.parquet(out).collect()
        return sorted((r.run_id, r.task_id, r.repair_epoch, r.used, r.seq) for r in found)

    repair = lambda n, task="t", epoch=0, purpose="convert", ok=True: ("r", task, purpose, ok, n, epoch)
    assert send(*[repair(n) for n in range(5)], *[repair(n, "u", purpose="references") for n in range(6)], repair(3, None), repair(4, "v", ok=False)) == [("r", "u", 0, 6, 5)]
    reached = [("r", "t", 0, 8, 7), ("r", "u", 0, 6, 5)]
    assert send(*[repair(n) for n in range(5, 9)]) == reached
    assert send(*[repair(n) for n in range(9, 12)]) == reached
    # The new epoch starts at nothing; repairs of the old one no longer count.
    reached = sorted([*reached, ("r", "t", 1, 8, 20)])
    assert send(*[repair(n, epoch=1) for n in range(12, 16)], repair(16, epoch=0), *[repair(n, epoch=1) for n in range(17, 24)]) == reached
    # After two hours without a repair the task is forgotten, so seven more do not reach the cap of epoch 1 again.
    send(repair(900, "other"))
    assert send(*[repair(n, epoch=1) for n in range(901, 908)]) == reached
    assert send(repair(908, epoch=1)) == sorted([*reached, ("r", "t", 1, 8, 908)])


def test_roots_of_sets(spark):
    members = [("p", f"path {n}") for n in range(700)] + [("q", "only"), (None, "x")]
    table = spark.createDataFrame(members, "project_id string, path string").repartition(5)
    got = {r.project_id: (r.root, r.n) for r in merkle_roots(table, ["project_id"], F.col("path"), "root", "n").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def root(texts):
        nodes = [(digest(t), digest(t)) for t in texts]
        for digits in (6, 4, 2, 0):
            groups = {}
            for name, value in sorted(nodes):
                groups.setdefault(name[:digits], []).append(value)
            nodes = [(name, digest(f"{digits}:" + "".join(values))) for name, values in groups.items()]
        return nodes[0][1]

    assert got == {p: (root([t for o, t in members if o == p]), sum(o == p for o, _ in members)) for p in ("p", "q", None)}
    plan = merkle_roots(table, ["project_id"], F.col("path"), "root", "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
