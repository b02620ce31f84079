"""The stages of the pipeline on a small corpus with planted cases."""

import json

import corpus_pipeline
from folio.llm import queries

from .conftest import prose


def test_pipeline_catches_planted_cases(spark, tmp_path):
    item = prose(700, 40)
    rows = [(i, prose(i, 150), "en", f"s{i % 3}", 900) for i in range(120)]
    labels = [(i, int(i % 4 == 1), 1) for i in range(120)]
    rows = [(i, t + " wretch dimwit blockhead wretch" if i % 4 == 1 else t, *rest) for i, t, *rest in rows]
    rows += [(200, rows[0][1], "en", "s0", 900), (201, rows[0][1].replace(" ", "  ", 3), "en", "s1", 900), (202, prose(9000, 60) + " " + item, "en", "s2", 700),
             (203, "what a wretch and dimwit and blockhead " + prose(9001, 30), "en", "s0", 300), (204, None, None, None, None), (205, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = {}
    for name, step in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps[name] = {r.doc_id for r in docs.collect()}
    clean = {i for i in range(120) if i % 4 != 1}
    assert steps["toxicity"] == clean | {200, 201, 202, 204, 205}
    # The empty and the missing text are copies of each other.
    assert steps["near_duplicates"] == clean | {202, 204}
    assert steps["decontamination"] == clean | {204}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= clean | {204} and {r.shard for r in out} <= set(range(24))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "shards"]


def test_each_query_is_registered_once():
    names = sorted(queries.QUERIES)
    assert len(names) == 13 and {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.SQL) <= set(names) and json.dumps(queries.SQL)
