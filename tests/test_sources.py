import hashlib
import json

from pyspark.sql import functions as F

from folio.sources import readers as RD
from folio.sources import sinks as SK
from folio.streaming import live as V


def test_catalog_and_inventory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.pdf").write_bytes(b"one")
    book = {"id": "a", "title": "A", "path": "src/a.pdf", "sha256": hashlib.sha256(b"one").hexdigest(), "page_count": 3}
    (tmp_path / "books.json").write_text(json.dumps({"schema_version": "1", "books": [book, {**book, "id": "b", "path": "src/b.pdf"}]}, indent=1))
    books = RD.read_catalog(spark, str(tmp_path / "books.json"))
    files = RD.file_inventory(spark, str(tmp_path / "src"))
    assert [(r.id, r.page_count) for r in books.collect()] == [("a", 3), ("b", 3)] and files.first().size_bytes == 3
    assert [r.id for r in RD.catalog_mismatches(books, files).collect()] == ["b"]


def test_batches_and_receipts(spark, tmp_path):
    batch = {"task_id": "batch-0001", "pages": [{"page": 4, "tex": "x"}, {"page": 5, "tex": "y"}], "headings": [{"id": "h", "page": 4, "level": "section", "number": "1", "title": "T"}],
             "assets": [{"id": "f", "page": 5, "bbox": [0, 0, 1, 1]}], "head": "closed", "tail": "math"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.json").write_text(json.dumps(batch))
    found = RD.read_batches(spark, str(tmp_path / "b"))
    assert [r.page for r in RD.batch_pages(found).collect()] == [4, 5] and RD.batch_headings(found).first().title == "T" and RD.batch_assets(found).first().bbox == [0.0, 0.0, 1.0, 1.0]
    for call, name, text in (("c1", "request.json", json.dumps({"prompt": json.dumps({"repair_feedback": {"candidate": {"a": 1}, "code": "X", "error": "m"}})})), ("c2", "request.json", "plain prompt"), ("c3", "repair.json", json.dumps({"feedback": {"candidate": None}}))):
        (tmp_path / "r" / call).mkdir(parents=True)
        (tmp_path / "r" / call / name).write_text(text)
    receipts = RD.read_receipts(spark, str(tmp_path / "r"))
    assert receipts.count() == 3 and receipts.filter("value IS NULL").first().call_id == "c2"
    assert [(r.call_id, r.code, r.message) for r in RD.receipt_feedback(receipts).collect()] == [("c1", "X", "m")]


def test_journal_skips_broken_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"method":"item/started","data":{}}\n{"method":"other"}\n{"method":"turn/comp')
    assert [r.method for r in RD.read_events(spark, str(tmp_path / "e.jsonl")).collect()] == ["item/started"]


def test_project_bodies(spark):
    bodies = spark.createDataFrame([(1, "\\input{a}\n\\input{s/b}\r\n"), (2, "\\input{a}\ntext"), (3, "\\input{../a}\n")], "project_id int, content string")
    files = spark.createDataFrame([(1, "a.tex", "A"), (1, "s/b.tex", "B")], "project_id int, path string, content string")
    parts, bad = RD.read_project_body(bodies, files)
    assert sorted((r.project_id, r.ord, r.content) for r in parts.collect()) == [(1, 0, "A"), (1, 1, "B"), (2, 0, "\\input{a}\ntext")]
    assert [(r.project_id, r.path) for r in bad.collect()] == [(3, "../a.tex")]


def test_bodies_split_as_they_were_rendered(spark, tmp_path):
    pages = spark.createDataFrame([(1, 4, "a\nb"), (1, 7, ""), (1, 9, "c")], "book_id bigint, page bigint, tex string")
    headings = spark.createDataFrame([(1, 7, "h", "section", "1", "T")], "book_id bigint, page bigint, id string, level string, number string, title string")
    rendered = SK.render_pages(pages, headings)
    SK.write_body(rendered, str(tmp_path / "body"))
    parts = sorted((tmp_path / "body" / "book_id=1").glob("part-*"))
    body = "".join(p.read_text() for p in parts)
    assert body == '% PDF page 4\na\nb\n% PDF page 7\n% BA source {"type":"headings","id":"h","page":7,"level":"section","number":"1","title":"T"}\n\n% PDF page 9\nc\n'
    split = RD.split_pages(spark.createDataFrame([(1, body)], "book_id bigint, body string"))
    assert [(r.page, r.line) for r in split.orderBy("ord").collect()] == [(4, 1), (7, 4), (9, 7)]
    assert [(r.page, r.line) for r in RD.rendered_lines(rendered).orderBy("page").collect()] == [(4, 2), (7, 6), (9, 8)]


def test_verdicts_leave_registered_keys_aside(spark):
    warn = "LaTeX Warning: Reference `{}' on page 1 undefined on input line 3."
    logs = [("a", warn.format("lem\nma:1") + "\nLaTeX Warning: There were undefined references.", 0), ("b", warn.format("lemma:2"), 0), ("c", "fine", 0), ("d", "body.tex:12: Bad thing\r\n", 1), ("e", "Label(s) may have changed", 0)]
    df = spark.createDataFrame(logs, "run_id string, log string, exit_code int")
    reviews = spark.createDataFrame([("a", "lemma:1"), ("b", "lemma:1")], "run_id string, key string")
    got = {r.run_id: (r.code, r.deferred) for r in RD.compile_verdict(df, reviews).collect()}
    assert got == {"a": (None, ["lemma:1"]), "b": ("REFERENCE_ERROR", []), "c": (None, []), "d": ("TEX_ERROR", []), "e": ("REFERENCE_ERROR", [])}
    assert [(r.run_id, r.line, r.message) for r in RD.log_errors(df).collect()] == [("d", 12, "Bad thing")]


def test_counter_declarations(spark):
    rules = spark.createDataFrame([(1, "lemma", "", "claim", "arabic", False, 1), (1, "equation", "section", "", "roman", True, 2)],
                                  "book_id bigint, name string, reset_by string, shared_with string, style string, prefix_parent boolean, ord int")
    setups = spark.createDataFrame([(1, "article")], "book_id bigint, documentclass string")
    lines = [r.line for r in SK.counter_preamble(rules, setups).orderBy("ord").collect()]
    assert lines[:6] == ["\\newtheorem{theorem}{Theorem}", "\\newtheorem*{theorem*}{Theorem}", "\\newtheorem{claim}[theorem]{Claim}", "\\newtheorem*{claim*}{Claim}", "\\newtheorem{lemma}[claim]{Lemma}", "\\newtheorem*{lemma*}{Lemma}"]
    assert lines[18:] == ["\\counterwithout*{equation}{part}", "\\counterwithout*{equation}{section}", "\\counterwithout*{equation}{subsection}", "\\counterwithin*{equation}{section}", "\\renewcommand{\\theequation}{\\thesection.\\roman{equation}}"]


def test_streams_restart_where_they_stopped(spark, tmp_path):
    schema = "event_id bigint, ts timestamp"
    write = lambda name, rows: spark.createDataFrame(rows, "event_id bigint, t string").select("event_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    run = lambda: V.write_appends(V.live_journal(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), ["event_id"]), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    write("a", [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")])
    run()
    # A repeat within the delay is dropped; a row behind the watermark is late.
    write("b", [(2, "2024-01-01 00:03:00"), (3, "2024-01-01 01:00:00"), (4, "2023-12-31 00:00:00")])
    run()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]
