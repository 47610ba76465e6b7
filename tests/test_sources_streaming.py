import json
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.operators import evals
from millrace.sources import parsers
from millrace.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path, paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>')


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    def pages(data):
        out = []
        def broken():
            raise OSError("page failed")

        for page in data.decode().split("\f"):
            out.append(broken if page == "BAD" else (page, 0, None) if page.startswith(" ") else lambda page=page: page)
        return {"title": "PDF", "author": ""}, out

    root = tmp_path_factory.mktemp("files")
    (root / "a.MD").write_text("# Guide\n\ntext\n## Part\nmore")
    (root / "empty.md").write_text(" \n")
    docx(root / "b.docx", [("H1", "Title"), ("", "one"), ("H2", "Sub"), ("", "two"), ("", "  ")])
    (root / "broken.docx").write_bytes(b"no zip")
    (root / "c.pdf").write_text("  first sheet \n\n of text \fsecond sheet\fBAD\f  ")
    (root / "scan.pdf").write_text("  ")
    (root / "x.exe").write_bytes(b"?")
    found = parsers.files(spark, str(root))
    return parsers.parse_results(parsers.read_files(found, {"pdf": pages})).withColumn("name", F.regexp_extract("source_uri", r"([^/]+)$", 1)).cache()


def test_statuses(results):
    rows = {r.name: r for r in results.collect()}
    assert {k: r.status for k, r in rows.items()} == {"a.MD": "succeeded", "empty.md": "succeeded", "b.docx": "succeeded", "broken.docx": "failed", "c.pdf": "partial", "scan.pdf": "failed", "x.exe": "failed"}
    assert rows["c.pdf"].content == "first sheet\nof text\n\nsecond sheet" and rows["c.pdf"].errors == ["page 3 of the pdf cannot be read: page failed"]
    assert rows["c.pdf"].metadata == {"title": "PDF", "page_count": "4", "parser": "PdfTextParser"} and rows["broken.docx"].metadata == {"parser": "DocxParser"}
    assert "OCR" in rows["scan.pdf"].errors[0] and rows["b.docx"].title == "Title" and rows["a.MD"].title == "Guide" and rows["b.docx"].metadata["paragraph_count"] == "4"


def test_chunks_of_each_type(results):
    assert [(r.page_number, r.chunk_index, r.chunk_count, r.content) for r in parsers.page_chunks(results.where("name = 'c.pdf'")).orderBy("page_number").collect()] == [(1, 0, 3, "first sheet\nof text"), (2, 1, 3, "second sheet")]
    assert [list(r.section_path) for r in parsers.paragraph_chunks(results).orderBy("chunk_index").collect()] == [["Title"], ["Title"], ["Title", "Sub"], ["Title", "Sub"]]
    assert [list(r.section_path) for r in parsers.section_chunks(results).orderBy("chunk_index").collect()] == [["Guide"], ["Guide", "Part"]]


def test_ocr_and_structured(spark):
    schema = "source_uri string, page_number int, text string, status string, confidence double, errors array<string>"
    scans = spark.createDataFrame([("u", 1, " scanned words ", "succeeded", 0.95, []), ("u", 2, None, "failed", None, ["too dark to read"]), ("v", 1, " ", "succeeded", 0.5, None)], schema)
    rows = {r.source_uri: r for r in parsers.ocr_results(scans).collect()}
    assert (rows["u"].status, rows["u"].errors, rows["u"].ocr_page_count, rows["u"].content) == ("partial", ["too dark to read"], 2, " scanned words ") and rows["v"].status == "succeeded"
    assert [(r.source_uri, r.chunk_index, r.chunk_count) for r in parsers.ocr_chunks(scans).orderBy("source_uri").collect()] == [("u", 0, 1), ("v", 0, 1)]
    md = spark.createDataFrame([("a", "# x", None), ("b", " ", None), ("c", None, "boom")], "source_uri string, markdown string, error string")
    assert {r.source_uri: (r.status, r.errors) for r in parsers.structured_chunks(md).collect()} == {"a": ("succeeded", []), "b": ("failed", ["the conversion gave no text"]), "c": ("failed", ["boom"])}


def test_uploads(spark):
    df = spark.createDataFrame([("demo.md", 5), ("demo.exe", 5), ("demo.md", 0), ("demo.md", 99), (" ", 5), ("dir/", 5)], "f string, n long")
    assert [r.x for r in df.select(parsers.reject_reason(F.col("f"), F.col("n"), 10).alias("x")).collect()] == [None, "file type is not supported", "file is empty", "file is too large", "filename is required", "filename is required"]


def test_cases_and_golden_data(spark, tmp_path):
    case = {"id": "c1", "query": "q", "relevant_chunk_ids": ["a"], "rankings": {"dense": ["x", "a"], "bm25": ["a"]}}
    (tmp_path / "cases.jsonl").write_text(json.dumps(case) + "\n\n")
    qrels, ranked = parsers.case_tables(parsers.read_jsonl(spark, str(tmp_path / "cases.jsonl"), parsers.RETRIEVAL_CASES))
    assert {(r.strategy, r.mrr) for r in evals.retrieval_metrics(qrels, ranked, ["strategy"]).collect()} == {("dense", 0.5), ("bm25", 1.0)}
    (tmp_path / "bad.jsonl").write_text('\n{"id": 1')
    with pytest.raises(Exception, match="Invalid JSON on line 2"):
        parsers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), parsers.GOLDEN_CASES).collect()
    gold = [{"id": str(i), "document_type": t, "parser": p, "expectation": {"requires_table": i == 0}} for i, (t, p) in enumerate([("pdf", "P"), ("pdf", "Q"), ("md", "M")])]
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, gold)))
    assert {r.key: r.cases for r in evals.golden_summary(parsers.read_jsonl(spark, str(tmp_path / "gold.jsonl"), parsers.GOLDEN_CASES)).collect()} == {
        "case_count": 3, "table_cases": 1, "type:pdf": 2, "type:md": 1, "parser:P": 1, "parser:Q": 1, "parser:M": 1,
    }


def test_cache(spark):
    files = spark.createDataFrame([("a", "v1"), ("b", "v1"), ("c", None)], "source_uri string, content_hash string")
    cache = spark.createDataFrame([("a", "v1", "succeeded"), ("b", "v0", "partial")], "source_uri string, content_hash string, status string")
    hits, todo = ingest.split_by_cache(files, cache)
    assert [r.source_uri for r in hits.collect()] == ["a"] and sorted(r.source_uri for r in todo.collect()) == ["b", "c"]
    new = spark.createDataFrame([("b", "v1", "succeeded"), ("a", "v2", "failed"), ("c", None, "succeeded")], cache.schema)
    assert sorted(map(tuple, ingest.cache_put(cache, new).collect())) == [("a", "v1", "succeeded"), ("b", "v1", "succeeded")]
    assert [r.source_uri for r in ingest.cache_invalidate(cache, files.where("source_uri = 'a'")).collect()] == ["b"]


def test_parse_many_and_state(spark):
    def parse(uri):
        if uri == "bad":
            raise RuntimeError("boom")
        return "partial" if uri == "half" else "succeeded"

    queue = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "half")], "queue_index int, source_uri string")
    events = ingest.parse_many(queue, parse, slots=2).cache()
    assert sorted((r.stage, r.status, r.message) for r in events.where("progress = 1").collect()) == [("failed", "failed", "boom"), ("succeeded", "partial", None), ("succeeded", "succeeded", None)]
    tasks = spark.createDataFrame([("task-0",), ("task-1",), ("task-9",)], "task_id string")
    assert {r.task_id: (r.status, r.events) for r in ingest.task_state(events, tasks).collect()} == {"task-0": ("succeeded", 3), "task-1": ("failed", 3), "task-9": ("queued", 0)}
    assert [r.stage for r in ingest.first_per_task(events).where("task_id = 'task-0'").orderBy("event_no").collect()] == ["queued", "started", "succeeded"]


def test_ingest_with_cache(spark):
    def parse(uri):
        if uri == "bad":
            raise RuntimeError("boom")
        return "succeeded"

    found = spark.createDataFrame([(0, "kept", "h1"), (1, "bad", "h2"), (2, "changed", "h4"), (3, "remote", None)], "queue_index int, source_uri string, content_hash string")
    cache = spark.createDataFrame([("kept", "h1", "partial", 7.0), ("changed", "h3", "succeeded", 8.0)], "source_uri string, content_hash string, status string, elapsed_ms double")
    done = ingest.ingest_many(found, cache, parse, slots=2)
    assert [(r.queue_index, r.status, r.cached, r.message) for r in done.results.orderBy("queue_index").collect()] == [(0, "partial", True, None), (1, "failed", False, "boom"), (2, "succeeded", False, None), (3, "succeeded", False, None)]
    stages = {}
    for r in sorted(done.events.collect(), key=lambda r: r.progress):
        stages.setdefault(r.task_id, []).append((r.stage, r.status))
    assert stages["task-0"] == [("queued", None), ("started", None), ("cache_hit", "partial")] and stages["task-1"][-1] == ("failed", "failed")
    assert sorted((r.source_uri, r.content_hash) for r in done.cache.collect()) == [("changed", "h4"), ("kept", "h1")]
    again = ingest.ingest_many(found, done.cache, parse, slots=2)
    assert {r.source_uri: r.cached for r in again.results.collect()} == {"kept": True, "bad": False, "changed": True, "remote": False}


def test_submitted_tasks_and_their_reports(spark):
    found = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "queue_index int, source_uri string")
    tasks, queued = ingest.submit(found)
    ids = [r.task_id for r in tasks.collect()]
    assert len(set(ids)) == 3 and ids == [r.task_id for r in ingest.submit(found)[0].collect()]
    assert {(r.status, r.stages) for r in ingest.task_reports(tasks, queued).collect()} == {("queued", "queued")}
    assert {(r.status, r.progress, r.stages) for r in ingest.task_reports(tasks, queued.limit(0)).collect()} == {("queued", 0.0, "")}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.md").write_text(f"# {i}")

    def parse(found):
        return parsers.parse_results(parsers.read_files(found)).select("source_uri", "status", "content").join(found.select("source_uri", "content_hash"), "source_uri")

    for run in range(2):  # the second run finds nothing new
        q = ingest.ingest_stream(ingest.stream_files(spark, str(tmp_path / "in"), 2), parse, str(tmp_path / "cache"), str(tmp_path / "ck"))
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "cache")).select("source_uri", "content_hash").distinct().count() == spark.read.parquet(str(tmp_path / "cache")).count() == 3
    events = spark.createDataFrame([("t", "queued", 0.0, "2024-01-01 00:00:00"), ("t", "started", 0.1, "2024-01-01 00:00:01"), ("u", "failed", 1.0, "2024-01-01 00:00:01")], "task_id string, stage string, progress double, created_at string")
    events.withColumn("created_at", F.col("created_at").cast("timestamp")).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("task_id string, stage string, progress double, created_at timestamp").parquet(str(tmp_path / "ev"))
    for more in ([], [("t", "succeeded", 1.0, "2024-01-01 00:00:05"), ("t", "started", 0.5, "2024-01-01 00:00:03")]):
        if more:
            spark.createDataFrame(more, events.schema).withColumn("created_at", F.col("created_at").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "ev"))
        ingest.stream_task_state(stream, str(tmp_path / "states"), str(tmp_path / "ck2")).awaitTermination(120)
        found = {(r.task_id, r.status, r.events) for r in ingest.read_task_state(spark, str(tmp_path / "states")).collect()}
        assert found == ({("t", "succeeded", 4), ("u", "failed", 1)} if more else {("t", "running", 2), ("u", "failed", 1)})
    assert ingest.stage_counts(spark.read.parquet(str(tmp_path / "ev"))).count() == 4
