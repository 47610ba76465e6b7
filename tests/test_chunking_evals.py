import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, evals, grids

# Fixed value: the text that the published chunk figures were measured on.
SAMPLE = """
# RAG Chunking

RAG retrieval quality depends on chunk quality. Good chunks keep enough context for
the model to understand definitions, constraints, and exceptions. Bad chunks may
separate a definition from the paragraph that explains it.

Parent-child chunking separates retrieval from generation. Child chunks are small and
focused, so vector search can match user intent more precisely. Parent chunks are
larger and preserve surrounding context for answer generation.

FastAPI exposes backend APIs. Observability records latency, token usage, and errors.
These concerns are related to production readiness but not always related to chunk
boundaries.
""".strip()


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, content string")


def metrics(chunks):
    return evals.chunk_quality(chunks.withColumn("source_uri", F.lit("x"))).first()


@pytest.mark.parametrize(
    "split,count,chars,p95,overlap",
    [
        (lambda d: chunking.recursive(d, 180, 30), 5, 147.2, 180.0, 0.115489),
        (lambda d: chunking.parent_child(d, 320, 40, 120, 20), 13, 122.0, 270.0, 0.588272),
        (lambda d: chunking.semantic(d, 220, 80, threshold=0.08), 7, 92.0, 148.0, 0.0),
    ],
)
def test_published_chunk_quality(spark, split, count, chars, p95, overlap):
    m = metrics(split(docs(spark, SAMPLE)))
    assert (m.chunk_count, m.avg_chars, m.p95_chars, m.overlap_ratio, m.context_complete_ratio) == (count, chars, p95, overlap, 1.0)


def test_recursive_windows_and_blanks(spark):
    rows = chunking.recursive(docs(spark, "x" * 25, "  \n ", None), 10, 0).orderBy("chunk_index").collect()
    assert [(r.start_char, r.end_char) for r in rows] == [(0, 10), (10, 20), (20, 25)] and {r.chunk_count for r in rows} == {3}
    paragraphs = ["First paragraph.", "Second paragraph.", "Third paragraph."]
    assert [r.content for r in chunking.recursive(docs(spark, "\n\n".join(paragraphs)), 25, 0).orderBy("chunk_index").collect()] == paragraphs
    with pytest.raises(ValueError):
        chunking.recursive(docs(spark, "x"), 10, 10)


def test_offsets_reproduce_contents(spark):
    text = "😀 Eins zwei drei. 四五六七。" * 40
    rows = chunking.parent_child(docs(spark, text), 200, 20, 60, 10).collect()
    assert all(text[r.start_char : r.end_char] == r.content for r in rows) and len({r.chunk_id for r in rows}) == len(rows)
    parents = {r.chunk_id: r for r in rows if r.chunk_role == "parent"}
    for r in rows:
        if r.chunk_role == "child":
            p = parents[r.parent_id]
            assert p.start_char <= r.start_char and r.end_char <= p.end_char


def test_semantic_groups(spark):
    assert [g[:2] for g in chunking.semantic_groups("x" * 35, 10, 5, 0)] == [(0, 10), (10, 20), (20, 30), (30, 35)]
    rows = chunking.semantic(docs(spark, "Cats sleep on mats. Cats sleep on beds. Stock prices fell sharply."), 120, 20, threshold=0.2).orderBy("ordinal").collect()
    assert [r.content for r in rows] == ["Cats sleep on mats.\nCats sleep on beds.", "Stock prices fell sharply."]


def test_markdown_sections(spark):
    text = "intro\n# Product Guide\nx\n## Install\nSteps\n### Windows\nRun\n#### \nnot a heading\n# Next\n### Deep\n## Up"
    rows = chunking.markdown_sections(docs(spark, text, "", None)).orderBy("chunk_index").collect()
    assert [list(r.section_path) for r in rows] == [[], ["Product Guide"], ["Product Guide", "Install"], ["Product Guide", "Install", "Windows"], ["Next"], ["Next", "Deep"], ["Next", "Up"]]
    assert rows[1].content == "# Product Guide\nx" and {r.chunk_count for r in rows} == {7}


def test_fixed_and_adjacent(spark):
    assert [(r.start_char, r.end_char) for r in chunking.fixed(docs(spark, "abcdefg", ""), 3).orderBy("chunk_index").collect()] == [(0, 3), (3, 6), (6, 7)]
    assert chunking.adjacent_similarity(docs(spark, "a b. a b.")).first().similarity == 1.0


def test_retrieval_metrics(spark):
    qrels = spark.createDataFrame([("case-1", "a"), ("case-1", "b"), ("case-2", "c")], "case_id string, chunk_id string")
    ranks = [("case-1", c, i) for i, c in enumerate(("x", "a", "y"), 1)] + [("case-2", c, i) for i, c in enumerate(("1", "2", "3", "4", "5", "c"), 1)]
    m = evals.retrieval_metrics(qrels, spark.createDataFrame(ranks, "case_id string, chunk_id string, rank int")).first()
    assert (m.recall_at_5, m.recall_at_10, m.cases) == (0.25, 0.75, 2) and m.mrr == pytest.approx((1 / 2 + 1 / 6) / 2, abs=1e-6)
    assert [r.case_id for r in evals.missing_cases(qrels, spark.createDataFrame(ranks[:3], "case_id string, chunk_id string, rank int")).collect()] == ["case-2"]


def test_overlap_and_empty_quality(spark):
    schema = "chunk_id string, document_id string, source_uri string, content string, content_hash string, token_count int, start_char int, end_char int, splitter string"
    rows = [("1", "d", "u", "x" * 10, "h", 2, 0, 10, "s"), ("2", "d", "u", "x" * 10, None, 2, 5, 15, "s")]
    m = evals.chunk_quality(spark.createDataFrame(rows, schema)).first()
    assert (m.overlap_ratio, m.context_complete_ratio) == (0.25, 0.5)
    empty = evals.chunk_quality(spark.createDataFrame([], schema)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_index_model(spark):
    rows = {r.profile: r for r in evals.estimate_index(evals.index_profiles(spark)).collect()}
    assert {k: (r.recall, r.p95_ms, r.memory_mb, r.build_cost, r.filter_penalty_ms, r.recommendation) for k, r in rows.items()} == {
        "low_latency": (0.984, 11.703, 53.406, 38.4, 0.0, ""),
        "balanced": (0.995, 16.178, 201.416, 102.4, 0.0, "default"),
        "high_recall": (0.995, 21.938, 207.52, 409.6, 0.0, ""),
        "filtered_without_payload_index": (0.995, 68.428, 201.416, 102.4, 52.25, ""),
    }
    lines = evals.markdown_report(evals.estimate_index(evals.index_profiles(spark)).select("profile", "recall"), {"recall": 3})
    assert lines.first().line.startswith("| low_latency | 0.984")


def grid(spark, rows, caption=None):
    return spark.createDataFrame([(rows, caption)], "rows array<array<string>>, caption string")


def test_grids(spark):
    g = grid(spark, [["Name", "Value"], ["A|B", "line1\nline2"]], " Cap ")
    assert g.select(grids.to_markdown(F.col("rows"), F.col("caption")).alias("x")).first().x == "Cap\n\n| Name | Value |\n| --- | --- |\n| A\\|B | line1<br>line2 |"
    assert grid(spark, [["A", "B"], ["1"]]).select(grids.to_csv(F.col("rows")).alias("x")).first().x == "A,B\n1,\n"
    assert grid(spark, [["name", "value", "name"], ["a", 'q"', "b"]]).select(grids.to_json(F.col("rows")).alias("x")).first().x == '[{"name": "b", "value": "q\\""}]'
    for empty in ([], None):
        row = grid(spark, empty).select(grids.to_markdown(F.col("rows")).alias("m"), grids.to_csv(F.col("rows")).alias("c"), grids.to_json(F.col("rows")).alias("j")).first()
        assert tuple(row) == ("", "", "[]")
    shape = grids.shape(grid(spark, [["a"], ["b", None]])).first()
    assert (shape.row_count, shape.column_count, shape.is_rectangular) == (2, 2, False)


def test_latency_and_long_metrics(spark):
    ev = spark.createDataFrame([(t, s, f"2024-01-01 00:00:0{n}") for t, s, n in (("a", "queued", 0), ("a", "done", 2), ("b", "queued", 1), ("b", "done", 2), ("c", "queued", 1))], "t string, s string, at string")
    m = evals.latency_percentiles(ev.withColumn("at", F.col("at").cast("timestamp")), "t", "s", "at", "queued", ("done",)).first()
    assert (m.tasks, m.p50_ms, m.p95_ms, m.throughput) == (2, 1000.0, 2000.0, 1.0)
    assert evals.long_metrics(spark.createDataFrame([(1, 2.0)], "a int, b double")).count() == 2
