import pytest
from pyspark.sql import functions as F

from millrace.functions import text, validation
from millrace.operators import evals, vectors

CHUNK = "chunk_id string, document_id string, source_uri string, content string, page_number int, end_page_number int, chunk_index int, chunk_count int, token_count int, start_char int, end_char int, chunk_type string, chunk_role string"


def test_faults_of_chunks(spark):
    good = ("c", "d", "u", "", 2, 3, 0, 1, 0, 0, 0, None, None)
    bad = ("", None, "u", None, 3, 2, -1, 0, None, 9, 4, "tablet", "child")
    rows = spark.createDataFrame([good, bad], CHUNK)
    fine, put_aside = validation.quarantine(rows, validation.chunk_faults())
    assert [r.chunk_id for r in fine.collect()] == ["c"] and fine.columns == rows.columns
    assert put_aside.first().faults == [
        "chunk_id is missing", "document_id is missing", "content is missing", "chunk_index is below 0", "chunk_count is below 1", "end_page_number is before page_number", "end_char is before start_char", "chunk_type is unknown",
    ]
    assert validation.quarantine(rows.limit(0), validation.chunk_faults())[1].count() == 0


def test_faults_of_queries(spark):
    rows = [("a", "words", [1.0] * 4, 3), ("b", " \u3000", [1.0], 0), (None, "é!", None, None)]
    df = spark.createDataFrame(rows, "query_id string, query string, embedding array<float>, top_k int").withColumn("f", validation.query_faults(4))
    assert {r.query_id: r.f for r in df.collect()} == {
        "a": [], "b": ["query is blank", "embedding has not 4 values", "top_k is not above 0"],
        None: ["query_id is missing", "query has no searchable term", "embedding is missing", "top_k is not above 0"],
    }


def test_payloads_have_defaults_and_faults(spark):
    whole = '{"chunk_id": "c", "document_id": "d", "content": "", "source_uri": "u", "page_number": "7", "metadata": {"a": "b"}}'
    rows = [(whole,), (None,), ("no json",), ('{"chunk_id": "c", "token_count": "many"}',)]
    found = validation.from_payload(spark.createDataFrame(rows, "payload string")).collect()
    assert (found[0].faults, found[0].page_number, found[0].chunk_type, found[0].chunk_role, found[0].has_table, found[0].section_path, found[0].metadata) == ([], 7, "text", "standalone", False, [], {"a": "b"})
    assert found[1].faults == ["there is no payload"] and found[2].faults == ["payload is no JSON"]
    assert found[3].faults == ["document_id is missing", "content is missing", "source_uri is missing", "token_count is no number"]


def test_external_tokenizers(spark):
    encode, decode = lambda t: [ord(c) for c in t], lambda ids: "".join(map(chr, ids))
    df = spark.createDataFrame([("abcd",), ("ab",), (None,)], "t string")
    rows = df.select(text.external_truncate(F.col("t"), encode, decode, 3).alias("s"), text.external_fits(F.col("t"), lambda ts: [len(encode(t)) for t in ts], 3).alias("f")).collect()
    assert [(r.s, r.f) for r in rows] == [("abc", False), ("ab", True), (None, True)]
    with pytest.raises(ValueError):
        text.external_fits(F.col("t"), len, -1)


def test_model_output_of_several_shapes():
    assert vectors.embedding_rows({"dense_vecs": [[1, 2]]}) == vectors.embedding_rows({"embeddings": [(1, 2)]}) == vectors.embedding_rows([[1, 2]]) == [[1, 2]]
    with pytest.raises(ValueError):
        vectors.embedding_rows({"other": []})


def test_index_profiles_are_checked(spark):
    bad = spark.createDataFrame([("p", 0, 64, 64, False, True)], evals.index_profiles(spark).schema)
    with pytest.raises(Exception, match="m is not above 0"):
        evals.estimate_index(bad).collect()
    lines = evals.markdown_report(evals.index_profiles(spark).select("profile", "m"), {"m": 1}, header=True).orderBy("line_no").collect()
    assert [r.line for r in lines[:3]] == ["| profile | m |", "| --- | ---: |", "| balanced | 16.0 |"] and len(lines) == 6


def test_retrieval_cases_are_checked(spark):
    schema = "id string, relevant_chunk_ids array<string>, rankings map<string, array<string>>"
    good = [("a", ["x"], {"one": ["x", "y"], "two": []}), ("b", ["y"], {"one": [], "two": ["y"]})]
    assert evals.checked_cases(spark.createDataFrame(good, schema)).count() == 2
    for row, said in [(("a", ["x"], {"one": [], "two": []}), "case twice"), ((" ", ["x"], {"one": [], "two": []}), "without id"), (("c", [], {"one": [], "two": []}), "without relevant"), (("c", ["x"], {"one": ["x", "x"], "two": []}), "chunk twice"), (("c", ["x"], {"one": []}), "other strategies")]:
        with pytest.raises(Exception, match=said):
            evals.checked_cases(spark.createDataFrame([*good, row], schema)).collect()


def test_missing_rankings_are_errors_if_strict(spark):
    qrels = spark.createDataFrame([("a", "x"), ("b", "y")], "case_id string, chunk_id string")
    ranked = spark.createDataFrame([("a", "x", 1), ("b", "z", 1)], "case_id string, chunk_id string, rank int")
    row = evals.retrieval_metrics(qrels, ranked, strict=True).first()
    assert (row.recall_at_5, row.cases) == (0.5, 2)
    with pytest.raises(Exception, match="cases without ranking: b"):
        evals.retrieval_metrics(qrels, ranked.where("case_id = 'a'"), strict=True).collect()
    with pytest.raises(Exception, match="there are no cases"):
        evals.retrieval_metrics(qrels.limit(0), ranked, strict=True).collect()
