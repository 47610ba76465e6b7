import pytest
from pyspark.sql import functions as F

from millrace.functions import filters, text



def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("value,count", [("cold, grey harbour?", 5), ("旧港口 map", 4), ("", 0), ("a　b\x1cc", 3), ("state-of-the_art it's", 2), (None, None)])
def test_token_count(spark, value, count):
    assert one(spark, value, text.token_count(F.col("t"))) == count


def test_truncate_and_fits(spark):
    assert one(spark, "cold, grey harbour?", text.truncate(F.col("t"), 3)) == "cold, grey"
    assert one(spark, "hello", text.truncate(F.col("t"), 3)) == "hello"
    assert one(spark, "hello", text.truncate(F.col("t"), 0)) == ""
    assert one(spark, "cold, grey harbour?", text.fits(F.col("t"), 5)) is True
    assert one(spark, "word " * 3000, F.length(text.truncate(F.col("t"), 1500))) == 1500 * 5 - 1
    with pytest.raises(ValueError):
        text.fits(F.col("t"), -1)


def test_budget(spark):
    assert text.available_input_tokens(8192, 1024, 512, 256) == 6400
    assert spark.range(1).select(text.allocate_per_chunk(6400, F.lit(8)).alias("x")).first().x == 800
    with pytest.raises(ValueError):
        text.available_input_tokens(100, 100)


def test_ids_and_hashes(spark):
    assert one(spark, "chunk-1", text.point_id(F.col("t"))) == "43ecbe12-c355-5c67-afcc-150df92f8680"
    assert one(spark, "", text.content_hash(F.col("t"))) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_terms_units_offsets(spark):
    assert one(spark, "Été BM25_x 检索", text.search_terms(F.col("t"))) == ["t", "bm25_x", "检", "索"]
    assert one(spark, "One. Two!\n\nThree", text.sentence_units(F.col("t"))) == ["One.", "Two!", "Three"]
    assert one(spark, "a 检b", text.token_offsets(F.col("t"))) == [[0, 1], [2, 3], [3, 4]]
    assert one(spark, "a b c", text.jaccard(text.term_set(F.col("t")), F.array(F.lit("b"), F.lit("d")))) == 0.25
    assert one(spark, "", text.jaccard(text.term_set(F.col("t")), text.term_set(F.col("t")))) == 0.0
    assert one(spark, "xyz", text.external_token_count(F.col("t"), lambda ts: [len(t) for t in ts])) == 3


def test_page_filter_contains_ranges(spark):
    df = spark.createDataFrame([("a", 2, 4), ("b", 3, None), ("c", 4, 5), ("d", None, None)], "chunk_id string, page_number int, end_page_number int")
    kept = df.where(filters.predicate(df, filters.Filter.metadata(page_number=3)))
    assert sorted(r.chunk_id for r in kept.collect()) == ["a", "b"]
    pages = spark.createDataFrame([("k", 3)], "k string, page_number int")
    joined = filters.containing_pages(df.withColumn("k", F.lit("k")), pages, on="k")
    assert sorted(r.chunk_id for r in joined.collect()) == ["a", "b"]


def test_typed_and_text_filters(spark):
    df = spark.createDataFrame([("a", 3, True, None), ("b", 4, False, "x")], "id string, page_number int, has_table boolean, tenant_id string")
    ids = lambda p: [r.id for r in df.where(p).collect()]
    spec = filters.Filter.exact
    assert ids(filters.predicate(df, filters.Filter())) == ["a", "b"]
    assert ids(filters.predicate(df, spec(page_number="3"))) == [] and ids(filters.text_predicate(df, {"page_number": "3"})) == ["a"]
    assert ids(filters.predicate(df, spec(page_number=3.0))) == ["a"] and ids(filters.predicate(df, spec(has_table=1))) == ["a"]
    assert ids(filters.predicate(df, spec(has_table=True))) == ["a"] and ids(filters.text_predicate(df, {"has_table": "False"})) == ["b"]
    assert ids(filters.text_predicate(df, {"tenant_id": "None"})) == ["a"] and ids(filters.predicate(df, spec(unknown="x"))) == []
    assert ids(filters.text_predicate(df, {"unknown": "None"})) == ["a", "b"]
    assert ids(filters.predicate(df, filters.Filter((filters.Condition("tenant_id", "lte", 3),)))) == []
    with pytest.raises(ValueError):
        filters.Condition("a", "neq", 1)
