from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import chunking, evals
from millrace.plans import sql
from millrace.session import durable, shared_folder

TEXTS = ["Straße 5: the well-known it's 检索", "", None, "It\\s a \x1c 'quoted' back\\slash  "]


def test_functions_in_sql_are_those_of_the_library(spark):
    sql.register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    df.createOrReplaceTempView("texts")
    a = spark.sql("select token_count(t) as n, token_fits(t, 4) as f, search_terms(t) as s, term_set(t) as w, content_hash(t) as h, jaccard(term_set(t), array('the', 'ss')) as j from texts").collect()
    t = F.col("t")
    b = df.select(text.token_count(t), text.fits(t, 4), text.search_terms(t), text.term_set(t), text.content_hash(t), text.jaccard(text.term_set(t), F.array(F.lit("the"), F.lit("ss")))).collect()
    assert [tuple(x) for x in a] == [tuple(x) for x in b]
    assert spark.sql("select sigmoid(-1000D) as a, sigmoid(0D) as b, reciprocal_rank(1, 60) as c, strip_blanks(' \u3000x ') as d").first() == (0.0, 0.5, 1 / 61, "x")


def test_splitting_in_sql(spark):
    sql.register(spark)
    body = "One sentence. Another one! " * 40
    rows = spark.sql(f"select * from split_recursive('{body}', 100, 20)").collect()
    assert [[r.start_char, r.end_char] for r in rows] == chunking.recursive_spans(body, 100, 20) and all(body[r.start_char : r.end_char] == r.content for r in rows)
    assert spark.sql("select * from split_recursive(null, 100, 20)").count() == 0


def test_most_tasks_at_once(spark):
    steps = [("a", "go", 1), ("b", "go", 2), ("a", "end", 4), ("c", "go", 4), ("b", "end", 9), ("c", "end", 5), ("d", "go", 3), ("e", "end", 3)]
    events = spark.createDataFrame(steps, "task string, stage string, at int")
    row = evals.concurrency(events, "task", "stage", "at", "go", ("end",)).first()
    assert (row.most_at_once, row.tasks) == (2, 3)


def test_written_tables_have_a_shared_folder(spark):
    folder = shared_folder(spark, "some-table")
    spark.range(3).write.mode("overwrite").parquet(folder)
    assert spark.read.parquet(folder).count() == 3 and durable(spark.range(2)).count() == 2
