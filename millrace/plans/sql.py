"""The engine in SQL: functions and views for `spark.sql`.

Functions are SQL functions over built-in ones, so the optimiser inlines them and filters on them are pushed like any
other; only the splitters, whose cuts follow from one another, are table functions in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from millrace.functions import text
from millrace.operators import chunking
from millrace.session import ship_package

_TOKEN, _TERM, _BLANK = (p.replace("\\", "\\\\").replace("'", "\\'") for p in (text.TOKEN, text.SEARCH_TERM, text.BLANK))

#: Name and parameters, result type, body.
FUNCTIONS = (
    ("token_count(t STRING)", "INT", f"regexp_count(t, '{_TOKEN}')"),
    ("token_fits(t STRING, most INT)", "BOOLEAN", f"regexp_count(t, '{_TOKEN}') <= most"),
    ("search_terms(t STRING)", "ARRAY<STRING>", f"transform(regexp_extract_all(t, '({_TERM})', 1), x -> lower(x))"),
    ("term_set(t STRING)", "ARRAY<STRING>", f"array_distinct(transform(regexp_extract_all(t, '({_TOKEN})', 1), x -> replace(lower(x), 'ß', 'ss')))"),
    ("jaccard(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("content_hash(t STRING)", "STRING", "sha2(cast(t AS BINARY), 256)"),
    ("strip_blanks(t STRING)", "STRING", f"regexp_replace(t, '^[{_BLANK}]+|[{_BLANK}]+$', '')"),
    ("sigmoid(x DOUBLE)", "DOUBLE", "CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END"),
    ("reciprocal_rank(place INT, k INT)", "DOUBLE", "1D / (k + place)"),
)


@udtf(returnType="chunk_index int, start_char int, end_char int, content string")
class SplitRecursive:
    """The chunks of a text, as `chunking.recursive` cuts them: text, size, overlap."""

    def eval(self, content: str, size: int, overlap: int):
        for i, (start, end) in enumerate(chunking.recursive_spans(content, size, overlap) if content else ()):
            yield i, start, end, content[start:end]


def register(spark: SparkSession, data: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """Makes the functions known to the session and, with `data`, a view of each of the tables there."""
    ship_package(spark)
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("split_recursive", SplitRecursive)
    for name in tables:
        spark.read.parquet(f"{data}/{name}.parquet").createOrReplaceTempView(name)
