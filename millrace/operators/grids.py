"""Tables inside documents: ARRAY<ARRAY<STRING>> to Markdown, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import BLANK, content_hash


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def normalise(rows: Column) -> Column:
    """Cells trimmed, null ones empty; rows padded to the widest."""
    clean = F.transform(F.coalesce(rows, F.expr("cast(array() as array<array<string>>)")), lambda r: F.transform(F.coalesce(r, F.expr("cast(array() as array<string>)")), lambda c: _strip(F.coalesce(c, F.lit("")))))
    return rectangular(clean)


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def rectangular(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width(rows) - F.size(r))))


def is_rectangular(rows: Column) -> Column:
    return F.forall(rows, lambda r: F.size(r) == width(rows))


def to_markdown(rows: Column, caption: Column | None = None) -> Column:
    """The first row is the header; pipes are escaped, line breaks become <br>. Empty tables give an empty text."""
    grid = normalise(rows)
    cell = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), r"\r?\n", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width(grid)), " | "), F.lit(" |"))
    body = F.array_join(F.concat(F.array(line(F.get(grid, F.lit(0))), rule), F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), line)), "\n")
    if caption is not None:
        body = F.when(F.coalesce(_strip(caption), F.lit("")) != "", F.concat(_strip(caption), F.lit("\n\n"), body)).otherwise(body)
    return F.when(F.size(grid) == 0, F.lit("")).otherwise(body)


def to_csv(rows: Column) -> Column:
    """Quoted where needed, each line ended by a line feed."""
    quote = lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    grid = normalise(rows)
    single = lambda r: (F.size(r) == 1) & (F.get(r, F.lit(0)) == "")
    line = lambda r: F.when(single(r), F.lit('""')).otherwise(F.array_join(F.transform(r, quote), ","))
    return F.when(F.size(grid) == 0, F.lit("")).otherwise(F.concat(F.array_join(F.transform(grid, line), "\n"), F.lit("\n")))


def to_json(rows: Column) -> Column:
    """Records by the header row; of equal headers the last wins, at the place of the first."""
    grid = normalise(rows)
    head = F.get(grid, F.lit(0))
    names = F.array_distinct(head)
    last = lambda n, r: F.get(F.reverse(F.filter(F.arrays_zip(head.alias("h"), r.alias("v")), lambda p: p["h"] == n)), F.lit(0))["v"]
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = lambda r: F.array_join(F.transform(names, lambda n: F.concat(quoted(n), F.lit(": "), quoted(last(n, r)))), ", ")
    records = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), lambda r: F.concat(F.lit("{"), pairs(r), F.lit("}")))
    return F.when(F.size(grid) < 2, F.lit("[]")).otherwise(F.concat(F.lit("["), F.array_join(records, ", "), F.lit("]")))


def shape(df: DataFrame, rows: str = "rows") -> DataFrame:
    """`df` with row_count, column_count (the widest row, 0 for none) and is_rectangular."""
    r = F.coalesce(F.col(rows), F.expr("cast(array() as array<array<string>>)"))
    return df.withColumn("row_count", F.size(r)).withColumn("column_count", width(r)).withColumn("is_rectangular", is_rectangular(r))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of type `table` from (document_id, source_uri, rows, caption, page_number, section_path), with their hash, splitter and own offsets."""
    chunks = tables.select(
        "document_id", "source_uri", to_markdown(F.col("rows"), F.col("caption")).alias("content"), F.lit("table").alias("chunk_type"), "page_number", F.col("page_number").alias("end_page_number"), "section_path",
        F.lit(True).alias("has_table"), F.create_map(F.lit("table_format"), F.lit("markdown")).alias("metadata"),
    )
    # fixed value: the splitter's name
    return chunks.withColumns({"content_hash": content_hash(F.col("content")), "splitter": F.lit("table_to_chunk"), "start_char": F.lit(0), "end_char": F.length("content")})
