"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encode, fuse, level, markup, mix, neardup, neighbours, scan, split, topn
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def p8_ids(spark: SparkSession, data: str) -> DataFrame:
    return encode.encode_texts(table(spark, data, "documents", "doc_id", "text"))


@query("""
with best as (select query_id, retriever, chunk_id, max(score) as score from hits
              where score is not null and not isnan(score) and query_id is not null and retriever is not null and chunk_id is not null
              group by query_id, retriever, chunk_id)
select query_id, retriever, chunk_id from best
qualify row_number() over (partition by query_id, retriever order by score desc, chunk_id) <= 5
""")
def p3_found(spark: SparkSession, data: str) -> DataFrame:
    hits = table(spark, data, "hits", "query_id", "retriever", "chunk_id", "score")
    return topn.top_n(hits, ["query_id", "retriever"], "chunk_id", "score", 5).select("query_id", "retriever", "chunk_id")


@query("""
with best as (select query_id, retriever, chunk_id, max(score) as score from hits
              where score is not null and not isnan(score) and query_id is not null and retriever is not null and chunk_id is not null
              group by query_id, retriever, chunk_id)
select query_id, retriever, chunk_id, score, cast(row_number() over (partition by query_id, retriever order by score desc, chunk_id) as int) as rank from best
qualify rank <= 10
""")
def p3_top10(spark: SparkSession, data: str) -> DataFrame:
    hits = table(spark, data, "hits", "query_id", "retriever", "chunk_id", "score")
    return topn.top_n(hits, ["query_id", "retriever"], "chunk_id", "score", 10)


_CUTS = r"""
with recursive d as (select distinct document_id, content from source_docs where len(content) > 1000),
c as (select document_id, content, 0 as start, 0 as stop, 0 as no from d
  union all
  select document_id, content, begin as start, begin + case when len(content) - begin <= 1000 then len(content) - begin when a > 100 then a when b > 100 then b when s > 100 then s when e > 100 then e else 1000 end as stop, no + 1 as no
  from (select *, len(regexp_extract(w, '(?s)^.*\n\n')) as a, len(regexp_extract(w, '(?s)^.*\n')) as b, len(regexp_extract(w, '(?s)^.*(?:[.!?] |[。！？])')) as s, len(regexp_extract(w, '(?s)^.* ')) as e
        from (select *, substring(content, begin + 1, 1000) as w from (select *, greatest(stop - 100, 0) as begin from c where stop < len(content)))))
"""


@query(f"{_CUTS} select distinct document_id, cast(start as int) as start_char, cast(stop as int) as end_char from c where no > 0")
def p4_found(spark: SparkSession, data: str) -> DataFrame:
    return split.split_oversized(table(spark, data, "source_docs", "document_id", "content"), with_text=False)


@query(f"""{_CUTS} select document_id, cast(no - 1 as int) as piece_index, cast(start as int) as start_char, cast(stop as int) as end_char, substring(content, start + 1, stop - start) as content,
cast(len(regexp_extract_all(substring(content, start + 1, stop - start), '[一-鿿]|[A-Za-z0-9]+(?:[-_''][A-Za-z0-9]+)*|[^\\s]')) as int) as token_count from c where no > 0""")
def p4_pieces(spark: SparkSession, data: str) -> DataFrame:
    return split.split_oversized(table(spark, data, "source_docs", "document_id", "content"))


_POINTS = """
with best as (select query_id as q, retriever as r, chunk_id as c, max(score) as x from hits semi join fusion_queries using (query_id)
              where retriever in ('dense', 'bm25', 'cross_encoder') and score is not null and not isnan(score) and chunk_id is not null group by 1, 2, 3),
p as (select q, r, quantile_disc(x, 0.25) as a, quantile_disc(x, 0.75) as b, min(x) as least, max(x) as most from best group by 1, 2),
f as (select q, r, case when b > a then greatest(least, a - 3 * (b - a)) else least end as low, case when b > a then least(most, b + 3 * (b - a)) else most end as high from p),
d as (select q, r, c, case when high > low then least(greatest(x, low), high) - low else 1.0 end as x from best join f using (q, r)),
axes as (select q, r, sqrt(count(*)) as weight, sqrt(sum(x * x)) as norm, sqrt(count(*)) * max(x) / sqrt(sum(x * x)) as ideal from d group by 1, 2),
every as (select q, c, r, weight, norm, ideal from (select distinct q, c from d) join axes using (q)),
v as (select q, c, ideal, coalesce(weight * (x / norm), 0) as v from every left join d using (q, r, c)),
s as (select q, c, sqrt(sum(v * v)) as gone, sqrt(sum((ideal - v) * (ideal - v))) as near from v group by 1, 2)
"""


@query(f"""{_POINTS} select q as query_id, c as chunk_id from s qualify row_number() over (partition by q order by round(gone / (gone + near), 9) desc, c) <= 3""")
def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return _fused(spark, data).select("query_id", "chunk_id")


@query(f"""{_POINTS} select q as query_id, c as chunk_id, round(gone / (gone + near), 6) as closeness, cast(row_number() over (partition by q order by round(gone / (gone + near), 9) desc, c) as int) as position from s qualify position <= 3""")
def p5_ranking(spark: SparkSession, data: str) -> DataFrame:
    """The same with closeness and position."""
    return _fused(spark, data).select("query_id", "chunk_id", F.round("closeness", 6).alias("closeness"), "position")


def _fused(spark: SparkSession, data: str) -> DataFrame:
    wanted = table(spark, data, "fusion_queries", "query_id").distinct()
    hits = table(spark, data, "hits", "query_id", "retriever", "chunk_id", "score").join(wanted, "query_id", "left_semi")
    return fuse.ideal_point_ranking(hits, {"dense": 1.0, "bm25": 1.0, "cross_encoder": 1.0}, top=3)


@query()
def p2_found(spark: SparkSession, data: str) -> DataFrame:
    vectors = table(spark, data, "vectors", "chunk_id", "embedding")
    probes = vectors.join(table(spark, data, "knn_probes", "chunk_id").distinct(), "chunk_id", "left_semi")
    near = neighbours.nearest(probes, vectors, k=10)
    return near.select(F.least("query", "neighbour").alias("chunk_id_a"), F.greatest("query", "neighbour").alias("chunk_id_b")).distinct()


@query()
def p2_knn(spark: SparkSession, data: str) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    vectors = table(spark, data, "vectors", "chunk_id", "embedding")
    asked = vectors.where(F.try_to_number(F.regexp_extract("chunk_id", r"(\d+)$", 1), F.lit("999999999999")) % 100 == 0)
    return neighbours.nearest(asked, vectors, k=10)


@query()
def p9_found(spark: SparkSession, data: str) -> DataFrame:
    return mix.short_sources(table(spark, data, "documents", "doc_id", "text", "lang", "source"), table(spark, data, "mix_targets"))


@query()
def p9_mixture(spark: SparkSession, data: str) -> DataFrame:
    return mix.mixture(table(spark, data, "documents", "doc_id", "text", "lang", "source"), table(spark, data, "mix_targets"))


@query()
def p9_shares(spark: SparkSession, data: str) -> DataFrame:
    return mix.mixture_shares(table(spark, data, "documents", "doc_id", "text", "lang", "source"), table(spark, data, "mix_targets"))


@query()
def p10_found(spark: SparkSession, data: str) -> DataFrame:
    """A document without any word has nothing that is hard to read: band 1."""
    documents = table(spark, data, "documents", "doc_id", "text", "lang", "n_chars")
    levels = level.reading_levels(documents, table(spark, data, "level_labels"))
    long = documents.where("n_chars >= 200").select("doc_id")
    return levels.join(long, "doc_id", "left_semi").select("doc_id", F.coalesce("band", F.lit(1)).alias("band"))


@query()
def p10_profile(spark: SparkSession, data: str) -> DataFrame:
    """Documents by language and band; documents without words have null for both."""
    levels = level.reading_levels(table(spark, data, "documents", "doc_id", "text", "lang"), table(spark, data, "level_labels"))
    return levels.groupBy("lang", "band").agg(F.count("*").alias("documents"), F.round(F.avg("level"), 6).alias("level"))


@query("""
with w as (select distinct chunk_id, content, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+|[一-鿿]'), lambda x: lower(x)) as w from chunks where chunk_id is not null),
t as (select row_number() over () as t, chunk_id, w from w where len(w) >= 30),
s as (select t, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as s from t),
n as (select t, count(*) as n from s group by 1),
p as (select a.t as a, b.t as b, count(*) as shared from s a join s b on a.s = b.s and a.t < b.t group by 1, 2),
k as (select a, b from p join n x on a = x.t join n y on b = y.t where shared >= 0.7 * (x.n + y.n - shared) - 1e-9)
select distinct least(x.chunk_id, y.chunk_id) as chunk_id_a, greatest(x.chunk_id, y.chunk_id) as chunk_id_b from k join t x on a = x.t join t y on b = y.t where x.chunk_id <> y.chunk_id
""")
def p7_found(spark: SparkSession, data: str) -> DataFrame:
    pairs = neardup.near_pairs(table(spark, data, "chunks", "chunk_id", "content"), threshold=0.7, expanded=None)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


@query("""
with recursive w as (select distinct chunk_id, list_transform(regexp_extract_all(content, '[A-Za-z0-9_]+|[一-鿿]'), lambda x: lower(x)) as w from chunks where chunk_id is not null),
t as (select chunk_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as s from w where len(w) >= 30),
c as (select s, row_number() over () as c, len(s) as n from (select distinct s from t)),
m as (select distinct c, chunk_id from t join c using (s)),
u as (select c, unnest(s) as s from c),
p as (select a.c as a, b.c as b, count(*) as shared from u a join u b on a.s = b.s and a.c < b.c group by 1, 2),
k as (select a, b from p join c x on a = x.c join c y on b = y.c where shared >= 0.7 * (x.n + y.n - shared) - 1e-9),
e as (select a, b from k union all select b, a from k),
r as (select c as a, c as b from c union select r.a, e.b from r join e on r.b = e.a),
g as (select r.a as c, min(chunk_id) as group_id from r join m on r.b = m.c group by 1)
select distinct chunk_id as id, group_id, copies from m join g using (c) join (select c, count(*) as copies from m group by 1) using (c)
""")
def p7_groups(spark: SparkSession, data: str) -> DataFrame:
    return neardup.near_groups(table(spark, data, "chunks", "chunk_id", "content"), threshold=0.7)


@query()
def p6_found(spark: SparkSession, data: str) -> DataFrame:
    return markup.markup_elements(table(spark, data, "source_docs", "document_id", "content"))


@query()
def p6_clean_documents(spark: SparkSession, data: str) -> DataFrame:
    return markup.clean_markup(table(spark, data, "source_docs", "document_id", "content"))


@query()
def p6_clean_chunks(spark: SparkSession, data: str) -> DataFrame:
    return markup.clean_markup(table(spark, data, "chunks", "chunk_id", "content"), key="chunk_id")


def _pages(spark: SparkSession, data: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, data, "chunks", "chunk_id", "document_id", "page_number", "chunk_index", "splitter", "content"), table(spark, data, "source_docs", "document_id", "title")


@query()
def p1_found(spark: SparkSession, data: str) -> DataFrame:
    return scan.line_defects(*_pages(spark, data))


@query()
def p1_paragraphs(spark: SparkSession, data: str) -> DataFrame:
    """Of the page chunks."""
    return scan.page_paragraphs(*_pages(spark, data))


@query()
def p1_documents(spark: SparkSession, data: str) -> DataFrame:
    """Of the contents of the documents that came as PDF."""
    documents = table(spark, data, "source_docs", "document_id", "title", "content", "doc_type").where("doc_type = 'pdf'")
    return scan.document_paragraphs(documents, _pages(spark, data)[0])
