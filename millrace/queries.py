"""Queries over the test tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import filters, text, validation
from millrace.operators import chunking, context, evals, fusion, grids, lexical, vectors
from millrace.plans import retrieval, sql
from millrace.session import shared_folder
from millrace.sources import parsers
from millrace.sources.tables import table
from millrace.streaming import ingest

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


def _chunks(spark: SparkSession, data: str, *columns: str) -> DataFrame:
    return table(spark, data, "chunks", "chunk_id", *columns).distinct()


_indexes: dict[tuple[str, str], lexical.LexicalIndex] = {}


def _index(spark: SparkSession, data: str) -> lexical.LexicalIndex:
    """The lexical index of the chunks: written once in a session, then read by every query."""
    key = (f"{spark.sparkContext.applicationId} {spark._jsparkSession.hashCode()}", data)
    if key not in _indexes:
        _indexes[key] = lexical.build_index(_chunks(spark, data, "content"))
    return _indexes[key]


def _documents(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "source_docs", "document_id", "content").distinct()


def _sql(template: str, *values: str, **named: str) -> str:
    """The template with {0}, {name} filled in; other braces, of patterns, stay."""
    for key, value in [*((str(i), v) for i, v in enumerate(values)), *named.items()]:
        template = template.replace("{" + key + "}", str(value))
    return template


TOKEN_SQL = text.TOKEN.replace("'", "''")
TERMS_SQL = "list_transform(regexp_extract_all({0}, '" + text.SEARCH_TERM + "'), lambda x: lower(x))"
WORDS_SQL = "list_distinct(list_transform(regexp_extract_all({0}, '" + TOKEN_SQL + "'), lambda x: replace(lower(x), 'ß', 'ss')))"
GOOD_SQL = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0"
BM25_SQL = f"""
d as (select distinct chunk_id, coalesce(content, '') as t from chunks),
w as (select chunk_id, {_sql(TERMS_SQL, 't')} as w from d),
p as (select term, chunk_id, length, count(*) as tf from (select chunk_id, len(w) as length, unnest(w) as term from w) group by all),
df as (select term, count(*) as df from p group by term),
co as (select count(*) as n, greatest(coalesce(avg(len(w)), 1), 1) as average from w),
a as (select distinct query_id, unnest({_sql(TERMS_SQL, 'query')}) as term from (select distinct query_id, query from queries where query_id is not null)),
s as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / average))) as score, list_sort(list(distinct term)) as terms
      from a join df using (term) cross join co join p using (term) {{allowed}} group by query_id, chunk_id),
b as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as int) as rank from s)"""
BM25_OUT = "select query_id, chunk_id, round(score, 6) as score, rank, 'bm25' as retriever, 'matched_terms=' || array_to_string(terms, ',') as explanation from b where rank <= {k}"
DENSE_SQL = f"""
v as (select chunk_id, min(embedding) as e from vectors where chunk_id is not null and {GOOD_SQL} {{allowed}} group by 1),
q as (select query_id, min(embedding) as e from queries where query_id is not null and {GOOD_SQL} group by 1),
sc as (select query_id, chunk_id, list_cosine_similarity(q.e::double[], v.e::double[]) as score from q cross join v),
dn as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as int) as rank from sc)"""


# --- text ---


@query(f"select distinct chunk_id, cast(len(regexp_extract_all(content, '{TOKEN_SQL}')) as int) as tokens, len(regexp_extract_all(content, '{TOKEN_SQL}')) <= 200 as fits from chunks")
def token_count(spark, data):
    return _chunks(spark, data, "content").select("chunk_id", text.token_count(F.col("content")).alias("tokens"), text.fits(F.col("content"), 200).alias("fits"))


@query(f"select distinct chunk_id, case when len(regexp_extract_all(content, '{TOKEN_SQL}')) <= 40 then content else regexp_extract(content, '^(?:[{text.BLANK}]*(?:{TOKEN_SQL})){{40}}') end as short from chunks")
def token_truncate(spark, data):
    return _chunks(spark, data, "content").select("chunk_id", text.truncate(F.col("content"), 40).alias("short"))


@query("select document_id, count(distinct chunk_id) as chunks, cast(greatest(1, 6400 // count(distinct chunk_id)) as int) as budget from chunks group by 1")
def token_budget(spark, data):
    counted = table(spark, data, "chunks", "document_id", "chunk_id").groupBy("document_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    return counted.withColumn("budget", text.allocate_per_chunk(text.available_input_tokens(8192, 1024, 512, 256), F.col("chunks")))


@query("select distinct chunk_id, sha256(content) as hash, lower(content_hash) = sha256(content) as fresh from chunks")
def content_hashes(spark, data):
    rows = _chunks(spark, data, "content", "content_hash")
    return rows.select("chunk_id", text.content_hash(F.col("content")).alias("hash"), (F.lower("content_hash") == text.content_hash(F.col("content"))).alias("fresh"))


@query("""
with h as (select distinct chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || chunk_id::blob) as h from chunks)
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(printf('%02x', (cast('0x' || substr(h, 17, 2) as int) & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) as point_id from h""")
def point_ids(spark, data):
    return _chunks(spark, data).select("chunk_id", text.point_id(F.col("chunk_id")).alias("point_id"))


@query(f"select distinct query_id, array_to_string({_sql(TERMS_SQL, 'query')}, ' ') as terms from queries")
def search_terms(spark, data):
    return table(spark, data, "queries", "query_id", "query").distinct().select("query_id", F.array_join(text.search_terms(F.col("query")), " ").alias("terms"))


_UNITS = rf"list_filter(list_transform(regexp_extract_all(content, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$'), lambda x: regexp_replace(x, '^[{text.BLANK}]+|[{text.BLANK}]+$', '', 'g')), lambda x: x <> '')"


@query(f"""
with u as (select document_id, unnest(u) as s, unnest(range(len(u))) as unit from (select distinct document_id, content, {_UNITS} as u from source_docs)),
w as (select document_id, unit, {_sql(WORDS_SQL, 's')} as w, lag({_sql(WORDS_SQL, 's')}) over (partition by document_id order by unit) as b from u)
select document_id, cast(unit as int) as unit, round(case when len(w) = 0 or len(b) = 0 then 0 else len(list_intersect(w, b)) / (len(w) + len(b) - len(list_intersect(w, b))) end, 9) as similarity from w where b is not null""")
def adjacent_similarity(spark, data):
    return chunking.adjacent_similarity(_documents(spark, data))


# --- filters ---


@query("select distinct chunk_id from chunks where tenant_id = 'tenant-bexford' and chunk_type = 'text'")
def filter_exact(spark, data):
    rows = table(spark, data, "chunks", "chunk_id", "tenant_id", "chunk_type")
    return rows.where(filters.predicate(rows, filters.Filter.metadata(tenant_id="tenant-bexford", chunk_type="text"))).select("chunk_id").distinct()


@query("select distinct chunk_id from chunks where page_number <= 3 and coalesce(end_page_number, page_number) >= 3")
def filter_page_range(spark, data):
    rows = table(spark, data, "chunks", "chunk_id", "page_number", "end_page_number")
    return rows.where(filters.predicate(rows, filters.Filter.metadata(page_number=3))).select("chunk_id").distinct()


@query("select distinct chunk_id from chunks where coalesce(cast(page_number as varchar), 'None') = '3' and has_table = false and coalesce(tenant_id, 'None') <> ''")
def filter_text(spark, data):
    rows = table(spark, data, "chunks", "chunk_id", "page_number", "has_table", "tenant_id")
    return rows.where(filters.text_predicate(rows, {"page_number": "3", "has_table": "False"})).select("chunk_id").distinct()


@query("""
with p as (select distinct document_id, page_number from chunks where page_number is not null)
select distinct c.chunk_id, p.page_number as wanted_page from chunks c join p on c.document_id = p.document_id and c.page_number <= p.page_number and coalesce(c.end_page_number, c.page_number) >= p.page_number""")
def pages_containing(spark, data):
    rows = table(spark, data, "chunks", "chunk_id", "document_id", "page_number", "end_page_number").distinct()
    wanted = rows.where("page_number is not null").select("document_id", "page_number").distinct()
    return filters.containing_pages(rows, wanted).select("chunk_id", "wanted_page").distinct()


# --- checks of rows ---

_RULES = [*[f"case when coalesce({c}, '') = '' then '{c} is missing' end" for c in ("chunk_id", "document_id", "source_uri")], "case when content is null then 'content is missing' end", *[f"case when {c} < {n} then '{c} is below {n}' end" for c, n in validation.LEAST.items()]]
_RULES += ["case when end_page_number < page_number then 'end_page_number is before page_number' end", "case when end_char < start_char then 'end_char is before start_char' end"]
_RULES += ["case when coalesce(chunk_type, 'text') not in ('text', 'table', 'image', 'formula') then 'chunk_type is unknown' end", "case when coalesce(chunk_role, 'standalone') not in ('standalone', 'parent', 'child') then 'chunk_role is unknown' end"]
#: Rows are dirtied alike in query and SQL, so that every rule has something to find.
_DIRTY = """(select * replace (case when token_count > 250 then -token_count else token_count end as token_count, case when page_number > 5 then 1 else end_page_number end as end_page_number, case when has_table then 'grid' else chunk_type end as chunk_type,
case when tenant_id is null then '' else source_uri end as source_uri) from (select distinct * exclude (metadata) from chunks))"""


@query(f"select chunk_id, array_to_string(list_filter([{', '.join(_RULES)}], lambda x: x is not null), '; ') as faults, count(*) as rows from {_DIRTY} group by 1, 2 having faults <> ''")
def chunk_quarantine(spark, data):
    rows = table(spark, data, "chunks").drop("metadata").distinct().withColumns({
        "token_count": F.when(F.col("token_count") > 250, -F.col("token_count")).otherwise(F.col("token_count")), "end_page_number": F.when(F.col("page_number") > 5, 1).otherwise(F.col("end_page_number")),
        "chunk_type": F.when(F.col("has_table"), "grid").otherwise(F.col("chunk_type")), "source_uri": F.when(F.col("tenant_id").isNull(), "").otherwise(F.col("source_uri")),
    })
    _, bad = validation.quarantine(rows, validation.chunk_faults())
    return bad.groupBy("chunk_id", F.array_join("faults", "; ").alias("faults")).agg(F.count("*").alias("rows"))


@query(f"""
with q as (select distinct query_id, case when top_k > 9 then '?! ' else query end as query, case when top_k > 9 then embedding[1:3] else embedding end as embedding, top_k from queries),
f as (select query_id, {_sql(TERMS_SQL, "coalesce(query, '')")} as w, regexp_replace(coalesce(query, ''), '[{text.BLANK}]', '', 'g') = '' as blank, embedding, top_k from q)
select query_id, array_to_string(list_filter([case when coalesce(query_id, '') = '' then 'query_id is missing' end, case when blank then 'query is blank' end, case when not blank and len(w) = 0 then 'query has no searchable term' end,
case when coalesce(len(embedding), 0) < 1 then 'embedding is missing' end, case when len(embedding) >= 1 and len(embedding) <> 64 then 'embedding has not 64 values' end, case when coalesce(top_k, 0) < 1 then 'top_k is not above 0' end], lambda x: x is not null), '; ') as faults from f where faults <> ''""")
def query_quarantine(spark, data):
    rows = table(spark, data, "queries").distinct().withColumn("query", F.when(F.col("top_k") > 9, "?! ").otherwise(F.col("query"))).withColumn("embedding", F.when(F.col("top_k") > 9, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return validation.quarantine(rows, validation.query_faults())[1].select("query_id", F.array_join("faults", "; ").alias("faults"))


_PLAIN = "chunk_id, document_id, content, source_uri, coalesce(chunk_type, 'text') as chunk_type, parent_id, tenant_id, content_hash, coalesce(chunk_role, 'standalone') as chunk_role, splitter, " + ", ".join(validation.LEAST)


@query(f"""
select distinct {_PLAIN}, array_to_string(coalesce(section_path, []), '/') as section_path, coalesce(has_table, false) as has_table, array_to_string(list_filter([case when chunk_id is null then 'chunk_id is missing' end, case when document_id is null then 'document_id is missing' end, case when content is null then 'content is missing' end, case when source_uri is null then 'source_uri is missing' end], lambda x: x is not null), '; ') as faults from chunks""")
def payload_round_trip(spark, data):
    """Chunks to the JSON beside their vectors and back."""
    stored = table(spark, data, "chunks").select(validation.to_payload().alias("payload"))
    rows = validation.from_payload(stored).drop("metadata").withColumn("section_path", F.array_join("section_path", "/"))
    return rows.withColumn("faults", F.array_join("faults", "; ")).distinct()


# --- lexical ---


@query(f"with {_sql(BM25_SQL, allowed='')} select term, chunk_id, cast(tf as bigint) as tf, cast(length as bigint) as length from p")
def bm25_postings(spark, data):
    return _index(spark, data).postings


@query(f"with {_sql(BM25_SQL, allowed='')} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) as idf from df cross join co")
def bm25_terms(spark, data):
    index = _index(spark, data)
    return index.terms.join(F.broadcast(index.corpus)).select("term", "df", F.round(lexical.inverse_document_frequency(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"with {_sql(BM25_SQL, allowed='')} {_sql(BM25_OUT, k=10)}")
def bm25_topk(spark, data):
    return lexical.bm25(table(spark, data, "queries", "query_id", "query"), _index(spark, data), 10)


@query(f"with {_sql(BM25_SQL, allowed='semi join (select chunk_id from chunks where has_table = false and chunk_role = $$standalone$$) al using (chunk_id)')} {_sql(BM25_OUT, k=5)}")
def bm25_filtered(spark, data):
    rows = table(spark, data, "chunks", "chunk_id", "has_table", "chunk_role")
    allowed = rows.where(filters.predicate(rows, filters.Filter.exact(has_table=False, chunk_role="standalone")))
    return lexical.bm25(table(spark, data, "queries", "query_id", "query"), _index(spark, data), 5, allowed=allowed)


@query(f"with {_sql(BM25_SQL, allowed='')} {_sql(BM25_OUT, k=3)}")
def bm25_written(spark, data):
    """From an index written to files and read again."""
    path = shared_folder(spark, "index-" + data.strip("/").replace("/", "-"))
    _index(spark, data).write(path)
    return lexical.bm25(table(spark, data, "queries", "query_id", "query"), lexical.LexicalIndex.read(spark, path), 3)


# --- vectors ---


@query("select cast(len(embedding) as bigint) as dimension, count(*) as vectors from vectors where embedding is not null group by 1")
def vector_dimensions(spark, data):
    return vectors.dimensions(table(spark, data, "vectors"))


@query(f"with {_sql(DENSE_SQL, allowed='')} select query_id, chunk_id, round(score, 6) as score, rank, 'dense' as retriever from dn where rank <= 10")
def vector_topk(spark, data):
    return vectors.search(table(spark, data, "queries", "query_id", "embedding"), table(spark, data, "vectors"), 10)


@query(f"with {_sql(DENSE_SQL, allowed='and chunk_id in (select chunk_id from chunks where chunk_role = $$child$$)')} select query_id, chunk_id, round(score, 6) as score, rank, 'dense' as retriever from dn where rank <= 5 and score >= 0")
def vector_topk_filtered(spark, data):
    roles = _chunks(spark, data, "chunk_role")
    store = table(spark, data, "vectors").join(roles.where("chunk_role is not null"), "chunk_id")
    return vectors.search(table(spark, data, "queries", "query_id", "embedding"), store, 5, min_score=0.0, spec=filters.Filter.exact(chunk_role="child"))


@query("""
with s as (select vec_id, label, 1 as version from embeddings), c as (select vec_id + 100 as vec_id, label + 10 as label, 2 as version from embeddings where label < 5)
select coalesce(c.vec_id, s.vec_id) as vec_id, cast(coalesce(c.label, s.label) as int) as label, cast(coalesce(c.version, s.version) as int) as version from s full join c using (vec_id)""")
def vector_upsert(spark, data):
    store = table(spark, data, "embeddings", "vec_id", "label").withColumn("version", F.lit(1))
    changes = store.where("label < 5").select((F.col("vec_id") + 100).alias("vec_id"), (F.col("label") + 10).cast("int").alias("label"), F.lit(2).alias("version"))
    return vectors.upsert(store.withColumn("label", F.col("label").cast("int")), changes, "vec_id")


@query("select vec_id, cast(label as int) as label from embeddings where not (label >= 3 and label <= 6)")
def vector_delete(spark, data):
    store = table(spark, data, "embeddings", "vec_id", "label")
    spec = filters.Filter((filters.Condition("label", "gte", 3), filters.Condition("label", "lte", 6)))
    return vectors.delete(store, spec).select("vec_id", F.col("label").cast("int").alias("label"))


@query("select count(*) as deleted from embeddings where label = 4")
def vector_deleted_count(spark, data):
    return vectors.deleted_count(table(spark, data, "embeddings"), filters.Filter.exact(label=4))


@query(f"""
with d as (select row_number() over () as r, chunk_id, t from (select distinct chunk_id, coalesce(content, '') as t from chunks)),
h as (select r, cast('0x' || substr(md5(term), 1, 8) as bigint) as h from (select r, unnest({_sql(TERMS_SQL, 't')}) as term from d)),
c as (select r, h % 32 as p, sum(case when (h >> 16) & 1 = 1 then -1 else 1 end) as v from h group by 1, 2), n as (select r, sqrt(sum(v * v)) as n from c group by 1),
g as (select r, chunk_id, unnest(range(32)) as p from d)
select chunk_id, list(case when n > 0 then round(cast(cast(coalesce(v, 0) / n as float) as double), 6) else 0.0 end order by p) as embedding from g left join c using (r, p) left join n using (r) group by r, chunk_id""")
def hashed_embedding(spark, data):
    rows = vectors.embed(_chunks(spark, data, "content"), size=32)
    return rows.select("chunk_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


# --- fusion ---

_RRF = """
u as (select query_id, chunk_id, 0 as channel, rank, retriever from {0} union all select query_id, chunk_id, 1, rank, retriever from {1}),
f as (select query_id, chunk_id, channel, min(rank) as rank, any_value(retriever) as retriever from u group by all),
z as (select query_id, chunk_id, sum(1.0::double / (60 + rank)) as score, array_to_string(list(retriever || '#' || rank order by channel), ',') as sources from (select query_id, chunk_id, channel, rank, retriever from f) group by 1, 2),
y as (select *, cast(row_number() over (partition by query_id order by round(score, 9) desc, chunk_id) as int) as rank from z)"""


@query(f"""
with h1 as (select * from hits where retriever = 'dense' and rank is not null and query_id is not null and chunk_id is not null),
h2 as (select * from hits where retriever = 'bm25' and rank is not null and query_id is not null and chunk_id is not null), {_sql(_RRF, 'h1', 'h2').replace('group by all', 'group by 1, 2, 3')}
select query_id, chunk_id, round(score, 9) as score, rank, 'rrf' as retriever, 'rrf_sources=' || sources as explanation from y where rank <= 10""")
def rrf_fuse(spark, data):
    hits = table(spark, data, "hits").where("rank is not null and query_id is not null and chunk_id is not null")
    fused = fusion.rrf([hits.where("retriever = 'dense'"), hits.where("retriever = 'bm25'")], 10)
    return fused.withColumn("score", F.round("score", 9))


_HYBRID = f"""{_sql(DENSE_SQL, allowed='')}, {_sql(BM25_SQL, allowed='')},
h1 as (select query_id, chunk_id, rank, 'dense' as retriever from dn where rank <= {{k}}), h2 as (select query_id, chunk_id, rank, 'bm25' as retriever from b where rank <= {{k}}), {_sql(_RRF, 'h1', 'h2').replace('group by all', 'group by 1, 2, 3')}"""


@query(f"with {_sql(_HYBRID, k=10)} select query_id, chunk_id, round(score, 9) as score, rank, 'rrf' as retriever, 'rrf_sources=' || sources as explanation from y where rank <= 10")
def hybrid_topk(spark, data):
    index = _index(spark, data)
    fused = retrieval.hybrid(table(spark, data, "queries", "query_id", "query", "embedding"), index, table(spark, data, "vectors"), 10)
    return fused.withColumn("score", F.round("score", 9))


_RERANK = f"""
pr as (select distinct y.query_id, y.chunk_id, {_sql(WORDS_SQL, 'query')} as qw, {_sql(WORDS_SQL, 'content')} as cw from {{hits}} y
       join (select distinct query_id, query from queries) q using (query_id) join (select distinct chunk_id, content from chunks) c using (chunk_id)),
rw as (select query_id, chunk_id, case when len(qw) = 0 or qw is null then -4.0::double else 8.0::double * coalesce(len(list_intersect(qw, cw)), 0) / len(qw) - 4.0::double end as raw from pr),
rr as (select *, cast(row_number() over (partition by query_id order by round(raw, 9) desc, chunk_id) as int) as rank from rw)
select query_id, chunk_id, round(1 / (1 + exp(-raw)), 9) as score, rank, 'cross_encoder' as retriever from rr where rank <= {{k}}"""


@query(f"with hh as (select query_id, chunk_id from hits where retriever = 'bm25'), {_sql(_RERANK, hits='hh', k=5)}")
def rerank_topk(spark, data):
    hits = table(spark, data, "hits").where("retriever = 'bm25'")
    best = fusion.rerank(hits, table(spark, data, "queries"), table(spark, data, "chunks", "chunk_id", "content").distinct(), 5)
    return best.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank", "retriever")


@query(f"with {_sql(_HYBRID, k=50)}, yy as (select query_id, chunk_id from y where rank <= 50), {_sql(_RERANK, hits='yy', k=10)}")
def two_stage_topk(spark, data):
    asked = table(spark, data, "queries", "query_id", "query", "embedding")
    chunks = _chunks(spark, data, "content")
    index = _index(spark, data)
    best = retrieval.two_stage(asked, lambda n: retrieval.hybrid(asked, index, table(spark, data, "vectors"), n), chunks, 10, 50)
    return best.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank", "retriever")


# --- context ---


@query("""
with c as (select chunk_id, min(content) as content from (select distinct chunk_id, content from chunks) group by 1),
h as (select query_id, chunk_id, score, rank, row_number() over (partition by query_id order by rank, score desc, chunk_id) as pos from (select distinct query_id, chunk_id, score, rank, retriever from hits where rank is not null and not isnan(score))),
r as (select h.*, row_number() over (partition by query_id, chunk_id order by pos) > 1 as copy, '[' || chunk_id || ']' || chr(10) || coalesce(content, '') as part from h join c using (chunk_id)),
s as (select *, sum(case when copy then 0 else len(part) end) over w as total, sum(case when copy then 0 else 1 end) over w as no from r window w as (partition by query_id order by pos rows unbounded preceding)),
o as (select *, not copy and total + case when no > 1 then 2 else 0 end > 4000 as over_ from s),
st as (select *, max(case when over_ then 1 else 0 end) over (partition by query_id order by pos rows unbounded preceding) = 1 as stopped from o)
select query_id, coalesce(string_agg(part, chr(10) || chr(10) order by pos) filter (not stopped and not copy), '') as text, cast(len(coalesce(string_agg(part, chr(10) || chr(10) order by pos) filter (not stopped and not copy), '')) as int) as character_count, cast(sum(case when not stopped and copy then 1 else 0 end) as bigint) as deduplicated, bool_or(over_) as truncated from st group by 1""")
def context_build(spark, data):
    hits = table(spark, data, "hits").where("rank is not null and score is not null and not isnan(score)").select("query_id", "chunk_id", "score", "rank", "retriever").distinct()
    return context.build_context(hits, _chunks(spark, data, "content"), 4000).select("query_id", "text", "character_count", "deduplicated", "truncated")


# --- grids ---

_GRID = "with g as (select r_name, list(array[n_name, n_nationkey::varchar || '|' || chr(34) || '\"'] order by n_nationkey) as b from nation join region on n_regionkey = r_regionkey group by 1)"


def _grid(spark: SparkSession, data: str) -> DataFrame:
    rows = table(spark, data, "nation").join(table(spark, data, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.struct("n_nationkey", F.array("n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit('|""'))).alias("c"))
    body = F.transform(F.array_sort(F.collect_list(cells)), lambda x: x["c"])
    return rows.groupBy("r_name").agg(F.concat(F.array(F.array(F.lit(" Nation "), F.lit("Key\nno"))), body).alias("rows"))


@query(_GRID + """ select r_name, r_name || chr(10) || chr(10) || '| Nation | Key<br>no |' || chr(10) || '| --- | --- |' || chr(10) ||
array_to_string(list_transform(b, lambda x: '| ' || x[1] || ' | ' || replace(x[2], '|', '\\|') || ' |'), chr(10)) as markdown from g""")
def grid_markdown(spark, data):
    return _grid(spark, data).select("r_name", grids.to_markdown(F.col("rows"), F.col("r_name")).alias("markdown"))


@query(_GRID + """ select r_name, 'Nation,"Key' || chr(10) || 'no"' || chr(10) || array_to_string(list_transform(b, lambda x: x[1] || ',"' || replace(x[2], '"', '""') || '"'), chr(10)) || chr(10) as csv from g""")
def grid_csv(spark, data):
    return _grid(spark, data).select("r_name", grids.to_csv(F.col("rows")).alias("csv"))


@query(_GRID + """ select r_name, '[' || array_to_string(list_transform(b, lambda x: '{"Nation": "' || x[1] || '", "Key\\nno": "' || replace(x[2], '"', '\\"') || '"}'), ', ') || ']' as json from g""")
def grid_json(spark, data):
    return _grid(spark, data).select("r_name", grids.to_json(F.col("rows")).alias("json"))


@query(_GRID + " select r_name, cast(len(b) + 1 as int) as row_count, 2 as column_count, true as is_rectangular from g")
def grid_shape(spark, data):
    return grids.shape(_grid(spark, data)).drop("rows")


# --- evaluation ---


@query("""
with rel as (select distinct query_id as case_id, chunk_id from hits where retriever = 'cross_encoder' and score >= 0.8 and not isnan(score)),
n as (select case_id, count(*) as n from rel group by 1),
st as (select * from (values ('dense'), ('bm25')) s(retriever)),
rk as (select distinct retriever, query_id as case_id, chunk_id, rank from hits where retriever in ('dense', 'bm25') and rank is not null),
m as (select retriever, case_id, count(distinct case when rank <= 5 then chunk_id end) as r5, count(distinct case when rank <= 10 then chunk_id end) as r10, min(rank) as first, sum(case when rank <= 10 then 1 / log2(rank + 1) end) as gain from rk join rel using (case_id, chunk_id) group by 1, 2),
e as (select retriever, coalesce(r5 / n, 0) as a, coalesce(r10 / n, 0) as b, coalesce(1 / first, 0) as c, coalesce(gain / list_sum(list_transform(range(1, least(n, 10)::int + 1), lambda i: 1 / log2(i + 1))), 0) as d from n cross join st left join m using (case_id, retriever))
select retriever, round(avg(a), 6) as recall_at_5, round(avg(b), 6) as recall_at_10, round(avg(c), 6) as mrr, round(avg(d), 6) as ndcg_at_10, count(*) as cases from e group by 1""")
def retrieval_metrics(spark, data):
    hits = table(spark, data, "hits")
    qrels = hits.where("retriever = 'cross_encoder' and score >= 0.8 and not isnan(score)").select(F.col("query_id").alias("case_id"), "chunk_id")
    rankings = hits.where("retriever in ('dense', 'bm25') and rank is not null").select("retriever", F.col("query_id").alias("case_id"), "chunk_id", "rank").distinct()
    return evals.retrieval_metrics(qrels, rankings, ["retriever"])


@query("""
select query_id as case_id from hits where retriever = 'cross_encoder' and query_id is not null except select query_id from hits where retriever = 'rrf'""")
def missing_rankings(spark, data):
    hits = table(spark, data, "hits", "query_id", "retriever").where("query_id is not null").withColumnRenamed("query_id", "case_id")
    return evals.missing_cases(hits.where("retriever = 'cross_encoder'"), hits.where("retriever = 'rrf'"))


@query("""
with c as (select distinct splitter, chunk_id, document_id, source_uri, content, content_hash, token_count, start_char, end_char from chunks),
r as (select splitter, len(content) as chars, coalesce(token_count, 0) as tokens, case when start_char is not null and end_char is not null then greatest(0, lag(end_char) over (partition by splitter, document_id order by start_char nulls first, end_char nulls first, chunk_id) - start_char) end as shared,
 case when coalesce(source_uri, '') <> '' and coalesce(document_id, '') <> '' and coalesce(content_hash, '') <> '' and start_char is not null and end_char is not null and token_count is not null and splitter is not null then 1.0 else 0.0 end as complete from c)
select splitter, count(*) as chunk_count, coalesce(round(avg(chars), 3), 0.0) as avg_chars, coalesce(cast(quantile_disc(chars, 0.95) as double), 0.0) as p95_chars, coalesce(round(avg(tokens), 3), 0.0) as avg_tokens, coalesce(cast(quantile_disc(tokens, 0.95) as double), 0.0) as p95_tokens,
 coalesce(round(cast(sum(shared) as double) / sum(chars), 6), 0.0) as overlap_ratio, coalesce(round(cast(avg(complete) as double), 6), 0.0) as context_complete_ratio from r group by 1""")
def chunk_quality(spark, data):
    rows = table(spark, data, "chunks", "splitter", "chunk_id", "document_id", "source_uri", "content", "content_hash", "token_count", "start_char", "end_char").distinct()
    return evals.chunk_quality(rows, ["splitter"])


@query("""
with t as (select user_id, min(case when event_type = 'view' then epoch_us(ts) / 1000.0 end) as a, max(case when event_type in ('purchase', 'error') then epoch_us(ts) / 1000.0 end) as b from events group by 1),
d as (select a, b, b - a as ms from t where a is not null and b >= a)
select count(*) as tasks, round(quantile_disc(ms, 0.5), 3) as p50_ms, round(quantile_disc(ms, 0.95), 3) as p95_ms, round(max(ms), 3) as max_ms, round(case when max(b) > min(a) then count(*) / ((max(b) - min(a)) / 1000.0) end, 6) as throughput from d""")
def latency_percentiles(spark, data):
    return evals.latency_percentiles(table(spark, data, "events"), "user_id", "event_type", "ts", "view", ("purchase", "error"))


_PROFILES = ", ".join(str(tuple(int(x) if isinstance(x, bool) else x for x in p)) for p in evals.INDEX_PROFILES)


@query(f"""
with p as (select * from (values {_PROFILES}) p(profile, m, ec, se, qz, px)),
r as (select profile, round(least(0.995, 0.63 + 0.032 * log2(se) + 0.022 * log2(m) + 0.018 * log2(ec) - case when qz = 1 then 0.025 else 0 end), 3) as recall,
 round((2.0 + 1.6 * log10(50000) + 0.045 * se + 0.9 + case when px = 1 then 0 else 52.25 end) * case when qz = 1 then 0.88 else 1 end, 3) as p95_ms,
 round(cast(50000 * 1024 * case when qz = 1 then 1 else 4 end + 50000 * m * 8 as double) / 1048576, 3) as memory_mb, round(50000 * m * ec / 1e6, 3) as build_cost, case when px = 1 then 0.0 else 52.25 end as filter_penalty_ms from p)
select profile, cast(recall as double) as recall, cast(p95_ms as double) as p95_ms, cast(memory_mb as double) as memory_mb, cast(build_cost as double) as build_cost, cast(filter_penalty_ms as double) as filter_penalty_ms, 
case when row_number() over (order by (filter_penalty_ms = 0 and recall >= best - 0.005) desc, p95_ms + 0.005 * memory_mb + 0.02 * build_cost) = 1 then 'default' else '' end as recommendation from (select *, max(recall) over () as best from r)""")
def index_profiles(spark, data):
    return evals.estimate_index(evals.index_profiles(spark))


_REPORT = "'| low_latency | 0.984 | 11.703 |', '| balanced | 0.995 | 16.178 |', '| high_recall | 0.995 | 21.938 |', '| filtered_without_payload_index | 0.995 | 68.428 |'"


@query(f"""
select 0 as line_no, '| profile | recall | p95_ms |' as line union all select 1, '| --- | ---: | ---: |' union all select 1 + row_number() over (order by l), l from (select unnest([{_REPORT}]) as l)""")
def index_report(spark, data):
    """Against the published figures of the four profiles."""
    rows = evals.estimate_index(evals.index_profiles(spark)).select("profile", "recall", "p95_ms")
    return evals.markdown_report(rows, {"recall": 3, "p95_ms": 3}, header=True)


@query("""
select case when grouping(doc_type) = 0 then 'type:' || doc_type when grouping(splitter) = 0 then 'parser:' || splitter else 'case_count' end as key, count(*) as cases
from (select d.document_id, d.doc_type, coalesce(c.splitter, 'none') as splitter from (select distinct document_id, doc_type from source_docs) d left join (select document_id, min(splitter) as splitter from chunks group by 1) c using (document_id))
group by grouping sets ((doc_type), (splitter), ())
union all select 'table_cases', count(distinct document_id) from chunks where has_table and document_id in (select document_id from source_docs)""")
def golden_summary(spark, data):
    tabled = table(spark, data, "chunks", "document_id", "splitter", "has_table").groupBy("document_id").agg(F.min("splitter").alias("splitter"), F.max(F.coalesce("has_table", F.lit(False))).alias("t"))
    cases = table(spark, data, "source_docs", "document_id", "doc_type").distinct().join(tabled, "document_id", "left")
    return evals.golden_summary(cases.select(F.col("doc_type").alias("document_type"), F.coalesce("splitter", F.lit("none")).alias("parser"), F.struct(F.coalesce("t", F.lit(False)).alias("requires_table")).alias("expectation")))


# --- chunking ---


@query("""
with d as (select distinct document_id, content from source_docs where len(content) > 0), w as (select document_id, content, unnest(range(cast(ceil(len(content) / 500.0) as int))) as i from d)
select document_id, cast(i as int) as chunk_index, cast(i * 500 as int) as start_char, cast(least(i * 500 + 500, len(content)) as int) as end_char, substring(content, cast(i * 500 + 1 as int), 500) as content from w""")
def chunk_fixed(spark, data):
    return chunking.fixed(_documents(spark, data), 500)


@query("select document_id, true as within_size, true as offsets_hold, true as gapless from (select distinct document_id, content from source_docs where regexp_matches(content, '\\S'))")
def chunk_recursive_checks(spark, data):
    docs = _documents(spark, data)
    rows = chunking.recursive(docs).join(docs.withColumnRenamed("content", "whole"), "document_id")
    fits = F.substring("whole", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("content")
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    gap = F.expr("substring(whole, last_end + 1, start_char - last_end)")
    rows = rows.withColumn("last_end", F.coalesce(F.lag("end_char").over(order), F.lit(0)))
    blank = (F.col("start_char") <= F.col("last_end")) | ~gap.rlike(r"(?U)\S")
    return rows.groupBy("document_id").agg(F.min(F.length("content") <= 800).alias("within_size"), F.min(fits).alias("offsets_hold"), F.min(blank).alias("gapless"))


# --- sources ---


@query("""
select distinct document_id, case lower(regexp_extract(source_uri, '(\\.[^./\\\\]+)$', 1)) when '.docx' then 'docx' when '.md' then 'markdown' when '.markdown' then 'markdown' when '.pdf' then 'pdf' end as parser,
case when lower(regexp_extract(source_uri, '(\\.[^./\\\\]+)$', 1)) not in ('.docx', '.md', '.markdown', '.pdf') then 'file type is not supported' when coalesce(len(content), 0) = 0 then 'file is empty' when len(content) > 20000 then 'file is too large' end as reject from source_docs""")
def upload_dispatch(spark, data):
    rows = table(spark, data, "source_docs", "document_id", "source_uri", "content")
    size = F.coalesce(F.length("content"), F.lit(0))
    return rows.select("document_id", parsers.document_type(F.col("source_uri")).alias("parser"), parsers.reject_reason(F.col("source_uri"), size, 20000).alias("reject")).distinct()


# --- ingestion ---

_EVENTS = "case event_type when 'signup' then 'queued' when 'view' then 'started' when 'click' then 'started' when 'purchase' then 'succeeded' else 'failed' end"


def _task_events(spark: SparkSession, data: str) -> DataFrame:
    return table(spark, data, "events").selectExpr("cast(user_id as string) as task_id", f"{_EVENTS} as stage", "value as progress", "cast(ts as timestamp) as created_at")


@query(f"""
with e as (select cast(user_id as varchar) as task_id, {_EVENTS} as stage, value as progress, ts from events),
l as (select *, row_number() over (partition by task_id order by ts desc, progress desc, stage desc) as n, count(*) over (partition by task_id) as events from e)
select task_id, stage, case stage when 'started' then 'running' else stage end as status, progress, events from l where n = 1""")
def task_state(spark, data):
    return ingest.task_state(_task_events(spark, data)).drop("updated_at")


@query(f"""
with e as (select cast(user_id as varchar) as task_id, {_EVENTS} as stage, value as progress, ts from events),
t as (select distinct cast(c_custkey as varchar) as task_id from customer),
r as (select task_id, arg_max(stage, (ts, progress, stage)) as stage, arg_max(progress, (ts, progress, stage)) as progress, string_agg(stage, ',' order by ts, progress, stage) as stages from e group by 1)
select task_id, case coalesce(stage, 'queued') when 'started' then 'running' else coalesce(stage, 'queued') end as status, coalesce(progress, 0.0) as progress, coalesce(stages, '') as stages from t left join r using (task_id)""")
def task_reports(spark, data):
    """Tasks with and without events."""
    tasks = table(spark, data, "customer", "c_custkey").select(F.col("c_custkey").cast("string").alias("task_id"))
    return ingest.task_reports(tasks, _task_events(spark, data))


@query(f"select epoch_us(date_trunc('hour', ts)) as start, {_EVENTS} as stage, count(*) as events from events group by 1, 2")
def stage_counts(spark, data):
    return ingest.stage_counts(_task_events(spark, data)).withColumn("start", F.unix_micros("start"))


@query("""
with f as (select distinct document_id as source_uri, sha256(content) as content_hash from source_docs), c as (select distinct document_id as source_uri, sha256(content) as content_hash from source_docs where content is not null and doc_type = 'pdf')
select source_uri, content_hash, exists (select 1 from c where c.source_uri = f.source_uri and c.content_hash = f.content_hash) as hit from f""")
def cache_split(spark, data):
    rows = table(spark, data, "source_docs", "document_id", "doc_type", "content").select(F.col("document_id").alias("source_uri"), text.content_hash(F.col("content")).alias("content_hash"), "doc_type")
    hits, todo = ingest.split_by_cache(rows.drop("doc_type").distinct(), rows.where("content_hash is not null and doc_type = 'pdf'"))
    return hits.withColumn("hit", F.lit(True)).unionByName(todo.withColumn("hit", F.lit(False)))


@query("""
with t as (select event_type, user_id, hour(ts) as h, ts from events),
s as (select h, user_id, min(case when event_type = 'view' then ts end) as a, max(case when event_type in ('purchase', 'error') then ts end) as b from t group by 1, 2),
v as (select h, a as moment, 1 as step from s where a < b union all select h, b, -1 from s where a < b),
m as (select h, moment, sum(step) as step, sum(case when step > 0 then 1 else 0 end) as starts from v group by 1, 2),
r as (select h, starts, sum(step) over (partition by h order by moment rows unbounded preceding) as running from m)
select cast(h as int) as h, cast(max(running) as int) as most_at_once, cast(sum(starts) as bigint) as tasks from r group by 1""")
def task_concurrency(spark, data):
    events = table(spark, data, "events").withColumn("h", F.hour("ts"))
    return evals.concurrency(events, "user_id", "event_type", "ts", "view", ("purchase", "error"), ["h"])


# --- in SQL ---


@query(f"""
with d as (select distinct chunk_id, content, coalesce(len(regexp_extract_all(content, '{TOKEN_SQL}')), 0) as tokens from chunks where len(regexp_extract_all(content, '{TOKEN_SQL}')) <= 60)
select chunk_id, cast(tokens as int) as tokens, sha256(content) as hash, round(case when len({_sql(WORDS_SQL, 'content')}) = 0 then 0 else len(list_intersect({_sql(WORDS_SQL, 'content')}, ['the', 'of', 'and'])) / (len({_sql(WORDS_SQL, 'content')}) + 3 - len(list_intersect({_sql(WORDS_SQL, 'content')}, ['the', 'of', 'and']))) end, 9) as near from d""")
def sql_functions(spark, data):
    sql.register(spark, data, ("chunks",))
    return spark.sql("select distinct chunk_id, token_count(content) as tokens, content_hash(content) as hash, round(jaccard(term_set(content), array('the', 'of', 'and')), 9) as near from chunks where token_fits(content, 60)")


@query("""
select o_orderpriority, strftime(date_trunc('month', o_orderdate), '%Y-%m') as month, cast(count(*) as bigint) as orders, cast(max(datediff('day', o_orderdate, last_day(o_orderdate))) as int) as most_left, cast(sum(case when isodow(o_orderdate) > 5 then 1 else 0 end) as bigint) as weekend
from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01' group by 1, 2""")
def sql_orders_by_month(spark, data):
    sql.register(spark, data, ("orders",))
    return spark.sql("""
        select o_orderpriority, date_format(date_trunc('month', o_orderdate), 'yyyy-MM') as month, count(*) as orders, max(datediff(last_day(o_orderdate), o_orderdate)) as most_left, sum(case when weekday(o_orderdate) > 4 then 1 else 0 end) as weekend
        from orders where o_orderdate >= date '1995-01-01' and o_orderdate < date '1996-01-01' group by 1, 2""")


# --- relational ---


@query("""
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as lines from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def rollup_lines(spark, data):
    lines = table(spark, data, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return lines.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("""
select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_custkey not in (select o_custkey from orders where o_totalprice > 150000) and n_regionkey in (select r_regionkey from region where r_name <> 'ASIA')""")
def customers_without_large_orders(spark, data):
    nations = table(spark, data, "nation").join(table(spark, data, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    idle = table(spark, data, "customer").join(table(spark, data, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def top_orders(spark, data):
    return lexical.top_k(table(spark, data, "orders", "o_custkey", "o_orderkey", "o_totalprice").withColumn("_i", F.format_string("%020d", "o_orderkey")), 3, "o_totalprice", "o_custkey", "_i").select("o_custkey", "o_orderkey", "o_totalprice")
