"""Queries of parsers, splitters and ingestion over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import chunking, grids
from millrace.plans import sql
from millrace.queries import TOKEN_SQL, WORDS_SQL, _documents, _sql, query
from millrace.sources import parsers
from millrace.sources.tables import table
from millrace.streaming import ingest

#: Lines and outer blanks in SQL, as the parsers take them.
LINES_SQL = "regexp_split_to_array({0}, '" + chunking.LINE_END + "')"
STRIP_SQL = "regexp_replace({0}, '^[" + text.BLANK + "]+|[" + text.BLANK + "]+$', '', 'g')"
LEAD_SQL = "len(regexp_extract({0}, '^[" + text.BLANK + "]+'))"


def _hash_sql(column: str) -> str:
    return f"sha256({column})"


# --- parsers ---

#: A page that holds this cannot be read by `torn_reader`.
TORN = "INC-9"


def torn_reader(data: bytes) -> tuple[dict[str, str], list[parsers.Part]]:
    """Pages between form feeds, as a library would give them; some fail."""

    def page(text: str):
        def read() -> str:
            if TORN in text:
                raise OSError("torn")
            return text

        return read

    return {"title": "Scan", "producer": ""}, [page(p) for p in data.decode().split("\f")]


def _pdf_files(spark: SparkSession, data: str) -> DataFrame:
    pages = table(spark, data, "chunks", "document_id", "page_number", "content", "splitter").where("splitter = 'PdfTextParser'").distinct()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "content"))), lambda p: p["content"]), "\f")
    return pages.groupBy("document_id").agg(F.encode(joined, "UTF-8").alias("content")).select(F.concat("document_id", F.lit(".pdf")).alias("source_uri"), "content")


def _pdf_results(spark: SparkSession, data: str) -> DataFrame:
    return parsers.parse_results(parsers.read_files(_pdf_files(spark, data), {"pdf": torn_reader}))


_PDF = f"""
pg as (select document_id || '.pdf' as source_uri, content, row_number() over (partition by document_id order by page_number) as no from (select distinct document_id, page_number, content from chunks where splitter = 'PdfTextParser')),
px as (select source_uri, no, contains(content, '{TORN}') as torn, array_to_string(list_filter(list_transform({_sql(LINES_SQL, "content")}, lambda x: {_sql(STRIP_SQL, "x")}), lambda x: x <> ''), chr(10)) as t from pg)"""


@query(f"""with {_PDF}
select source_uri, 'Scan' as title, coalesce(string_agg(t, chr(10) || chr(10) order by no) filter (not torn and t <> ''), '') as content, cast(count(*) as varchar) as page_count,
coalesce(list('page ' || no || ' of the pdf cannot be read: torn' order by no) filter (torn), []) as errors,
case when not bool_or(torn) then 'succeeded' when count(*) filter (not torn and t <> '') > 0 then 'partial' else 'failed' end as status from px group by 1""")
def pdf_parse(spark, data):
    return _pdf_results(spark, data).select("source_uri", "title", "content", F.col("metadata")["page_count"].alias("page_count"), "errors", "status")


@query(f"""with {_PDF}, ok as (select *, row_number() over (partition by source_uri order by no) - 1 as i, count(*) over (partition by source_uri) as n from px where not torn)
select source_uri as document_id, cast(no as int) as page_number, cast(no as int) as end_page_number, cast(i as int) as chunk_index, cast(n as int) as chunk_count, t as content, {_hash_sql('t')} as content_hash, 'PdfTextParser' as splitter, 0 as start_char, cast(len(t) as int) as end_char from ok where t <> ''""")
def pdf_pages(spark, data):
    return parsers.page_chunks(_pdf_results(spark, data))


def _docx_results(spark: SparkSession, data: str) -> DataFrame:
    lines = F.filter(F.split("content", chunking.LINE_END), lambda x: F.regexp_count(x, F.lit(rf"[^{text.BLANK}]")) > 0)

    @F.pandas_udf("binary")
    def written(documents):
        import pandas as pd

        return pd.Series([parsers.write_docx([(x, len(x) - len(x.lstrip("#")) if x.lstrip("#").startswith(" ") and len(x) - len(x.lstrip("#")) <= 6 else 0) for x in d]) for d in documents])

    files = _documents(spark, data).where("content is not null").select(F.concat("document_id", F.lit(".docx")).alias("source_uri"), written(lines).alias("content"))
    return parsers.parse_results(parsers.read_files(files))


_DOCX = f"""
ln as (select document_id, unnest(l) as line, unnest(range(len(l))) as n from (select document_id, {_sql(LINES_SQL, "content")} as l from (select distinct document_id, content from source_docs where content is not null))),
xl as (select document_id || '.docx' as document_id, n, {_sql(STRIP_SQL, "line")} as t, case when regexp_matches(line, '^#{{1,6}} ') then len(regexp_extract(line, '^#+')) end as level
 from (select document_id, n, regexp_replace(line, '[\\x{{0}}-\\x{{8}}\\x{{b}}\\x{{c}}\\x{{e}}-\\x{{1f}}\\x{{fffe}}\\x{{ffff}}]', '', 'g') as line from ln)),
pr as (select document_id, t, level, row_number() over (partition by document_id order by n) - 1 as i, count(*) over (partition by document_id) as c from xl where t <> '')"""


@query(f"""with {_DOCX} select d.document_id || '.docx' as source_uri, arg_min(t, i) filter (level = 1) as title, coalesce(string_agg(t, chr(10) || chr(10) order by i), '') as content,
case when count(t) > 0 then [] else ['the document has no text'] end as errors, case when count(t) > 0 then 'succeeded' else 'failed' end as status
from (select distinct document_id from source_docs where content is not null) d left join pr on pr.document_id = d.document_id || '.docx' group by 1""")
def docx_parse(spark, data):
    return _docx_results(spark, data).select("source_uri", "title", "content", "errors", "status")


@query(f"""with recursive {_DOCX},
st as (select document_id, i, t, c, case when level is null then cast([] as varchar[]) else [t] end as path from pr where i = 0
 union all select pr.document_id, pr.i, pr.t, pr.c, case when pr.level is null then st.path else list_append(st.path[1:pr.level - 1], pr.t) end from st join pr on pr.document_id = st.document_id and pr.i = st.i + 1)
select document_id, cast(i as int) as chunk_index, cast(c as int) as chunk_count, path as section_path, t as content, {_hash_sql('t')} as content_hash, 'DocxParser' as splitter, 0 as start_char, cast(len(t) as int) as end_char from st""")
def docx_paragraphs(spark, data):
    return parsers.paragraph_chunks(_docx_results(spark, data))


@query(f"""
with m as (select document_id as source_uri, doc_type, {_sql(STRIP_SQL, "coalesce(content, '')")} as t from (select distinct document_id, doc_type, content from source_docs where doc_type in ('pdf', 'docx')))
select source_uri, case when doc_type = 'docx' or t = '' then 'failed' else 'succeeded' end as status, case when doc_type = 'docx' then ['no layout'] when t = '' then ['the conversion gave no text'] else [] end as errors,
case when doc_type = 'docx' then '' else t end as content, 0 as chunk_index, 1 as chunk_count, sha256(case when doc_type = 'docx' then '' else t end) as content_hash, 'StructuredPdfParser' as splitter, 0 as start_char, cast(len(case when doc_type = 'docx' then '' else t end) as int) as end_char from m""")
def structured_parse(spark, data):
    rows = table(spark, data, "source_docs", "document_id", "doc_type", "content").where("doc_type in ('pdf', 'docx')").distinct()
    return parsers.structured_chunks(rows.select(F.col("document_id").alias("source_uri"), F.col("content").alias("markdown"), F.when(F.col("doc_type") == "docx", "no layout").alias("error")))


_HEADINGS = f"""
ml as (select document_id, unnest(l) as line, unnest(range(len(l))) as n from (select document_id, {_sql(LINES_SQL, "content")} as l from (select distinct document_id, content from source_docs))),
mh as (select document_id, n, line, len(regexp_extract(line, '^[{text.BLANK}]*(#{{1,6}}) (.*)$', 1)) as h, {_sql(STRIP_SQL, f"regexp_extract(line, '^[{text.BLANK}]*(#{{1,6}}) (.*)$', 2)")} as title from ml),
ms as (select *, h > 0 and title <> '' as head, sum(case when h > 0 and title <> '' then 1 else 0 end) over (partition by document_id order by n rows unbounded preceding) as s from mh),
mg as (select document_id, s, {_sql(STRIP_SQL, "string_agg(line, chr(10) order by n)")} as content, max(case when head then h end) as level, max(case when head then title end) as title from ms group by 1, 2)"""


@query(f"""with {_HEADINGS} select d.document_id || '.md' as source_uri, arg_min(title, s) filter (title is not null) as title, d.content as content, cast([] as varchar[]) as errors, 'succeeded' as status
from (select distinct document_id, content from source_docs where content is not null) d left join mg using (document_id) group by 1, d.content""")
def markdown_parse(spark, data):
    files = _documents(spark, data).where("content is not null").select(F.concat("document_id", F.lit(".md")).alias("source_uri"), F.encode("content", "UTF-8").alias("content"))
    return parsers.parse_results(parsers.read_files(files)).select("source_uri", "title", "content", "errors", "status")


@query(f"""with recursive {_HEADINGS},
mp as (select document_id, s, content, case when level is null then cast([] as varchar[]) else [title] end as path from mg where s = 0
 union all select mg.document_id, mg.s, mg.content, list_append(mp.path[1:mg.level - 1], mg.title) from mp join mg on mg.document_id = mp.document_id and mg.s = mp.s + 1),
-- a document that begins with a heading has no section 0
m1 as (select document_id, s, content, [title] as path from mg where s = 1 and document_id not in (select document_id from mg where s = 0)
 union all select mg.document_id, mg.s, mg.content, list_append(m1.path[1:mg.level - 1], mg.title) from m1 join mg on mg.document_id = m1.document_id and mg.s = m1.s + 1)
select document_id, cast(row_number() over w - 1 as int) as chunk_index, cast(count(*) over (partition by document_id) as int) as chunk_count, path as section_path, content, {_hash_sql('content')} as content_hash, 'MarkdownParser' as splitter
from (select * from mp union all select * from m1) where content <> '' window w as (partition by document_id order by s)""")
def markdown_sections(spark, data):
    return chunking.markdown_sections(_documents(spark, data))


def _scans(spark: SparkSession, data: str) -> DataFrame:
    torn = F.contains("content", F.lit(TORN))
    return table(spark, data, "chunks").where("splitter = 'OcrDocumentParser'").select(
        F.col("document_id").alias("source_uri"), "page_number", F.col("content").alias("text"), F.when(torn | F.col("content").isNull(), "failed").otherwise("succeeded").alias("status"),
        F.lit(None).cast("double").alias("confidence"), F.when(torn, F.array(F.concat(F.lit("blurred "), F.col("page_number").cast("string")))).otherwise(F.expr("cast(array() as array<string>)")).alias("errors"),
    ).distinct()


_OCR = f"og as (select distinct document_id as source_uri, page_number, content as t, contains(content, '{TORN}') as torn from chunks where splitter = 'OcrDocumentParser')"


@query(f"""with {_OCR} select source_uri, coalesce(string_agg(t, chr(10) || chr(10) order by page_number) filter (not torn and t <> ''), '') as content, coalesce(list('blurred ' || page_number order by page_number) filter (torn), []) as errors,
case when count(*) filter (not torn and t <> '') = 0 then 'failed' when bool_or(torn) then 'partial' else 'succeeded' end as status, count(*) as ocr_page_count from og group by 1""")
def ocr_parse(spark, data):
    return parsers.ocr_results(_scans(spark, data))


@query(f"""with {_OCR} select source_uri, page_number, page_number as end_page_number, t as content, cast(row_number() over w - 1 as int) as chunk_index, cast(count(*) over (partition by source_uri) as int) as chunk_count, {_hash_sql('t')} as content_hash, 'OcrDocumentParser' as splitter,
0 as start_char, cast(len(t) as int) as end_char from og where not torn and t is not null window w as (partition by source_uri order by page_number) qualify t <> ''""")
def ocr_pages(spark, data):
    return parsers.ocr_chunks(_scans(spark, data))


# --- tables inside documents ---


@query("""
with g as (select n_regionkey, r_name, list([n_name, n_nationkey::varchar] order by n_nationkey) as b from nation join region on n_regionkey = r_regionkey group by 1, 2),
t as (select n_regionkey, r_name, r_name || chr(10) || chr(10) || '| Nation |  |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(b, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) as content from g)
select 'doc-' || n_regionkey as document_id, 'table_to_chunk' as splitter, content, sha256(content) as content_hash, 0 as start_char, cast(len(content) as int) as end_char, 'table' as chunk_type, true as has_table, cast(n_regionkey as int) as page_number, cast(n_regionkey as int) as end_page_number, ['tables', r_name] as section_path from t""")
def table_chunks(spark, data):
    """With a header that is shorter than the rows."""
    rows = table(spark, data, "nation").join(table(spark, data, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"], x["n_nationkey"].cast("string")))
    tables = rows.groupBy("n_regionkey", "r_name").agg(F.concat(F.array(F.array(F.lit(" Nation "))), cells).alias("rows"))
    page = F.col("n_regionkey").cast("int")
    tables = tables.select(F.concat(F.lit("doc-"), F.col("n_regionkey").cast("string")).alias("document_id"), F.lit("x").alias("source_uri"), "rows", F.col("r_name").alias("caption"), page.alias("page_number"), F.array(F.lit("tables"), "r_name").alias("section_path"))
    return grids.table_chunks(tables).drop("source_uri", "metadata")


# --- splitters ---


def _recursive_sql(source: str, name: str, size: int, overlap: int) -> str:
    """CTEs that cut the texts of `source` (k, t), the last one `name` (k, s, e, i, n): spans without outer blanks, numbered from 0, and how many."""
    ctes = [f"{name}_0 as (select k, t, 0 as a, len(t) as b from {source} where len(t) > 0)"]
    for j, separator in enumerate(chunking.SEPARATORS, 1):
        sep = separator.replace("\n", "' || chr(10) || '")
        sep = f"('{sep}')"
        ctes.append(f"""
{name}_{j} as (select k, t, a, b from {name}_{j - 1} where b - a <= {size} union all
 select k, t, a + coalesce(sum(l) over (partition by k, a order by i rows between unbounded preceding and 1 preceding), 0) as a, a + sum(l) over (partition by k, a order by i rows unbounded preceding) as b
 from (select k, t, a, i, len(p) + case when i < c then len({sep}) else 0 end as l from (select k, t, a, unnest(x) as p, unnest(range(1, len(x) + 1)) as i, len(x) as c from (select k, t, a, string_split(substring(t, a + 1, b - a), {sep}) as x from {name}_{j - 1} where b - a > {size}))) where l > 0)""")
    last = len(chunking.SEPARATORS)
    ctes.append(f"""
{name}_p as (select k, cast(a + c * {size} as bigint) as a, cast(least(a + c * {size} + {size}, b) as bigint) as b, row_number() over (partition by k order by a, c) as i, count(*) over (partition by k) as n from (select k, a, b, unnest(range(cast(ceil((b - a) / {size}.0) as bigint))) as c from {name}_{last})),
{name}_m as (select k, i, n, a as s, b as e, cast(null as bigint) as fs, cast(null as bigint) as fe from {name}_p where i = 1
 union all select p.k, p.i, p.n, case when p.b - m.s > {size} then greatest(m.e - {overlap}, p.b - {size}, 0) else m.s end, p.b, case when p.b - m.s > {size} then m.s end, case when p.b - m.s > {size} then m.e end from {name}_m m join {name}_p p on p.k = m.k and p.i = m.i + 1),
{name}_c as (select k, i, fs as s, fe as e from {name}_m where fs is not null union all select k, n + 1, s, e from {name}_m where i = n),
{name}_t as (select k, i, s, e, substring(t, s + 1, e - s) as part from {name}_c join {source} using (k)),
{name} as (select k, s + {_sql(LEAD_SQL, 'part')} as s, s + len(regexp_replace(part, '[{text.BLANK}]+$', '')) as e, row_number() over (partition by k order by i) - 1 as i, count(*) over (partition by k) as n from {name}_t where {_sql(STRIP_SQL, 'part')} <> '')""")
    return ", ".join(ctes)


def _described_sql(role: str, splitter: str, spans: str) -> str:
    """Columns of chunks over rows (document_id, content, s, e, i, n)."""
    key = f"sha256(document_id || '|{splitter}|{role}|' || s || '|' || e)"
    return f"""{key} as chunk_id, document_id, content, cast(i as int) as chunk_index, cast(n as int) as chunk_count, '{role}' as chunk_role, '{splitter}' as splitter, cast(len(regexp_extract_all(content, '{TOKEN_SQL}')) as int) as token_count,
cast(s as int) as start_char, cast(e as int) as end_char, {_hash_sql('content')} as content_hash from {spans}"""


_SOURCE = "sd as (select document_id as k, content as t from (select distinct document_id, content from source_docs) where content is not null)"


@query(f"""with recursive {_SOURCE}, {_recursive_sql('sd', 'rs', 800, 120)}
select {_described_sql('standalone', 'RecursiveSplitter', '(select k as document_id, substring(t, s + 1, e - s) as content, s, e, i, n from rs join sd using (k))')}""")
def chunk_recursive(spark, data):
    return chunking.recursive(_documents(spark, data))


@query(f"""with recursive {_SOURCE}, {_recursive_sql('sd', 'rs', 500, 50)}
select k as document_id, cast(i as int) as chunk_index, cast(s as int) as start_char, cast(e as int) as end_char, substring(t, s + 1, e - s) as content from rs join sd using (k)""")
def sql_split(spark, data):
    """A splitter as a table function."""
    sql.register(spark)
    _documents(spark, data).createOrReplaceTempView("distinct_docs")
    return spark.sql("select document_id, c.* from distinct_docs, lateral split_recursive(content, 500, 50) c")


@query(f"""with recursive {_SOURCE}, {_recursive_sql('sd', 'pa', 1600, 160)},
par as (select {_described_sql('parent', 'ParentChildSplitter', '(select k as document_id, substring(t, s + 1, e - s) as content, s, e, i, n from pa join sd using (k))')}),
pk as (select chunk_id as k, content as t from par), {_recursive_sql('pk', 'ch', 400, 80)},
chi as (select {_described_sql('child', 'ParentChildSplitter', '(select document_id, k as parent_id, substring(content, s + 1, e - s) as content, start_char + s as s, start_char + e as e, i, n from ch join par on k = chunk_id)').replace('document_id, content,', 'document_id, parent_id, content,', 1)})
select *, cast(null as varchar) as parent_id from par union all by name select * replace (sha256(parent_id || '|' || chunk_id) as chunk_id) from chi""")
def chunk_parent_child(spark, data):
    return chunking.parent_child(_documents(spark, data))


_RAW = "regexp_extract_all(t, '[^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$')"


@query(f"""with recursive {_SOURCE},
un as (select k, unnest(u) as raw, unnest(range(len(u))) as j from (select k, {_RAW} as u from sd)),
uo as (select k, j, raw, sum(len(raw)) over (partition by k order by j rows unbounded preceding) - len(raw) as off from un),
uk as (select k, {_sql(STRIP_SQL, 'raw')} as p, off + {_sql(LEAD_SQL, 'raw')} as a, off + len(regexp_replace(raw, '[{text.BLANK}]+$', '')) as b, row_number() over (partition by k order by j) as i, count(*) over (partition by k) as n from uo where {_sql(STRIP_SQL, 'raw')} <> ''),
uw as (select *, {_sql(WORDS_SQL, 'p')} as w from uk),
fo as (select k, i, n, a, b, p as c, w, cast(null as bigint) as fa, cast(null as bigint) as fb, cast(null as varchar) as fc from uw where i = 1
 union all select k, i, n, case when j then oa else a end, b, case when j then oc || chr(10) || p else p end, case when j then list_distinct(list_concat(ow, w)) else w end, case when not j then oa end, case when not j then ob end, case when not j then oc end
 from (select u.*, o.a as oa, o.b as ob, o.c as oc, o.w as ow, len(o.c) + 1 + len(u.p) <= 800 and (len(o.c) < 160 or (case when len(o.w) = 0 or len(u.w) = 0 then 0 else len(list_intersect(o.w, u.w)) / (len(o.w) + len(u.w) - len(list_intersect(o.w, u.w))) end) >= 0.12) as j from fo o join uw u on u.k = o.k and u.i = o.i + 1)),
gr as (select k, i, fa as a, fb as b, fc as c from fo where fc is not null union all select k, n + 1, a, b, c from fo where i = n),
lo as (select k || '#' || i as k, c as t from gr where len(c) > 800), {_recursive_sql('lo', 'cu', 800, 80)},
al as (select k as document_id, i as g, 0 as x, c as content, a as s, b as e, cast(null as bigint) as ix, cast(null as bigint) as n from gr where len(c) <= 800
 union all select gr.k, gr.i, cu.i, substring(gr.c, cu.s + 1, cu.e - cu.s), gr.a + cu.s, gr.a + cu.e, cu.i, cu.n from gr join cu on cu.k = gr.k || '#' || gr.i),
od as (select *, row_number() over (partition by document_id order by g, x) - 1 as ordinal from al)
select cast(ordinal as int) as ordinal, {_described_sql('standalone', 'SemanticSplitter', '(select document_id, content, s, e, coalesce(ix, ordinal) as i, n, ordinal from od)')}""")
def chunk_semantic(spark, data):
    return chunking.semantic(_documents(spark, data))


# --- ingestion ---


def _by_last_digit(uri: str) -> str:
    """A parser whose outcome hangs on the name of the file."""
    if uri.endswith("7"):
        raise RuntimeError("unreadable")
    return "partial" if uri.endswith("3") else "succeeded"


def _ingestion(spark: SparkSession, data: str) -> ingest.Ingestion:
    rows = table(spark, data, "source_docs", "document_id", "doc_type", "content").distinct().withColumn("content_hash", text.content_hash(F.col("content")))
    # a small queue with one order; in a stream the source numbers its files
    found = rows.select((F.row_number().over(Window.orderBy("document_id")) - 1).alias("queue_index"), F.col("document_id").alias("source_uri"), "content_hash")
    held = rows.where("doc_type = 'pdf' and content_hash is not null").select(F.col("document_id").alias("source_uri"), F.when(F.endswith("document_id", F.lit("5")), F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("partial").alias("status"), F.lit(5.0).alias("elapsed_ms"))
    return ingest.ingest_many(found, held, _by_last_digit, slots=8)


_INGEST = """
fi as (select document_id as source_uri, sha256(content) as content_hash, row_number() over (order by document_id) - 1 as queue_index, coalesce(doc_type = 'pdf' and content is not null and document_id not like '%5', false) as cached, document_id like '%7' as bad from (select distinct document_id, doc_type, content from source_docs)),
rs as (select *, case when cached then 'partial' when bad then 'failed' when source_uri like '%3' then 'partial' else 'succeeded' end as status from fi)"""


@query(f"""with {_INGEST} select cast(queue_index as int) as queue_index, source_uri, cached, status, case when bad and not cached then 'unreadable' end as message,
'queued,started,' || case when cached then 'cache_hit' when bad then 'failed' else 'succeeded' end as stages from rs""")
def parse_many(spark, data):
    """The whole pipeline: queue, probe of the cache, parsing, results in the order of the queue."""
    done = _ingestion(spark, data)
    stages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("progress", "stage"))), lambda e: e["stage"]), ",")
    told = done.events.groupBy("source_uri").agg(stages.alias("stages"))
    return done.results.join(told, "source_uri").select("queue_index", "source_uri", "cached", "status", "message", "stages")


@query(f"""with {_INGEST} select source_uri, content_hash, status from rs where cached or (status <> 'failed' and content_hash is not null)
union all select document_id, 'old', 'partial' from (select distinct document_id, doc_type, content from source_docs) where doc_type = 'pdf' and content is not null and document_id like '%5' and document_id like '%7'""")
def cache_after(spark, data):
    """The cache that a run leaves: failed files and those without hash left out, changed ones replaced."""
    return _ingestion(spark, data).cache.select("source_uri", "content_hash", "status")


@query("select source_uri, sha256(content) as content_hash from (select distinct document_id as source_uri, doc_type, content from source_docs) where doc_type <> 'docx'")
def cache_invalidated(spark, data):
    rows = table(spark, data, "source_docs", "document_id", "doc_type", "content").distinct().select(F.col("document_id").alias("source_uri"), "doc_type", text.content_hash(F.col("content")).alias("content_hash"))
    return ingest.cache_invalidate(rows, rows.where("doc_type = 'docx'")).where("doc_type is not null").select("source_uri", "content_hash")
