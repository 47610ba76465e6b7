"""Files to parse results and chunks: Markdown, DOCX, PDF pages, structured PDF, OCR pages.

Reading bytes of one file is the only thing done in Python; a reader for each type
can be given, since PDF and OCR need libraries of the caller. What follows is
relational: pages and paragraphs are rows.

A parse result has: source_uri, document_type, title, content, metadata
(MAP<STRING,STRING>), status (succeeded, partial, failed), errors (ARRAY<STRING>),
parts (ARRAY<STRUCT<no, text, level, error>>).
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from io import BytesIO
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import BLANK, content_hash
from millrace.operators import chunking

#: Suffixes and their types.
TYPES = {".docx": "docx", ".markdown": "markdown", ".md": "markdown", ".pdf": "pdf"}
#: What a type's parser is called in metadata and chunks.
PARSERS = {"docx": "DocxParser", "markdown": "MarkdownParser", "pdf": "PdfTextParser"}
MAX_UPLOAD_BYTES = 20 * 1024 * 1024

PARTS = "array<struct<no: int, text: string, level: int, error: string>>"
#: A part is (text, heading level or 0, error or None), or a function that gives its text when it is called, so that one
#: that fails takes no other with it.
Part = tuple[str | None, int, str | None] | Callable[[], str | None]
#: A reader gets bytes and gives (metadata, parts).
Reader = Callable[[bytes], tuple[dict[str, str], Iterable[Part]]]


def suffix(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"(\.[^./\\]+)$", 1))


def document_type(uri: Column) -> Column:
    """The type by the uri's suffix, ignoring case; null where none is registered."""
    return F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[suffix(uri)]


def reject_reason(filename: Column, size: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """Why an upload is refused, null if it is not; checked in this order."""
    base = F.regexp_extract(F.trim(filename), r"([^/\\]*)$", 1)
    return (
        F.when(F.coalesce(F.trim(filename), F.lit("")) == "", "filename is required")
        .when(base == "", "filename is required")
        .when(~suffix(base).isin(*TYPES), "file type is not supported")
        .when(size <= 0, "file is empty")
        .when(size > most, "file is too large")
    )


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """source_uri, content, size, content_hash of the files below a path. Spark's file sources skip files without any byte."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("source_uri"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def read_docx(data: bytes) -> tuple[dict[str, str], list[tuple[str | None, int, str | None]]]:
    """Paragraphs of a DOCX by the standard library; styles `Heading N` give levels."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                name = s.find(f"{w}name")
                names[s.get(f"{w}styleId")] = name.get(f"{w}val") if name is not None else ""
    parts: list[tuple[str | None, int, str | None]] = []
    # the body's own paragraphs: those of tables and text boxes are not running text
    for p in body.iterfind(f"{w}body/{w}p"):
        text = "".join((x.text or "") if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else "" for r in p.iter(f"{w}r") for x in r)
        style = p.find(f"{w}pPr/{w}pStyle")
        style_id = style.get(f"{w}val") if style is not None else ""
        name = (names.get(style_id) or style_id or "").lower().replace(" ", "")
        level = int(name[7:]) if name.startswith("heading") and name[7:].isdigit() else 0
        if text.strip():
            parts.append((text.strip(), level, None))
    return {"paragraph_count": str(len(parts))}, parts


def read_pdf(data: bytes) -> tuple[dict[str, str], list[Part]]:
    """Pages of a PDF by the library `pypdf`, where it is installed; each page is read by itself."""
    from pypdf import PdfReader

    pdf = PdfReader(BytesIO(data))
    named = {k: getattr(pdf.metadata, k, None) for k in ("title", "author", "creator", "producer", "subject")} if pdf.metadata else {}
    return {k: str(v) for k, v in named.items() if v}, [page.extract_text for page in pdf.pages]


def _listed(kind: str, parts: Iterable[Part]) -> list[dict]:
    """The parts numbered from 1; one that raises has the error for its text."""
    out = []
    for no, part in enumerate(parts, 1):
        text, level, error = None, 0, None
        if callable(part):
            try:
                text = part() or ""
            except Exception as e:  # noqa: BLE001
                error = f"page {no} of the {kind} cannot be read: {e}"
        else:
            text, level, error = part
        out.append({"no": no, "text": text, "level": level, "error": error})
    return out


_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def write_docx(paragraphs: list[tuple[str, int]]) -> bytes:
    """A DOCX of (text, heading level or 0); characters that XML cannot hold are left out."""
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = []
    for text, level in paragraphs:
        style = f'<w:pPr><w:pStyle w:val="Heading{level}"/></w:pPr>' if level else ""
        body.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(_NOT_XML.sub("", text))}</w:t></w:r></w:p>')
    styles = "".join(f'<w:style w:styleId="Heading{n}"><w:name w:val="heading {n}"/></w:style>' for n in range(1, 10))
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


def read_markdown(data: bytes) -> tuple[dict[str, str], list[tuple[str | None, int, str | None]]]:
    return {}, [(data.decode("utf-8"), 0, None)]


def read_files(found: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """source_uri, document_type, metadata, parts, error of (source_uri, content): one task reads many files, one after another.

    A reader's exception becomes `error`; it never ends the job. Types without a reader have an error too.
    """
    known: dict[str, Reader] = {"docx": read_docx, "markdown": read_markdown, "pdf": read_pdf, **(readers or {})}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri, kind, data in zip(batch["source_uri"], batch["document_type"], batch["content"]):
                try:
                    if kind not in known:
                        raise ValueError(f"no reader for {kind or 'this type'}")
                    metadata, parts = known[kind](bytes(data))
                    listed = _listed(kind, parts)
                    rows.append((uri, kind, {k: str(v) for k, v in metadata.items() if v}, listed, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((uri, kind, {}, [], f"Failed to read {kind or 'file'}: {e}"))
            yield pd.DataFrame(rows, columns=["source_uri", "document_type", "metadata", "parts", "error"])

    typed = found.select("source_uri", document_type(F.col("source_uri")).alias("document_type"), "content")
    return typed.mapInPandas(run, f"source_uri string, document_type string, metadata map<string, string>, parts {PARTS}, error string")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def page_text(text: Column) -> Column:
    """Lines trimmed, blank ones dropped."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), chunking.LINE_END), _stripped)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: What an empty document of a type is told.
_EMPTY = {"docx": "the document has no text", "pdf": "no page has text, the file may need OCR"}


def parse_results(read: DataFrame) -> DataFrame:
    """Parse results of `read_files`: joined content, title, status and errors.

    Markdown succeeds even when empty; other types need text. Errors with some text make a result partial.
    """
    clean = F.transform("parts", lambda p: F.when(F.col("document_type") == "pdf", page_text(p["text"])).otherwise(p["text"]))
    texts = F.filter(clean, lambda t: t.isNotNull() & (t != ""))
    content = F.array_join(texts, "\n\n")
    errors = F.concat(F.filter(F.transform("parts", lambda p: p["error"]), lambda e: e.isNotNull()), F.filter(F.array("error"), lambda e: e.isNotNull()))
    headings = F.filter("parts", lambda p: p["level"] == 1)
    title = F.when(F.col("document_type") == "docx", F.get(headings, F.lit(0))["text"]).when(F.col("document_type") == "markdown", F.nullif(_stripped(F.regexp_extract(content, rf"(?m)^[{BLANK}]*#{{1,6}} (.*[^{BLANK}].*)$", 1)), F.lit(""))).otherwise(F.col("metadata")["title"])
    rows = read.select("source_uri", "document_type", title.alias("title"), content.alias("content"), "metadata", errors.alias("errors"), "parts", F.col("error").isNotNull().alias("_broken"))
    empty = F.create_map(*[F.lit(x) for kv in _EMPTY.items() for x in kv])[F.col("document_type")]
    bare = (F.col("content") == "") & (F.size("errors") == 0) & empty.isNotNull()
    rows = rows.withColumn("errors", F.when(bare, F.array(empty)).otherwise(F.col("errors")))
    own = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("parser").alias("k"), F.create_map(*[F.lit(x) for kv in PARSERS.items() for x in kv])[F.col("document_type")].alias("v")),
        F.struct(F.lit("page_count").alias("k"), F.when((F.col("document_type") == "pdf") & ~F.col("_broken"), F.size("parts").cast("string")).alias("v")),
    ), lambda e: e["v"].isNotNull()))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("parser", "page_count"))
    rows = rows.withColumn("metadata", F.map_concat(kept, own))
    return rows.withColumn("status", status(F.col("content") != "", F.size("errors") > 0, (F.col("document_type") == "markdown") & ~F.col("_broken"))).drop("_broken")


def status(has_text: Column, has_errors: Column, may_be_empty: Column | None = None) -> Column:
    fine = ~has_errors if may_be_empty is None else ~has_errors & (has_text | may_be_empty)
    return F.when(fine, "succeeded").when(has_text, "partial").otherwise("failed")


def _own_offsets(rows: DataFrame, splitter: str) -> DataFrame:
    """`rows` with content_hash, splitter and offsets that are the chunk's own."""
    return rows.withColumns({"content_hash": content_hash(F.col("content")), "splitter": F.lit(splitter), "start_char": F.lit(0), "end_char": F.length("content")})


def page_chunks(results: DataFrame) -> DataFrame:
    """document_id (the uri), page_number, end_page_number, chunk_index, chunk_count, content and its hash, splitter and offsets of PDF results: one chunk for each page with text.

    The index counts pages without text too, the count leaves out failed ones.
    """
    ok = F.filter("parts", lambda p: p["error"].isNull())
    rows = results.where("document_type = 'pdf'").select(F.col("source_uri").alias("document_id"), F.size(ok).alias("chunk_count"), F.posexplode(ok).alias("chunk_index", "_p"))
    rows = rows.select("document_id", F.col("_p.no").alias("page_number"), F.col("_p.no").alias("end_page_number"), "chunk_index", "chunk_count", page_text(F.col("_p.text")).alias("content")).where("content <> ''")
    return _own_offsets(rows, PARSERS["pdf"])


def paragraph_chunks(results: DataFrame) -> DataFrame:
    """Chunks of DOCX results: one for each paragraph, with the path of headings above it, its hash, splitter and own offsets."""
    rows = results.where("document_type = 'docx'").select(F.col("source_uri").alias("document_id"), F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("chunk_index", "_p"))
    rows = chunking.heading_paths(rows, "document_id", "chunk_index", F.when(F.col("_p.level") > 0, F.col("_p.level")), F.col("_p.text"))
    return _own_offsets(rows.select("document_id", "chunk_index", "chunk_count", "section_path", F.col("_p.text").alias("content")), PARSERS["docx"])


def section_chunks(results: DataFrame) -> DataFrame:
    return chunking.markdown_sections(results.where("document_type = 'markdown'").select(F.col("source_uri").alias("document_id"), "content"))


def structured_chunks(markdown: DataFrame) -> DataFrame:
    """One Markdown chunk for each file converted by the caller: from (source_uri, markdown, error) to source_uri, status, errors, content and its hash, splitter, offsets."""
    text = F.regexp_replace(F.coalesce("markdown", F.lit("")), rf"^[{BLANK}]+|[{BLANK}]+$", "")
    errors = F.when(F.col("error").isNotNull(), F.array("error")).when(text == "", F.array(F.lit("the conversion gave no text"))).otherwise(F.expr("cast(array() as array<string>)"))
    content = F.when(F.col("error").isNull(), text).otherwise(F.lit(""))
    rows = markdown.select("source_uri", F.when(F.size(errors) == 0, "succeeded").otherwise("failed").alias("status"), errors.alias("errors"), content.alias("content"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"))
    return _own_offsets(rows, "StructuredPdfParser")


def ocr_results(pages: DataFrame) -> DataFrame:
    """source_uri, content, status, errors, ocr_page_count from OCR pages (source_uri, page_number, text, status, confidence, errors). Texts stay as they were read."""
    ok = (F.col("status") == "succeeded") & (F.coalesce("text", F.lit("")) != "")
    rows = pages.groupBy("source_uri").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("page_number", F.col("text").alias("t"))))), lambda p: p["t"]), "\n\n").alias("content"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("errors", F.expr("cast(array() as array<string>)")).alias("e")))), lambda p: p["e"])).alias("errors"),
        F.count("*").alias("ocr_page_count"),
    )
    return rows.select("source_uri", "content", status(F.col("content") != "", F.size("errors") > 0, F.lit(False)).alias("status"), "errors", "ocr_page_count")


def ocr_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of the pages that were read, with their hash, splitter and offsets; index and count over those, empty ones included."""
    by = Window.partitionBy("source_uri")
    rows = pages.where("status = 'succeeded'").select("source_uri", "page_number", F.col("page_number").alias("end_page_number"), F.coalesce("text", F.lit("")).alias("content"), (F.row_number().over(by.orderBy("page_number", "text")) - 1).alias("chunk_index"), F.count("*").over(by).cast("int").alias("chunk_count"))
    return _own_offsets(rows.where("content <> ''"), "OcrDocumentParser")


def _line_number(path: str, line: str) -> int | None:
    """The number of the first such line of a file that this machine can open."""
    try:
        with open(unquote(urlparse(path).path), encoding="utf-8") as file:
            return next((n for n, x in enumerate(file, 1) if x.rstrip("\r\n") == line.rstrip("\r")), None)
    except OSError:
        return None


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema; blank lines are skipped, a malformed one fails the read with its number.

    Lines are read apart, in as many tasks as the files have splits; a file is only opened to count its lines when one is malformed.
    """

    @F.pandas_udf("boolean")
    def fine(faults):
        import pandas as pd

        for path, line in faults[faults["line"].notna()].itertuples(index=False):
            number = _line_number(path, line)
            raise ValueError(f"Invalid JSON on line {number}" if number else f"Invalid JSON: {line[:200]}")
        return pd.Series([True] * len(faults))

    lines = spark.read.text(path).select(F.col("value").alias("_l"), F.col("_metadata.file_path").alias("_p")).where(F.trim("_l") != "")
    parsed = lines.select("_l", "_p", F.from_json("_l", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    fault = F.when(F.col("r._corrupt").isNotNull(), F.struct(F.col("_p").alias("path"), F.col("_l").alias("line")))
    fault = F.struct(fault["path"].alias("path"), fault["line"].alias("line"))
    return parsed.where(fine(fault)).select("r.*").drop("_corrupt")


RETRIEVAL_CASES = "id string, query string, relevant_chunk_ids array<string>, rankings map<string, array<string>>"
GOLDEN_CASES = "id string, source_uri string, document_type string, parser string, expectation struct<min_chunk_count: int, required_text: array<string>, required_page_numbers: array<int>, required_section_paths: array<array<string>>, requires_table: boolean>, notes string"


def case_tables(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """qrels (case_id, chunk_id) and rankings (strategy, case_id, chunk_id, rank) of retrieval cases."""
    qrels = cases.select(F.col("id").alias("case_id"), F.explode("relevant_chunk_ids").alias("chunk_id"))
    ranked = cases.select(F.col("id").alias("case_id"), F.explode("rankings").alias("strategy", "_r")).select("strategy", "case_id", F.posexplode("_r").alias("_n", "chunk_id"))
    return qrels, ranked.select("strategy", "case_id", "chunk_id", (F.col("_n") + 1).alias("rank"))
