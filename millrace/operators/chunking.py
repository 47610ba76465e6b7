"""Splitters: documents to chunks.

Where a cut depends on the cut before it, an Arrow function finds offsets only,
in time linear in the text; contents, hashes and counts are derived from the
offsets by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import BLANK, PYTHON_TOKEN, content_hash, jaccard, sentence_units, term_set, token_count

#: Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "；", "; ", "，", ", ", " ")

SPANS = "array<array<int>>"


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[tuple[int, int]]:
    """Offsets of pieces of at most `size`, cut after ever finer separators, at last anywhere."""
    pieces = [(0, len(text))]
    for separator in separators:
        if all(b - a <= size for a, b in pieces):
            return pieces
        finer = []
        for a, b in pieces:
            if b - a <= size:
                finer.append((a, b))
                continue
            at = a
            while (hit := text.find(separator, at, b)) >= 0:
                finer.append((at, hit + len(separator)))
                at = hit + len(separator)
            if at < b:
                finer.append((at, b))
        pieces = finer
    return [(c, min(c + size, b)) for a, b in pieces for c in (range(a, b, size) if b - a > size else (a,))]


def recursive_spans(text: str, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS) -> list[list[int]]:
    """Offsets of the chunks of a text: pieces gathered while they fit, blanks trimmed off.

    A new chunk begins `overlap` before the end of the last one, or as late as its first piece demands.
    """
    if not text.strip():
        return []
    out, begin, end = [], None, 0

    def keep() -> None:
        part = text[begin:end]
        lead = len(part) - len(part.lstrip())
        if part.strip():
            out.append([begin + lead, begin + len(part.rstrip())])

    for a, b in _pieces(text, size, separators):
        if begin is None:
            begin = a
        elif b - begin > size:
            keep()
            begin = max(end - overlap, b - size, 0)
        end = b
    if begin is not None:
        keep()
    return out


def _check(size: int, overlap: int) -> None:
    if size < 1:
        raise ValueError("max_chars must be greater than 0")
    if not 0 <= overlap < size:
        raise ValueError("overlap_chars must be at least 0 and smaller than max_chars")


def recursive_offsets(text: Column, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS) -> Column:
    _check(size, overlap)

    @F.pandas_udf(SPANS)
    def run(texts):
        import pandas as pd

        return pd.Series([recursive_spans(t, size, overlap, separators) if t else [] for t in texts])

    return run(text)


def _described(df: DataFrame, splitter: str, role: str) -> DataFrame:
    return (
        df.withColumn("content_hash", content_hash(F.col("content")))
        .withColumn("token_count", token_count(F.col("content")))
        .withColumn("chunk_role", F.lit(role))
        .withColumn("splitter", F.lit(splitter))
        .withColumn("chunk_id", chunk_key(splitter, role))
    )


def chunk_key(splitter: str, role: str) -> Column:
    """A deterministic id, so that a repeated run upserts instead of doubling."""
    return F.sha2(F.concat_ws("|", F.col("document_id"), F.lit(splitter), F.lit(role), F.col("start_char").cast("string"), F.col("end_char").cast("string")), 256)


COLUMNS = ("chunk_id", "document_id", "content", "chunk_index", "chunk_count", "chunk_role", "splitter", "token_count", "start_char", "end_char", "content_hash")


def recursive(documents: DataFrame, size: int = 800, overlap: int = 120, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """Chunks of (document_id, content); blank documents have none."""
    spans = documents.select("document_id", F.col("content").alias("_t"), recursive_offsets(F.col("content"), size, overlap, separators).alias("_s"))
    rows = spans.select("document_id", "_t", F.size("_s").alias("chunk_count"), F.posexplode("_s").alias("chunk_index", "_p"))
    rows = rows.select("document_id", "chunk_index", "chunk_count", F.col("_p")[0].alias("start_char"), F.col("_p")[1].alias("end_char"), F.substring("_t", F.col("_p")[0] + 1, F.col("_p")[1] - F.col("_p")[0]).alias("content"))
    return _described(rows, "RecursiveSplitter", "standalone").select(*COLUMNS)


def parent_child(documents: DataFrame, parent_size: int = 1600, parent_overlap: int = 160, child_size: int = 400, child_overlap: int = 80, inherited: tuple[str, ...] = ()) -> DataFrame:
    """Parents and the children each is cut into; a child's offsets are the document's, its index and count those within its parent.

    Columns of `documents` named in `inherited` (page, section, tenant and the like) come with parents and children;
    a document must then have one row.
    """
    if child_size >= parent_size:
        raise ValueError("child_max_chars must be smaller than parent_max_chars")
    _check(child_size, child_overlap)
    parents = recursive(documents, parent_size, parent_overlap).withColumn("splitter", F.lit("ParentChildSplitter")).withColumn("chunk_role", F.lit("parent")).withColumn("chunk_id", chunk_key("ParentChildSplitter", "parent")).withColumn("parent_id", F.lit(None).cast("string"))
    cut = parents.select("document_id", F.col("chunk_id").alias("parent_id"), F.col("content").alias("_t"), F.col("start_char").alias("_at"), recursive_offsets(F.col("content"), child_size, child_overlap).alias("_s"))
    rows = cut.select("document_id", "parent_id", "_t", "_at", F.size("_s").alias("chunk_count"), F.posexplode("_s").alias("chunk_index", "_p"))
    start, end = F.col("_p")[0], F.col("_p")[1]
    rows = rows.select("document_id", "parent_id", "chunk_index", "chunk_count", (F.col("_at") + start).alias("start_char"), (F.col("_at") + end).alias("end_char"), F.substring("_t", start + 1, end - start).alias("content"))
    children = _described(rows, "ParentChildSplitter", "child")
    # siblings of overlapping parents may share offsets
    children = children.withColumn("chunk_id", F.sha2(F.concat_ws("|", "parent_id", "chunk_id"), 256))
    both = parents.select(*COLUMNS, "parent_id").unionByName(children.select(*COLUMNS, "parent_id"))
    return both.join(documents.select("document_id", *inherited), "document_id") if inherited else both


_ENDS = ".!?。！？\n"


def _units(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for i, c in enumerate(text):
        if c in _ENDS or i == len(text) - 1:
            part = text[at : i + 1]
            if part.strip():
                lead = len(part) - len(part.lstrip())
                out.append((at + lead, at + len(part.rstrip())))
            at = i + 1
    return out


def semantic_groups(text: str, size: int = 800, least: int = 160, overlap: int | None = None, threshold: float = 0.12) -> list[tuple[int, int, str, int, int | None]]:
    """start, end, content, chunk_index, chunk_count of the groups of a text's sentences.

    A sentence joins the group before it if the group stays within `size` and is below `least` or shares
    `threshold` of the terms. Sentences beyond `size` are cut recursively: their pieces count from 0 anew.
    """
    import re

    overlap = min(80, size // 10) if overlap is None else overlap
    pattern = re.compile(PYTHON_TOKEN)
    groups: list[list] = []  # start, end, parts, length, terms
    for a, b in _units(text):
        part = text[a:b]
        terms = {t.casefold() for t in pattern.findall(part)}
        if groups:
            g = groups[-1]
            both = len(g[4] | terms)
            near = len(g[4] & terms) / both if both and g[4] and terms else 0.0
            if g[3] + 1 + len(part) <= size and (g[3] < least or near >= threshold):
                g[1], g[3] = b, g[3] + 1 + len(part)
                g[2].append(part)
                g[4] |= terms
                continue
        groups.append([a, b, [part], len(part), terms])
    out: list[tuple[int, int, str, int, int | None]] = []
    for a, b, parts, length, _ in groups:
        content = "\n".join(parts)
        if length <= size:
            out.append((a, b, content, len(out), None))
            continue
        spans = recursive_spans(content, size, overlap)
        out += [(a + x, a + y, content[x:y], i, len(spans)) for i, (x, y) in enumerate(spans)]
    return out


def semantic(documents: DataFrame, size: int = 800, least: int = 160, overlap: int | None = None, threshold: float = 0.12) -> DataFrame:
    """Chunks of sentences that belong together, with `ordinal`, which unlike chunk_index only ever grows."""
    if not 0 <= threshold <= 1:
        raise ValueError("similarity_threshold must be between 0 and 1")
    if not 0 < least <= size:
        raise ValueError("min_chars must be greater than 0 and at most max_chars")

    @F.pandas_udf("array<struct<start_char: int, end_char: int, content: string, chunk_index: int, chunk_count: int>>")
    def run(texts):
        import pandas as pd

        names = ("start_char", "end_char", "content", "chunk_index", "chunk_count")
        return pd.Series([[dict(zip(names, g)) for g in semantic_groups(t, size, least, overlap, threshold)] if t and t.strip() else [] for t in texts])

    rows = documents.select("document_id", F.posexplode(run(F.col("content"))).alias("ordinal", "_c")).select("document_id", "ordinal", "_c.*")
    return _described(rows, "SemanticSplitter", "standalone").select(*COLUMNS, "ordinal")


def adjacent_similarity(documents: DataFrame) -> DataFrame:
    """document_id, unit, similarity of each sentence to the one before it, without leaving the JVM."""
    units = documents.select("document_id", F.posexplode(sentence_units(F.col("content"))).alias("unit", "_u")).withColumn("_w", term_set(F.col("_u")))
    before = F.lag("_w").over(Window.partitionBy("document_id").orderBy("unit"))
    return units.withColumn("_b", before).where("_b is not null").select("document_id", "unit", F.round(jaccard(F.col("_b"), F.col("_w")), 9).alias("similarity"))


HEADING = rf"^[{BLANK}]*(#{{1,6}}) (.*)$"
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def heading_paths(rows: DataFrame, part: str, order: str, level: Column, title: Column) -> DataFrame:
    """`rows` with section_path: the titles above each row of a `part` by `order`, its own last; level is null where there is no heading.

    A heading of level n replaces the path from its place n on, or is added to a shorter one. So its depth is the least of
    its level and one more than the depth before: with the headings counted, the count plus the least of (level - count)
    so far. A title stays in the path while it is the last one of its depth. All of that are running windows.
    """
    so_far = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_level", level).withColumn("_title", title).withColumn("_count", F.count("_level").over(so_far))
    depth = F.when(F.col("_level").isNotNull(), F.col("_count") + F.least(F.lit(0), F.min(F.when(F.col("_level").isNotNull(), F.col("_level") - F.col("_count"))).over(so_far)))
    rows = rows.withColumn("_depth", depth).withColumn("_now", F.last("_depth", ignorenulls=True).over(so_far))
    last = [F.last(F.when(F.col("_depth") == d, F.col("_title")), ignorenulls=True).over(so_far) for d in range(1, 7)]
    path = F.slice(F.array(*last), F.lit(1), F.coalesce(F.col("_now"), F.lit(0)).cast("int"))
    return rows.withColumn("section_path", path).drop("_level", "_title", "_count", "_depth", "_now")


def markdown_sections(documents: DataFrame) -> DataFrame:
    """document_id, chunk_index, chunk_count, section_path, content, content_hash, splitter of Markdown documents, cut at headings.

    A section begins with its heading line; text before the first has an empty path. See `heading_paths` for the
    path. Blank sections are dropped.
    """
    line = F.col("_l")
    lines = documents.select("document_id", F.posexplode(F.split("content", LINE_END)).alias("_n", "_l"))
    marks = lines.withColumn("_h", F.regexp_extract(line, HEADING, 1)).withColumn("_t", F.regexp_replace(F.regexp_extract(line, HEADING, 2), rf"^[{BLANK}]+|[{BLANK}]+$", ""))
    marks = marks.withColumn("_is", (F.col("_h") != "") & (F.col("_t") != ""))
    order = Window.partitionBy("document_id").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_section", F.sum(F.col("_is").cast("int")).over(order))
    sections = marks.groupBy("document_id", "_section").agg(
        F.array_sort(F.collect_list(F.struct("_n", "_l"))).alias("_ls"), F.max(F.when(F.col("_is"), F.struct(F.length("_h").alias("level"), F.col("_t").alias("title")))).alias("_head")
    )
    content = F.regexp_replace(F.array_join(F.col("_ls._l"), "\n"), rf"^[{BLANK}]+|[{BLANK}]+$", "")
    kept = heading_paths(sections, "document_id", "_section", F.col("_head.level"), F.col("_head.title")).withColumn("content", content).where("content <> ''")
    by = Window.partitionBy("document_id")
    return kept.select(
        "document_id", (F.row_number().over(by.orderBy("_section")) - 1).alias("chunk_index"), F.count("*").over(by).cast("int").alias("chunk_count"), "section_path", "content",
        content_hash(F.col("content")).alias("content_hash"), F.lit("MarkdownParser").alias("splitter"),
    )


def fixed(documents: DataFrame, size: int) -> DataFrame:
    """Windows of `size` characters, without any function beyond the built-in ones."""
    if size < 1:
        raise ValueError("max_chars must be greater than 0")
    count = F.ceil(F.length("content") / size).cast("int")
    rows = documents.where(F.length("content") > 0).select("document_id", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * size
    return rows.select("document_id", "chunk_index", start.alias("start_char"), F.least(start + size, F.length("content")).alias("end_char"), F.substring("content", start + 1, F.lit(size)).alias("content"))
