"""Checks of rows: what is wrong with a chunk, a query or a stored payload, as data, and rows put aside by it.

A check never ends a job: it gives ARRAY<STRING> of faults, empty where there is none, so that a table can be split into
good rows and a quarantine in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import BLANK, search_terms

#: Kinds of chunks and their roles.
CHUNK_TYPES = ("text", "table", "image", "formula")
CHUNK_ROLES = ("standalone", "parent", "child")
#: Numbers of a chunk and the least each may be.
LEAST = {"page_number": 1, "end_page_number": 1, "chunk_index": 0, "chunk_count": 1, "token_count": 0, "start_char": 0, "end_char": 0}


def _faults(*rules: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(wrong, F.lit(text)) for wrong, text in rules]), lambda f: f.isNotNull())


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def chunk_faults() -> Column:
    """Faults of a row with the columns of a chunk: keys and sources that are missing, numbers out of range, ends before starts, unknown kinds."""
    return _faults(
        *[(_empty(c), f"{c} is missing") for c in ("chunk_id", "document_id", "source_uri")],
        (F.col("content").isNull(), "content is missing"),
        *[(F.col(c) < least, f"{c} is below {least}") for c, least in LEAST.items()],
        (F.col("end_page_number") < F.col("page_number"), "end_page_number is before page_number"),
        (F.col("end_char") < F.col("start_char"), "end_char is before start_char"),
        (~F.coalesce("chunk_type", F.lit("text")).isin(*CHUNK_TYPES), "chunk_type is unknown"),
        (~F.coalesce("chunk_role", F.lit("standalone")).isin(*CHUNK_ROLES), "chunk_role is unknown"),
    )


def query_faults(size: int = 64) -> Column:
    """Faults of a row (query_id, query, embedding, top_k): what a search would find nothing for, or cannot do."""
    blank = F.regexp_replace(F.coalesce("query", F.lit("")), f"[{BLANK}]", "") == ""
    return _faults(
        (_empty("query_id"), "query_id is missing"),
        (blank, "query is blank"),
        (~blank & (F.size(search_terms(F.coalesce("query", F.lit("")))) == 0), "query has no searchable term"),
        (F.coalesce(F.size("embedding"), F.lit(-1)) < 1, "embedding is missing"),
        ((F.size("embedding") >= 1) & (F.size("embedding") != size), f"embedding has not {size} values"),
        (F.coalesce("top_k", F.lit(0)) < 1, "top_k is not above 0"),
    )


def quarantine(rows: DataFrame, faults: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without faults, and the others with theirs in the column `faults`."""
    checked = rows.withColumn("faults", faults)
    return checked.where(F.size("faults") == 0).drop("faults"), checked.where(F.size("faults") > 0)


STRINGS = ("chunk_id", "document_id", "content", "source_uri", "chunk_type", "parent_id", "tenant_id", "content_hash", "chunk_role", "splitter")
#: What a payload that lacks a field means.
DEFAULTS = {"chunk_type": "text", "chunk_role": "standalone"}
_PAYLOAD = ", ".join([*(f"{c} string" for c in (*STRINGS, *LEAST)), "section_path array<string>", "has_table boolean", "metadata map<string, string>"])


def to_payload() -> Column:
    """A chunk's columns as the JSON that is stored beside its vector; nulls are left out."""
    return F.to_json(F.struct(*STRINGS, *LEAST, "section_path", "has_table", "metadata"))


def from_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns of a chunk from JSON, and `faults`: no payload, not JSON, a required field missing, a number that is none.

    Fields that are missing have their defaults; numbers may be written as text.
    """
    read = rows.withColumn("_p", F.from_json(F.col(payload), _PAYLOAD))
    number = lambda c: F.expr(f"try_cast(_p.{c} as int)")
    missing = F.col(payload).isNull()
    broken = ~missing & F.try_parse_json(F.col(payload)).isNull()
    faults = _faults(
        (missing, "there is no payload"),
        (broken, "payload is no JSON"),
        *[(~missing & ~broken & F.col(f"_p.{c}").isNull(), f"{c} is missing") for c in ("chunk_id", "document_id", "content", "source_uri")],
        *[(F.col(f"_p.{c}").isNotNull() & number(c).isNull(), f"{c} is no number") for c in LEAST],
    )
    return read.select(
        *[F.coalesce(F.col(f"_p.{c}"), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(f"_p.{c}").alias(c) for c in STRINGS],
        *[number(c).alias(c) for c in LEAST],
        F.coalesce("_p.section_path", F.expr("cast(array() as array<string>)")).alias("section_path"),
        F.coalesce("_p.has_table", F.lit(False)).alias("has_table"),
        F.coalesce("_p.metadata", F.expr("cast(map() as map<string, string>)")).alias("metadata"),
        faults.alias("faults"),
    )
