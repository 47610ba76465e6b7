"""Scalar text functions: tokens, budgets, hashes and ids. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: What counts as blank, and the token patterns built on it. Java and RE2 read them alike.
BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|[^{BLANK}]"
TOKEN_POSSESSIVE = rf"[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]++(?:[-_'][A-Za-z0-9]++)*+|[^{BLANK}]"
SEARCH_TERM = r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"
PYTHON_TOKEN = r"[一-鿿]|[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|[^\s]"
PYTHON_SEARCH_TERM = r"[A-Za-z0-9_]+|[一-鿿]"
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def token_count(text: Column) -> Column:
    """Number of tokens: a CJK character, a word with inner joins, or another single character. Null for null."""
    return F.regexp_count(text, F.lit(TOKEN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def fits(text: Column, most: int) -> Column:
    """Whether the text has at most `most` tokens."""
    if most < 0:
        raise ValueError("max_tokens must be greater than or equal to 0")
    return token_count(text) <= most


def truncate(text: Column, most: int) -> Column:
    """The text up to its token number `most`; texts that fit stay as they are."""
    if most < 0:
        raise ValueError("max_tokens must be greater than or equal to 0")
    if most == 0:
        return F.when(text.isNotNull(), F.lit(""))
    prefix = F.regexp_extract(text, rf"^(?:[{BLANK}]*+(?:{TOKEN_POSSESSIVE})){{{most}}}+", 0)
    return F.when(token_count(text) <= most, text).otherwise(prefix)


def available_input_tokens(context: int, output: int, system: int = 0, prompt: int = 0) -> int:
    """Tokens left for retrieved text."""
    left = context - output - system - prompt
    if min(context, output, system, prompt) < 0 or left <= 0:
        raise ValueError("token budget leaves no room for input")
    return left


def allocate_per_chunk(available: Column | int, chunks: Column) -> Column:
    """An equal share of the budget for each chunk, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.lit(available) / chunks).cast("int")) if isinstance(available, int) else F.greatest(F.lit(1), F.floor(available / chunks).cast("int"))


def external_token_count(text: Column, counter: Callable[[list[str]], list[int]]) -> Column:
    """Counts by a tokenizer of the caller, called with a batch of texts; null counts as empty."""

    @F.pandas_udf("int")
    def count(texts):
        import pandas as pd

        return pd.Series(counter(["" if t is None else t for t in texts.tolist()]), dtype="int32")

    return count(text)


def external_fits(text: Column, counter: Callable[[list[str]], list[int]], most: int) -> Column:
    """Whether the text has at most `most` tokens of the caller's tokenizer."""
    if most < 0:
        raise ValueError("max_tokens must be greater than or equal to 0")
    return external_token_count(text, counter) <= most


def external_truncate(text: Column, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], most: int) -> Column:
    """The text of the first `most` tokens of the caller's tokenizer; texts that fit stay as they are, null stays null."""
    if most < 0:
        raise ValueError("max_tokens must be greater than or equal to 0")

    @F.pandas_udf("string")
    def cut(texts):
        import pandas as pd

        out = []
        for t in texts.tolist():
            ids = [] if t is None else encode(t)
            out.append(t if t is None or len(ids) <= most else decode(ids[:most]))
        return pd.Series(out, dtype=object)

    return cut(text)


def search_terms(text: Column) -> Column:
    """Lower-cased ASCII words and single CJK characters, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({SEARCH_TERM})"), F.lit(1)), F.lower)


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def point_id(key: Column) -> Column:
    """UUID version 5 of the key in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), key.cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    part = lambda start, n: F.substring(h, start, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def term_set(text: Column) -> Column:
    """Distinct lower-cased tokens, `ß` as `ss`."""
    return F.array_distinct(F.transform(tokens(text), lambda t: F.replace(F.lower(t), F.lit("ß"), F.lit("ss"))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sentence_units(text: Column) -> Column:
    """Trimmed sentences and lines, their end marks kept, blanks dropped."""
    units = F.regexp_extract_all(text, F.lit(r"([^.!?。！？\n]*[.!?。！？\n]|[^.!?。！？\n]+$)"), F.lit(1))
    return F.filter(F.transform(units, lambda u: F.regexp_replace(u, rf"^[{BLANK}]+|[{BLANK}]+$", "")), lambda u: u != "")


def token_offsets(text: Column) -> Column:
    """ARRAY<ARRAY<INT>>: start and end of each token, in code points."""

    @F.pandas_udf(ArrayType(ArrayType(IntegerType())))
    def spans(texts):
        import re

        import pandas as pd

        pattern = re.compile(PYTHON_TOKEN)
        return pd.Series([None if t is None else [[m.start(), m.end()] for m in pattern.finditer(t)] for t in texts])

    return spans(text)
