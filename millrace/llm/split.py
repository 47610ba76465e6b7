"""Splitting oversized texts at natural boundaries (problem 4).

Bounded-quantifier regex extraction. One regular expression consumes a text from
cut to cut: its alternatives are ordered by boundary strength, each a greedy
bounded run that must end right after the boundary (a lookbehind, which may also
see what lies before the cut it starts from), the last one plain characters. A
lookahead keeps cutting while more than the limit remains. Array functions turn
the run lengths into offsets; a piece starts `overlap` before the previous cut.
Everything stays in the JVM, one pass over each text, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Boundaries from strong to weak, as what must directly precede the cut.
BOUNDARIES = (r"\n\n", r"\n", r"[.!?] |[。！？]", r" ")

#: A token is one CJK character, a word with inner joins, or any other single non-blank character.
TOKEN = r"[一-鿿]|[A-Za-z0-9]+(?:[-_'][A-Za-z0-9]+)*|[^\s]"


def cut_pattern(limit: int = 1000, overlap: int = 100) -> str:
    """The Java pattern whose successive matches are the runs between cuts."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def run(least: int, most: int) -> str:
        return "|".join([*(f".{{{least},{most}}}(?<={b})" for b in BOUNDARIES), f".{{{most}}}"])

    first = f"\\A(?=.{{{limit + 1}}})(?:{run(overlap + 1, limit)})"
    later = f"(?!\\A)(?=.{{{limit - overlap + 1}}})(?:{run(1, limit - overlap)})"
    return f"(?s)(?:{first})|(?:{later})|.+"


def run_lengths(text: Column, limit: int = 1000, overlap: int = 100) -> Column:
    """ARRAY<INT> of the runs between cuts; one pass over the text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(cut_pattern(limit, overlap)), F.lit(0)), F.char_length)


def piece_offsets(runs: Column, overlap: int = 100, block: int = 256) -> Column:
    """ARRAY<STRUCT<start_char INT, end_char INT>>, end exclusive, in code points, from a column of run lengths.

    A fold copies what it has gathered at each step, so it runs over blocks: of runs for their sums, then of the sums,
    then within each block from where it begins. `runs` must be a column as it stands, since it is read several times.
    """
    count = F.ceil(F.size(runs) / block).cast("int")
    blocks = F.when(F.size(runs) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(runs, i * block + 1, block))).otherwise(F.expr("cast(array() as array<array<int>>)"))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n))
    onwards = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    begins = F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")), onwards, lambda acc: acc["all"])

    def step(acc: Column, n: Column) -> Column:
        start = F.greatest(acc["end"] - F.lit(overlap), F.lit(0))
        piece = F.struct(start.alias("start_char"), (acc["end"] + n).alias("end_char"))
        return F.struct((acc["end"] + n).alias("end"), F.concat(acc["pieces"], F.array(piece)).alias("pieces"))

    none = F.expr("cast(array() as array<struct<start_char: int, end_char: int>>)")
    return F.flatten(F.zip_with(blocks, begins, lambda b, at: F.aggregate(b, F.struct(at.alias("end"), none.alias("pieces")), step, lambda acc: acc["pieces"])))


def split_oversized(df: DataFrame, key: str = "document_id", text: str = "content", limit: int = 1000, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """The pieces of each text longer than `limit`: key, start_char, end_char and, with_text, piece_index, content, token_count.

    Texts within the limit, empty and null ones have no pieces. Pieces are
    untrimmed; each is at most `limit` long, and they cover the text. A repeated row
    counts once; other columns are ignored. A null key is kept as a key. Texts
    without any boundary are cut every `limit` characters.
    """
    long = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).where(F.char_length("__text") > limit)
    if not with_text:
        pieces = long.select("__key", run_lengths(F.col("__text"), limit, overlap).alias("__runs")).select("__key", F.inline(piece_offsets(F.col("__runs"), overlap)))
        return pieces.distinct().select(F.col("__key").alias(key), "start_char", "end_char")
    long = long.distinct().select("__key", "__text", run_lengths(F.col("__text"), limit, overlap).alias("__runs"))
    pieces = long.select("__key", "__text", F.posexplode(piece_offsets(F.col("__runs"), overlap)).alias("piece_index", "__at"))
    piece = F.expr("substring(__text, __at.start_char + 1, __at.end_char - __at.start_char)")
    return pieces.select(
        F.col("__key").alias(key), "piece_index", F.col("__at.start_char"), F.col("__at.end_char"), piece.alias("content"), F.regexp_count(piece, F.lit(TOKEN)).alias("token_count")
    )
