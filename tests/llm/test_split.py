import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from millrace.llm.split import cut_pattern, split_oversized

ENDINGS = [("\n\n",), ("\n",), (". ", "! ", "? ", "。", "！", "？"), (" ",)]


def brute(text, limit=1000, overlap=100):
    """The definition, position by position."""
    if len(text) <= limit:
        return []
    pieces, start = [], 0
    while len(text) - start > limit:
        end = None
        for endings in ENDINGS:
            fits = [e for e in range(start + overlap + 1, start + limit + 1) if text[:e].endswith(endings)]
            if fits:
                end = fits[-1]
                break
        end = end or start + limit
        pieces.append((start, end))
        start = end - overlap
    return [*pieces, (start, len(text))]


def pieces_of(spark, texts, limit, overlap):
    df = spark.createDataFrame([Row(document_id=str(i), content=t, start_char="clash") for i, t in enumerate(texts)], "document_id string, content string, start_char string")
    found = {str(i): [] for i in range(len(texts))}
    for r in split_oversized(df, limit=limit, overlap=overlap, with_text=False).collect():
        found[r.document_id].append((r.start_char, r.end_char))
    return [sorted(found[str(i)]) for i in range(len(texts))]


alphabet = st.sampled_from(list("ab \n.!?。！😀x"))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet, max_size=200), min_size=20, max_size=20))
def test_matches_the_definition(spark, texts):
    assert pieces_of(spark, texts, 30, 5) == [brute(t, 30, 5) for t in texts]


def test_long_runs_and_blanks_across_cuts(spark):
    texts = ["x" * 2500, "😀" * 2101, "a" * 999 + "\n\n" + "b" * 1500, ("w" * 899 + "\n\n") * 4, "", "short", " " * 1500, "é. " * 900]
    assert pieces_of(spark, texts, 1000, 100) == [brute(t) for t in texts]


def test_texts_of_very_many_pieces(spark):
    texts = ["ab c. d\n" * 1500, "x" * 25 * 256 + "y" * 5, "x" * (25 * 256 * 2 + 5), "ab c. d\n" * 8000]
    found = pieces_of(spark, texts, 30, 5)
    assert found[:3] == [brute(t, 30, 5) for t in texts[:3]]
    assert len(found[3]) > 2000 and found[3][-1][1] == len(texts[3]) and all(b[0] == a[1] - 5 for a, b in zip(found[3], found[3][1:]))


def test_text_tokens_nulls_and_repeats(spark):
    text = "one two. " * 30
    df = spark.createDataFrame([("a", text), ("a", text), ("b", None), (None, text)], "document_id string, content string")
    rows = split_oversized(df, limit=100, overlap=10).collect()
    assert {r.document_id for r in rows} == {"a", None}
    assert all(text[r.start_char : r.end_char] == r.content and len(r.content) <= 100 for r in rows)
    assert len([r for r in rows if r.document_id == "a"]) == len(brute(text, 100, 10))
    assert all(r.token_count > 0 for r in rows)
    assert split_oversized(df.limit(0)).count() == 0


def test_overlap_must_be_below_limit():
    with pytest.raises(ValueError):
        cut_pattern(10, 10)
