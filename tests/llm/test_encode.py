import base64
from pathlib import Path

import pytest
from tokenizers import Tokenizer

from millrace.llm.encode import DEFAULT_VOCABULARY, SpeculativeCodec, count_tokens, encode_texts, exact_merge, read_vocabulary

TEXTS = [
    None, "", "   ", "It's a test_case __x__, isn't it?", "x²y ½ⅷ a\x1cb  c\r\n\r\n\tend", "检索构建器在写入之前会校验每一批记录。", "Straße 😀👩‍👩‍👧 é é",
    "<|endoftext|> is text", "hq57vp n3d6zc 0123456789", "a" * 5000, "　\xa0  x", "supercalifragilisticexpialidocious " * 50,
]


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(str(Path(DEFAULT_VOCABULARY).parent / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_public_tokenizer(spark, public):
    df = spark.createDataFrame([(i, t, "keep", [1]) for i, t in enumerate(TEXTS)] + [(0, None, "keep", [1])], "doc_id long, text string, other string, ids array<int>")
    rows = encode_texts(df).collect()
    assert len(rows) == len(TEXTS) + 1 and set(rows[0].asDict()) == {"doc_id", "other", "ids"}
    for r in rows:
        assert r.ids == public(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    assert encode_texts(df.limit(0)).count() == 0


def test_round_trip_and_counts(spark, public):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = {int(b): base64.b64decode(a) for a, b in map(bytes.split, Path(DEFAULT_VOCABULARY).read_bytes().splitlines())}
    for r in encode_texts(df).collect():
        assert b"".join(back[i] for i in r.ids).decode() == (TEXTS[r.doc_id] or "")
    assert {r.doc_id: r.tokens for r in count_tokens(df).collect()} == {i: len(public(t)) for i, t in enumerate(TEXTS)}


def test_speculation_fails_only_where_merges_differ():
    codec = SpeculativeCodec(read_vocabulary(DEFAULT_VOCABULARY))
    words = ["testing", " tokenization", "ababababab", "检索构建器", "zzzzqqq"]
    ids, ends, failed = codec.encode_words(words)
    assert 0 <= failed <= len(words)
    for k, w in enumerate(words):
        assert ids[ends[k - 1] if k else 0 : ends[k]].tolist() == exact_merge(w.encode(), codec.ranks)
