import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import scan

SENTENCES = [
    "The platform group recommends a persistent adapter for the former storage channel.",
    "Every well-known plan of the archive lists several long-term tasks for the operators.",
    "Operators in the reading room should verify that the access stage reports a valid state.",
    "Keep the long-term folder apart from the well-known one and ask the duty engineer first.",
]
SCHEMA = "chunk_id string, document_id string, page_number int, chunk_index int, splitter string, content string, title string"


def clean_text():
    rng = random.Random(1)
    return [" ".join(rng.choice(SENTENCES) for _ in range(12)) for _ in range(60)]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"t{i}", f"x{i}", None, i, "RecursiveSplitter", t, "clash") for i, t in enumerate(clean_text())]
    page1 = "The platforrn group recommends a persis-\ntent adapter for the former storage channel. Every well-\nknown plan of the archive lists several long-term tasks for the oper­\n1"
    page2 = "ANNUAL ACCESS REPORT\nators. Keep the long-term fo1der apart from the well-known one.\nHeading Of A Part\nAsk hq57vp and n3d6zc or INC-1234 first, 95 times.\n2"
    page3 = "ANNUAL ACCE5S REPORT\nOperators in the reading room should verify that the acccss stage rep¬\norts a valid state.\n\n3"
    rows += [(f"p{n}", "doc", n, n - 1, "OcrDocumentParser", t, "clash") for n, t in enumerate((page1, page2, page3), 1)]
    rows += [("p1", "doc", 1, 0, "OcrDocumentParser", page1, "clash"), ("p9", None, None, None, "PdfTextParser", "The storage channel\nPage 4 0f 9", ""), ("p8", "doc8", 1, 0, "PdfTextParser", None, "")]
    rows += [("p6", "doc6", 1, 0, "PdfTextParser", "cl" * 20000 + "\n" + "rn0" * 9000 + " " + "so " * 20000, "")]
    rows += [("p7", "doc7", 1, 0, "PdfTextParser", "", ""), (None, "doc7", 2, 1, "PdfTextParser", "x", "")]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("doc", None), ("doc", "Annual Access Report")], "document_id string, title string")


def test_defects(tables):
    found = sorted(map(tuple, scan.line_defects(*tables).collect()))
    assert found == sorted(
        [("p1", 1, "broken_word"), ("p1", 1, "misread"), ("p1", 3, "broken_word"), ("p1", 4, "furniture"), ("p2", 1, "furniture"), ("p2", 2, "misread"), ("p2", 5, "furniture")]
        + [("p3", 1, "furniture"), ("p3", 2, "broken_word"), ("p3", 2, "misread"), ("p3", 5, "furniture"), ("p9", 2, "furniture")]
    )


def test_paragraphs_are_continuous_and_repaired(tables):
    text = {r.document_id: [] for r in scan.page_paragraphs(*tables).collect()}
    rows = sorted(scan.page_paragraphs(*tables).where("document_id = 'doc'").collect(), key=lambda r: r.paragraph_no)
    whole = " ".join(r.content for r in rows)
    assert "doc" in text and "None" not in text
    assert whole.startswith("The platform group recommends a persistent adapter for the former storage channel. Every well-known plan")
    assert "tasks for the operators. Keep the long-term folder apart" in whole
    assert "the access stage reports a valid state." in whole and "REPORT" not in whole


def test_faults_in_the_rest_of_a_cut_word_are_its_lines(spark, tables):
    chunks, titles = tables
    page1 = "The platform group recommends a persis-\ntcnt adapter for the former storage channel. Every plan lists seve-"
    page2 = "ra1 long-term tasks for the operators."
    extra = spark.createDataFrame([("r1", "rest", 1, 0, "PdfTextParser", page1, ""), ("r2", "rest", 2, 1, "PdfTextParser", page2, "")], SCHEMA)
    found = sorted((r.chunk_id, r.line_no, r.defect) for r in scan.line_defects(chunks.unionByName(extra), titles).where("chunk_id like 'r%'").collect())
    assert found == [("r1", 1, "broken_word"), ("r1", 2, "broken_word"), ("r1", 2, "misread"), ("r2", 1, "misread")]


def test_page_numbers():
    for line in ("7", "[12]", "- 3 -", "Page 5 0f 5", "Pagc 5 of 6", "p. 3", "Seite 2 von 9", "3/5", "iv", "第3页", "385", "iii"):
        assert scan.is_page_number(line), line
    for line in ("", "copy.", "2.2 Notes on the log", "In 1999", "tasks 12", "May 5", "INC-1234"):
        assert not scan.is_page_number(line), line


def test_empty_table(tables):
    chunks, titles = tables
    assert scan.line_defects(chunks.limit(0), titles).count() == 0
    assert scan.page_paragraphs(chunks.limit(0), titles.limit(0)).count() == 0


def test_many_rare_words_hide_no_misread(spark, tables):
    chunks, titles = tables
    heads = [("persis", "tcnt"), ("plat", "forrn"), ("operat", "0rs"), ("stor", "agc"), ("engi", "ncer"), ("recom", "mcnds"), ("adap", "tcr"), ("chan", "ncl")]
    rows = []
    for i, (head, tail) in enumerate(heads):
        rows += [(f"h{i}", f"cut{i}", 1, 0, "PdfTextParser", f"Every plan lists the {head}-", ""), (f"r{i}", f"cut{i}", 2, 1, "PdfTextParser", f"{tail} and the former storage channel.", "")]
    word = F.translate(F.md5(F.concat_ws(".", F.col("id"), F.col("j")).cast("binary")), "0123456789", "ghijklmnop")
    filler = spark.range(1500).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(1000)))).groupBy("id").agg(F.array_join(F.collect_list(word), " ").alias("content"))
    filler = filler.selectExpr("'f' || id as chunk_id", "'f' as document_id", "null as page_number", "0 as chunk_index", "'RecursiveSplitter' as splitter", "content", "null as title")
    every = chunks.unionByName(spark.createDataFrame(rows, SCHEMA)).unionByName(filler)
    found = {(r.chunk_id, r.line_no) for r in scan.line_defects(every, titles).where("chunk_id like 'r%' and defect = 'misread'").collect()}
    assert found == {(f"r{i}", 1) for i in range(len(heads))}


def test_pages_ask_for_all_words_they_look_up(monkeypatch):
    class Seen(scan.Counts):
        def word(self, w):
            seen.add(w)
            return super().word(w)

    common = {w: 500 for t in SENTENCES for w in scan._WORD.findall(t.lower())}
    text = "The platforrn group re-\ncommends a persis-\ntcnt long-tcrm adapter for the for-\nmer well-kn0wn st0rage oper­"
    near = [(-1, ["x"], ["it was a chan-"]), (1, ["ators in the room"], ["y"])]
    seen = set()
    edges = scan.Edges.of(text, near, None, 2)
    scan.Page(text, edges, Seen(common, 10_000, scan.np.zeros((2, scan.PAIR_BUCKETS), int)))
    asked = scan._Asked(text, edges, scan.Counts(common, 10_000, scan.np.zeros((2, scan.PAIR_BUCKETS), int))).words
    assert "long-term" in seen and seen - asked <= set(common)


def test_what_is_known_depends_on_the_size_of_the_corpus():
    assert scan.least_known(1_000) == scan.least_known(2_000_000) == 4 and scan.least_known(26_000_000) == pytest.approx(39)


def test_misread_words_of_two_letters(spark, tables):
    chunks, titles = tables
    text = "The plan 0f the archive lists\nseveral tasks f0r the operators 1n the\nreading room, 7 days, v2 and 3d.\nOperators verify the state."
    rows = [("s1", "short", 1, 0, "PdfTextParser", text, "")]
    found = scan.line_defects(chunks.unionByName(spark.createDataFrame(rows, SCHEMA)), titles).where("chunk_id = 's1'").collect()
    assert sorted((r.line_no, r.defect) for r in found) == [(1, "misread"), (2, "misread")]
    paragraphs = scan.page_paragraphs(chunks.unionByName(spark.createDataFrame(rows, SCHEMA)), titles).where("document_id = 'short'").collect()
    assert "plan of the archive" in paragraphs[0].content and "operators in the" in paragraphs[0].content and "v2 and 3d" in paragraphs[0].content


def test_headers_of_several_lines_and_long_ones(spark, tables):
    chunks, titles = tables
    long = "Report of the archive on the state of the storage channel and of the access stage " * 3
    body = ["The platform group recommends a persistent adapter", "Keep the long-term folder apart from the others", "Operators verify that the access stage is valid"]
    rows = [(f"m{n}", "multi", n, n - 1, "PdfTextParser", f"{long}\nArchive Access Series\nPage {n}\n{body[n - 1]}\nand one more line for page {'abc'[n - 1]}.\nFooter of the series\n{n}", "") for n in (1, 2, 3)]
    found = scan.line_defects(chunks.unionByName(spark.createDataFrame(rows, SCHEMA)), titles).where("chunk_id like 'm%' and defect = 'furniture'").collect()
    assert len(long) > 219 and sorted((r.chunk_id, r.line_no) for r in found) == [(f"m{n}", i) for n in (1, 2, 3) for i in (1, 2, 3, 6, 7)]
    assert scan.is_furniture("x" * 300_000 + " " * 300_000 + "|" * 1000, None, ["y" * 300_000], "title", False) in (True, False)


def test_latin_words_in_chinese_lines(spark, tables):
    chunks, titles = tables
    text = "检索platforrn构建器，在archivc里。\nThe plan 0f the archive."
    found = scan.line_defects(chunks.unionByName(spark.createDataFrame([("z1", "z", 1, 0, "PdfTextParser", text, "")], SCHEMA)), titles).where("chunk_id = 'z1'").collect()
    assert sorted((r.line_no, r.defect) for r in found) == [(1, "misread"), (2, "misread")]


def test_words_with_many_odd_characters():
    counts = scan.Counts({"possibilities": 500}, 10_000, scan.np.zeros((2, scan.PAIR_BUCKETS), int))
    assert [w for w, _ in scan.candidates("p0551b1l1t1e5", counts)] == ["possibilities"]


def test_the_channel_learns_which_confusions_occur():
    assert scan.confusions_between("acccss", "access") == [("c", "e")] and scan.confusions_between("platforrn", "platform") == [("rn", "m")]
    assert scan.confusions_between("f0rrn", "form") == [] and scan.confusions_between("w1th0ut", "without") == [("1", "i"), ("0", "o")]
    channel = scan.learned_channel({("c", "e"): 900, ("o", "c"): 3}, {"the": 10_000, "access": 10_000})
    assert channel["c", "e"] > scan.log(scan.CONFUSION) > channel["o", "c"] >= scan.log(scan.CONFUSION * 0.9) - 1e-9


def test_whole_contents_and_pages_without_document(spark, tables):
    chunks, titles = tables
    content = "ANNUAL ACCESS REPORT\nThe platforrn group recommends a persis-\ntent adapter for the oper­\n\nANNUAL ACCE5S REPORT\nPage 2\nators in the reading room."
    rows = [("d", "T", content), ("d", None, content), ("d", "T", "The archive lists several tasks."), ("e", "T", None), (None, "T", "The plan 0f the archive."), ("g", "T", " \n ")]
    found = scan.document_paragraphs(spark.createDataFrame(rows, "document_id string, title string, content string"), chunks).collect()
    text = {}
    for r in sorted(found, key=lambda r: r.paragraph_no):
        text.setdefault((r.document_id, r.content_hash), []).append(r.content)
    assert sorted((k[0] or "", v) for k, v in text.items()) == [
        ("", ["The plan of the archive."]), ("d", ["The archive lists several tasks."]), ("d", ["The platform group recommends a persistent adapter for the operators in the reading room."]),
    ]
    alone = scan.page_paragraphs(chunks, titles).where("document_id is null").collect()
    assert [r.content for r in alone] == ["The storage channel"]


def test_pairs_of_all_rows_are_counted(spark, tables):
    chunks, titles = tables
    filler = [" ".join(f"{w}{c}" for w in ("east", "cast") for c in "abcdefghij")] * 3
    clean = ["They went to the east wing. "] * 600 + ["It has a cast iron gate. "] * 8 + filler
    pages = [("q1", "gate", 1, 0, "PdfTextParser", "We saw a cast iron gate\nbehind the cast wing.", "")]
    rows = [(f"w{i}", f"w{i}", None, 0, "RecursiveSplitter", t, "") for i, t in enumerate(clean)] + [("w", "w", None, 0, "RecursiveSplitter", None, "")]
    every = chunks.unionByName(spark.createDataFrame(rows + pages, SCHEMA))
    found = scan.line_defects(every, titles).where("chunk_id = 'q1'").collect()
    assert [(r.line_no, r.defect) for r in found] == [(2, "misread")]
    counts, _ = scan.corpus_counts(every)
    assert [counts.pair(*p) for p in (("the", "east"), ("east", "wing"), ("cast", "iron"), ("iron", "gate"), ("cast", "wing"), ("wing", "they"))] == [600, 600, 9, 9, 0, 0]
    assert list(counts.pairs[0]) == sorted(set(counts.pairs[0].tolist())) and counts.pairs[1].min() == 3


def test_pairs_passed_on_in_parts_are_counted_alike(spark, tables, monkeypatch):
    chunks = tables[0].unionByName(tables[0])
    at_once, _ = scan.corpus_counts(chunks.repartition(3))
    monkeypatch.setattr(scan, "PAIR_BUCKETS", 1)
    in_parts, _ = scan.corpus_counts(chunks.coalesce(1))
    assert at_once.pairs.tolist() == in_parts.pairs.tolist() and at_once.pairs.shape[1] > 20


def test_long_corpora_know_pairs_by_their_share(spark, tables, monkeypatch):
    chunks, _ = tables
    every, _ = scan.corpus_counts(chunks)
    monkeypatch.setattr(scan, "LEAST_SHARE", 0.01)
    some, _ = scan.corpus_counts(chunks)
    texts = [scan._WORD.findall((r.content or "").lower()) for r in chunks.collect()]
    limit = 0.01 * sum(max(len(t) - 1, 0) for t in texts)
    assert limit > 2 and sorted(some.pairs[1]) == sorted(n for n in every.pairs[1] if n > limit) != sorted(every.pairs[1])
