import pytest

from millrace.llm.markup import clean_markup, clean_text, markup_elements, parse

CASES = [
    ("# Title\n\nSome text.\n\n- one\n- two\n\n```python\n<b>x</b>\n# no\n```\n", {("markdown", "heading"), ("markdown", "list"), ("markdown", "code")}),
    ("Guide\n=====\n\nText `name_x` and more.", {("markdown", "heading"), ("markdown", "inline")}),
    ("See **this** or [that](a.html) and ![pic](b.png) ~~gone~~.", {("markdown", "inline")}),
    ("<h2 class='x'>\nHead\n</h2><ul>\n<li>a</li></ul><pre><code>== no ==\n- no</code></pre>", {("html", "heading"), ("html", "list"), ("html", "code")}),
    ("a&nbsp;&ndash; b <!-- ''x'' [[y]] -->", {("html", "inline")}),
    ("== Head ==\n* one\n** two\n# three\n<math>\\sum x_i</math> '''b''' <source lang='sql'>\nSELECT 1\n</source>", {("wiki", k) for k in ("heading", "list", "formula", "inline", "code")}),
    ("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n\\textbf{b} $a_1 = b$ \\begin{verbatim}\n$x$\n\\end{verbatim}", {("latex", k) for k in ("heading", "list", "formula", "inline", "code")}),
    ("The fee is $68 per seat, or $511 for a site.", set()),
    ("Share drive C:\\map\\lamp holds the 'old' copies. The 5' cable and the 6'' rack were listed as = 3 = equal. 6'' x", set()),
    ("Speeds were 5 < x < 27; R&D asked for A & B == C. 2 * 3 * 4, snake_case_name", set()),
    ("text\n- 12 -\n\nmore text here", set()),
    ("~~~\nnever closed\n<h1>x</h1>", {("markdown", "code")}),
    ("<pre>never closed, so plain", set()),
    (None, set()),
    ("  \n ", set()),
]


@pytest.mark.parametrize("text,elements", CASES)
def test_elements(text, elements):
    assert parse(text).elements == elements


def test_clean_keeps_structure():
    text = "<h2>Head</h2>\n<ul>\n<li>one &amp; two</li>\n</ul>\n<pre>\na < b\n</pre>\nSome <b>bold</b> text with \\(x^2\\) inside.\n"
    assert clean_text(text).split("\n") == ["## Head", "", "- one & two", "```", "a < b", "```", "Some bold text with $x^2$ inside."]
    assert clean_text("== Head ==\n# first item\n# second item\n'''b''' [[a|c]]") == "# Head\n- first item\n- second item\nb c"


def test_open_items_inherit_from_their_neighbours():
    assert parse("- one\n- two\n\n- three").elements == {("markdown", "list")}
    assert parse("It ended in the year\n4. Then it began again and the rest of the line goes on.").elements == set()


def test_the_nearer_neighbour_decides():
    text = "This is the running text of a document that goes on and on without any mark."
    blocks = [(b.text, b.label) for b in parse(f"- one\n- two\n\n- three\n\n- four\n\n{text}\n\n- five\n\n{text}").blocks if b.label != "blank"]
    assert [x for _, x in blocks] == ["list", "list", "list", "list", "text", "text", "text"]
    assert [b.label for b in parse(f"{text}\n- alone\n{text}").blocks] == ["text", "text", "text"]


def test_set_off_headings_and_items_are_blocks():
    html = [(b.label, b.markup, b.level, b.text) for b in parse("<h3>A <b>b</b></h3><ol><li>x<li>y</ol>").blocks if b.label != "blank"]
    assert [b[:3] for b in html] == [("heading", "html", 3), ("list", "html", 0), ("list", "html", 0)]
    latex = [(b.label, b.markup, b.text) for b in parse("\\subsection{S}\n\\begin{enumerate}\n\\item a\n\\item[z] b\n\\end{enumerate}").blocks if b.label in ("heading", "list")]
    assert latex == [("heading", "latex", "S"), ("list", "latex", "a"), ("list", "latex", "b")]


def test_tables_with_dirt(spark):
    rows = [("a", "# x"), ("a", "# x"), ("b", None), (None, "**bold**"), ("c", "")]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "document_id string, content string, markup string")
    assert sorted(map(tuple, markup_elements(df).collect()), key=str) == [("a", "markdown", "heading"), (None, "markdown", "inline")]
    assert sorted((r.document_id or "", r.clean or "") for r in clean_markup(df).collect()) == [("", "bold"), ("a", "# x"), ("a", "# x"), ("b", ""), ("c", "")]
    assert markup_elements(df.limit(0)).count() == 0


def test_very_long_text_is_linear():
    assert parse("word " * 400_000 + "$5 " * 2000).elements == set()
    assert parse("<pre> \\[ <!-- " * 50_000).elements == set()
    assert ("markdown", "inline") not in parse("*a " * 50_000).elements


def test_long_formulas_between_dollars():
    formula = "$" + " + ".join(f"a_{{{i}}} *x* [[y]]" for i in range(60)) + "$"
    assert len(formula) > 400 and parse(f"Let {formula} hold.").elements == {("latex", "formula")}
    assert ("latex", "formula") not in parse(formula[:-1] + "\n\nand more x$").elements
    assert parse("$5 " * 50_000 + "$x " * 50_000 + "y$ and $n$").elements == {("latex", "formula")}
