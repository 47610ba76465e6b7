"""Markup residue in text documents (problem 6).

Two-pass block rules over a document whose verbatim parts (code, formulas,
comments) are set aside first, since what stands inside them means nothing else.

Pass 1 decides blocks on their own evidence: headings and items that tags or commands
set off are lines of their own and need none; a line that carries a list or heading
mark is a list item or heading if its neighbouring lines or its shape bear that
out; running text is told from residue by stop-word density, length and link
density. What is short or stands alone stays open. Pass 2: an open line is residue if
its nearest decided neighbours are, and text else; then an open item is one if what
stands beside it is, blank lines aside, itself decided or just labelled; all else is text.

Headings and lists of all markups are those of the blocks that come out. Code and
formulas are the verbatim parts, inline marks are looked for in what is left.

Four markups are known: html, markdown, wiki and latex; five kinds of element:
heading, list, code, formula and inline.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent words that running text has and menus, lists of links and captions lack.
STOP_WORDS = frozenset(
    "the a an of to in and or for is are be it that this with as on by at from not we you will can if was were has have had do does but they their there its which who what when than then so "
    "no more some such only into out about up over after before all any each most other these those our your his her may must should would could been being "
    "der die das den dem des ein eine einen einem einer und oder für ist sind mit auf von zu im in nicht wir sie wenn dass es er ich als auch aus bei nach nur noch wird werden war waren "
    "haben hat kann sich über um vor durch wie so aber zum zur am bis ihre ihr sein seine keine mehr diese dieser dieses "
    "的 了 在 是 和 与 或 不 会 请 把 有 为 以 及 对 从 到 并 也 将 被 由 其 这 那".split()
)
MAX_LINK_DENSITY, LEAST_STOP_WORDS, SHORT = 0.4, 0.12, 60

_VERBATIM = re.compile(
    r"""(?P<fence>(?<![^\n ])(?P<ticks>`{3,}|~{3,})[^`\n]*$)
      | <(?P<tag>pre|code|syntaxhighlight|source|math|nowiki)\b[^<>\n]*>
      | \\begin\{(?P<env>(?:verbatim|lstlisting|minted|equation|align|gather|multline|displaymath|math|eqnarray)\*?)\}
      | (?P<open>\\\[|\\\(|\$\$)
      | (?P<dollar>(?<![\\\w$])\$(?=[^\s$]))
      | (?P<span>(?<!`)`{1,2}(?=[^`\n]))
      | (?P<comment><!--)
      | \\(?P<verb>verb|lstinline)\*?(?P<mark>[^\w\s*{])""",
    re.M | re.X | re.I,
)
#: Every verbatim part begins with one of these; looking for them first is several times quicker.
_VERBATIM_START = re.compile(r"[`~<\\$]")
_CLOSE = {"\\[": "\\]", "\\(": "\\)", "$$": "$$"}
_CODE_TAGS = {"pre": "html", "code": "html", "syntaxhighlight": "wiki", "source": "wiki"}
_CODE_ENVIRONMENTS = ("verbatim", "lstlisting", "minted")
#: What stands for a verbatim part in the remaining text.
HOLE = "\ufffc"

_HTML_HEADING = re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1\s*>", re.I | re.S)
_HTML_LIST = re.compile(r"<(?:ul|ol|dl|li)\b[^<>]*>\s*", re.I)
_HTML_INLINE = re.compile(r"<(?:a|span|b|i|em|strong|br|img|sup|sub|u|s|mark|font|small|abbr|cite|kbd|tt|del|ins|q|big|label|time)\b(?:\s[^<>]*)?/?>|</(?:a|span|b|i|em|strong|font)\s*>", re.I)
_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});")
_WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M)
_WIKI_INLINE = re.compile(r"(?<![^\s(（\ufffc>])'{2,5}(?=[^\s'])[^\n']*(?:'[^\n']+)*?(?<=[^\s'])'{2,5}(?!\w)|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|<ref\b[^<>]*>|\[https?://[^\s\]]+ [^\]\n]+\]", re.I)
_LATEX_HEADING = re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_LATEX_LIST = re.compile(r"\\begin\{(?:itemize|enumerate|description)\*?\}")
_LATEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?\s*")
_LATEX_INLINE = re.compile(r"~?\\(?:textbf|textit|texttt|textsc|textrm|textsf|emph|underline|cite[a-z]*|footnote|href|url|ref|eqref|label|mbox)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_MARKDOWN_INLINE = re.compile(
    r"(?<![*\w])\*{1,3}(?=[^\s*])[^*\n]+(?<=[^\s*])\*{1,3}(?![*\w])|(?<![_\w])_{1,3}(?=[^\s_])[^_\n]+(?<=[^\s_])_{1,3}(?![_\w])|~~(?=\S)[^~\n]+(?<=\S)~~"
    r"|!?\[[^\[\]\n]*\]\([^()\s]*(?:[ ]\"[^\"\n]*\")?\)|\[\^[^\]\s]+\]|<https?://[^<>\s]+>|(?<!\[)\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\])"
)
_MARKDOWN_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_ITEM = re.compile(r"^\s*(?:([*#:;]{1,6})(?=[ \t])|([-+])(?=[ \t])|(\d{1,9})[.)](?=[ \t]))[ \t]+(\S.*)$")
_PAGE_NUMBER = re.compile(r"^\s*-\s*[\divxlcIVXLC]{1,6}\s*-\s*$")
_UNDERLINE = re.compile(r"^(?:={3,}|-{3,})[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*\b[^<>]*>")
_ANY = re.compile(r"[<&`$\\*_~\[{#]")
_ANY_LINE = re.compile(r"^(?:==|--|\s*[-+:;] |\s*\d+[.)] )|''", re.M)


@dataclass
class Block:
    """A line or verbatim part. label: heading, list, code, formula, text, residue, or open until pass 2."""

    text: str
    label: str
    markup: str = ""
    could: str = ""
    level: int = 0
    lines: int = 1


@dataclass
class Parsed:
    blocks: list[Block] = field(default_factory=list)
    elements: set[tuple[str, str]] = field(default_factory=set)


#: A heading (with its level) or item that tags (h) or commands (l) set off, on a line of its own.
_SET_OFF = re.compile(r"\x01(?P<kind>[hl])(?:(?P<level>\d)|i)(?P<text>.*)$", re.S)
_CLOSING_DOLLAR = re.compile(r"(?<=[^\s\\$])\$(?![\d$])")


def _set_aside(text: str, elements: set[tuple[str, str]]) -> tuple[str, list[Block]]:
    """The text with a HOLE for each verbatim part, and the parts."""
    out, parts, at, look = [], [], 0, 0
    paragraph, dollar, plain = -1, None, -1  # end of the paragraph with the last dollar, the next closing one in it
    unclosed: set[str] = set()  # marks that are not closed from here on: not looked for again
    while first := _VERBATIM_START.search(text, look):
        m = _VERBATIM.match(text, first.start())
        if not m or m["fence"] and text[text.rfind("\n", 0, m.start()) + 1 : m.start()] not in ("", " ", "  ", "   "):
            look = first.end()
            while m and look < m.end() and text[look] in "`~":
                look += 1
            continue
        start, begin = m.start(), m.end()
        kind = (m["tag"] or m["env"] or m["open"] or m["comment"] or "").lower()
        if kind and kind in unclosed:
            look = begin
            continue
        end = stop = -1
        label, markup = "code", "markdown"
        if m["fence"]:
            close = re.compile(rf"^ {{0,3}}{re.escape(m['ticks'][0])}{{{len(m['ticks'])},}}[ \t]*$", re.M).search(text, begin)
            end, stop = (close.start(), close.end()) if close else (len(text), len(text))
        elif m["tag"]:
            tag = m["tag"].lower()
            close = re.compile(rf"</{tag}\s*>", re.I).search(text, begin)
            if close:
                end, stop = close.span()
            label, markup = ("formula", "wiki") if tag == "math" else ("inline", "wiki") if tag == "nowiki" else ("code", _CODE_TAGS[tag])
        elif m["env"]:
            closing = f"\\end{{{m['env']}}}"
            end = text.find(closing, begin)
            stop = end + len(closing)
            label, markup = ("code" if m["env"].rstrip("*").lower() in _CODE_ENVIRONMENTS else "formula"), "latex"
        elif m["open"]:
            closing = _CLOSE[m["open"]]
            end = text.find(closing, begin)
            stop, label, markup = end + len(closing), "formula", "latex"
            if end < 0:
                unclosed.add(kind)
            elif (not text[begin:end].strip() or "\n\n" in text[begin:end]):
                end = -1
        elif m["dollar"]:
            if begin > paragraph:
                paragraph = text.find("\n\n", begin)
                paragraph = len(text) if paragraph < 0 else paragraph
                dollar = _CLOSING_DOLLAR.search(text, begin, paragraph)
            elif dollar and dollar.start() < begin:
                dollar = _CLOSING_DOLLAR.search(text, begin, paragraph)
            # what was plain from an earlier dollar to this one isn't read again, unless a single letter is left
            if dollar and (dollar.start() != plain or dollar.start() - begin == 1):
                if re.search(r"[\\^_=<>+{}]|^[A-Za-z]$", text[begin : dollar.start()]):
                    end, stop = dollar.span()
                else:
                    plain = dollar.start()
            label, markup = "formula", "latex"
        elif m["span"]:
            close = re.compile(rf"(?<!`){m['span']}(?!`)").search(text, begin)
            if close and "\n" not in text[begin : close.start()]:
                end, stop = close.span()
            label = "inline"
        elif m["comment"]:
            end = text.find("-->", begin)
            stop, label, markup = end + 3, "inline", "html"
        else:
            end = text.find(m["mark"], begin)
            stop, markup = end + 1, "latex"
            if "\n" in text[begin:end]:
                end = -1
        if end < 0:  # never closed: the mark is ordinary text
            if kind and not m["open"]:
                unclosed.add(kind)
            look = begin
            continue
        elements.add((markup, label))
        content = text[begin:end].strip("\n") if label == "code" else text[begin:end].strip()
        if m["tag"] and markup == "html":
            content = html.unescape(_TAG.sub("", content) if re.match(r"\s*<code\b", content, re.I) else content)
        parts.append(Block("" if m["comment"] else content, label, markup, lines=content.count("\n") + 1))
        out.append(text[at:start].replace(HOLE, " ") + HOLE)
        at = look = stop
    out.append(text[at:].replace(HOLE, " "))
    return "".join(out), parts


def _stop_density(line: str) -> float:
    """Share of stop words among the words."""
    words = _WORD.findall(line.lower())
    han = sum("一" <= c <= "鿿" for c in line)
    stops = sum(w in STOP_WORDS for w in words) + sum(c in STOP_WORDS for c in line) * (han > 0)
    return stops / max(1, len(words) + han // 4)


def _link_density(line: str) -> float:
    """Share of the characters inside links."""
    return sum(len(x) for x in re.findall(r"\[\[?([^\[\]\n]*)\]\]?|<a\b[^<>]*>([^<>]*)</a>", line) for x in x) / max(1, len(line))


def _first_pass(text: str, parts: list[Block], elements: set[tuple[str, str]]) -> list[Block]:
    wiki = bool(_WIKI_HEADING.search(text))
    holes = iter(parts)
    blocks: list[Block] = []
    lines = text.split("\n")
    kind = []  # of each line's mark: the family of items it belongs to
    for line in lines:
        m = None if _PAGE_NUMBER.match(line) else _ITEM.match(line)
        kind.append((m[1][0] if m[1] else m[2] or "0", m[3], m[4]) if m else None)
    for i, line in enumerate(lines):
        here = [next(holes) for _ in range(line.count(HOLE))]
        whole = [b for b in here if b.label in ("code", "formula")]
        if here and not line.replace(HOLE, "").strip():
            blocks.extend(here)
            continue
        shown = line
        for b in here:
            shown = shown.replace(HOLE, f"${b.text}$" if b.label == "formula" else f"`{b.text}`" if b.label == "code" else b.text, 1)
        if not line.strip():
            blocks.append(Block("", "blank"))
            continue
        if m := _SET_OFF.match(shown):
            blocks.append(Block(m["text"], "heading" if m["level"] else "list", "latex" if m["kind"] == "l" else "html", level=int(m["level"] or 0)))
            continue
        if m := _WIKI_HEADING.match(line):
            blocks.append(Block(m[2], "heading", "wiki", level=len(m[1]) - 1))
            continue
        if _UNDERLINE.match(line) and blocks and blocks[-1].label in ("text", "open") and blocks[-1].text.strip() and kind[i - 1] is None and len(blocks[-1].text) <= 200:
            blocks[-1] = Block(blocks[-1].text, "heading", "markdown", level=1 if line[0] == "=" else 2)
            continue
        mark = kind[i]
        heading = None if wiki else _MARKDOWN_HEADING.match(line)
        if heading:
            # a long sentence after a single # is an item of an ordered list whose wiki headings are lost
            follows = heading[1] == "#" and any(k and k[0] == "#" for k in (kind[i - 1] if i else None, kind[i + 1] if i + 1 < len(lines) else None))
            if follows and len(heading[2]) > SHORT and _stop_density(heading[2]) >= LEAST_STOP_WORDS:
                blocks.append(Block(shown.strip("# \t"), "list", "wiki"))
            else:
                blocks.append(Block(heading[2] if HOLE not in heading[2] else shown.strip("# \t"), "heading", "markdown", level=len(heading[1])))
            continue
        if mark:
            family, number, body = mark
            near = [k for k in ((kind[i - 1] if i else None), (kind[i + 1] if i + 1 < len(lines) else None)) if k]
            same = any(k[0] == family and (family != "0" or abs(int(k[1]) - int(number)) <= 1) for k in near)
            markup = "wiki" if wiki or family in "#:;" else "markdown"
            item = Block(_ITEM.match(shown)[4] if _ITEM.match(shown) else body, "list" if same else "open", markup, could="list")
            if family in ":;" and not wiki:
                item.label, item.could = "text", ""
            blocks.append(item)
            continue
        bare = _TAG.sub("", line) if "<" in line else line
        if len(bare) >= SHORT and "[" not in line and "<a" not in line:  # long and without links: the densities cannot matter
            blocks.append(Block(shown, "text"))
            continue
        stops = _stop_density(line)
        if _link_density(line) > MAX_LINK_DENSITY and len(bare) > 20 and stops < LEAST_STOP_WORDS:
            blocks.append(Block(shown, "residue"))
        elif len(bare) >= SHORT or stops >= LEAST_STOP_WORDS or whole:
            blocks.append(Block(shown, "text"))
        else:
            blocks.append(Block(shown, "open", could="text"))
    return blocks


def _second_pass(blocks: list[Block]) -> None:
    """Open blocks inherit from the nearest decided neighbours, blank lines aside; what has inherited counts as decided."""
    solid = [b for b in blocks if b.label != "blank"]
    decided = [i for i, b in enumerate(solid) if b.label != "open"]
    labels = [solid[i].label for i in decided]
    after = 0  # number of the first decided block that follows
    for b in solid:
        if b.label != "open":
            after += 1
        elif b.could != "list":
            near = labels[max(after - 1, 0) : after + 1]  # of one side only at the document's ends
            b.label = "residue" if near and all(x == "residue" for x in near) else "text"
    for way in (solid, solid[::-1]):
        for b, beside in zip(way[1:], way):
            if b.label == "open" and beside.label == "list":
                b.label = "list"
    for b in solid:
        if b.label == "open":
            b.label = "text"


def parse(text: str | None) -> Parsed:
    """Blocks of a text and the (markup, element) kinds that occur in it."""
    parsed = Parsed()
    if not text or not text.strip():
        return parsed
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    found = parsed.elements
    if not _ANY.search(text) and not _ANY_LINE.search(text):
        parsed.blocks = [Block(x, "text" if x.strip() else "blank") for x in text.split("\n")]
        return parsed
    rest, parts = _set_aside(text, found)
    if "<" in rest:
        if _HTML_INLINE.search(rest):
            found.add(("html", "inline"))
    if "&" in rest and _ENTITY.search(rest):
        found.add(("html", "inline"))
    if "\\" in rest:
        if _LATEX_INLINE.search(rest):
            found.add(("latex", "inline"))
    if ("''" in rest or "[[" in rest or "{{" in rest or "<ref" in rest or "[http" in rest) and _WIKI_INLINE.search(rest):
        found.add(("wiki", "inline"))
    plain = _WIKI_INLINE.sub(" ", rest) if "[[" in rest or "{{" in rest else rest
    if re.search(r"[*_~\]]", plain) and _MARKDOWN_INLINE.search(re.sub(r"(?m)^\s*[*#:;+-]+ ", "", plain)):
        found.add(("markdown", "inline"))
    # headings and items that tags or commands set off become lines of their own before the line rules
    lined = rest
    if "<" in rest:
        lined = _HTML_HEADING.sub(lambda m: f"\n\x01h{m[1]}{' '.join(m[2].split())}\n", lined) if "</h" in rest.lower() else lined
        lined = _HTML_LIST.sub("\n\x01hi", lined)
    if "\\" in rest:
        lined = _LATEX_HEADING.sub(lambda m: f"\n\x01l{_latex_level(m[0])}{m[1]}\n", lined)
        if _LATEX_LIST.search(lined):
            lined = _LATEX_ITEM.sub("\n\x01li", _LATEX_LIST.sub("\n\x01li", lined))
    parsed.blocks = _first_pass(lined, parts, found)
    _second_pass(parsed.blocks)
    found.update((b.markup, b.label) for b in parsed.blocks if b.label in ("heading", "list"))
    # what opens a list is none of its items
    parsed.blocks = [b for b in parsed.blocks if b.label != "list" or b.text.strip()]
    return parsed


def _latex_level(command: str) -> int:
    return {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}.get(command.strip("\\").split("{")[0].rstrip("* "), 5)


def _plain(text: str) -> str:
    """Inline marks removed, their words kept; entities resolved."""
    text = re.sub(r"</?(?:[A-Za-z][A-Za-z0-9]*)\b[^<>]*>", "", text)
    text = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?: \"[^\"\n]*\")?\)", r"\1", text)
    text = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", text)
    text = re.sub(r"\{\{[^{}\n]*\}\}|\[\^[^\]\s]+\]|~?\\(?:cite[a-z]*|label|ref|eqref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", text)
    text = re.sub(r"\\(?:textbf|textit|texttt|textsc|emph|underline|footnote|url|mbox|textrm|textsf)\*?\{([^{}\n]*)\}", r"\1", text)
    text = re.sub(r"(?<![*\w])(\*{1,3})(?=[^\s*])([^*\n]+)(?<=[^\s*])\1(?![*\w])", r"\2", text)
    text = re.sub(r"(?<![_\w])(_{1,3})(?=[^\s_])([^_\n]+)(?<=[^\s_])\1(?![_\w])|~~(?=\S)([^~\n]+)(?<=\S)~~", lambda m: m[2] or m[3], text)
    text = re.sub(r"(?<![^\s(（>])('{2,5})(?=[^\s'])([^\n]*?)(?<=[^\s'])\1(?!\w)", r"\2", text)
    text = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate|description|document|center|quote)\*?\}", "", text)
    return html.unescape(text) if "&" in text else text


def clean_text(text: str | None) -> str | None:
    """The text without markup residue; headings as `# `, items as `- `, code fenced, formulas between dollars. Null stays null."""
    if text is None:
        return None
    out: list[str] = []
    for b in parse(text).blocks:
        if b.label == "blank":
            if out and out[-1] != "":
                out.append("")
        elif b.label == "heading":
            out.append("#" * max(1, b.level) + " " + _plain(b.text).strip())
        elif b.label == "list":
            out.append("- " + _plain(b.text).strip())
        elif b.label == "code":
            fence = "`" * max([3, *(len(x) + 1 for x in re.findall(r"`{3,}", b.text))])
            out.append(f"{fence}\n{b.text}\n{fence}")
        elif b.label == "formula":
            out.append(f"${b.text}$")
        elif b.label != "residue":
            line = re.sub(r"[ \t]{2,}", " ", _plain(b.text)).strip()
            if line:
                out.append(line)
    return "\n".join(out).strip("\n")


def _over(df: DataFrame, key: str, text: str, schema: str, rows_of) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield rows_of(part.column(0), part.column(1).to_pylist())

    return df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def markup_elements(df: DataFrame, key: str = "document_id", text: str = "content") -> DataFrame:
    """key, markup, element: each kind that occurs in each text, once. Null and blank texts have none; a null key is kept."""

    def rows(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        found = [(i, *e) for i, t in enumerate(texts) for e in sorted(parse(t).elements)]
        at = pa.array([f[0] for f in found], pa.int64())
        return pa.RecordBatch.from_arrays([keys.take(at), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())], names=[key, "markup", "element"])

    kind = df.schema[key].dataType.simpleString()
    return _over(df, key, text, f"`{key}` {kind}, markup string, element string", rows).distinct()


def clean_markup(df: DataFrame, key: str = "document_id", text: str = "content", cleaned: str = "clean") -> DataFrame:
    """key and the cleaned text of each row; repeated rows stay repeated, null texts stay null, blank ones become empty."""

    def rows(keys: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([clean_text(t) for t in texts], pa.string())], names=[key, cleaned])

    kind = df.schema[key].dataType.simpleString()
    return _over(df, key, text, f"`{key}` {kind}, `{cleaned}` string", rows)
