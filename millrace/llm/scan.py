"""Noise in text from scanned pages (problem 1).

Noisy-channel correction. What a word was meant to be is decoded by Viterbi over
the candidate words of a line: a candidate costs the probability of the character
confusions that turn it into what was read, and its likelihood in the corpus,
bigrams interpolated with unigrams. The channel is learned: a first decoding of all
pages, with equal confusions, counts which one stood for what; the second uses
those probabilities, shrunk towards the mean where there is little to go by (one step
of expectation maximisation). Corpus counts cover all rows. Words are counted
exactly: those above a share of the corpus are known words, of which there can only be
so many, and go to all tasks; the counts of the others are joined to the pages that
ask for them. Adjacent pairs are counted exactly too, by keys of 63 bits; those above
a share of all pairs go to all tasks, the others say no more than chance.

Line ends are part of the channel: a word cut at a line end is joined if the joined
word is likelier than the compound with its hyphen. Running headers, footers and
page numbers are edge lines, up to EDGE - 1 in a row, that recur on neighbouring pages,
number the page or repeat the title; a page only ever looks at the pages up to two
before and after it, which are fetched by an equi-join, so a document may have any
number of pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from hashlib import blake2b
from itertools import chain, islice
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable

SPLITTERS = ("OcrDocumentParser", "PdfTextParser")
#: A task passes its counts on when it holds more distinct pairs.
PAIR_BUCKETS = 1 << 18
#: A word is left alone unless a candidate is so many times likelier as this share of it.
CONFUSION = 0.02
#: How alike lines are that recur at an edge, and those behind other furniture.
LIKE, DEEP_LIKE = 0.78, 0.94
#: A word is known if it occurs more often than this, in a larger corpus than this share of it.
LEAST_COUNT, LEAST_SHARE = 4, 1.5e-6
#: A pair is no chance if it occurs more often than this, in a larger corpus than LEAST_SHARE of all pairs.
LEAST_PAIRS = 2
#: Longer runs without a blank are no words; longer lines are compared by their words, not their letters.
LONGEST_WORD, LONG_LINE = 60, 200
#: Lines at each edge of a page that are looked at: all but the last of them may be furniture.
EDGE = 4
#: So many readings of a word's odd characters are tried (only `1` has two).
MOST_FORMS = 4096
#: Candidates that are so many times too rare by themselves are still weighed in their line.
IN_CONTEXT = 4

#: Marks that stand for a hyphen at a line end.
HYPHENS = "-­‐‑¬"
#: What is read, and what it may have been.
CONFUSIONS = {
    "0": "o", "1": "li", "5": "s", "8": "b", "6": "b", "9": "g", "3": "e", "4": "a", "2": "z", "7": "t", "†": "t", "|": "l", "!": "i", "$": "s", "@": "a", "€": "e", "¢": "c",
    "c": "eo", "e": "co", "b": "h", "h": "b", "l": "it", "i": "lj", "o": "ca", "a": "o", "u": "nv", "n": "ur", "v": "yu", "y": "v", "f": "t", "t": "fl", "r": "n", "s": "5", "g": "q", "q": "g", "z": "2", "j": "i", "k": "l",
    "á": "a", "à": "a", "â": "a", "ä": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n", "ı": "i", "ß": "b",
    "rn": "m", "cl": "d", "ii": "u", "ri": "n", "vv": "w", "li": "h", "nn": "m", "m": ("rn", "nn"), "d": ("cl",), "w": ("vv",), "ln": "h", "iii": "m", "lc": "k", "tl": "d", "fi": "h", "rri": "m", "in": "m", "ni": "m", "ll": "u", "il": "u", "li": "uh", "ol": "d", "ci": "d", "ti": "h", "lt": "k", "ic": "k", "oe": "æ",
}

_WORD = re.compile(r"[^\W\d_一-鿿]+(?:-[^\W\d_一-鿿]+)*")
_ENTRY = re.compile(r"[^\s\"“”„«»()\[\]{}<>,;:?/\\]+")
_NO_HAN = re.compile(r"[^一-鿿]+")
# the two parts of a cut word; misread characters may be digits and signs
_TAIL = re.compile(r"([\w†|$@€¢]+(?:-[\w†|$@€¢]+)*)[-­‐‑¬]$")
_HEAD = re.compile(r"[\w†|$@€¢]+(?:-[\w†|$@€¢]+)*")
_DIGITS = r"[\dOolIS]{1,5}"
_ROMAN = r"[ivxlcIVXLC]{1,7}"
_NUMBER_LINE = re.compile(
    rf"^\W{{0,3}}\s*(?:(?P<word>[^\W\d_]{{1,6}})[.\s]{{0,2}}\s*)?(?P<n>{_DIGITS}|{_ROMAN})\s*(?:(?:/|\|)\s*{_DIGITS}|\s(?P<of>[^\W_]{{2,3}})\s+{_DIGITS})?\s*\W{{0,3}}$"
)
_CJK_NUMBER = re.compile(r"^\W{0,3}第?\s*\d{1,5}\s*[页頁](?:.{0,4}\d{1,5}\s*[页頁])?\W{0,3}$")


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")


class _Hashes(dict):
    """Word to its hash; starts anew when it holds very many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = _hash(word)
        return value


_hashes = _Hashes()


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _pair_key(a, b):
    """Key of two adjacent words, from their hashes (Python's numbers, or arrays of 64 bits)."""
    return (a * 0x9E3779B97F4A7C15 + b) & 0x7FFFFFFFFFFFFFFF


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each."""
    keys, of = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, of, n)
    return keys, sums


_STEP = log(CONFUSION)


class Counts:
    """Exact corpus counts of words and adjacent pairs.

    `common` has all known words, `rare` those others that the page at hand asks for. `pairs` has the keys of the pairs
    that are no chance, in order, and their counts.
    """

    def __init__(self, common: dict[str, int], total: int, pairs: np.ndarray, channel: dict[tuple[str, str], float] | None = None):
        self.common, self.pairs = common, pairs
        #: log probability that (what was read, what was meant); CONFUSION where nothing is known
        self.channel = channel or {}
        self.rare: dict[str, int] = {}
        self.total = max(float(total), 1.0)
        self.least = least_known(total)
        self.together: dict[int, int] = {}
        self.meant: dict[str, list[tuple[str, float]]] = {}

    def cost(self, read: str, meant: str) -> float:
        return self.channel.get((read, meant), _STEP)

    def word(self, w: str) -> int:
        return self.common.get(w) or self.rare.get(w, 0)

    def pair(self, a: str, b: str) -> int:
        """How often `b` follows `a`; 0 if no more often than by chance."""
        key = _pair_key(_hashes[a], _hashes[b])
        if key not in self.together:
            if len(self.together) > 300_000:
                self.together.clear()
            keys, n = self.pairs
            at = int(np.searchsorted(keys, key))
            self.together[key] = int(n[at]) if at < len(keys) and keys[at] == key else 0
        return self.together[key]

    def log_likelihood(self, previous: str | None, w: str) -> float:
        p = (self.word(w) + 0.05) / self.total
        if previous:
            before, together = self.word(previous), self.pair(previous, w)
            if before and together:
                p = 0.5 * p + 0.5 * min(1.0, together / before)
        return log(p)


def least_known(total: int) -> float:
    return max(LEAST_COUNT, LEAST_SHARE * total)


def corpus_counts(texts: DataFrame, text: str = "content") -> tuple[Counts, DataFrame]:
    """Counts of words (letters with inner hyphens, and the parts of such compounds) and adjacent pairs over all rows; word, n of all words.

    At most 1 / LEAST_SHARE words and as many pairs reach the driver.
    """

    def rows_of(words: list[str], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(words), 50_000):
            some = pa.array(words[at : at + 50_000], pa.string())
            yield pa.RecordBatch.from_arrays([some, pa.nulls(len(some), pa.int64()), pa.array(n[at : at + 50_000], pa.int64())], names=["word", "pair", "n"])

    def rows_of_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for keys, n in pairs:
            # the row without a key has the number of all
            some = pa.concat_arrays([pa.array(keys.astype(np.int64)), pa.nulls(1, pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), some, pa.array(np.append(n, n.sum()))], names=["word", "pair", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        numbers, hashes, counted = _Numbers(), np.empty(0, np.uint64), np.zeros(0, np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            yield from rows_of(list(numbers), counted)
            parts: dict[str, int] = {}
            for w, n in numbers.items():
                for p in w.split("-") if "-" in w else ():
                    parts[p] = parts.get(p, 0) + int(counted[n])
            yield from rows_of(list(parts), np.fromiter(parts.values(), np.int64, len(parts)))

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if len(numbers) > 500_000:
                    yield from words()
                    numbers, hashes, counted = _Numbers(), np.empty(0, np.uint64), np.zeros(0, np.int64)
                found = [_WORD.findall(t.lower()) if t else [] for t in batch.column(0).to_pylist()]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                known = len(numbers)
                seen = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
                if not len(seen):
                    continue
                fresh = list(islice(reversed(numbers), len(numbers) - known))[::-1]
                if fresh:
                    hashes = np.concatenate([hashes, np.fromiter(map(_hash, fresh), np.uint64, len(fresh))])
                    counted = np.concatenate([counted, np.zeros(len(fresh), np.int64)])
                counted += np.bincount(seen, minlength=len(numbers))
                of = np.repeat(np.arange(len(found)), sizes)
                adjacent = np.flatnonzero(of[1:] == of[:-1])
                pairs.append(np.unique(_pair_key(hashes[seen[adjacent]], hashes[seen[adjacent + 1]]), return_counts=True))
                if sum(len(keys) for keys, _ in pairs) > 2 * PAIR_BUCKETS:
                    pairs = [_summed(*map(np.concatenate, zip(*pairs)))]
                    if len(pairs[0][0]) > PAIR_BUCKETS:
                        yield from rows_of_pairs(pairs)
                        pairs = []
        yield from words()
        yield from rows_of_pairs(pairs)

    rows = texts.select(F.col(f"`{text}`")).mapInArrow(run, "word string, pair bigint, n bigint").groupBy("word", "pair").agg(F.sum("n").alias("n"))
    rows = durable(rows.where((F.col("n") > LEAST_PAIRS) | F.col("word").isNotNull() | F.col("pair").isNull()))
    words = rows.where("word is not null").select("word", "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    common = words.where(F.col("n") > least_known(total)).toArrow()
    of_pairs = rows.where("word is null")
    all_pairs = of_pairs.where("pair is null").agg(F.sum("n")).first()[0] or 0
    often = of_pairs.where(F.col("pair").isNotNull() & (F.col("n") > max(LEAST_PAIRS, LEAST_SHARE * all_pairs))).select("pair", "n").toArrow()
    pairs = np.stack([often["pair"].to_numpy(), often["n"].to_numpy()])
    return Counts(dict(zip(common["word"].to_pylist(), common["n"].to_pylist())), total, pairs[:, pairs[0].argsort()]), words


_ONE = {k: t for k, t in CONFUSIONS.items() if len(k) == 1}
_MORE = {k: t for k, t in CONFUSIONS.items() if len(k) > 1}
_BEGINS = {n: frozenset(k[0] for k in _MORE if len(k) == n) for n in (2, 3)}


def _swaps(word: str, start: int = 0) -> Iterator[tuple[int, str, str, str]]:
    """Where the next confusion may begin, the word with one undone, what was read and what was meant."""
    for i in range(start, len(word)):
        c = word[i]
        for t in _ONE.get(c, ()):
            yield i + len(t), word[:i] + t + word[i + 1 :], c, t
        for size, begins in _BEGINS.items():
            if c in begins and (read := word[i : i + size]) in _MORE:
                for t in _MORE[read]:
                    yield i + len(t), word[:i] + t + word[i + size :], read, t


def candidates(word: str, counts: Counts) -> list[tuple[str, float]]:
    """Known words that could have been read as `word`, with the log probability of the confusions.

    Characters that are no plain letters must all have been something else, then up to one letter,
    or two in long words without such characters.
    """
    odd = [i for i, c in enumerate(word) if not ("a" <= c <= "z" or c in "-äöüß")]
    accents = [i for i, c in enumerate(word) if c in "äöüß"]
    forms = {word: 0.0}
    for i in reversed(odd):
        forms = {w[:i] + t + w[i + 1 :]: cost + counts.cost(w[i], t) for w, cost in forms.items() for t in CONFUSIONS.get(w[i], "")}
        if len(forms) > MOST_FORMS:
            return []
    found: dict[str, float] = {}
    # so short a word is only looked for where a character is no letter
    shortest = 3 if word.replace("-", "").isalpha() else 2

    known = counts.common

    def offer(c: str, cost: float) -> None:
        if len(c) >= shortest and c != word and c.replace("-", "").isalpha():
            found[c] = max(cost, found.get(c, cost))

    if odd:
        for w, cost in forms.items():
            if w in known:
                offer(w, cost)
    if not found and (len(odd) <= 1 or accents):
        for w, cost in forms.items():
            for _, c, read, t in _swaps(w):
                if c in known:
                    offer(c, cost + counts.cost(read, t))
    if not found and not odd and len(word) >= 8:
        for i, w, read, t in _swaps(word):
            for _, c, other, u in _swaps(w, i):
                if c in known:
                    offer(c, counts.cost(read, t) + counts.cost(other, u))
    return list(found.items())


def confusions_between(read: str, meant: str) -> list[tuple[str, str]]:
    """The confusions that turn what was meant into what was read, as far as the table has them."""
    a = 0
    while a < min(len(read), len(meant)) and read[a] == meant[a]:
        a += 1
    b = 0
    while b < min(len(read), len(meant)) - a and read[-1 - b] == meant[-1 - b]:
        b += 1
    r, m = read[a : len(read) - b], meant[a : len(meant) - b]
    if m in CONFUSIONS.get(r, ()):
        return [(r, m)]
    return [(x, y) for x, y in zip(r, m) if x != y and y in CONFUSIONS.get(x, ())] if len(r) == len(m) else []


def learned_channel(seen: dict[tuple[str, str], int], common: dict[str, int], smoothing: float = 20.0, least: float = 0.9, most: float = 4.0) -> dict[tuple[str, str], float]:
    """Log probability of each confusion from how often it was decoded and how often what it stands for was written.

    CONFUSION is what they have on average; `smoothing` cases of the average are added to each, and none is less than `least`
    or more than `most` times as likely.
    """
    written: dict[str, int] = {}
    for t in {t for _, t in seen}:
        written[t] = sum(n * w.count(t) for w, n in common.items() if t in w)
    rate = sum(seen.values()) / max(sum(written[t] for _, t in seen), 1)
    out = {}
    for (read, meant), n in seen.items():
        ratio = (n + smoothing) / (written[meant] * rate + smoothing)
        out[read, meant] = log(CONFUSION * min(max(ratio, least), most))
    return out


def _cut_tail(line: str) -> re.Match | None:
    """The part of a word before a hyphen at the line's end; one look at the last run of characters."""
    line = line.rstrip()
    if not line.endswith(tuple(HYPHENS)):
        return None
    last = line.rsplit(None, 1)[-1] if not line[-1:].isspace() else ""
    return _TAIL.search(last) if len(last) <= LONGEST_WORD else None


def _wordlike(part: str) -> bool:
    """Whether a part of a cut word is mostly letters."""
    return 2 * sum(c.isalpha() for c in part) >= len(part.replace("-", "")) and any(c.isalpha() for c in part)


def _cores(line: str, begin: int) -> Iterator[tuple[int, str, bool]]:
    """Start of each word that ends after `begin`, the word without outer marks, and whether it is the line's last entry."""
    entries = [(m.start(), m[0]) for m in _ENTRY.finditer(line) if m.end() > begin]
    for k, (a, raw) in enumerate(entries):
        if a < begin:
            a, raw = begin, raw[begin - a :]
        core = raw.strip(".'’!…" + HYPHENS)
        if not core:
            continue
        at, last = a + raw.index(core), k == len(entries) - 1
        if core.isascii():
            yield at, core, last
            continue
        for m in _NO_HAN.finditer(core):  # Chinese runs have no confusions here, what stands between them has
            yield at + m.start(), m[0], last and m.end() == len(core)


def _skeleton(line: str) -> str:
    return " ".join(re.sub(r"[\W\d_]+", " ", line.lower()).split())


def _alike(a: str, b: str, like: float = LIKE) -> bool:
    if min(len(a), len(b)) < 4 or min(len(a), len(b)) < 0.7 * max(len(a), len(b)):
        return False
    if a == b:
        return True
    if max(len(a), len(b)) > LONG_LINE:  # the words they share, in linear time
        x, y = Counter(a.split()), Counter(b.split())
        return 2 * (x & y).total() >= like * (x.total() + y.total())
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    return matcher.quick_ratio() >= like and matcher.ratio() >= like  # the quick one is never below


def is_page_number(line: str) -> bool:
    """Whether a whole line numbers a page, allowing for misread characters."""
    line = line.strip()
    if not line:
        return False
    if _CJK_NUMBER.match(line) or re.fullmatch(rf"\W*{_ROMAN}\W*", line):
        return True
    m = _NUMBER_LINE.match(line)
    if not m:
        return False
    if m["word"] and not any(SequenceMatcher(None, m["word"].lower(), w).ratio() >= 0.66 for w in ("page", "seite", "p", "s", "blatt", "pg")):
        return False
    if m["of"] and not any(SequenceMatcher(None, m["of"].lower(), w).ratio() >= 0.5 for w in ("of", "von")):
        return False
    return any(c.isdigit() for c in line) or m["word"] is not None or line in ("O", "l", "I", "S")


def _title_like(line: str) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+", line) if len(w) > 3]
    return bool(words) and sum(w[0].isupper() for w in words) >= 0.75 * len(words) and not line.rstrip().endswith((".", "!", "?", ":", ",", ";")) and len(line) < 110


_PARTS = re.compile(r" *[|–—] *| {2,}")


def is_furniture(line: str, following: str | None, others: list[str], title: str | None, first_page: bool, deep: bool = False) -> bool:
    """Whether an edge line is a running header, footer or page number.

    `others` has lines at the same edge of the neighbouring pages, `following` the next line inside the page. A `deep`
    line, behind others at its edge, must number the page or recur nearly as it is, on two pages where there are so many.
    """
    if is_page_number(line):
        return True
    line, *others = [re.sub(r"\s", " ", re.sub(r"\s{2,}", "  ", x)) for x in (line, *others)]
    skeleton = _skeleton(line)
    if not skeleton or line.rstrip().endswith((".", "!", "?", ",", ";")):
        return False
    parts = [p for p in map(_skeleton, _PARTS.split(line)) if len(p) >= 4]
    several = "|" in line or "–" in line or "  " in line
    if deep:
        same = sum(_alike(skeleton, _skeleton(other), DEEP_LIKE) for other in others)
        return same >= min(2, max(1, len(others)))
    for other in others:
        if _alike(skeleton, _skeleton(other)):
            return True
        if several and any(_alike(p, q) for p in parts for q in map(_skeleton, _PARTS.split(other)) if len(p) >= 8):
            return True
    named = bool(title) and any(_alike(p, _skeleton(title)) for p in [skeleton, *parts])
    if re.search(r"\S ?[|] ?\S|\S +– +\S+ +– +\S", line) and _title_like(line.replace("–", " ").split("|")[0]):
        return True
    if re.search(r"^\d{1,4}  +\S|\S  +\d{1,4}$", line):
        return True
    if first_page:
        return False
    runs_on = bool(following) and following[:1].islower()
    return named or (runs_on and _title_like(line))


def edge_furniture(lines: list[str], near: list[list[str]], title: str | None, first_page: bool, inwards: bool = True) -> int:
    """How many of the lines at an edge, the outermost first, are furniture. `near` has the edges of other pages likewise."""
    numbered = False  # an edge has one page number
    for k, line in enumerate(lines[: EDGE - 1]):
        number = is_page_number(line)
        if number and numbered:
            return k
        numbered |= number
        following = lines[k + 1] if inwards and k + 1 < len(lines) else None
        others = [edge[min(k, len(edge) - 1)] for edge in near]
        if not is_furniture(line, following, others, title, first_page, deep=k > 0):
            return k
    return min(len(lines), EDGE - 1)


Near = list[tuple[int, list[str], list[str]]]


@dataclass(frozen=True)
class Edges:
    """Numbers of a page's furniture lines, the first running line of the next page and the last one of the page before."""

    furniture: frozenset[int]
    next_page: str | None = None
    last_page: str | None = None

    @staticmethod
    def of(text: str, near: Near, title: str | None, number: int | None) -> Edges:
        """`near` has how far away a page is and its edges, the outermost lines first."""
        lines = text.split("\n")
        furniture: set[int] = set()
        solid = [i for i, x in enumerate(lines) if x.strip()]
        first_page = number is None or number <= 1 and not any(d < 0 for d, _, _ in near)
        top = edge_furniture([lines[i] for i in solid[:EDGE]], [t for _, t, _ in near if t], title, first_page)
        furniture.update(solid[:top])
        rest = solid[top:] if top < len(solid) else []
        # one line of a page stays text, unless it is the only one
        under = rest[::-1][:EDGE] if len(solid) > 1 else []
        bottom = edge_furniture([lines[i] for i in under], [b for _, _, b in near if b], title, True, inwards=False)
        furniture.update(under[:bottom])
        own = [[lines[i]] for i in furniture]
        after = before = None
        for d, top, bottom in near:
            if d == 1 and top and after is None:
                others = [t for e, t, _ in near if e == 2 and t] + own
                after = top[min(edge_furniture(top, others, title, False), len(top) - 1)]
            if d == -1 and bottom and before is None:
                others = [b for e, _, b in near if e == -2 and b] + own
                before = bottom[min(edge_furniture(bottom, others, title, True, inwards=False), len(bottom) - 1)]
        return Edges(frozenset(furniture), after, before)


class Page:
    """The running lines of a page and its defects."""

    def __init__(self, text: str, edges: Edges, counts: Counts):
        self.counts = counts
        self.lines = text.split("\n")
        self.furniture = edges.furniture
        self.running = [i for i, x in enumerate(self.lines) if x.strip() and i not in self.furniture]
        self.next_page, self.last_page = edges.next_page, edges.last_page
        self.cut: dict[int, tuple[str, str, str]] = {}  # line: head, tail, joined word
        self.fixed: dict[int, list[tuple[int, int, str]]] = {}  # line: start, end, word meant (empty spans: part of a cut word)
        self.meant: dict[int, str] = {}  # line: what its cut word was meant to be
        self.read_as: list[tuple[str, str]] = []  # words read and meant
        self._join()
        self._correct()

    def _join(self) -> None:
        # a word cut at the end of the page before: what stands at this page's start is its rest
        self.carried_in: tuple[str, str] | None = None
        if self.running and self.last_page:
            before = _cut_tail(self.last_page)
            first = _HEAD.match(self.lines[self.running[0]].lstrip())
            if before and first and _wordlike(before[1]) and _wordlike(first[0]) and not first[0][:1].isupper():
                self.carried_in = (before[1], first[0])
        for i, line, first, rest in self._possible_cuts():
            head, tail = first.lower(), rest.lower()
            joined, compound = head + tail, f"{head}-{tail}"
            whole, parted = self._weight(joined), self._weight(compound)
            if line[-1] not in "-‐‑" and whole >= parted:
                cut = True  # a mark that only ever breaks words
            elif whole or parted:
                cut = whole > parted
            else:  # neither is known: two words make a compound, fragments a word
                pieces = [self.counts.word(head.rpartition("-")[2]), self.counts.word(tail.partition("-")[0])]
                cut = min(pieces) < 5 * self.counts.least
            if cut:
                self.cut[i] = (first, rest, first + rest)

    def _possible_cuts(self) -> Iterator[tuple[int, str, str, str]]:
        """Line numbers, lines and the two parts of what may be words cut at their ends."""
        for at, i in enumerate(self.running):
            line = self.lines[i].rstrip()
            after = self.lines[self.running[at + 1]].lstrip() if at + 1 < len(self.running) else (self.next_page or "").lstrip()
            m, n = _cut_tail(line), _HEAD.match(after)
            if not m or not n or not _wordlike(m[1]) or not _wordlike(n[0]):
                continue
            if after[:1].isupper():
                continue  # a compound of names, or a new sentence
            yield i, line, m[1], n[0]

    def _weight(self, word: str) -> int:
        """Its count, or that of a likely reading of it."""
        n = self.counts.word(word)
        if n > self.counts.least:
            return n
        return max([n, *(int(self.counts.word(c) * CONFUSION) for c, _ in self._doubtful(word))])

    def _correct(self) -> None:
        carried = self.carried_in[1] if self.carried_in else None  # the part of a cut word that the line begins with
        for at, i in enumerate(self.running):
            line = self.lines[i]
            begin = 0
            if carried:
                begin = len(line) - len(line.lstrip()) + len(carried)
            if at == 0 and self.carried_in:
                head, tail = self.carried_in
                if self._rest_misread(head, tail):
                    self.fixed.setdefault(i, []).append((begin - len(tail), begin - len(tail), ""))
            carried = self.cut[i][1] if i in self.cut else None
            states: list[list[tuple[str, float]]] = []
            spans = []
            for a, core, last in _cores(line, begin):
                word = core.lower()
                if i in self.cut and last:
                    word = self.cut[i][2].lower()
                spans.append((a, a + len(core)))
                states.append([(word, 0.0), *self._doubtful(word)])
            for (a, b), (observed, *_), meant in zip(spans, states, self._viterbi(states)):
                if meant == observed[0]:
                    continue
                self.read_as.append((observed[0], meant))
                if i in self.cut and observed[0] == self.cut[i][2].lower() and b >= len(line.rstrip()) - 1:
                    self.meant[i] = meant
                    head = len(self.cut[i][0])
                    if observed[0][:head] == meant[:head]:  # the fault is in the rest, on the next line
                        if at + 1 < len(self.running):
                            self.fixed.setdefault(self.running[at + 1], []).append((0, 0, ""))
                        continue
                self.fixed.setdefault(i, []).append((a, b, meant))

    def _rest_misread(self, head: str, tail: str) -> bool:
        """Whether a cut word's rest holds a misread character, the head being right."""
        word = (head + tail).lower()
        if self.counts.word(word) > self.counts.least or self.counts.word(f"{head}-{tail}".lower()) > self.counts.least:
            return False
        return any(c.startswith(head.lower()) and self.counts.word(c) * CONFUSION > self.counts.word(word) + 0.02 for c, _ in self._doubtful(word))

    def _doubtful(self, word: str) -> list[tuple[str, float]]:
        """Candidates for a word that may be misread; none for numbers, identifiers and words known well enough."""
        if len(self.counts.meant) > 300_000:
            self.counts.meant.clear()
        if word not in self.counts.meant:
            self.counts.meant[word] = self._readings(word)
        return self.counts.meant[word]

    def _readings(self, word: str) -> list[tuple[str, float]]:
        if not 2 <= len(word) <= LONGEST_WORD or word.isdigit():
            return []
        if re.fullmatch(r"\d[\d.,]*[olis]|\d[\d.,]*[ol][\d.,]+|[ol][\d.,]*\d[\d.,]*", word) and len(word) > 2:
            return [(word.translate(str.maketrans("olis", "0115")), 0.0)] if word[-1] != "s" else []
        letters = sum(c.isalpha() for c in word)
        if letters < 0.5 * len(word) or "." in word:
            return []
        n = self.counts.word(word) if word.replace("-", "").isalpha() else 0
        if n > 0 and len(word) < 3:
            return []
        parts = word.split("-")
        if n == 0 and len(parts) > 1 and all(p and self.counts.word(p) > 5 * self.counts.least for p in parts):
            return []
        # the line decides; only what no neighbour could make likelier is left out
        found = [(c, cost) for c, cost in candidates(word, self.counts) if self.counts.word(c) * CONFUSION * IN_CONTEXT > n + 0.02]
        if not found and len(parts) > 1:  # one part of a compound
            for at, p in enumerate(parts):
                if len(p) > 2 and self.counts.word(p) <= self.counts.least:
                    found += [("-".join([*parts[:at], c, *parts[at + 1 :]]), cost) for c, cost in candidates(p, self.counts) if self.counts.word(c) * CONFUSION > self.counts.word(p) + 0.02]
        return found

    def _viterbi(self, states: list[list[tuple[str, float]]]) -> list[str]:
        if all(len(s) == 1 for s in states):
            return [s[0][0] for s in states]
        best: list[tuple[float, list[int]]] = [(0.0, [])]
        previous: list[str | None] = [None]
        for options in states:
            step = []
            for k, (w, channel) in enumerate(options):
                if len(options) == 1 and len(previous) == 1:
                    step.append((best[0][0], best[0][1] + [0]))
                    continue
                value, path = max((b + self.counts.log_likelihood(p, w), q) for (b, q), p in zip(best, previous))
                step.append((value + channel, path + [k]))
            best, previous = step, [w for w, _ in options]
        path = max(best)[1]
        return [s[k][0] for s, k in zip(states, path)]

    def defects(self) -> list[tuple[int, str]]:
        out = [(i + 1, "furniture") for i in sorted(self.furniture)]
        out += [(i + 1, "broken_word") for i in sorted(self.cut)]
        return out + [(i + 1, "misread") for i in sorted(self.fixed)]

    def paragraphs(self) -> list[str]:
        """Running text, words joined and corrected; a paragraph ends at a short line with a sentence end. The rest of a word cut at the page's end is added."""
        width = max([len(self.lines[i].rstrip()) for i in self.running], default=0)
        out: list[str] = []
        text, skip, last = "", 0, None
        for i in self.running:
            raw = self.lines[i]
            line = raw
            for a, b, meant in sorted(self.fixed.get(i, []), reverse=True):
                if a == b or i in self.cut and b >= len(raw.rstrip()) - 1:
                    continue
                line = line[:a] + _cased(line[a:b], meant) + line[b:]
            lead = len(line) - len(line.lstrip())
            line = line[lead:][skip:].strip() if skip else line.strip()
            gap = last is not None and any(not self.lines[j].strip() for j in range(last + 1, i))
            if text and (gap or (text.endswith((".", "!", "?", "。", "！", "？")) and last is not None and len(self.lines[last].rstrip()) < 0.85 * width)):
                out.append(text)
                text = ""
            text = (text + " " + line if text and line else text + line).strip()
            skip, last = 0, i
            if i in self.cut:
                head, tail, joined = self.cut[i]
                meant = self.meant.get(i, joined.lower())
                text = text[: len(text) - len(head) - 1] + _cased(joined, meant)
                skip = len(tail)
            elif line.endswith(tuple(HYPHENS)) and text:
                text = text.rstrip("­¬") + "\x00"  # a compound goes on without a blank
            text = text.replace("\x00 ", "")
        text = text.replace("\x00", "")
        return [*out, text] if text else out


class _Asked(Page):
    """The words that a page asks the counts of, whatever these are; known words needn't be among them."""

    def _join(self) -> None:
        self.words: set[str] = set()
        self.rests: dict[int, str] = {}  # line: part of a word that it may begin with
        if self.running and self.last_page:
            before = _cut_tail(self.last_page)
            first = _HEAD.match(self.lines[self.running[0]].lstrip())
            if before and first:
                self._ask(before[1], first[0])
                self.rests[self.running[0]] = first[0]
        following = dict(zip(self.running, self.running[1:]))
        for i, _, head, tail in self._possible_cuts():
            self._ask(head, tail)
            if i in following:
                self.rests[following[i]] = tail

    def _ask(self, head: str, tail: str) -> None:
        self.words |= {(head + tail).lower(), f"{head}-{tail}".lower()}

    def _correct(self) -> None:
        for i in self.running:
            line = self.lines[i]
            rest = self.rests.get(i)
            for begin in {0, len(line) - len(line.lstrip()) + len(rest) if rest else 0}:
                self.words |= {core.lower() for _, core, _ in _cores(line, begin)}
        for w in [w for w in self.words if "-" in w]:
            parts = w.split("-")
            self.words.update(parts)
            if len(w) <= LONGEST_WORD and w not in self.counts.common:
                for at, p in enumerate(parts):
                    if len(p) > 2 and p not in self.counts.common:
                        self.words |= {"-".join([*parts[:at], c, *parts[at + 1 :]]) for c, _ in candidates(p, self.counts)}


def _cased(read: str, meant: str) -> str:
    if read.isupper():
        return meant.upper()
    return meant[:1].upper() + meant[1:] if read[:1].isupper() else meant


def _edges(content: str = "content") -> list:
    solid = F.filter(F.split(F.col(content), "\n"), lambda x: F.trim(x) != "")
    return [F.slice(solid, 1, EDGE).alias("top"), F.slice(F.reverse(solid), 1, EDGE).alias("bottom")]


def _with_neighbours(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """chunk_id, document_id, page, content, title and near (d, top, bottom of the pages up to two away)."""
    edges = pages.select("document_id", "page", *_edges()).where("document_id is not null and page is not null")
    near = edges.withColumn("d", F.explode(F.array(*[F.lit(d) for d in (-2, -1, 1, 2)])))
    near = near.select("document_id", (F.col("page") - F.col("d")).alias("page"), "d", "top", "bottom")
    # one page for each place, so at most four rows come together
    near = near.groupBy("document_id", "page", "d").agg(F.min(F.struct("top", "bottom")).alias("e")).groupBy("document_id", "page").agg(F.sort_array(F.collect_list(F.struct("d", "e.top", "e.bottom"))).alias("near"))
    title = titles.where("document_id is not null").groupBy("document_id").agg(F.min("title").alias("title"))
    return pages.join(near, ["document_id", "page"], "left").join(title, "document_id", "left").select("chunk_id", "document_id", "page", "content", "title", "near")


def _pages(chunks: DataFrame) -> DataFrame:
    pages = chunks.where(F.col("splitter").isin(*SPLITTERS) & F.col("content").isNotNull() & F.col("chunk_id").isNotNull())
    return pages.select("chunk_id", "document_id", F.coalesce("page_number", F.col("chunk_index") + 1).alias("page"), "content").distinct()


def _read(chunks: DataFrame, pages: DataFrame, schema: str, rows_of) -> DataFrame:
    """`rows_of` each of `pages` (chunk_id, document_id, page, content, title, near), read with the counts of `chunks`."""
    counts, words = corpus_counts(chunks)
    spark = chunks.sparkSession
    # at most 1 / LEAST_SHARE words, and as many pairs of 16 bytes
    tables = spark.sparkContext.broadcast((counts.common, int(counts.total), counts.pairs))

    def edge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [Edges.of(r["content"], [(n["d"], n["top"], n["bottom"]) for n in r["near"] or []], r["title"], r["page"]) for r in batch.to_pylist()]
                kept = [batch.column(c) for c in ("chunk_id", "document_id", "page", "content", "key")]
                lists = pa.array([sorted(e.furniture) for e in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*kept, lists, pa.array([e.next_page for e in found], pa.string()), pa.array([e.last_page for e in found], pa.string())],
                    names=["chunk_id", "document_id", "page", "content", "key", "furniture", "next_page", "last_page"],
                )

    # the edges of other pages are looked at once; from here on a page stands by itself
    pages = pages.withColumn("key", F.xxhash64("chunk_id", "document_id", "page", "content")).select("chunk_id", "document_id", "page", "content", "key", "title", "near")
    pages = durable(pages.mapInArrow(edge, "chunk_id string, document_id string, page int, content string, key bigint, furniture array<int>, next_page string, last_page string"))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[dict, Edges]]]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            yield [(r, Edges(frozenset(r["furniture"]), r["next_page"], r["last_page"])) for r in batch.to_pylist()]

    def read(batches: Iterable[pa.RecordBatch], counts: Counts) -> Iterator[list[tuple[dict, Page]]]:
        for part in each(batches):
            out = []
            for r, edges in part:
                counts.rare = {x["word"]: x["n"] for x in r["rare"] or []}
                out.append((r, Page(r["content"], edges, counts)))
            yield out

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(*tables.value)
        for part in each(batches):
            asked = [(r["key"], w) for r, edges in part for w in _Asked(r["content"], edges, counts).words if w not in counts.common]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in asked], pa.int64()), pa.array([w for _, w in asked], pa.string())], names=["key", "word"])

    def confused(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in read(batches, Counts(*tables.value)):
            seen.update(c for _, page in part for words in page.read_as for c in confusions_between(*words))
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in seen], pa.string()), pa.array([m for _, m in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["read", "meant", "n"])

    rare = pages.mapInArrow(ask, "key bigint, word string").join(words, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("rare"))
    pages = durable(pages.join(rare, "key", "left"))
    # as many rows as the table of confusions has entries, at most
    seen = {(r.read, r.meant): r.n for r in pages.mapInArrow(confused, "read string, meant string, n bigint").groupBy("read", "meant").agg(F.sum("n").alias("n")).collect()}
    channel = learned_channel(seen, counts.common)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in read(batches, Counts(*tables.value, channel)):
            rows = [row for r, page in part for row in rows_of(r, page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names, types = [c.split()[0] for c in schema.split(", ")], [kinds[c.split()[1]] for c in schema.split(", ")]
    return pages.mapInArrow(run, schema)


def line_defects(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """chunk_id, line_no (from 1), defect of the page chunks' lines: furniture, broken_word, misread.

    Repeated rows count once. Null contents, and chunks of other splitters, have no lines; null titles, documents
    or page numbers only leave their evidence out (without a page number the chunk's index stands for it).
    """
    return _read(chunks, _with_neighbours(_pages(chunks), titles), "chunk_id string, line_no int, defect string", lambda r, page: [(r["chunk_id"], n, d) for n, d in page.defects()]).distinct()


def _paragraphs(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, paragraph_no, content of pages with a document each."""

    def rows(r: dict, page: Page) -> list[tuple]:
        text = page.paragraphs()
        cut_end = bool(page.running) and page.running[-1] in page.cut
        return [(r["document_id"], r["page"], i, t, i == len(text) - 1 and not t.endswith((".", "!", "?", "。", "！", "？")), i == len(text) - 1 and cut_end) for i, t in enumerate(text)]

    parts = _read(chunks, pages, "document_id string, page int, part int, content string, open boolean, cut boolean", rows)
    order = Window.partitionBy("document_id").orderBy("page", "part")
    parts = parts.withColumn("runs_on", F.coalesce(F.lag("open").over(order), F.lit(False))).withColumn("cut_before", F.coalesce(F.lag("cut").over(order), F.lit(False)))
    parts = parts.withColumn("paragraph_no", F.sum((~F.col("runs_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    content = F.when(F.col("cut_before"), F.regexp_replace("content", r"^[\p{L}\p{N}†|$@€¢]+(?:-[\p{L}\p{N}†|$@€¢]+)*", "\x00")).otherwise(F.col("content"))
    joined = parts.select("document_id", "paragraph_no", F.struct("page", "part", content.alias("content")).alias("p")).groupBy("document_id", "paragraph_no").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return joined.select("document_id", "paragraph_no", F.replace(F.array_join(F.filter(F.col("p.content"), lambda x: x != ""), " "), F.lit(" \x00"), F.lit("")).alias("content"))


#: Between the parts of a key that is taken apart again.
_AND = "\x1f"


def page_paragraphs(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """document_id, paragraph_no (from 1), content: the repaired paragraphs of each document, joined across pages.

    Pages without a number, and paragraphs of them, come first. A paragraph goes on over a page's end unless it
    ends a sentence there. The first word of a page that completes a word of the page before is dropped there.
    Pages of no document (null) stay by themselves.
    """
    pages = _with_neighbours(_pages(chunks), titles)
    pages = pages.withColumn("document_id", F.coalesce("document_id", F.concat(F.lit(_AND), "chunk_id")))
    return _paragraphs(chunks, pages).withColumn("document_id", F.when(~F.startswith("document_id", F.lit(_AND)), F.col("document_id")))


def content_pages(documents: DataFrame) -> DataFrame:
    """Whole contents (document_id, title, content) as pages: their blocks between blank lines, which is where page edges fall.

    Since a page may hold several blocks, the neighbours of a block are those next to it, and up to two at either side that
    begin or end with the same words, wherever in the document they are.
    """

    def near(blocks: list[str]) -> Iterator[list[dict]]:
        edges = []
        for b in blocks:
            solid = [x for x in b.split("\n") if x.strip()]
            edges.append((solid[:EDGE], solid[::-1][:EDGE]))
        places: dict[tuple[int, str], list[int]] = {}
        order = []
        for i, edge in enumerate(edges):
            for side in (0, 1):
                where = places.setdefault((side, _skeleton(edge[side][0]) if edge[side] else ""), [])
                order.append(len(where))
                where.append(i)
        for i, edge in enumerate(edges):
            out = {d: i + d for d in (-1, 1) if 0 <= i + d < len(blocks)}
            for side in (0, 1):
                where, at = places[side, _skeleton(edge[side][0]) if edge[side] else ""], order[2 * i + side]
                for d, j in ((-2, at - 1), (2, at + 1)):
                    if 0 <= j < len(where):
                        out[d] = where[j]
            yield [{"d": d, "top": edges[j][0], "bottom": edges[j][1]} for d, j in out.items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, title, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                blocks = [b for b in re.split(r"\n[ \t]*(?:\n[ \t]*)+", content) if b.strip()]
                yield pa.RecordBatch.from_pylist(
                    [{"chunk_id": None, "document_id": key, "page": i + 1, "content": b, "title": title, "near": n} for i, (b, n) in enumerate(zip(blocks, near(blocks)))], schema=arrow
                )

    edge = pa.list_(pa.struct([("d", pa.int32()), ("top", pa.list_(pa.string())), ("bottom", pa.list_(pa.string()))]))
    arrow = pa.schema([("chunk_id", pa.string()), ("document_id", pa.string()), ("page", pa.int32()), ("content", pa.string()), ("title", pa.string()), ("near", edge)])
    schema = "chunk_id string, document_id string, page int, content string, title string, near array<struct<d: int, top: array<string>, bottom: array<string>>>"
    return documents.select("document_id", "title", "content").mapInArrow(run, schema)


def document_paragraphs(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, content_hash, paragraph_no (from 1), content: the repaired paragraphs of whole contents (document_id, title, content).

    Repeated rows count once; a document with several contents has the paragraphs of each, told apart by content_hash. Null and
    blank contents have none. Word counts are those of all `chunks`.
    """
    whole = documents.where(F.coalesce(F.trim("content"), F.lit("")) != "").groupBy("document_id", "content").agg(F.min("title").alias("title"))
    keyed = whole.select(F.concat(F.coalesce("document_id", F.lit("")), F.lit(_AND), F.sha2("content", 256)).alias("document_id"), "title", "content")
    rows = _paragraphs(chunks, content_pages(keyed))
    names = F.substring_index("document_id", _AND, 1)
    return rows.select(F.when(names != "", names).alias("document_id"), F.substring_index("document_id", _AND, -1).alias("content_hash"), "paragraph_no", "content")
