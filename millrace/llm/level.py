"""Reading level of each document (problem 10).

Regularised ordinal regression. Each document gets features of lexical diversity,
word rarity, connectives, clause depth (by its punctuation) and length. They are
standardised within each language over all documents, which makes languages
comparable; a proportional-odds model then learns shared weights, and for each
language small deviations from them (held near 0 by a stronger penalty), from
graded documents. The model is a few hundred numbers.

Word rarity needs corpus counts. Words of all documents are counted exactly, by one
aggregation. Those with at least one in 2^CEILING of all words (so there are fewer
than 2^CEILING of them, whatever the corpus) go to the executors with their counts;
any rarer word counts as CEILING bits of surprise.

Letters of every script make words. A document's language is told by its script and
frequent words; where these say nothing the language column decides. All languages
but the three known ones are standardised together as `other`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import durable

#: Bits of surprise of all words rarer than one in 2^CEILING.
CEILING = 18
#: At most so many graded rows (those of smallest hash) are collected to fit on.
MAX_LABELS = 20_000
WORDS_KEPT = 1_000_000

#: Connectives by language, single characters for Chinese.
CONNECTIVES = set(
    "although though whereas because since unless while whenever insofar notwithstanding moreover nevertheless consequently accordingly thereby hitherto whose which provided "
    "whereby wherein whereupon therefore furthermore nonetheless hence thus inasmuch albeit lest whether whom until whereof thereof besides conversely subsequently "
    "obwohl soweit sofern weshalb sowohl ungeachtet demgemäß obgleich indem damit sobald dass deren wonach weil wenn bevor "
    "falls nachdem während solange wodurch wobei worauf woraus wofern dessen dennoch jedoch folglich demnach daher deshalb nichtsdestoweniger insofern gleichwohl hingegen mithin somit "
    "然 而 则 故 若 倘 尽 虽 且 即 其 之 亦 否 因 此 凡".split()
)
#: Frequent words that tell two languages of Latin script apart.
ENGLISH, GERMAN = frozenset("the of and to is that".split()), frozenset("der die und das den nicht".split())
LANGUAGES = ("en", "de", "zh", "other")
FEATURES = (
    "sentence_mean", "sentence_low", "sentence_middle", "sentence_high", "sentence_top", "word_length", "long_words", "rarity", "rare_words", "connectives", "commas", "diversity", "words"
)

_TOKEN = re.compile(r"[^\W\d_一-鿿]+|[一-鿿]|[.!?](?!\w)|[。！？\n,;:，；：、]")
_END, _PAUSE, _WORD, _HAN = 0, 1, 2, 3
#: What a word says of its language: letters beyond Latin, or frequent in one of two.
_NOTHING, _FOREIGN, _ENGLISH, _GERMAN = 0, 1, 2, 3


class _Lexicon(dict):
    """Token to number, with what is known of each token in arrays."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.kind = np.empty(0, np.int8)
        self.tells = np.empty(0, np.int8)
        self.length = np.empty(0, np.int64)
        self.connective = np.empty(0, bool)
        self.surprise = np.empty(0)
        self.table: dict[str, float] | None = None

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.fresh.append(token)
        return n

    def learn(self) -> None:
        if not self.fresh:
            return
        kinds = [_HAN if "一" <= t <= "鿿" else _WORD if t.isalpha() else _END if t in ".!?。！？\n" else _PAUSE for t in self.fresh]
        tells = [_ENGLISH if t in ENGLISH else _GERMAN if t in GERMAN or not t.isascii() and any(c in "äöüß" for c in t) else _FOREIGN if t[0] > "\u024f" and t.isalpha() else _NOTHING for t in self.fresh]
        self.kind = np.concatenate([self.kind, np.array(kinds, np.int8)])
        self.tells = np.concatenate([self.tells, np.array(tells, np.int8)])
        self.length = np.concatenate([self.length, np.fromiter(map(len, self.fresh), np.int64, len(self.fresh))])
        self.connective = np.concatenate([self.connective, np.fromiter((t in CONNECTIVES for t in self.fresh), bool, len(self.fresh))])
        self.fresh = []

    def surprises(self, table: dict[str, float]) -> np.ndarray:
        """Bits of surprise of each token."""
        if self.table is not table:
            self.table, self.surprise = table, np.empty(0)
        if len(self.surprise) < len(self):
            new = islice(self, len(self.surprise), None)
            self.surprise = np.concatenate([self.surprise, np.fromiter((table.get(t, CEILING) for t in new), np.float64, len(self) - len(self.surprise))])
        return self.surprise


_lexicon: list[_Lexicon] = []


def _tokens(texts: list[str | None]) -> tuple[_Lexicon, np.ndarray, np.ndarray]:
    """The worker's lexicon, the texts' tokens as its numbers, and the text of each token."""
    if not _lexicon or len(_lexicon[0]) > WORDS_KEPT:
        _lexicon[:] = [_Lexicon()]
    lexicon = _lexicon[0]
    found = [_TOKEN.findall(t.lower()) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    numbers = np.fromiter(map(lexicon.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
    lexicon.learn()
    return lexicon, numbers, np.repeat(np.arange(len(texts)), counts)


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def word_surprise(documents: DataFrame, text: str = "text") -> dict[str, float]:
    """Bits of surprise of the words that make up at least one in 2^CEILING of all words; fewer than 2^CEILING of them come to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counted = None, np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            words = np.array(list(held), object)
            for at in range(0, len(words), 50_000):
                some = at + np.flatnonzero((counted[at : at + 50_000] > 0) & (held.kind[at : at + 50_000] >= _WORD))
                yield pa.RecordBatch.from_arrays([pa.array(words[some], pa.string()), pa.array(counted[some])], names=["word", "n"])

        for batch in _slices(batches):
            lexicon, numbers, _ = _tokens(batch.column(0).to_pylist())
            if held is not lexicon:
                if held is not None:
                    yield from rows()
                held, counted = lexicon, np.zeros(0, np.int64)
            new = np.bincount(numbers, minlength=len(lexicon))
            new[: len(counted)] += counted
            counted = new
        if held is not None:
            yield from rows()

    counts = durable(documents.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.where(F.col("n") * (1 << CEILING) > total).toArrow()
    return dict(zip(known["word"].to_pylist(), (np.log2(max(total, 1)) - np.log2(known["n"].to_numpy())).tolist()))


def measure(texts: list[str | None], surprise: dict[str, float], said: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text (rows) and its language's number in LANGUAGES. Texts without words have zeros. `said` has what the language column says."""
    n = len(texts)
    lexicon, number, of = _tokens(texts)
    kind = lexicon.kind[number]
    is_word = kind >= _WORD
    word, at = number[is_word], of[is_word]
    words = np.bincount(at, minlength=n)
    some = np.maximum(words, 1)

    # sentences: runs of words up to an end
    sentence = np.cumsum(kind == _END) + of  # a new text is a new sentence as well
    _, index = np.unique(sentence[is_word], return_inverse=True)
    size = np.bincount(index) if len(index) else np.empty(0, np.int64)
    owner = np.zeros(len(size), np.int64)
    owner[index] = at
    keep = size >= 2
    size, owner = np.log(size[keep]), owner[keep]
    order = np.lexsort((size, owner))
    size, owner = size[order], owner[order]
    sentences = np.bincount(owner, minlength=n)
    begin = np.cumsum(sentences) - sentences
    out = np.zeros((n, len(FEATURES)))
    has = sentences > 0
    out[:, 0] = np.bincount(owner, size, n) / np.maximum(sentences, 1)
    for j, q in enumerate((0.1, 0.35, 0.65, 0.9)):
        out[has, 1 + j] = size[begin[has] + ((sentences[has] - 1) * q).round().astype(int)]

    length, rare = lexicon.length[word], lexicon.surprises(surprise)[word]
    out[:, 5] = np.bincount(at, length, n) / some
    out[:, 6] = np.bincount(at, length >= 10, n) / some
    out[:, 7] = np.bincount(at, rare, n) / some
    out[:, 8] = np.bincount(at, rare > 13, n) / some
    whole = np.maximum(sentences, 1)
    out[:, 9] = np.bincount(at, lexicon.connective[word], n) / whole
    out[:, 10] = np.bincount(of[kind == _PAUSE], minlength=n) / whole
    pair = np.unique(at * (len(lexicon) + 1) + word)
    distinct = np.bincount(pair // (len(lexicon) + 1), minlength=n)
    out[:, 11] = np.log(np.maximum(distinct, 1)) - 0.6 * np.log(some)
    out[:, 12] = np.log(some)

    han = np.bincount(of[kind == _HAN], minlength=n)
    foreign, english, german = (np.bincount(at, lexicon.tells[word] == t, n) for t in (_FOREIGN, _ENGLISH, _GERMAN))
    named = np.array([LANGUAGES.index(s) if s in ("en", "de") else 0 if not s or s == "zh" else 3 for s in (said or [None] * n)], np.int64)
    latin = np.where(np.maximum(english, german) > 0.02 * some, np.where(german > english, 1, 0), named)
    return out, np.where(han > 0.3 * some, 2, np.where(foreign > 0.5 * some, 3, latin))


def features(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang (INT, place in LANGUAGES) and x (ARRAY<DOUBLE>, FEATURES) of each document; the column `lang` is evidence where there is one."""
    table = documents.sparkSession.sparkContext.broadcast(word_surprise(documents, text))  # fewer than 2^CEILING words

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, languages = measure(batch.column(1).to_pylist(), table.value, batch.column(2).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages, pa.int32()), lists], names=["key", "lang", "x"])

    kind = documents.schema[key].dataType.simpleString()
    said = F.lower(F.trim(F.col(f"`{lang}`").cast("string"))) if lang in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), said.alias("said")).mapInArrow(run, f"key {kind}, lang int, x array<double>")


@dataclass
class OrdinalModel:
    """P(band > j) = sigmoid(score - cut_j); score is linear in the standardised features and a language's deviations."""

    mean: np.ndarray  # language x feature
    spread: np.ndarray
    weights: np.ndarray
    deviations: np.ndarray  # language x (feature, constant)
    cuts: np.ndarray

    def design(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean[lang]) / self.spread[lang], -4, 4)

    def score(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        z = self.design(x, lang)
        return z @ self.weights + (z * self.deviations[lang, :-1]).sum(1) + self.deviations[lang, -1]

    def band(self, x: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """The most probable band."""
        above = 1 / (1 + np.exp(-np.clip(self.score(x, lang)[:, None] - self.cuts, -40, 40)))
        edge = np.column_stack([np.ones(len(x)), above, np.zeros(len(x))])
        return 1 + np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)

    @staticmethod
    def fit(x: np.ndarray, lang: np.ndarray, band: np.ndarray, mean: np.ndarray, spread: np.ndarray, bands: int = 4, shared: float = 0.3, own: float = 2.0, steps: int = 1500) -> OrdinalModel:
        """Penalised maximum likelihood by Adam over all rows; penalties are L2, in units of rows."""
        f, k = x.shape[1], len(mean)
        model = OrdinalModel(mean, spread, np.zeros(f), np.zeros((k, f + 1)), np.linspace(-2, 2, bands - 1))
        if not len(x):
            return model
        z = model.design(x, lang)
        step0 = np.concatenate([model.weights, model.deviations.ravel(), [model.cuts[0]], np.log(np.diff(model.cuts))])
        m, v = np.zeros_like(step0), np.zeros_like(step0)
        theta, n = step0, len(x)
        member = np.eye(k)[lang]
        for t in range(1, steps + 1):
            w, d = theta[:f], theta[f : f + k * (f + 1)].reshape(k, f + 1)
            gaps = np.exp(theta[f + k * (f + 1) + 1 :])
            cuts = theta[f + k * (f + 1)] + np.concatenate([[0], np.cumsum(gaps)])
            s = z @ w + (z * d[lang, :-1]).sum(1) + d[lang, -1]
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))
            edge = np.column_stack([np.ones(n), above, np.zeros(n)])
            rows = np.arange(n)
            p = np.maximum(edge[rows, band - 1] - edge[rows, band], 1e-12)
            slope = edge * (1 - edge)
            ds = (slope[rows, band - 1] - slope[rows, band]) / p  # of the log likelihood by the score
            dcut = np.zeros((n, bands + 1))
            dcut[rows, band - 1] -= slope[rows, band - 1] / p
            dcut[rows, band] += slope[rows, band] / p
            dcut = dcut[:, 1:-1].sum(0)
            gw = z.T @ ds - shared * w
            gd = np.column_stack([(member * ds[:, None]).T @ z, (member * ds[:, None]).sum(0)]) - own * d
            gc = np.concatenate([[dcut.sum()], [dcut[j + 1 :].sum() * gaps[j] for j in range(bands - 2)]])
            g = np.concatenate([gw, gd.ravel(), gc]) / n
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            theta = theta + 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, d = theta[:f], theta[f : f + k * (f + 1)].reshape(k, f + 1)
        cuts = theta[f + k * (f + 1)] + np.concatenate([[0], np.cumsum(np.exp(theta[f + k * (f + 1) + 1 :]))])
        return OrdinalModel(mean, spread, w, d, cuts)


def standards(measured: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over all documents with words, by language; languages without documents use all."""
    columns = [f(F.get("x", F.lit(j))).alias(f"{name}{j}") for j in range(len(FEATURES)) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    with_words = measured.where(F.get("x", F.lit(len(FEATURES) - 1)) > 0)
    rows = with_words.rollup("lang").agg(*columns)
    mean, spread = np.zeros((len(LANGUAGES), len(FEATURES))), np.ones((len(LANGUAGES), len(FEATURES)))
    found = {r["lang"]: r for r in rows.collect()}  # at most LANGUAGES + 1 rows
    for i in range(len(LANGUAGES)):
        if r := found.get(i, found.get(None)):
            mean[i] = [r[f"m{j}"] or 0 for j in range(len(FEATURES))]
            spread[i] = [r[f"s{j}"] or 0 for j in range(len(FEATURES))]
    return mean, np.where(spread > 1e-9, spread, 1.0)


def fit_levels(measured: DataFrame, labels: DataFrame, bands: int = 4, max_labels: int = MAX_LABELS) -> OrdinalModel:
    """The model from `features` rows and graded ones (doc_id, band); null and impossible bands are left out."""
    graded = labels.where(F.col("band").between(1, bands)).select(F.col("doc_id").alias("key"), F.col("band").cast("int").alias("band"))
    rows = graded.join(measured, "key").orderBy(F.xxhash64("key"), "key", "band").limit(max_labels).toArrow()
    mean, spread = standards(measured)
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return OrdinalModel.fit(x, rows["lang"].to_numpy().astype(int), rows["band"].to_numpy().astype(int), mean, spread, bands)


def calibration(x: np.ndarray, lang: np.ndarray, band: np.ndarray, mean: np.ndarray, spread: np.ndarray, folds: int = 5, bands: int = 4) -> list[tuple[str, int, int, float, float]]:
    """lang, band, rows, expected and real share of the band among graded rows, by models fitted without them."""
    above = np.zeros((len(x), bands + 1))
    for f in range(folds):
        held = np.arange(len(x)) % folds == f
        model = OrdinalModel.fit(x[~held], lang[~held], band[~held], mean, spread, bands)
        p = 1 / (1 + np.exp(-np.clip(model.score(x[held], lang[held])[:, None] - model.cuts, -40, 40)))
        above[held] = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
    share = above[:, :-1] - above[:, 1:]
    return [
        (name, j + 1, int((lang == i).sum()), float(share[lang == i, j].mean()), float((band[lang == i] == j + 1).mean()))
        for i, name in enumerate(LANGUAGES) if (lang == i).any() for j in range(bands)
    ]


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang, level (DOUBLE, comparable across languages) and band (INT from 1, easiest) of each document.

    Documents without any word (null, empty, blank or symbols only) have null level
    and band. Repeated rows stay repeated. Without usable labels every document
    with words has the same level. A column `lang` is evidence of the language; others are ignored.
    """
    measured = durable(features(documents, key, text))
    model = fit_levels(measured, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            lang = batch.column(1).to_numpy().astype(int)
            wordless = x[:, -1] <= 0
            lone = np.abs(x).sum(1) == 0
            level, band = model.score(x, lang), model.band(x, lang)
            names = pa.array([LANGUAGES[i] for i in lang], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(level, mask=wordless & lone), pa.array(band, pa.int32(), mask=wordless & lone)], names=[key, "lang", "level", "band"])

    kind = documents.schema[key].dataType.simpleString()
    return measured.mapInArrow(run, f"`{key}` {kind}, lang string, level double, band int")
