"""Mixing sources to target weights (problem 9).

Iterative proportional fitting. Documents fall into cells of source, language and
topic; the cells' token sums are one aggregation, and their number is bounded by
the targets times the fixed languages and topics. Uses of a document of each cell
are raked in turn to the topic, language and source marginals, never above the
source's max_repeats; topics and languages keep the shares they have in the
corpus, sources get their target. Documents are then sampled by these calibrated
weights: the whole part always, the fraction by a hash of the document, which
makes the sample reproducible and independent of partitioning.

Topics come from a mixture of multinomials over hashed tokens, one for each
language, fitted by expectation maximisation over all documents. A document keeps
the counts of its token ids in PLACES places, so texts are read and encoded once
and every round is one pass over a few hundred bytes a document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.encode import DEFAULT_VOCABULARY, codec_for, read_vocabulary
from millrace.session import durable

#: More targets than this are refused: they are broadcast, and their cells are collected.
MAX_SOURCES = 10_000

#: Languages told apart; all others are `other`.
LANGUAGES = ("en", "zh", "de")
#: Topics of each language, places that token ids are hashed to, and rounds of the fit.
TOPICS, PLACES, ROUNDS = 4, 256, 6


def normal_name(name: Column) -> Column:
    """A source without case and outer blanks."""
    return F.regexp_replace(F.lower(name), r"(?U)^\s+|\s+$", "")


def rake(tokens: np.ndarray, caps: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Uses of each cell, within [0, caps], whose token sums fit the marginals in turn, the last one best.

    `members` has for each marginal the number of each cell's category, `targets` the tokens of each category.
    A category whose cells are all at their caps stays below its target.
    """
    uses = np.minimum(np.ones(len(tokens)), caps)
    for _ in range(rounds):
        before = uses.copy()
        for member, target in zip(members, targets):
            # a category's open cells share what its full cells leave, until none fills up any more
            for _ in range(len(tokens) + 1):
                full = uses >= caps * (1 - 1e-12)
                taken = np.bincount(member, tokens * uses * full, len(target))
                open_ = np.bincount(member, tokens * uses * ~full, len(target))
                scale = np.divide(np.maximum(target - taken, 0), open_, out=np.ones(len(target)), where=open_ > 0)
                over = taken > target * (1 + 1e-12)  # full cells alone hold too much: shrink all of them
                shrink = np.divide(target, taken + open_, out=np.ones(len(target)), where=taken + open_ > 0)
                new = np.where(over[member], uses * shrink[member], np.where(full, uses, uses * scale[member]))
                new = np.minimum(new, caps)
                done = np.allclose(new, uses, rtol=1e-12, atol=0)
                uses = new
                if done:
                    break
        if np.max(np.abs(uses - before), initial=0) <= tolerance:
            break
    return uses


@dataclass
class Plan:
    """Raked cells, and for each source of the targets what it asks for and what it can give."""

    cells: list[tuple[str, str, str, float]]  # source, lang, topic, uses of each document
    sources: list[tuple[str, float, int, int, float, float, bool]]  # source, share, max_repeats, tokens, wanted, raked, short
    total: int


def _token_places(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The other columns of `documents`, tokens, and places (PLACES bytes: counts of the token ids of `text` by place, scaled down where one exceeds 255)."""
    keep = [c for c in documents.columns if c != "text"]
    files = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(files.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ids, offsets = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
                tokens = np.diff(offsets)
                place = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PLACES
                counts = np.bincount(np.repeat(np.arange(len(tokens)), tokens) * PLACES + place, minlength=len(tokens) * PLACES).reshape(-1, PLACES)
                scale = np.maximum(counts.max(1, initial=0), 255)[:, None] / 255
                counts = np.ceil(counts / scale).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary())], names=[*keep, "tokens", "places"])

    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "tokens bigint", "places binary"])
    return documents.select(*keep, "text").mapInArrow(run, schema)


@dataclass
class TopicModel:
    """For each language a mixture of TOPICS multinomials over the places."""

    log_share: np.ndarray  # language x topic
    log_place: np.ndarray  # language x topic x place

    @staticmethod
    def of(sums: np.ndarray) -> TopicModel:
        """From the place counts of each language and topic."""
        size = sums.sum(2)
        place = (sums + 0.5) / (size + 0.5 * PLACES)[:, :, None]
        return TopicModel(np.log((size + 1.0) / (size + 1.0).sum(1, keepdims=True)), np.log(place))

    def topic(self, lang: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The most probable topic of each document."""
        out = np.zeros(len(lang), np.int64)
        for i in range(len(self.log_share)):
            rows = np.flatnonzero(lang == i)
            if len(rows):
                out[rows] = (counts[rows] @ self.log_place[i].T + self.log_share[i]).argmax(1)
        return out


def _place_counts(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PLACES).astype(np.float64)


def fit_topics(measured: DataFrame, rounds: int = ROUNDS) -> TopicModel:
    """Expectation maximisation over all rows of (language INT, places); each round brings a row for each language, topic and place.

    The first topics are the sides of two fixed random planes through the mean document of a language, so the fit is reproducible.
    """
    languages = len(LANGUAGES) + 1
    planes = np.random.default_rng(9).normal(size=(TOPICS.bit_length() - 1, PLACES))

    def sums(chosen) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((languages, TOPICS, PLACES))
            for batch in batches:
                if batch.num_rows:
                    lang, counts = batch.column(0).to_numpy().astype(int), _place_counts(batch.column(1))
                    np.add.at(total, (lang, chosen(lang, counts)), counts)
            flat = total.ravel()
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(flat[some].astype(np.int64))], names=["at", "n"])

        found = measured.select("language", "places").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(languages * TOPICS * PLACES)
        out[found["at"].to_numpy()] = found["n"].to_numpy()
        return out.reshape(languages, TOPICS, PLACES)

    mean = sums(lambda lang, counts: np.zeros(len(lang), np.int64))[:, 0]
    mean = mean / np.maximum(mean.sum(1, keepdims=True), 1)

    def sides(lang: np.ndarray, counts: np.ndarray) -> np.ndarray:
        away = counts / np.maximum(counts.sum(1, keepdims=True), 1) - mean[lang]
        return ((away @ planes.T > 0) << np.arange(len(planes))).sum(1)

    model = TopicModel.of(sums(sides))
    for _ in range(rounds):
        model = TopicModel.of(sums(model.topic))
    return model


def _targets(targets: DataFrame) -> DataFrame:
    """source (normalised), share and max_repeats of each target; more than MAX_SOURCES are refused."""
    wanted = targets.where("source is not null and target_share is not null").groupBy(normal_name(F.col("source")).alias("source"))
    wanted = wanted.agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    if len(wanted.take(MAX_SOURCES + 1)) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    return wanted


def sized_documents(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source (normalised), lang, topic, tokens, fingerprint and max_repeats of the documents in the targets.

    Null texts count as empty; null sources, and sources outside the targets, are left out.
    Only languages of LANGUAGES are told apart, all others are `other`; topics are those of the language (`en-0` and so on).
    """
    lang = F.lower(F.trim("lang"))
    lang = F.coalesce(F.when(lang.isin(*LANGUAGES), lang), F.lit("other"))
    number = F.coalesce(F.array_position(F.array(*map(F.lit, LANGUAGES)), lang) - 1, F.lit(-1)).cast("int")
    docs = documents.select("doc_id", normal_name(F.col("source")).alias("source"), lang.alias("lang"), F.xxhash64("text").alias("fingerprint"), "text")
    docs = docs.join(F.broadcast(_targets(targets).select("source", "max_repeats")), "source")  # at most MAX_SOURCES rows
    docs = docs.withColumn("language", F.when(number < 0, len(LANGUAGES)).otherwise(number))
    measured = durable(_token_places(docs.select("doc_id", "source", "lang", "language", "fingerprint", "max_repeats", "text"), vocabulary))
    model = fit_topics(measured)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                topic = model.topic(batch.column("language").to_numpy().astype(int), _place_counts(batch.column("places")))
                names = pa.array([f"{a}-{b}" for a, b in zip(batch.column("lang").to_pylist(), topic.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), names], names=[*keep, "topic"])

    keep = ["doc_id", "source", "lang", "tokens", "fingerprint", "max_repeats"]
    schema = ", ".join([*(f"{c} {measured.schema[c].dataType.simpleString()}" for c in keep), "topic string"])
    return measured.mapInArrow(run, schema)


def mixture_plan(sized: DataFrame, targets: DataFrame) -> Plan:
    """Rakes the cells of `sized` to the targets; the total is the tokens of all rows of `sized`."""
    wanted = {r.source: (r.share, r.max_repeats) for r in _targets(targets).collect()}  # at most MAX_SOURCES rows
    # at most MAX_SOURCES x 4 languages x 4 topics rows
    cells = [(r[0], r[1], r[2], int(r[3] or 0)) for r in sized.groupBy("source", "lang", "topic").agg(F.sum("tokens")).collect() if r[0] in wanted]
    cells = sorted(c for c in cells if c[3] > 0)
    names = sorted(wanted)
    tokens = np.array([c[3] for c in cells], float)
    total = int(tokens.sum())
    caps = np.array([wanted[c[0]][1] for c in cells], float)
    members, goals = [], []
    for at in (2, 1):
        kinds = sorted({c[at] for c in cells})
        member = np.array([kinds.index(c[at]) for c in cells], np.int64)
        members.append(member)
        goals.append(np.bincount(member, tokens, len(kinds)) if cells else np.zeros(0))
    members.append(np.array([names.index(c[0]) for c in cells], np.int64))
    goals.append(np.array([wanted[s][0] * total for s in names]))
    uses = rake(tokens, caps, members, goals)
    held = np.bincount(members[2], tokens, len(names)) if cells else np.zeros(len(names))
    got = np.bincount(members[2], tokens * uses, len(names)) if cells else np.zeros(len(names))
    sources = []
    for i, s in enumerate(names):
        goal = wanted[s][0] * total
        # short: what the last fit to the source marginal leaves open, every use being taken
        sources.append((s, wanted[s][0], wanted[s][1], int(held[i]), goal, float(got[i]), bool(got[i] < goal * (1 - 1e-9))))
    return Plan([(*c[:3], float(u)) for c, u in zip(cells, uses)], sources, total)


def short_sources(documents: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """source: those that stay below their share of all tokens even with every document used max_repeats times."""
    plan = mixture_plan(sized_documents(documents, targets, vocabulary), targets)
    return documents.sparkSession.createDataFrame([(s[0],) for s in plan.sources if s[6]], "source string")


def distinct_texts(sized: DataFrame) -> DataFrame:
    """One row for each text: that of the smallest doc_id. Copies by the million are folded before the shuffle."""
    columns = [c for c in sized.columns if c not in ("fingerprint", "doc_id")]
    first = sized.groupBy("fingerprint", "tokens").agg(F.min(F.struct("doc_id", *[c for c in columns if c != "tokens"])).alias("r"))
    return first.select("fingerprint", "tokens", "r.*")


def mixture(documents: DataFrame, targets: DataFrame, seed: int = 1, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source, tokens, uses (from 1 to max_repeats): the documents of the mixture.

    A text that several documents hold is used through the one of smallest doc_id, so no
    text is used more than max_repeats times. Documents without tokens are never used.
    """
    sized = durable(distinct_texts(sized_documents(documents, targets, vocabulary)))
    plan = mixture_plan(sized, targets)
    spark = documents.sparkSession
    weights = F.broadcast(spark.createDataFrame(plan.cells, "source string, lang string, topic string, weight double"))  # bounded like the cells
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    uses = (F.floor("weight") + (chance < F.col("weight") - F.floor("weight")).cast("int")).cast("int")
    drawn = sized.join(weights, ["source", "lang", "topic"]).withColumn("uses", F.least(uses, F.col("max_repeats")))
    return drawn.where("uses > 0 and tokens > 0").select("doc_id", "source", "tokens", "uses")


def mixture_shares(documents: DataFrame, targets: DataFrame, seed: int = 1, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """source, target_share, tokens, share: the shares of the mixture really reached, 0 for targets without documents."""
    mixed = mixture(documents, targets, seed, vocabulary).groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    wanted = _targets(targets).select("source", F.col("share").alias("target_share"))
    out = wanted.join(mixed, "source", "left").fillna(0, ["tokens"])
    total = out.agg(F.sum("tokens").alias("all"))
    return out.join(F.broadcast(total)).select("source", "target_share", "tokens", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0).alias("share"))
