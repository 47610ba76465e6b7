"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 8).

Speculate and verify. Texts are cut into words by the vocabulary's own split
pattern; each distinct word of a worker is encoded once:

1. Speculation: greedy longest match through a byte trie. All new words advance
   together, one byte a step, through sorted (node, byte) keys, so a step is one
   binary search over a numpy array.
2. Verification: a BPE encoding is right exactly if each adjacent pair of its
   tokens is what the merges make of the pair's own bytes (provided that every
   token of the vocabulary encodes to itself, which is checked when the codec is
   built; tokens that do not are kept out of the trie). The pairs of all words
   are tested at once against the verdicts known so far; a new pair costs one
   merge of a few bytes.
3. Only words with a failing pair are merged exactly.

A word of L bytes takes at most L steps, and all new words of a batch take them together: 0.02 ms a step, so a run of 10 MB
without any cut takes some minutes of one task.

Words are looked up by index and ids gathered with numpy, so nothing runs per
token in Python. The vocabulary file's path is a parameter; it is read by the
driver and sent to the executors (its size is checked, see MAX_VOCABULARY_MB).
"""

from __future__ import annotations

import base64
import re
import threading
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary file is broadcast; anything larger than this is refused.
MAX_VOCABULARY_MB = 64
#: Distinct words and pairs of tokens that a worker remembers; beyond it the memory starts anew.
WORDS_KEPT, PAIRS_KEPT = 1_500_000, 2_000_000

#: The split pattern of the rank files.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for the quicker `re`, where \w stands for letters and all numbers. It differs only for
# words holding letter-like or other numbers (categories Nl, No) or the separators U+001C to U+001F;
# texts with such a word are cut again by the exact pattern.
_EXACT = regex.compile(SPLIT_PATTERN)
_QUICK = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


_ODD = re.compile("[\x1c-\x1f" + "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) in ("Nl", "No")) + "]")


class _WordIndex(dict):
    """Word to number; a word asked for the first time gets the next number."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def exact_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one word by its definition: join the adjacent pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class SpeculativeCodec:
    """Encodes batches of texts; one per Python worker, see `codec_for`."""

    def __init__(self, rank_file: bytes):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}
        # cuts nothing: each text is one word to it
        self.merger = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})
        self.token_bytes = {i: b for b, i in self.ranks.items()}
        self._build_trie()
        self.pair_keys = np.empty(0, np.int64)
        self.pair_fits = np.empty(0, bool)
        self._forget()

    def _merge(self, piece: bytes) -> list[int]:
        """BPE of one word; parts of characters, which only short pairs of tokens can be, by the definition."""
        try:
            return self.merger.encode_ordinary(piece.decode())
        except UnicodeDecodeError:
            return exact_merge(piece, self.ranks)

    def _build_trie(self) -> None:
        nodes: dict[int, int] = {}
        accept = [-1]
        for token, number in self.ranks.items():
            if self._merge(token) != [number]:
                continue
            at = 0
            for byte in token:
                key = at * 256 + byte
                if key not in nodes:
                    nodes[key] = len(accept)
                    accept.append(-1)
                at = nodes[key]
            accept[at] = number
        keys = np.fromiter(nodes.keys(), np.int64, len(nodes))
        order = np.argsort(keys)
        self.trie_keys = keys[order]
        self.trie_next = np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.trie_accept = np.array(accept, np.int64)

    def _forget(self) -> None:
        self.words = _WordIndex()
        self.word_ids = np.empty(0, np.int32)
        self.word_ends = np.zeros(1, np.int64)
        self.odd: set[int] = set()

    def _greedy(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of the byte ranges: (range number, token), in order within each range."""
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, begin = starts.copy(), starts.copy()
        node = np.zeros(len(starts), np.int64)
        good, good_end = np.full(len(starts), -1), starts.copy()
        alive = np.arange(len(starts))
        out_range, out_token = [], []
        while len(alive):
            inside = at[alive] < ends[alive]
            key = node[alive] * 256 + data[np.minimum(at[alive], len(data) - 1)]
            slot = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            moves = inside & (self.trie_keys[slot] == key)
            going = alive[moves]
            node[going] = self.trie_next[slot[moves]]
            at[going] += 1
            token = self.trie_accept[node[going]]
            hit = going[token >= 0]
            good[hit], good_end[hit] = token[token >= 0], at[hit]
            stuck = alive[~moves]
            out_range.append(stuck)
            out_token.append(good[stuck])
            at[stuck] = begin[stuck] = good_end[stuck]
            node[stuck] = 0
            alive = np.concatenate([going, stuck[good_end[stuck] < ends[stuck]]])
        ranges, tokens = np.concatenate(out_range), np.concatenate(out_token)
        order = np.argsort(ranges, kind="stable")
        return ranges[order], tokens[order]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each adjacent pair, whether the merges leave it as it is."""
        keys, where = np.unique(left * (1 << 31) + right, return_inverse=True)
        slot = np.searchsorted(self.pair_keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.pair_keys):
            known = self.pair_keys[np.minimum(slot, len(self.pair_keys) - 1)] == keys
        if not known.all():
            fresh = keys[~known]
            verdict = np.fromiter((self._merge(self.token_bytes[k >> 31] + self.token_bytes[k & 0x7FFFFFFF]) == [k >> 31, k & 0x7FFFFFFF] for k in fresh.tolist()), bool, len(fresh))
            place = slot[~known]
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, place, fresh), np.insert(self.pair_fits, place, verdict)
            slot = np.searchsorted(self.pair_keys, keys)
        fits = self.pair_fits[slot][where]
        if len(self.pair_keys) > PAIRS_KEPT:
            self.pair_keys, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        return fits

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids of the words one after another, their end offsets, and how many words failed verification."""
        pieces = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        of, tokens = self._greedy(data, ends - sizes, ends)
        failed = np.empty(0, np.int64)
        if len(tokens) > 1:
            same = np.flatnonzero(of[1:] == of[:-1])
            failed = np.unique(of[same][~self._compatible(tokens[same], tokens[same + 1])])
        counts = np.bincount(of, minlength=len(words))
        if len(failed):
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            for k in failed.tolist():
                parts[k] = np.array(self._merge(pieces[k]), np.int64)
            counts = np.fromiter(map(len, parts), np.int64, len(parts))
            tokens = np.concatenate(parts)
        return tokens.astype(np.int32), np.cumsum(counts), len(failed)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts one after another, and how many words each has."""
        if len(self.words) > WORDS_KEPT:
            self._forget()
        cut = [_QUICK.findall(t) for t in texts]
        while True:
            numbers = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
            fresh = [w for w, n in zip(reversed(self.words), range(len(self.words) - 1, len(self.word_ends) - 2, -1))][::-1]
            if fresh:
                base = len(self.word_ends) - 1
                self.odd.update(base + i for i, w in enumerate(fresh) if _ODD.search(w))
                ids, ends, _ = self.encode_words(fresh)
                self.word_ids = np.concatenate([self.word_ids, ids])
                self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + ends])
            counts = np.fromiter(map(len, cut), np.int64, len(cut))
            if not self.odd:
                return numbers, counts
            hit = np.isin(numbers, np.fromiter(self.odd, np.int64, len(self.odd)))
            texts_hit = np.unique(np.repeat(np.arange(len(cut)), counts)[hit])
            again = False
            for k in texts_hit.tolist():
                exact = _EXACT.findall(texts[k])
                if exact != cut[k]:
                    cut[k], again = exact, True
            if not again:
                return numbers, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another and the offsets of each text; null and empty texts have none."""
        numbers, words = self._cut([t or "" for t in texts])
        first, size = self.word_ends[:-1][numbers], np.diff(self.word_ends)[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.word_ids[np.repeat(first - (ends - size), size) + np.arange(total)]
        at = np.concatenate([[0], ends])
        return ids, at[np.concatenate([[0], np.cumsum(words)])]


_codecs: dict[int, SpeculativeCodec] = {}
_lock = threading.Lock()


def codec_for(rank_file: bytes) -> SpeculativeCodec:
    """The worker's codec for this vocabulary; kept between tasks."""
    with _lock:
        key = hash(rank_file)
        if key not in _codecs:
            _codecs[key] = SpeculativeCodec(rank_file)
        return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    file = Path(path)
    if file.stat().st_size > MAX_VOCABULARY_MB * 2**20:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_MB} MB")
    return file.read_bytes()


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """`keep` (by default all columns but `text`) and the token ids of `text` as ARRAY<INT>.

    Null and empty texts have an empty list; blank texts have the ids of their
    blanks. Markers of special tokens are ordinary text. Lone surrogates cannot
    occur in Spark strings. A column called like `ids` is replaced. Repeated rows
    stay repeated; an empty table gives an empty table.
    """
    keep = [c for c in (keep if keep is not None else df.columns) if c not in (text, ids)]
    files = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(files.value)
        for batch in _slices(batches):
            values, offsets = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keep, ids])

    kept = df.select(*[f"`{c}`" for c in keep], f"`{text}`")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{ids}` array<int>"])
    return kept.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", count: str = "tokens", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The other columns of `df` and the number of tokens of `text`; null and empty texts have 0."""
    keep = [c for c in df.columns if c not in (text, count)]
    files = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(files.value)
        for batch in _slices(batches):
            _, offsets = codec.encode(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(offsets), pa.int64())], names=[*keep, count])

    kept = df.select(*[f"`{c}`" for c in keep], f"`{text}`")
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{count}` bigint"])
    return kept.mapInArrow(run, schema)
