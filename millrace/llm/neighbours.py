"""The most similar vectors for every vector of a query set (problem 2).

Learned partitions, as many as the collection asks for:

1. A bounded sample (`sample` rows of smallest hash, by a bound set from the exact
   count) gets its exact neighbour graph, which is cut into balanced parts: recursive
   bisection at the median of a vector smoothed over the graph, then rounds in which
   nodes move to the part of most of their neighbours while that part has room.
2. A small classifier (one hidden layer) learns the part of a vector; every row of
   the collection is put into the part it names.
3. A second one learns where the neighbours of a vector lie under that
   assignment. It routes a query to the most probable parts until `mass` of the
   probability is covered.
4. Parts grow with the root of the collection. Beyond FIRST_PARTS of them each part
   is cut again, by the same three steps on a bounded sample of its own rows, all
   parts at once on the executors; a leaf is as probable as its part times itself.
5. Leaves are cut into blocks by exact counts, so neither a popular leaf nor
   copies of one vector by the million meet in one task. Each block scores its
   queries in one matrix product and reranks its best in double precision; a
   final window keeps k for each query.

Only the fits are on samples; every usable row is indexed. The models are bounded
(FIRST_PARTS + 1 pairs of networks below 170 kB each) and travel with the functions.
With `parts=1` the search is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the first cut is fitted on, and rows of each part that its own cut is fitted on.
SAMPLE, PART_SAMPLE = 24_576, 8_192
#: Parts are PARTS_OF_ROOT times the root of the rows, on two levels of at most so many.
PARTS_OF_ROOT, FIRST_PARTS, SECOND_PARTS = 0.63, 256, 256
#: A part is fitted on so many sampled rows at least, or there are fewer parts.
ROWS_A_PART = 40
MASS, BLOCK_ROWS = 0.97, 20_000


@dataclass
class Network:
    """A softmax classifier with one hidden layer, trained by Adam on soft labels."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray, hidden: int = 96, epochs: int = 14, batch: int = 256, rate: float = 3e-3, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, labels.shape[1])), np.zeros(labels.shape[1])]
        p = [a.astype(np.float32) for a in p]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            step = rate * (1 - epoch / epochs)
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                h = np.maximum(x[rows] @ p[0] + p[1], 0)
                g = (Network(*p).probabilities(x[rows]) - labels[rows]) / len(rows)
                gh = (g @ p[2].T) * (h > 0)
                t += 1
                for i, d in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                    m[i] += 0.1 * (d - m[i])
                    v[i] += 0.01 * (d * d - v[i])
                    p[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
        return Network(*p)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k most similar other rows of each row of unit vectors."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, room: float = 1.08, seed: int = 7) -> np.ndarray:
    """A part from 0 to parts - 1 (a power of two) for each node; none much larger than the rest."""
    n, k = graph.shape
    rng = np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), k), graph.ravel()
    part = np.zeros(n, np.int64)
    for level in range(parts.bit_length() - 1):
        f = rng.normal(size=n)
        inside = part[a] == part[b]
        x, y = a[inside], b[inside]
        degree = np.bincount(x, minlength=n) + np.bincount(y, minlength=n) + 1
        size = np.bincount(part, minlength=1 << level)
        for _ in range(30):
            f = (f + np.bincount(x, f[y], n) + np.bincount(y, f[x], n)) / degree
            f -= (np.bincount(part, f * degree, 1 << level) / np.bincount(part, degree, 1 << level))[part]
            f /= np.sqrt(np.bincount(part, f * f, 1 << level) / np.maximum(size, 1) + 1e-30)[part]
        order = np.lexsort((f, part))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        begin = np.cumsum(size) - size
        part = part * 2 + (place - begin[part] >= size[part] / 2)
    cap = int(room * n / parts) + 1
    for _ in range(rounds):
        votes = (np.bincount(a * parts + part[b], minlength=n * parts) + np.bincount(b * parts + part[a], minlength=n * parts)).reshape(n, parts)
        want = votes.argmax(1)
        gain = votes[np.arange(n), want] - votes[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[want[i]] < cap:
                size[part[i]] -= 1
                size[want[i]] += 1
                part[i] = want[i]
    return part


@dataclass
class Cut:
    """One level: which part a vector belongs to, and which parts its neighbours are in."""

    assign: Network
    route: Network
    parts: int

    @staticmethod
    def fit(x: np.ndarray, parts: int, k: int = 12, hidden: int = 128) -> Cut | None:
        """From unit vectors; None if they are too few for two parts."""
        while parts > 1 and len(x) < parts * ROWS_A_PART:
            parts //= 2
        if parts == 1:
            return None
        x = x.astype(np.float32)
        graph = neighbour_graph(x, k)
        row = np.repeat(np.arange(len(x)) * parts, k)

        def shares(part: np.ndarray) -> np.ndarray:
            """The parts of each row's neighbours."""
            return (np.bincount(row + part[graph].ravel(), minlength=len(x) * parts).reshape(-1, parts) / np.float32(k)).astype(np.float32)

        part = balanced_parts(graph, parts)
        own = 0.5 * shares(part)
        own[np.arange(len(x)), part] += 0.5
        assign = Network.fit(x, own, hidden)
        return Cut(assign, Network.fit(x, shares(assign.probabilities(x).argmax(1)), hidden), parts)


@dataclass
class PartitionIndex:
    """A first cut (None: one part) and the cuts of its parts. Leaves are numbered part * second + part within it."""

    first: Cut | None
    second: int = 1
    cuts: dict[int, Cut] = field(default_factory=dict)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        x = x.astype(np.float32)
        part = self.first.assign.probabilities(x).argmax(1) if self.first else np.zeros(len(x), np.int64)
        leaf = part * self.second
        for p in np.unique(part).tolist():
            if p in self.cuts:
                rows = np.flatnonzero(part == p)
                leaf[rows] += self.cuts[p].assign.probabilities(x[rows]).argmax(1)
        return leaf

    def routes(self, x: np.ndarray, mass: float) -> list[list[int]]:
        """The most probable leaves of each query until `mass` is covered."""
        x = x.astype(np.float32)
        if not self.first:
            return [[0]] * len(x)
        probable = self.first.route.probabilities(x)
        order = np.argsort(-probable, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(probable, order, 1), axis=1)
        # parts beyond this cannot matter to what `mass` is covered with
        taken = reached - np.take_along_axis(probable, order, 1) < 1 - (1 - mass) / 4
        row, place = np.nonzero(taken)
        part = order[row, place]
        query, leaf, weight = [], [], []
        for p in np.unique(part).tolist():
            rows = row[part == p]
            cut = self.cuts.get(p)
            inner = cut.route.probabilities(x[rows]) if cut else np.ones((len(rows), 1), np.float32)
            query.append(np.repeat(rows, inner.shape[1]))
            leaf.append(np.tile(p * self.second + np.arange(inner.shape[1]), len(rows)))
            weight.append((probable[rows, p][:, None] * inner).ravel())
        query, leaf, weight = (np.concatenate(v) for v in (query, leaf, weight))
        order = np.lexsort((-weight, query))
        query, leaf, weight = query[order], leaf[order], weight[order]
        begin = np.searchsorted(query, np.arange(len(x)))
        total = np.cumsum(weight, dtype=np.float64)
        before = total - weight - np.concatenate([[0.0], total])[begin][query]
        keep = before < mass
        return [part.tolist() for part in np.split(leaf[keep], np.searchsorted(query[keep], np.arange(1, len(x))))]


def usable(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """id and v (ARRAY<FLOAT>) of the rows whose vector has `size` finite values, not all zero."""
    v = F.col(f"`{vector}`").cast("array<float>")
    good = (F.size(v) == size) & F.col(f"`{key}`").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{key}`").cast("string").alias("id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def parts_for(rows: int) -> tuple[int, int]:
    """Parts of the two levels for a collection of so many rows; powers of two."""
    wanted = int(log2(max(1.0, min(PARTS_OF_ROOT * sqrt(rows), rows / 64))))
    first = min(wanted, int(log2(FIRST_PARTS)))
    return 1 << first, 1 << min(wanted - first, int(log2(SECOND_PARTS)))


def _sampled(rows: DataFrame, share: float) -> DataFrame:
    """Rows whose key's hash is among the smallest `share`; each key once."""
    return rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40)) < F.lit(int(min(share, 1.0) * (1 << 40)))).dropDuplicates(["id"])


def fit_index(vectors: DataFrame, size: int, sample: int = SAMPLE, parts: int | None = None, part_sample: int = PART_SAMPLE) -> PartitionIndex:
    """The index of `usable` rows. About `sample` of them come to the driver; `part_sample` for each part are fitted on where they are."""
    count = vectors.count()
    first, second = parts_for(count) if parts is None else (min(parts, FIRST_PARTS), max(1, parts // FIRST_PARTS))
    if first == 1:
        return PartitionIndex(None)
    rows = _sampled(vectors, sample / count).toArrow()
    top = PartitionIndex(Cut.fit(_matrix(rows["v"], size), first) if rows.num_rows else None)
    if second == 1 or not top.first:
        return top

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top.place(_matrix(batch.column(1), size)), pa.int32())], names=["id", "v", "part"])

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        cut = Cut.fit(_matrix(rows["v"], size), second, hidden=64)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cut": pa.array([pickle.dumps(cut)], pa.binary())})

    some = _sampled(vectors, part_sample * first / count).mapInArrow(place, "id string, v array<float>, part int")
    fitted = some.groupBy("part").applyInArrow(fit, "part int, cut binary").toArrow()  # at most FIRST_PARTS rows
    cuts = {p: pickle.loads(c) for p, c in zip(fitted["part"].to_pylist(), fitted["cut"].to_pylist())}
    return PartitionIndex(top.first, second, {p: c for p, c in cuts.items() if c})


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "chunk_id", vector: str = "embedding", size: int = 64, sample: int = SAMPLE, parts: int | None = None, mass: float = MASS
) -> DataFrame:
    """query, neighbour, similarity, rank: the k most similar other rows of `vectors` for each row of `queries`, by cosine.

    Vectors that are null, of another size, all zero or hold nulls, NaN or infinities
    are left out on both sides, as are null keys. A key that occurs more than
    once counts once, with its best similarity. Ties go to the smaller key as a
    string. Fewer than k other rows give fewer. Recall is below 1: see README; with
    `parts=1` all rows are compared and the result is exact.
    """
    if k < 1:
        raise ValueError("k must be greater than or equal to 1")
    pool, asked = usable(vectors, key, vector, size), usable(queries, key, vector, size)
    spark = vectors.sparkSession
    fitted = spark.sparkContext.broadcast(fit_index(pool, size, sample, parts))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = pa.array(fitted.value.place(_matrix(batch.column(1), size)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), part], names=["id", "v", "part"])

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                to = pa.array(fitted.value.routes(_matrix(batch.column(1), size), mass), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), to], names=["id", "v", "to"])

    placed = pool.mapInArrow(place, "id string, v array<float>, part int")
    # one row for each leaf: at most FIRST_PARTS x SECOND_PARTS
    blocks = placed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    blocks = F.broadcast(blocks)
    stored = placed.join(blocks, "part").select("id", "v", "part", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    routed = asked.dropDuplicates(["id"]).mapInArrow(route, "id string, v array<float>, to array<int>")
    routed = routed.select("id", "v", F.explode("to").alias("part")).join(blocks, "part")
    routed = routed.select("id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.string()), "neighbour": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q, x = _matrix(left["v"], size), _matrix(right["v"], size)
        qid, xid = np.array(left["id"].to_pylist(), object), np.array(right["id"].to_pylist(), object)
        order = np.argsort(xid, kind="stable")  # equal similarities then come by key
        x, xid = x[order], xid[order]
        _, number = np.unique(xid, return_inverse=True)
        most = int(np.bincount(number).max())
        x32, out = x.astype(np.float32), ([], [], [])
        for at in range(0, len(q), 256):
            s = q[at : at + 256].astype(np.float32) @ x32.T
            take = min((k + 1) * most + 8, len(x))
            floor = np.partition(s, len(x) - take, axis=1)[:, len(x) - take] - np.float32(1e-5)
            for i in range(len(s)):
                near = np.flatnonzero(s[i] >= floor[i])
                exact = np.round(x[near] @ q[at + i], 12)
                best = near[np.lexsort((near, -exact))]
                value = np.sort(-exact)
                seen: set[int] = set()
                for j, v in zip(best.tolist(), (-value).tolist()):
                    if xid[j] != qid[at + i] and number[j] not in seen:
                        seen.add(number[j])
                        out[0].append(qid[at + i]), out[1].append(xid[j]), out[2].append(v)
                        if len(seen) == k:
                            break
        return pa.table({"query": pa.array(out[0], pa.string()), "neighbour": pa.array(out[1], pa.string()), "similarity": pa.array(out[2], pa.float64())})

    found = routed.groupBy("part", "block").cogroup(stored.groupBy("part", "block")).applyInArrow(score, "query string, neighbour string, similarity double")
    found = found.groupBy("query", "neighbour").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
