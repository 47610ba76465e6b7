import numpy as np
import pytest

from millrace.llm import neighbours
from millrace.llm.neighbours import balanced_parts, nearest, neighbour_graph

SCHEMA = "chunk_id string, embedding array<float>, part string"


def clustered(n, size=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(24, size))
    return (centres[rng.integers(0, 24, n)] + 0.6 * rng.normal(size=(n, size))).astype(np.float32)


def brute(ids, x, queries, k):
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(x @ x[ids.index(q)], 12)
        out[q] = [i for _, i in sorted((-v, i) for v, i in zip(s, ids) if i != q)[:k]]
    return out


def test_parts_are_balanced():
    x = clustered(2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = np.bincount(balanced_parts(neighbour_graph(x, 8), 8), minlength=8)
    assert size.max() <= 1.1 * 2000 / 8 + 2 and size.min() > 0


def test_recall_against_brute_force(spark):
    x = clustered(4000)
    ids = [f"c{i}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, x)], SCHEMA)
    asked = ids[::100]
    truth = brute(ids, x, asked, 10)
    found = nearest(df.where(df.chunk_id.isin(asked)), df, k=10, size=16, sample=2000, parts=8).collect()
    assert len(found) == 10 * len(asked)
    hits = sum(r.neighbour in truth[r.query] for r in found)
    assert hits / len(found) >= 0.9


def test_two_levels_of_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FIRST_PARTS", 4)
    x = clustered(4000)
    ids = [f"c{i}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, x)], SCHEMA)
    index = neighbours.fit_index(neighbours.usable(df, "chunk_id", "embedding", 16), 16, sample=2000, parts=16)
    assert index.second == 4 and len(index.cuts) == 4
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(index.place(unit), minlength=16)
    assert len(sizes) == 16 and (sizes > 0).sum() > 12
    routes = index.routes(unit[:50], 0.9)
    assert all(0 < len(r) <= 16 and len(set(r)) == len(r) for r in routes)
    assert all(len(a) <= len(b) for a, b in zip(routes, index.routes(unit[:50], 0.99)))
    asked = ids[::100]
    truth = brute(ids, x, asked, 10)
    found = nearest(df.where(df.chunk_id.isin(asked)), df, k=10, size=16, sample=2000, parts=16).collect()
    assert sum(r.neighbour in truth[r.query] for r in found) / len(found) >= 0.9


def test_parts_grow_with_the_rows():
    assert [neighbours.parts_for(n) for n in (0, 100, 17_330, 173_040, 10**9, 10**12)] == [(1, 1), (1, 1), (64, 1), (256, 1), (256, 64), (256, 256)]


def test_one_part_is_exact_with_dirt_copies_and_ties(spark):
    rows = [("a", [1.0, 0.0], ""), ("b", [2.0, 0.0], ""), ("c", [1.0, 0.0], ""), ("c", [1.0, 0.0], ""), ("d", [0.0, 1.0], ""), ("n", None, "")]
    rows += [("z", [0.0, 0.0], ""), ("s", [1.0], ""), ("x", [float("nan"), 1.0], ""), (None, [1.0, 1.0], ""), ("m", [None, 1.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.query, r.rank, r.neighbour) for r in nearest(df, df, k=2, size=2).collect())
    assert found == [("a", 1, "b"), ("a", 2, "c"), ("b", 1, "a"), ("b", 2, "c"), ("c", 1, "a"), ("c", 2, "b"), ("d", 1, "a"), ("d", 2, "b")]
    assert nearest(df, df.limit(0), k=2, size=2).count() == 0
    with pytest.raises(ValueError):
        nearest(df, df, k=0)
