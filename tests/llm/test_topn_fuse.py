import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm.fuse import ideal_point_ranking
from millrace.llm.topn import heavy_groups, top_n


def brute(rows, n):
    best = {}
    for g, c, s in rows:
        if g is not None and c is not None and s is not None and s == s:
            best[g, c] = max(best.get((g, c), float("-inf")), s)
    out = []
    for g in {g for g, _ in best}:
        items = sorted(((-s, c) for (h, c), s in best.items() if h == g))[:n]
        out += [(g, c, -s, i + 1) for i, (s, c) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_hot_and_cold_agree_with_brute_force(spark, hot_rows):
    rows = [("hot", f"c{i % 700}", float(i % 13)) for i in range(3000)] + [(f"g{i % 50}", f"c{i}", float(i % 3)) for i in range(500)]
    rows += [("hot", "c1", float("nan")), ("g1", None, 1.0), (None, "c", 1.0), ("g2", "c9", None), ("ties", "b", 1.0), ("ties", "a", 1.0)]
    df = spark.createDataFrame(rows, "g string, c string, s double").withColumn("rank", F.lit("clash"))
    found = top_n(df, ["g"], "c", "s", 5, hot_rows=hot_rows).collect()
    assert sorted(map(tuple, found)) == brute(rows, 5)
    assert top_n(df.limit(0), ["g"], "c", "s", 5).count() == 0


@pytest.mark.parametrize("broadcast_groups", [10**6, 100])
def test_every_group_above_the_limit_is_hot(spark, broadcast_groups):
    # none of the 1,500 groups holds a thousandth of the rows
    df = spark.range(1500 * 30).select(F.format_string("g%d", F.col("id") % 1500).alias("g"), F.format_string("c%d", (F.col("id") / 1500).cast("int") % 21).alias("c"), (F.col("id") * 7919 % 17).cast("double").alias("s"))
    assert heavy_groups(df, ["g"], 20).count() == 1500 and heavy_groups(df, ["g"], 30).count() == 0
    found = top_n(df, ["g"], "c", "s", 3, hot_rows=20, broadcast_groups=broadcast_groups).collect()
    assert sorted(map(tuple, found)) == brute([tuple(r) for r in df.collect()], 3)


def test_top_n_needs_a_positive_n(spark):
    with pytest.raises(ValueError):
        top_n(spark.range(1).toDF("g"), ["g"], "g", "g", 0)


def test_outliers_and_ranges_do_not_dominate(spark):
    good = [("q", f"good{i}", r, s) for i in range(3) for r, s in (("dense", 0.9 - i / 100), ("bm25", 11.0 - i / 10), ("cross_encoder", 0.99 - i / 100))]
    noise = [("q", f"n{i:02}", r, s) for i in range(20) for r, s in (("dense", 0.5 + i / 100), ("bm25", 4.0 + i / 5), ("cross_encoder", i / 100))]
    odd = [("q", "outlier", "bm25", 500.0), ("q", "n01", "bm25", None), ("q", "n02", "dense", float("nan")), ("q", "only", "rrf", 9.0), (None, "x", "dense", 1.0)]
    df = spark.createDataFrame(good + noise + odd + good, "query_id string, chunk_id string, retriever string, score double")
    ranked = ideal_point_ranking(df, {"dense": 1.0, "bm25": 1.0, "cross_encoder": 1.0}).orderBy("position").collect()
    assert [r.chunk_id for r in ranked[:3]] == ["good0", "good1", "good2"]
    assert "only" not in {r.chunk_id for r in ranked} and all(0 <= r.closeness <= 1 for r in ranked)
    assert [r.position for r in ranked] == list(range(1, len(ranked) + 1))


def closeness(rows, weights):
    """The ranking written anew over plain lists."""
    lists = {r: {} for r in weights}
    for c, r, x in rows:
        if r in lists and x is not None and x == x:
            lists[r][c] = max(x, lists[r].get(c, -math.inf))
    axes = {}
    for r, m in lists.items():
        x = sorted(m.values())
        if not x:
            continue
        a, b = x[math.ceil(len(x) / 4) - 1], x[math.ceil(3 * len(x) / 4) - 1]
        low, high = (max(x[0], a - 3 * (b - a)), min(x[-1], b + 3 * (b - a))) if b > a else (x[0], x[-1])
        m = {c: min(max(v, low), high) - low if high > low else 1.0 for c, v in m.items()}
        norm = math.sqrt(sum(v * v for v in m.values()))
        axes[r] = {c: weights[r] * math.sqrt(len(m)) * v / norm for c, v in m.items()}
    ideal = [max(m.values()) for m in axes.values()]
    out = []
    for c in {c for m in axes.values() for c in m}:
        v = [m.get(c, 0.0) for m in axes.values()]
        anti, near = math.hypot(*v), math.dist(v, ideal)
        out.append((-round(anti / (anti + near), 9), c))
    return [(c, -x) for x, c in sorted(out)]


def test_ranking_agrees_with_plain_lists(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(60):02}", r, s) for r, f in (("dense", lambda: rng.random()), ("bm25", lambda: rng.expovariate(0.1)), ("cross_encoder", lambda: rng.gauss(0, 5))) for s in [f() for _ in range(50)]]
    rows += [("c01", "bm25", 900.0), ("c02", "rrf", 5.0), ("c03", "dense", None)]
    df = spark.createDataFrame([("q", *r) for r in rows], "query_id string, chunk_id string, retriever string, score double")
    weights = {"dense": 1.0, "bm25": 1.0, "cross_encoder": 2.0}
    assert [(r.chunk_id, r.closeness) for r in ideal_point_ranking(df, weights).orderBy("position").collect()] == [(c, pytest.approx(x, abs=2e-9)) for c, x in closeness(rows, weights)]
    # another unit, origin or length of a list does not change what it says
    moved = df.withColumn("score", F.when(F.col("retriever") == "bm25", F.col("score") * 1000 - 7).otherwise(F.col("score")))
    assert [r.chunk_id for r in ideal_point_ranking(moved, weights).orderBy("position").collect()] == [c for c, _ in closeness(rows, weights)]


def test_infinite_scores_are_drawn_in(spark):
    df = spark.createDataFrame([("q", f"c{i}", "dense", s) for i, s in enumerate((0.1, 0.2, 0.3, float("inf"), float("-inf")))] + [("p", "c", "dense", float("inf"))], "query_id string, chunk_id string, retriever string, score double")
    assert [(r.query_id, r.chunk_id) for r in ideal_point_ranking(df, {"dense": 1.0}).orderBy("query_id", "position").collect()] == [("p", "c"), ("q", "c2"), ("q", "c3"), ("q", "c1"), ("q", "c0"), ("q", "c4")]


def test_equal_scores_and_empty_tables(spark):
    df = spark.createDataFrame([("q", "b", "dense", 1.0), ("q", "a", "dense", 1.0)], "query_id string, chunk_id string, retriever string, score double")
    assert [(r.chunk_id, r.closeness) for r in ideal_point_ranking(df, {"dense": 1.0}).orderBy("position").collect()] == [("a", 1.0), ("b", 1.0)]
    assert ideal_point_ranking(df.limit(0), {"dense": 1.0}).count() == 0
    with pytest.raises(ValueError):
        ideal_point_ranking(df, {})
