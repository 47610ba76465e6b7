"""One ranking from several differently scaled scores (problem 5).

Ideal-point ranking. Within each list (query and retriever) scores are winsorised
at Tukey's outer fences, shifted so that the lowest is 0 and vector-normalised:
divided by the length of the list's vector of scores. Each retriever is an axis. A
unit vector of n scores has a mean square of 1 / n, so an axis is weighted by the
square root of n, times the retriever's weight: all lists then have the same mean
square, whatever their range, shape and length, which is the equal say. The ideal
point has the best coordinate of every axis of the query, the anti-ideal point 0,
which is also what an item gets from a list it is missing from. Items are
sorted by relative closeness d(anti) / (d(ideal) + d(anti)), ties by item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Multiples of the interquartile range beyond which a score is drawn in to the fence.
FENCE = 3.0


def ideal_point_ranking(
    hits: DataFrame, retrievers: dict[str, float], query: str = "query_id", item: str = "chunk_id", score: str = "score", retriever: str = "retriever", top: int | None = None
) -> DataFrame:
    """query, item, closeness (DOUBLE in [0, 1]), position (INT from 1), the best `top` of each query or all.

    `retrievers` has the weight of each list that counts. Null and NaN scores and
    null keys are left out; an item that a list holds more than once counts with its
    best score. A list whose scores are all equal gives each of its items the
    full value, and so does one without finite scores. Infinite scores are drawn in to the
    fences. Queries without any usable score have no rows. `top` bounds what a query brings
    to one task; without it a whole query is sorted there.
    """
    if not retrievers or min(retrievers.values()) <= 0:
        raise ValueError("retrievers must have positive weights")
    rows = hits.select(F.col(f"`{query}`").alias("q"), F.col(f"`{item}`").alias("c"), F.col(f"`{retriever}`").alias("r"), F.col(f"`{score}`").cast("double").alias("x"))
    rows = rows.where(F.col("r").isin(*retrievers) & F.col("x").isNotNull() & ~F.isnan("x")).dropna(subset=["q", "c"])
    best = rows.groupBy("q", "r", "c").agg(F.max("x").alias("x"))

    # quartiles are exact up to 10,000 scores a list, and right to a ten-thousandth of the ranks beyond, in bounded memory
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    lists = best.groupBy("q", "r").agg(F.percentile_approx(finite, [0.25, 0.75], 10_000).alias("p"), F.min(finite).alias("least"), F.max(finite).alias("most"))
    spread = F.col("p")[1] - F.col("p")[0]
    low, high = F.greatest("least", F.col("p")[0] - FENCE * spread), F.least("most", F.col("p")[1] + FENCE * spread)
    # lists of which three quarters are equal have no spread to fence with
    lists = lists.select("q", "r", F.when(spread > 0, low).otherwise(F.col("least")).alias("low"), F.when(spread > 0, high).otherwise(F.col("most")).alias("high"))

    drawn = F.least(F.greatest("x", "low"), F.col("high")) - F.col("low")
    drawn = best.join(lists, ["q", "r"]).select("q", "r", "c", F.when(F.col("high") > F.col("low"), drawn).otherwise(F.lit(1.0)).alias("x"))
    say = F.create_map(*[v for k, w in retrievers.items() for v in (F.lit(k), F.lit(float(w)))])[F.col("r")]
    axes = drawn.groupBy("q", "r").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.max("x").alias("top"), F.sqrt(F.count("*")).alias("root"))
    axes = axes.select("q", "r", "norm", (say * F.col("root")).alias("weight"), (say * F.col("root") * F.col("top") / F.col("norm")).alias("ideal"))
    # one row a query: how far the anti-ideal point is from the ideal one
    gaps = axes.groupBy("q").agg(F.sum(F.col("ideal") * F.col("ideal")).alias("gap"))
    points = drawn.join(axes.join(gaps, "q"), ["q", "r"]).select("q", "c", (F.col("weight") * (F.col("x") / F.col("norm"))).alias("v"), "ideal", "gap")

    # the axes of lists that an item is missing from are left of `gap` when those it is in are taken off
    left = F.sum((F.col("ideal") - F.col("v")) * (F.col("ideal") - F.col("v")) - F.col("ideal") * F.col("ideal")) + F.max("gap")
    sums = points.groupBy("q", "c").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("anti"), F.sqrt(F.greatest(left, F.lit(0.0))).alias("near"))
    ranked = sums.select("q", "c", F.round(F.col("anti") / (F.col("anti") + F.col("near")), 9).alias("closeness"))
    ranked = ranked.withColumn("position", F.row_number().over(Window.partitionBy("q").orderBy(F.col("closeness").desc(), F.col("c").cast("string"))))
    if top is not None:
        ranked = ranked.where(F.col("position") <= top)
    return ranked.select(F.col("q").alias(query), F.col("c").alias(item), "closeness", "position")
