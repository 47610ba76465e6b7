"""Top N items within every group (problem 3).

Hot-cold split. Exact group counts decide alone: a group of more than `hot_rows`
rows is hot, whatever share of the table that is. Hot groups are cut into score
ranges at their own quantiles, each range salted by a hash of the item, so that
neither a long group nor a long run of equal scores meets in one task; the best N
of each salted range go to a final sort. Cold groups use one ordinary window.
The results are united.

Cold rows are shuffled once, by group, hot ones by group and salt. The keys of hot
groups and the rows of hot groups are written tables. The keys are broadcast only
while there are at most BROADCAST_GROUPS of them (some 20 MB with the cuts); more
are joined by group and salt, each of them once for every salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import durable

RANGES, SALTS = 32, 16
#: Rows of a group in one task before it is split; more hot groups than this are joined instead of broadcast.
HOT_ROWS, BROADCAST_GROUPS = 50_000, 50_000


def _best(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("__score").desc(), F.col("__item").cast("string").asc())
    return rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n)


def heavy_groups(rows: DataFrame, names: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The groups of more than `hot_rows` rows, by exact counts."""
    return rows.groupBy(*names).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(*names)


def _joined(rows: DataFrame, groups: DataFrame, names: list[str], few: bool, how: str) -> DataFrame:
    """`rows` (with __salt) and what `groups` knows of theirs."""
    if few:
        return rows.join(F.broadcast(groups), names, how)
    return rows.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*names, "__salt"], how)


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int, hot_rows: int = HOT_ROWS, rank: str = "rank", broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The `n` best items of each group: groups, item, score (DOUBLE), rank from 1.

    Higher score first, equal scores by item ascending as a string. An item that
    occurs more than once in a group counts with its best score. Rows whose
    score is null or NaN, or whose group or item is null, are left out. Other columns
    of `df` are ignored, whatever they are called. An empty table gives an empty table.
    """
    if n < 1:
        raise ValueError("n must be greater than or equal to 1")
    names = [f"__g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(f"`{g}`").alias(a) for g, a in zip(groups, names)], F.col(f"`{item}`").alias("__item"), F.col(f"`{score}`").cast("double").alias("__score"))
    rows = rows.where(F.col("__score").isNotNull() & ~F.isnan("__score")).dropna(subset=[*names, "__item"])

    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("__item"), F.lit(SALTS)).cast("int"))
    heavy = durable(heavy_groups(rows, names, hot_rows))
    few = heavy.count() <= broadcast_groups

    cold = _joined(rows, heavy, names, few, "left_anti").repartition(*[F.col(x) for x in names])
    cold = _best(cold.groupBy(*names, "__item").agg(F.max("__score").alias("__score")), names, n)

    # read twice, for the cuts and for the rows
    hot = durable(_joined(rows, heavy, names, few, "inner").select(*names, "__salt", "__item", "__score"))
    # quantiles of the rows as they come: an item's repetitions shift a cut, never a result
    cuts = hot.groupBy(*names).agg(F.percentile_approx("__score", [i / RANGES for i in range(1, RANGES)], 1000).alias("__cuts"))
    # an item's rows share its salt, so their best is the item's
    hot = hot.repartition(*[F.col(x) for x in (*names, "__salt")]).groupBy(*names, "__salt", "__item").agg(F.max("__score").alias("__score"))
    hot = _joined(hot, cuts, names, few, "inner").withColumn("__range", F.size(F.filter("__cuts", lambda c: c <= F.col("__score"))))
    hot = _best(hot.drop("__cuts"), [*names, "__salt", "__range"], n).drop("__rank")
    out = cold.unionByName(_best(hot.select(*names, "__item", "__score"), names, n))
    return out.select(*[F.col(a).alias(g) for g, a in zip(groups, names)], F.col("__item").alias(item), F.col("__score").alias(score), F.col("__rank").cast("int").alias(rank))
