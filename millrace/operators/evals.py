"""Evaluation: retrieval metrics, chunk quality, latency, index parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def retrieval_metrics(qrels: DataFrame, rankings: DataFrame, group: list[str] | None = None, strict: bool = False) -> DataFrame:
    """recall_at_5, recall_at_10, mrr, ndcg_at_10, cases: averages over the cases of qrels (case_id, chunk_id).

    `rankings` has case_id, chunk_id, rank and the columns of `group`. Recall counts a chunk once, NDCG each
    time; the reciprocal rank looks at the whole ranking. Cases without ranking count as 0 (see `missing_cases`), or
    are an error if `strict`, as is a table without cases (which is looked at then and there).
    """
    group = group or []
    relevant = qrels.select("case_id", "chunk_id").distinct()
    sizes = relevant.groupBy("case_id").agg(F.count("*").alias("n"))
    if strict:
        if sizes.isEmpty():
            raise ValueError("there are no cases")
        if missing := [r.case_id for r in missing_cases(qrels, rankings).orderBy("case_id").take(20)]:
            raise ValueError(f"cases without ranking: {', '.join(map(str, missing))}")
    hits = rankings.join(relevant, ["case_id", "chunk_id"])
    within = lambda k, c: F.when(F.col("rank") <= k, c)
    found = hits.groupBy("case_id", *group).agg(
        F.countDistinct(within(5, F.col("chunk_id"))).alias("r5"), F.countDistinct(within(10, F.col("chunk_id"))).alias("r10"), F.min("rank").alias("first"), F.sum(within(10, 1 / F.log2(F.col("rank") + 1))).alias("gain")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    each = found.join(sizes, "case_id").select(*group, (F.col("r5") / F.col("n")).alias("a"), (F.col("r10") / F.col("n")).alias("b"), (1 / F.col("first")).alias("c"), (F.col("gain") / ideal).alias("d"))
    # cases that a strategy found nothing for add nothing to its sums, but count
    sums = each.groupBy(*group).agg(*[F.sum(c).alias(c) for c in "abcd"])
    strategies = rankings.select(*group).distinct().join(sums, group, "left") if group else sums
    cases = F.broadcast(sizes.agg(F.count("*").alias("cases")))  # one row
    mean = lambda c, name: F.round(F.coalesce(F.col(c), F.lit(0.0)) / F.col("cases"), 6).alias(name)
    return strategies.join(cases).where("cases > 0").select(*group, mean("a", "recall_at_5"), mean("b", "recall_at_10"), mean("c", "mrr"), mean("d", "ndcg_at_10"), "cases")


def checked_cases(cases: DataFrame) -> DataFrame:
    """`cases` (id, relevant_chunk_ids, rankings) as they are; an error where an id is blank or comes twice, where nothing is relevant,
    where a ranking names a chunk twice, or where cases are ranked by different strategies."""
    strategies = F.array_sort(F.map_keys("rankings"))
    ids = cases.groupBy("id").agg(F.count("*").alias("_copies"), F.min(F.to_json(strategies)).alias("_s"))
    every = ids.agg(F.min("_s").alias("_all"))
    repeated = F.exists(F.map_values("rankings"), lambda r: F.size(r) != F.size(F.array_distinct(r)))
    said = lambda text: F.concat(F.lit(f"{text}: "), F.coalesce("id", F.lit("null")))
    fault = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", said("case without id")).when(F.col("_copies") > 1, said("case twice")).when(F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) < 1, said("case without relevant chunks"))
        .when(repeated, said("ranking with a chunk twice")).when(F.to_json(strategies) != F.col("_all"), said("case ranked by other strategies"))
    )
    checked = cases.join(ids.select("id", "_copies"), "id", "left").join(F.broadcast(every))
    return checked.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.lit(True))).select(*cases.columns)


def missing_cases(qrels: DataFrame, rankings: DataFrame) -> DataFrame:
    return qrels.select("case_id").distinct().join(rankings.select("case_id").distinct(), "case_id", "left_anti")


def chunk_quality(chunks: DataFrame, group: list[str] | None = None) -> DataFrame:
    """chunk_count, avg_chars, p95_chars, avg_tokens, p95_tokens, overlap_ratio, context_complete_ratio.

    Overlap is what a chunk shares with the one before it in its document, by start and end, over all characters.
    Complete chunks have a source, a document, a hash, offsets, a token count and a splitter. No chunks: zeros.
    """
    group = group or []
    before = F.lag("end_char").over(Window.partitionBy(*group, "document_id").orderBy("start_char", "end_char", "chunk_id"))
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("source_uri", "document_id", "content_hash")] + [F.col(c).isNotNull() for c in ("start_char", "end_char", "token_count", "splitter")]
    complete = filled[0]
    for f in filled[1:]:
        complete = complete & f
    placed = F.col("start_char").isNotNull() & F.col("end_char").isNotNull()
    rows = chunks.select(*group, F.length("content").alias("chars"), F.coalesce("token_count", F.lit(0)).alias("tokens"), F.when(placed, F.greatest(F.lit(0), before - F.col("start_char"))).alias("shared"), complete.cast("double").alias("complete"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return rows.groupBy(*group).agg(
        F.count("*").alias("chunk_count"), zero(F.round(F.avg("chars"), 3), "avg_chars"), zero(F.expr("percentile_disc(0.95) within group (order by chars)").cast("double"), "p95_chars"),
        zero(F.round(F.avg("tokens"), 3), "avg_tokens"), zero(F.expr("percentile_disc(0.95) within group (order by tokens)").cast("double"), "p95_tokens"),
        zero(F.round(F.sum("shared") / F.sum("chars"), 6), "overlap_ratio"), zero(F.round(F.avg("complete"), 6), "context_complete_ratio"),
    )


def latency_percentiles(events: DataFrame, task: str, stage: str, at: str, first: str, last: tuple[str, ...]) -> DataFrame:
    """tasks, p50_ms, p95_ms, max_ms, throughput: from the first event of stage `first` to the terminal one of each task."""
    millis = F.unix_micros(F.col(at).cast("timestamp")) / 1000.0
    per_task = events.groupBy(task).agg(F.min(F.when(F.col(stage) == first, millis)).alias("a"), F.max(F.when(F.col(stage).isin(*last), millis)).alias("b"))
    done = per_task.where("a is not null and b >= a").select("a", "b", (F.col("b") - F.col("a")).alias("ms"))
    pct = lambda p: F.expr(f"percentile_disc({p}) within group (order by ms)")
    span = (F.max("b") - F.min("a")) / 1000.0
    return done.agg(F.count("*").alias("tasks"), F.round(pct(0.5), 3).alias("p50_ms"), F.round(pct(0.95), 3).alias("p95_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(F.when(span > 0, F.count("*") / span), 6).alias("throughput"))


def concurrency(events: DataFrame, task: str, stage: str, at: str, first: str, last: tuple[str, ...], group: list[str] | None = None) -> DataFrame:
    """group, most_at_once, tasks: the most tasks that ran at one time, from their first event of stage `first` to the terminal one.

    Starts and ends are counted a moment at a time before they are summed up; at one moment ends come before starts.
    """
    group = group or []
    spans = events.groupBy(*group, task).agg(F.min(F.when(F.col(stage) == first, F.col(at))).alias("a"), F.max(F.when(F.col(stage).isin(*last), F.col(at))).alias("b")).where("a < b")
    steps = spans.select(*group, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("step")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("step")))).alias("s")).select(*group, "s.*")
    moments = steps.groupBy(*group, "at").agg(F.sum("step").alias("step"), F.sum(F.when(F.col("step") > 0, 1).otherwise(0)).alias("starts"))
    running = F.sum("step").over(Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return moments.withColumn("running", running).groupBy(*group).agg(F.max("running").cast("int").alias("most_at_once"), F.sum("starts").alias("tasks"))


#: Name, links of a node, search width at build and at query, scalar quantisation, payload index.
INDEX_PROFILES = (("low_latency", 12, 64, 64, True, True), ("balanced", 16, 128, 128, False, True), ("high_recall", 32, 256, 256, False, True), ("filtered_without_payload_index", 16, 128, 128, False, False))


def index_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INDEX_PROFILES, "profile string, m int, ef_construct int, search_ef int, quantised boolean, payload_indexed boolean")


def profile_faults() -> Column:
    """Faults of a profile's parameters, ARRAY<STRING>; empty where there is none."""
    rules = [(F.coalesce(F.trim("profile"), F.lit("")) == "", "profile has no name"), *[(F.coalesce(F.col(c), F.lit(0)) < 1, f"{c} is not above 0") for c in ("m", "ef_construct", "search_ef")]]
    return F.filter(F.array(*[F.when(wrong, F.lit(text)) for wrong, text in rules]), lambda f: f.isNotNull())


def estimate_index(profiles: DataFrame, vectors: int = 50_000, dimension: int = 1024, top_k: int = 5, selectivity: float = 0.05) -> DataFrame:
    """Recall, latency, memory and build cost of graph index parameters by a closed form, and the recommended default.

    The default has no filter penalty and a recall within 0.005 of the best, if there is one, and the least
    sum of latency, memory and build cost.
    """
    if vectors < 1 or dimension < 1 or top_k < 1 or not 0 < selectivity <= 1:
        raise ValueError("vectors, dimension and top_k must be positive, selectivity in (0, 1]")
    quantised = F.col("quantised")
    faults = profile_faults()
    profiles = profiles.where(F.when(F.size(faults) > 0, F.raise_error(F.array_join(faults, ", ")).cast("boolean")).otherwise(F.lit(True)))
    # fixed values of the model
    penalty = F.when(F.col("payload_indexed"), 0.0).otherwise(55.0 * (1 - selectivity))
    recall = F.least(F.lit(0.995), 0.63 + 0.032 * F.log2("search_ef") + 0.022 * F.log2("m") + 0.018 * F.log2("ef_construct") - F.when(quantised, 0.025).otherwise(0.0))
    latency = (2.0 + 1.6 * F.log10(F.lit(vectors)) + 0.045 * F.col("search_ef") + 0.18 * top_k + penalty) * F.when(quantised, 0.88).otherwise(1.0)
    memory = (vectors * dimension * F.when(quantised, 1).otherwise(4) + vectors * F.col("m") * 8) / 1048576
    rows = profiles.select(
        "profile", F.round(recall, 3).alias("recall"), F.round(latency, 3).alias("p95_ms"), F.round(memory, 3).alias("memory_mb"),
        F.round(vectors * F.col("m") * F.col("ef_construct") / 1e6, 3).alias("build_cost"), F.round(penalty, 3).alias("filter_penalty_ms"), F.monotonically_increasing_id().alias("_i"),
    )
    every = Window.partitionBy(F.lit(0))  # a handful of profiles
    rows = rows.withColumn("_fit", (F.col("filter_penalty_ms") == 0) & (F.col("recall") >= F.max("recall").over(every) - 0.005))
    cost = F.col("p95_ms") + 0.005 * F.col("memory_mb") + 0.02 * F.col("build_cost")
    place = F.row_number().over(every.orderBy(F.col("_fit").desc(), cost, "_i"))
    return rows.withColumn("recommendation", F.when(place == 1, "default").otherwise("")).drop("_i", "_fit")


def markdown_report(df: DataFrame, decimals: dict[str, int], header: bool = False) -> DataFrame:
    """One line of a Markdown table for each row: numbers named in `decimals` with so many digits. With `header`, `line_no` puts the head and its rule first."""
    cells: list[Column] = [F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double")) if c in decimals else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    lines = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    if not header:
        return lines
    rule = " | ".join("---:" if c in decimals else "---" for c in df.columns)
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, f"| {rule} |")], "line_no long, line string")
    return head.unionByName(lines.select((F.row_number().over(Window.orderBy("line")) + 1).cast("long").alias("line_no"), "line"))  # a report is a few lines


def golden_summary(cases: DataFrame) -> DataFrame:
    """key, cases: how many cases there are by document type and by parser, and how many need a table."""
    rows = cases.groupingSets([["document_type"], ["parser"], []], "document_type", "parser").agg(F.count("*").alias("cases"), F.grouping_id().alias("g"), F.sum(F.col("expectation.requires_table").cast("bigint")).alias("t"))
    keyed = rows.select(F.when(F.col("g") == 3, "case_count").when(F.col("g") == 1, F.concat(F.lit("type:"), "document_type")).otherwise(F.concat(F.lit("parser:"), "parser")).alias("key"), "cases")
    return keyed.unionByName(rows.where("g = 3").select(F.lit("table_cases").alias("key"), F.coalesce("t", F.lit(0)).alias("cases")))


def long_metrics(df: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Metrics as rows: group, metric, value."""
    group = group or []
    names = [c for c in df.columns if c not in group]
    return df.select(*group, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(group, names, "metric", "value")
