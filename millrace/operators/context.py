"""Context assembly from hits, and the prompt registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def build_context(hits: DataFrame, chunks: DataFrame, max_characters: int, strict: bool = False) -> DataFrame:
    """query_id, text, chunk_ids, character_count, deduplicated, truncated for each query with hits (query_id, chunk_id, score, rank).

    Chunks are taken whole, by rank, until one does not fit; none after it is taken. A chunk's later hits are
    dropped and, if they come before that point, counted. Unless `strict`, a part is charged one separator
    however many precede it, so the text may exceed the budget by the others.
    """
    if max_characters < 1:
        raise ValueError("max_characters must be greater than 0")
    texts = chunks.select("chunk_id", "content").groupBy("chunk_id").agg(F.min("content").alias("content"))
    texts = texts.select("chunk_id", F.concat(F.lit("["), "chunk_id", F.lit("]\n"), F.coalesce("content", F.lit(""))).alias("_part"))
    # the order of hits as one value: by rank, then the higher score (NaN highest, null last), then chunk
    score = F.when(F.isnan("score"), float("-inf")).when(F.col("score").isNull(), float("inf")).otherwise(-F.col("score"))
    keyed = hits.select("query_id", "chunk_id", F.struct("rank", score.alias("score"), "chunk_id").alias("_at"))
    # lengths go to the hits; the texts themselves only to what is taken
    keyed = keyed.join(texts.select("chunk_id", F.length("_part").alias("_length")), "chunk_id")
    first = keyed.groupBy("query_id", "chunk_id").agg(F.min("_at").alias("_at"), F.first("_length").alias("_length"))
    # no more parts than this can fit, so a query with very many hits is cut down where they are
    order = Window.partitionBy("query_id").orderBy("_at")
    first = first.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= max_characters // 3 + 2)
    total = F.sum("_length").over(order.rowsBetween(Window.unboundedPreceding, 0))
    gaps = (F.col("_no") - 1) * 2 if strict else F.when(F.col("_no") > 1, 2).otherwise(0)
    first = first.withColumn("_over", total + gaps > max_characters)
    stops = first.groupBy("query_id").agg(F.min(F.when(F.col("_over"), F.col("_at"))).alias("_stop"))
    before = F.col("_stop").isNull() | (F.col("_at") < F.col("_stop"))
    taken = first.join(stops, "query_id").where(before).join(texts, "chunk_id")
    parts = taken.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_no", "chunk_id", "_part"))).alias("_p"))
    # later hits of a chunk, before that point
    copies = keyed.select("query_id", "_at").join(stops, "query_id").where(before).groupBy("query_id").agg(F.count("*").alias("_hits"))
    out = stops.join(parts, "query_id", "left").join(copies, "query_id", "left").withColumn("_p", F.coalesce("_p", F.expr("cast(array() as array<struct<_no: int, chunk_id: string, _part: string>>)")))
    text = F.array_join(F.col("_p._part"), "\n\n")
    return out.select(
        "query_id", text.alias("text"), F.col("_p.chunk_id").alias("chunk_ids"), F.length(text).alias("character_count"),
        (F.coalesce("_hits", F.lit(0)) - F.size("_p")).cast("bigint").alias("deduplicated"), F.col("_stop").isNotNull().alias("truncated"),
    )


class PromptRegistry:
    """Versions of named prompts; immutable, every change gives a new registry. Tables are tiny and local."""

    FIELDS = ("name", "version", "system", "user")

    def __init__(self, prompts: tuple[dict[str, str], ...] = (), active: dict[str, str] | None = None):
        self.prompts, self.active = prompts, dict(active or {})

    def register(self, name: str, version: str, system: str, user: str, activate: bool = False) -> PromptRegistry:
        prompt = dict(zip(self.FIELDS, (name, version, system, user)))
        for field, value in prompt.items():
            if not value.strip():
                raise ValueError(f"prompt {field} must not be blank")
        if any(p["name"] == name and p["version"] == version for p in self.prompts):
            raise ValueError(f"prompt {name} {version} is already registered")
        return PromptRegistry((*self.prompts, prompt), {**self.active, **({name: version} if activate else {})})

    def activate(self, name: str, version: str) -> PromptRegistry:
        self.get(name, version)
        return PromptRegistry(self.prompts, {**self.active, name: version})

    def get(self, name: str, version: str | None = None) -> dict[str, str]:
        wanted = version or self.active.get(name)
        for p in self.prompts:
            if p["name"] == name and p["version"] == wanted:
                return p
        raise LookupError(f"prompt {name} {version or '(active)'} is not registered")

    def versions(self, name: str) -> tuple[str, ...]:
        return tuple(p["version"] for p in self.prompts if p["name"] == name)


def active_prompts(prompts: DataFrame, active: DataFrame) -> DataFrame:
    """The active version of each prompt, as an equi-join of two tables (name, version, ...)."""
    return prompts.join(active.select("name", "version"), ["name", "version"])
