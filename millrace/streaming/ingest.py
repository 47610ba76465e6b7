"""Incremental ingestion: cache, progress events, task state, file streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.text import point_id
from millrace.session import durable

EVENT_COLUMNS = ["task_id", "source_uri", "stage", "progress", "status", "message", "elapsed_ms", "created_at"]
EVENT = "task_id string, source_uri string, stage string, progress double, status string, message string, elapsed_ms double, created_at timestamp"


def task_status(stage: Column) -> Column:
    """The state of a task from the stage of its last event."""
    return F.when(stage == "queued", "queued").when(stage == "started", "running").when(stage == "failed", "failed").otherwise("succeeded")


def terminal_stage(status: Column) -> Column:
    """Partial results count as success."""
    return F.when(status == "failed", "failed").otherwise("succeeded")


def task_state(events: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """task_id, stage, status, progress, events, updated_at: the last event of each task by time, then progress.

    With `tasks` given, events of other tasks are ignored and tasks without events are queued.
    """
    last = events.groupBy("task_id").agg(F.max(F.struct("created_at", "progress", "stage")).alias("l"), F.count("*").alias("events"))
    state = last.select("task_id", F.col("l.stage").alias("stage"), F.col("l.progress").alias("progress"), "events", F.col("l.created_at").alias("updated_at"))
    if tasks is not None:
        state = tasks.select("task_id").distinct().join(state, "task_id", "left").fillna({"stage": "queued", "progress": 0.0, "events": 0})
    return state.select("task_id", "stage", task_status(F.col("stage")).alias("status"), "progress", "events", "updated_at")


_STATE = "created_at timestamp, progress double, stage string, events long"
_UPDATE = "task_id string, stage string, progress double, events long, updated_at timestamp"


def stream_task_state(events: DataFrame, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """`task_state` kept up to date from a stream of events: the rows that a micro-batch changes are appended below `path`, see `read_task_state`.

    A task whose last event lies further back than `late` is forgotten by the stream (its rows stay in the table), so
    what is held in memory are the tasks of that time; later events of it count anew.
    """

    def update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, progress, stage, count = state.get if state.exists else (None, None, None, 0)
        best = None if at is None else (pd.Timestamp(at), progress, stage)
        for frame in frames:
            count += len(frame)
            for row in frame[["created_at", "progress", "stage"]].itertuples(index=False):
                mine = (row.created_at, row.progress, row.stage)
                best = mine if best is None or mine > best else best
        state.update((best[0].to_pydatetime(), best[1], best[2], count))
        state.setTimeoutTimestamp(max(int(best[0].timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"task_id": [key[0]], "stage": [best[2]], "progress": [best[1]], "events": [count], "updated_at": [best[0]]})

    def append(batch: DataFrame, number: int) -> None:
        # a batch that runs again after a failure replaces what it wrote
        batch.select("*", task_status(F.col("stage")).alias("status")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    known = events.where("task_id is not null and created_at is not null").select("task_id", "created_at", "progress", "stage").withWatermark("created_at", late)
    changed = known.groupBy("task_id").applyInPandasWithState(update, _UPDATE, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return changed.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_task_state(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each task that `stream_task_state` wrote."""
    columns = ("stage", "status", "progress", "events", "updated_at")
    last = spark.read.parquet(path).groupBy("task_id").agg(F.max_by(F.struct(*columns), "batch").alias("l"))
    return last.select("task_id", *[F.col(f"l.{c}").alias(c) for c in columns])


def stage_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and stage; over a stream, rows that come later than `late` are dropped."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", window), "stage").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "stage", "events")


def split_by_cache(found: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (source_uri, content_hash) already in the cache, and those to parse. Files without hash are never cached."""
    keys = cache.select("source_uri", "content_hash").distinct()
    return found.join(keys, ["source_uri", "content_hash"], "left_semi"), found.join(keys, ["source_uri", "content_hash"], "left_anti")


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with new results (source_uri, content_hash, status, ...); failed ones and those without hash are left out, a newer result of a file replaces the older."""
    fresh = results.where("status <> 'failed' and content_hash is not null")
    return cache.join(fresh.select("source_uri").distinct(), "source_uri", "left_anti").unionByName(fresh, allowMissingColumns=True)


def cache_invalidate(cache: DataFrame, uris: DataFrame) -> DataFrame:
    return cache.join(uris.select("source_uri").distinct(), "source_uri", "left_anti")


def parse_many(found: DataFrame, parse: Callable[[str], str], slots: int | None = None) -> DataFrame:
    """Events (queued, started, succeeded or failed) of parsing (queue_index, source_uri), `slots` files at a time.

    A task of the cluster is a slot, its partition the queue: files are dealt to the slots in turn and wait until theirs is
    free. `parse` gets a uri and gives a status; its exception is a failure. Events of a file keep the order of their times.
    """
    began = datetime.now(UTC).replace(tzinfo=None)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for index, uri in zip(batch["queue_index"], batch["source_uri"]):
                started = datetime.now(UTC).replace(tzinfo=None)
                clock = time.perf_counter()
                try:
                    status, message = parse(uri), None
                except Exception as e:  # noqa: BLE001
                    status, message = "failed", str(e)
                took = (time.perf_counter() - clock) * 1000
                done = datetime.now(UTC).replace(tzinfo=None)
                task = f"task-{index}"
                rows.append((task, uri, "queued", 0.0, None, None, None, began))
                rows.append((task, uri, "started", 0.1, None, None, None, started))
                rows.append((task, uri, "failed" if status == "failed" else "succeeded", 1.0, status, message, took, done))
            yield pd.DataFrame(rows, columns=EVENT_COLUMNS)

    queue = found.select("queue_index", "source_uri")
    if slots:
        queue = queue.repartitionById(slots, F.pmod("queue_index", F.lit(slots)).cast("int"))
    return queue.mapInPandas(run, EVENT)


@dataclass(frozen=True)
class Ingestion:
    """events as of `parse_many` and of the cache, results (queue_index, source_uri, content_hash, status, message, elapsed_ms, cached), and the cache with the new ones."""

    events: DataFrame
    results: DataFrame
    cache: DataFrame


def ingest_many(found: DataFrame, cache: DataFrame, parse: Callable[[str], str], slots: int | None = None) -> Ingestion:
    """Parses (queue_index, source_uri, content_hash) but for what `cache` (source_uri, content_hash, status, elapsed_ms) holds.

    A file of the cache has the events queued, started and cache_hit and its result from there. Files without hash are
    parsed and never cached. `results` has a row for each row of `found`; queue_index gives their order. Files are parsed once,
    into a written table, whichever of the three is read.
    """
    hits, todo = split_by_cache(found, cache)
    parsed = durable(parse_many(todo, parse, slots))
    held = cache.groupBy("source_uri", "content_hash").agg(F.max(F.struct("status", "elapsed_ms")).alias("_r"))
    hits = hits.join(held, ["source_uri", "content_hash"]).select("queue_index", "source_uri", "content_hash", "_r.*")
    now = F.current_timestamp()
    nothing = F.lit(None).cast("string")
    steps = F.array(
        F.struct(F.lit("queued").alias("stage"), F.lit(0.0).alias("progress"), nothing.alias("status"), F.lit(None).cast("double").alias("elapsed_ms")),
        F.struct(F.lit("started").alias("stage"), F.lit(0.1).alias("progress"), nothing.alias("status"), F.lit(None).cast("double").alias("elapsed_ms")),
        F.struct(F.lit("cache_hit").alias("stage"), F.lit(1.0).alias("progress"), F.col("status"), F.col("elapsed_ms").cast("double").alias("elapsed_ms")),
    )
    told = hits.select(F.concat(F.lit("task-"), F.col("queue_index").cast("string")).alias("task_id"), "source_uri", F.explode(steps).alias("s"))
    told = told.select("task_id", "source_uri", "s.stage", "s.progress", "s.status", nothing.alias("message"), "s.elapsed_ms", now.alias("created_at"))
    last = parsed.where("progress = 1").select("task_id", "status", "message", "elapsed_ms")
    fresh = todo.withColumn("task_id", F.concat(F.lit("task-"), F.col("queue_index").cast("string"))).join(last, "task_id")
    fresh = fresh.select("queue_index", "source_uri", "content_hash", "status", "message", "elapsed_ms", F.lit(False).alias("cached"))
    known = hits.select("queue_index", "source_uri", "content_hash", "status", nothing.alias("message"), F.col("elapsed_ms").cast("double").alias("elapsed_ms"), F.lit(True).alias("cached"))
    kept = cache_put(cache, fresh.select("source_uri", "content_hash", "status", "elapsed_ms").dropDuplicates(["source_uri"]))
    return Ingestion(parsed.unionByName(told), known.unionByName(fresh), kept)


def synthetic_parser(delay_ms: float = 50.0, payload_kb: int = 64) -> Callable[[str], str]:
    """A parser that only waits and makes text, for measuring scheduling."""

    def parse(uri: str) -> str:
        time.sleep(delay_ms / 1000)
        return "succeeded" if len("x" * payload_kb * 1024) else "failed"

    return parse


def stream_files(spark: SparkSession, path: str, per_trigger: int = 100, glob: str = "*") -> DataFrame:
    """New files below a path as a stream; at most `per_trigger` at a time wait in memory."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select(F.col("path").alias("source_uri"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), "modificationTime")


def submit(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks (task_id, source_uri) for (queue_index, source_uri), and the events that queue them. The same file at the same place has the same id."""
    tasks = found.select(point_id(F.concat(F.col("queue_index").cast("string"), F.lit("#"), F.coalesce("source_uri", F.lit("")))).alias("task_id"), "source_uri")
    nothing = F.lit(None)
    queued = tasks.select(
        "task_id", "source_uri", F.lit("queued").alias("stage"), F.lit(0.0).alias("progress"), nothing.cast("string").alias("status"), nothing.cast("string").alias("message"), nothing.cast("double").alias("elapsed_ms"), F.current_timestamp().alias("created_at")
    )
    return tasks, queued


def task_reports(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """task_id, status, progress, stages (in order of time, then progress, joined by commas) of each task; one without events is queued."""
    state = task_state(events, tasks).select("task_id", "status", "progress")
    told = events.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "progress", "stage"))).alias("_e"))  # a task has a handful of events
    stages = F.array_join(F.transform(F.coalesce("_e", F.expr("cast(array() as array<struct<created_at: timestamp, progress: double, stage: string>>)")), lambda e: e["stage"]), ",")
    return state.join(told, "task_id", "left").select("task_id", "status", "progress", stages.alias("stages"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on whatever file system."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest_stream(found: DataFrame, parse: Callable[[DataFrame], DataFrame], cache_path: str, checkpoint: str) -> StreamingQuery:
    """Parses files of a stream that the cache at `cache_path` does not hold, and appends their results to it.

    `parse` turns (source_uri, content, content_hash) into results with a status. A batch that runs again after a
    failure finds its results in the cache. Equal files of a batch are parsed once. The cache is kept in 256 parts by the hash of the uri.
    """
    # begins with a letter that makes no number of it, as which folder names would be read
    bucket = F.concat(F.lit("p"), F.substring(F.sha2("source_uri", 256), 1, 2))

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = batch.dropDuplicates(["source_uri", "content_hash"])
        if path_exists(spark, cache_path):
            # only the keys, and of at most 256 parts those that the batch falls into
            parts = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]
            todo = split_by_cache(todo, spark.read.parquet(cache_path).where(F.col("bucket").isin(parts)))[1]
        fresh = parse(todo).where("status <> 'failed' and content_hash is not null")
        fresh.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").parquet(cache_path)

    return found.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_task(events: DataFrame) -> DataFrame:
    """Events numbered within their task by time."""
    return events.withColumn("event_no", F.row_number().over(Window.partitionBy("task_id").orderBy("created_at", "progress", "stage")))
