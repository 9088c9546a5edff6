"""Event streams: write-through logs, counts, sessions, chains and a retrying queue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators import stats
from ..operators.tables import Written

Handler = Callable[[DataFrame, int], None]


def source(spark: SparkSession, folder: str, schema, files_per_batch: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_through(events: DataFrame, log: str, checkpoint: str, handlers: dict[str, Handler]) -> StreamingQuery:
    """Appends each batch to the log first, then hands each handler its type's events.

    A batch that fails is run again as a whole: its part of the log is replaced, and
    handlers see it at least once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{log}/batch={number}")
        written = rows.sparkSession.read.parquet(f"{log}/batch={number}")
        for kind, handler in handlers.items():
            handler(written.filter(F.col("event_type") == kind), number)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and time window; those later than `late` are left out."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def turns(events: DataFrame, silence: str = "500 milliseconds", late: str = "30 seconds") -> DataFrame:
    """Turns of a speaker: events with no longer silence between them."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = rows.groupBy("user_id", F.session_window("at", silence).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "first_id")


def chains(events: DataFrame, expected: list[str], timeout: str = "5 seconds") -> DataFrame:
    """correlation, complete: whether all expected types came before the timeout.

    A complete chain is reported at once, an incomplete one when the watermark passes
    its time. The state is one set of types for each open correlation.
    """
    wanted, wait = set(expected), int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            done = state.get[0]
            state.remove()
            if done != "*":
                yield pd.DataFrame({"correlation": [key[0]], "complete": [False]})
            return
        seen = set(state.get[0].split(",")) if state.exists else set()
        closed, last = "*" in seen, 0
        for frame in frames:
            seen |= set(frame["event_type"]) & wanted
            last = max(last, int(frame["at"].max().timestamp() * 1000))
        if closed:
            return
        if wanted <= seen:
            yield pd.DataFrame({"correlation": [key[0]], "complete": [True]})
            seen = {"*"}
        state.update((",".join(sorted(seen)),))
        state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 second")
    rows = rows.select(F.col("user_id").cast("long").alias("user_id"), "event_type", "at")
    return rows.groupBy("user_id").applyInPandasWithState(step, "correlation long, complete boolean", "seen string", "append", GroupStateTimeout.EventTimeTimeout)


def queue_counts(tasks: DataFrame) -> DataFrame:
    """One row: pending, completed, failed tasks, those that may be retried, and the last attempt."""
    status = F.col("status")
    counts = [F.count_if(status == s).alias(s) for s in ("pending", "completed", "failed")]
    return tasks.agg(*counts, F.count_if(retryable()).alias("retryable"), F.max("last_attempt_at").alias("last_attempt"))


def retryable(most_retries: int = 3):
    return (F.col("status") == "failed") & (F.col("retry_count") < most_retries)


def next_batch(tasks: DataFrame, size: int = 10, now=None) -> DataFrame:
    """The oldest pending tasks, `size` at most; with `now`, only those whose delay is over.

    Of tasks with one uuid the first counts. A task waits two seconds for each retry since
    its last attempt.
    """
    pending = tasks.filter("status = 'pending'")
    if now is not None:
        wait = F.make_dt_interval(secs=F.col("retry_count") * F.lit(2.0))
        pending = pending.filter(F.col("last_attempt_at").isNull() | (F.col("last_attempt_at") + wait <= now))
    first = pending.groupBy("entity_uuid").agg(F.min("id").alias("id")).orderBy("id").limit(size)
    return tasks.join(F.broadcast(first.select("id")), "id", "left_semi")  # `size` rows


def flushed(tasks: DataFrame, run: Callable[[DataFrame], DataFrame], most_retries: int = 3, one: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A queue's tasks after one pass of `run`, which returns the uuids that succeeded.

    Tasks without text are done; of pending tasks with one uuid the first runs, the
    others are dropped. A task that failed waits again until it has been retried
    `most_retries` times. one: where `run` raises, the tasks are given to it instead; it
    is to work row by row and to return those that succeeded.
    """
    first = tasks.filter("status = 'pending'").groupBy("entity_uuid").agg(F.min("id").alias("id"))
    others = tasks.filter("status <> 'pending'")
    pending = tasks.join(first.select("id"), "id", "left_semi")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    try:
        done = run(pending.filter(~empty)).select("entity_uuid")
        if one is not None:
            done = Written(done.sparkSession).table(done)  # a lazy result would fail later
    except Exception:
        if one is None:
            raise
        done = one(pending.filter(~empty)).select("entity_uuid")
    done = done.distinct().withColumn("ok", F.lit(True))
    rows = pending.join(done, "entity_uuid", "left")
    good = empty | F.coalesce("ok", F.lit(False))
    tries = F.when(good, F.col("retry_count")).otherwise(F.col("retry_count") + 1)
    status = F.when(good, "completed").when(tries >= most_retries, "failed").otherwise("pending")
    return others.unionByName(rows.withColumns({"status": status, "retry_count": tries.cast("int")}).select(tasks.columns))


def flush_stream(tasks: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Runs a stream of tasks batch by batch: what has come every two seconds."""
    return tasks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def locations(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stand-in for a stream of positions: at, lat, lon of a walk around a circle."""
    angle = F.radians(F.col("value") % 360)
    rate = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return rate.select(F.col("timestamp").alias("at"), (48.1 + F.sin(angle) / 100).alias("lat"), (11.5 + F.cos(angle) / 100).alias("lon"))


def audio_chunks(spark: SparkSession, folder: str, size: int = 3200) -> DataFrame:
    """New files of a folder as a stream of slices: path, position, slice."""
    from ..functions import files

    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    raw = spark.readStream.format("binaryFile").schema(schema).load(folder)
    return raw.select("path", F.posexplode(files.slices(F.col("content"), size)).alias("position", "slice"))


def ring(log: DataFrame, most: int = 1000) -> DataFrame:
    return stats.last_events(log, most)
