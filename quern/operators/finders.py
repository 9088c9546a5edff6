"""Predicates and orders of entity finders. What counts as now is always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

AUDIO, VIDEO = ("mp3", "m4a", "aac"), ("mp4", "webm", "mkv")
ACTIVE_DOWNLOADS = ("queued", "downloading", "processing")


def by(rows: DataFrame, order: str | list[str] | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values, ordered on demand."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return rows.orderBy(order) if order else rows


def unsynced(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("sync_status") == "local")


def between(edges: DataFrame, a: str, b: str, both: bool = False) -> DataFrame:
    there = (F.col("source_uuid") == a) & (F.col("target_uuid") == b)
    back = (F.col("source_uuid") == b) & (F.col("target_uuid") == a)
    return edges.filter(there | back if both else there)


def turn_links() -> Column:
    """The invocations of a turn that are there."""
    return F.array_compact(F.array("stt_id", "llm_id", "tts_id"))


def turns_with(turns: DataFrame, invocation: int) -> DataFrame:
    return turns.filter(F.array_contains(turn_links(), F.lit(invocation).cast("long")))


def tasks(rows: DataFrame, kind: str, now: Column) -> DataFrame:
    """Tasks of a named filter; an unknown name gives all."""
    open_, due = ~F.col("completed"), F.col("due_date")
    conditions = {
        "incomplete": open_,
        "completed": F.col("completed"),
        "overdue": times.overdue(due, F.col("completed"), now),
        "today": open_ & times.same_day(due, now),
        "soon": open_ & times.due_between(due, now, 7 * 24),
        "high_priority": open_ & (F.col("priority") == "high"),
    }
    return rows.filter(conditions[kind]) if kind in conditions else rows


def timers_active(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(~F.col("fired") & (F.col("ends_at") > now)).orderBy("ends_at", "uuid")


def timers_expired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(~F.col("fired") & (F.col("ends_at") <= now)).orderBy("ends_at", "uuid")


def timers_fired(rows: DataFrame) -> DataFrame:
    return rows.filter("fired").orderBy(F.coalesce("fired_at", "ends_at").desc(), "uuid")


def stale(hours_since: str, limit: float) -> Column:
    """Never checked, or at least `limit` hours ago."""
    return F.col(hours_since).isNull() | (F.col(hours_since) >= limit)


def retryable() -> Column:
    return (F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries"))


def cleaned(downloads: DataFrame, now: Column, keep_days: int = 7, most: int = 100) -> DataFrame:
    """Downloads without old failures, if there are more than `most` failures at all."""
    failed = F.col("status") == "failed"
    n = downloads.filter(failed).agg(F.count("*")).scalar()  # a subquery of the one that uses it
    old = failed & (F.coalesce("finished_at", now) < times.later(now, -24 * keep_days))
    return downloads.filter(~(F.coalesce(old, F.lit(False)) & (n > most)))


def progressed(status: Column, event: Column) -> Column:
    """A download's next status; events that do not fit leave it."""
    return (
        F.when((event == "start") & status.isin("queued", "failed"), "downloading")
        .when((event == "process") & (status == "downloading"), "processing")
        .when((event == "complete") & status.isin("downloading", "processing"), "completed")
        .when((event == "fail") & status.isin(*ACTIVE_DOWNLOADS), "failed")
        .when((event == "retry") & (status == "failed"), "queued")
        .otherwise(status)
    )


def percent(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0)), F.lit(100))


def task_state(completed: Column, event: Column) -> Column:
    return F.when(event == "complete", F.lit(True)).when(event == "reopen", F.lit(False)).otherwise(completed)


def task_priority(priority: Column, asked: Column) -> Column:
    """The asked priority, if it is one."""
    return F.when(asked.isin("low", "medium", "high"), asked).otherwise(priority)


def unsynced_by_id(rows: DataFrame) -> DataFrame:
    """Rows that no remote has confirmed yet: they carry no id of a remote."""
    return rows.filter(F.col("sync_id").isNull())


def edge_of(edges: DataFrame, a: str, b: str | None, kind: str) -> DataFrame:
    """The first edge of a type from one entity to another (None: to any), by id."""
    ends = {"source_uuid": a} | ({} if b is None else {"target_uuid": b})
    return by(edges, **ends, edge_type=kind).orderBy(*edges.columns).limit(1)


def turns(rows: DataFrame, kind: str, component: str | None = None, most: int = 10) -> DataFrame:
    """Turns: successful, failed, failed_in (a component), recent (the `most` latest)."""
    if kind == "recent":
        return rows.orderBy(F.col("seq").desc(), F.col("uuid").desc()).limit(most)
    good = F.col("result") == "success"
    return rows.filter({"successful": good, "failed": ~good, "failed_in": ~good & (F.col("failure_component") == component)}[kind])


def subscription_state(active: Column, downloaded: Column, hours: Column, event: Column, count: Column) -> Column:
    """(active, downloaded, hours_since_check) after poll, download, activate or deactivate."""
    return F.struct(
        F.when(event == "activate", F.lit(True)).when(event == "deactivate", F.lit(False)).otherwise(active).alias("active"),
        F.when(event == "download", downloaded + count).otherwise(downloaded).alias("downloaded"),
        F.when(event == "poll", F.lit(0).cast("long")).otherwise(hours).alias("hours_since_check"),
    )


def channel_state(subscribed: Column, days: Column, hours: Column, event: Column) -> Column:
    """(subscribed, days_since_added, hours_since_check) after subscribe, unsubscribe or check.

    A channel that is subscribed already keeps its date.
    """
    new = (event == "subscribe") & ~subscribed
    return F.struct(
        F.when(event == "subscribe", F.lit(True)).when(event == "unsubscribe", F.lit(False)).otherwise(subscribed).alias("subscribed"),
        F.when(new, F.lit(0).cast("long")).otherwise(days).alias("days_since_added"),
        F.when(event == "check", F.lit(0).cast("long")).otherwise(hours).alias("hours_since_check"),
    )


def media_state(status: Column, blob: Column, size: Column, event: Column, new_blob: Column, new_size: Column) -> Column:
    """(status, blob_id, size_bytes, error) after start, complete or fail; other events change nothing."""
    done = event == "complete"
    return F.struct(
        F.when(event == "start", "downloading").when(done, "completed").when(event == "fail", "failed").otherwise(status).alias("status"),
        F.when(done, new_blob).otherwise(blob).alias("blob_id"),
        F.when(done, new_size).otherwise(size).alias("size_bytes"),
        F.when(event == "fail", "failed").alias("error"),
    )


def invoked(tool: Column, status: Column) -> Column:
    """(was_invoked, succeeded) of an entity that a tool may have made."""
    return F.struct(tool.isNotNull().alias("was_invoked"), F.coalesce(status == "success", F.lit(False)).alias("succeeded"))
