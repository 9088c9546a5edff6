"""Stateful streams: folds in event order with timers, and a queue with retries.

They need Spark's RocksDB state store, see `state_store`. State and timers lie in the
query's checkpoint, so that a restarted query goes on where the last whole batch ended.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.embedder import embed
from ..operators import stats

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Sets the state store that these streams need, for queries that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


# Folds in event order ------------------------------------------------------------------


#: Rows that wait in one element of a list, at most.
PACK = 1_000


class InOrder(StatefulProcessor):
    """Folds the rows of each key by (at_us, event_id), each as soon as the watermark has passed it.

    Rows wait in a list until no earlier one can come any more, so that the result does not
    depend on the order of arrival; those behind the watermark have been dropped before.
    What waits is packed, many rows (of numbers, strings and booleans) to an element: each
    element is a value that the state store has to be sent and asked for.
    A fold has one state (a tuple of `memory`'s fields) and may set a time in microseconds
    at which it wants to be called if no row comes until then.
    """

    #: The key's name; fields of the rows behind at_us and event_id, of the state, and of the output behind the key.
    key: str
    fields: str
    memory: str
    output: str

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after a row, and what to give out."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When `expire` is to be called: the time is over with the first watermark at or behind it."""
        return None

    def expire(self, key: tuple, state: tuple) -> tuple[tuple | None, list[tuple]]:
        return None, []

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed string")
        self.state = handle.getValueState("state", self.memory)
        self.names = ["at_us", "event_id", *(f.split()[0] for f in self.fields.split(", "))]
        self.out = Row(self.key, *(f.split()[0] for f in self.output.split(", ")))

    def _wake(self, at_us: int) -> None:
        self.handle.registerTimer(-(-at_us // 1000))

    @staticmethod
    def _packed(rows: list[tuple]) -> list[tuple[str]]:
        return [(json.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(row[n] for n in self.names) for row in rows]
        if new:
            self.waiting.appendList(self._packed(new))
            self._wake(min(r[0] for r in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(r) for (packed,) in self.waiting.get() for r in json.loads(packed)]
        ready = sorted((r for r in waiting if r[0] <= past), key=lambda r: r[:2])
        before = self.state.get()
        state, out = before, []
        for row in ready:
            if state is not None and (due := self.due(state)) is not None and row[0] > due:
                state, more = self.expire(key, state)
                out += more
            state, more = self.step(key, state, row)
            out += more
        due = self.due(state) if state is not None else None
        if due is not None and due <= past:
            state, more = self.expire(key, state)
            out, due = out + more, None
        if len(ready) < len(waiting):
            left = [r for r in waiting if r[0] > past]
            if ready:
                self.waiting.put(self._packed(left))
            self._wake(min(r[0] for r in left))
        elif waiting:
            self.waiting.clear()
        if state is None:
            if before is not None:
                self.state.clear()
        else:
            if state != before:
                self.state.update(state)
            if due is not None:
                self._wake(due)
        for row in out:
            yield self.out(*key, *row)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, processor: InOrder, late: str) -> DataFrame:
    """The processor over events (key, at, event_id and its fields) that come up to `late` behind the latest."""
    processor.key = key
    rows = events.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    rows = rows.select(key, "at", "at_us", F.col("event_id").cast("long").alias("event_id"), *(F.col(f.split()[0]) for f in processor.fields.split(", ")))
    return rows.groupBy(key).transformWithState(processor, f"{key} {events.schema[key].dataType.simpleString()}, {processor.output}", "Append", "EventTime")


class TurnAssembly(InOrder):
    """Turns of recognition events, by the rules of `stats.assembled_turns`."""

    fields = "kind string, transcript string, speech_final boolean"
    memory = "turn long, n long, transcript string, last long, wait long, why string"
    output = "turn long, n long, transcript string, closed_by string"

    def step(self, key, state, row):
        at, _, kind, transcript, final = row
        turn, n, text, *_ = state or (0, 0, None, 0, 0, "")
        text = transcript if transcript else text
        if kind in stats.TURN_ENDS:
            return (turn + 1, 0, None, at, -1, ""), [(turn, n + 1, text, "mark")]
        wait, why = (500_000, "silence") if kind == "Update" else (2_000_000, "final") if final else (30_000_000, "idle error")
        return (turn, n + 1, text, at, wait, why), []

    def due(self, state):
        return state[3] + state[4] if state[1] else None

    def expire(self, key, state):
        turn, n, text, last, _, why = state
        return (turn + 1, 0, None, last, -1, ""), [(turn, n, text, why)]


def assembled_turns(events: DataFrame, late: str = "2 seconds") -> DataFrame:
    """session, turn, n, transcript, closed_by: the stream of turns that are over.

    events: session, at, event_id, kind, transcript, speech_final, as for
    `stats.assembled_turns`, which gives the same turns but for the last of each session,
    open there until the stream has waited for it. A turn is given when the watermark
    passes its end mark, or the 0.5, 2 or 30 seconds in which nothing came; a session's
    state is the number of its turns and the open one.
    """
    return in_order(events, "session", TurnAssembly(), late)


class Changes(InOrder):
    """Events whose value is not that of the one before; a key is forgotten after `expiry_us` without events."""

    fields = "value string"
    memory = "value string, last long"
    output = "event_id long, value string, before string"

    def __init__(self, expiry_us: int | None):
        self.expiry_us = expiry_us

    def step(self, key, state, row):
        at, event_id, value = row
        before = state[0] if state else None
        return (value, at), [] if state and before == value or value is None and state is None else [(event_id, value, before)]

    def due(self, state):
        return None if self.expiry_us is None else state[1] + self.expiry_us


def changes(events: DataFrame, key: str, value: str, late: str = "10 minutes", expiry: str | None = None) -> DataFrame:
    """key, event_id, value, before of events (at, event_id) that change their key's value: `stats.changes` as a stream.

    expiry: a key without events for so long is forgotten; its next event counts as its first.
    """
    wait = None if expiry is None else int(pd.Timedelta(expiry).total_seconds() * 1e6)
    rows = events.select(F.col(key), "at", "event_id", F.col(value).cast("string").alias("value"))
    return in_order(rows, key, Changes(wait), late)


class Chains(InOrder):
    """Whether all expected kinds of events came within `wait_us` of the last one seen."""

    fields = "kind string"
    memory = "seen array<string>, last long"
    output = "complete boolean"

    def __init__(self, expected: Sequence[str], wait_us: int):
        self.expected, self.wait_us = frozenset(expected), wait_us

    def step(self, key, state, row):
        at, _, kind = row
        seen = set(state[0]) if state else set()
        if self.expected <= seen:  # reported; kept until no more of it comes
            return (sorted(seen), at), []
        seen |= {kind} & self.expected
        return (sorted(seen), at), [(True,)] if self.expected <= seen else []

    def due(self, state):
        return state[1] + self.wait_us

    def expire(self, key, state):
        return None, [] if self.expected <= set(state[0]) else [(False,)]


def chains(events: DataFrame, key: str, kind: str, expected: Sequence[str], timeout: str = "5 seconds", late: str = "1 second") -> DataFrame:
    """key, complete: chains of events (at, event_id) as they become complete, or are given up.

    A chain is given up when nothing of its key comes within `timeout`; then it is forgotten,
    and what comes later begins a new one.
    """
    rows = events.select(F.col(key), "at", "event_id", F.col(kind).alias("kind"))
    return in_order(rows, key, Chains(expected, int(pd.Timedelta(timeout).total_seconds() * 1e6)), late)


# Latest rows and counts ----------------------------------------------------------------


class Latest(StatefulProcessor):
    """The `most` latest rows of a shard, given out whole whenever they change."""

    def __init__(self, most: int, names: list[str], schema: str):
        self.most, self.names, self.schema = most, names, schema

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for frame in rows:
            held += [tuple(None if pd.isna(v) else v for v in r) for r in frame[self.names].astype(object).itertuples(index=False)]
            held = sorted(set(held), key=lambda r: r[:2], reverse=True)[: self.most]
        if held:
            self.rows.put(held)
            yield pd.DataFrame([(key[0], *r) for r in held], columns=["shard", *self.names])

    def close(self) -> None:
        pass


def latest(events: DataFrame, keep: dict[str, str], most: int = 1000, shards: int = 8) -> DataFrame:
    """shard, at_us, event_id and the columns `keep` (name: type): each shard's latest rows, whenever they change.

    Rows are dealt by id, so that no task sees all of them; the latest of all are among
    the shards' latest, see `ring_sink` and `ring`.
    """
    fields = {"at_us": "long", "event_id": "long"} | keep
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    rows = events.select(F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard"), F.unix_micros("at").alias("at_us"), F.col("event_id").cast("long").alias("event_id"), *keep)
    return rows.groupBy("shard").transformWithStateInPandas(Latest(most, list(fields), schema), f"shard int, {schema}", "Update", "None")


def ring_sink(rows: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps what `latest` gives in `folder`: each batch replaces the shards that it has."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ring(spark: SparkSession, folder: str, most: int = 1000) -> DataFrame:
    """The latest rows of all shards."""
    return spark.read.parquet(folder).drop("shard").orderBy(F.desc("at_us"), F.desc("event_id")).limit(most)


class Counts(StatefulProcessor):
    """Running counts; a key without rows for `expiry_ms` of event time is forgotten and counts from nought again."""

    def __init__(self, key: str, expiry_ms: int | None):
        self.key, self.expiry_ms = key, expiry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "n long, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        n, last = self.state.get() if self.state.exists() else (0, 0)
        for at in sorted(t for frame in rows for t in frame["at_ms"].tolist()):
            n = 1 if self.expiry_ms is not None and at > last + self.expiry_ms else n + 1
            last = max(last, at)
        self.state.update((n, last))
        if self.expiry_ms is not None:
            self.handle.registerTimer(last + self.expiry_ms)
        yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists() and self.state.get()[1] + self.expiry_ms <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def running_counts(events: DataFrame, key: str, late: str = "10 minutes", expiry: str | None = None) -> DataFrame:
    """key, n: the count of each key that a batch has rows of, after them.

    Rows are counted on arrival, also out of order; without `expiry` the last n of each key
    is its count of all rows.
    """
    wait = None if expiry is None else int(pd.Timedelta(expiry).total_seconds() * 1000)
    rows = events.select(key, "at", F.unix_millis("at").alias("at_ms"))
    rows = rows.withWatermark("at", late) if wait is not None else rows
    schema = f"{key} {events.schema[key].dataType.simpleString()}, n long"
    return rows.groupBy(key).transformWithStateInPandas(Counts(key, wait), schema, "Update", "None" if wait is None else "EventTime")


# The queue -----------------------------------------------------------------------------


class Queue(StatefulProcessor):
    """Tasks of one lane: worked off in batches of `size`, at once when so many wait, else every `every_ms`.

    A batch that fails is worked off task by task. A task that fails waits `delay_ms` for
    each of its failures and is given up with the `most_retries`th. With `flush` all that
    has come is worked off at once, and again what failed, until nothing waits.
    """

    memory = "entity_uuid string, entity_type string, text string, retry_count int, due_ms long"

    def __init__(self, run: Callable, one: Callable, size: int, every_ms: int, delay_ms: int, most_retries: int, flush: bool = False):
        self.run, self.one, self.size, self.every_ms, self.delay_ms, self.most_retries, self.flush = run, one, size, every_ms, delay_ms, most_retries, flush

    def init(self, handle) -> None:
        self.handle = handle
        self.tasks = handle.getListState("tasks", self.memory)

    def handleInputRows(self, key, rows, timerValues):
        tasks = [tuple(t) for t in self.tasks.get()] if self.tasks.exists() else []
        new = [r for frame in rows for r in frame[["id", "entity_uuid", "entity_type", "text"]].astype(object).itertuples(index=False)]
        known = {t[0] for t in tasks}
        for _, uuid, kind, text in sorted(new, key=lambda r: r[0]):
            if uuid not in known and isinstance(text, str) and text.strip():
                tasks.append((uuid, None if pd.isna(kind) else kind, text, 0, 0))
                known.add(uuid)
        if self.flush:
            yield from self._worked(tasks, 0, 1)
        else:
            yield from self._worked(tasks, timerValues.getCurrentProcessingTimeInMs(), self.size)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.tasks.exists():
            yield from self._worked([tuple(t) for t in self.tasks.get()], timerValues.getCurrentProcessingTimeInMs(), 1)

    def _worked(self, tasks: list[tuple], now: int, least: int) -> Iterator[pd.DataFrame]:
        """Works off whole batches while `least` tasks or more are due, keeps the others, and sets the timer."""
        out = []
        while len(ready := list(itertools.islice((t for t in tasks if t[4] <= now), self.size))) >= least:
            gone = {t[0] for t in ready}
            tasks = [t for t in tasks if t[0] not in gone]
            for task, vector, error in self._tried(ready):
                uuid, kind, text, retries, _ = task
                if error is None:
                    out.append((uuid, kind, "completed", retries, list(map(float, vector)), None))
                elif retries + 1 >= self.most_retries:
                    out.append((uuid, kind, "failed", retries + 1, None, error))
                else:
                    tasks.append((uuid, kind, text, retries + 1, now + self.delay_ms * (retries + 1)))
        if tasks:
            self.tasks.put(tasks)
            self.handle.registerTimer(now + self.every_ms)
        else:
            self.tasks.clear()
        if out:
            yield pd.DataFrame(out, columns=["entity_uuid", "entity_type", "status", "retry_count", "vector", "error"])

    def _tried(self, ready: list[tuple]) -> list[tuple]:
        try:
            return [(t, v, None) for t, v in zip(ready, self.run([t[2] for t in ready]), strict=True)]
        except Exception:
            out = []
            for task in ready:
                try:
                    out.append((task, self.one(task[2]), None))
                except Exception as e:
                    out.append((task, None, f"{type(e).__name__}: {e}"))
            return out

    def close(self) -> None:
        pass


def _each(one: Callable) -> Callable:
    return lambda texts: [one(t) for t in texts]


def queue(
    tasks: DataFrame,
    one: Callable[[str], Sequence[float]] = embed,
    run: Callable[[list[str]], list] | None = None,
    lanes: int = 8,
    size: int = 10,
    every_ms: int = 2000,
    delay_ms: int = 2000,
    most_retries: int = 3,
    flush: bool = False,
) -> DataFrame:
    """entity_uuid, entity_type, status, retry_count, vector, error: tasks that are done or given up.

    tasks: id, entity_uuid, entity_type, text. Those without text are skipped, as are those
    whose uuid waits already; of several in one batch the least id counts. They are dealt
    into lanes by uuid, and a lane works off its own in the order in which they came.
    run: vectors of several texts; where it raises, `one` is called for each. The state
    survives a restart. Work of a batch that was cut short is done again, but its rows
    reach a sink that Spark commits batch by batch (files) once. flush: nothing waits,
    neither for other tasks nor for a delay, and no timers are used: for a query that ends
    when all has been read (availableNow), which one with timers never does.
    """
    rows = tasks.select(F.pmod(F.xxhash64("entity_uuid"), F.lit(lanes)).cast("int").alias("lane"), "id", "entity_uuid", "entity_type", "text")
    processor = Queue(run or _each(one), one, size, every_ms, 0 if flush else delay_ms, most_retries, flush)
    return rows.groupBy("lane").transformWithStateInPandas(processor, "entity_uuid string, entity_type string, status string, retry_count int, vector array<double>, error string", "Append", "None" if flush else "ProcessingTime")


# Subscribers ---------------------------------------------------------------------------


def subscribe(spark: SparkSession, log: str, schema, checkpoint: str, handler: Callable[[DataFrame, int], None], kind: str | None = None, since: Column | None = None, trigger: dict | None = None) -> StreamingQuery:
    """A query of its own over a write-through log (`pipelines.write_through`): `handler` gets its new rows, batch by batch.

    Each subscriber has its own checkpoint and so its own place in the log: one that fails
    holds up no other, and goes on from there when it is started again. A new one begins at
    the log's beginning or, with `since` (a condition on the rows), where that holds.
    """
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(log)
    rows = rows.filter(since) if since is not None else rows
    rows = rows.filter(F.col("event_type") == kind) if kind is not None else rows
    return rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
