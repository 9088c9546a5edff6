"""Whole tables replayed through the streams, in slices between which each query is stopped and started anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import shared_folder
from ..sources.store import EntityStore
from ..sources.views import table, view
from ..streaming import pipelines, pull, replay, stateful
from .registry import query

_KINDS = ["signup", "view", "purchase", "error"]
#: Microseconds by which the row that ends a replay lies behind all others.
_FAR = 10**14


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def _ended(rows: DataFrame, at: str, **other) -> list[DataFrame]:
    """Two slices of rows by a time, with a row behind them at which all that still waits is over.

    other: the columns that this row has; all others are null.
    """
    first, second = replay.halves(rows, at)
    values = {at: F.floor(F.col("last") / 1000) * 1000 + _FAR} | {k: F.lit(v) for k, v in other.items()}
    end = rows.agg(F.max(at).alias("last")).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    return [first, second.unionByName(end)]


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("at", F.timestamp_micros("at_us"))


@query("""WITH g AS (SELECT *, coalesce(lead(at_us) OVER w - at_us, 1000000000000) / 1e6 AS gap FROM speech_events WINDOW w AS (PARTITION BY session ORDER BY at_us, event_id)),
    y AS (SELECT *, CASE WHEN kind = 'EndOfTurn' THEN 'mark' WHEN kind = 'Update' AND gap > 0.5 THEN 'silence' WHEN speech_final AND gap > 2 THEN 'final' WHEN gap > 30 THEN 'idle error' END AS why FROM g),
    n AS (SELECT *, coalesce(sum((why IS NOT NULL)::INT) OVER (PARTITION BY session ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM y)
    SELECT session, CAST(turn AS BIGINT) AS turn, count(*) AS n, arg_max(CASE WHEN transcript <> '' THEN transcript END, CASE WHEN transcript <> '' THEN (at_us, event_id) END) AS transcript, max(why) AS closed_by
    FROM n GROUP BY session, turn""")
def str_turns(spark, sf_dir):
    """Turns closed by end marks and by timers of 0.5, 2 and 30 seconds."""
    rows = view(spark, sf_dir, "speech_events").withColumn("at_us", F.col("at_us") + 10**12)  # no time may be 0
    with replay.stateful_queries(spark):
        found = replay.appended(_ended(rows, "at_us", session=-1, event_id=-1, kind="Update"), lambda s: stateful.assembled_turns(_timed(s)))
    return found.filter("session >= 0")


@query("""SELECT event_id, user_id, event_type AS value, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS DISTINCT FROM event_type""")
def str_changes(spark, sf_dir):
    with replay.stateful_queries(spark):
        found = replay.appended(_ended(_events(spark, sf_dir), "at_us", user_id=-1, event_id=-1), lambda s: stateful.changes(_timed(s), "user_id", "event_type"))
    return found.filter("user_id >= 0")


@query(f"""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 60 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN {tuple(_KINDS)}) = 4 AS complete FROM r GROUP BY user_id, run""")
def str_chains(spark, sf_dir):
    """Chains that become complete, or are given up after 60 hours without an event of theirs."""
    with replay.stateful_queries(spark):
        found = replay.appended(_ended(_events(spark, sf_dir), "at_us", user_id=-1, event_id=-1), lambda s: stateful.chains(_timed(s), "user_id", "event_type", _KINDS, "60 hours"))
    return found.filter("user_id >= 0")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def str_counts(spark, sf_dir):
    """The last of the running counts of each user."""
    with replay.stateful_queries(spark):
        found = replay.updated(replay.halves(_events(spark, sf_dir), "at_us"), lambda s: stateful.running_counts(_timed(s), "user_id"))
    return found.groupBy("user_id").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def str_ring(spark, sf_dir):
    """The latest thousand events, as the stream's state keeps them."""
    folder = shared_folder(spark)
    with replay.stateful_queries(spark):
        replay.replay(replay.halves(_events(spark, sf_dir), "at_us"), lambda s, c: stateful.ring_sink(stateful.latest(_timed(s), {"user_id": "long"}), folder, c))
    return stateful.ring(spark, folder).select("event_id", "user_id")


def _measured(text: str) -> list[float]:
    """A provider of vectors that fails for texts whose length is a multiple of seven."""
    if len(text) % 7 == 0:
        raise ValueError(f"length {len(text)}")
    return [float(len(text))]


@query("""SELECT concat('d', doc_id) AS entity_uuid, lang AS entity_type, CASE WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN bad THEN 3 ELSE 0 END AS retry_count,
    CASE WHEN NOT bad THEN CAST(length(text) AS DOUBLE) END AS size, CASE WHEN bad THEN concat('ValueError: length ', length(text)) END AS error
    FROM (SELECT *, length(text) % 7 = 0 AS bad FROM documents WHERE trim(text) <> '')""")
def str_queue(spark, sf_dir):
    """Every document as a task of the queue, each twice and once without text; those that fail are tried three times."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("entity_uuid"), F.col("lang").alias("entity_type"), "text")
    again = docs.select((F.col("id") + 10**12).alias("id"), "entity_uuid", "entity_type", F.lit("again").alias("text"))
    blank = docs.select((-F.col("id") - 1).alias("id"), "entity_uuid", "entity_type", F.lit(" ").alias("text"))
    tasks = docs.unionByName(again).unionByName(blank)
    uneven = F.crc32(F.col("entity_uuid").cast("binary")) % 2 == 0
    with replay.stateful_queries(spark):
        found = replay.appended([tasks.filter(uneven), tasks.filter(~uneven)], lambda s: stateful.queue(s, _measured, flush=True))
    return found.select("entity_uuid", "entity_type", "status", "retry_count", F.get("vector", F.lit(0)).alias("size"), "error")


_LATER = "2024-01-15 00:00:00"


@query(f"""SELECT 'all' AS subscriber, event_id FROM events UNION ALL SELECT 'errors', event_id FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'late', event_id FROM events WHERE ts >= TIMESTAMP '{_LATER}' UNION ALL SELECT 'log', event_id FROM events""")
def str_subscribers(spark, sf_dir):
    """What subscribers of the write-through log see: of all, of one type, and one that joins with the second slice."""
    events = table(spark, sf_dir, "events")
    later = F.col("ts") >= F.lit(_LATER).cast("timestamp_ntz")
    log, places = shared_folder(spark), {n: (shared_folder(spark), shared_folder(spark)) for n in ("all", "errors", "late")}

    def each(number: int) -> None:
        for name, (folder, checkpoint) in places.items():
            if name != "late" or number:
                stateful.subscribe(spark, log, events.schema, checkpoint, replay.kept(folder), "error" if name == "errors" else None, later if name == "late" else None).awaitTermination()

    replay.replay([events.filter(~later), events.filter(later)], lambda s, c: pipelines.write_through(s, log, c, {}), each)
    seen = {"log": log} | {n: folder for n, (folder, _) in places.items()}
    out = [spark.read.schema(events.schema).parquet(folder).select(F.lit(n).alias("subscriber"), "event_id") for n, folder in seen.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT coalesce(l.uuid, r.uuid) AS uuid, round(CASE WHEN r.uuid IS NULL OR l.updated_at > r.updated_at THEN l.payload ELSE r.payload END, 2) AS payload,
    CASE WHEN r.uuid IS NULL OR l.updated_at > r.updated_at THEN 'local' ELSE 'remote' END AS side FROM local_entities l FULL JOIN remote_entities r ON l.uuid = r.uuid""")
def str_pull(spark, sf_dir):
    """Remote entities merged into a store as they come, half of them a second time."""
    store = EntityStore(spark, shared_folder(spark))
    names = lambda name, side: view(spark, sf_dir, name).select("uuid", "payload", "updated_at", F.lit(side).alias("side"))
    store.save("entities", names("local_entities", "local"))
    first, second = replay.halves(names("remote_entities", "remote"), "updated_at")
    replay.replay([second, first, second], lambda s, c: pull.pull_stream(s, store, "entities", c))
    return store.read("entities").select("uuid", F.round("payload", 2).alias("payload"), "side")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_windowed_counts(spark, sf_dir):
    """Counts by hour, each given once, when its hour is over."""
    rows = _events(spark, sf_dir)
    found = replay.appended(_ended(rows, "at_us", event_type="end"), lambda s: pipelines.windowed_counts(s.withColumn("ts", F.timestamp_micros("at_us"))))
    return found.filter("event_type <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS cut FROM events),
    runs AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM runs GROUP BY user_id, run""")
def str_sessions(spark, sf_dir):
    """Sessions by silence, each given once, when its silence is over."""
    rows = _events(spark, sf_dir)
    found = replay.appended(_ended(rows, "at_us", user_id=-1, event_id=-1), lambda s: pipelines.turns(s.withColumn("ts", F.timestamp_micros("at_us")), "4 hours"))
    return found.filter("user_id >= 0").select("user_id", "n", "first_id")
