"""Repository statistics, traces and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and how many rows meet each condition."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))


def total(rows: DataFrame, column: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))


def component_counts(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("component_type").agg(F.count("*").alias("n"), F.count_if("success").alias("n_success"))


def traces(invocations: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """correlation_id, n, components: the trace of each correlation in pipeline order.

    Components without a rank come last; a trace's members are ordered by rank, time, id.
    Members of equal components next to each other are gathered as one run with its length:
    by counting where a component has its rank alone, else by their positions in the order.
    """
    alone = [c for c, r in ranks.items() if list(ranks.values()).count(r) == 1 and r != 999]
    known = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    rows = invocations.withColumn("rank", F.coalesce(known[F.col("component_type")], F.lit(999)))
    counted = F.coalesce(F.col("component_type").isin(alone), F.lit(False))
    n = F.count("*").alias("n")
    one = rows.filter(counted).groupBy("correlation_id", "rank", "component_type").agg(F.lit(0).alias("position"), n)
    order = Window.partitionBy("correlation_id").orderBy("rank", "created_at", "uuid")
    own = Window.partitionBy("correlation_id", "component_type").orderBy("rank", "created_at", "uuid")
    rest = rows.filter(~counted).withColumn("position", F.row_number().over(order)).withColumn("run", F.col("position") - F.row_number().over(own))
    rest = rest.groupBy("correlation_id", "rank", "component_type", "run").agg(F.min("position").alias("position"), n).drop("run")
    member = F.struct("rank", "position", F.col("n").cast("int").alias("n"), "component_type")
    grouped = one.unionByName(rest).groupBy("correlation_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))
    names = F.flatten(F.transform("members", lambda m: F.array_repeat(m["component_type"], m["n"])))
    return grouped.select("correlation_id", "n", F.array_join(names, ">").alias("components"))


def latest_traces(invocations: DataFrame, most: int) -> DataFrame:
    """Rows of the `most` correlations whose first member is the latest."""
    first = invocations.groupBy("correlation_id").agg(F.min(F.struct("created_at", "uuid")).alias("first"))
    top = first.orderBy(F.col("first").desc()).limit(most).select("correlation_id")
    return invocations.join(F.broadcast(top), "correlation_id", "left_semi")  # `most` rows


def last_events(events: DataFrame, most: int = 1000) -> DataFrame:
    """The ring buffer: the latest events, found without a global sort."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(most)


def complete_chains(events: DataFrame, key: str, kind: str, expected: list[str]) -> DataFrame:
    """Keys for which every expected kind of event has come."""
    seen = events.filter(F.col(kind).isin(expected)).groupBy(key).agg(F.collect_set(kind).alias("seen"))
    return seen.filter(F.size(F.array_except(F.array(*map(F.lit, expected)), "seen")) == 0).select(key)


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the one before of their key; the first counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col(value)))


def sessions(events: DataFrame, key: str, at: str, gap_minutes: int) -> DataFrame:
    """key, n, first_id, last_id of runs of events at most `gap_minutes` apart."""
    rows = events.withColumn("at", F.col(at).cast("timestamp"))
    window = F.session_window("at", f"{gap_minutes} minutes")
    return rows.groupBy(key, window).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).drop("session_window")


#: The rank of each component in the pipeline (fixed values); others come last.
PIPELINE = ("namespace_selector", "tool_selector", "context_injector", "llm_config_selector", "llm_orchestrator", "response_renderer", "tts")


def pipeline_rank(component: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in zip(PIPELINE, range(1, len(PIPELINE) + 1)) for x in pair))
    return F.coalesce(known[component], F.lit(999))


def trace(invocations: DataFrame, correlation) -> DataFrame:
    """The invocations of one correlation in pipeline order, without those of speech recognition."""
    rows = invocations.filter((F.col("correlation_id") == correlation) & (F.col("component_type") != "stt"))
    return rows.withColumn("rank", pipeline_rank(F.col("component_type"))).orderBy("rank", "created_at", "uuid")


def trace_rows(invocations: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Each invocation with its position in its correlation's trace: no trace becomes one row."""
    known = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    order = Window.partitionBy("correlation_id").orderBy(F.coalesce(known[F.col("component_type")], F.lit(999)), "created_at", "uuid")
    return invocations.withColumn("position", F.row_number().over(order))


def ancestors(events: DataFrame, levels: int = 3) -> DataFrame:
    """event_id, root, depth: the chain of parents of each event, `levels` steps at most.

    root is the last ancestor that is there; an event whose parent is missing is its own.
    """
    rows = events.select("event_id", F.col("event_id").alias("root"), F.col("parent_event_id").alias("next"), F.lit(0).alias("depth"))
    parents = events.select(F.col("event_id").alias("next"), F.col("parent_event_id").alias("above"))
    for _ in range(levels):
        found = rows.join(parents.withColumn("there", F.lit(True)), "next", "left")
        on = F.coalesce("there", F.lit(False))
        rows = found.select("event_id", F.when(on, F.col("next")).otherwise(F.col("root")).alias("root"), F.when(on, F.col("above")).alias("next"), (F.col("depth") + on.cast("int")).alias("depth"))
    return rows.select("event_id", "root", "depth")


#: Kinds of recognition events that end a turn at once (fixed values).
TURN_ENDS = ("UtteranceEnd", "EndOfTurn", "EagerEndOfTurn")


def assembled_turns(events: DataFrame) -> DataFrame:
    """session, turn, n, transcript, closed_by of the turns of recognition events.

    events: session, at, event_id, kind, transcript, speech_final. A turn ends with an end
    mark, after an Update that 0.5 s of silence follow, after speech_final and 2 s, or after
    30 s idle, which is an error. Its text is the last transcript that is not empty.
    """
    w = Window.partitionBy("session").orderBy("at", "event_id")
    gap = F.timestamp_diff("MICROSECOND", F.col("at"), F.lead("at").over(w)) / 1e6
    why = (
        F.when(F.col("kind").isin(*TURN_ENDS), "mark")
        .when((F.col("kind") == "Update") & (F.col("gap") > 0.5), "silence")
        .when(F.col("speech_final") & (F.col("gap") > 2), "final")
        .when(F.col("gap") > 30, "idle error")
    )
    rows = events.withColumn("gap", gap).withColumn("why", why)
    before = F.coalesce(F.sum(F.col("why").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = F.max_by(F.when(F.col("transcript") != "", F.col("transcript")), F.when(F.col("transcript") != "", F.struct("at", "event_id")))
    grouped = rows.withColumn("turn", before).groupBy("session", "turn")
    return grouped.agg(F.count("*").alias("n"), text.alias("transcript"), F.coalesce(F.max("why"), F.lit("open")).alias("closed_by"))


def speech_metrics(output: Column) -> Column:
    """Words, seconds and end-of-turn confidence that a recognition's JSON output states."""
    return F.from_json(output, "wordCount BIGINT, audioDuration DOUBLE, endOfTurnConfidence DOUBLE")
