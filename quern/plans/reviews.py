"""Queries over turns, their invocations and feedback, recognition events and what is learned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finders, learning, stats
from ..sources.views import table, view
from .registry import query


@query("""SELECT t.uuid AS turn, i.uuid AS invocation, i.component_type, i.success FROM turns t JOIN turn_invocations i ON i.uuid IN (t.stt_id, t.llm_id, t.tts_id)""")
def turn_join_invocations(spark, sf_dir):
    """Turns with the invocations that their three references name."""
    links = view(spark, sf_dir, "turns").select(F.col("uuid").alias("turn"), F.explode(finders.turn_links()).alias("invocation"))
    made = view(spark, sf_dir, "turn_invocations").select(F.col("uuid").alias("invocation"), "component_type", "success")
    return links.join(made, "invocation").select("turn", "invocation", "component_type", "success")


@query("""SELECT t.uuid, t.conversation_id, f.invocation_id, f.action FROM turns t LEFT JOIN feedback f ON f.turn_id = t.uuid WHERE t.marked_for_feedback""")
def turn_with_feedback(spark, sf_dir):
    """The review list: marked turns with their feedback, where there is any."""
    marked = view(spark, sf_dir, "turns").filter("marked_for_feedback").select("uuid", "conversation_id")
    given = view(spark, sf_dir, "feedback").filter("turn_id IS NOT NULL").select(F.col("turn_id").alias("uuid"), "invocation_id", "action")
    return marked.join(given, "uuid", "left").select("uuid", "conversation_id", "invocation_id", "action")


@query("SELECT uuid, marked_at FROM turns WHERE conversation_id = 3 AND marked_for_feedback ORDER BY marked_at DESC NULLS FIRST, uuid")
def turn_marked_of_conv(spark, sf_dir):
    marked = finders.by(view(spark, sf_dir, "turns"), conversation_id=3, marked_for_feedback=True)
    return marked.orderBy(F.col("marked_at").desc_nulls_first(), "uuid").select("uuid", "marked_at")


@query("SELECT uuid FROM turns WHERE result = 'success'")
def turn_successful(spark, sf_dir):
    return finders.turns(view(spark, sf_dir, "turns"), "successful").select("uuid")


@query("SELECT uuid, failure_component FROM turns WHERE result <> 'success'")
def turn_failed(spark, sf_dir):
    return finders.turns(view(spark, sf_dir, "turns"), "failed").select("uuid", "failure_component")


@query("SELECT uuid FROM turns WHERE result <> 'success' AND failure_component = 'llm'")
def turn_failed_in(spark, sf_dir):
    return finders.turns(view(spark, sf_dir, "turns"), "failed_in", "llm").select("uuid")


@query("SELECT uuid, seq FROM turns ORDER BY seq DESC, uuid DESC LIMIT 10")
def turn_recent10(spark, sf_dir):
    return finders.turns(view(spark, sf_dir, "turns"), "recent").select("uuid", "seq")


@query("SELECT uuid, conversation_id, role FROM turns WHERE uuid = 3001")
def turn_by_uuid(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "turns"), uuid=3001).select("uuid", "conversation_id", "role")


@query("SELECT uuid, component_type FROM turn_invocations WHERE turn_id = 3001 ORDER BY seq, uuid")
def inv_by_turn_ordered(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "turn_invocations"), ["seq", "uuid"], turn_id=3001).select("uuid", "component_type")


@query("SELECT invocation_id, action FROM feedback WHERE turn_id = 4")
def fb_by_turn(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "feedback"), turn_id=4).select("invocation_id", "action")


@query("SELECT invocation_id, action FROM feedback WHERE turn_id = 2 AND component_type = 'src2'")
def fb_by_turn_component(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "feedback"), turn_id=2, component_type="src2").select("invocation_id", "action")


@query("SELECT invocation_id, action FROM feedback WHERE component_type = 'src3'")
def fb_by_component(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "feedback"), component_type="src3").select("invocation_id", "action")


@query("SELECT version, scope, data FROM adaptation WHERE component = 3 ORDER BY version")
def adapt_history(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "adaptation"), "version", component=3).select("version", "scope", "data")


_RANK = "CASE component_type " + " ".join(f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(stats.PIPELINE)) + " ELSE 999 END"


@query(f"SELECT uuid, component_type, {_RANK} AS rank FROM component_invocations WHERE correlation_id = 7 AND component_type <> 'stt' ORDER BY rank, created_at, uuid")
def inv_trace_seven(spark, sf_dir):
    """One correlation's invocations by the seven ranks of the pipeline."""
    return stats.trace(view(spark, sf_dir, "component_invocations"), 7).select("uuid", "component_type", "rank")


@query("""SELECT uuid, correlation_id, row_number() OVER (PARTITION BY correlation_id ORDER BY
        CASE component_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 999 END, created_at, uuid) AS position FROM invocations""")
def inv_trace_rows(spark, sf_dir):
    """All traces, one row an invocation, so that no trace has to fit into one row."""
    ranks = {"signup": 1, "view": 2, "click": 3, "purchase": 4}
    found = stats.trace_rows(view(spark, sf_dir, "invocations"), ranks)
    return found.select("uuid", "correlation_id", F.col("position").cast("long").alias("position"))


@query("""WITH RECURSIVE up AS (SELECT event_id, event_id AS root, parent_event_id AS next, 0 AS depth FROM chained_events
        UNION ALL SELECT u.event_id, p.event_id, p.parent_event_id, u.depth + 1 FROM up u JOIN chained_events p ON p.event_id = u.next WHERE u.depth < 3)
    SELECT event_id, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY event_id""")
def ev_parent_chain(spark, sf_dir):
    """The ancestor of each event, three levels up at most."""
    return stats.ancestors(view(spark, sf_dir, "chained_events"), 3)


_STT_TURNS = """WITH g AS (SELECT *, (lead(at_us) OVER w - at_us) / 1e6 AS gap FROM speech_events WINDOW w AS (PARTITION BY session ORDER BY at_us, event_id)),
    y AS (SELECT *, CASE WHEN kind = 'EndOfTurn' THEN 'mark' WHEN kind = 'Update' AND gap > 0.5 THEN 'silence' WHEN speech_final AND gap > 2 THEN 'final' WHEN gap > 30 THEN 'idle error' END AS why FROM g),
    n AS (SELECT *, coalesce(sum((why IS NOT NULL)::INT) OVER (PARTITION BY session ORDER BY at_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM y)
    SELECT session, CAST(turn AS BIGINT) AS turn, count(*) AS n, arg_max(CASE WHEN transcript <> '' THEN transcript END, CASE WHEN transcript <> '' THEN (at_us, event_id) END) AS transcript,
        coalesce(max(why), 'open') AS closed_by FROM n GROUP BY session, turn"""


@query(_STT_TURNS)
def stt_turns(spark, sf_dir):
    rows = view(spark, sf_dir, "speech_events").withColumn("at", F.timestamp_micros("at_us"))
    return stats.assembled_turns(rows).withColumn("turn", F.col("turn").cast("long"))


@query("""SELECT event_id, event_id % 9 AS words, value AS seconds, CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE END AS confidence FROM events""")
def stt_metrics(spark, sf_dir):
    output = F.to_json(F.struct((F.col("event_id") % 9).alias("wordCount"), F.col("value").alias("audioDuration"), F.when(F.col("event_id") % 2 == 0, F.lit(0.5)).alias("endOfTurnConfidence"), F.lit("text").alias("transcript")))
    rows = table(spark, sf_dir, "events").select("event_id", stats.speech_metrics(output).alias("m"))
    return rows.select("event_id", F.col("m.wordCount").alias("words"), F.col("m.audioDuration").alias("seconds"), F.col("m.endOfTurnConfidence").alias("confidence"))


@query("""SELECT component_type, count(*) FILTER (quality = 1) AS successful_loops, count(*) FILTER (quality = 0 AND toxic = 0) AS poor_loops, count(*) FILTER (quality = 0 AND toxic = 1) AS tool_errors
    FROM feedback GROUP BY component_type""")
def learn_loops(spark, sf_dir):
    verdict = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 0, "poor").otherwise("toolIssue")
    return learning.loop_counters(view(spark, sf_dir, "feedback").withColumn("verdict", verdict), "verdict", "component_type")


@query("""SELECT f.invocation_id, f.action, i.component_type, i.success, round(s.data, 2) AS state FROM feedback f LEFT JOIN invocations i ON i.uuid = f.invocation_id
    LEFT JOIN (SELECT CASE component % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END AS kind, arg_max(data, version) AS data FROM adaptation GROUP BY kind) s ON s.kind = i.component_type""")
def learn_feedback_context(spark, sf_dir):
    kind = F.when(F.col("component") % 3 == 0, "click").when(F.col("component") % 3 == 1, "view").otherwise("error")
    states = view(spark, sf_dir, "adaptation").withColumn("component_type", kind)
    given = view(spark, sf_dir, "feedback").select("invocation_id", "action")
    found = learning.feedback_context(given, view(spark, sf_dir, "invocations"), states)
    return found.select("invocation_id", "action", "component_type", "success", F.round("state", 2).alias("state"))


@query("""SELECT user_id, min(event_type) AS selected, CASE WHEN count(DISTINCT event_type) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM events GROUP BY user_id""")
def learn_selection(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    return kinds.select("user_id", learning.selection(F.col("names")).alias("s")).select("user_id", "s.*")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS watched, count(*) FILTER (event_type = 'error') AS skipped,
    CASE WHEN count(*) FILTER (event_type IN ('view', 'error')) > 0 THEN round(count(*) FILTER (event_type = 'view') / count(*) FILTER (event_type IN ('view', 'error')), 6) END AS confidence
    FROM events GROUP BY user_id""")
def learn_watch_confidence(spark, sf_dir):
    gesture = F.when(F.col("event_type") == "view", "full").when(F.col("event_type") == "error", "skip")
    return learning.watch_confidence(table(spark, sf_dir, "events").withColumn("gesture", gesture), "user_id")


@query("SELECT event_type AS namespace, round(avg(value), 6) AS score, CASE WHEN round(avg(value), 6) >= 5 THEN 'PASS' ELSE 'FAIL' END AS status FROM events GROUP BY event_type")
def learn_namespace_scores(spark, sf_dir):
    scores = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("namespace")).agg(F.round(F.avg("value"), 6).alias("score"))
    return learning.namespace_scores(scores, 5.0)


@query("""SELECT event_id, event_type <> 'signup' AS was_invoked, event_type = 'purchase' AS succeeded FROM events""")
def inv_projections(spark, sf_dir):
    tool = F.when(F.col("event_type") != "signup", F.col("event_type"))
    status = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "timeout")
    return table(spark, sf_dir, "events").select("event_id", finders.invoked(tool, status).alias("i")).select("event_id", "i.*")
