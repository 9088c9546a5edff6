"""Queries over events, invocations, turns and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finders, learning, stats
from ..sources.views import table, view
from .registry import query

_ORDER = {"signup": 1, "view": 2, "click": 3, "purchase": 4}


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def ev_by_type(spark, sf_dir):
    return finders.by(table(spark, sf_dir, "events"), event_type="error").select("event_id", "user_id")


@query("SELECT event_id, event_type FROM events WHERE user_id = 7 ORDER BY ts, event_id")
def ev_by_corr_ordered(spark, sf_dir):
    return finders.by(table(spark, sf_dir, "events"), ["ts", "event_id"], user_id=7).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-29 12:00:00' ORDER BY ts, event_id")
def ev_since(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("ts > TIMESTAMP_NTZ '2024-01-29 12:00:00'").orderBy("ts", "event_id").select("event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def ev_count_by_corr(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def ev_ring_last_1000(spark, sf_dir):
    return stats.last_events(table(spark, sf_dir, "events")).select("event_id", "user_id")


@query("""SELECT user_id FROM events WHERE event_type IN ('signup', 'view', 'purchase', 'error')
    GROUP BY user_id HAVING count(DISTINCT event_type) = 4""")
def ev_chain_complete(spark, sf_dir):
    return stats.complete_chains(table(spark, sf_dir, "events"), "user_id", "event_type", ["signup", "view", "purchase", "error"])


@query("""SELECT user_id FROM events WHERE event_type IN ('signup', 'view', 'purchase')
    GROUP BY user_id HAVING count(DISTINCT event_type) = 3""")
def ev_chain_complete_all(spark, sf_dir):
    """Chains of three kinds of events."""
    return stats.complete_chains(table(spark, sf_dir, "events"), "user_id", "event_type", ["signup", "view", "purchase"])


@query("""SELECT event_id, user_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    WHERE before IS DISTINCT FROM event_type""")
def ev_state_changes(spark, sf_dir):
    found = stats.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return found.select("event_id", "user_id", "event_type", "before")


@query("""WITH marked AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    runs AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked)
    SELECT user_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM runs GROUP BY user_id, run""")
def ev_sessions(spark, sf_dir):
    return stats.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 240)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def inv_parse_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT component_type, count(*) AS n, count(*) FILTER (success) AS n_success FROM invocations GROUP BY component_type")
def inv_component_stats(spark, sf_dir):
    return stats.component_counts(view(spark, sf_dir, "invocations"))


@query("""SELECT correlation_id, count(*) AS n, string_agg(component_type, '>' ORDER BY
        CASE component_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 999 END, created_at, uuid) AS components
    FROM invocations GROUP BY correlation_id""")
def inv_trace_groups(spark, sf_dir):
    return stats.traces(view(spark, sf_dir, "invocations"), _ORDER)


@query("""WITH firsts AS (SELECT correlation_id, min(created_at) AS f FROM invocations GROUP BY correlation_id),
    top AS (SELECT correlation_id FROM firsts ORDER BY f DESC LIMIT 3)
    SELECT uuid, correlation_id FROM invocations WHERE correlation_id IN (SELECT correlation_id FROM top)""")
def inv_top3_traces(spark, sf_dir):
    return stats.latest_traces(view(spark, sf_dir, "invocations"), 3).select("uuid", "correlation_id")


@query("""SELECT uuid, CASE component_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 ELSE 999 END AS rank FROM invocations""")
def inv_pipeline_order(spark, sf_dir):
    known = F.create_map(*(F.lit(x) for pair in _ORDER.items() for x in pair))
    return view(spark, sf_dir, "invocations").select("uuid", F.coalesce(known[F.col("component_type")], F.lit(999)).alias("rank"))


@query("SELECT uuid, component_type FROM invocations WHERE uuid IN (SELECT doc_id FROM labels WHERE quality = 0)")
def inv_in_set(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("uuid"))
    return view(spark, sf_dir, "invocations").join(wanted, "uuid", "left_semi").select("uuid", "component_type")


@query("SELECT component_type, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS rate, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) >= 0.5 AS chosen FROM invocations GROUP BY component_type")
def inv_success_rates(spark, sf_dir):
    return learning.success_rates(view(spark, sf_dir, "invocations"), 0.5)


@query("SELECT uuid, seq, role FROM turns WHERE conversation_id = 3 ORDER BY seq")
def turn_by_conv_ordered(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "turns"), "seq", conversation_id=3).select("uuid", "seq", "role")


@query("SELECT role, count(*) AS n, count(DISTINCT conversation_id) AS conversations FROM turns GROUP BY role")
def turn_role_counts(spark, sf_dir):
    return view(spark, sf_dir, "turns").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"))


@query("SELECT uuid, marked_at FROM turns WHERE marked_for_feedback ORDER BY marked_at DESC NULLS FIRST, uuid")
def turn_marked_desc(spark, sf_dir):
    marked = view(spark, sf_dir, "turns").filter("marked_for_feedback")
    return marked.orderBy(F.col("marked_at").desc_nulls_first(), "uuid").select("uuid", "marked_at")


@query("SELECT conversation_id, uuid, marked_at FROM turns WHERE marked_for_feedback ORDER BY conversation_id, marked_at DESC NULLS FIRST, uuid")
def turn_marked_by_conv(spark, sf_dir):
    """All marked turns, ordered within their conversation."""
    marked = view(spark, sf_dir, "turns").filter("marked_for_feedback")
    return marked.orderBy("conversation_id", F.col("marked_at").desc_nulls_first(), "uuid").select("conversation_id", "uuid", "marked_at")


@query("SELECT result, failure_component, count(*) AS n FROM turns GROUP BY result, failure_component")
def turn_results(spark, sf_dir):
    return view(spark, sf_dir, "turns").groupBy("result", "failure_component").agg(F.count("*").alias("n"))


@query("""SELECT t.uuid AS turn, i.id AS invocation FROM turns t, LATERAL (SELECT unnest([stt_id, llm_id, tts_id]) AS id) i WHERE i.id IS NOT NULL""")
def turn_fk_explode_join(spark, sf_dir):
    return view(spark, sf_dir, "turns").select(F.col("uuid").alias("turn"), F.explode(finders.turn_links()).alias("invocation"))


@query("""SELECT uuid, CAST((stt_id IS NOT NULL)::INT + (llm_id IS NOT NULL)::INT + (tts_id IS NOT NULL)::INT AS BIGINT) AS n FROM turns""")
def turn_invocation_count(spark, sf_dir):
    return view(spark, sf_dir, "turns").select("uuid", F.size(finders.turn_links()).cast("long").alias("n"))


@query("SELECT uuid FROM turns WHERE 2000003001 IN (stt_id, llm_id, tts_id)")
def turn_with_invocation(spark, sf_dir):
    return finders.turns_with(view(spark, sf_dir, "turns"), 2_000_003_001).select("uuid")


@query("SELECT invocation_id, turn_id IS NULL AS background, action = 'correct' AND corrected IS NOT NULL AS has_correction FROM feedback")
def fb_kinds(spark, sf_dir):
    has = F.coalesce((F.col("action") == "correct") & F.col("corrected").isNotNull(), F.lit(False))
    return view(spark, sf_dir, "feedback").select("invocation_id", F.col("turn_id").isNull().alias("background"), has.alias("has_correction"))


@query("""SELECT f.invocation_id, i.component_type AS kind, f.component_type FROM feedback f JOIN invocations i ON i.uuid = f.invocation_id WHERE f.turn_id IS NOT NULL""")
def fb_join_invocations(spark, sf_dir):
    given = view(spark, sf_dir, "feedback").filter("turn_id IS NOT NULL")
    made = view(spark, sf_dir, "invocations").select(F.col("uuid").alias("invocation_id"), F.col("component_type").alias("kind"))
    return given.join(made, "invocation_id").select("invocation_id", "kind", "component_type")


@query("""SELECT component_type, count(*) FILTER (selected <> corrected) AS wrong_selections, count(*) AS correct_selections, count(*) AS applied
    FROM feedback WHERE action = 'correct' AND corrected IS NOT NULL GROUP BY component_type""")
def learn_namespace(spark, sf_dir):
    return learning.namespace_counters(view(spark, sf_dir, "feedback"))


@query("""WITH words AS (SELECT component_type, list_distinct([selected, 'en', action]) AS s, list_distinct([coalesce(corrected, 'de'), 'en']) AS c FROM feedback)
    SELECT component_type, CAST(sum(len(list_intersect(s, c))) AS BIGINT) AS correct_tools,
        CAST(sum(len(s) - len(list_intersect(s, c))) AS BIGINT) AS wrong_tools FROM words GROUP BY component_type""")
def learn_tools(spark, sf_dir):
    rows = view(spark, sf_dir, "feedback")
    rows = rows.withColumns({"s": F.array_distinct(F.array("selected", F.lit("en"), "action")), "c": F.array_distinct(F.array(F.coalesce("corrected", F.lit("de")), F.lit("en")))})
    return learning.tool_counters(rows, "s", "c", "component_type")


@query("""SELECT component_type, CAST(sum((quality = 0)::INT + (toxic = 1)::INT + (turn_id IS NULL)::INT) AS BIGINT) AS missing_context FROM feedback GROUP BY component_type""")
def learn_context(spark, sf_dir):
    """What each feedback says was missing from the context, as lists of names."""
    lacks = {"facts": F.col("quality") == 0, "tone": F.col("toxic") == 1, "turn": F.col("turn_id").isNull()}
    rows = view(spark, sf_dir, "feedback").withColumn("missing", F.array_compact(F.array(*(F.when(c, n) for n, c in lacks.items()))))
    return learning.missing_context(rows, "missing", "component_type")


@query("""WITH v AS (SELECT *, CASE WHEN quality = 0 AND toxic = 1 THEN 'hallucinated' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS verdict FROM feedback)
    SELECT component_type, count(*) FILTER (verdict = 'good') AS good, count(*) FILTER (verdict = 'poor') AS poor, count(*) FILTER (verdict = 'hallucinated') AS hallucinated,
        arg_max(CASE WHEN verdict = 'hallucinated' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END, seq) AS temperature FROM v GROUP BY component_type""")
def learn_quality(spark, sf_dir):
    return learning.quality_counters(view(spark, sf_dir, "feedback"), "component_type")


@query("""WITH p AS (SELECT *, CASE seq % 4 WHEN 0 THEN 'too-long' WHEN 1 THEN 'too-short' WHEN 2 THEN 'too-technical' ELSE 'perfect' END AS preference FROM feedback)
    SELECT component_type, count(*) FILTER (preference = 'too-long') AS too_long, count(*) FILTER (preference = 'too-short') AS too_short,
        count(*) FILTER (preference = 'too-technical') AS too_technical, count(*) FILTER (preference = 'perfect') AS perfect, arg_max(preference, seq) AS last_preference FROM p GROUP BY component_type""")
def learn_render(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("too-long", "too-short", "too-technical", "perfect")))
    rows = view(spark, sf_dir, "feedback").withColumn("preference", F.element_at(names, (F.col("seq") % 4 + 1).cast("int")))
    return learning.preference_counters(rows, "preference", "seq", "component_type")


@query("""WITH wanted AS (SELECT DISTINCT s_nationkey AS component, u AS user_id FROM supplier, (SELECT unnest([0, 1, 2, 3, 4, 9]) AS u)),
    own AS (SELECT component, user_id, arg_max(data, version) AS own FROM adaptation WHERE scope = 'user' GROUP BY ALL),
    common AS (SELECT component, arg_max(data, version) AS common FROM adaptation WHERE scope = 'global' GROUP BY ALL)
    SELECT w.component, CAST(w.user_id AS BIGINT) AS user_id, coalesce(own, common, 0.0) AS data, CASE WHEN own IS NOT NULL THEN 'user' WHEN common IS NOT NULL THEN 'global' ELSE 'default' END AS source
    FROM wanted w LEFT JOIN own o ON o.component = w.component AND o.user_id = w.user_id LEFT JOIN common c ON c.component = w.component""")
def adapt_scoped_resolution(spark, sf_dir):
    states = view(spark, sf_dir, "adaptation")
    users = F.explode(F.array(*(F.lit(u).cast("long") for u in (0, 1, 2, 3, 4, 9)))).alias("user_id")
    return learning.scoped(states, states.select("component").distinct().select("component", users))
