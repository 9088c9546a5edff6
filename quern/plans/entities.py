"""Finder and statistics queries over media, downloads, channels, tasks, timers and the like."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access, files, places, texts, times
from ..operators import finders, stats
from ..sources.views import table, view
from .registry import query

NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def ent_point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus").limit(1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 9, 100000)")
def ent_in_set(spark, sf_dir):
    return finders.by(table(spark, sf_dir, "customer"), c_custkey=[1, 5, 9, 100_000]).select("c_custkey", "c_name")


@query("SELECT count(*) AS n FROM lineitem")
def ent_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS downloaded, count(*) FILTER (status = 'pending') AS pending,
    count(*) FILTER (status = 'downloading') AS downloading, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (lower(format) IN ('mp3', 'm4a', 'aac')) AS audio, count(*) FILTER (lower(format) IN ('mp4', 'webm', 'mkv')) AS video,
    CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes, round(coalesce(sum(size_bytes), 0) / 1048576, 6) AS size_mb FROM media_items""")
def media_stats(spark, sf_dir):
    status, kind = F.col("status"), F.lower("format")
    rows = view(spark, sf_dir, "media_items")
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(status == "completed").alias("downloaded"),
        *(F.count_if(status == s).alias(s) for s in ("pending", "downloading", "failed")),
        F.count_if(kind.isin(*finders.AUDIO)).alias("audio"), F.count_if(kind.isin(*finders.VIDEO)).alias("video"),
        size.alias("size_bytes"), F.round(size / 1048576, 6).alias("size_mb"),
    )


@query("SELECT uuid FROM media_items WHERE status = 'completed' AND days_since <= 7")
def media_recent(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "media_items"), status="completed").filter("days_since <= 7").select("uuid")


@query("SELECT uuid, title FROM media_items WHERE lower(format) = 'webm'")
def media_by_format_ci(spark, sf_dir):
    return view(spark, sf_dir, "media_items").filter(F.lower("format") == "webm").select("uuid", "title")


@query("SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS size_bytes FROM media_items WHERE status = 'completed' AND blob_id IS NOT NULL")
def media_total_size(spark, sf_dir):
    done = (F.col("status") == "completed") & F.col("blob_id").isNotNull()
    return view(spark, sf_dir, "media_items").agg(stats.total(None, "size_bytes", done).alias("size_bytes"))


@query("SELECT channel_id, count(*) AS n, count(blob_id) AS with_blob FROM media_items GROUP BY channel_id")
def media_by_channel(spark, sf_dir):
    return view(spark, sf_dir, "media_items").groupBy("channel_id").agg(F.count("*").alias("n"), F.count("blob_id").alias("with_blob"))


@query("""SELECT m.uuid, c.name AS channel_name FROM media_items m LEFT JOIN channels c ON m.channel_id = concat('src', CAST(c.uuid AS VARCHAR)) WHERE m.status = 'failed'""")
def media_with_channel(spark, sf_dir):
    failed = finders.by(view(spark, sf_dir, "media_items"), status="failed").select("uuid", "channel_id")
    names = view(spark, sf_dir, "channels").select(F.concat(F.lit("src"), F.col("uuid").cast("string")).alias("channel_id"), F.col("name").alias("channel_name"))
    return failed.join(names, "channel_id", "left").select("uuid", "channel_name")


_DOWNLOADS = ("completed", "failed", "queued", "downloading", "processing")


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'queued') AS queued,
    count(*) FILTER (status = 'downloading') AS downloading, count(*) FILTER (status = 'processing') AS processing,
    count(*) FILTER (status IN ('queued', 'downloading', 'processing')) AS active, count(*) FILTER (status = 'failed' AND retry_count < max_retries) AS retryable FROM downloads""")
def dl_stats(spark, sf_dir):
    status = F.col("status")
    named = {s: status == s for s in _DOWNLOADS}
    return stats.counts(view(spark, sf_dir, "downloads"), **named, active=status.isin(*finders.ACTIVE_DOWNLOADS), retryable=finders.retryable())


@query("SELECT uuid, retry_count FROM downloads WHERE status = 'failed' AND retry_count < max_retries")
def dl_retryable(spark, sf_dir):
    return view(spark, sf_dir, "downloads").filter(finders.retryable()).select("uuid", "retry_count")


@query(f"""SELECT uuid FROM downloads WHERE NOT (status = 'failed' AND coalesce(finished_at, TIMESTAMP '{NOW}') < TIMESTAMP '{NOW}' - INTERVAL 7 DAY
    AND (SELECT count(*) FROM downloads WHERE status = 'failed') > 100)""")
def dl_cleanup_old_failed(spark, sf_dir):
    return finders.cleaned(view(spark, sf_dir, "downloads"), times.moment(NOW)).select("uuid")


@query(f"SELECT uuid FROM downloads WHERE status = 'completed' AND finished_at > TIMESTAMP '{NOW}' - INTERVAL 2400 HOUR")
def dl_recently_completed(spark, sf_dir):
    recent = F.col("finished_at") > times.later(times.moment(NOW), -2400)
    return finders.by(view(spark, sf_dir, "downloads"), status="completed").filter(recent).select("uuid")


@query("""WITH e AS (SELECT uuid, status, CASE uuid % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'process' WHEN 2 THEN 'complete' WHEN 3 THEN 'fail' ELSE 'retry' END AS event, CAST(uuid % 150 - 20 AS BIGINT) AS progress FROM downloads)
    SELECT uuid, CASE WHEN event = 'start' AND status IN ('queued', 'failed') THEN 'downloading' WHEN event = 'process' AND status = 'downloading' THEN 'processing'
        WHEN event = 'complete' AND status IN ('downloading', 'processing') THEN 'completed' WHEN event = 'fail' AND status IN ('queued', 'downloading', 'processing') THEN 'failed'
        WHEN event = 'retry' AND status = 'failed' THEN 'queued' ELSE status END AS next, least(greatest(progress, 0), 100) AS progress FROM e""")
def dl_transitions(spark, sf_dir):
    names = F.array(*(F.lit(x) for x in ("start", "process", "complete", "fail", "retry")))
    event = F.element_at(names, (F.col("uuid") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "downloads").select("uuid", finders.progressed(F.col("status"), event).alias("next"), finders.percent(F.col("uuid") % 150 - 20).alias("progress"))


@query("""SELECT count(*) AS total, count(*) FILTER (subscribed) AS subscribed, count(*) FILTER (NOT subscribed) AS unsubscribed,
    count(*) FILTER (subscribed AND (hours_since_check IS NULL OR hours_since_check >= 1)) AS needs_check, count(*) FILTER (days_since_added <= 7) AS added_last_week FROM channels""")
def ch_stats(spark, sf_dir):
    on = F.col("subscribed")
    return stats.counts(view(spark, sf_dir, "channels"), subscribed=on, unsubscribed=~on, needs_check=on & finders.stale("hours_since_check", 1), added_last_week=F.col("days_since_added") <= 7)


@query("SELECT uuid, name FROM channels WHERE contains(lower(name), '00003')")
def ch_name_contains_ci(spark, sf_dir):
    return view(spark, sf_dir, "channels").filter(texts.contains_ignoring_case(F.col("name"), "00003")).select("uuid", "name")


@query("SELECT uuid, CASE WHEN subscribed THEN NULL ELSE hours_since_check END AS hours_since_check FROM channels")
def ch_mark_all_for_check(spark, sf_dir):
    return view(spark, sf_dir, "channels").select("uuid", F.when(~F.col("subscribed"), F.col("hours_since_check")).alias("hours_since_check"))


@query("SELECT uuid, name FROM subscriptions WHERE active AND (hours_since_check IS NULL OR hours_since_check > 24) ORDER BY name")
def sub_needing_poll(spark, sf_dir):
    return view(spark, sf_dir, "subscriptions").filter(F.col("active") & finders.stale("hours_since_check", 25)).orderBy("name").select("uuid", "name")


@query("SELECT uuid, name FROM subscriptions WHERE source_type = 'BUILDING' AND NOT active ORDER BY name")
def sub_inactive_by_type(spark, sf_dir):
    return finders.by(view(spark, sf_dir, "subscriptions"), "name", source_type="BUILDING", active=False).select("uuid", "name")


def _task_query(name: str, kind: str, condition: str) -> None:
    def run(spark, sf_dir):
        return finders.tasks(view(spark, sf_dir, "tasks"), kind, times.moment("2001-07-20 00:00:00")).select("uuid", "owner_id")

    run.__name__ = name
    query(f"SELECT uuid, owner_id FROM tasks WHERE {condition}")(run)


_AT = "TIMESTAMP '2001-07-20 00:00:00'"
for _name, _kind, _condition in (
    ("task_incomplete", "incomplete", "NOT completed"),
    ("task_completed", "completed", "completed"),
    ("task_overdue", "overdue", f"NOT completed AND due_date < {_AT}"),
    ("task_today", "today", f"NOT completed AND CAST(due_date AS DATE) = CAST({_AT} AS DATE)"),
    ("task_soon7d", "soon", f"NOT completed AND due_date > {_AT} AND due_date < {_AT} + INTERVAL 7 DAY"),
    ("task_high_priority", "high_priority", "NOT completed AND priority = 'high'"),
    ("task_all", "something else", "true"),
):
    _task_query(_name, _kind, _condition)


@query(f"""SELECT uuid, coalesce(due_date < {_AT} + INTERVAL 24 HOUR, false) AS before_window, coalesce(due_date >= {_AT} AND due_date < {_AT} + INTERVAL 25 HOUR, false) AS within_hours FROM tasks""")
def task_due_soon_variants(spark, sf_dir):
    now, due = times.moment("2001-07-20 00:00:00"), F.col("due_date")
    return view(spark, sf_dir, "tasks").select("uuid", times.due_before(due, now, 24).alias("before_window"), times.due_within_hours(due, now, 24).alias("within_hours"))


@query(f"SELECT uuid, label FROM timers WHERE NOT fired AND ends_at > TIMESTAMP '{EVENTS_NOW}' ORDER BY ends_at, uuid")
def timer_active(spark, sf_dir):
    return finders.timers_active(view(spark, sf_dir, "timers"), times.moment(EVENTS_NOW)).select("uuid", "label")


@query(f"SELECT uuid, label FROM timers WHERE NOT fired AND ends_at <= TIMESTAMP '{EVENTS_NOW}' ORDER BY ends_at, uuid")
def timer_expired(spark, sf_dir):
    return finders.timers_expired(view(spark, sf_dir, "timers"), times.moment(EVENTS_NOW)).select("uuid", "label")


@query("SELECT uuid, cancelled FROM timers WHERE fired ORDER BY coalesce(fired_at, ends_at) DESC, uuid")
def timer_fired_order(spark, sf_dir):
    return finders.timers_fired(view(spark, sf_dir, "timers")).select("uuid", "cancelled")


@query(f"SELECT uuid, CAST(greatest(0, floor(epoch(ends_at - TIMESTAMP '{EVENTS_NOW}'))) AS BIGINT) AS left FROM timers")
def timer_remaining(spark, sf_dir):
    return view(spark, sf_dir, "timers").select("uuid", times.remaining_seconds(F.col("ends_at"), times.moment(EVENTS_NOW)).alias("left"))


@query("SELECT DISTINCT namespace FROM namespaces ORDER BY namespace")
def ns_names(spark, sf_dir):
    return view(spark, sf_dir, "namespaces").select("namespace").distinct().orderBy("namespace")


@query("""SELECT namespace, tool, CASE WHEN len(string_split(tool, '.')) = 2 THEN string_split(tool, '.')[2] END AS name FROM namespaces""")
def tool_fullname_parse(spark, sf_dir):
    return view(spark, sf_dir, "namespaces").select("namespace", "tool", texts.dotted_name(F.col("tool"))["tool"].alias("name"))


@query("SELECT uuid, owner_id = 7 AS own FROM owned WHERE owner_id = 7 OR visibility = 'public' OR shared_with = 7")
def acc_accessible_by(spark, sf_dir):
    may = access.accessible_by(F.col("owner_id"), F.col("visibility"), F.array("shared_with"), 7)
    return view(spark, sf_dir, "owned").filter(may).select("uuid", access.owned_by(F.col("owner_id"), 7).alias("own"))


@query("""SELECT uuid, round(2 * 6378.137 * asin(sqrt(pow(sin(radians(lat - 48.1) / 2), 2) + cos(radians(48.1)) * cos(radians(lat)) * pow(sin(radians(lon - 11.5) / 2), 2))), 3) AS km
    FROM places WHERE 2 * 6378.137 * asin(sqrt(pow(sin(radians(lat - 48.1) / 2), 2) + cos(radians(48.1)) * cos(radians(lat)) * pow(sin(radians(lon - 11.5) / 2), 2))) <= 2500""")
def geo_within_radius(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    near = view(spark, sf_dir, "places").filter(places.within_km(lat, lon, (48.1, 11.5), 2500))
    return near.select("uuid", F.round(places.haversine_km(F.lit(48.1), F.lit(11.5), lat, lon), 3).alias("km"))


_EXT = "CASE WHEN contains(url, '.') THEN lower(regexp_extract(url, '\\.([^.]*)$', 1)) ELSE '' END"


@query(f"""WITH e AS (SELECT page_id, {_EXT} AS ext FROM pages) SELECT page_id, ext,
    CASE ext {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MEDIA_TYPES.items())} ELSE '{files.DEFAULT_TYPE}' END AS kind FROM e""")
def file_mime_ext(spark, sf_dir):
    ext = files.extension(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), files.media_type(ext).alias("kind"))


@query("""SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, CAST(ceil(octet_length(encode(html)) / 1024.0) AS BIGINT) AS slices FROM pages""")
def blob_slices(spark, sf_dir):
    content = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(content).cast("long").alias("size_bytes"), F.size(files.slices(content, 1024)).cast("long").alias("slices"))


@query("""SELECT r_name AS name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations, coalesce((SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey), 0) AS customers FROM region""")
def cat_correlated_counts(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    nations = nation.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    by_nation = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    customers = nation.join(by_nation, "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("customers"))
    rows = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey").join(nations, "n_regionkey", "left").join(customers, "n_regionkey", "left")
    return rows.select(F.col("r_name").alias("name"), F.coalesce("nations", F.lit(0)).alias("nations"), F.coalesce("customers", F.lit(0)).alias("customers"))
