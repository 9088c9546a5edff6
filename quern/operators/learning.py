"""Learning from feedback: counters by component, state by scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corrections(feedback: DataFrame) -> DataFrame:
    """Feedback that corrects something and says what."""
    return feedback.filter((F.col("action") == "correct") & F.col("corrected").isNotNull())


def namespace_counters(feedback: DataFrame) -> DataFrame:
    """component_type, wrong_selections, correct_selections, applied."""
    rows = corrections(feedback)
    wrong = F.count_if(F.col("selected") != F.col("corrected"))
    return rows.groupBy("component_type").agg(wrong.alias("wrong_selections"), F.count("*").alias("correct_selections"), F.count("*").alias("applied"))


def tool_counters(rows: DataFrame, selected: str, correct: str, *by: str) -> DataFrame:
    """How many selected tools were right, and how many were not (arrays of names)."""
    right = F.size(F.array_intersect(selected, correct))
    wrong = F.size(F.array_except(selected, correct))
    return rows.groupBy(*by).agg(F.sum(right).cast("long").alias("correct_tools"), F.sum(wrong).cast("long").alias("wrong_tools"))


def missing_context(rows: DataFrame, missing: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.size(missing)).cast("long").alias("missing_context"))


def quality_counters(feedback: DataFrame, *by: str) -> DataFrame:
    """good, poor and hallucinated answers; the last verdict sets the temperature."""
    verdict = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), "hallucinated").when(F.col("quality") == 0, "poor").otherwise("good")
    rows = feedback.withColumn("verdict", verdict)
    warm = F.max_by(F.when(F.col("verdict") == "hallucinated", 0.3).otherwise(0.5), "seq")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("good", "poor", "hallucinated")]
    return rows.groupBy(*by).agg(*counts, F.round(warm, 1).alias("temperature"))


def preference_counters(rows: DataFrame, preference: str, order: str, *by: str) -> DataFrame:
    """How often each preference was stated, and the last one."""
    kinds = ("too-long", "too-short", "too-technical", "perfect")
    counts = [F.count_if(F.col(preference) == k).alias(k.replace("-", "_")) for k in kinds]
    return rows.groupBy(*by).agg(*counts, F.max_by(preference, order).alias("last_preference"))


def scoped(states: DataFrame, wanted: DataFrame, default: float = 0.0) -> DataFrame:
    """For each wanted (component, user_id) the user's state, else the global, else a default.

    Of several states in a scope the highest version counts.
    """
    best = lambda by: F.max_by("data", "version").alias(by)
    own = states.filter("scope = 'user'").groupBy("component", "user_id").agg(best("own"))
    common = states.filter("scope = 'global'").groupBy("component").agg(best("common"))
    rows = wanted.join(own, ["component", "user_id"], "left").join(common, "component", "left")
    source = F.when(F.col("own").isNotNull(), "user").when(F.col("common").isNotNull(), "global").otherwise("default")
    return rows.select("component", "user_id", F.coalesce("own", "common", F.lit(default)).alias("data"), source.alias("source"))


def updated_state(states: DataFrame, counters: DataFrame) -> DataFrame:
    """States with the version raised once for each applied feedback."""
    rows = states.join(counters.select("component_type", "applied"), "component_type", "left")
    n = F.coalesce("applied", F.lit(0))
    return rows.withColumns({"version": F.col("version") + n, "feedback_count_applied": F.col("feedback_count_applied") + n}).drop("applied")


def success_rates(invocations: DataFrame, threshold: float) -> DataFrame:
    """component_type, rate, chosen: whether the share of successes reaches the threshold."""
    rate = F.avg(F.col("success").cast("double"))
    return invocations.groupBy("component_type").agg(F.round(rate, 6).alias("rate"), (rate >= threshold).alias("chosen"))


def loop_counters(rows: DataFrame, verdict: str, *by: str) -> DataFrame:
    """successful_loops, poor_loops, tool_errors by the verdicts good, poor and toolIssue."""
    names = {"successful_loops": "good", "poor_loops": "poor", "tool_errors": "toolIssue"}
    return rows.groupBy(*by).agg(*(F.count_if(F.col(verdict) == v).alias(n) for n, v in names.items()))


def feedback_context(feedback: DataFrame, invocations: DataFrame, states: DataFrame) -> DataFrame:
    """Feedback with its invocation and the current state of the component, null where there is none."""
    current = states.groupBy("component_type").agg(F.max_by("data", "version").alias("state"))
    made = invocations.select(F.col("uuid").alias("invocation_id"), "component_type", "success", "confidence")
    return feedback.join(made, "invocation_id", "left").join(current, "component_type", "left")


def selection(names: Column) -> Column:
    """(selected, confidence) of an array of choices: the first, sure only where it is the only one."""
    sure = F.when(F.size(names) == 1, 1.0).otherwise(0.5)
    chosen = F.struct(F.try_element_at(names, F.lit(1)).alias("selected"), sure.alias("confidence"))
    return F.when(F.size(names) > 0, chosen).otherwise(F.raise_error(F.lit("there is nothing to choose from")).cast("struct<selected:string,confidence:double>"))


def watch_confidence(rows: DataFrame, *by: str) -> DataFrame:
    """watched, skipped, confidence: the share of full watches among full watches and skips."""
    full, skip = F.count_if(F.col("gesture") == "full"), F.count_if(F.col("gesture") == "skip")
    both = full + skip
    return rows.groupBy(*by).agg(full.alias("watched"), skip.alias("skipped"), F.when(both > 0, F.round(full / both, 6)).alias("confidence"))


def namespace_scores(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """namespace, score, status of each score: PASS where it reaches the threshold."""
    return rows.select("namespace", "score", F.when(F.col("score") >= threshold, "PASS").otherwise("FAIL").alias("status"))
