"""Event streams: run state, expiry, rolling feedback, daily usage, de-duplication, progress.

Every function takes a streaming or a batch DataFrame; on a batch the watermark has no effect and
the result is the final state.  Aggregations use built-in functions, so each micro-batch is combined
on the map side before it meets the state, and only the expiry timer needs a Python state function.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from entityops import constants as C
from entityops.functions.ordering import first_row
from entityops.operators import usage

EXPIRY_SCHEMA = "session_id string, created_at timestamp, expires_at timestamp"


def _event_time(df: DataFrame) -> DataFrame:
    """Watermarks need an instant; times without a zone are taken in the session's zone."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if df.isStreaming else df


def run_state(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Status and counts of the known runs.

    events: run_id, ordinal, ts, type; runs: run_id (a run must have been created; others are ignored).
    Start it in update or complete mode.
    """
    kinds = ["RUN_STARTED", "STEP_FINISHED", "TOOL_CALL_START", "RUN_FINISHED"]
    known = events.where(F.col("type").isin(*kinds)).join(runs.select("run_id").distinct(), "run_id")
    # the newest lifecycle event, as the largest (ordinal, done) pair
    lifecycle = F.when(F.col("type").isin("RUN_STARTED", "RUN_FINISHED"), F.struct("ordinal", (F.col("type") == "RUN_FINISHED").alias("done")))
    return known.groupBy("run_id").agg(
        F.max(lifecycle).alias("_last"),
        F.count_if(F.col("type") == "STEP_FINISHED").alias("stage_count"),
        F.count_if(F.col("type") == "TOOL_CALL_START").alias("tool_call_count"),
        F.max("ts").alias("updated_at"),
    ).select(
        "run_id", F.when(F.col("_last").isNull(), "pending").when(F.col("_last.done"), "done").otherwise("running").alias("status"),
        "stage_count", "tool_call_count", "updated_at",
    )


def session_expiry(sessions: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """When each session expires: a fixed time after its creation, not after its last event."""
    return sessions.groupBy("session_id").agg(F.min("ts").alias("created_at")).withColumn(
        "expires_at", F.col("created_at") + F.expr(f"interval {ttl}")
    )


def expired_sessions(sessions: DataFrame, ttl_seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """Stream only: emit a session once the watermark has passed its fixed expiry.

    sessions: session_id (string) and ts of creation events.  The state of a key is one number.
    """

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        if state.hasTimedOut:
            (created,) = state.get
            state.remove()
            start = pd.Timestamp(created, unit="ms")
            yield pd.DataFrame({"session_id": [key[0]], "created_at": [start], "expires_at": [start + pd.Timedelta(seconds=ttl_seconds)]})
            return
        created = state.get[0] if state.exists else None
        for batch in batches:
            earliest = int(batch["ts"].min().timestamp() * 1000)
            created = earliest if created is None else min(created, earliest)
        state.update((created,))
        due = created + ttl_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        return
        yield  # makes this a generator

    return (
        _event_time(sessions).withWatermark("ts", watermark)
        .groupBy("session_id")
        .applyInPandasWithState(step, EXPIRY_SCHEMA, "created long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def rolling_feedback(feedback: DataFrame, window: str = "1 day", watermark: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Ratings per window, country and connector, flagged when they would give a hint."""
    bad = F.col("rating") == "not_helpful"
    counts = _event_time(feedback).withWatermark("ts", watermark).groupBy(
        F.window("ts", window, slide) if slide else F.window("ts", window), "country", "connector"
    ).agg(F.count(F.lit(1)).alias("samples"), F.count_if(bad).alias("negative"))
    flagged = (F.col("samples") >= C.FEEDBACK_MIN_SAMPLES) & (F.col("negative") / F.col("samples") >= C.FEEDBACK_NEGATIVE_RATE)
    return counts.select(F.col("window.start").alias("window_start"), "country", "connector", "samples", "negative", flagged.alias("hint"))


def usage_by_day(generations: DataFrame, watermark: str = "1 day", include_tests: bool = False) -> DataFrame:
    """Generations, tokens and cost per day and feature."""
    rows = generations if include_tests else usage.exclude_test_traces(generations)
    priced = usage.estimate_cost(rows).withColumn("feature", usage.feature_of(F.col("name")))
    return (
        _event_time(priced).withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "feature")
        .agg(
            F.count(F.lit(1)).alias("generations"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.sum("cost_usd").cast("double").alias("cost_usd"),
        )
        .select(F.col("window.start").alias("day"), "feature", "generations", "tokens", "cost_usd")
    )


def dedup_uploads(uploads: DataFrame, content: Column, watermark: str = "1 hour", order: str | None = None) -> DataFrame:
    """Drop uploads whose content was already seen; state is kept for the watermark only.

    A batch keeps the first row by ``order``; a stream keeps the one that arrives first.
    """
    hashed = uploads.withColumn("content_hash", F.sha2(content, 256))
    if not uploads.isStreaming:
        return hashed.dropDuplicates(["content_hash"]) if order is None else first_row(hashed, ["content_hash"], [F.col(order)])
    return _event_time(hashed).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["content_hash"])


def stage_counts(events: DataFrame) -> DataFrame:
    """How often each stage finished per session."""
    return events.groupBy("session_id", "stage").agg(F.count(F.lit(1)).alias("finished"), F.min("ordinal").alias("first_ordinal"))
