"""Site events to daily metrics, funnels and deduplicated requests, batch and streaming alike.

The transformations take any DataFrame, bounded or not; the streaming entry points add the watermark and
leave the sink to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import top_per_group

# Metric columns and the event types that feed them.
METRICS = {
    "profile_views": "page_view",
    "phone_clicks": "phone_click",
    "direction_clicks": "direction_click",
    "website_clicks": "website_click",
    "quote_requests": "quote_request",
    "claims": "claim_click",
}
EVENT_SCHEMA = "event_id bigint, ts timestamp, session_id bigint, provider_id bigint, event_type string"
FUNNEL_STEPS = ["page_view", "phone_click", "quote_request"]


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def parse_events(raw: DataFrame, payload: str = "props") -> DataFrame:
    """Typed payload beside the event columns; a payload that is not JSON gives null."""
    return raw.withColumn("payload", F.try_parse_json(payload)).withColumn("k", F.try_variant_get("payload", "$.k", "int")).drop("payload")


def _counts() -> list[Column]:
    return [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in METRICS.items()]


def daily_metrics(events: DataFrame) -> DataFrame:
    """Provider by day, one column per metric. Counts are partial aggregates, so a provider with a third of
    all events costs one row per task."""
    return events.groupBy("provider_id", F.to_date("ts").alias("day")).agg(*_counts())


def daily_metrics_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The same over a stream, one-day windows, final once the watermark has passed the day."""
    counted = events.withWatermark("ts", lateness).groupBy("provider_id", F.window("ts", "1 day")).agg(*_counts())
    return counted.select("provider_id", F.to_date("window.start").alias("day"), *METRICS)


def funnel_steps(events: DataFrame, steps: list[str] | None = None) -> DataFrame:
    """Per session the time of each step and how far it got in order: a step counts at its first time at or after
    the step before it. One conditional minimum a step, so no session is ever collected."""
    wanted = steps or FUNNEL_STEPS
    time_of = lambda step: F.min(F.when(F.col("event_type") == step, F.col("ts")))
    reached = events.groupBy("session_id").agg(time_of(wanted[0]).alias("at_1"))
    for i, step in enumerate(wanted[1:], 2):
        before = reached.filter(F.col(f"at_{i - 1}").isNotNull()).select("session_id", F.col(f"at_{i - 1}").alias("_before"))
        later = events.filter(F.col("event_type") == step).select("session_id", "ts").join(before, "session_id").filter("ts >= _before")
        reached = reached.join(later.groupBy("session_id").agg(F.min("ts").alias(f"at_{i}")), "session_id", "left")
    depth = sum((F.when(F.col(f"at_{i}").isNotNull(), 1).otherwise(0) for i in range(1, len(wanted) + 1)), F.lit(0))
    return reached.withColumn("depth", depth.cast("int"))


def funnel_report(sessions: DataFrame, steps: int = len(FUNNEL_STEPS)) -> DataFrame:
    """Sessions reaching each step and the share of those that reached the one before."""
    counts = sessions.agg(*[F.count_if(F.col("depth") >= i).alias(f"n{i}") for i in range(1, steps + 1)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.col(f"n{i}").alias("sessions"),
                 (F.lit(1.0) if i == 1 else F.round(F.col(f"n{i}") / F.nullif(F.col(f"n{i - 1}"), F.lit(0)), 4)).alias("rate"))
        for i in range(1, steps + 1)
    ])
    return counts.select(F.inline(rows))


def session_activity(events: DataFrame, gap: str = "30 minutes", lateness: str | None = None) -> DataFrame:
    """Visits: events of one session no further apart than `gap`."""
    rows = events.withWatermark("ts", lateness) if lateness else events
    visit = F.session_window("ts", gap)
    return rows.groupBy("session_id", visit).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "quote_request").alias("requests")).select(
        "session_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events", "requests"
    )


def stream_dedup(requests: DataFrame, lateness: str = "1 day") -> DataFrame:
    """First request of each idempotency hash within the watermark; needs ts and idempotency_hash. State is kept for
    as long as a duplicate may come, not for ever."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["idempotency_hash"])


def backlog(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: rows whose key no settled result has."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def run_incremental(stream: DataFrame, process, checkpoint: str, available_now: bool = True):
    """Resume where the last run stopped: the checkpoint, in a shared folder, remembers what was handled.
    `process(batch, batch_id)` must be idempotent per batch id."""
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def click_after_search(events: DataFrame, first: str = "page_view", then: str = "phone_click") -> DataFrame:
    """Per session and provider: first view, first later click; an ordered pair of events without a self-join."""
    seen = events.groupBy("session_id", "provider_id").agg(
        F.min(F.when(F.col("event_type") == first, F.col("ts"))).alias("first_at"),
        F.max(F.when(F.col("event_type") == then, F.col("ts"))).alias("_last"),
    )
    return seen.filter("first_at IS NOT NULL").withColumn("followed", F.coalesce(F.col("_last") >= F.col("first_at"), F.lit(False))).drop("_last")


def latest_event(events: DataFrame) -> DataFrame:
    """Newest event per provider."""
    return top_per_group(events, ["provider_id"], [F.col("ts").desc(), F.col("event_id").desc()], 1)
