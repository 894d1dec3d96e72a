"""Event metrics. The batch forms run here; tests drive the same transformations as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import metrics
from .registry import query

_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{kind}') AS {name}" for name, kind in metrics.METRICS.items())


@query("daily_metrics", f"SELECT provider_id, CAST(ts AS DATE) AS day, {_COUNTS} FROM provider_events GROUP BY provider_id, CAST(ts AS DATE)")
def _(d):
    return metrics.daily_metrics(d.provider_events)


@query("daily_metrics_window", f"SELECT provider_id, CAST(ts AS DATE) AS day, {_COUNTS} FROM provider_events GROUP BY provider_id, CAST(ts AS DATE)")
def _(d):
    return metrics.daily_metrics_stream(d.provider_events)


@query("event_stream", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def _(d):
    return metrics.parse_events(d.events).select("event_id", "event_type", "k")


_FUNNEL = """SELECT s.session_id, a.at_1, b.at_2, c.at_3, CAST(CASE WHEN a.at_1 IS NULL THEN 0 WHEN b.at_2 IS NULL THEN 1 WHEN c.at_3 IS NULL THEN 2 ELSE 3 END AS INT) AS depth
  FROM (SELECT DISTINCT session_id FROM provider_events) s
  LEFT JOIN (SELECT session_id, min(ts) AS at_1 FROM provider_events WHERE event_type = 'page_view' GROUP BY session_id) a ON a.session_id = s.session_id
  LEFT JOIN LATERAL (SELECT min(e.ts) AS at_2 FROM provider_events e WHERE e.session_id = s.session_id AND e.event_type = 'phone_click' AND e.ts >= a.at_1) b ON true
  LEFT JOIN LATERAL (SELECT min(e.ts) AS at_3 FROM provider_events e WHERE e.session_id = s.session_id AND e.event_type = 'quote_request' AND e.ts >= b.at_2) c ON true"""


@query("funnel_steps", _FUNNEL)
def _(d):
    return metrics.funnel_steps(d.provider_events)


@query(
    "funnel_report",
    f"""WITH f AS ({_FUNNEL}), n AS (SELECT CAST(s AS INT) AS step, count(*) FILTER (depth >= s) AS sessions FROM f CROSS JOIN (VALUES (1), (2), (3)) v(s) GROUP BY s)
        SELECT step, sessions, CASE WHEN step = 1 THEN 1.0::DOUBLE ELSE round(sessions::DOUBLE / lag(sessions) OVER (ORDER BY step), 4) END AS rate FROM n""",
)
def _(d):
    return metrics.funnel_report(metrics.funnel_steps(d.provider_events))


@query(
    "session_activity",
    """SELECT session_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS events, count(*) FILTER (event_type = 'quote_request') AS requests FROM (
         SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS visit FROM (
           SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM provider_events) a) b GROUP BY session_id, visit""",
)
def _(d):
    return metrics.session_activity(d.provider_events)


@query(
    "stream_dedup",
    """SELECT idempotency_hash FROM (SELECT DISTINCT sha256(concat(CAST(session_id AS STRING), '|', CAST(provider_id AS STRING))) AS idempotency_hash FROM provider_events WHERE event_type = 'quote_request') t""",
)
def _(d):
    """The events as a stream of files, through the operator, into a written table."""
    from ..functions.records import sha_key
    from ..operators.skew import scratch_path

    raw = metrics.read_event_stream(d.spark, f"{d.folder}/events.parque[t]", d.events.schema.simpleString()[7:-1].replace(":", " "))
    providers = d.sql("SELECT count(*) AS n FROM customer").first()["n"]
    asked = raw.filter("event_type = 'purchase'").withColumn(
        "idempotency_hash", sha_key(F.col("user_id"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(providers)))
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(d.spark, "stream-dedup")
    unique = metrics.stream_dedup(asked, "60 days").select("idempotency_hash")
    unique.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return d.spark.read.schema("idempotency_hash string").parquet(f"{out}/rows")


@query(
    "click_after_search",
    """SELECT session_id, provider_id, first_at, coalesce(last_at >= first_at, false) AS followed FROM (SELECT session_id, provider_id, min(ts) FILTER (event_type = 'page_view') AS first_at,
         max(ts) FILTER (event_type = 'phone_click') AS last_at FROM provider_events GROUP BY session_id, provider_id) t WHERE first_at IS NOT NULL""",
)
def _(d):
    return metrics.click_after_search(d.provider_events)


@query(
    "latest_event",
    """SELECT provider_id, event_id FROM (SELECT provider_id, event_id, row_number() OVER (PARTITION BY provider_id ORDER BY ts DESC, event_id DESC) AS rn FROM provider_events) t WHERE rn = 1""",
)
def _(d):
    return metrics.latest_event(d.provider_events).select("provider_id", "event_id")
