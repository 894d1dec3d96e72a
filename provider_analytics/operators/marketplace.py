"""Marketplace figures: lead quality, matching rank, quote checks, stage funnels, health by territory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import top_per_group

# Points for what a request brings along.
LEAD_POINTS = {
    "contact_verified": 20, "identity_verified": 10, "type_defined": 15, "economics_present": 15,
    "place_defined": 10, "documents_present": 15, "timing_given": 10, "checklist_done": 5,
}
# Weights of the matching rank; the price is no part of it.
MATCH_WEIGHTS = {
    "geo_fit": 0.30, "practice_fit": 0.20, "availability": 0.15, "response_rate": 0.10, "response_speed": 0.10,
    "user_preference": 0.10, "marketplace_quality": 0.05,
}
HARD_FILTERS = ["in_area", "offers_type", "available", "active", "opted_in", "below_limit", "compatible"]
# Stages of the two funnels, in order.
USER_STAGES = ["landing", "start", "completed", "qualified", "sent", "quoted", "viewed", "chosen", "started", "done"]
PROVIDER_STAGES = ["profile_viewed", "claimed", "delivered", "opened", "accepted", "quote_sent", "chosen"]
FIRST_SEND = 3


def lead_quality(requests: DataFrame) -> DataFrame:
    """Score 0 to 100 and class A, B, C or Incomplete from boolean columns."""
    score = sum((F.when(F.coalesce(F.col(c), F.lit(False)), p).otherwise(0) for c, p in LEAD_POINTS.items()), F.lit(0))
    return requests.withColumn("score", score.cast("int")).withColumn(
        "class", F.when(F.col("score") >= 80, "A").when(F.col("score") >= 60, "B").when(F.col("score") >= 40, "C").otherwise("Incomplete")
    )


def match_rank(candidates: DataFrame, first_send: int = FIRST_SEND) -> DataFrame:
    """Candidates that pass all hard filters, by weighted fit, the first few per request."""
    fit = candidates
    for name in HARD_FILTERS:
        fit = fit.filter(F.col(name))
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in MATCH_WEIGHTS.items()), F.lit(0.0))
    return top_per_group(
        fit.withColumn("match_score", F.round(score, 6)), ["request_id"], [F.col("match_score").desc(), F.col("provider_id")], first_send, "place"
    )


def quote_check(quotes: DataFrame, parts: list[str], required: list[str], today: Column) -> DataFrame:
    """Flags on quotes; prices are reported, never changed."""
    total = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
    missing = F.lit(False)
    for c in required:
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return quotes.withColumn("sum_differs", F.abs(F.col("total_cents") - total) > 0).withColumn("field_missing", missing).withColumn(
        "expired", F.coalesce(F.col("valid_until") < today, F.lit(False))
    )


def stage_funnel(events: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Subjects per stage and the share of those at the stage before. Every subject is one row of conditional
    flags, so the work is one partial aggregate."""
    flags = events.groupBy(key).agg(*[F.bool_or(F.col("stage") == s).alias(s) for s in stages])
    counts = flags.agg(*[F.count_if(s).alias(s) for s in stages])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("subjects"),
                 (F.lit(1.0) if i == 0 else F.round(F.col(s) / F.nullif(F.col(stages[i - 1]), F.lit(0)), 4)).alias("rate"))
        for i, s in enumerate(stages)
    ])))


def market_health(requests: DataFrame, responses: DataFrame, supply: DataFrame) -> DataFrame:
    """Demand, supply and answers by territory and type, with alerts.

    requests: request_id, territory, type, incomplete. responses: request_id, provider_id, response_days (null
    = none), won. supply: territory, providers. Answers are summed per request first, then per territory; the
    largest provider share needs one sum per (territory, type, provider)."""
    place = ["territory", "type"]
    keyed = responses.join(requests.select("request_id", *place), "request_id")
    per_request = keyed.groupBy("request_id").agg(
        F.count("*").alias("_sent"), F.count("response_days").alias("_answers"), F.bool_or("won").alias("_won")
    )
    base = requests.join(per_request, "request_id", "left").groupBy(*place).agg(
        F.count("*").alias("demand"), F.round(F.avg(F.coalesce("_sent", F.lit(0))), 4).alias("matches_per_request"),
        F.round(F.avg(F.when(F.coalesce("_answers", F.lit(0)) > 0, 1.0).otherwise(0.0)), 4).alias("quote_coverage"),
        F.round(F.avg(F.when(F.coalesce("_won", F.lit(False)), 1.0).otherwise(0.0)), 4).alias("choice_rate"),
        F.round(F.avg(F.when(F.col("incomplete"), 1.0).otherwise(0.0)), 4).alias("incomplete_rate"),
    )
    # Response times are whole days: the exact median keeps one counter per distinct day.
    speed = keyed.groupBy(*place).agg(F.median("response_days").alias("median_response_days"))
    wins = keyed.filter("won").groupBy(*place, "provider_id").agg(F.count("*").alias("_w"))
    share = wins.groupBy(*place).agg(F.round(F.max("_w") / F.sum("_w"), 4).alias("top_win_share"))
    out = base.join(speed, place, "left").join(share, place, "left").join(supply, "territory", "left").withColumn(
        "supply", F.coalesce("providers", F.lit(0).cast("bigint"))
    ).drop("providers")
    ratio = F.round(F.col("demand") / F.nullif("supply", F.lit(0)), 4)
    return out.withColumn("request_ratio", ratio).withColumns({
        "few_providers": F.coalesce(F.col("request_ratio") > 10, F.lit(True)),
        "few_requests": F.coalesce(F.col("request_ratio") < 0.1, F.lit(False)),
        "concentrated": F.coalesce(F.col("top_win_share") > 0.5, F.lit(False)),
        "ignored": F.col("quote_coverage") < 0.5,
        "many_incomplete": F.col("incomplete_rate") > 0.3,
    })
