"""Quote requests: admission, deduplication, recipients, delivery, clients and their properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records
from ..functions.geo import as_coord
from .skew import place_in_group, top_per_group

# What a client may mark a property as usable for.
PROPERTY_USE_CASES = [
    "730", "imu_tari", "acquisto_vendita", "mutuo", "successione", "donazione", "locazione", "altro",
]


def selected_targets(targets: DataFrame, limit: int | None = None) -> DataFrame:
    """First occurrences of ticked ids in form order, with `place`; all of them unless a limit is given. targets:
    submission_id, pos, provider_id."""
    first = targets.groupBy("submission_id", "provider_id").agg(F.min("pos").alias("pos"))
    order = [F.col("pos"), F.col("provider_id")]
    if limit is None:
        return place_in_group(first, ["submission_id"], order, "place")
    return top_per_group(first, ["submission_id"], order, limit, "place")


def canonical_service(submissions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Submissions with the service they mean: an alias stands for its canonical service; what is unknown or cannot
    be searched is refused."""
    named = taxonomy.select("service_id", "slug", "canonical_id", "is_searchable")
    real = named.select(F.col("service_id").alias("_real"), F.col("slug").alias("_slug"), "is_searchable").filter("is_searchable")
    means = named.select(F.col("slug").alias("service_slug"), F.coalesce("canonical_id", "service_id").alias("_real")).join(real, "_real")
    return submissions.join(means.select("service_slug", "_slug"), "service_slug").withColumn("service_slug", F.col("_slug")).drop("_slug")


def owned_properties(links: DataFrame, submissions: DataFrame, properties: DataFrame) -> DataFrame:
    """Linked properties (submission_id, property_id) that belong to the submitter."""
    mine = submissions.select("submission_id", F.lower(F.trim("email")).alias("_email"))
    owned = properties.select("property_id", F.lower(F.trim("owner_email")).alias("_owner"))
    # Dealt by property while rows are two ids, then by submission, as which they are gathered after.
    linked = links.select("submission_id", "property_id").repartition("property_id").distinct().join(owned, "property_id")
    return linked.join(mine, "submission_id").filter(F.col("_email") == F.col("_owner")).select("property_id", "submission_id")


def _id_list(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """The distinct ids of each submission as one array: what a person ticked in one form."""
    return rows.select("submission_id", id_col).groupBy("submission_id").agg(F.collect_set(id_col).alias(name))


def request_keys(submissions: DataFrame, targets: DataFrame, properties: DataFrame | None = None) -> DataFrame:
    """Submissions with their idempotency hash over all ticked providers and all linked properties."""
    none = F.array().cast("array<bigint>")
    rows = submissions.join(_id_list(targets.select("submission_id", "provider_id").repartition("submission_id"), "provider_id", "_providers"), "submission_id", "left")
    if properties is not None:
        rows = rows.join(_id_list(properties, "property_id", "_properties"), "submission_id", "left")
    else:
        rows = rows.withColumn("_properties", none)
    return rows.withColumn("idempotency_hash", records.idempotency_hash(
        F.col("email"), F.col("service_slug"), F.col("comune"), F.coalesce("message", F.lit("")),
        F.coalesce("_providers", none), F.coalesce("_properties", none),
    )).drop("_providers", "_properties")


def dedup_requests(keyed: DataFrame) -> DataFrame:
    """One request per hash: identity and first fields from the first submission, details from the last."""
    moment = F.struct("created_at", "submission_id")
    return keyed.groupBy("idempotency_hash").agg(
        F.min_by("submission_id", moment).alias("request_id"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.min_by(F.lower(F.trim("email")), moment).alias("requester_email"),
        F.min_by("service_slug", moment).alias("service_slug"),
        F.max_by("submission_id", moment).alias("details_from"),
        F.count("*").alias("submissions"),
    )


def fan_out_recipients(requests: DataFrame, targets: DataFrame, providers: DataFrame) -> DataFrame:
    """Request by selected published provider; a verified owner's address comes before the
    public one. providers: provider_id, full_name, status, email, owner_email, profile_status."""
    verified = F.col("profile_status") == "verified"
    public = F.nullif("email", F.lit(""))
    live = providers.filter("status = 'published'").select(
        "provider_id", F.col("full_name").alias("recipient_name"),
        F.when(verified, F.coalesce(F.nullif("owner_email", F.lit("")), public)).otherwise(public).alias("recipient_email"),
        F.coalesce(verified, F.lit(False)).alias("is_verified"),
    )
    # The first of equal ticks by one sort, which the join goes on with: a distinct would hold all rows in two hash tables besides.
    ticked = targets.select(F.col("submission_id").alias("request_id"), "provider_id")
    chosen = top_per_group(ticked, ["request_id", "provider_id"], [F.col("provider_id")], 1)
    return requests.select("request_id").join(chosen, "request_id").join(live, "provider_id").withColumn("status", F.lit("pending"))


def delivery_status(recipients: DataFrame, deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(recipients with sent/failed status, requests with at least one success). deliveries: request_id,
    provider_id, success, at."""
    last = deliveries.groupBy("request_id", "provider_id").agg(
        F.max_by("success", "at").alias("_ok"), F.max("at").alias("_at")
    )
    updated = recipients.join(last, ["request_id", "provider_id"], "left").withColumn(
        "status", F.when(F.col("_ok"), "sent").when(~F.col("_ok"), "failed").otherwise(F.col("status"))
    ).withColumn("sent_at", F.when(F.col("_ok"), F.col("_at"))).drop("_ok", "_at")
    sent = deliveries.groupBy("request_id").agg(F.bool_or("success").alias("any_sent"), F.max(F.when(F.col("success"), F.col("at"))).alias("sent_at"))
    return updated, sent


def request_recipients(requests: DataFrame, recipients: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests with their recipients, one row a recipient: recipient_count, place and recipient_name in the order of
    names, unknown ones last. A request without recipients has one row without a place."""
    named = providers.select("provider_id", F.col("full_name").alias("recipient_name"))
    linked = recipients.select("request_id", "provider_id").join(named, "provider_id", "left")
    counts = linked.groupBy("request_id").agg(F.count("*").alias("recipient_count"))
    placed = place_in_group(linked, ["request_id"], [F.col("recipient_name").asc_nulls_last(), F.col("provider_id")], "place")
    return requests.join(counts, "request_id", "left").join(placed.drop("provider_id"), "request_id", "left").withColumn(
        "recipient_count", F.coalesce("recipient_count", F.lit(0).cast("bigint"))
    )


def client_rollup(requests: DataFrame, properties: DataFrame) -> DataFrame:
    """Per client email: requests, last request, active properties, number of distinct services asked for."""
    email = F.lower("requester_email").alias("email")
    summary = requests.groupBy(email).agg(F.count("*").alias("requests"), F.max("created_at").alias("last_request_at"))
    services = requests.select(email, "service_name").distinct().groupBy("email").agg(F.count("service_name").alias("services"))
    owned = properties.filter("status = 'active'").groupBy(F.lower("owner_email").alias("email")).agg(F.count("*").alias("properties"))
    return summary.join(services, "email", "left").join(owned, "email", "left").withColumn(
        "properties", F.coalesce("properties", F.lit(0).cast("bigint"))
    )


def client_services(requests: DataFrame) -> DataFrame:
    """The distinct services of each client, one row each, with their place in order of name."""
    asked = requests.select(F.lower("requester_email").alias("email"), "service_name").filter("service_name IS NOT NULL").distinct()
    return place_in_group(asked, ["email"], [F.col("service_name")], "place")


def client_properties(rows: DataFrame, use_cases: list[str] | None = None) -> DataFrame:
    """Active properties with clean fields: use cases off the list dropped, decimal comma read, summary line."""
    allowed = F.array(*[F.lit(u) for u in use_cases or PROPERTY_USE_CASES])
    none = F.lit(None).cast("string")
    given = lambda c: F.col(c) if c in rows.columns else none
    out = rows.filter("status = 'active'").withColumn("owner_key", F.lower(F.trim("owner_email"))).withColumn(
        "rendita", as_coord(F.col("rendita"))
    ).withColumn("summary", records.cadastral_summary(
        given("foglio"), given("particella"), given("subalterno"), given("sezione"), given("categoria")
    ))
    if "usable_for" in rows.columns:
        out = out.withColumn("usable_for", F.array_intersect(F.array_distinct(F.transform("usable_for", lambda u: F.trim(u))), allowed))
    return out


def properties_for_request(links: DataFrame, properties: DataFrame, requests: DataFrame) -> DataFrame:
    """Linked properties that the requester owns, shares and has not archived."""
    owned = properties.filter("status = 'active' AND shareable").withColumn("_email", F.lower("owner_email"))
    asked = requests.select("request_id", F.lower("requester_email").alias("_email"))
    return links.select("request_id", "property_id").distinct().join(asked, "request_id").join(owned, ["property_id", "_email"]).drop("_email")


#: The fields of a property in a case, in order, and the fields of the case around them.
PROPERTY_FIELDS = (
    "id", "nickname", "address", "comune", "province", "foglio", "particella", "subalterno", "sezione",
    "categoria_catastale", "rendita_catastale", "quota_possesso", "usable_for", "data_source",
)
CASE_FIELDS = (
    "mvp", "funnel", "urgency", "property_value", "parties", "documents_ready", "intake_profile", "intake",
    "selected_notary_ids", "selected_property_ids", "properties_snapshot", "service_requested_by_user", "service_source",
)


def case_snapshot(requests: DataFrame, targets: DataFrame, properties: DataFrame, intake: list[Column]) -> DataFrame:
    """Requests with the whole case as JSON, all thirteen fields in order; a field that is null stays out.

    requests: request_id, urgency, property_value, parties, documents_ready, intake_profile, and what `intake` uses, whose
    names are the intake's keys. Without an own value urgency falls back to the intake's timing_preference and the
    property value to its deal_value or loan_amount. targets: request_id, provider_id, place. properties: request_id
    and the property fields. A case holds what one form carried."""
    ids = targets.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "provider_id"))), lambda t: t["provider_id"]).alias("selected_notary_ids")
    )
    # Dealt as plain rows: what is the same in all of them is added after, and lists are made only once.
    held = properties.repartition("request_id").groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*PROPERTY_FIELDS))).alias("properties_snapshot"))
    rows = requests.join(ids, "request_id", "left").join(held, "request_id", "left").withColumn("intake", F.struct(*intake))
    keys = set(rows.schema["intake"].dataType.fieldNames())
    given = lambda name: [F.col(f"intake.{name}")] if name in keys else []
    text = lambda name, *others: F.coalesce(F.nullif(F.trim(name), F.lit("")), *[o for n in others for o in given(n)])
    kinds = dict(held.dtypes)
    empty = F.array()
    values = {
        "mvp": F.lit(True), "funnel": F.lit(True), "urgency": text("urgency", "timing_preference"),
        "property_value": text("property_value", "deal_value", "loan_amount"), "parties": text("parties"),
        "documents_ready": text("documents_ready"), "intake_profile": F.col("intake_profile"), "intake": F.col("intake"),
        "selected_notary_ids": F.coalesce("selected_notary_ids", empty.cast(dict(ids.dtypes)["selected_notary_ids"])),
        "selected_property_ids": F.transform(F.coalesce("properties_snapshot", empty.cast(kinds["properties_snapshot"])), lambda p: p["id"]),
        "properties_snapshot": F.coalesce("properties_snapshot", empty.cast(kinds["properties_snapshot"])),
        "service_requested_by_user": F.lit(True), "service_source": F.lit("user_request"),
    }
    case = F.to_json(F.struct(*[values[name].alias(name) for name in CASE_FIELDS]))
    return rows.withColumn("case_details", case).drop("selected_notary_ids", "properties_snapshot", "intake")
