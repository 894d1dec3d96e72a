"""Requests, claims, accounts and overview figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as cl
from ..operators import requests as rq
from .registry import query

_TARGETS = """SELECT submission_id, provider_id, row_number() OVER (PARTITION BY submission_id ORDER BY pos, provider_id) AS place
  FROM (SELECT submission_id, provider_id, min(pos) AS pos FROM submission_targets GROUP BY submission_id, provider_id) a"""
# A submission under an alias of each service, besides those under the services themselves.
_SUBMITTED = """SELECT submission_id, email, service_slug, comune, message, created_at FROM submissions
  UNION ALL SELECT s.submission_id + 100000000, s.email, t.slug, s.comune, s.message, s.created_at + INTERVAL 1 HOUR FROM submissions s
    JOIN taxonomy c ON c.slug = s.service_slug JOIN taxonomy t ON t.canonical_id = c.service_id WHERE s.submission_id % 3 = 0"""
_TICKED = """SELECT submission_id, pos, provider_id FROM submission_targets
  UNION ALL SELECT submission_id + 100000000, pos, provider_id FROM submission_targets WHERE submission_id % 3 = 0"""
_LINKED = """SELECT CAST(floor(property_id / 10) AS BIGINT) AS submission_id, property_id FROM client_properties
  UNION ALL SELECT CAST(floor(property_id / 10) AS BIGINT) + 100000000, property_id FROM client_properties WHERE CAST(floor(property_id / 10) AS BIGINT) % 3 = 0
  UNION ALL SELECT CAST(floor(property_id / 10) AS BIGINT) + 1, property_id FROM client_properties"""
_MEANT = f"""SELECT s.submission_id, s.email, c.slug AS service_slug, s.comune, s.message, s.created_at FROM ({_SUBMITTED}) s JOIN taxonomy t ON t.slug = s.service_slug
  JOIN taxonomy c ON c.service_id = coalesce(t.canonical_id, t.service_id) WHERE c.is_searchable"""
_HASHED = f"""SELECT s.*, sha256(concat(lower(trim(email)), '|', service_slug, '|', lower(trim(comune)), '|', lower(trim(message)), '|', coalesce(t.ids, ''), '|', coalesce(p.ids, ''))) AS idempotency_hash
  FROM ({_MEANT}) s LEFT JOIN (SELECT submission_id, string_agg(CAST(provider_id AS STRING), ',' ORDER BY CAST(provider_id AS STRING)) AS ids
    FROM (SELECT DISTINCT submission_id, provider_id FROM ({_TICKED}) y) x GROUP BY submission_id) t ON t.submission_id = s.submission_id
  LEFT JOIN (SELECT submission_id, string_agg(CAST(property_id AS STRING), ',' ORDER BY CAST(property_id AS STRING)) AS ids FROM (
      SELECT DISTINCT l.submission_id, l.property_id FROM ({_LINKED}) l JOIN ({_SUBMITTED}) o ON o.submission_id = l.submission_id
      JOIN client_properties q ON q.property_id = l.property_id AND lower(trim(q.owner_email)) = lower(trim(o.email))) z GROUP BY submission_id) p ON p.submission_id = s.submission_id"""


def _keyed(d):
    meant = rq.canonical_service(d.sql(_SUBMITTED), d.taxonomy)
    owned = rq.owned_properties(d.sql(_LINKED), meant, d.client_properties)
    return rq.request_keys(meant, d.sql(_TICKED), owned)


@query("dedup_first", _TARGETS)
def _(d):
    return rq.selected_targets(d.submission_targets).select("submission_id", "provider_id", "place")


@query("idempotency_hash", f"SELECT submission_id, idempotency_hash FROM ({_HASHED}) h")
def _(d):
    return _keyed(d).select("submission_id", "idempotency_hash")


@query("canonical_service", f"SELECT submission_id, service_slug FROM ({_MEANT}) m")
def _(d):
    return rq.canonical_service(d.sql(_SUBMITTED), d.taxonomy).select("submission_id", "service_slug")


@query(
    "dedup_requests",
    f"""SELECT idempotency_hash, request_id, created_at, updated_at, submissions, details_from FROM (
          SELECT idempotency_hash, submission_id AS request_id, min(created_at) OVER w AS created_at, max(created_at) OVER w AS updated_at, count(*) OVER w AS submissions,
                 last(submission_id) OVER (PARTITION BY idempotency_hash ORDER BY created_at, submission_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS details_from,
                 row_number() OVER (PARTITION BY idempotency_hash ORDER BY created_at, submission_id) AS rn
          FROM ({_HASHED}) h WINDOW w AS (PARTITION BY idempotency_hash)) t WHERE rn = 1""",
)
def _(d):
    return rq.dedup_requests(_keyed(d)).select("idempotency_hash", "request_id", "created_at", "updated_at", "submissions", "details_from")


def _owned(d):
    return d.providers.withColumn("owner_email", F.when(F.col("provider_id") % 4 == 0, F.upper("email"))).withColumn(
        "profile_status", F.when(F.col("provider_id") % 8 == 0, "verified").when(F.col("provider_id") % 4 == 0, "in_revisione")
    ).withColumn("claimed_at", F.lit(None).cast("timestamp_ntz"))


_OWNED = """SELECT *, CASE WHEN provider_id % 4 = 0 THEN upper(email) END AS owner_email,
  CASE WHEN provider_id % 8 = 0 THEN 'verified' WHEN provider_id % 4 = 0 THEN 'in_revisione' END AS profile_status FROM providers"""


@query(
    "fan_out_recipients",
    f"""SELECT s.submission_id AS request_id, t.provider_id, CASE WHEN p.profile_status = 'verified' THEN p.owner_email ELSE p.email END AS recipient_email,
          coalesce(p.profile_status = 'verified', false) AS is_verified
        FROM submissions s JOIN ({_TARGETS}) t ON t.submission_id = s.submission_id JOIN ({_OWNED}) p ON p.provider_id = t.provider_id WHERE p.status = 'published'""",
)
def _(d):
    requests = d.submissions.select(F.col("submission_id").alias("request_id"))
    return rq.fan_out_recipients(requests, d.submission_targets, _owned(d)).select("request_id", "provider_id", "recipient_email", "is_verified")


_DELIVERIES = "SELECT l_orderkey AS request_id, l_suppkey AS provider_id, l_returnflag <> 'R' AS success, max(l_shipdate) AS at_time FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag <> 'R'"


@query(
    "delivery_status",
    f"""SELECT r.request_id, r.provider_id, CASE WHEN d.success THEN 'sent' WHEN NOT d.success THEN 'failed' ELSE r.status END AS status
        FROM (SELECT DISTINCT request_id, provider_id, 'pending' AS status FROM request_recipients) r LEFT JOIN (
          SELECT request_id, provider_id, success FROM (SELECT *, row_number() OVER (PARTITION BY request_id, provider_id ORDER BY at_time DESC, success DESC) AS rn FROM ({_DELIVERIES}) x) y WHERE rn = 1) d
        ON d.request_id = r.request_id AND d.provider_id = r.provider_id""",
)
def _(d):
    deliveries = d.sql(_DELIVERIES).select("request_id", "provider_id", "success", F.struct("at_time", "success").alias("at"))
    recipients = d.request_recipients.select("request_id", "provider_id").distinct().withColumn("status", F.lit("pending"))
    updated, _ = rq.delivery_status(recipients, deliveries)
    return updated.select("request_id", "provider_id", "status")


@query(
    "request_sent_at",
    f"SELECT request_id, bool_or(success) AS any_sent, max(CASE WHEN success THEN at_time END) AS sent_at FROM ({_DELIVERIES}) x GROUP BY request_id",
)
def _(d):
    deliveries = d.sql(_DELIVERIES).withColumnRenamed("at_time", "at")
    _, sent = rq.delivery_status(d.request_recipients.select("request_id", "provider_id", "status"), deliveries)
    return sent


@query(
    "request_recipients",
    """SELECT q.request_id, coalesce(a.n, 0) AS recipient_count, a.place, a.recipient_name FROM requests q LEFT JOIN (
         SELECT r.request_id, p.full_name AS recipient_name, count(*) OVER (PARTITION BY r.request_id) AS n,
           row_number() OVER (PARTITION BY r.request_id ORDER BY p.full_name NULLS LAST, r.provider_id) AS place
         FROM request_recipients r LEFT JOIN providers p ON p.provider_id = r.provider_id) a ON a.request_id = q.request_id""",
)
def _(d):
    return rq.request_recipients(d.requests, d.request_recipients, d.providers).select("request_id", "recipient_count", "place", "recipient_name")


@query(
    "client_rollup",
    """SELECT r.email, r.requests, r.last_request_at, coalesce(p.n, 0) AS properties, r.services FROM (
         SELECT lower(requester_email) AS email, count(*) AS requests, max(created_at) AS last_request_at, count(DISTINCT service_name) AS services
         FROM requests GROUP BY lower(requester_email)) r
       LEFT JOIN (SELECT lower(owner_email) AS email, count(*) AS n FROM client_properties WHERE status = 'active' GROUP BY lower(owner_email)) p ON p.email = r.email""",
)
def _(d):
    return rq.client_rollup(d.requests, d.client_properties).select("email", "requests", "last_request_at", "properties", "services")


@query(
    "client_services",
    "SELECT email, service_name, row_number() OVER (PARTITION BY email ORDER BY service_name) AS place FROM (SELECT DISTINCT lower(requester_email) AS email, service_name FROM requests) r",
)
def _(d):
    return rq.client_services(d.requests)


@query(
    "client_properties",
    """SELECT property_id, lower(owner_email) AS owner_key, CAST(replace(rendita, ',', '.') AS DOUBLE) AS rendita,
          CASE WHEN shareable THEN 'locazione,mutuo' ELSE 'locazione' END AS usable_for FROM client_properties WHERE status = 'active'""",
)
def _(d):
    rows = d.client_properties.withColumn("usable_for", F.when(
        F.col("shareable"), F.array(F.lit(" locazione"), F.lit("mutuo"), F.lit("locazione"), F.lit("party"))
    ).otherwise(F.array(F.lit("locazione"), F.lit(""))))
    return rq.client_properties(rows).select("property_id", "owner_key", "rendita", F.array_join("usable_for", ",").alias("usable_for"))


_LINKS = "SELECT DISTINCT l_orderkey AS request_id, l_orderkey * 10 + l_linenumber AS property_id FROM lineitem"


def _links(d):
    """_LINKS, dealt once and by the property, as which they are joined."""
    links = d.lineitem.select(F.col("l_orderkey").alias("request_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("property_id"))
    return links.repartition("property_id").distinct()


@query(
    "properties_for_request",
    f"""SELECT l.request_id, p.property_id, p.nickname FROM (SELECT DISTINCT request_id, property_id FROM ({_LINKS}) x) l JOIN requests q ON q.request_id = l.request_id
        JOIN client_properties p ON p.property_id = l.property_id AND lower(p.owner_email) = lower(q.requester_email) WHERE p.status = 'active' AND p.shareable""",
)
def _(d):
    return rq.properties_for_request(_links(d), d.client_properties, d.requests).select("request_id", "property_id", "nickname")


_PROPERTY = """concat('{"id":', property_id, ',"nickname":"', nickname, '","comune":"', comune, '"', CASE WHEN foglio IS NULL THEN '' ELSE concat(',"foglio":"', foglio, '"') END,
  ',"particella":"', particella, '"', CASE WHEN categoria IS NULL THEN '' ELSE concat(',"categoria_catastale":"', categoria, '"') END, ',"rendita_catastale":"', rendita, '","usable_for":["mutuo"],"data_source":"user"}')"""


@query(
    "case_snapshot",
    f"""SELECT q.request_id, concat('{{"mvp":true,"funnel":true,"urgency":"', q.message, '"', CASE WHEN q.request_id % 2 = 0 THEN concat(',"property_value":"', q.request_id, '"') ELSE ',"property_value":"90000"' END,
          ',"documents_ready":"yes","intake_profile":"home","intake":{{"timing_preference":"', q.message, '","deal_value":"90000"}},"selected_notary_ids":[', coalesce(t.list, ''),
          '],"selected_property_ids":[', coalesce(p.ids, ''), '],"properties_snapshot":[', coalesce(p.list, ''), '],"service_requested_by_user":true,"service_source":"user_request"}}') AS case_details
        FROM requests q LEFT JOIN (SELECT request_id, string_agg(CAST(property_id AS STRING), ',' ORDER BY property_id) AS ids, string_agg({_PROPERTY}, ',' ORDER BY property_id) AS list
          FROM (SELECT l.request_id, c.* FROM ({_LINKS}) l JOIN client_properties c ON c.property_id = l.property_id) x GROUP BY request_id) p ON p.request_id = q.request_id
        LEFT JOIN (SELECT submission_id, string_agg(CAST(provider_id AS STRING), ',' ORDER BY place) AS list FROM ({_TARGETS}) y GROUP BY submission_id) t ON t.submission_id = q.request_id""",
)
def _(d):
    none = F.lit(None).cast("string")
    asked = d.requests.select(
        "request_id", F.lit(" ").alias("urgency"), F.when(F.col("request_id") % 2 == 0, F.col("request_id").cast("string")).alias("property_value"),
        none.alias("parties"), F.lit("yes").alias("documents_ready"), F.lit("home").alias("intake_profile"), "message",
    )
    p = _links(d).join(d.client_properties, "property_id").select(
        "request_id", F.col("property_id").alias("id"), "nickname", none.alias("address"), "comune", none.alias("province"), "foglio", "particella",
        none.alias("subalterno"), none.alias("sezione"), F.col("categoria").alias("categoria_catastale"), F.col("rendita").alias("rendita_catastale"),
        none.alias("quota_possesso"), F.array(F.lit("mutuo")).alias("usable_for"), F.lit("user").alias("data_source"),
    )
    targets = rq.selected_targets(d.submission_targets).withColumnRenamed("submission_id", "request_id")
    intake = [F.col("message").alias("timing_preference"), F.lit("90000").alias("deal_value")]
    return rq.case_snapshot(asked, targets, p, intake).select("request_id", "case_details")


@query(
    "claim_status_of_owner",
    f"""SELECT p.provider_id, c.status AS claim_status FROM ({_OWNED}) p LEFT JOIN (SELECT provider_id, email, status FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, lower(email)
          ORDER BY CASE status WHEN 'approved' THEN 0 WHEN 'pending' THEN 1 ELSE 2 END, created_at DESC, claim_id) AS rn FROM claims) x WHERE rn = 1) c
          ON c.provider_id = p.provider_id AND lower(c.email) = lower(p.owner_email) WHERE coalesce(p.owner_email, '') <> ''""",
)
def _(d):
    return cl.claim_status_of_owner(_owned(d), d.claims).select("provider_id", "claim_status")


# One decision after the other, as a walk over the decisions of each provider.
_WALK = f"""WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY created_at, claim_id) AS rn FROM claims),
  walk AS (
    SELECT provider_id, CAST(0 AS BIGINT) AS rn, owner_email, profile_status, CAST(NULL AS TIMESTAMP) AS claimed_at FROM ({_OWNED}) o
    UNION ALL
    SELECT w.provider_id, s.rn,
      CASE WHEN s.status IN ('approved', 'pending') THEN lower(s.email) WHEN lower(coalesce(w.owner_email, '')) = lower(s.email) THEN NULL ELSE w.owner_email END,
      CASE WHEN s.status = 'approved' THEN 'verified' WHEN s.status = 'pending' THEN 'in_revisione' WHEN lower(coalesce(w.owner_email, '')) = lower(s.email) THEN NULL ELSE w.profile_status END,
      CASE WHEN s.status = 'approved' THEN coalesce(w.claimed_at, s.created_at) ELSE w.claimed_at END
    FROM walk w JOIN seq s ON s.provider_id = w.provider_id AND s.rn = w.rn + 1)
SELECT provider_id, owner_email, profile_status, claimed_at FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY rn DESC) AS back FROM walk) x WHERE back = 1"""


@query("claim_transitions", _WALK)
def _(d):
    return cl.claim_transitions(_owned(d), d.claims).select("provider_id", "owner_email", "profile_status", "claimed_at")


_DECISIONS = """SELECT claim_id, status, created_at + INTERVAL 1 DAY AS decided_at FROM claims
  UNION ALL SELECT claim_id, 'rejected' AS status, created_at + INTERVAL 2 DAY AS decided_at FROM claims WHERE claim_id % 7 = 0
  UNION ALL SELECT claim_id, 'approved' AS status, created_at + INTERVAL 3 DAY AS decided_at FROM claims WHERE claim_id % 14 = 0"""


@query(
    "decide_claims",
    f"""SELECT c.claim_id, x.status, x.approved_at, x.rejected_at FROM claims c JOIN (SELECT claim_id, arg_max(status, decided_at) AS status,
          max(decided_at) FILTER (status = 'approved') AS approved_at, max(decided_at) FILTER (status = 'rejected') AS rejected_at FROM ({_DECISIONS}) y GROUP BY claim_id) x ON x.claim_id = c.claim_id""",
)
def _(d):
    never = F.lit(None).cast("timestamp_ntz")
    claims = d.claims.withColumns({"status": F.lit("pending"), "approved_at": never, "rejected_at": never, "verified_at": never})
    return cl.decide_claims(claims, d.sql(_DECISIONS)).select("claim_id", "status", "approved_at", "rejected_at")


# Claims are judged in the order of time; what was admitted so far is carried along.
_ADMITTED = f"""
WITH RECURSIVE j AS (
  SELECT c.*, lower(trim(c.email)) AS e, CASE WHEN o.owned IS NOT NULL AND o.owned <> c.provider_id THEN 'already_has_provider' WHEN p.provider_id IS NULL THEN 'provider_not_found'
    WHEN coalesce(p.owner_email, '') <> '' AND lower(p.owner_email) <> lower(c.email) THEN 'already_claimed' ELSE 'ok' END AS v
  FROM claims c LEFT JOIN ({_OWNED}) p ON p.provider_id = c.provider_id AND p.status = 'published'
  LEFT JOIN (SELECT lower(owner_email) AS e, min(provider_id) AS owned FROM ({_OWNED}) x WHERE owner_email IS NOT NULL GROUP BY lower(owner_email)) o ON o.e = lower(c.email)),
seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY created_at, claim_id) AS rn FROM j),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS claim_id, CAST(NULL AS VARCHAR) AS verdict, CAST([] AS VARCHAR[]) AS emails, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT rn, claim_id, verdict, CASE WHEN verdict = 'ok' THEN list_append(emails, e) ELSE emails END, CASE WHEN verdict = 'ok' THEN list_append(taken, provider_id) ELSE taken END FROM (
    SELECT s.rn, s.claim_id, s.e, s.provider_id, w.emails, w.taken,
      CASE WHEN list_contains(w.emails, s.e) AND w.taken[list_position(w.emails, s.e)] <> s.provider_id THEN 'already_has_provider' WHEN s.v <> 'ok' THEN s.v
           WHEN list_contains(w.taken, s.provider_id) AND w.emails[list_position(w.taken, s.provider_id)] <> s.e THEN 'already_claimed' ELSE 'ok' END AS verdict
    FROM walk w JOIN seq s ON s.rn = w.rn + 1) n)
SELECT j.claim_id, j.provider_id, j.e AS email, w.verdict FROM j JOIN walk w ON w.claim_id = j.claim_id"""


@query("claim_admission", f"SELECT claim_id, provider_id, verdict FROM ({_ADMITTED}) a")
def _(d):
    return cl.claim_admission(d.claims, _owned(d)).select("claim_id", "provider_id", "verdict")


def _held(d):
    """Claims made earlier, with the columns an upsert changes."""
    day = lambda status: F.when(F.col("status") == status, F.col("created_at"))
    return d.claims.filter("claim_id % 3 <> 0").withColumns({"claimant_name": F.lit("old"), "approved_at": day("approved"), "rejected_at": day("rejected")})


def _asked(d):
    """Submissions: every third claim, and a second one for the pair of every earlier claim with an even id."""
    new = d.claims.filter("claim_id % 3 = 0").select("claim_id", "provider_id", "email", "created_at")
    again = d.claims.filter("claim_id % 3 <> 0 AND claim_id % 2 = 0").select(
        F.col("claim_id") + 10_000_000, "provider_id", F.upper("email"), F.expr("created_at + INTERVAL 40 DAY"))
    return new.union(again).toDF("submission_id", "provider_id", "email", "created_at").withColumn("name", F.concat(F.lit("n"), F.col("submission_id").cast("string")))


_HELD = """SELECT claim_id, provider_id, email, 'old' AS claimant_name, status, created_at, CASE WHEN status = 'approved' THEN created_at END AS approved_at FROM claims WHERE claim_id % 3 <> 0"""
_ASKED = """SELECT claim_id AS submission_id, provider_id, lower(email) AS email, created_at FROM claims WHERE claim_id % 3 = 0
  UNION ALL SELECT claim_id + 10000000, provider_id, lower(email), created_at + INTERVAL 40 DAY FROM claims WHERE claim_id % 3 <> 0 AND claim_id % 2 = 0"""


@query(
    "claim_upsert",
    f"""WITH h AS ({_HELD}), s AS (SELECT provider_id, email, arg_min(submission_id, (created_at, submission_id)) AS first_id, min(created_at) AS at_time,
            concat('n', arg_max(submission_id, (created_at, submission_id))) AS name FROM ({_ASKED}) a GROUP BY provider_id, email),
          o AS (SELECT *, row_number() OVER (PARTITION BY provider_id, lower(email) ORDER BY created_at DESC, claim_id DESC) AS rn FROM h WHERE status IN ('pending', 'approved'))
        SELECT h.claim_id, h.provider_id, coalesce(s.name, h.claimant_name) AS claimant_name, CASE WHEN s.name IS NOT NULL THEN 'pending' ELSE h.status END AS status,
          CASE WHEN s.name IS NULL THEN h.approved_at END AS approved_at
        FROM h LEFT JOIN o ON o.claim_id = h.claim_id AND o.rn = 1 LEFT JOIN s ON s.provider_id = o.provider_id AND s.email = lower(o.email)
        UNION ALL SELECT s.first_id, s.provider_id, s.name, 'pending', NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.provider_id = s.provider_id AND lower(o.email) = s.email)""",
)
def _(d):
    return cl.claim_upsert(_held(d), _asked(d)).select("claim_id", "provider_id", "claimant_name", "status", "approved_at")


@query(
    "owners_after_claims",
    f"""SELECT p.provider_id, CASE WHEN a.email IS NOT NULL AND coalesce(lower(p.owner_email), a.email) = a.email THEN a.email ELSE p.owner_email END AS owner_email,
          CASE WHEN a.email IS NOT NULL AND coalesce(lower(p.owner_email), a.email) = a.email THEN coalesce(p.profile_status, 'in_revisione') ELSE p.profile_status END AS profile_status
        FROM ({_OWNED}) p LEFT JOIN (SELECT provider_id, arg_min(email, (created_at, submission_id)) AS email FROM ({_ASKED}) s GROUP BY provider_id) a ON a.provider_id = p.provider_id""",
)
def _(d):
    return cl.owners_after_claims(_owned(d), _asked(d)).select("provider_id", "owner_email", "profile_status")


@query(
    "profile_update",
    f"""SELECT p.provider_id, CASE WHEN p.provider_id % 4 = 0 THEN CASE WHEN p.provider_id % 12 = 0 THEN NULL ELSE 'x' || p.phone END ELSE p.phone END AS phone,
          CASE WHEN p.provider_id % 4 = 0 THEN 'https://new.example.org' ELSE p.website END AS website,
          CASE WHEN p.provider_id % 8 = 0 THEN 'verified' WHEN p.provider_id % 4 = 0 THEN 'in_revisione' ELSE p.profile_status END AS profile_status FROM ({_OWNED}) p""",
)
def _(d):
    edits = d.providers.select(
        "provider_id", F.col("email").alias("editor"),
        F.when(F.col("provider_id") % 12 == 0, " ").otherwise(F.concat(F.lit("x"), "phone")).alias("phone"), F.lit("//new.example.org").alias("website"),
    )
    return cl.profile_update(_owned(d), edits).select("provider_id", "phone", "website", "profile_status")


@query(
    "claims_queue",
    """SELECT c.claim_id, c.status, p.full_name FROM (SELECT * FROM claims ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, created_at DESC, claim_id LIMIT 100) c
       LEFT JOIN providers p ON p.provider_id = c.provider_id""",
)
def _(d):
    return cl.claims_queue(d.claims, d.providers).select("claim_id", "status", "full_name")


@query(
    "union_accounts",
    """SELECT * FROM (SELECT 'notary' AS kind, email, google, last_login_at FROM provider_accounts ORDER BY coalesce(last_login_at, created_at) DESC NULLS LAST, email LIMIT 50) a
       UNION ALL SELECT * FROM (SELECT 'client' AS kind, email, google, last_login_at FROM client_accounts ORDER BY coalesce(last_login_at, created_at) DESC NULLS LAST, email LIMIT 50) b""",
)
def _(d):
    return cl.union_accounts(d.provider_accounts, d.client_accounts, 50).drop("created_at")


@query(
    "accounts_recent",
    "SELECT email, google FROM client_accounts ORDER BY coalesce(last_login_at, created_at) DESC NULLS LAST, email LIMIT 100",
)
def _(d):
    return cl.accounts_recent(d.client_accounts).select("email", "google")


_NOW = "1998-08-01 00:00:00"


@query(
    "directory_overview",
    f"""SELECT (SELECT count(*) FROM providers WHERE status = 'published') AS providers, (SELECT count(*) FROM providers WHERE status = 'published' AND coalesce(email, '') <> '') AS with_email,
          (SELECT count(*) FROM providers WHERE status = 'published' AND coalesce(phone, '') <> '') AS with_phone, (SELECT count(*) FROM providers WHERE status = 'published' AND coalesce(website, '') <> '') AS with_website,
          (SELECT count(*) FROM providers WHERE status = 'published' AND lat IS NOT NULL AND lng IS NOT NULL) AS with_geo, (SELECT count(*) FROM providers WHERE status = 'published' AND is_official) AS official,
          (SELECT count(*) FROM services) AS services, (SELECT count(*) FROM requests) AS requests, (SELECT count(*) FROM requests WHERE created_at >= TIMESTAMP '{_NOW}' - INTERVAL 7 DAY) AS requests_7d,
          (SELECT count(DISTINCT lower(requester_email)) FROM requests) AS client_emails, (SELECT count(*) FROM claims WHERE status = 'pending') AS claims_pending,
          (SELECT count(*) FROM client_properties WHERE status = 'active') AS properties, (SELECT count(*) FROM observations) AS observations, (SELECT count(*) FROM provider_services) AS service_links""",
)
def _(d):
    return cl.directory_overview(
        d.providers, d.services, d.requests, d.claims, d.client_properties, d.observations, d.provider_services, F.lit(_NOW).cast("timestamp_ntz")
    )


@query(
    "site_stats",
    "SELECT (SELECT count(*) FROM providers WHERE status = 'published') AS providers, (SELECT count(*) FROM services) AS services, (SELECT count(*) FROM price_benchmarks) AS prices",
)
def _(d):
    return cl.site_stats(d.providers, d.services, d.price_benchmarks)


@query(
    "observation_breakdown",
    "SELECT coalesce(source, 'unknown') AS source, coalesce(status, 'unknown') AS status, count(*) AS total FROM observations GROUP BY 1, 2 ORDER BY total DESC, source, status LIMIT 40",
)
def _(d):
    return cl.observation_breakdown(d.observations)


@query(
    "run_summary",
    """SELECT source, count(*) AS processed, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'empty') AS no_match, count(*) FILTER (status = 'error') AS errors,
          round(CAST(count(*) * 0.032 AS DOUBLE), 3) AS estimated_cost FROM observations GROUP BY source""",
)
def _(d):
    return cl.run_summary(d.observations, 0.032)


@query(
    "geocode_coverage",
    """SELECT count(*) AS total, count(*) FILTER (lat IS NOT NULL) AS with_coords, count(*) FILTER (coalesce(done, false)) AS from_source, count(*) FILTER (lat IS NULL AND NOT coalesce(settled, false)) AS remaining
       FROM providers p LEFT JOIN (SELECT provider_id, bool_or(status = 'completed') AS done, bool_or(status IN ('completed', 'empty')) AS settled FROM observations WHERE source = 'source2' GROUP BY provider_id) o
         ON o.provider_id = p.provider_id""",
)
def _(d):
    return cl.geocode_coverage(d.providers, d.observations, "source2")
