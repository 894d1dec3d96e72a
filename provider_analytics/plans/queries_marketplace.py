"""Marketplace figures over requests and their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marketplace as mk
from .registry import query

_LEADS = """SELECT o_orderkey AS request_id, o_orderkey % 2 = 0 AS contact_verified, o_orderkey % 3 = 0 AS identity_verified, o_orderpriority <> '5-LOW' AS type_defined,
  o_totalprice > 100000 AS economics_present, o_orderstatus <> 'P' AS place_defined, o_orderkey % 5 < 2 AS documents_present, o_orderpriority LIKE '1%' AS timing_given,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 7 = 1 END AS checklist_done FROM orders"""
_POINTS = " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in mk.LEAD_POINTS.items())


@query(
    "lead_quality",
    f"""SELECT request_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'Incomplete' END AS class
        FROM (SELECT request_id, CAST({_POINTS} AS INT) AS score FROM ({_LEADS}) l) t""",
)
def _(d):
    return mk.lead_quality(d.sql(_LEADS)).select("request_id", "score", "class")


_CANDIDATES = """SELECT l_orderkey AS request_id, l_suppkey AS provider_id, max(l_discount) AS discount, max(l_tax) AS tax, max(l_quantity) AS quantity, max(l_returnflag) AS flag, max(l_linestatus) AS linestatus
  FROM lineitem GROUP BY l_orderkey, l_suppkey"""
_FITS = f"""SELECT request_id, provider_id, flag <> 'N' AS in_area, true AS offers_type, linestatus = 'O' AS available, quantity > 3 AS active, true AS opted_in, quantity < 49 AS below_limit, true AS compatible,
  quantity / 50 AS geo_fit, discount * 10 AS practice_fit, tax * 10 AS availability, quantity / 100 AS response_rate, discount AS response_speed, CAST(NULL AS DOUBLE) AS user_preference, tax AS marketplace_quality FROM ({_CANDIDATES}) c"""


@query(
    "match_rank",
    f"""SELECT request_id, provider_id, match_score, place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY match_score DESC, provider_id) AS place FROM (
          SELECT request_id, provider_id, round(geo_fit * 0.30 + practice_fit * 0.20 + availability * 0.15 + response_rate * 0.10 + response_speed * 0.10 + marketplace_quality * 0.05, 6) AS match_score
          FROM ({_FITS}) f WHERE in_area AND available AND active AND below_limit) g) h WHERE place <= 3""",
)
def _(d):
    return mk.match_rank(d.sql(_FITS)).select("request_id", "provider_id", "match_score", "place")


_QUOTES = """SELECT l_orderkey, l_linenumber, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS fee_cents, CAST(floor(l_quantity) AS BIGINT) AS tax_cents,
  CAST(floor(l_extendedprice) AS BIGINT) + CAST(floor(l_quantity) AS BIGINT) + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS total_cents,
  CASE WHEN l_linestatus = 'O' THEN '' ELSE l_returnflag END AS notes, l_shipdate AS valid_until FROM lineitem"""


@query(
    "quote_check",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, total_cents <> fee_cents + tax_cents AS sum_differs, notes = '' AS field_missing, valid_until < TIMESTAMP '1997-01-01 00:00:00' AS expired FROM ({_QUOTES}) q""",
)
def _(d):
    checked = mk.quote_check(d.sql(_QUOTES), ["fee_cents", "tax_cents"], ["notes", "valid_until"], F.lit("1997-01-01 00:00:00").cast("timestamp_ntz"))
    return checked.select("l_orderkey", "l_linenumber", "l_suppkey", "sum_differs", "field_missing", "expired")


def _funnel_sql(key, mapping, stages):
    flags = ", ".join(f"bool_or({mapping[s]}) AS {s}" for s in stages)
    rows = " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INT) AS step, '{s}' AS stage, count(*) FILTER ({s}) AS subjects, "
        + ("1.0::DOUBLE" if i == 0 else f"round(count(*) FILTER ({s})::DOUBLE / nullif(count(*) FILTER ({stages[i - 1]}), 0), 4)") + " AS rate FROM f"
        for i, s in enumerate(stages)
    )
    return f"WITH f AS (SELECT {key}, {flags} FROM lineitem GROUP BY {key}) {rows}"


def _stage_rows(d, key, mapping, stages):
    branches = F.array_compact(F.array(*[F.when(F.expr(mapping[s]), s) for s in stages]))
    return d.lineitem.select(key, F.explode(branches).alias("stage"))


_USER = {"landing": "true", "start": "l_linenumber >= 1", "completed": "l_linenumber >= 2", "qualified": "l_linenumber >= 2 AND l_quantity > 10", "sent": "l_linenumber >= 3",
         "quoted": "l_linenumber >= 3 AND l_returnflag <> 'N'", "viewed": "l_linenumber >= 4", "chosen": "l_linenumber >= 5", "started": "l_linenumber >= 6", "done": "l_linenumber >= 7"}
_PROVIDER = {"profile_viewed": "true", "claimed": "l_linenumber >= 2", "delivered": "l_linenumber >= 3", "opened": "l_linenumber >= 4", "accepted": "l_linenumber >= 5 AND l_quantity > 10",
             "quote_sent": "l_linenumber >= 6 AND l_quantity > 20", "chosen": "l_linenumber >= 7 AND l_quantity > 45"}


@query("funnel_user", _funnel_sql("l_orderkey", _USER, mk.USER_STAGES))
def _(d):
    return mk.stage_funnel(_stage_rows(d, "l_orderkey", _USER, mk.USER_STAGES), "l_orderkey", mk.USER_STAGES)


@query("funnel_provider", _funnel_sql("l_suppkey", _PROVIDER, mk.PROVIDER_STAGES))
def _(d):
    return mk.stage_funnel(_stage_rows(d, "l_suppkey", _PROVIDER, mk.PROVIDER_STAGES), "l_suppkey", mk.PROVIDER_STAGES)


_MARKET_REQ = "SELECT request_id, comune AS territory, service_name AS type, message = '5-LOW' AS incomplete FROM requests"
_MARKET_RESP = """SELECT l_orderkey AS request_id, l_suppkey AS provider_id, CASE WHEN l_returnflag <> 'N' THEN CAST(floor(l_quantity) AS INT) END AS response_days,
  l_returnflag = 'R' AND l_linenumber = 1 AS won FROM lineitem"""
_MARKET_SUPPLY = "SELECT comune AS territory, count(*) AS providers FROM providers WHERE status = 'published' GROUP BY comune"


@query(
    "market_health",
    f"""WITH r AS ({_MARKET_REQ}), a AS ({_MARKET_RESP}), pr AS (SELECT request_id, count(*) AS sent, count(response_days) AS answers, bool_or(won) AS won FROM a GROUP BY request_id),
        b AS (SELECT territory, type, count(*) AS demand, round(avg(coalesce(sent, 0)), 4) AS matches_per_request, round(avg(CASE WHEN coalesce(answers, 0) > 0 THEN 1 ELSE 0 END), 4) AS quote_coverage,
          round(avg(CASE WHEN coalesce(won, false) THEN 1 ELSE 0 END), 4) AS choice_rate, round(avg(CASE WHEN incomplete THEN 1 ELSE 0 END), 4) AS incomplete_rate
          FROM r LEFT JOIN pr ON pr.request_id = r.request_id GROUP BY territory, type),
        s AS (SELECT territory, type, median(response_days) AS median_response_days FROM a JOIN r ON r.request_id = a.request_id GROUP BY territory, type),
        w AS (SELECT territory, type, round(max(n) / sum(n), 4) AS top_win_share FROM (SELECT territory, type, provider_id, count(*) AS n FROM a JOIN r ON r.request_id = a.request_id WHERE won GROUP BY territory, type, provider_id) x GROUP BY territory, type),
        o AS (SELECT b.*, s.median_response_days, w.top_win_share, coalesce(p.providers, 0) AS supply, round(b.demand / nullif(p.providers, 0), 4) AS request_ratio FROM b
          LEFT JOIN s ON s.territory = b.territory AND s.type = b.type LEFT JOIN w ON w.territory = b.territory AND w.type = b.type LEFT JOIN ({_MARKET_SUPPLY}) p ON p.territory = b.territory)
        SELECT *, coalesce(request_ratio > 10, true) AS few_providers, coalesce(request_ratio < 0.1, false) AS few_requests, coalesce(top_win_share > 0.5, false) AS concentrated,
          quote_coverage < 0.5 AS ignored, incomplete_rate > 0.3 AS many_incomplete FROM o""",
)
def _(d):
    return mk.market_health(d.sql(_MARKET_REQ), d.sql(_MARKET_RESP), d.sql(_MARKET_SUPPLY))
