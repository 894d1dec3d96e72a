"""Directory entities as SQL views over the raw tables.

The text is portable SQL, so the same definitions serve as Spark temporary views and as the WITH
clause of the SQL each query is checked against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.tables import TABLES, read_table

VIEWS: dict[str, str] = {}

VIEWS["providers"] = """
SELECT c_custkey AS provider_id,
       concat('provider-', CAST(c_custkey AS STRING)) AS slug,
       concat(c_mktsegment, ' ', c_name) AS full_name,
       concat(n_name, ' C', CAST(c_custkey % 8 AS STRING)) AS comune,
       n_name AS district,
       CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE concat('Via ', c_mktsegment, ' ', CAST(c_custkey % 97 AS STRING)) END AS address,
       concat('0', CAST(100000000 + (c_custkey * 7919) % 800000000 AS STRING)) AS phone,
       concat(lower(c_name), '@example.org') AS email,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('www.p', CAST(c_custkey AS STRING), '.example.org') END AS website,
       CASE WHEN c_custkey % 9 = 4 THEN NULL
            ELSE 36 + CAST((c_nationkey * 37 + (c_custkey % 8) * 11) % 110 AS DOUBLE) / 10 + CAST(c_custkey % 17 AS DOUBLE) / 100 END AS lat,
       CASE WHEN c_custkey % 9 = 4 THEN NULL
            ELSE 7 + CAST((c_nationkey * 53 + (c_custkey % 8) * 7) % 110 AS DOUBLE) / 10 + CAST(c_custkey % 13 AS DOUBLE) / 100 END AS lng,
       CASE WHEN c_custkey % 20 = 7 THEN 'draft' ELSE 'published' END AS status,
       c_custkey % 5 <> 0 AS is_official
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS["services"] = """
SELECT min(p_partkey) AS service_id, replace(p_name, ' ', '-') AS slug, p_name AS name,
       CASE WHEN p_name LIKE '% gear' OR p_name LIKE '% bolt' OR p_name LIKE '% rod' THEN 'metal'
            WHEN p_name LIKE '% ring' OR p_name LIKE '% plate' THEN 'flat' ELSE NULL END AS category,
       CASE WHEN p_name LIKE 'old %' THEN 'alias' WHEN p_name LIKE 'hot %' THEN 'hub' ELSE 'service' END AS record_kind,
       CASE WHEN p_name LIKE 'old %' THEN concat('new', substr(p_name, 4)) ELSE NULL END AS canonical_name,
       p_name NOT LIKE 'old %' AND p_name NOT LIKE 'hot %' AS is_searchable,
       min(p_size) AS priority
FROM part GROUP BY p_name
"""

VIEWS["taxonomy"] = """
SELECT s.service_id, s.slug, s.name, s.category, s.record_kind, s.is_searchable, s.priority,
       c.service_id AS canonical_id
FROM services s LEFT JOIN services c ON c.name = s.canonical_name
"""

# What editors have written for a service; some have nothing, some a list that is no list.
VIEWS["service_contents"] = """
SELECT p.service_id, CASE WHEN p.service_id % 5 = 3 THEN 'none' WHEN p.service_id % 5 = 4 THEN NULL ELSE p.brands END AS required_documents,
       text AS html_content, CASE WHEN p.service_id % 3 = 0 THEN ' ' WHEN p.service_id % 3 = 1 THEN concat('/img/', lang, '.webp') ELSE NULL END AS image_url,
       source AS content_status
FROM (SELECT min(p_partkey) AS service_id, concat('["', min(p_brand), '","', max(p_brand), '"]') AS brands FROM part GROUP BY p_name) p
JOIN documents ON doc_id = p.service_id * 2
"""

VIEWS["price_benchmarks"] = """
SELECT p_partkey AS benchmark_id, s.service_id,
       CASE WHEN p_partkey % 3 = 0 THEN 'national' ELSE 'province' END AS location_scope,
       CAST(round(p_retailprice * 80) AS INT) AS price_min_cents,
       CAST(round(p_retailprice * 100) AS INT) AS price_avg_cents,
       CAST(round(p_retailprice * 150) AS INT) AS price_max_cents,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 10 AS DOUBLE) / 10 END AS confidence,
       p_partkey % 365 AS updated_day
FROM part JOIN services s ON s.name = p_name
"""

VIEWS["provider_services"] = """
SELECT o_custkey AS provider_id, s.service_id, concat('src', l_returnflag) AS source,
       max(l_discount) * 5 AS confidence
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey JOIN services s ON s.name = p_name
GROUP BY o_custkey, s.service_id, concat('src', l_returnflag)
"""

VIEWS["requests"] = """
SELECT o_orderkey AS request_id, s.service_id, s.name AS service_name, p.comune,
       CASE WHEN o_orderkey % 2 = 0 THEN p.email ELSE upper(p.email) END AS requester_email,
       o_orderpriority AS message, lower(o_orderstatus) AS status, o_orderdate AS created_at
FROM orders JOIN providers p ON p.provider_id = o_custkey
JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) JOIN services s ON s.name = p_name
"""

VIEWS["request_recipients"] = """
SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS provider_id, l_linestatus AS status FROM lineitem
"""

VIEWS["reviews"] = """
SELECT doc_id AS review_id, doc_id % (SELECT count(*) FROM customer) AS provider_id, source,
       CAST(1 + doc_id % 5 AS INT) AS rating, text, lang AS language, doc_id % 400 AS published_day FROM documents
"""

VIEWS["review_summaries"] = """
SELECT provider_id, source, count(*) AS review_count, round(avg(CAST(rating AS DOUBLE)), 2) AS rating_avg
FROM reviews GROUP BY provider_id, source
"""

VIEWS["listings"] = """
SELECT provider_id AS listing_id,
       CASE WHEN provider_id % 4 = 1 THEN concat('Studio ', full_name) WHEN provider_id % 4 = 2 THEN upper(full_name) ELSE full_name END AS name,
       comune AS city, CASE WHEN provider_id % 5 = 2 THEN NULL ELSE concat('+39 ', phone) END AS phone,
       lat + 0.002 AS lat, lng - 0.002 AS lng, concat('http://p', CAST(provider_id AS STRING), '.example.org') AS website
FROM providers WHERE provider_id % 6 <> 0
"""

VIEWS["provider_events"] = """
SELECT event_id, ts, user_id AS session_id, (user_id * 7 + event_id) % (SELECT count(*) FROM customer) AS provider_id,
       CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'phone_click' WHEN 'purchase' THEN 'quote_request' WHEN 'signup' THEN 'claim_click' ELSE 'other' END AS event_type
FROM events
"""

# One enrichment attempt per order: which source was asked about which provider, when, how it ended.
VIEWS["observations"] = """
SELECT o_orderkey AS observation_id, o_custkey AS provider_id,
       CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE concat('source', substr(o_orderpriority, 1, 1)) END AS source,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'empty' ELSE 'error' END AS status,
       o_orderdate AS created_at
FROM orders
"""

# Services bought one after the other in equal quantity.
VIEWS["service_relations"] = """
SELECT sa.service_id, sb.service_id AS related_id, 'next_step' AS relation_type, CAST(count(*) AS INT) AS weight
FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND b.l_quantity = a.l_quantity
JOIN part pa ON pa.p_partkey = a.l_partkey JOIN services sa ON sa.name = pa.p_name
JOIN part pb ON pb.p_partkey = b.l_partkey JOIN services sb ON sb.name = pb.p_name
WHERE sa.service_id <> sb.service_id
GROUP BY sa.service_id, sb.service_id
"""

# Further wordings under which a service may be asked for.
VIEWS["search_terms"] = """
SELECT service_id, term, term_type, max(weight) AS weight FROM (
  SELECT s.service_id, concat(lower(p_type), ' ', p_name) AS term,
         CASE WHEN p_size % 3 = 0 THEN 'intent' WHEN p_size % 3 = 1 THEN 'alias' ELSE 'boost' END AS term_type, p_size AS weight
  FROM part JOIN services s ON s.name = p_name
  UNION ALL
  SELECT s.service_id, lower(p_type) AS term, 'alias' AS term_type, p_size AS weight
  FROM part JOIN services s ON s.name = p_name WHERE p_size > 48
) t GROUP BY service_id, term, term_type
"""

# What visitors typed: exact names, cut words, swapped letters, prefixed names, whole sentences, single words.
VIEWS["typed_queries"] = """
SELECT CASE p_partkey % 6
         WHEN 0 THEN upper(p_name)
         WHEN 1 THEN substr(p_name, 1, 6)
         WHEN 2 THEN concat(substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1), substr(p_name, 5))
         WHEN 3 THEN concat(lower(p_type), '  ', p_name, '!')
         WHEN 4 THEN concat('vorrei ', p_name, ' per la casa')
         ELSE concat(substr(lower(p_type), 1, 3), substr(lower(p_type), 5)) END AS query
FROM part
"""

# The same and everything users wrote in conversations, with how often each was asked.
VIEWS["search_queries"] = """
SELECT query, count(*) AS asked FROM (
  SELECT query FROM typed_queries UNION ALL SELECT text AS query FROM conversations WHERE role = 'user'
) q GROUP BY query
"""

# Form submissions and the providers ticked in them, one row per tick in form order.
VIEWS["submissions"] = """
SELECT o_orderkey AS submission_id, concat(' ', p.email) AS email, s.slug AS service_slug, upper(p.comune) AS comune,
       o_orderpriority AS message, o_orderdate AS created_at
FROM orders JOIN providers p ON p.provider_id = o_custkey
JOIN part ON p_partkey = o_custkey % (SELECT count(*) FROM part) JOIN services s ON s.name = p_name
"""

VIEWS["submission_targets"] = """
SELECT l_orderkey AS submission_id, l_linenumber AS pos,
       (o_custkey * 13 + l_linenumber % 5) % (SELECT count(*) FROM customer) AS provider_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
"""

VIEWS["client_properties"] = """
SELECT l_orderkey * 10 + l_linenumber AS property_id, upper(p.email) AS owner_email,
       concat('Immobile ', CAST(l_linenumber AS STRING)) AS nickname, p.comune,
       CASE WHEN max(l_linestatus) = 'O' THEN CAST(max(l_suppkey) AS STRING) ELSE NULL END AS foglio,
       CAST(max(l_partkey) AS STRING) AS particella,
       CASE WHEN max(l_returnflag) = 'R' THEN 'A/2' ELSE NULL END AS categoria,
       concat(CAST(CAST(floor(max(l_quantity)) AS INT) AS STRING), ',5') AS rendita,
       CASE WHEN max(l_returnflag) = 'A' THEN 'archived' ELSE 'active' END AS status,
       max(l_linestatus) = 'O' AS shareable
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN providers p ON p.provider_id = o_custkey
GROUP BY l_orderkey, l_linenumber, p.email, p.comune
"""

VIEWS["claims"] = """
SELECT event_id AS claim_id, provider_id, concat('user', CAST(session_id AS STRING), '@example.org') AS email, ts AS created_at,
       CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status
FROM provider_events WHERE event_type = 'claim_click'
"""

VIEWS["provider_accounts"] = """
SELECT concat(lower(s_name), '@example.org') AS email, s_acctbal > 5000 AS google,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey % 300 AS INT) END AS last_login_at,
       TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey % 200 AS INT) AS created_at
FROM supplier
"""

VIEWS["client_accounts"] = """
SELECT concat(lower(c_name), '@example.org') AS email, c_acctbal > 5000 AS google,
       max(o_orderdate) AS last_login_at, TIMESTAMP '2023-06-01 00:00:00' AS created_at
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_name, c_acctbal
"""

# Providers with the figures ranking uses; the reference form of directory.directory_rows.
VIEWS["ranked_rows"] = """
SELECT p.*, coalesce(sc.n, 0) AS services_count, rs.rating_avg, coalesce(rs.review_count, 0) AS review_count
FROM providers p
LEFT JOIN (SELECT provider_id, count(*) AS n FROM provider_services GROUP BY provider_id) sc ON sc.provider_id = p.provider_id
LEFT JOIN (SELECT * FROM (SELECT provider_id, rating_avg, review_count,
             row_number() OVER (PARTITION BY provider_id ORDER BY review_count DESC, rating_avg DESC, source) AS rn
           FROM review_summaries) t WHERE rn = 1) rs ON rs.provider_id = p.provider_id
WHERE p.status = 'published'
"""

# Where site visitors stand.
VIEWS["visitors"] = """
SELECT DISTINCT CAST(session_id AS STRING) AS point_id, 36 + CAST(session_id * 31 % 1100 AS DOUBLE) / 100 AS lat,
       7 + CAST(session_id * 17 % 1100 AS DOUBLE) / 100 AS lng
FROM provider_events
"""

# Cities asked for: as slugs with automatic radius, second pages of a fixed radius, names that are only
# districts, towns without providers that only the gazetteer knows, and the first and third kind by somebody who
# says where they are.
VIEWS["location_requests"] = """
SELECT comune, CAST(radius_km AS INT) AS radius_km, CAST(page AS INT) AS page, CAST(near_lat AS DOUBLE) AS near_lat, CAST(near_lat - 30 AS DOUBLE) AS near_lng FROM (
  SELECT DISTINCT replace(comune, ' ', '-') AS comune, NULL AS radius_km, 1 AS page, NULL AS near_lat FROM requests
  UNION ALL SELECT DISTINCT comune, 20 AS radius_km, 2 AS page, NULL AS near_lat FROM requests
  UNION ALL SELECT n_name AS comune, NULL AS radius_km, 1 AS page, NULL AS near_lat FROM nation
  UNION ALL SELECT concat('Town ', n_name) AS comune, NULL AS radius_km, 1 AS page, NULL AS near_lat FROM nation
  UNION ALL SELECT DISTINCT comune, NULL AS radius_km, 1 AS page, 41.5 AS near_lat FROM requests WHERE comune LIKE '%C1'
  UNION ALL SELECT n_name AS comune, NULL AS radius_km, 1 AS page, 42.5 AS near_lat FROM nation
) t
"""

VIEWS["gazetteer"] = """
SELECT concat('town ', lower(n_name)) AS city_key, 36.05 + CAST(n_nationkey AS DOUBLE) * 2 / 5 AS center_lat,
       7.3 + CAST(n_nationkey * 7 % 25 AS DOUBLE) * 2 / 5 AS center_lng
FROM nation
"""

# Where Spark takes the joins of a view in another order, for the same rows: with the clients found for the orders first,
# all that follows is dealt by the order already.
_ORDERED = {"client_properties": (
    "FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN providers p ON p.provider_id = o_custkey",
    "FROM lineitem JOIN (SELECT o_orderkey, email, comune FROM orders JOIN providers ON provider_id = o_custkey) p ON p.o_orderkey = l_orderkey",
)}

_WORD = re.compile(r"[a-z_]+")


def needed_views(sql: str) -> list[str]:
    """Views named in the text and those they rest on, in definition order."""
    wanted: set[str] = set()
    queue = [sql]
    while queue:
        for word in set(_WORD.findall(queue.pop())) & VIEWS.keys():
            if word not in wanted:
                wanted.add(word)
                queue.append(VIEWS[word])
    return [name for name in VIEWS if name in wanted]


def oracle(sql: str) -> str:
    """Prefix a SELECT with the views it needs."""
    views = needed_views(sql)
    if not views:
        return sql
    clause = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in views)
    return f"WITH {clause}\nSELECT * FROM (\n{sql.strip()}\n) AS answer"


class Domain:
    """Raw tables and domain views of one data folder, as attributes. Each is set up once per instance."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder
        self._ready: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        return self._prepare(name)

    def _prepare(self, name: str) -> DataFrame:
        if name not in self._ready:
            if name in TABLES:
                df = read_table(self.spark, self.folder, name)
            else:
                for word in sorted(set(_WORD.findall(VIEWS[name])) & (VIEWS.keys() | set(TABLES))):
                    if word != name:
                        self._prepare(word)
                df = self.spark.sql(VIEWS[name].replace(*_ORDERED[name]) if name in _ORDERED else VIEWS[name])
            df.createOrReplaceTempView(name)
            self._ready[name] = df
        return self._ready[name]

    def sql(self, text: str) -> DataFrame:
        """SQL over tables and views; analysed at once, so a later folder may reuse the view names."""
        for word in set(_WORD.findall(text)) & (VIEWS.keys() | set(TABLES)):
            self._prepare(word)
        return self.spark.sql(text)
