"""Directory search, ranking and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..operators import directory, filters, geojoin, ranking, taxonomy
from ..operators.skew import place_in_group
from .registry import query


def hav(a, b, c, d):
    """Great-circle kilometres in SQL, to the millimetre."""
    h = (f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) "
         f"* sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))")
    return f"round(12742 * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0))), 6)"


SCORE = """round(CASE WHEN review_count > 0 THEN coalesce(rating_avg, 0) * log10(1 + review_count) * 12 ELSE 0 END
  + services_count * 6 + CASE WHEN {km} IS NULL THEN -20 ELSE greatest(0, 45 - {km}) END, 6)"""


def figures(d):
    return directory.provider_figures(d.provider_services, d.review_summaries)


def rows(d):
    return directory.directory_rows(d.providers, d.provider_services, d.review_summaries)


@query("published", "SELECT provider_id, full_name FROM providers WHERE status = 'published'")
def _(d):
    return filters.published(d.providers).select("provider_id", "full_name")


@query("read_table", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def _(d):
    from ..sources.tables import read_table

    return read_table(
        d.spark, d.folder, "customer", ["c_custkey", "c_name"], "c_acctbal > 5000",
        "c_custkey bigint, c_name string, c_acctbal double",
    )


@query(
    "ilike_search",
    "SELECT provider_id, full_name, comune FROM providers WHERE full_name ILIKE '%BUILDING%' OR comune ILIKE '%BUILDING%'",
)
def _(d):
    return filters.ilike_search(d.providers, " buildIng ", ["full_name", "comune"]).select("provider_id", "full_name", "comune")


# What many visitors look for: parts of names, of cities, single letters, nothing, words no provider has.
_TERMS = """SELECT p_partkey AS request_id, CASE p_partkey % 7 WHEN 0 THEN ' Building ' WHEN 1 THEN concat('#', CAST(p_partkey AS STRING)) WHEN 2 THEN concat('nation_', CAST(p_partkey % 30 AS STRING))
    WHEN 3 THEN '7' WHEN 4 THEN ' ' WHEN 5 THEN CASE WHEN p_partkey % 3 = 0 THEN concat('via ', CAST(p_partkey % 7 AS STRING)) WHEN p_partkey % 3 = 1 THEN concat('machinery ', CAST(p_partkey % 90 AS STRING)) ELSE p_name END ELSE concat('0', CAST(p_partkey % 100 AS STRING)) END AS term,
  CASE p_partkey % 5 WHEN 0 THEN 'Nation_3' WHEN 1 THEN concat('nation_', CAST(p_partkey % 25 AS STRING), '-c1') ELSE '' END AS city,
  CASE WHEN p_partkey % 2 = 0 THEN 'red-ring' END AS service FROM part"""


@query(
    "search_texts",
    f"""SELECT t.request_id, p.provider_id FROM ({_TERMS}) t JOIN providers p ON trim(t.term) <> '' AND (contains(lower(p.full_name), lower(trim(t.term))) OR contains(lower(p.comune), lower(trim(t.term))))""",
)
def _(d):
    return filters.search_texts(d.sql(_TERMS), d.providers, "provider_id", ["full_name", "comune"])


@query(
    "search_joined_texts",
    f"""SELECT t.request_id, q.provider_id FROM ({_TERMS}) t JOIN providers q ON trim(t.term) <> '' AND contains(lower(concat_ws(' ', q.full_name, q.comune, q.phone)), lower(trim(t.term)))""",
)
def _(d):
    return filters.search_texts(d.sql(_TERMS), d.providers, "provider_id", ["full_name", "comune", "phone"], joined=True)


@query(
    "claimable_searches",
    f"""SELECT request_id, provider_id, place FROM (SELECT t.request_id, p.provider_id, row_number() OVER (PARTITION BY t.request_id
            ORDER BY is_official, CASE WHEN lower(full_name) = lower(trim(t.term)) THEN 0 ELSE 1 END, full_name, provider_id) AS place
          FROM ({_TERMS}) t JOIN providers p ON p.status = 'published' AND length(trim(t.term)) >= 2 AND (contains(lower(p.full_name), lower(trim(t.term))) OR contains(lower(p.comune), lower(trim(t.term))))) x
        WHERE place <= 12""",
)
def _(d):
    owned = d.providers.withColumn("owner_email", F.when(F.col("is_official"), F.col("email")))
    return filters.claimable_searches(d.sql(_TERMS), owned)


@query(
    "searches_by_name",
    f"""WITH t AS (SELECT request_id, lower(trim(term)) AS term, lower(trim(replace(city, '-', ' '))) AS city, service FROM ({_TERMS}) x),
          m AS (SELECT ps.provider_id, min(CASE s.slug WHEN 'red-ring' THEN 'exact' ELSE 'related' END) AS match_kind
            FROM provider_services ps JOIN services s ON s.service_id = ps.service_id WHERE s.slug IN ('red-ring', 'red-bolt') GROUP BY ps.provider_id)
        SELECT request_id, provider_id, match_kind, place FROM (
          SELECT t.request_id, p.provider_id, m.match_kind, row_number() OVER (PARTITION BY t.request_id ORDER BY CASE m.match_kind WHEN 'exact' THEN 0 WHEN 'related' THEN 1 ELSE 2 END,
              CASE WHEN t.city = '' OR lower(p.comune) = t.city THEN 0 ELSE 1 END, CASE WHEN t.city = '' OR contains(lower(p.comune), t.city) THEN 0 ELSE 1 END,
              CASE WHEN p.lat IS NULL THEN 1 ELSE 0 END, p.full_name, p.provider_id) AS place
          FROM t JOIN providers p ON p.status = 'published' AND (contains(lower(p.full_name), t.term) OR contains(lower(p.comune), t.term) OR contains(lower(coalesce(p.address, '')), t.term))
            AND (contains(lower(p.comune), t.city) OR contains(lower(p.district), t.city))
          LEFT JOIN m ON m.provider_id = p.provider_id AND t.service = 'red-ring') y WHERE place <= 12""",
)
def _(d):
    wanted = d.services.filter("slug IN ('red-ring', 'red-bolt')").select(
        F.lit("red-ring").alias("service"), "service_id", F.when(F.col("slug") == "red-ring", "exact").otherwise("related").alias("match_kind"))
    return directory.searches_by_name(d.sql(_TERMS), d.providers, d.provider_services, wanted)


@query(
    "ci_equals",
    "SELECT r.request_id, p.provider_id FROM requests r JOIN providers p ON lower(r.requester_email) = lower(p.email)",
)
def _(d):
    requests = d.requests.select("request_id", filters.ci_key(F.col("requester_email")).alias("email_key"))
    providers = d.providers.select("provider_id", filters.ci_key(F.col("email")).alias("email_key"))
    return requests.join(providers, "email_key").select("request_id", "provider_id")


@query(
    "blank_to_null",
    "SELECT provider_id, CASE WHEN website IS NULL OR provider_id % 2 = 0 THEN NULL ELSE website END AS website FROM providers",
)
def _(d):
    raw = F.when(F.col("provider_id") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "website"))
    return d.providers.select("provider_id", blank_to_null(raw).alias("website"))


@query(
    "filter_any_column",
    """SELECT request_id, 'hit' AS kind FROM requests WHERE contains(lower(concat_ws(' ', service_name, comune, message)), 'urgent')
       UNION ALL SELECT request_id, 'all' AS kind FROM requests""",
)
def _(d):
    columns = ["service_name", "comune", "message"]
    hit = filters.filter_any_column(d.requests, "URGENT", columns)
    everything = filters.filter_any_column(d.requests, "no such words", columns, keep_all_if_none=True)
    return hit.select("request_id", F.lit("hit").alias("kind")).unionByName(
        everything.select("request_id", F.lit("all").alias("kind"))
    )


_CHECKED = """SELECT p.provider_id, max(o.created_at) AS checked_at FROM providers p
  LEFT JOIN observations o ON o.provider_id = p.provider_id AND o.source = 'source5' WHERE p.status = 'published' GROUP BY p.provider_id"""


@query(
    "stale_rows",
    f"""SELECT * FROM ({_CHECKED}) t WHERE checked_at IS NULL OR checked_at < TIMESTAMP '2000-06-01 00:00:00' - INTERVAL 30 DAY
        ORDER BY checked_at ASC NULLS FIRST, provider_id LIMIT 200""",
)
def _(d):
    return filters.stale_rows(
        d.sql(_CHECKED), "checked_at", F.lit("2000-06-01 00:00:00").cast("timestamp_ntz"), 30, 200, "provider_id"
    )


@query(
    "needs_geocode",
    """SELECT provider_id FROM providers p WHERE status = 'published' AND lat IS NULL AND NOT EXISTS (
         SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.source = 'source2' AND o.status IN ('completed', 'empty'))""",
)
def _(d):
    providers = d.providers.withColumn("address", F.concat(F.lit("Via "), "comune"))
    return filters.needs_geocode(providers, d.observations, "source2").select("provider_id")


@query(
    "needs_enrichment",
    """SELECT provider_id, comune FROM providers p WHERE status = 'published' AND NOT EXISTS (
         SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.source = 'source3')
       ORDER BY CASE lower(comune) WHEN 'nation_5 c3' THEN 1 WHEN 'nation_1 c1' THEN 2 ELSE 3 END, full_name, provider_id LIMIT 50 OFFSET 5""",
)
def _(d):
    todo = filters.needs_enrichment(d.providers, d.observations, "source3", ["NATION_5 C3", "NATION_1 C1"], 5, 50)
    return todo.select("provider_id", "comune")


@query(
    "exists_semi",
    """SELECT listing_id FROM listings l WHERE EXISTS (SELECT 1 FROM providers p WHERE p.provider_id <> l.listing_id
         AND p.comune = l.city AND p.is_official)""",
)
def _(d):
    # Another provider in the same place: true unless the only official one there is the row itself. The
    # place is summed up first, so a comune of any size adds one row to the join.
    places = d.providers.filter("is_official").groupBy(F.col("comune").alias("city")).agg(
        F.min("provider_id").alias("_low"), F.max("provider_id").alias("_high")
    )
    other = (F.col("_low") != F.col("listing_id")) | (F.col("_high") != F.col("listing_id"))
    return d.listings.join(places, "city").filter(other).select("listing_id")


@query(
    "not_exists_anti",
    "SELECT provider_id FROM providers p WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.status = 'error')",
)
def _(d):
    return d.providers.join(
        d.observations.filter("status = 'error'").select("provider_id"), "provider_id", "left_anti"
    ).select("provider_id")


@query(
    "content_gap",
    """SELECT doc_id, len(trim(text)) AS chars, len(trim(text)) > 200 AS has_text, len(trim(text)) < 200 AS gap FROM documents""",
)
def _(d):
    return filters.content_gap(d.documents, "text").select("doc_id", "chars", "has_text", "gap")


@query(
    "content_validate",
    r"""SELECT doc_id, good_faqs, CASE WHEN len(trim(text)) < 2500 THEN 'body too short' WHEN good_faqs < 5 THEN 'too few questions' ELSE 'ok' END AS verdict
        FROM (SELECT doc_id, text, CAST(len(list_filter(string_split(text, chr(10))[1:6], lambda l: len(trim(substr(l, 1, 40))) >= 12 AND len(trim(l)) >= 80)) AS BIGINT) AS good_faqs
              FROM documents) t""",
)
def _(d):
    lines = F.split("text", "\n")
    faqs = F.concat(
        F.lit("```json\n"),
        F.to_json(F.struct(F.transform(
            lines, lambda l: F.struct(l.substr(1, 40).alias("question"), l.alias("answer"))).alias("faqs"))),
        F.lit("\n```"),
    )
    checked = filters.content_validate(d.documents.withColumn("faqs_json", faqs), "text", "faqs_json")
    return checked.select("doc_id", "good_faqs", "verdict")


@query(
    "claimable_search",
    """SELECT provider_id, full_name FROM providers WHERE status = 'published' AND (full_name ILIKE '%nation_1%' OR comune ILIKE '%nation_1%')
       ORDER BY is_official, full_name, provider_id LIMIT 40""",
)
def _(d):
    owned = d.providers.withColumn("owner_email", F.when(F.col("is_official"), F.col("email")))
    return filters.claimable_search(owned, " nation_1", 40).select("provider_id", "full_name")


_URLS = """SELECT p.provider_id, p.full_name, c.cand_id, concat('https://dir.example.org/', lower(c.cand_name)) AS url, c.cand_id AS pos
  FROM providers p JOIN (SELECT provider_id AS cand_id, replace(full_name, ' ', '-') AS cand_name, comune FROM providers) c
    ON c.comune = p.comune AND left(right(c.cand_name, 9), 6) = left(right(p.full_name, 9), 6)"""


@query(
    "shortlist_by_name",
    f"""SELECT provider_id, cand_id, hits, place FROM (
          SELECT *, max(hits) OVER (PARTITION BY provider_id) AS top,
                 row_number() OVER (PARTITION BY provider_id ORDER BY hits DESC, pos, url) AS place FROM (
            SELECT provider_id, cand_id, url, pos, CAST(len(list_filter(regexp_extract_all(lower(full_name), '[a-z]+'), lambda t: len(t) >= 4 AND contains(url, t))) AS BIGINT) AS hits
            FROM ({_URLS}) u) v) w
        WHERE (top > 0 AND hits > 0 AND place <= 8) OR (top = 0 AND place <= 3)""",
)
def _(d):
    return filters.shortlist_by_name(d.sql(_URLS), "full_name", "url", ["provider_id"], "pos").select(
        "provider_id", "cand_id", "hits", "place"
    )


@query(
    "services_count",
    """SELECT p.provider_id, coalesce(n, 0) AS services_count FROM providers p LEFT JOIN (
         SELECT provider_id, count(*) AS n FROM provider_services GROUP BY provider_id) s ON s.provider_id = p.provider_id""",
)
def _(d):
    return directory.services_count(d.providers, d.provider_services).select("provider_id", "services_count")


@query(
    "best_review_summary",
    """SELECT provider_id, source, review_count, rating_avg FROM (SELECT *, row_number() OVER (PARTITION BY provider_id
         ORDER BY review_count DESC, rating_avg DESC, source) AS rn FROM review_summaries) t WHERE rn = 1""",
)
def _(d):
    return directory.best_review_summary(d.review_summaries)


@query(
    "latest_reviews",
    """SELECT provider_id, review_id, place FROM (SELECT provider_id, review_id, row_number() OVER (PARTITION BY provider_id
         ORDER BY published_day DESC, review_id) AS place FROM reviews WHERE trim(text) <> '') t WHERE place <= 3""",
)
def _(d):
    from ..operators.reviews import latest_reviews

    return latest_reviews(d.reviews, 3).select("provider_id", "review_id", "place")


@query(
    "best_service_match",
    """SELECT provider_id, service_id, match_kind, confidence FROM (
         SELECT ps.provider_id, ps.service_id, w.match_kind, ps.confidence, row_number() OVER (PARTITION BY ps.provider_id
           ORDER BY CASE w.match_kind WHEN 'exact' THEN 0 ELSE 1 END, ps.confidence DESC NULLS LAST, ps.service_id, ps.source) AS rn
         FROM provider_services ps JOIN (SELECT service_id, CASE WHEN slug = 'red-ring' THEN 'exact' ELSE 'related' END AS match_kind
           FROM services WHERE slug LIKE '%-ring') w ON w.service_id = ps.service_id) t WHERE rn = 1""",
)
def _(d):
    wanted = d.services.filter("slug LIKE '%-ring'").select(
        "service_id", F.when(F.col("slug") == "red-ring", "exact").otherwise("related").alias("match_kind")
    )
    return directory.best_service_match(d.provider_services, wanted).select("provider_id", "service_id", "match_kind", "confidence")


@query(
    "search_by_name",
    """SELECT provider_id, match_kind FROM (
         SELECT p.provider_id, m.match_kind, row_number() OVER (ORDER BY CASE m.match_kind WHEN 'exact' THEN 0 WHEN 'related' THEN 1 ELSE 2 END,
             CASE WHEN lower(comune) = 'nation_3' THEN 0 ELSE 1 END, CASE WHEN contains(lower(comune), 'nation_3') THEN 0 ELSE 1 END,
             CASE WHEN lat IS NULL THEN 1 ELSE 0 END, full_name, p.provider_id) AS rn
         FROM providers p LEFT JOIN (
           SELECT ps.provider_id, min(CASE s.slug WHEN 'red-ring' THEN 'exact' ELSE 'related' END) AS match_kind
           FROM provider_services ps JOIN services s ON s.service_id = ps.service_id WHERE s.slug IN ('red-ring', 'red-bolt') GROUP BY ps.provider_id) m
           ON m.provider_id = p.provider_id
         WHERE status = 'published' AND (full_name ILIKE '%household%' OR address ILIKE '%household%') AND (comune ILIKE '%nation\\_3%' ESCAPE '\\' OR district ILIKE '%nation\\_3%' ESCAPE '\\')) t
       WHERE rn <= 20""",
)
def _(d):
    wanted = d.services.filter("slug IN ('red-ring', 'red-bolt')").select(
        "service_id", F.when(F.col("slug") == "red-ring", "exact").otherwise("related").alias("match_kind")
    )
    found = directory.search_by_name(d.providers, d.provider_services, wanted, "household", "nation_3", 20)
    return found.select("provider_id", "match_kind")


@query(
    "centroid",
    """SELECT lower(comune) AS city_key, round(avg(lat), 9) AS center_lat, round(avg(lng), 9) AS center_lng, count(*) AS located
       FROM providers WHERE status = 'published' AND lat IS NOT NULL GROUP BY lower(comune)""",
)
def _(d):
    return directory.centroid(d.providers).withColumn("center_lat", F.round("center_lat", 9)).withColumn(
        "center_lng", F.round("center_lng", 9)
    )


_NEAR = f"""SELECT v.point_id, p.provider_id, {hav('v.lat', 'v.lng', 'p.lat', 'p.lng')} AS distance_km, p.full_name
  FROM visitors v JOIN providers p ON p.status = 'published' AND p.lat IS NOT NULL AND abs(p.lat - v.lat) < 0.6"""


@query(
    "geo_radius_join",
    f"""SELECT point_id, provider_id, distance_km, place FROM (SELECT *, row_number() OVER (PARTITION BY point_id
          ORDER BY distance_km, full_name, provider_id) AS place FROM ({_NEAR}) t WHERE distance_km <= 50) u""",
)
def _(d):
    places = directory._places(filters.published(d.providers))
    near = geojoin.places_around(d.visitors, places, 50.0, ["full_name", "provider_id"], ["provider_id"])
    return near.select("point_id", "provider_id", "distance_km", "place")


@query(
    "knn_join",
    f"""SELECT provider_id, neighbour_id, distance_km, place FROM (
          SELECT a.provider_id, b.provider_id AS neighbour_id, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS distance_km,
                 row_number() OVER (PARTITION BY a.provider_id ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.full_name, b.provider_id) AS place
          FROM providers a JOIN providers b ON a.provider_id <> b.provider_id
          WHERE a.status = 'published' AND b.status = 'published' AND a.lat IS NOT NULL AND b.lat IS NOT NULL) t WHERE place <= 6""",
)
def _(d):
    return geojoin.neighbours(filters.published(d.providers), 6)


@query(
    "nearby_with_fallback",
    f"""SELECT provider_id, neighbour_id, tier, place FROM (
          SELECT a.provider_id, b.provider_id AS neighbour_id, 'geo' AS tier,
                 row_number() OVER (PARTITION BY a.provider_id ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.full_name, b.provider_id) AS place
          FROM providers a JOIN providers b ON a.provider_id <> b.provider_id
          WHERE a.status = 'published' AND b.status = 'published' AND a.lat IS NOT NULL AND b.lat IS NOT NULL
          UNION ALL
          SELECT a.provider_id, b.provider_id AS neighbour_id, 'comune' AS tier,
                 row_number() OVER (PARTITION BY a.provider_id ORDER BY CASE WHEN b.lat IS NULL THEN 1 ELSE 0 END, b.full_name, b.provider_id) AS place
          FROM providers a JOIN providers b ON a.provider_id <> b.provider_id AND a.comune = b.comune
          WHERE a.status = 'published' AND b.status = 'published' AND a.lat IS NULL
          UNION ALL
          SELECT a.provider_id, b.provider_id AS neighbour_id, 'distretto' AS tier,
                 row_number() OVER (PARTITION BY a.provider_id ORDER BY CASE WHEN b.lat IS NULL THEN 1 ELSE 0 END, b.full_name, b.provider_id) AS place
          FROM providers a JOIN providers b ON a.provider_id <> b.provider_id AND contains(b.district, a.district)
          WHERE a.status = 'published' AND b.status = 'published' AND a.lat IS NULL
            AND NOT EXISTS (SELECT 1 FROM providers c WHERE c.comune = a.comune AND c.provider_id <> a.provider_id AND c.status = 'published')
        ) t WHERE place <= 6""",
)
def _(d):
    return directory.nearby_with_fallback(d.providers, 6).select("provider_id", "neighbour_id", "tier", "place")


@query(
    "relevance_score",
    f"""SELECT provider_id, km, {SCORE.format(km='km')} AS score FROM (
          SELECT *, {hav('41.9', '12.5', 'lat', 'lng')} AS km FROM ranked_rows) t""",
)
def _(d):
    from ..functions.geo import distance_km

    km = distance_km(F.lit(41.9), F.lit(12.5), F.col("lat"), F.col("lng"))
    scored = rows(d).withColumn("km", km)
    return scored.select(
        "provider_id", "km",
        ranking.relevance_score(F.col("rating_avg"), F.col("review_count"), F.col("services_count"), F.col("km")).alias("score"),
    )


_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY district ORDER BY relevance_score DESC, distance_km ASC NULLS LAST, full_name, provider_id) AS place
  FROM (SELECT *, {SCORE.format(km='distance_km')} AS relevance_score FROM (
    SELECT *, {hav('41.9', '12.5', 'lat', 'lng')} AS distance_km FROM ranked_rows) t) u"""


def _scored(d):
    from ..functions.geo import distance_km

    return directory._with_score(
        rows(d).withColumn("distance_km", distance_km(F.lit(41.9), F.lit(12.5), F.col("lat"), F.col("lng")))
    )


@query("rank_by_relevance", f"SELECT district, provider_id, relevance_score, place FROM ({_RANKED}) r WHERE place <= 10")
def _(d):
    return ranking.rank_by_relevance(_scored(d), ["district"], 10).select("district", "provider_id", "relevance_score", "place")


@query(
    "paginate",
    f"""SELECT district, provider_id, place, total, total_pages, page FROM (
          SELECT *, least(3, total_pages) AS page FROM (SELECT *, greatest(1, CAST(ceil(total / 15.0) AS BIGINT)) AS total_pages FROM (
            SELECT *, count(*) OVER (PARTITION BY district) AS total FROM ({_RANKED}) r) s) t) u
        WHERE place > (page - 1) * 15 AND place <= page * 15""",
)
def _(d):
    return ranking.paginate(_scored(d), ["district"], ranking.by_relevance(), 3).select(
        "district", "provider_id", "place", "total", "total_pages", "page"
    )


@query(
    "search_near_me",
    f"""SELECT point_id, provider_id, distance_km, relevance_score, place, total FROM (
          SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY relevance_score DESC, distance_km, full_name, provider_id) AS place,
                 count(*) OVER (PARTITION BY point_id) AS total FROM (
            SELECT n.point_id, n.provider_id, n.distance_km, n.full_name, {SCORE.format(km='n.distance_km')} AS relevance_score
            FROM ({_NEAR}) n JOIN ranked_rows r ON r.provider_id = n.provider_id WHERE n.distance_km <= 30) u) v
        WHERE place <= 15""",
)
def _(d):
    return directory.search_near_me(d.visitors, d.providers, figures(d), 30).select(
        "point_id", "provider_id", "distance_km", "relevance_score", "place", "total"
    )


SEARCH_LOCATION = f"""
WITH k AS (SELECT DISTINCT lower(trim(replace(comune, '-', ' '))) AS city_key, radius_km AS asked_km, page AS asked_page, near_lat, near_lng,
    concat_ws('|', lower(trim(replace(comune, '-', ' '))), coalesce(CAST(radius_km AS STRING), ''), coalesce(CAST(near_lat AS STRING), '')) AS sid FROM location_requests),
exact AS (SELECT lower(comune) AS city_key, * FROM ranked_rows WHERE lower(comune) IN (SELECT city_key FROM k)),
s AS (SELECT *, CASE WHEN asked_km IS NULL AND n >= 8 THEN 'comune' WHEN clat IS NULL THEN 'distretto' ELSE 'raggio' END AS mode FROM (
  SELECT k2.*, coalesce(e.n, 0) AS n, coalesce(e.clat, g.center_lat) AS clat, coalesce(e.clng, g.center_lng) AS clng
  FROM (SELECT DISTINCT sid, city_key, asked_km, near_lat, near_lng FROM k) k2
  LEFT JOIN (SELECT city_key, count(*) AS n, avg(lat) AS clat, avg(lng) AS clng FROM exact GROUP BY city_key) e ON e.city_key = k2.city_key
  LEFT JOIN gazetteer g ON g.city_key = k2.city_key) b),
others AS (SELECT * FROM (SELECT s.sid, s.asked_km, r.provider_id, {hav('s.clat', 's.clng', 'r.lat', 'r.lng')} AS km
  FROM s JOIN ranked_rows r ON s.mode = 'raggio' AND r.lat IS NOT NULL AND lower(r.comune) <> s.city_key) a WHERE km <= coalesce(asked_km, 100)),
step AS (SELECT s.sid, s.asked_km, v.st, s.n, count(o.provider_id) AS c FROM s CROSS JOIN (VALUES (10), (20), (30), (50), (100)) v(st)
  LEFT JOIN others o ON o.sid = s.sid AND o.km <= v.st WHERE s.mode = 'raggio' GROUP BY s.sid, s.asked_km, v.st, s.n),
radius AS (SELECT sid, CAST(coalesce(asked_km, min(CASE WHEN n + c >= CASE WHEN n = 0 THEN 1 ELSE 12 END THEN st END), 100) AS INT) AS radius_km FROM step GROUP BY sid, asked_km),
cand AS (
  SELECT s.sid, e.provider_id, CASE WHEN s.mode = 'raggio' THEN 0 END AS km FROM s JOIN exact e ON e.city_key = s.city_key AND s.mode IN ('raggio', 'comune')
  UNION ALL SELECT o.sid, o.provider_id, o.km FROM others o JOIN radius r ON r.sid = o.sid WHERE o.km <= r.radius_km
  UNION ALL SELECT s.sid, r.provider_id, NULL FROM s JOIN ranked_rows r ON s.mode = 'distretto' AND (lower(r.comune) = s.city_key OR contains(lower(r.district), s.city_key))),
shape AS (SELECT c.sid, count(*) AS total, bool_and(lower(r.comune) = s.city_key) AS same FROM cand c JOIN ranked_rows r ON r.provider_id = c.provider_id JOIN s ON s.sid = c.sid GROUP BY c.sid),
away AS (SELECT c.sid, c.provider_id, coalesce(c.km, {hav('coalesce(s.near_lat, s.clat)', 'coalesce(s.near_lng, s.clng)', 'r.lat', 'r.lng')}) AS distance_km
  FROM cand c JOIN s ON s.sid = c.sid JOIN ranked_rows r ON r.provider_id = c.provider_id),
scored AS (SELECT k.city_key, k.sid, k.near_lat, k.asked_page, r.provider_id, r.full_name, c.distance_km, {SCORE.format(km='c.distance_km')} AS relevance_score, sh.total,
    CASE s.mode WHEN 'comune' THEN 'comune' WHEN 'distretto' THEN CASE WHEN sh.total > s.n THEN 'distretto' ELSE 'comune' END
      ELSE CASE WHEN s.n > 0 AND sh.same THEN 'comune' ELSE 'raggio' END END AS scope, rad.radius_km, s.n AS exact_city_count
  FROM k JOIN s ON s.sid = k.sid JOIN away c ON c.sid = k.sid JOIN shape sh ON sh.sid = k.sid LEFT JOIN radius rad ON rad.sid = k.sid
  JOIN ranked_rows r ON r.provider_id = c.provider_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sid, asked_page ORDER BY relevance_score DESC, distance_km ASC NULLS LAST, full_name, provider_id) AS place,
    least(greatest(1, asked_page), greatest(1, CAST(ceil(total / 15.0) AS BIGINT))) AS page FROM scored)
SELECT city_key, near_lat, radius_km, scope, exact_city_count, total, page, place, provider_id, distance_km, relevance_score
FROM numbered WHERE place > (page - 1) * 15 AND place <= page * 15
"""


def located_pages(d):
    return directory.search_location(d.location_requests, d.providers, figures(d), d.gazetteer)


@query("search_location", SEARCH_LOCATION)
def _(d):
    return located_pages(d).select(
        "city_key", "near_lat", "radius_km", "scope", "exact_city_count", "total", "page", "place", "provider_id", "distance_km", "relevance_score"
    )


@query(
    "scope_label",
    f"""SELECT DISTINCT city_key, scope, CASE WHEN scope = 'distretto' THEN 'Pochi risultati nel comune: mostriamo anche studi del distretto notarile.'
          WHEN scope = 'raggio' AND radius_km IS NOT NULL AND exact_city_count <= 0 THEN concat('Nessun notaio a ', city_key, ': abbiamo esteso la ricerca a ', radius_km, ' km.')
          WHEN scope = 'raggio' AND radius_km IS NOT NULL THEN concat('Pochi studi a ', city_key, ': ricerca estesa a ', radius_km, ' km.') ELSE '' END AS note
        FROM ({SEARCH_LOCATION}) q""",
)
def _(d):
    note = directory.scope_note(F.col("city_key"), F.col("scope"), F.col("exact_city_count"), F.col("radius_km"))
    return located_pages(d).select("city_key", "scope", note.alias("note")).distinct()


@query(
    "first_n_map_points",
    f"""SELECT city_key, radius_km, marker, provider_id FROM (SELECT q.city_key, q.radius_km, q.place AS marker, q.provider_id,
            row_number() OVER (PARTITION BY q.city_key, q.near_lat, q.radius_km, q.page ORDER BY q.place) AS rn
          FROM ({SEARCH_LOCATION}) q JOIN providers p ON p.provider_id = q.provider_id
          WHERE p.lat BETWEEN 35 AND 48 AND p.lng BETWEEN 6 AND 19.5) t WHERE rn <= 60""",
)
def _(d):
    return directory.first_n_map_points(located_pages(d), ["search_id", "page"]).select(
        "city_key", "radius_km", "marker", "provider_id"
    )


_GEO = """CASE WHEN p.lat IS NULL THEN '' ELSE concat(',"geo":{"@type":"GeoCoordinates","latitude":', CAST(p.lat AS DOUBLE), ',"longitude":', CAST(p.lng AS DOUBLE), '}') END"""


@query(
    "list_item_jsonld",
    f"""SELECT q.city_key, q.radius_km, concat('{{"@type":"ListItem","position":', q.place, ',"item":{{"@type":["LegalService","LocalBusiness"],"name":"', p.full_name,
          '","url":"https://site.example.org/notai/', p.slug, '","telephone":"+39', p.phone,
          '","address":{{"@type":"PostalAddress","addressLocality":"', p.comune, '","addressCountry":"IT"}}', {_GEO}, '}}}}') AS doc
        FROM ({SEARCH_LOCATION}) q JOIN providers p ON p.provider_id = q.provider_id""",
)
def _(d):
    from ..operators.crawl import list_item_jsonld

    pages = located_pages(d).withColumn("address", F.lit(None).cast("string")).withColumn("cap", F.lit(None).cast("string"))
    return pages.select("city_key", "radius_km", list_item_jsonld("https://site.example.org").alias("doc"))


@query(
    "exact_union_nearby",
    f"""SELECT city_key, provider_id, min(km) AS distance_km FROM (
          SELECT lower(comune) AS city_key, provider_id, 0 AS km FROM providers WHERE status = 'published'
          UNION ALL
          SELECT c.city_key, p.provider_id, {hav('c.lat', 'c.lng', 'p.lat', 'p.lng')} AS km FROM (
            SELECT lower(comune) AS city_key, avg(lat) AS lat, avg(lng) AS lng FROM providers WHERE status = 'published' AND lat IS NOT NULL GROUP BY lower(comune)) c
          JOIN providers p ON p.status = 'published' AND p.lat IS NOT NULL AND {hav('c.lat', 'c.lng', 'p.lat', 'p.lng')} <= 20
            AND lower(p.comune) <> c.city_key) t GROUP BY city_key, provider_id""",
)
def _(d):
    live = filters.published(d.providers)
    exact = live.select(F.lower("comune").alias("city_key"), "provider_id")
    centers = directory.centroid(d.providers).select(
        F.col("city_key").alias("point_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng")
    )
    near = geojoin.within(centers, directory._places(live), F.lit(20.0))
    nearby = near.select(F.col("point_id").alias("city_key"), "provider_id", "distance_km")
    return directory.exact_union_nearby(exact, nearby, ["city_key", "provider_id"])


@query(
    "reverse_city",
    f"""SELECT lat, lng, city_key, distance_km FROM (SELECT *, row_number() OVER (PARTITION BY lat, lng ORDER BY distance_km, city_key) AS rn FROM (
          SELECT v.lat, v.lng, c.city_key, {hav('v.lat', 'v.lng', 'c.clat', 'c.clng')} AS distance_km
          FROM (SELECT DISTINCT round(lat, 2) AS lat, round(lng, 2) AS lng FROM visitors) v CROSS JOIN (
            SELECT lower(comune) AS city_key, avg(lat) AS clat, avg(lng) AS clng FROM providers WHERE status = 'published' AND lat IS NOT NULL GROUP BY lower(comune)) c) t) u
        WHERE rn = 1""",
)
def _(d):
    return directory.reverse_city(d.visitors, directory.centroid(d.providers))


_CITIES = "SELECT DISTINCT district AS province, comune AS name FROM providers WHERE status = 'published'"


@query(
    "search_province",
    """SELECT province, provider_id, place, total, page FROM (SELECT *, least(2, greatest(1, CAST(ceil(total / 36.0) AS BIGINT))) AS page FROM (
         SELECT district AS province, provider_id, row_number() OVER (PARTITION BY district ORDER BY full_name, provider_id) AS place,
                count(*) OVER (PARTITION BY district) AS total FROM providers WHERE status = 'published') t) u
       WHERE place > (page - 1) * 36 AND place <= page * 36""",
)
def _(d):
    return directory.search_province(d.sql(_CITIES), d.providers, 2).select("province", "provider_id", "place", "total", "page")


@query(
    "enriched_first",
    """SELECT provider_id, is_enriched FROM (SELECT p.provider_id, coalesce(website, '') <> '' AS is_enriched, u.updated_at, full_name,
         row_number() OVER (ORDER BY CASE WHEN coalesce(website, '') <> '' THEN 0 ELSE 1 END, u.updated_at DESC NULLS LAST, full_name, p.provider_id) AS rn
       FROM providers p LEFT JOIN (SELECT provider_id, max(created_at) AS updated_at FROM observations GROUP BY provider_id) u ON u.provider_id = p.provider_id
       WHERE status = 'published') t""",
)
def _(d):
    updated = d.observations.groupBy("provider_id").agg(F.max("created_at").alias("updated_at"))
    rows_ = d.providers.join(updated, "provider_id", "left").withColumn("place_id", F.lit(None).cast("string"))
    return directory.enriched_first(rows_, "updated_at").select("provider_id", "is_enriched")


_LISTS = {
    "located": "SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS provider_id, l_quantity AS distance_km FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1",
    "declared": "SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS provider_id, 'exact' AS match_kind FROM lineitem WHERE l_linestatus = 'O'",
    "selected": "SELECT DISTINCT l_orderkey AS request_id, l_suppkey AS provider_id FROM lineitem WHERE l_linenumber = 2",
}
_MERGED = f"""SELECT coalesce(l.request_id, c.request_id, s.request_id) AS request_id, coalesce(l.provider_id, c.provider_id, s.provider_id) AS provider_id,
    l.distance_km, c.match_kind, s.request_id IS NOT NULL AS selected
  FROM ({_LISTS['located']}) l
  FULL JOIN ({_LISTS['declared']}) c ON c.request_id = l.request_id AND c.provider_id = l.provider_id
  FULL JOIN ({_LISTS['selected']}) s ON s.request_id = coalesce(l.request_id, c.request_id) AND s.provider_id = coalesce(l.provider_id, c.provider_id)
  WHERE l.request_id IS NOT NULL OR s.request_id IS NOT NULL
     OR c.request_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)"""


def merged(d):
    return directory.merge_candidates(d.sql(_LISTS["located"]), d.sql(_LISTS["declared"]), d.sql(_LISTS["selected"]))


@query("merge_candidates", _MERGED)
def _(d):
    return merged(d).select("request_id", "provider_id", "distance_km", "match_kind", "selected")


@query(
    "rank_choices",
    f"""SELECT m.request_id, m.provider_id, row_number() OVER (PARTITION BY m.request_id ORDER BY CASE WHEN selected THEN 0 ELSE 1 END,
            CASE match_kind WHEN 'exact' THEN 0 ELSE 2 END, CASE WHEN p.comune = q.comune THEN 0 ELSE 1 END, coalesce(distance_km, 9999), p.full_name, m.provider_id) AS place,
          selected OR (NOT bool_or(selected) OVER (PARTITION BY m.request_id) AND count(*) OVER (PARTITION BY m.request_id) <= 10) AS ticked
        FROM ({_MERGED}) m JOIN providers p ON p.provider_id = m.provider_id JOIN requests q ON q.request_id = m.request_id""",
)
def _(d):
    known = merged(d).join(d.providers.select("provider_id", "full_name", "comune"), "provider_id").join(
        d.requests.select("request_id", F.col("comune").alias("asked")), "request_id"
    ).withColumn("same_city", F.lower("comune") == F.lower("asked"))
    return directory.rank_choices(known, ["request_id"]).select("request_id", "provider_id", "place", "ticked")


@query(
    "provider_profile",
    f"""SELECT p.provider_id, b.rating_avg, coalesce(sv.list, '') AS services, coalesce(rv.list, '') AS latest_reviews, coalesce(nb.list, '') AS neighbours
        FROM providers p
        LEFT JOIN (SELECT provider_id, rating_avg FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY review_count DESC, rating_avg DESC, source) AS rn
                   FROM review_summaries) t WHERE rn = 1) b ON b.provider_id = p.provider_id
        LEFT JOIN (SELECT provider_id, string_agg(slug, ',' ORDER BY place) AS list FROM (SELECT provider_id, slug, row_number() OVER (PARTITION BY provider_id
                     ORDER BY confidence DESC NULLS LAST, priority, name, service_id) AS place FROM (
                       SELECT ps.provider_id, c.service_id, c.slug, c.name, c.priority, max(ps.confidence) AS confidence FROM provider_services ps
                       JOIN taxonomy t ON t.service_id = ps.service_id JOIN taxonomy c ON c.service_id = coalesce(t.canonical_id, t.service_id)
                       WHERE c.is_searchable GROUP BY ps.provider_id, c.service_id, c.slug, c.name, c.priority) x) y WHERE place <= 10 GROUP BY provider_id) sv ON sv.provider_id = p.provider_id
        LEFT JOIN (SELECT provider_id, string_agg(CAST(review_id AS STRING), ',' ORDER BY place) AS list FROM (SELECT provider_id, review_id,
                     row_number() OVER (PARTITION BY provider_id ORDER BY published_day DESC, review_id) AS place FROM reviews WHERE trim(text) <> '') t
                   WHERE place <= 3 GROUP BY provider_id) rv ON rv.provider_id = p.provider_id
        LEFT JOIN (SELECT provider_id, string_agg(CAST(neighbour_id AS STRING), ',' ORDER BY place) AS list FROM (
                     SELECT a.provider_id, b.provider_id AS neighbour_id, row_number() OVER (PARTITION BY a.provider_id
                       ORDER BY {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, b.full_name, b.provider_id) AS place
                     FROM providers a JOIN providers b ON a.provider_id <> b.provider_id
                     WHERE a.status = 'published' AND b.status = 'published' AND a.lat IS NOT NULL AND b.lat IS NOT NULL) t WHERE place <= 6 GROUP BY provider_id) nb
          ON nb.provider_id = p.provider_id
        WHERE p.status = 'published'""",
)
def _(d):
    from ..operators.reviews import latest_reviews

    profile = directory.provider_profile(
        d.providers, taxonomy.provider_services_resolved(d.provider_services, d.taxonomy, d.price_benchmarks),
        d.review_summaries, latest_reviews(d.reviews, 3), geojoin.neighbours(filters.published(d.providers), 6),
    )
    text = lambda c: F.array_join(c, ",").alias(c)
    return profile.select("provider_id", "rating_avg", text("services"), text("latest_reviews"), text("neighbours"))
