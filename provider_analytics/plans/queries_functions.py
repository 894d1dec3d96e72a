"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, phones, records, text
from .registry import query

_NORMAL = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


@query("normalize_query", f"SELECT doc_id, {_NORMAL.format('text')} AS normalized FROM documents")
def _(d):
    return d.documents.select("doc_id", text.normalize_query(F.col("text")).alias("normalized"))


@query(
    "normalize_query_sql_function",
    f"SELECT conv_id, turn, {_NORMAL.format('text')} AS normalized FROM conversations",
)
def _(d):
    text.register_sql_functions(d.spark)
    return d.sql("SELECT conv_id, turn, normalize_service_search_term(text) AS normalized FROM conversations")


@query(
    "normalize_accents",
    "SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) AS normalized FROM documents",
)
def _(d):
    return d.documents.select("doc_id", text.normalize_accents(F.col("text")).alias("normalized"))


@query(
    "slugify",
    """SELECT page_id, regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug
       FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages) t""",
)
def _(d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return d.pages.select("page_id", text.slugify(title).alias("slug"))


@query(
    "title_case",
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\s-]+|[^\s-]+'),
          lambda p: CASE WHEN regexp_matches(p, '^[a-zàèéìòù]') THEN upper(substr(p, 1, 1)) || substr(p, 2) ELSE p END), '') AS titled
        FROM documents""",
)
def _(d):
    return d.documents.select("doc_id", text.title_case(F.col("text")).alias("titled"))


_STOP = "[" + ",".join(f"'{w}'" for w in text.SERVICE_STOP_WORDS) + "]"


@query(
    "tokens",
    f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS kept FROM (
          SELECT doc_id, list_filter(string_split({_NORMAL.format('text')}, ' '),
            lambda t: len(t) >= 2 AND NOT list_contains({_STOP}, t)) AS toks FROM documents) t""",
)
def _(d):
    toks = text.service_tokens(F.col("text"))
    return d.documents.select("doc_id", toks.alias("toks")).select(
        "doc_id", F.size("toks").cast("bigint").alias("n_tokens"), F.array_join("toks", " ").alias("kept")
    )


_PHONE_FIELD = """CASE provider_id % 5 WHEN 0 THEN concat('0039 ', phone, ' ; ', phone)
   WHEN 1 THEN concat('+39', substr(phone, 1, 9), ', 02/', substr(phone, 2, 7))
   WHEN 2 THEN concat(substr(phone, 1, 4), ' | ', phone)
   WHEN 3 THEN concat('39', phone, '; ', substr(phone, 3), ' , 12345678901234')
   ELSE phone END"""
_DIGITS = """CASE WHEN starts_with({d}, '0039') THEN substr({d}, 5)
  WHEN starts_with({d}, '39') AND len({d}) > 10 THEN substr({d}, 3) ELSE {d} END"""


@query(
    "phone_digits",
    f"""SELECT provider_id, {_DIGITS.format(d="d")} AS digits FROM (
          SELECT provider_id, regexp_replace({_PHONE_FIELD}, '[^0-9]', '', 'g') AS d FROM providers) t""",
)
def _(d):
    return d.providers.select("provider_id", phones.phone_digits(F.expr(_PHONE_FIELD)).alias("digits"))


@query(
    "phone_split",
    f"""SELECT provider_id, row_number() OVER (PARTITION BY provider_id ORDER BY ix) AS pos, chunk FROM (
          SELECT provider_id, ix, chunk, dig, row_number() OVER (PARTITION BY provider_id, dig ORDER BY ix) AS seen FROM (
            SELECT provider_id, ix, chunk, {_DIGITS.format(d="regexp_replace(chunk, '[^0-9]', '', 'g')")} AS dig FROM (
              SELECT provider_id, unnest(regexp_split_to_array({_PHONE_FIELD}, '\\s*[,;|]\\s*')) AS chunk,
                     generate_subscripts(regexp_split_to_array({_PHONE_FIELD}, '\\s*[,;|]\\s*'), 1) AS ix
              FROM providers) a) b) c
        WHERE seen = 1 AND len(dig) BETWEEN 6 AND 11""",
)
def _(d):
    return d.providers.select("provider_id", F.posexplode(phones.phone_split(F.expr(_PHONE_FIELD)))).select(
        "provider_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("col").alias("chunk")
    )


@query(
    "phone_tokens",
    f"""SELECT DISTINCT provider_id, token FROM (
          SELECT provider_id, {_DIGITS.format(d="d")} AS token FROM (
            SELECT provider_id, regexp_replace(unnest(regexp_split_to_array({_PHONE_FIELD}, '[;,/]')), '[^0-9]', '', 'g') AS d
            FROM providers) t) u WHERE len(token) >= 7""",
)
def _(d):
    return d.providers.select("provider_id", F.explode(phones.phone_tokens(F.expr(_PHONE_FIELD))).alias("token"))


@query(
    "phone_e164",
    "SELECT listing_id, '+39' || substr(phone, 5) AS e164 FROM listings WHERE phone IS NOT NULL",
)
def _(d):
    return d.listings.filter("phone IS NOT NULL").select("listing_id", phones.phone_e164(F.col("phone")).alias("e164"))


@query(
    "street_number",
    f"""SELECT doc_id, coalesce(regexp_extract({_NORMAL.format('text')}, '\\b(\\d{{1,5}})(?:\\s*[a-z])?\\b', 1), '') AS number
        FROM documents""",
)
def _(d):
    return d.documents.select("doc_id", phones.street_number(F.col("text")).alias("number"))


@query(
    "split_name",
    """SELECT provider_id, string_split(full_name, ' ')[1] AS first_name, string_split(full_name, ' ')[2] AS last_name
       FROM providers""",
)
def _(d):
    first, last = text.split_name(F.col("full_name"))
    return d.providers.select("provider_id", first.alias("first_name"), last.alias("last_name"))


@query(
    "parse_iso_date",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""",
)
def _(d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(day, F.lit("T00"))).otherwise(F.concat(F.lit(" "), day))
    return d.orders.select("o_orderkey", text.parse_iso_date(raw).alias("day"))


@query(
    "website_url",
    """SELECT provider_id, CASE WHEN website IS NULL THEN NULL WHEN provider_id % 2 = 0 THEN 'HTTP://' || website
              ELSE 'https://' || website END AS url FROM providers""",
)
def _(d):
    raw = (
        F.when(F.col("provider_id") % 2 == 0, F.concat(F.lit(" HTTP://"), "website"))
        .when(F.col("provider_id") % 5 == 0, F.concat(F.lit("//"), "website"))
        .otherwise(F.concat(F.lit("/"), "website"))
    )
    return d.providers.select("provider_id", text.website_url(raw).alias("url"))


@query(
    "url_host",
    """SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/:?#]*)', 1)), '^www\\.', '') AS host FROM pages""",
)
def _(d):
    return d.pages.select("page_id", text.url_host(F.col("url")).alias("host"))


@query(
    "domain_matches_name",
    """SELECT listing_id, true AS by_own_name, false AS by_title FROM listings""",
)
def _(d):
    site = F.concat(F.lit("https://www.studio-"), F.lower(F.replace("name", F.lit(" "), F.lit(""))), F.lit(".example.org/x"))
    return d.listings.select(
        "listing_id",
        text.domain_matches_name(site, F.col("name")).alias("by_own_name"),
        text.domain_matches_name(F.lit("https://studionotarile.example.org"), F.lit("Studio Notarile")).alias("by_title"),
    )


def _chain(pairs, value):
    """Nested replacements in SQL, the first pair innermost."""
    for old, new in pairs:
        value = f"replace({value}, '{old}', '{new}')"
    return value


# Every text as a wrong code page would show it, and the repair of that.
_BREAK = [(right, wrong) for wrong, right in text.MOJIBAKE if right and wrong != "\u00c3 "]
_BROKEN = _chain(_BREAK, "text")


@query(
    "fix_mojibake",
    f"""SELECT doc_id, CASE WHEN regexp_matches(broken, '[ÃÂâ]') THEN {_chain(text.MOJIBAKE, 'broken')} ELSE broken END AS repaired
        FROM (SELECT doc_id, {_BROKEN} AS broken FROM documents) b""",
)
def _(d):
    broken = F.col("text")
    for right, wrong in _BREAK:
        broken = F.replace(broken, F.lit(right), F.lit(wrong))
    return d.documents.withColumn("broken", broken).select("doc_id", text.fix_mojibake(F.col("broken")).alias("repaired"))


@query(
    "compact_hours",
    """SELECT provider_id, CASE WHEN provider_id % 3 <> 0 THEN provider_id % 3 = 1 END AS open_now, CASE WHEN provider_id % 3 <> 0 AND provider_id % 2 = 0 THEN 'Mon|Tue' ELSE '' END AS days,
          CASE WHEN provider_id % 3 <> 0 THEN 1 ELSE 0 END AS n_periods FROM providers""",
)
def _(d):
    hours = F.expr("""CASE WHEN provider_id % 3 <> 0 THEN named_struct('open_now', provider_id % 3 = 1,
      'weekday_text', CASE WHEN provider_id % 2 = 0 THEN array('Mon', 'Tue') END,
      'periods', array(named_struct('open', named_struct('day', 1, 'time', '0900'), 'close', named_struct('day', 1, 'time', '1300')))) END""")
    rows = d.providers.select("provider_id", records.compact_hours(hours).alias("h"))
    return rows.select("provider_id", "h.open_now", F.array_join("h.weekday_text", "|").alias("days"), F.size("h.periods").alias("n_periods"))


_HAVERSINE = """round(2 * 6371 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))), 6)"""


@query(
    "haversine_km",
    f"""SELECT provider_id, {_HAVERSINE} AS km FROM (
          SELECT provider_id, sin(radians(41.9 - lat) / 2) * sin(radians(41.9 - lat) / 2)
            + cos(radians(lat)) * cos(radians(41.9)) * sin(radians(12.5 - lng) / 2) * sin(radians(12.5 - lng) / 2) AS h
          FROM providers) t""",
)
def _(d):
    km = geo.distance_km(F.col("lat"), F.col("lng"), F.lit(41.9), F.lit(12.5))
    return d.providers.select("provider_id", km.alias("km"))


@query(
    "acos_km",
    """SELECT provider_id, round(6371 * acos(least(1, greatest(-1, cos(radians(41.9)) * cos(radians(lat)) * cos(radians(lng) - radians(12.5))
         + sin(radians(41.9)) * sin(radians(lat))))), 4) AS km FROM providers""",
)
def _(d):
    km = geo.acos_km(F.lit(41.9), F.lit(12.5), F.col("lat"), F.col("lng"))
    return d.providers.select("provider_id", F.round(km, 4).alias("km"))


@query(
    "as_coord",
    "SELECT property_id, CAST(replace(rendita, ',', '.') AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS junk FROM client_properties",
)
def _(d):
    return d.client_properties.select(
        "property_id",
        geo.as_coord(F.col("rendita")).alias("value"),
        geo.as_coord(F.concat("rendita", F.lit(" km"))).alias("junk"),
    )


@query(
    "parse_radius",
    """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity IN (10, 20, 30, 50, 100) THEN l_quantity ELSE 30 END AS INT) AS radius
       FROM lineitem""",
)
def _(d):
    return d.lineitem.select("l_orderkey", "l_linenumber", geo.parse_radius(F.col("l_quantity").cast("string"), 30).alias("radius"))


@query(
    "snap_to_cell",
    """SELECT provider_id, round(lat, 2) AS cell_lat, round(lng, 2) AS cell_lng FROM providers""",
)
def _(d):
    lat, lng = geo.snap_to_cell(F.col("lat"), F.col("lng"))
    return d.providers.select("provider_id", lat.alias("cell_lat"), lng.alias("cell_lng"))


@query(
    "review_id",
    """SELECT review_id, sha256(concat(CAST(provider_id AS STRING), '|', source, '|', CAST(published_day AS STRING), '|', text)) AS hash
       FROM reviews""",
)
def _(d):
    return d.reviews.select(
        "review_id",
        records.review_id(F.col("provider_id"), F.col("source"), F.col("published_day"), F.col("text")).alias("hash"),
    )


@query(
    "cadastral_summary",
    """SELECT property_id, concat_ws(' · ', 'Fg. ' || foglio, 'Part. ' || particella, 'Cat. ' || categoria) AS summary
       FROM client_properties""",
)
def _(d):
    none = F.lit(None).cast("string")
    return d.client_properties.select(
        "property_id",
        records.cadastral_summary(F.col("foglio"), F.col("particella"), none, none, F.col("categoria")).alias("summary"),
    )


@query(
    "sanitize_html",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '<!doctype[^>]*>', '', 'gi'), '</?html[^>]*>', '', 'gi'), '<head[^>]*>.*?</head>', '', 'gis'),
          '</?body[^>]*>', '', 'gi'), '<script[^>]*>.*?</script>', '', 'gis'), '<iframe[^>]*>.*?</iframe>', '', 'gis'), ' ') AS clean
        FROM pages""",
)
def _(d):
    return d.pages.select("page_id", text.sanitize_html(F.col("html")).alias("clean"))


@query(
    "split_heading",
    r"""SELECT page_id, heading, CASE WHEN heading = '' THEN html ELSE trim(
          substr(html, 1, instr(html, heading) - 1) || substr(html, instr(html, heading) + len(heading)), ' ') END AS body
        FROM (SELECT page_id, html, regexp_extract(html, '<h1\b[^>]*>.*?</h1>', 0, 'is') AS heading FROM pages) t""",
)
def _(d):
    heading, body = text.split_heading(F.col("html"))
    return d.pages.select("page_id", heading.alias("heading"), body.alias("body"))


_PERIODS = """transform(sequence(0, 6), i -> named_struct('open_day', i,
  'open_hhmm', concat('0', cast(provider_id % 10 as string), CASE WHEN i = 3 THEN '' ELSE '30' END), 'close_day', i,
  'close_hhmm', concat('1', cast(provider_id % 9 as string), '00')))"""


@query(
    "open_now",
    """SELECT event_id, (dayofweek(local) <> 3 AND provider_id % 10 * 100 + 30 <= clock AND clock < 1000 + provider_id % 9 * 100)
              OR (dayofweek(local) = 3 AND provider_id % 10 <= clock AND clock < 1000 + provider_id % 9 * 100) AS is_open
       FROM (SELECT *, hour(local) * 100 + minute(local) AS clock FROM (
          SELECT event_id, provider_id, ts + INTERVAL 1 HOUR AS local FROM provider_events) a) b""",
)
def _(d):
    # All events lie in January, when the zone is one hour ahead of UTC.
    return d.provider_events.select(
        "event_id", records.open_now(F.expr(_PERIODS), F.col("ts").cast("timestamp")).alias("is_open")
    )


@query(
    "opening_spec",
    """SELECT provider_id, day, concat('0', CAST(provider_id % 10 AS STRING), ':30') AS opens,
              concat('1', CAST(provider_id % 9 AS STRING), ':00') AS closes
       FROM providers CROSS JOIN (VALUES ('Sunday'), ('Monday'), ('Tuesday'), ('Thursday'), ('Friday'), ('Saturday')) w(day)""",
)
def _(d):
    return d.providers.select("provider_id", F.inline(records.opening_spec(F.expr(_PERIODS))))


_PHOTOS = """transform(sequence(1, 7), i -> named_struct(
  'photo_reference', CASE WHEN (provider_id + i) % 3 = 0 THEN '' ELSE concat('ref', cast(i as string)) END,
  'width', i * 100, 'height', i * 10, 'html_attributions', cast(null as array<string>)))"""


@query(
    "compact_photos",
    """SELECT provider_id, concat('ref', CAST(i AS STRING)) AS reference, CAST(i * 100 AS INT) AS width
       FROM providers CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS i) n WHERE (provider_id + i) % 3 <> 0""",
)
def _(d):
    return d.providers.select("provider_id", F.inline(records.compact_photos(F.expr(_PHOTOS)))).select(
        "provider_id", "reference", "width"
    )


@query(
    "canonical_json",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""",
)
def _(d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return d.events.select("event_id", records.canonical_json(fenced, "struct<k:int>")["k"].alias("k"))


@query(
    "json_merge",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS type, CAST(2 AS INT) AS n_fields FROM events""",
)
def _(d):
    merged = records.json_merge(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type"))
    )
    return d.events.select("event_id", merged.alias("m")).select(
        "event_id",
        F.col("m")["k"].cast("int").alias("k"),
        F.col("m")["type"].alias("type"),
        records.json_len(F.map_keys("m")).alias("n_fields"),
    )


@query(
    "valid_profile_url",
    """SELECT page_id, url, ends_with(regexp_extract(lower(url), '://([^/:?#]*)', 1), 'example.com')
          AND regexp_matches(url, '://[^/?#]*/(?:fr|en)/[^/?#]') AS valid FROM pages""",
)
def _(d):
    from ..operators.filters import valid_profile_url

    rules = {"hosts": ["example.com"], "path_prefixes": ["/fr/", "/en/"], "placeholders": ["/-/"]}
    return d.pages.select("page_id", "url", valid_profile_url(F.col("url"), **rules).alias("valid"))


@query("indexable_url", "SELECT page_id, NOT contains(url, '?') AS indexable FROM pages")
def _(d):
    return d.pages.select("page_id", text.indexable_url(F.col("url")).alias("indexable"))


@query(
    "is_generic_query",
    """SELECT c_custkey, c_custkey % 4 IN (0, 1, 3) AS generic, CASE WHEN c_custkey % 4 = 2 THEN 'Notaio ' || c_name ELSE '' END AS useful
       FROM customer""",
)
def _(d):
    asked = F.expr("""CASE c_custkey % 4 WHEN 0 THEN 'Studio  Notarile!' WHEN 1 THEN 'cerca notàio'
                      WHEN 2 THEN concat('Notaio ', c_name, ' ') ELSE ' ' END""")
    return d.customer.select(
        "c_custkey", text.is_generic_query(asked).alias("generic"), text.meaningful_query(asked).alias("useful")
    )


@query(
    "in_bbox",
    """SELECT provider_id, coalesce(lat BETWEEN 35 AND 48 AND lng BETWEEN 6 AND 19.5, false) AS shown,
              coalesce(lat BETWEEN 35 AND 47.2 AND lng BETWEEN 6 AND 19.3, false) AS accepted, lat IS NOT NULL AS located
       FROM providers""",
)
def _(d):
    lat, lng = F.col("lat"), F.col("lng")
    return d.providers.select(
        "provider_id",
        F.coalesce(geo.in_bbox(lat, lng), F.lit(False)).alias("shown"),
        F.coalesce(geo.in_bbox(lat, lng, geo.GEOCODE_BOX), F.lit(False)).alias("accepted"),
        geo.has_coords(lat, lng).alias("located"),
    )
