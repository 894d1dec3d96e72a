"""Extraction from pages: the raw pages, and profile pages rendered from the register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import writes
from ..sources import pages as page_source
from ..sources import runlog
from ..sources.tables import spread
from .registry import query


@query("read_pages", "SELECT page_id, url, len(html) AS chars, sha256(html) AS html_hash FROM pages")
def _(d):
    return page_source.page_facts(d.pages)


@query(
    "visible_lines",
    r"""SELECT page_id, pos, line FROM (SELECT page_id, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS pos FROM (
          SELECT page_id, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
              '<!--.*?-->', chr(10), 'gs'), '<script\b.*?</script>', chr(10), 'gis'), '<style\b.*?</style>', chr(10), 'gis'), '<[^>]*>', chr(10), 'g'),
              '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS ls
          FROM pages) t) u""",
)
def _(d):
    lines = ex.visible_lines(d.pages)
    return lines.select("page_id", F.posexplode("lines").alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


@query(
    "extract_links",
    r"""SELECT page_id, link, pos FROM (SELECT page_id, link, min(pos) - 1 AS pos FROM (
          SELECT page_id, unnest(ls) AS link, CAST(generate_subscripts(ls, 1) AS INT) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]*)"', 1, 'i') AS ls FROM pages) t) u
        WHERE starts_with(link, '/') GROUP BY page_id, link) v""",
)
def _(d):
    return ex.extract_links(d.pages, F.col("link").startswith("/")).withColumn("pos", F.col("pos").cast("int"))


# Register pages as the official site lays them out, with a section of earlier offices.
_REGISTER = """SELECT p.provider_id AS page_id, concat('https://register.example.org/it/profile/', slug) AS url,
  concat('<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><h2>Dati personali</h2><div><span>Nome e Cognome:</span><b>', full_name, '</b></div>',
    '<p>Codice fiscale</p><p>abc', CAST(p.provider_id AS STRING), '</p><p>Comune</p><p>', comune, '</p><p>Telefono</p><p>', phone, ' ; 0039 ', phone, '</p><p>Email</p><p>',
    CASE WHEN p.provider_id % 5 = 0 THEN '' ELSE email END, '</p><p>Pec</p><p>Distretto</p><p>', district, '</p><p>In questa sede dal:</p><p>2020-0', CAST(1 + p.provider_id % 9 AS STRING), '-15</p>',
    '<h2>Sedi precedenti</h2><p>', comune, ' vecchia</p><p>dal</p><p>2001-02-03</p><p>Altrove</p><p>dal</p><p>mai</p><p>', district, '</p><p>dal</p><p>2010-11-12</p><p>Torna alla ricerca dei notai</p><p>Fine</p><p>dal</p><p>2011-01-01</p></body></html>') AS html
  FROM providers p"""


@query(
    "parse_register_page",
    """SELECT provider_id AS page_id, slug, full_name, string_split(full_name, ' ')[1] AS first_name, concat('ABC', CAST(provider_id AS STRING)) AS fiscal_code, comune,
          concat(phone, ' ; 0039 ', phone) AS phone, CASE WHEN provider_id % 5 = 0 THEN NULL ELSE email END AS email, CAST(NULL AS STRING) AS pec, district,
          CAST(concat('2020-0', CAST(1 + provider_id % 9 AS STRING), '-15') AS DATE) AS current_office_since, phone AS first_phone, CAST(1 AS INT) AS n_phones FROM providers""",
)
def _(d):
    record = ex.parse_register_pages(spread(d.sql(_REGISTER)))
    return record.select(
        "page_id", "slug", "full_name", "first_name", "fiscal_code", "comune", "phone", "email", "pec", "district", "current_office_since",
        F.get("phones", F.lit(0)).alias("first_phone"), F.size("phones").alias("n_phones"),
    )


@query(
    "previous_locations",
    """SELECT provider_id AS page_id, concat(comune, ' vecchia') AS comune, DATE '2001-02-03' AS since FROM providers UNION ALL SELECT provider_id, district, DATE '2010-11-12' FROM providers""",
)
def _(d):
    record = ex.parse_register_pages(spread(d.sql(_REGISTER)))
    return record.select("page_id", F.inline("previous_locations")).select("page_id", "comune", F.col("from").alias("since"))


@query(
    "label_values",
    "SELECT provider_id AS page_id, comune, district, CAST(NULL AS STRING) AS nothing FROM providers",
)
def _(d):
    lines = ex.visible_lines(spread(d.sql(_REGISTER)))
    found = ex.label_values(lines, {"comune": "Comune", "district": "DISTRETTO:", "nothing": "Pec", "p": "Distretto"}, ex.SECTION_LABELS)
    return found.select("page_id", "comune", "district", "nothing")


@query(
    "parse_register_rejects",
    "SELECT page_id, 'no name found' AS error FROM pages",
)
def _(d):
    return ex.parse_register_pages(d.pages).filter("error IS NOT NULL").select("page_id", "error")


_JSONLD = """SELECT provider_id AS page_id, concat('https://profiles.example.org/', slug) AS url,
  concat('<html><script type="application/ld+json">{not json}</script><script type="application/ld+json">[{"@type":"WebPage","name":"page"},{"@type":["Thing","LegalService"],"name":"Studio ', full_name,
    '","telephone":"', phone, '","address":{"@type":"PostalAddress","addressLocality":"', comune, '","postalCode":"00100"},"geo":{"latitude":', CAST(coalesce(lat, 0.5) AS STRING), ',"longitude":"', CAST(coalesce(lng, 0.25) AS STRING), '"}}]</script>',
    CASE WHEN provider_id % 2 = 0 THEN concat('<script type="application/ld+json">{"@type":"Person","name":"', full_name, '","familyName":"X', CAST(provider_id AS STRING), '","email":"', email, '"}</script>') ELSE '' END,
    '</html>') AS html FROM providers"""


@query(
    "parse_jsonld",
    """SELECT provider_id AS page_id, CASE WHEN provider_id % 2 = 0 THEN full_name ELSE concat('Studio ', full_name) END AS name, CASE WHEN provider_id % 2 = 0 THEN concat('X', CAST(provider_id AS STRING)) END AS last_name,
          comune AS city, '00100' AS cap, phone, CASE WHEN provider_id % 2 = 0 THEN email END AS email, coalesce(lat, 0.5) AS lat, coalesce(lng, 0.25) AS lng FROM providers""",
)
def _(d):
    return ex.parse_jsonld(d.sql(_JSONLD)).select("page_id", "name", "last_name", "city", "cap", "phone", "email", "lat", "lng")


_MICRO = """SELECT provider_id AS page_id, concat('https://dir.example.org/', slug) AS url,
  concat('<html><h1 itemprop="name">', full_name, '</h1><div id="categoriaPrimaria">Studi</div><span itemprop="streetAddress">Via Roma ', CAST(provider_id % 90 AS STRING), '</span><span itemprop="postalCode">00100</span>',
    '<span itemprop="addressLocality">', comune, '</span><span itemprop="addressLocality">', comune, '</span><a onclick="openMapLayer17({&quot;tel&quot;:&quot;', phone, '&quot;,&quot;ll&quot;:&quot;41.5;12.25&quot;});">map</a>',
    '<meta itemprop="url" content="https://unrelated.example.org"><a href="https://www.', replace(lower(c_name), '#', ''), '.example.org/">site</a>',
    '<table class="orari_apertura x"><tr><td>Lun 9-13</td><td>Mar</td></tr></table><article class="place_info"><cite>Short</cite><p>About ', district, '</p></article></html>') AS html
  FROM providers JOIN customer ON c_custkey = provider_id"""


@query(
    "parse_microdata",
    """SELECT provider_id AS page_id, full_name AS name, 'Studi' AS category, concat('Via Roma ', CAST(provider_id % 90 AS STRING), ' 00100 ', comune) AS address, comune AS city, phone, CAST(41.5 AS DOUBLE) AS lat, CAST(12.25 AS DOUBLE) AS lng,
          concat('https://www.', replace(lower(c_name), '#', ''), '.example.org/') AS website, 'Short' AS short_description, concat('About ', district) AS description, '9-13' AS monday, CAST(0 AS INT) AS tuesday_spans
       FROM providers JOIN customer ON c_custkey = provider_id""",
)
def _(d):
    rows = ex.parse_microdata(spread(d.sql(_MICRO)))
    return rows.select(
        "page_id", "name", "category", "address", "city", "phone", "lat", "lng", "website", "short_description", "description",
        F.get(F.col("opening_hours")["Lun"], F.lit(0)).alias("monday"), F.size(F.col("opening_hours")["Mar"]).alias("tuesday_spans"),
    )


_CARDS = """SELECT provider_id AS page_id, concat('https://profiles.example.org/', slug) AS url,
  concat('<div class="service-card"><h3>Outside</h3></div><section id="servizi"><h2>Casa</h2><div class="service-card"><h3>Donazioni</h3><p>Testo ', comune, '</div><div class="service-card"><h4>Altro Servizio ', CAST(provider_id % 3 AS STRING),
    '</h4><ul><li>Atto<li>Visura</ul></div><div class="service-card"><p>no name</p></div></section>') AS html FROM providers"""


@query(
    "parse_service_cards",
    """SELECT provider_id AS page_id, 'donazione' AS slug, 'Diritto di Famiglia' AS category, concat('Testo ', comune) AS evidence FROM providers
       UNION ALL SELECT provider_id, concat('altro-servizio-', CAST(provider_id % 3 AS STRING)), 'Da schede', '' FROM providers""",
)
def _(d):
    return ex.parse_service_cards(spread(d.sql(_CARDS))).select("page_id", "slug", "category", "evidence")


_SERVICE_PAGE = """SELECT provider_id AS page_id, concat('https://profiles.example.org/', slug) AS url,
  concat('<h2>Pagina</h2><section class="servizi-section x"><div class="servizi-section-header"><h2>', district, '</h2></div><div class="servizio-card"><h3>Donazioni</h3><p>no<div class="servizio-card-body"><p>Testo ', comune,
    '</div><ul class="servizio-documenti"><li>Atto ', CAST(provider_id % 3 AS STRING), '<li>Visura<li> </ul></div></section><section><div class="servizio-card"><h3>Outside</h3></div></section>',
    '<section class="servizi-section"><h2>Altri</h2><div class="servizio-card"><h4>Altro Atto</h4></div></section>') AS html FROM providers"""


@query(
    "parse_service_pages",
    """SELECT provider_id AS page_id, 'donazioni' AS slug, district AS category, concat('Testo ', comune) AS description, concat('Atto ', CAST(provider_id % 3 AS STRING), ',Visura') AS documents FROM providers
       UNION ALL SELECT provider_id, 'altro-atto', 'Altri', '', '' FROM providers""",
)
def _(d):
    cards = ex.parse_service_pages(spread(d.sql(_SERVICE_PAGE)))
    return cards.select("page_id", "slug", "category", "description", F.array_join("documents", ",").alias("documents"))


_LOG = """SELECT observation_id, CASE WHEN observation_id % 7 = 0 THEN concat('plain text ', status) WHEN observation_id % 11 = 0 THEN '{broken json'
  ELSE concat('{"event":"', status, '","slug":"s', CAST(provider_id AS STRING), '","score":', CAST(observation_id % 100 AS STRING), '}') END AS value FROM observations"""


@query(
    "read_run_log",
    "SELECT status AS event, count(*) AS n FROM observations WHERE observation_id % 7 <> 0 AND observation_id % 11 <> 0 GROUP BY status",
)
def _(d):
    return runlog.count_events(runlog.parse_log_lines(d.sql(_LOG)))


@query(
    "write_report",
    """SELECT concat('{"provider_id":', provider_id, ',"status":"', status, '"}') AS line FROM observations""",
)
def _(d):
    return runlog.report_rows(d.observations.select("provider_id", "status"))


@query(
    "incremental_backlog",
    """SELECT l.listing_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.provider_id = l.listing_id AND o.source = 'source5' AND o.status <> 'error')""",
)
def _(d):
    from ..streaming.metrics import backlog

    todo = d.listings.select(F.col("listing_id").alias("provider_id"))
    done = d.observations.filter("source = 'source5' AND status <> 'error'")
    return backlog(todo, done, ["provider_id"]).select(F.col("provider_id").alias("listing_id"))
