"""Cities, provinces and the URL inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import crawl, directory
from .registry import query

SITE = "https://site.example.org"
# Every district name plays the part of a capital with a two-letter code.
_CAPITALS = "SELECT n_name AS name, concat('P', chr(65 + n_nationkey)) AS province, CAST(n_nationkey AS INT) AS pos FROM nation"
_EXTRAS = "SELECT concat(n_name, ' C7') AS name, concat('P', chr(65 + (n_nationkey + 1) % 25)) AS province, CAST(100 + n_nationkey AS INT) AS pos FROM nation WHERE n_regionkey = 1"
_NEAR = """SELECT concat('P', chr(65 + a.n_nationkey)) AS province, concat('P', chr(65 + b.n_nationkey)) AS near, CAST(b.n_nationkey AS INT) AS pos
  FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_regionkey < 3"""
_SLUG = "regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g')"
_TITLE = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2, instr({0}, ' ') - 2)), ' ', upper(substr({0}, instr({0}, ' ') + 1)))"

_AGG = """SELECT lower(comune) AS city_key, min(comune) AS comune, max(nullif(district, '')) AS district, count(*) AS providers FROM providers
  WHERE status = 'published' AND coalesce(comune, '') <> '' GROUP BY lower(comune) HAVING count(*) >= {0}"""
# The longest capital name that occurs in the slug of city and district; extra cities give their own province.
_INFER = f"""SELECT a.*, coalesce(x.province, c.province) AS province FROM ({_AGG}) a
  LEFT JOIN ({_EXTRAS}) x ON lower(x.name) = a.city_key
  LEFT JOIN LATERAL (SELECT province FROM ({_CAPITALS}) q WHERE contains({_SLUG.format("concat(a.comune, ' ', a.district)")}, {_SLUG.format('q.name')})
    ORDER BY len(q.name) DESC, q.pos LIMIT 1) c ON true"""
_CITY = f"""SELECT name, province, providers, path, location_slug FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY providers DESC, listed, name) AS rn FROM (
    SELECT name, province, providers, listed, concat('/notai/', lower(province), '/', {_SLUG.format('name')}) AS path,
           concat({_SLUG.format('name')}, '-', lower(province)) AS location_slug FROM (
      SELECT name, province, 0 AS providers, 1 AS listed FROM ({_CAPITALS}) a1 UNION ALL SELECT name, province, 0, 1 FROM ({_EXTRAS}) a2
      UNION ALL SELECT {_TITLE.format('comune')}, province, providers, 0 FROM ({_INFER}) i WHERE province IS NOT NULL) u) v) w WHERE rn = 1"""


def capitals(d):
    return d.sql(_CAPITALS)


def inventory(d, least):
    return crawl.city_inventory(d.providers, capitals(d), d.sql(_EXTRAS), least)


@query("city_aggregates", _AGG.format(2))
def _(d):
    return crawl.city_aggregates(d.providers, 2)


@query("infer_province", f"SELECT comune, district, province FROM ({_INFER.format(1)}) i")
def _(d):
    cities = crawl.city_aggregates(d.providers, 1)
    return crawl.infer_province(cities, capitals(d), d.sql(_EXTRAS)).select("comune", "district", "province")


@query("city_inventory", _CITY.format(2))
def _(d):
    return inventory(d, 2)


_PROVINCE = f"""SELECT c.province AS code, coalesce(n.name, c.province) AS name, concat('/notai/provincia/', lower(c.province)) AS path, count(*) AS cities,
  CAST(sum(c.providers) AS BIGINT) AS providers FROM ({_CITY.format(2)}) c LEFT JOIN ({_CAPITALS}) n ON n.province = c.province GROUP BY c.province, n.name"""


@query("province_rollup", _PROVINCE)
def _(d):
    return crawl.province_rollup(inventory(d, 2), capitals(d))


@query(
    "location_slug",
    f"""SELECT comune, {_SLUG.format("concat(comune, ' pa')")} AS slug, concat('/notai/pa/', {_SLUG.format('comune')}) AS path,
          concat(upper(substr(comune, 1, 1)), lower(substr(comune, 2, instr(comune, '_') - 2)), ' ', substr(comune, instr(comune, '_') + 1)) AS city, 'PA' AS code FROM providers""",
)
def _(d):
    slug = crawl.location_slug(F.col("comune"), F.lit("PA"))
    city, code = crawl.parse_location_slug(slug)
    return d.providers.select(
        "comune", slug.alias("slug"), crawl.city_path(F.col("comune"), F.lit("PA")).alias("path"), city.alias("city"), code.alias("code")
    )


_LOCAL_SLUGS = ", ".join(f"('{slug}')" for slug, _ in crawl.LOCAL_SERVICES)
_STATIC = f"""SELECT path, 'static' AS bucket, CASE WHEN path = '/' THEN 'daily' ELSE 'weekly' END AS changefreq,
  CASE WHEN path = '/' THEN 1.0 WHEN path IN ('/notai', '/quanto-costa') THEN 0.9 ELSE 0.5 END AS priority, NULL AS lastmod
  FROM (VALUES {", ".join(f"('{p}')" for p in crawl.STATIC_PATHS)}) v(path)"""
_PROVIDER_ROWS = """SELECT p.slug, coalesce(p.website, '') <> '' AS is_enriched, strftime(u.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
  row_number() OVER (ORDER BY CASE WHEN coalesce(p.website, '') <> '' THEN 0 ELSE 1 END, u.updated_at DESC NULLS LAST, p.full_name, p.provider_id) AS rn
  FROM providers p LEFT JOIN (SELECT provider_id, max(created_at) AS updated_at FROM observations GROUP BY provider_id) u ON u.provider_id = p.provider_id WHERE p.status = 'published'"""
_URLS = f"""SELECT path, bucket, changefreq, CAST(priority AS DOUBLE) AS priority, CAST(lastmod AS STRING) AS lastmod FROM (
  {_STATIC}
  UNION ALL SELECT path, 'province', 'weekly', 0.85, NULL FROM ({_PROVINCE}) p
  UNION ALL SELECT path, 'citta', 'weekly', 0.95, NULL FROM ({_CITY.format(2)}) c
  UNION ALL SELECT concat('/quanto-costa/categoria/', slug), 'servizi', 'weekly', 0.85, NULL FROM (VALUES {", ".join(f"('{s}')" for s in crawl.MACRO_SLUGS)}) m(slug)
  UNION ALL SELECT concat('/quanto-costa/', slug), 'servizi', 'weekly', 0.75, NULL FROM taxonomy WHERE canonical_id IS NULL AND is_searchable
  UNION ALL SELECT concat('/quanto-costa/', location_slug, '/', s.slug, '/notai'), 'local', 'weekly', CASE WHEN providers >= 10 THEN 0.65 ELSE 0.55 END, NULL
    FROM ({_CITY.format(3)}) c CROSS JOIN (VALUES {_LOCAL_SLUGS}) s(slug)
  UNION ALL SELECT concat('/notai/', slug), 'notai', 'monthly', CASE WHEN is_enriched THEN 0.6 ELSE 0.35 END, updated_at FROM ({_PROVIDER_ROWS}) r) u"""


def all_urls(d):
    caps = capitals(d)
    cities = inventory(d, 2)
    updated = d.observations.groupBy("provider_id").agg(F.max("created_at").alias("updated_at"))
    rows = d.providers.join(updated, "provider_id", "left").withColumn("place_id", F.lit(None).cast("string"))
    enriched = directory.enriched_first(rows, "updated_at")
    from ..operators.taxonomy import searchable

    return crawl.url_union(
        crawl.static_urls(d.spark), crawl.province_urls(crawl.province_rollup(cities, caps)), crawl.city_urls(cities, caps),
        crawl.service_urls(searchable(d.taxonomy)), crawl.local_urls(inventory(d, 3)), crawl.provider_urls(enriched),
    )


@query("url_union", _URLS)
def _(d):
    return all_urls(d)


@query(
    "cross_city_service",
    f"SELECT c.path, s.slug AS service_slug FROM ({_CITY.format(3)}) c CROSS JOIN (VALUES {_LOCAL_SLUGS}) s(slug)",
)
def _(d):
    return crawl.cross_city_service(inventory(d, 3)).select("path", "service_slug")


@query("url_priority", f"SELECT bucket, priority, changefreq, count(*) AS n FROM ({_URLS}) u GROUP BY bucket, priority, changefreq")
def _(d):
    return all_urls(d).groupBy("bucket", "priority", "changefreq").agg(F.count("*").alias("n"))


@query(
    "crawl_report",
    f"""SELECT bucket, count(*) AS urls, round(count(*) * 100.0 / (SELECT count(*) FROM ({_URLS}) t), 1) AS share_pct,
          array_to_string((list(path ORDER BY path))[1:5], ' ') AS samples FROM ({_URLS}) u GROUP BY bucket""",
)
def _(d):
    return crawl.crawl_report(all_urls(d))


_ELEMENT = f"""concat('  <url>', chr(10), '    <loc>{SITE}', path, '</loc>',
  CASE WHEN lastmod IS NULL THEN '' ELSE concat(chr(10), '    <lastmod>', substr(lastmod, 1, 10), '</lastmod>') END,
  chr(10), '    <changefreq>', changefreq, '</changefreq>', chr(10), '    <priority>',
  CASE priority WHEN 1.0 THEN '1.0' WHEN 0.95 THEN '0.9' WHEN 0.9 THEN '0.9' WHEN 0.85 THEN '0.8' WHEN 0.75 THEN '0.8' WHEN 0.65 THEN '0.7'
    WHEN 0.6 THEN '0.6' WHEN 0.55 THEN '0.6' WHEN 0.5 THEN '0.5' WHEN 0.35 THEN '0.3' END, '</priority>', chr(10), '  </url>')"""


@query("write_urls", f"SELECT path, {_ELEMENT} AS element FROM ({_URLS}) u")
def _(d):
    return all_urls(d).select("path", crawl.url_element(SITE).alias("element"))


@query(
    "sitemap_locs",
    f"SELECT bucket, concat('{SITE}', path) AS loc, substr(lastmod, 1, 10) AS lastmod FROM ({_URLS}) u",
)
def _(d):
    from ..sources.sitemap import parse_documents

    documents = crawl.sitemap_documents(all_urls(d), SITE)
    return parse_documents(documents.select("bucket", "xml"), "xml").select("bucket", "loc", "lastmod")


@query(
    "changed_urls",
    f"""SELECT url, CAST(floor((row_number() OVER (ORDER BY url) - 1) / 100) AS BIGINT) AS notification FROM (SELECT DISTINCT concat('{SITE}/notai/', lower(slug)) AS url FROM providers p
        WHERE EXISTS (SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.status = 'completed' AND o.source = 'source1') OR EXISTS (
          SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.status = 'completed' AND o.source = 'source4')) u""",
)
def _(d):
    run = d.observations.filter("source IN ('source1', 'source4')")
    return crawl.changed_urls(d.providers, run, SITE, 100)


_NEIGHBOURS = f"""SELECT a.province AS place, row_number() OVER (PARTITION BY a.province ORDER BY n.pos) AS rank, c.name, n.near AS near_province
    FROM ({_CAPITALS}) a JOIN ({_NEAR}) n ON n.province = a.province JOIN ({_CAPITALS}) c ON c.province = n.near
  UNION ALL
  SELECT place, rank, name, near_province FROM (SELECT a.province AS place, row_number() OVER (PARTITION BY a.province ORDER BY c.pos) AS rank, c.name, c.province AS near_province
    FROM ({_CAPITALS}) a JOIN ({_CAPITALS}) c ON c.province <> a.province WHERE a.province NOT IN (SELECT province FROM ({_NEAR}) x)) f"""


@query("neighbour_cities", f"SELECT place, rank, name, near_province FROM ({_NEIGHBOURS}) n WHERE rank <= 6")
def _(d):
    asked = inventory(d, 2).select(F.col("province").alias("place"))
    return crawl.neighbour_cities(asked, capitals(d), d.sql(_NEAR))


@query(
    "cross_links",
    f"""SELECT c.name, c.province, 'province' AS kind, 0 AS rank, concat('/notai/provincia/', lower(c.province)) AS href FROM ({_CITY.format(2)}) c
        UNION ALL SELECT c.name, c.province, 'city', n.rank, concat('/notai/', lower(n.near_province), '/', {_SLUG.format('n.name')})
          FROM ({_CITY.format(2)}) c JOIN ({_NEIGHBOURS}) n ON n.place = c.province WHERE n.rank <= 6
        UNION ALL SELECT c.name, c.province, 'service', s.rank, concat('/quanto-costa/', c.location_slug, '/', s.slug, '/notai')
          FROM ({_CITY.format(2)}) c CROSS JOIN (VALUES {", ".join(f"({i + 1}, '{slug}')" for i, (slug, _) in enumerate(crawl.LOCAL_SERVICES[:8]))}) s(rank, slug)""",
)
def _(d):
    return crawl.cross_links(inventory(d, 2), capitals(d), d.sql(_NEAR))
