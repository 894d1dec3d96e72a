"""Taxonomy, prices and their maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import taxonomy as tx
from ..operators import versioned, writes
from ..operators.skew import scratch_path
from .registry import query

# Groups for the product categories of the raw tables.
GROUPS = {"metal": "Metal parts", "flat": "Flat parts"}
_MACRO = "CASE {0} WHEN 'metal' THEN 'Metal parts' WHEN 'flat' THEN 'Flat parts' ELSE 'Other parts' END"

_BEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY confidence DESC NULLS LAST, updated_day DESC, benchmark_id) AS rn
  FROM price_benchmarks WHERE location_scope = 'national') t WHERE rn = 1"""


def macro():
    return tx.macro_category(F.col("category"), GROUPS, "Other parts")


@query(
    "resolve_canonical",
    """SELECT a.slug AS requested_slug, a.record_kind AS requested_kind, c.service_id, c.slug FROM taxonomy a
       JOIN taxonomy c ON c.service_id = coalesce(a.canonical_id, a.service_id)""",
)
def _(d):
    asked = d.services.select(F.col("slug").alias("requested_slug"))
    return tx.resolve_canonical(asked, d.taxonomy).select("requested_slug", "requested_kind", "service_id", "slug")


@query("best_benchmark", f"SELECT service_id, benchmark_id, price_avg_cents, confidence FROM ({_BEST}) b")
def _(d):
    return tx.best_benchmark(d.price_benchmarks).select("service_id", "benchmark_id", "price_avg_cents", "confidence")


@query(
    "best_benchmark_lateral",
    f"""SELECT s.slug, b.benchmark_id FROM services s LEFT JOIN ({_BEST}) b ON b.service_id = s.service_id""",
)
def _(d):
    return d.sql("""SELECT s.slug, b.benchmark_id FROM services s LEFT JOIN LATERAL (
        SELECT benchmark_id FROM price_benchmarks b WHERE b.service_id = s.service_id AND b.location_scope = 'national'
        ORDER BY confidence DESC NULLS LAST, updated_day DESC, benchmark_id LIMIT 1) b""")


@query(
    "top_services",
    f"""SELECT t.slug, b.price_min_cents, b.price_avg_cents, b.price_max_cents FROM (
          SELECT * FROM taxonomy WHERE canonical_id IS NULL AND is_searchable ORDER BY priority, category NULLS LAST, name, service_id LIMIT 18) t
        LEFT JOIN ({_BEST}) b ON b.service_id = t.service_id""",
)
def _(d):
    return tx.top_services(d.taxonomy, d.price_benchmarks).select("slug", "price_min_cents", "price_avg_cents", "price_max_cents")


_RELATED = """SELECT service_id, related_id, weight, CASE kind WHEN 0 THEN 'relation' ELSE 'category' END AS origin, place FROM (
  SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY kind, weight DESC NULLS LAST, priority, name, related_id) AS place FROM (
    SELECT a.service_id, b.service_id AS related_id, r.weight, b.priority, b.name, CASE WHEN r.related_id IS NOT NULL THEN 0 ELSE 1 END AS kind
    FROM taxonomy a JOIN taxonomy b ON a.service_id <> b.service_id
    LEFT JOIN service_relations r ON r.service_id = a.service_id AND r.related_id = b.service_id
    WHERE a.canonical_id IS NULL AND a.is_searchable AND b.canonical_id IS NULL AND b.is_searchable
      AND (r.related_id IS NOT NULL OR coalesce(a.category, '') = coalesce(b.category, ''))) t) u WHERE place <= {0}"""


@query("related_services", _RELATED.format(6))
def _(d):
    return tx.related_services(d.taxonomy, d.service_relations, 6).select("service_id", "related_id", "weight", "origin", "place")


@query(
    "related_services_priced",
    f"""SELECT r.service_id, r.related_id, r.weight, r.origin, r.place, t.slug, t.name, t.category, b.price_min_cents, b.price_avg_cents, b.price_max_cents, b.confidence AS price_confidence
        FROM ({_RELATED.format(6)}) r JOIN taxonomy t ON t.service_id = r.related_id LEFT JOIN ({_BEST}) b ON b.service_id = r.related_id""",
)
def _(d):
    return tx.related_services_priced(d.taxonomy, d.service_relations, d.price_benchmarks, 6)


@query(
    "service_list",
    f"""SELECT t.service_id, t.slug, t.name, t.category, t.record_kind, t.is_searchable, c.slug AS canonical_slug, t.priority, b.price_avg_cents,
          CAST(CASE WHEN starts_with(s.required_documents, '[') THEN 2 ELSE 0 END AS INT) AS docs_count, s.content_status,
          coalesce(len(trim(s.html_content)) > 200, false) AS has_html, coalesce(len(trim(s.image_url)) > 0, false) AS has_image
        FROM taxonomy t LEFT JOIN taxonomy c ON c.service_id = t.canonical_id LEFT JOIN ({_BEST}) b ON b.service_id = t.service_id
        LEFT JOIN service_contents s ON s.service_id = t.service_id""",
)
def _(d):
    return tx.service_list(d.taxonomy, d.price_benchmarks, d.service_contents)


@query(
    "related_or_category_fill",
    f"""WITH enough AS (SELECT service_id FROM service_relations GROUP BY service_id HAVING count(*) >= 8)
        SELECT service_id, related_id, place, 'related' AS origin FROM (
          SELECT service_id, related_id, row_number() OVER (PARTITION BY service_id ORDER BY weight DESC, related_id) AS place FROM service_relations) r
        WHERE place <= 6 AND service_id IN (SELECT service_id FROM enough)
        UNION ALL
        SELECT service_id, related_id, place, 'category' AS origin FROM (
          SELECT a.service_id, b.service_id AS related_id, row_number() OVER (PARTITION BY a.service_id ORDER BY b.priority, b.name, b.service_id) AS place
          FROM services a JOIN services b ON a.service_id <> b.service_id AND {_MACRO.format('a.category')} = {_MACRO.format('b.category')}
          WHERE a.service_id NOT IN (SELECT service_id FROM enough)) f WHERE place <= 6""",
)
def _(d):
    from ..operators.skew import top_per_group

    related = top_per_group(
        d.service_relations, ["service_id"], [F.col("weight").desc(), F.col("related_id")], 100, "place"
    )
    return tx.related_or_category_fill(
        related, d.services, macro(), [F.col("priority"), F.col("name"), F.col("service_id")], at_least=8
    )


@query(
    "provider_services_resolved",
    f"""SELECT r.provider_id, r.service_id, r.source, r.confidence, c.slug, b.price_avg_cents FROM (
          SELECT ps.provider_id, coalesce(t.canonical_id, t.service_id) AS service_id, ps.source, ps.confidence,
                 row_number() OVER (PARTITION BY ps.provider_id, coalesce(t.canonical_id, t.service_id) ORDER BY ps.confidence DESC NULLS LAST, ps.source) AS rn
          FROM provider_services ps JOIN taxonomy t ON t.service_id = ps.service_id) r
        JOIN taxonomy c ON c.service_id = r.service_id AND c.is_searchable LEFT JOIN ({_BEST}) b ON b.service_id = r.service_id WHERE r.rn = 1""",
)
def _(d):
    return tx.provider_services_resolved(d.provider_services, d.taxonomy, d.price_benchmarks).select(
        "provider_id", "service_id", "source", "confidence", "slug", "price_avg_cents"
    )


_EDGES = """SELECT DISTINCT a.slug, b.slug AS related_slug FROM service_relations r JOIN services a ON a.service_id = r.service_id
  JOIN services b ON b.service_id = r.related_id"""


@query(
    "expand_affinity",
    f"""WITH canon AS (SELECT slug AS any_slug, coalesce(canonical_id, service_id) AS service_id FROM taxonomy),
        exact AS (SELECT any_slug AS slug, service_id FROM canon)
        SELECT slug, service_id, 'exact' AS match_kind FROM exact
        UNION ALL
        SELECT DISTINCT e.slug, c.service_id, 'related' AS match_kind FROM ({_EDGES}) e JOIN canon c ON c.any_slug = e.related_slug
        WHERE NOT EXISTS (SELECT 1 FROM exact x WHERE x.slug = e.slug AND x.service_id = c.service_id)""",
)
def _(d):
    return tx.expand_affinity(d.services.select("slug"), d.taxonomy, d.sql(_EDGES))


@query(
    "search_terms_agg",
    """SELECT t.service_id, coalesce(n, 0) AS n_terms, s.place, s.term, s.term_type, s.weight FROM taxonomy t LEFT JOIN (
         SELECT *, count(*) OVER (PARTITION BY service_id) AS n, row_number() OVER (PARTITION BY service_id ORDER BY weight DESC, term, term_type) AS place
         FROM search_terms) s ON s.service_id = t.service_id WHERE t.canonical_id IS NULL AND t.is_searchable""",
)
def _(d):
    return tx.search_terms_agg(d.taxonomy, d.search_terms).select("service_id", "n_terms", "place", "term", "term_type", "weight")


@query(
    "category_prices",
    f"""SELECT {_MACRO.format('s.category')} AS category, count(*) AS services, CAST(floor(avg(nullif(b.price_avg_cents, 0)) + 0.5) AS BIGINT) AS avg_price_cents
        FROM services s LEFT JOIN ({_BEST}) b ON b.service_id = s.service_id GROUP BY {_MACRO.format('s.category')}""",
)
def _(d):
    return tx.category_prices(d.services, d.price_benchmarks, macro())


@query(
    "group_by_category",
    """SELECT coalesce(category, 'Altri servizi') AS category, slug, count(*) OVER (PARTITION BY coalesce(category, 'Altri servizi')) AS n_services,
         row_number() OVER (PARTITION BY coalesce(category, 'Altri servizi') ORDER BY priority, name, service_id) AS place FROM services""",
)
def _(d):
    return tx.group_by_category(d.services).select("category", "slug", "n_services", "place")


@query("macro_category", f"SELECT slug, {_MACRO.format('category')} AS macro FROM services")
def _(d):
    return d.services.select("slug", macro().alias("macro"))


@query(
    "intake_profile",
    """SELECT p_partkey, CASE WHEN contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'gear') OR contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'bolt') THEN 'moving'
         WHEN contains(lower(concat_ws(' ', p_name, p_type, p_brand)), 'economy') THEN 'cheap' ELSE 'generico' END AS profile FROM part""",
)
def _(d):
    rules = [("moving", ["gear", "bolt"]), ("cheap", ["economy"])]
    return d.part.select("p_partkey", tx.intake_profile([F.col("p_name"), F.col("p_type"), F.col("p_brand")], rules).alias("profile"))


@query(
    "seed_values",
    """SELECT s.slug, s.service_id, v.min_eur FROM services s JOIN (VALUES ('red-ring', 150), ('hot-bolt', 80), ('old-gear', 60), ('nowhere', 1)) v(slug, min_eur) ON v.slug = s.slug""",
)
def _(d):
    seed = [("red-ring", 150), ("hot-bolt", 80), ("old-gear", 60), ("nowhere", 1)]
    return tx.seed_values(d.services, seed, "slug string, min_eur int", "slug").select("slug", "service_id", "min_eur")


# Brands act as editors' lists: every brand maps the names it sells that start with 'small' to the 'red' ones.
_ALIASES = "SELECT DISTINCT replace(p_name, ' ', '-') AS slug, concat('red-', substr(p_name, 7)) AS canonical_slug FROM part WHERE p_name LIKE 'small %'"


@query(
    "apply_aliases",
    f"""SELECT t.slug, CASE WHEN c.service_id IS NOT NULL THEN 'alias' ELSE t.record_kind END AS record_kind,
          coalesce(c.service_id, t.canonical_id) AS canonical_id, c.service_id IS NULL AND t.is_searchable AS is_searchable
        FROM taxonomy t LEFT JOIN ({_ALIASES}) m ON m.slug = t.slug LEFT JOIN services c ON c.slug = m.canonical_slug""",
)
def _(d):
    return tx.apply_aliases(d.taxonomy, d.sql(_ALIASES)).select("slug", "record_kind", "canonical_id", "is_searchable")


@query(
    "mark_hubs",
    """SELECT t.slug, CASE WHEN h.slug IS NOT NULL THEN 'hub' ELSE t.record_kind END AS record_kind, h.slug IS NULL AND t.is_searchable AS is_searchable
       FROM taxonomy t LEFT JOIN (SELECT DISTINCT replace(p_name, ' ', '-') AS slug FROM part WHERE p_retailprice > 2700) h ON h.slug = t.slug""",
)
def _(d):
    hubs = d.sql("SELECT replace(p_name, ' ', '-') AS slug FROM part WHERE p_retailprice > 2700")
    return tx.mark_hubs(d.taxonomy, hubs).select("slug", "record_kind", "is_searchable")


_SYNONYMS = "SELECT s.service_id, concat(' ', p_brand, ' ', p_name, '!') AS synonym FROM part JOIN services s ON s.name = p_name"


@query(
    "terms_from_synonyms",
    f"""SELECT coalesce(t.canonical_id, t.service_id) AS service_id, trim(regexp_replace(lower(synonym), '[^a-z0-9]+', ' ', 'g')) AS normalized_term,
          min(trim(synonym)) AS term, CAST(90 AS INT) AS weight
        FROM ({_SYNONYMS}) y JOIN taxonomy t ON t.service_id = y.service_id
        GROUP BY coalesce(t.canonical_id, t.service_id), trim(regexp_replace(lower(synonym), '[^a-z0-9]+', ' ', 'g'))""",
)
def _(d):
    return tx.terms_from_synonyms(d.taxonomy, d.sql(_SYNONYMS)).select("service_id", "normalized_term", "term", "weight")


_TERMS_NOW = "SELECT service_id, term_type, term AS normalized_term, term, weight FROM search_terms WHERE weight < 40"
_TERMS_NEW = "SELECT service_id, term_type, term AS normalized_term, upper(term) AS term, CAST(30 AS INT) AS weight FROM search_terms WHERE weight > 20"


@query(
    "load_terms",
    f"""SELECT coalesce(n.service_id, o.service_id) AS service_id, coalesce(n.term_type, o.term_type) AS term_type, coalesce(n.term, o.term) AS term,
          greatest(o.weight, n.weight) AS weight, CASE WHEN o.service_id IS NULL THEN 'insert' WHEN n.service_id IS NULL THEN 'keep' ELSE 'update' END AS action
        FROM ({_TERMS_NOW}) o FULL JOIN ({_TERMS_NEW}) n ON n.service_id = o.service_id AND n.term_type = o.term_type AND n.normalized_term = o.normalized_term""",
)
def _(d):
    return tx.load_terms(d.sql(_TERMS_NOW), d.sql(_TERMS_NEW)).drop("normalized_term")


@query(
    "load_relations",
    """SELECT service_id, related_id, relation_type, weight FROM service_relations
       UNION ALL SELECT related_id AS service_id, service_id AS related_id, 'reverse' AS relation_type, weight FROM service_relations""",
)
def _(d):
    incoming = d.service_relations.select(
        F.col("related_id").alias("service_id"), F.col("service_id").alias("related_id"), F.lit("reverse").alias("relation_type"), "weight"
    )
    return tx.load_relations(d.service_relations, incoming)


_INCOMING = """SELECT slug, upper(name) AS name, CASE WHEN priority > 1 THEN 'new' ELSE NULL END AS category, CAST(2 AS INT) AS priority FROM services WHERE category IS NULL
  UNION ALL SELECT concat('extra-', slug) AS slug, name, 'extra' AS category, CAST(5 AS INT) AS priority FROM services WHERE category = 'flat'"""


@query(
    "load_services",
    f"""SELECT coalesce(n.slug, s.slug) AS slug, coalesce(n.name, s.name) AS name, coalesce(n.category, s.category) AS category,
          least(s.priority, n.priority) AS priority, CASE WHEN s.slug IS NULL THEN 'insert' WHEN n.slug IS NULL THEN 'keep' ELSE 'update' END AS action
        FROM services s FULL JOIN ({_INCOMING}) n ON n.slug = s.slug""",
)
def _(d):
    return tx.load_services(d.services, d.sql(_INCOMING))


_PRICE_ROWS = """SELECT replace(p_name, ' ', '-') AS slug, p_brand AS location_scope, p_retailprice * 0.75 AS min_eur, p_retailprice AS avg_eur,
  p_retailprice * 1.5 AS max_eur, p_size AS valid_from FROM part"""


@query(
    "load_benchmarks",
    f"""SELECT service_id, location_scope, price_min_cents, price_avg_cents, price_max_cents, valid_from FROM (
          SELECT s.service_id, location_scope, CAST(round(min_eur * 100) AS INT) AS price_min_cents, CAST(round(avg_eur * 100) AS INT) AS price_avg_cents,
                 CAST(round(max_eur * 100) AS INT) AS price_max_cents, valid_from, row_number() OVER (PARTITION BY s.service_id, location_scope
                   ORDER BY valid_from DESC, CAST(round(avg_eur * 100) AS INT)) AS rn
          FROM ({_PRICE_ROWS}) p JOIN services s ON s.slug = p.slug) t WHERE rn = 1""",
)
def _(d):
    return tx.load_benchmarks(d.services, d.sql(_PRICE_ROWS), "seed").drop("source")


@query(
    "fill_defaults",
    """SELECT slug, coalesce(plain, name) AS plain_language_name, coalesce(title, concat(upper(substr(name, 1, 1)), substr(name, 2, instr(name, ' ') - 1),
         upper(substr(name, instr(name, ' ') + 1, 1)), substr(name, instr(name, ' ') + 2), ': costo, documenti e preventivo notaio')) AS seo_title, 'media' AS complexity
       FROM (SELECT *, CASE WHEN category = 'metal' THEN upper(name) END AS plain, CASE WHEN category = 'flat' THEN 'Set' END AS title FROM services) t""",
)
def _(d):
    rows = d.services.withColumn("plain_language_name", F.when(F.col("category") == "metal", F.upper("name"))).withColumn(
        "seo_title", F.when(F.col("category") == "flat", "Set")
    )
    return tx.fill_defaults(rows).select("slug", "plain_language_name", "seo_title", "complexity")


@query(
    "taxonomy_fill",
    """SELECT s.slug, coalesce(c.brand, s.name) AS description, CASE WHEN s.category = 'flat' THEN s.name ELSE coalesce(c.type, '') END AS synonyms
       FROM services s LEFT JOIN (SELECT replace(p_name, ' ', '-') AS slug, max(p_brand) AS brand, min(p_type) AS type FROM part WHERE p_size > 48 GROUP BY p_name) c ON c.slug = s.slug""",
)
def _(d):
    cards = d.part.filter("p_size > 48").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).agg(
        F.max("p_brand").alias("description"), F.array(F.min("p_type")).alias("synonyms")
    )
    rows = d.services.withColumn("description", F.col("name")).withColumn(
        "synonyms", F.when(F.col("category") == "flat", F.array("name")).otherwise(F.array().cast("array<string>"))
    )
    return tx.taxonomy_fill(rows, cards).select("slug", "description", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    "taxonomy_checks",
    """SELECT 'weight' AS "check", service_id FROM search_terms WHERE weight > 45
       UNION ALL SELECT 'self relation' AS "check", service_id FROM service_relations WHERE weight > 1
       UNION ALL SELECT 'dangling' AS "check", service_id FROM services WHERE category = 'metal'
       UNION ALL SELECT 'searchable alias' AS "check", service_id FROM services WHERE category = 'metal' AND is_searchable""",
)
def _(d):
    # Plant known faults: heavy weights, loops, links into nowhere.
    terms = d.search_terms.withColumn("weight", F.when(F.col("weight") > 45, 101).otherwise(F.col("weight")))
    loops = d.service_relations.withColumn("related_id", F.when(F.col("weight") > 1, F.col("service_id")).otherwise(F.col("related_id")))
    tax = d.taxonomy.withColumn("canonical_id", F.when(F.col("category") == "metal", F.lit(-1).cast("bigint")))
    return tx.taxonomy_checks(tax, terms, loops)


@query(
    "upsert",
    """SELECT coalesce(p.provider_id, l.listing_id) AS provider_id, coalesce(nullif(p.website, ''), l.website) AS website,
          CASE WHEN l.listing_id IS NULL THEN p.phone ELSE l.phone END AS phone,
          CASE WHEN p.provider_id IS NULL THEN 'insert' WHEN l.listing_id IS NULL THEN 'keep' ELSE 'update' END AS action
        FROM (SELECT * FROM providers WHERE status = 'published') p FULL JOIN listings l ON l.listing_id = p.provider_id""",
)
def _(d):
    target = d.providers.filter("status = 'published'").select("provider_id", "website", "phone")
    incoming = d.listings.select(F.col("listing_id").alias("provider_id"), "website", "phone")
    return writes.upsert(
        target, incoming, ["provider_id"],
        {"website": F.coalesce(F.nullif("old.website", F.lit("")), F.col("new.website"))},
    )


@query(
    "upsert_versioned",
    """SELECT coalesce(p.provider_id, l.listing_id) AS provider_id, coalesce(nullif(p.website, ''), l.website) AS website,
          CASE WHEN l.listing_id IS NULL THEN p.phone ELSE l.phone END AS phone
        FROM (SELECT * FROM providers WHERE status = 'published') p FULL JOIN listings l ON l.listing_id = p.provider_id""",
)
def _(d):
    table = scratch_path(d.spark, "providers")
    versioned.create_versioned(d.providers.filter("status = 'published'").select("provider_id", "website", "phone"), table, ["provider_id"])
    versioned.upsert_versioned(
        d.listings.select(F.col("listing_id").alias("provider_id"), "website", "phone"), table,
        {"website": F.coalesce(F.nullif("old.website", F.lit("")), F.col("new.website"))},
    )
    return versioned.read_versioned(d.spark, table)


@query(
    "insert_ignore",
    """SELECT request_id, provider_id, status FROM request_recipients WHERE status = 'O' AND provider_id % 2 = 0
       UNION ALL SELECT request_id, provider_id, max(status) FROM request_recipients r GROUP BY request_id, provider_id
         HAVING NOT bool_or(status = 'O' AND provider_id % 2 = 0)""",
)
def _(d):
    links = d.request_recipients.select("request_id", "provider_id", "status")
    present = links.filter("status = 'O' AND provider_id % 2 = 0")
    return writes.insert_ignore(present, links, ["request_id", "provider_id"], [F.col("status").desc()])


@query(
    "distinct_on",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1""",
)
def _(d):
    return writes.distinct_on(d.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("duplicate_guard", "SELECT lower(c_mktsegment) AS key, count(*) AS n FROM customer GROUP BY lower(c_mktsegment) HAVING count(*) > 1")
def _(d):
    return writes.duplicate_guard(d.customer, F.lower("c_mktsegment"))


@query(
    "normalize_slugs",
    "SELECT listing_id, lower(name) AS slug, name AS old_slug FROM listings WHERE name <> lower(name)",
)
def _(d):
    fixed, backup = writes.normalize_slugs(d.listings.select("listing_id", F.col("name").alias("slug")))
    return backup.withColumnRenamed("slug", "old_slug").join(fixed, "listing_id")


@query(
    "survivorship",
    """SELECT p.provider_id, coalesce(p.website, l.website) AS website, coalesce(p.lat, f.lat) AS lat, coalesce(p.lng, f.lng) AS lng
       FROM providers p LEFT JOIN listings l ON l.listing_id = p.provider_id LEFT JOIN (SELECT comune, min(lat) AS lat, min(lng) AS lng FROM providers GROUP BY comune) f
         ON f.comune = p.comune""",
)
def _(d):
    official = d.listings.select(F.col("listing_id").alias("provider_id"), "website", "lat", "lng")
    places = d.providers.groupBy("comune").agg(F.min("lat").alias("lat"), F.min("lng").alias("lng"))
    second = d.providers.select("provider_id", "comune").join(places, "comune").select("provider_id", "lat", "lng")
    return writes.survivorship(d.providers, [official, second], ["website"], ["lat", "lng"]).select("provider_id", "website", "lat", "lng")


@query(
    "content_update",
    """SELECT s.slug, CASE WHEN p.slug IS NOT NULL AND p.title <> '' THEN p.title ELSE s.name END AS title,
          CASE WHEN p.slug IS NOT NULL THEN p.body ELSE s.slug END AS body FROM services s
       LEFT JOIN (SELECT replace(p_name, ' ', '-') AS slug, CASE WHEN max(p_size) > 49 THEN '' ELSE max(p_brand) END AS title, min(p_type) AS body FROM part WHERE p_size > 45 GROUP BY p_name) p ON p.slug = s.slug""",
)
def _(d):
    patches = d.part.filter("p_size > 45").groupBy(F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).agg(
        F.when(F.max("p_size") > 49, "").otherwise(F.max("p_brand")).alias("title"), F.min("p_type").alias("body")
    )
    target = d.services.select("slug", F.col("name").alias("title"), F.col("slug").alias("body"))
    return writes.patch_columns(target, patches, "slug", keep_if_blank=["title"], replace_if_given=["body"]).select("slug", "title", "body")
