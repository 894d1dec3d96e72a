"""Cities and provinces of the directory, the URL inventory built from them, and its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.phones import phone_e164
from ..functions.text import slugify, title_case, xml_escape
from .filters import published
from .skew import place_in_group, reuse, top_per_group
from .windows import with_windows

# Provincial capitals with their province codes, in priority order.
CAPITALS = [
    ("Milano", "MI"), ("Roma", "RM"), ("Torino", "TO"), ("Napoli", "NA"), ("Firenze", "FI"), ("Bologna", "BO"),
    ("Genova", "GE"), ("Venezia", "VE"), ("Verona", "VR"), ("Padova", "PD"), ("Brescia", "BS"), ("Bergamo", "BG"),
    ("Varese", "VA"), ("Monza", "MB"), ("Como", "CO"), ("Palermo", "PA"), ("Catania", "CT"), ("Bari", "BA"),
    ("Bolzano", "BZ"), ("Trento", "TN"), ("Perugia", "PG"), ("Ancona", "AN"), ("Pescara", "PE"), ("Cagliari", "CA"),
    ("Trieste", "TS"), ("Udine", "UD"), ("Parma", "PR"), ("Modena", "MO"), ("Reggio Emilia", "RE"), ("Livorno", "LI"),
    ("Pisa", "PI"), ("Siena", "SI"), ("Salerno", "SA"), ("Lecce", "LE"), ("Taranto", "TA"), ("Reggio Calabria", "RC"),
    ("Messina", "ME"), ("Siracusa", "SR"), ("Sassari", "SS"), ("Aosta", "AO"),
]
# Further cities with pages of their own.
EXTRA_CITIES = [("Legnano", "MI"), ("Sesto San Giovanni", "MI"), ("Rozzano", "MI")]
# Provinces shown next to a province, nearest first.
NEARBY_PROVINCES = {
    "MI": ["MB", "VA", "CO", "BG", "PV", "LO"], "MB": ["MI", "CO", "LC", "BG", "VA"], "VA": ["MI", "CO", "MB"],
    "CO": ["MI", "VA", "LC", "MB"], "BG": ["MI", "BS", "LC", "MB"], "BS": ["BG", "MN", "VR"],
    "TO": ["CN", "AL", "NO", "VC"], "GE": ["SV", "SP", "AL"], "BO": ["MO", "FE", "RA", "PR"],
    "MO": ["BO", "RE", "PR"], "RE": ["MO", "PR", "MN"], "PR": ["RE", "MO", "PC"], "FI": ["PI", "PO", "SI", "AR"],
    "PI": ["FI", "LI", "LU"], "SI": ["FI", "AR", "GR"], "VE": ["PD", "TV", "RO"], "PD": ["VE", "VI", "TV", "RO"],
    "VR": ["VI", "PD", "BS", "MN"], "TS": ["UD", "GO"], "UD": ["TS", "PN"], "RM": ["LT", "FR", "VT", "RI"],
    "NA": ["SA", "CE", "AV"], "SA": ["NA", "AV"], "BA": ["TA", "BT", "BR"], "PA": ["TP", "AG", "CT"],
    "CT": ["SR", "ME", "RG", "PA"], "CA": ["SS", "OR", "NU"],
}
# Services with pages per city, in link order.
LOCAL_SERVICES = [
    ("acquisto-prima-casa", "Acquisto prima casa"), ("acquisto-casa-con-mutuo", "Acquisto con mutuo"),
    ("preliminare-compravendita", "Compromesso casa"), ("compravendita-immobiliare", "Compravendita / rogito"),
    ("mutuo", "Mutuo"), ("successione-ereditaria", "Successione"), ("testamento", "Testamento"),
    ("costituzione-srl", "Costituzione SRL"), ("procura", "Procura notarile"), ("donazione", "Donazione"),
    ("copia-conforme", "Copia conforme"), ("autentica-copia", "Autentica di copia"),
    ("vendita-box-garage", "Vendita box / garage"),
]
# Pages that always exist, and the slugs of the four macro areas.
STATIC_PATHS = ["/", "/notai", "/quanto-costa", "/chi-siamo", "/contatti", "/area-notai", "/privacy-policy",
                "/cookie-policy", "/note-legali", "/credits"]
MACRO_SLUGS = ["atti-immobiliari", "famiglia-e-successioni", "diritto-societario", "consulenza-e-altri-atti"]
CITY_MIN, LOCAL_MIN, URLS_PER_DOCUMENT = 2, 3, 50_000


def capitals_frame(spark: SparkSession) -> DataFrame:
    rows = [(name, code, pos) for pos, (name, code) in enumerate(CAPITALS)]
    return spark.createDataFrame(rows, "name string, province string, pos int")


def extras_frame(spark: SparkSession) -> DataFrame:
    rows = [(name, code, len(CAPITALS) + pos) for pos, (name, code) in enumerate(EXTRA_CITIES)]
    return spark.createDataFrame(rows, "name string, province string, pos int")


def location_slug(name: Column, province: Column) -> Column:
    return F.concat(slugify(name), F.lit("-"), F.lower(province))


def parse_location_slug(slug: Column) -> tuple[Column, Column]:
    """(city name, province code) from a slug such as reggio-emilia-re; one word has no province."""
    parts = F.filter(F.split(slug, "-"), lambda p: p != "")
    many = F.size(parts) >= 2
    city = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " ")
    return (
        F.when(many, title_case(city)).otherwise(title_case(F.replace(slug, F.lit("-"), F.lit(" ")))),
        F.when(many, F.upper(F.element_at(parts, -1))).otherwise(F.lit("")),
    )


def city_path(name: Column, province: Column) -> Column:
    """Page of a city; without a province it is a search URL, which is not indexable."""
    slug = slugify(name)
    return F.when(
        (F.coalesce(province, F.lit("")) != "") & (slug != ""), F.concat(F.lit("/notai/"), F.lower(F.trim(province)), F.lit("/"), slug)
    ).otherwise(F.when(F.trim(name) != "", F.concat(F.lit("/notai?comune="), F.url_encode(F.trim(name)))).otherwise("/notai"))


def province_path(code: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(code)), "[^a-z]", "").substr(1, 2)
    return F.when(clean != "", F.concat(F.lit("/notai/provincia/"), clean)).otherwise("/notai")


def _capital_keys(capitals: DataFrame) -> DataFrame:
    """Every key under which a capital is found: its slug, slug plus province, province code."""
    keys = F.array(slugify(F.col("name")), location_slug(F.col("name"), F.col("province")), F.lower("province"))
    exploded = capitals.select(F.explode(keys).alias("key"), F.struct("pos", "name", "province").alias("c"))
    return exploded.groupBy("key").agg(F.min("c").alias("c")).select(
        "key", F.col("c.name").alias("capital_name"), F.col("c.province").alias("capital_province")
    )


def infer_province(cities: DataFrame, capitals: DataFrame, extras: DataFrame) -> DataFrame:
    """Add `province` to (comune, district): a known city gives its own; otherwise the longest capital name
    of four letters or more inside the city and district names, the earlier capital on equal length.

    Containment is an equality join of the capital names with the windows of distinct (comune, district) texts that
    are as long as some capital name."""
    named = cities.withColumn("_d", F.coalesce("district", F.lit("")))
    distinct = named.select("comune", "_d").distinct().withColumn("key", slugify(F.col("comune")))
    known = _capital_keys(capitals).select("key", F.col("capital_province").alias("_a"))
    listed = extras.select(slugify(F.col("name")).alias("key"), F.col("province").alias("_b")).dropDuplicates(["key"])
    needles = capitals.select(slugify(F.col("name")).alias("needle"), "province", "pos").filter("length(needle) >= 4")
    texts = distinct.select("comune", "_d", slugify(F.concat_ws(" ", F.trim("comune"), F.col("_d"))).alias("_blob"))
    substrings = with_windows(texts, "_blob", needles, "needle")
    inside = substrings.join(needles, "needle").groupBy("comune", "_d").agg(
        F.max_by("province", F.struct(F.length("needle"), -F.col("pos"))).alias("_c")
    )
    resolved = (
        distinct.join(known, "key", "left").join(listed, "key", "left").join(inside, ["comune", "_d"], "left")
        .select("comune", "_d", F.coalesce("_a", "_b", "_c").alias("province"))
    )
    return named.join(resolved, ["comune", "_d"], "left").drop("_d")


def city_aggregates(providers: DataFrame, min_providers: int) -> DataFrame:
    return (
        published(providers).filter(F.coalesce("comune", F.lit("")) != "")
        .groupBy(F.lower("comune").alias("city_key"))
        .agg(F.min("comune").alias("comune"), F.max(F.nullif("district", F.lit(""))).alias("district"), F.count("*").alias("providers"))
        .filter(F.col("providers") >= min_providers)
    )


def city_inventory(providers: DataFrame, capitals: DataFrame, extras: DataFrame, min_providers: int = CITY_MIN) -> DataFrame:
    """Cities with pages: the listed ones and every comune with enough providers and a known province, one
    row per path, the larger count winning."""
    listed = capitals.unionByName(extras).select(
        F.col("name"), "province", F.lit(0).cast("bigint").alias("providers"), F.lit(1).alias("_listed")
    )
    counted = infer_province(city_aggregates(providers, min_providers), capitals, extras).filter("province IS NOT NULL").select(
        title_case(F.col("comune")).alias("name"), "province", "providers", F.lit(0).alias("_listed")
    )
    keys = _capital_keys(capitals).select("key", "capital_name")
    both = listed.unionByName(counted).withColumn("key", slugify(F.col("name"))).join(keys, "key", "left").withColumn(
        "path", city_path(F.coalesce("capital_name", "name"), F.col("province"))
    ).withColumn("location_slug", location_slug(F.col("name"), F.col("province"))).drop("key", "capital_name")
    # A few thousand rows at most (one per comune of a country), read by several URL lists.
    return reuse(top_per_group(both, ["path"], [F.col("providers").desc(), F.col("_listed"), F.col("name")], 1).drop("_listed"))


def province_rollup(cities: DataFrame, capitals: DataFrame) -> DataFrame:
    names = capitals.groupBy(F.upper("province").alias("code")).agg(F.min_by("name", "pos").alias("_name"))
    return (
        cities.groupBy(F.upper("province").alias("code"))
        .agg(F.count("*").alias("cities"), F.sum("providers").alias("providers"))
        .join(names, "code", "left")
        .select("code", F.coalesce("_name", "code").alias("name"), province_path(F.col("code")).alias("path"), "cities", "providers")
    )


# URL inventory

def _urls(df: DataFrame, path: Column, bucket: str, freq: Column | str, priority: Column, lastmod: Column | None = None) -> DataFrame:
    return df.select(
        path.alias("path"), F.lit(bucket).alias("bucket"),
        (freq if isinstance(freq, Column) else F.lit(freq)).alias("changefreq"), priority.alias("priority"),
        (lastmod if lastmod is not None else F.lit(None)).cast("string").alias("lastmod"),
    )


def static_urls(spark: SparkSession) -> DataFrame:
    paths = spark.createDataFrame([(p,) for p in STATIC_PATHS], "path string")
    path = F.col("path")
    return _urls(
        paths, path, "static", F.when(path == "/", "daily").otherwise("weekly"),
        F.when(path == "/", 1.0).when(path.isin("/notai", "/quanto-costa"), 0.9).otherwise(0.5),
    )


def province_urls(provinces: DataFrame) -> DataFrame:
    return _urls(provinces, F.col("path"), "province", "weekly", F.lit(0.85))


def city_urls(cities: DataFrame, capitals: DataFrame) -> DataFrame:
    """The top priority goes to every city of a listed province, not to capitals alone."""
    listed = capitals.select(F.upper("province").alias("_code")).distinct().withColumn("_listed", F.lit(True))
    rows = cities.join(listed, F.upper("province") == F.col("_code"), "left")
    return _urls(
        rows, F.col("path"), "citta", "weekly",
        F.when(F.col("_listed"), 0.95).when(F.col("providers") >= 10, 0.85).otherwise(0.75),
    )


def service_urls(services: DataFrame) -> DataFrame:
    macros = services.sparkSession.createDataFrame([(s,) for s in MACRO_SLUGS], "slug string")
    top = [slug for slug, _ in LOCAL_SERVICES]
    return _urls(macros, F.concat(F.lit("/quanto-costa/categoria/"), "slug"), "servizi", "weekly", F.lit(0.85)).unionByName(
        _urls(services, F.concat(F.lit("/quanto-costa/"), "slug"), "servizi", "weekly",
              F.when(F.col("slug").isin(top), 0.9).otherwise(0.75))
    )


def cross_city_service(cities: DataFrame, min_providers: int = LOCAL_MIN) -> DataFrame:
    """Every city with enough providers once per local service; the service list is a literal."""
    services = F.array(*[F.lit(slug) for slug, _ in LOCAL_SERVICES])
    rows = cities.filter((F.col("providers") >= min_providers) | (F.col("providers") == 0))
    return rows.withColumn("service_slug", F.explode(services))


def local_urls(cities: DataFrame) -> DataFrame:
    """cities: `city_inventory` made with the local minimum."""
    rows = cross_city_service(cities)
    path = F.concat(F.lit("/quanto-costa/"), "location_slug", F.lit("/"), "service_slug", F.lit("/notai"))
    return _urls(rows, path, "local", "weekly", F.when(F.col("providers") >= 10, 0.65).otherwise(0.55))


def provider_urls(rows: DataFrame) -> DataFrame:
    """rows: `enriched_first` with slug, is_enriched and updated_at."""
    return _urls(
        rows, F.concat(F.lit("/notai/"), F.lower("slug")), "notai", "monthly",
        F.when(F.col("is_enriched"), 0.6).otherwise(0.35), F.col("updated_at"),
    )


def url_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def crawl_report(urls: DataFrame, samples: int = 5) -> DataFrame:
    """Per bucket: URLs, share of all in percent, first paths."""
    counts = urls.groupBy("bucket").agg(F.count("*").alias("urls"))
    total = F.sum("urls").over(Window.partitionBy(F.lit(0)))  # over one row per bucket
    first = top_per_group(urls.select("bucket", "path"), ["bucket"], [F.col("path")], samples).groupBy("bucket").agg(
        F.array_join(F.array_sort(F.collect_list("path")), " ").alias("samples")
    )
    return counts.withColumn("_all", total).join(first, "bucket").select(
        "bucket", "urls", F.round(F.col("urls") * 100 / F.col("_all"), 1).alias("share_pct"), "samples"
    )


def _one_decimal(value: Column) -> Column:
    """One decimal by the exact binary value, so that 0.85 prints as 0.8 and 0.65 as 0.7."""
    low = F.floor(value * 10) / 10
    high = (F.floor(value * 10) + 1) / 10
    return F.format_string("%.1f", F.when(value - low < high - value, low).otherwise(high))


def url_element(site: str) -> Column:
    """One <url> element."""
    lastmod = F.when(
        F.coalesce("lastmod", F.lit("")) != "",
        F.concat(F.lit("\n    <lastmod>"), xml_escape(F.col("lastmod").substr(1, 10)), F.lit("</lastmod>")),
    ).otherwise("")
    priority = F.when(F.col("priority").isNotNull(), _one_decimal(F.col("priority"))).otherwise(
        F.when(F.col("path") == "/", "1.0").otherwise("0.6")
    )
    return F.concat(
        F.lit("  <url>\n    <loc>"), xml_escape(F.concat(F.lit(site), "path")), F.lit("</loc>"), lastmod,
        F.lit("\n    <changefreq>"), F.coalesce("changefreq", F.lit("weekly")), F.lit("</changefreq>\n    <priority>"),
        priority, F.lit("</priority>\n  </url>"),
    )


def sitemap_documents(urls: DataFrame, site: str, per_document: int = URLS_PER_DOCUMENT) -> DataFrame:
    """(bucket, part, shard, urls, xml): URL documents of at most `per_document` entries.

    Rows are spread by a hash of the path over as many parts as half-full documents need, then cut by row
    number inside each part: no sort or count ever runs over a whole bucket in one task."""
    counts = urls.groupBy("bucket").agg(F.count("*").alias("_n"))  # one row per bucket, a handful
    spread = urls.join(F.broadcast(counts), "bucket").withColumn(
        "part", F.pmod(F.xxhash64("path"), F.ceil(F.col("_n") * 2 / per_document))
    )
    place = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("path"))
    cut = spread.withColumn("_place", place).withColumn("shard", F.floor((F.col("_place") - 1) / per_document))
    body = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_place", url_element(site).alias("x")))), lambda e: e["x"]
    ), "\n")
    # The document frame of the sitemap format.
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    return cut.groupBy("bucket", "part", "shard").agg(
        F.count("*").alias("urls"), F.concat(F.lit(head), body, F.lit("\n</urlset>")).alias("xml")
    )


def write_documents(documents: DataFrame, folder: str) -> None:
    """One file per document, in folders by bucket, part and shard."""
    key = ["bucket", "part", "shard"]
    documents.select(*key, "xml").repartition(*key).write.partitionBy(*key).text(folder)


def sitemap_index(documents: DataFrame, site: str) -> DataFrame:
    """Index entries for the documents, one line of text per document."""
    path = F.concat(F.lit(site + "/sitemap-"), "bucket", F.lit("-"), "part", F.lit("-"), "shard", F.lit(".xml"))
    return documents.select("bucket", "part", "shard", F.concat(
        F.lit("  <sitemap>\n    <loc>"), xml_escape(path), F.lit("</loc>\n  </sitemap>")
    ).alias("entry"))


def changed_urls(providers: DataFrame, observations: DataFrame, site: str, per_notification: int = 10_000) -> DataFrame:
    """Distinct profile URLs of providers completed in a run, in order: url, and the notification it goes into, as a
    notification takes so many."""
    done = observations.filter("status = 'completed'").select("provider_id").distinct()
    url = F.concat(F.lit(site + "/notai/"), F.lower(F.trim("slug")))
    urls = providers.join(done, "provider_id", "left_semi").filter(F.coalesce(F.trim("slug"), F.lit("")) != "").select(url.alias("url")).distinct()
    placed = place_in_group(urls.withColumn("_all", F.lit(0)), ["_all"], [F.col("url")], "place")
    return placed.select("url", F.floor((F.col("place") - 1) / per_notification).alias("notification"))


def neighbour_cities(asked: DataFrame, capitals: DataFrame, neighbours: DataFrame, limit: int = 6) -> DataFrame:
    """Capitals next to each asked place (name, slug or province code): those of the neighbouring provinces in
    order, else the first other capitals. Places that are neither a capital nor a two-letter code have none.

    asked: place. neighbours: province, near (code), pos."""
    places = asked.select(F.trim("place").alias("place")).filter("place <> ''").distinct()
    resolved = places.withColumn("key", slugify(F.col("place"))).join(_capital_keys(capitals), "key", "left").select(
        "place", F.coalesce("capital_province", F.when(F.length("place") == 2, F.upper("place"))).alias("province")
    ).filter("province IS NOT NULL")
    by_code = capitals.groupBy("province").agg(F.min_by("name", "pos").alias("name"))
    near = resolved.join(neighbours.select("province", F.col("near"), F.col("pos").alias("_pos")), "province").join(
        by_code.select(F.col("province").alias("near"), "name"), "near"
    )
    first = top_per_group(near, ["place"], [F.col("_pos")], limit, "rank").select("place", "rank", "name", F.col("near").alias("near_province"))
    none = resolved.join(first.select("place").distinct(), "place", "left_anti")
    # The first capitals; for a place in the province of one of them, the first ones outside it.
    rows = capitals.select("pos", "name", F.col("province").alias("near_province"))
    head = top_per_group(rows.withColumn("_own", F.lit("")), ["_own"], [F.col("pos")], limit, "rank")  # at most `limit` rows
    own = F.broadcast(head.select(F.col("near_province").alias("_own")).distinct())
    outside = top_per_group(rows.join(own, F.col("near_province") != F.col("_own")), ["_own"], [F.col("pos")], limit, "rank")
    in_head = none.join(own, F.col("province") == F.col("_own"))
    others = none.join(own, F.col("province") == F.col("_own"), "left_anti").crossJoin(F.broadcast(head.drop("_own")))
    filled = in_head.join(F.broadcast(outside), "_own").select("place", "rank", "name", "near_province").unionByName(
        others.select("place", "rank", "name", "near_province"))
    return first.unionByName(filled)


def cross_links(cities: DataFrame, capitals: DataFrame, neighbours: DataFrame, limit_cities: int = 6, limit_services: int = 8) -> DataFrame:
    """Link rows of every city page (name, province): its province page, neighbouring capitals, top services."""
    base = cities.select("name", "province").distinct()
    province = base.select("name", "province", F.lit("province").alias("kind"), F.lit(0).cast("bigint").alias("rank"),
                           province_path(F.col("province")).alias("href"))
    near = neighbour_cities(base.select(F.col("province").alias("place")), capitals, neighbours, limit_cities)
    around = base.join(
        near.select(F.col("place").alias("province"), "rank", F.col("name").alias("near_name"), "near_province"), "province"
    ).select(
        "name", "province", F.lit("city").alias("kind"), "rank", city_path(F.col("near_name"), F.col("near_province")).alias("href")
    )
    services = F.array(*[F.lit(slug) for slug, _ in LOCAL_SERVICES[:limit_services]])
    local = base.select("name", "province", F.posexplode(services).alias("_p", "slug")).select(
        "name", "province", F.lit("service").alias("kind"), (F.col("_p") + 1).cast("bigint").alias("rank"),
        F.concat(F.lit("/quanto-costa/"), location_slug(F.col("name"), F.col("province")), F.lit("/"), "slug", F.lit("/notai")).alias("href"),
    )
    return province.unionByName(around).unionByName(local)


def neighbours_frame(spark: SparkSession) -> DataFrame:
    rows = [(code, near, pos) for code, nears in NEARBY_PROVINCES.items() for pos, near in enumerate(nears)]
    return spark.createDataFrame(rows, "province string, near string, pos int")


def list_item_jsonld(site: str) -> Column:
    """One list entry of structured data for a result row with place, full_name, slug, address, comune, cap,
    phone, lat, lng; missing fields are left out."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    geo = F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.struct(
        F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude")
    ))
    return F.to_json(F.struct(
        F.lit("ListItem").alias("@type"), F.col("place").alias("position"),
        F.struct(
            F.array(F.lit("LegalService"), F.lit("LocalBusiness")).alias("@type"), F.col("full_name").alias("name"),
            F.concat(F.lit(site + "/notai/"), F.lower(F.coalesce("slug", F.lit("")))).alias("url"),
            phone_e164(F.col("phone")).alias("telephone"),
            F.struct(
                F.lit("PostalAddress").alias("@type"), text("address").alias("streetAddress"), text("comune").alias("addressLocality"),
                text("cap").alias("postalCode"), F.lit("IT").alias("addressCountry"),
            ).alias("address"),
            geo.alias("geo"),
        ).alias("item"),
    ))
