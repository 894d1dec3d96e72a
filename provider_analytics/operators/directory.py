"""Directory search: per city, per point, per province, per name; profiles and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import RADIUS_STEPS_KM, distance_km, in_bbox
from . import nearbest, postings, ranking
from .filters import ilike_search, published, term_key
from .geojoin import nearest_within, neighbours, within
from .ranking import PAGE_SIZE
from .skew import place_in_group, settle, top_per_group
from .windows import with_windows


def services_count(providers: DataFrame, provider_services: DataFrame) -> DataFrame:
    counts = provider_services.groupBy("provider_id").agg(F.count("*").alias("services_count"))
    return providers.join(counts, "provider_id", "left").withColumn(
        "services_count", F.coalesce("services_count", F.lit(0).cast("bigint"))
    )


def best_review_summary(summaries: DataFrame) -> DataFrame:
    """The most reviewed source of each provider, the better rated one on a tie."""
    return top_per_group(
        summaries, ["provider_id"],
        [F.col("review_count").desc_nulls_last(), F.col("rating_avg").desc_nulls_last(), F.col("source")], 1,
    )


def provider_figures(provider_services: DataFrame, summaries: DataFrame) -> DataFrame:
    """What ranking needs to know of each provider that has anything: services, rating, reviews."""
    counts = provider_services.groupBy("provider_id").agg(F.count("*").alias("services_count"))
    best = best_review_summary(summaries).select("provider_id", "rating_avg", "review_count")
    return counts.join(best, "provider_id", "full")


def with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return rows.join(figures, "provider_id", "left").withColumns(
        {"services_count": F.coalesce("services_count", zero), "review_count": F.coalesce("review_count", zero)}
    )


def directory_rows(providers: DataFrame, provider_services: DataFrame, summaries: DataFrame) -> DataFrame:
    """Published providers with the figures that ranking uses."""
    return with_figures(published(providers), provider_figures(provider_services, summaries))


def city_key(column: Column) -> Column:
    """Requested city name, possibly a slug, as the key it is matched under."""
    return F.lower(F.trim(F.replace(column, F.lit("-"), F.lit(" "))))


def centroid(providers: DataFrame) -> DataFrame:
    """Mean position of the located published providers of each comune."""
    located = published(providers).filter("lat IS NOT NULL AND lng IS NOT NULL")
    return located.groupBy(F.lower("comune").alias("city_key")).agg(
        F.avg("lat").alias("center_lat"), F.avg("lng").alias("center_lng"), F.count("*").alias("located")
    )


def _with_score(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "relevance_score",
        ranking.relevance_score(F.col("rating_avg"), F.col("review_count"), F.col("services_count"), F.col("distance_km")),
    )


def _places(rows: DataFrame) -> DataFrame:
    return rows.select(
        "provider_id", "full_name", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng")
    )


def search_near_me(points: DataFrame, providers: DataFrame, figures: DataFrame, radius_km: int = 30, page: int = 1,
                   page_size: int = PAGE_SIZE) -> DataFrame:
    """All providers within the radius of each point (point_id, lat, lng) by relevance, one page.

    Points on one spot share one search; its page is then handed to each of them. Early pages read, in cells around
    the spot, only providers that can be on them; late ones number all providers around by one range sort."""
    spot = F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string"))
    asked = points.filter("lat IS NOT NULL AND lng IS NOT NULL")
    spots = asked.select(spot.alias("point_id"), "lat", "lng").distinct()
    places = with_figures(_places(published(providers)), figures)
    wanted, size = max(1, page), max(1, page_size)
    if wanted * size <= ranking.CUT_RANK:
        best, totals = nearbest.best_within(spots, places, radius_km, wanted * size)
        pages = ranking.page_of(best, totals, ["point_id"], wanted, size)
    else:
        scored = _with_score(within(spots, places, F.lit(float(radius_km))))
        pages = ranking.paginate(scored, ["point_id"], ranking.by_relevance(), wanted, size)
    return asked.select("point_id", spot.alias("_spot")).join(pages.withColumnRenamed("point_id", "_spot"), "_spot").drop("_spot")


def _in_district(lost: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the asked city, and rows whose district contains its name. The containment runs over distinct district
    names as an equality with their windows as long as an asked name, not as a pairwise scan. lost: search_id, city_key."""
    districts = rows.select("district").filter("district <> ''").distinct().withColumn("_lower", F.lower("district"))
    outer = lost.join(with_windows(districts, "_lower", lost.select("city_key"), "city_key"), "city_key").select("search_id", "city_key", "district")
    columns = ["search_id", "provider_id"]
    around = outer.withColumnRenamed("city_key", "_asked").join(rows, "district").filter(
        F.coalesce(F.col("city_key") != F.col("_asked"), F.lit(True))).select(*columns)
    return lost.join(rows, "city_key").select(*columns).unionByName(around)


def search_location(requests: DataFrame, providers: DataFrame, figures: DataFrame, gazetteer: DataFrame | None = None, page_size: int = PAGE_SIZE,
                    min_local: int = 8, min_total: int = 12) -> DataFrame:
    """City search for many requests at once.

    requests: comune, radius_km (null = automatic), page, and where visitors stand, near_lat and near_lng, if known.
    figures: `provider_figures`. gazetteer: city_key, center_lat, center_lng for cities without located providers.

    A city with enough providers is answered from the city alone. Otherwise the smallest radius step that yields
    enough is chosen; a city that cannot be placed falls back to its district. Where the radius has not set a
    distance it is measured from the visitor, else from the city's centre. Requests for one city share one search."""
    point = [F.col(c).cast("double") if c in requests.columns else F.lit(None).cast("double") for c in ("near_lat", "near_lng")]
    known = point[0].isNotNull() & point[1].isNotNull()
    keys = requests.select(
        city_key(F.col("comune")).alias("city_key"), F.col("radius_km").cast("int").alias("asked_km"),
        F.coalesce(F.col("page").cast("int"), F.lit(1)).alias("asked_page"), F.when(known, point[0]).alias("near_lat"), F.when(known, point[1]).alias("near_lng"),
    ).filter("city_key <> ''")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = keys.withColumn("search_id", F.concat_ws("|", "city_key", text("asked_km"), text("near_lat"), text("near_lng"))).distinct()
    live = published(providers)
    rows = live.select("provider_id", "full_name", F.lower("comune").alias("city_key"), "district", "lat", "lng")
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    found = rows.groupBy("city_key").agg(
        F.count("*").alias("exact_city_count"), F.avg(F.when(located, F.col("lat"))).alias("center_lat"), F.avg(F.when(located, F.col("lng"))).alias("center_lng"),
    )
    searches = keys.drop("asked_page").distinct().join(found, "city_key", "left")
    if gazetteer is not None:
        listed = gazetteer.select("city_key", F.col("center_lat").alias("_lat"), F.col("center_lng").alias("_lng"))
        searches = searches.join(listed, "city_key", "left").withColumn(
            "center_lng", F.when(F.col("center_lat").isNull(), F.col("_lng")).otherwise(F.col("center_lng"))
        ).withColumn("center_lat", F.coalesce("center_lat", "_lat")).drop("_lat", "_lng")
    searches = searches.withColumn("exact_city_count", F.coalesce("exact_city_count", F.lit(0).cast("bigint"))).withColumn(
        "mode",
        F.when(F.col("asked_km").isNull() & (F.col("exact_city_count") >= min_local), "comune")
        .when(F.col("center_lat").isNull(), "distretto").otherwise("raggio"),
    )
    places = rows.withColumnsRenamed({"lat": "place_lat", "lng": "place_lng", "city_key": "_city"})
    round_ = searches.filter("mode = 'raggio'").select(F.col("search_id").alias("point_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), "*")
    searches = settle(searches.join(_radius(round_, places, min_local, min_total), "search_id", "left"), "searches")

    # Candidates as (search, provider, distance where the radius sets it).
    unknown = F.lit(None).cast("double")
    own = searches.filter("mode <> 'distretto'").join(rows.select("city_key", "provider_id"), "city_key").select(
        "search_id", "provider_id", F.when(F.col("mode") == "raggio", F.lit(0.0)).alias("distance_km"))
    reached = searches.filter("mode = 'raggio'").select(
        F.col("search_id").alias("point_id"), F.col("center_lat").alias("lat"), F.col("center_lng").alias("lng"), "city_key", "radius_km")
    near = within(reached, places, F.col("radius_km"), ("city_key",)).filter(F.coalesce(F.col("_city") != F.col("city_key"), F.lit(True))).select(
        F.col("point_id").alias("search_id"), "provider_id", "distance_km")
    wide = _in_district(searches.filter("mode = 'distretto'").select("search_id", "city_key"), rows).withColumn("distance_km", unknown)
    # The pool holds what the order needs and is written once; everything else is joined to the rows of the pages.
    listed = with_figures(live, figures)
    brief = listed.select("provider_id", "full_name", F.lower("comune").alias("_city"), "lat", "lng", "rating_avg", "review_count", "services_count")
    pool = own.unionByName(near).unionByName(wide).join(brief, "provider_id").join(
        searches.select("search_id", "city_key", "center_lat", "center_lng", "near_lat", "near_lng"), "search_id")
    ref_lat, ref_lng = F.coalesce("near_lat", "center_lat"), F.when(F.col("near_lat").isNotNull(), F.col("near_lng")).otherwise(F.col("center_lng"))
    pool = _with_score(pool.withColumn("distance_km", F.coalesce("distance_km", distance_km(ref_lat, ref_lng, F.col("lat"), F.col("lng")))))
    pool = settle(pool.select("search_id", "provider_id", "full_name", "distance_km", "relevance_score", (F.col("_city") == F.col("city_key")).alias("_same")), "candidates")
    cover = pool.groupBy("search_id").agg(F.count("*").alias("_total"), F.bool_and("_same").alias("_same"))
    paged = ranking.paginate_by(pool.drop("_same"), ["search_id"], ranking.by_relevance(), keys.select("search_id", "asked_page"), page_size)
    about = searches.select("search_id", "city_key", "exact_city_count", "mode", "radius_km", "near_lat", "near_lng").join(cover, "search_id")
    scope = scope_label(F.col("mode"), F.col("exact_city_count"), F.col("_total"), F.col("_same"))
    found = paged.drop("full_name").join(about, "search_id").join(listed, "provider_id")
    return found.withColumn("scope", scope).drop("_total", "_same")


def _radius(searches: DataFrame, places: DataFrame, min_local: int, min_total: int) -> DataFrame:
    """search_id and the radius of each search around a point: as asked, else the smallest step with enough others.

    Whether a step has enough follows from the few nearest places: as many as are needed, and those of the own city
    that may be among them. A dense surrounding is never counted out."""
    steps = list(RADIUS_STEPS_KM)
    enough = max(min_local, min_total)
    needed = F.when(F.col("exact_city_count") == 0, F.lit(1)).otherwise(F.lit(enough) - F.col("exact_city_count"))
    free = searches.filter("asked_km IS NULL")
    near = nearest_within(free, places, enough + min_local, ["full_name", "provider_id"], F.lit(float(steps[-1])))
    near = near.join(free.select("point_id", "city_key"), "point_id").filter(F.coalesce(F.col("_city") != F.col("city_key"), F.lit(True)))
    counts = near.groupBy("point_id").agg(*[F.count_if(F.col("distance_km") <= s).alias(f"_{s}") for s in steps])
    chosen = F.coalesce(F.col("asked_km"), *[F.when(F.col(f"_{s}") >= needed, F.lit(s)) for s in steps], F.lit(steps[-1]))
    return searches.join(counts, "point_id", "left").select("search_id", chosen.alias("radius_km"))


def scope_label(mode: Column, exact: Column, total: Column, same_city: Column) -> Column:
    """What the answer covers: the comune, a radius around it, or its district."""
    return (
        F.when(mode == "comune", "comune")
        .when(mode == "distretto", F.when(total > exact, "distretto").otherwise("comune"))
        .otherwise(F.when((exact > 0) & F.coalesce(same_city, F.lit(True)), "comune").otherwise("raggio"))
    )


def scope_note(label: Column, scope: Column, exact: Column, radius: Column) -> Column:
    """Why the answer goes beyond the comune, in words; empty when it does not."""
    # The three messages.
    place, km = F.trim(label), radius.cast("string")
    return (
        F.when(place == "", "")
        .when(scope == "distretto", "Pochi risultati nel comune: mostriamo anche studi del distretto notarile.")
        .when((scope == "raggio") & radius.isNotNull() & (exact <= 0),
              F.concat(F.lit("Nessun notaio a "), place, F.lit(": abbiamo esteso la ricerca a "), km, F.lit(" km.")))
        .when((scope == "raggio") & radius.isNotNull(),
              F.concat(F.lit("Pochi studi a "), place, F.lit(": ricerca estesa a "), km, F.lit(" km.")))
        .otherwise("")
    )


def exact_union_nearby(exact: DataFrame, nearby: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the city at distance zero, then rows from the radius that are not among them."""
    zero = exact.withColumn("distance_km", F.lit(0.0))
    rest = nearby.join(exact.select(*key), key, "left_anti")
    return zero.unionByName(rest.select(*zero.columns))


def nearby_with_fallback(providers: DataFrame, k: int = 6) -> DataFrame:
    """Others worth showing next to each published provider: the nearest, else the same comune, else a
    comune whose district contains this one's. The first tier that has anyone wins, per provider."""
    live = published(providers)
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    geo = neighbours(live, k).withColumn("tier", F.lit("geo"))
    # Nobody is near a provider without a position, or near the only one that has a position.
    count = live.agg(F.count_if(located).alias("_located"))  # one row
    todo = live.crossJoin(F.broadcast(count)).filter(~located | (F.col("_located") < 2)).select(
        "provider_id", F.lower("comune").alias("_city"), "district"
    )
    listed = live.select(
        F.col("provider_id").alias("neighbour_id"), F.col("full_name").alias("neighbour_name"),
        F.lower("comune").alias("_city"), "district", F.when(located, 0).otherwise(1).alias("_unlocated"),
    )
    order = [F.col("_unlocated"), F.col("neighbour_name"), F.col("neighbour_id")]

    def shared_list(key: str, name: str) -> DataFrame:
        """Everyone with one key shares one list of k+1 candidates."""
        first = top_per_group(listed.filter(F.coalesce(F.col(key), F.lit("")) != ""), [key], order, k + 1, "place")
        return first.groupBy(key).agg(F.transform(
            F.array_sort(F.collect_list(F.struct("place", "neighbour_id"))), lambda n: n["neighbour_id"]
        ).alias(name))

    # One row for each city and district on the right, so a crowded one splits on the left as it needs to.
    listed_for = todo.join(shared_list("_city", "_in_city"), "_city", "left").join(district_lists(listed, order, k), "district", "left")
    others = lambda c: F.slice(F.filter(F.coalesce(F.col(c), F.array().cast("array<bigint>")),
                                        lambda n: n != F.col("provider_id")), 1, k)
    fallen = listed_for.select("provider_id", others("_in_city").alias("_a"), others("_in_district").alias("_b")).withColumn(
        "tier", F.when(F.size("_a") > 0, "comune").otherwise("distretto")
    ).select("provider_id", "tier", F.posexplode(F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.col("_b"))).alias("_pos", "neighbour_id"))
    return geo.unionByName(fallen.select(
        "provider_id", "neighbour_id", F.lit(None).cast("double").alias("distance_km"),
        (F.col("_pos") + 1).cast("bigint").alias("place"), "tier",
    ))


def district_lists(listed: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k+1 providers of all districts whose name contains the given district's name. Containment is an
    equality with windows of the distinct names; each name brings its own short list."""
    names = listed.select("district").filter("district <> ''").distinct()
    asked = names.withColumn("_part", F.lower("district"))
    held = names.select(F.col("district").alias("_outer"), F.lower("district").alias("_lower"))
    pairs = asked.join(with_windows(held, "_lower", asked, "_part"), "_part").select("district", "_outer")
    first = top_per_group(listed.filter("district <> ''"), ["district"], order, k + 1).withColumnRenamed("district", "_outer")
    best = top_per_group(pairs.join(first, "_outer"), ["district"], order, k + 1, "place")
    return best.groupBy("district").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "neighbour_id"))), lambda n: n["neighbour_id"]
    ).alias("_in_district"))


def best_service_match(provider_services: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per provider the best of its declared services among the wanted ones (service_id, match_kind):
    exact before related, then confidence."""
    declared = provider_services.join(wanted, "service_id")
    return top_per_group(
        declared, ["provider_id"],
        [F.col("match_kind") != "exact", F.col("confidence").desc_nulls_last(), F.col("service_id"), F.col("source")], 1,
    )


def rank_declared(df: DataFrame, city: str = "", limit: int = 12) -> DataFrame:
    """Declared match first, then the asked comune, then located providers, then name."""
    kind = F.when(F.col("match_kind") == "exact", 0).when(F.col("match_kind") == "related", 1).otherwise(2)
    order = [kind]
    if city:
        order += [F.lower("comune") != city.lower(), ~F.contains(F.lower("comune"), F.lit(city.lower()))]
    return df.orderBy(*order, F.col("lat").isNull() | F.col("lng").isNull(), "full_name", "provider_id").limit(limit)


def search_by_name(providers: DataFrame, provider_services: DataFrame, wanted: DataFrame, term: str = "",
                   city: str = "", limit: int = 12) -> DataFrame:
    """Text and city search over the directory with the declared service as first sort key."""
    place = city.replace("-", " ").strip()
    rows = ilike_search(published(providers), term, ["full_name", "comune", "address"])
    rows = ilike_search(rows, place, ["comune", "district"])
    matched = best_service_match(provider_services, wanted).select("provider_id", "match_kind", F.col("source").alias("match_source"))
    return rank_declared(rows.join(matched, "provider_id", "left"), place, limit)


def searches_by_name(requests: DataFrame, providers: DataFrame, provider_services: DataFrame, wanted: DataFrame, limit: int = 12) -> DataFrame:
    """Text and city search for a frame of requests: request_id, provider_id, match_kind, place.

    requests: request_id, term, city, service (null or blank: not asked). wanted: service, service_id, match_kind, the
    services that answer each service asked for. A term is looked for in name, comune and address, a city in comune and
    district; a request with neither asks for the whole directory. Declared match first, then the asked comune, then
    located providers, then name. Equal requests are searched once."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = published(providers).select(
        "provider_id", "full_name", low("full_name").alias("_name"), low("comune").alias("_comune"), low("district").alias("_district"),
        low("address").alias("_address"), (F.col("lat").isNull() | F.col("lng").isNull()).alias("_away"))
    service = F.when(F.trim(F.coalesce("service", F.lit(""))) != "", F.col("service"))
    place = term_key(F.replace(F.coalesce("city", F.lit("")), F.lit("-"), F.lit(" ")))
    asked = requests.select("request_id", term_key(F.col("term")).alias("term"), place.alias("city"), F.coalesce(service, F.lit("")).alias("service"))
    best = top_per_group(
        provider_services.join(wanted, "service_id"), ["service", "provider_id"],
        [F.col("match_kind") != "exact", F.col("confidence").desc_nulls_last(), F.col("service_id"), F.col("source")], 1,
    ).select("service", "provider_id", "match_kind", F.when(F.col("match_kind") == "exact", 0).when(F.col("match_kind") == "related", 1).otherwise(2).alias("_declared"))
    best = settle(best, "declared")

    # Tiers: how the service is declared (exact, related, not), and where the city is (the comune, in it, in the district only).
    number = lambda c, none, n: F.explode(F.when(F.col(c) == "", F.array(F.lit(none))).otherwise(F.array(*map(F.lit, range(n)))))
    search = ["term", "city", "service"]
    tiers = asked.select(*search).distinct().withColumn("_kind", number("service", 2, 3)).withColumn("_level", number("city", 0, 3))
    tiers = tiers.withColumn("tier", F.col("_kind") * 3 + F.col("_level"))
    city, level, none = F.col("city"), F.col("_level"), F.array().cast("array<string>")
    by_city = F.when(city == "", none).when(level == 0, F.array(F.concat(F.lit("=:"), city))).when(
        level == 1, postings.asked_pieces(city, "c:")).otherwise(postings.asked_pieces(city, "d:"))
    declared_key = F.concat(F.lit("s:"), F.col("_kind").cast("string"), F.lit(":"), F.col("service"))
    keys = F.concat(postings.asked_pieces(F.col("term"), "t:"), by_city, F.when(F.col("_kind") < 2, F.array(declared_key)).otherwise(none))
    keyed = tiers.select(*search, "tier", F.explode(F.when(F.size(keys) > 0, keys).otherwise(F.array(F.lit("*")))).alias("key"))
    wanted_keys = settle(keyed, "asked-keys")
    distinct = wanted_keys.select("key").distinct()

    texts = [postings.listed_pieces(rows, "provider_id", F.col(text), "t:", distinct) for text in ("_name", "_comune", "_address")]
    plain = rows.select(F.explode(F.array(F.concat(F.lit("=:"), "_comune"), F.lit("*"))).alias("key"), "provider_id").unionByName(
        best.join(rows.select("provider_id"), "provider_id").select(
            F.concat(F.lit("s:"), F.col("_declared").cast("string"), F.lit(":"), F.col("service")).alias("key"), "provider_id"))
    entries = texts[0].unionByName(texts[1]).unionByName(texts[2]).distinct()
    for text, space in (("_comune", "c:"), ("_district", "d:")):
        entries = entries.unionByName(postings.listed_pieces(rows, "provider_id", F.col(text), space, distinct))
    entries = entries.unionByName(plain.join(distinct, "key", "left_semi"))

    def test(df: DataFrame) -> DataFrame:
        term, has = F.col("term"), F.contains(F.col("_comune"), city)
        equal = F.col("_comune") == city
        fits = F.contains("_name", term) | F.contains("_comune", term) | F.contains("_address", term)
        there = (city == "") | F.when(level == 0, equal).when(level == 1, has & ~equal).otherwise(F.contains("_district", city) & ~has)
        declared = df.filter(fits & there).join(best.select("service", "provider_id", "_declared"), ["service", "provider_id"], "left")
        return declared.filter(F.coalesce("_declared", F.lit(2)) == F.col("_kind"))

    order = [F.col("_away"), F.col("full_name"), F.col("provider_id")]
    found = postings.first_matches(tiers, wanted_keys, entries, rows, "provider_id", search, order, test, limit)
    kinds = found.join(best.select("service", "provider_id", "match_kind"), ["service", "provider_id"], "left")
    return asked.join(kinds, search).select("request_id", "provider_id", "match_kind", "place")


def rank_choices(df: DataFrame, group: list[str], auto_select: int = 10) -> DataFrame:
    """Order of offered providers per request: ticked, declared match, same city, distance, name. A request
    with few choices and none ticked has all of them ticked.

    Every row is numbered by one range sort, so the longest list needs no task of its own."""
    kind = F.when(F.col("match_kind") == "exact", 0).when(F.col("match_kind") == "related", 1).otherwise(2)
    selected = F.coalesce("selected", F.lit(False))
    rows = df.withColumns({"_kind": kind, "_far": F.coalesce("distance_km", F.lit(9999.0)), "_city": F.coalesce("same_city", F.lit(False)), "_on": selected})
    order = [F.col("_on").desc(), F.col("_kind"), F.col("_city").desc(), F.col("_far"), F.col("full_name"), F.col("provider_id")]
    ranked = place_in_group(rows, group, order, "place")
    lists = rows.groupBy(*group).agg(F.count("*").alias("choices"), F.bool_or("_on").alias("_any"))
    return ranked.join(lists, group).withColumn(
        "ticked", F.col("_on") | (~F.col("_any") & (F.col("choices") <= auto_select))
    ).drop("_kind", "_far", "_city", "_on", "_any")


def merge_candidates(located: DataFrame, declared: DataFrame, selected: DataFrame) -> DataFrame:
    """One row per (request_id, provider_id) out of three lists. Where the located list of a request has
    rows, declared providers outside it are left out; ticked ones always stay."""
    key = ["request_id", "provider_id"]
    has_located = located.select("request_id").distinct().withColumn("_has", F.lit(True))
    full = (
        located.withColumn("_located", F.lit(True))
        .join(declared.withColumn("_declared", F.lit(True)), key, "full")
        .join(selected.select(*key).distinct().withColumn("selected", F.lit(True)), key, "full")
        .join(has_located, "request_id", "left")
    )
    keep = F.coalesce("_located", F.lit(False)) | F.coalesce("selected", F.lit(False)) | F.col("_has").isNull()
    return full.filter(keep).withColumn("selected", F.coalesce("selected", F.lit(False))).drop("_located", "_declared", "_has")


def search_province(cities: DataFrame, providers: DataFrame, page: int = 1, page_size: int = 36) -> DataFrame:
    """Providers of all listed cities (province, name) of each province in name order, one page."""
    keys = cities.select("province", F.lower("name").alias("city_key")).distinct()
    rows = published(providers).withColumn("city_key", F.lower("comune")).join(keys, "city_key")
    return ranking.paginate(rows, ["province"], [F.col("full_name"), F.col("provider_id")], page, page_size)


def first_n_map_points(page: DataFrame, group: list[str], page_size: int = PAGE_SIZE, limit: int = 60) -> DataFrame:
    """Map markers of a result page. The number is the place in the list, so rows that cannot be drawn
    leave gaps; `page` needs place and page."""
    marked = page.withColumn("marker", F.col("place")).filter(
        F.col("lat").isNotNull() & F.col("lng").isNotNull() & in_bbox(F.col("lat"), F.col("lng"))
    )
    return top_per_group(marked, group, [F.col("marker")], limit)


def enriched_first(providers: DataFrame, updated_at: str, limit: int | None = None) -> DataFrame:
    """Published providers with a slug, those with a website or a place id first, newest first; all unless a limit is
    given."""
    enriched = (F.coalesce("website", F.lit("")) != "") | (F.coalesce("place_id", F.lit("")) != "")
    rows = published(providers).filter(F.coalesce("slug", F.lit("")) != "").withColumn("is_enriched", enriched)
    ordered = rows.orderBy(F.col("is_enriched").desc(), F.col(updated_at).desc_nulls_last(), "full_name", "provider_id")
    return ordered if limit is None else ordered.limit(limit)


def provider_profile(providers: DataFrame, resolved_services: DataFrame, summaries: DataFrame, reviews: DataFrame,
                     near: DataFrame, max_services: int = 10) -> DataFrame:
    """One wide row per published provider: services, rating, latest reviews, neighbours. Every list is
    bounded (10 services, 5 reviews, 6 neighbours), so no row grows with the data."""
    services = top_per_group(
        resolved_services, ["provider_id"],
        [F.col("confidence").desc_nulls_last(), F.col("priority"), F.col("name"), F.col("service_id")], max_services, "place",
    ).groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("place", "slug"))).alias("_s"))
    latest = reviews.groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("place", "review_id"))).alias("_r"))
    around = near.groupBy("provider_id").agg(F.array_sort(F.collect_list(F.struct("place", "neighbour_id"))).alias("_n"))
    out = published(providers)
    for part in (services, best_review_summary(summaries).select("provider_id", "rating_avg", "review_count"), latest, around):
        out = out.join(part, "provider_id", "left")
    empty = F.array().cast("array<string>")
    listed = lambda c, f: F.coalesce(F.transform(c, lambda x: x[f].cast("string")), empty)
    return out.withColumn("services", listed("_s", "slug")).withColumn("latest_reviews", listed("_r", "review_id")).withColumn(
        "neighbours", listed("_n", "neighbour_id")
    ).drop("_s", "_r", "_n")


def reverse_city(points: DataFrame, centroids: DataFrame, digits: int = 2) -> DataFrame:
    """Nearest city centre for each coordinate cell, looked up once per cell."""
    cell = points.select(F.round("lat", digits).alias("lat"), F.round("lng", digits).alias("lng")).filter(
        "lat IS NOT NULL AND lng IS NOT NULL"
    ).distinct().withColumn("point_id", F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string")))
    places = centroids.select("city_key", F.col("center_lat").alias("place_lat"), F.col("center_lng").alias("place_lng"))
    near = nearest_within(cell, places, 1, ["city_key"])
    return cell.join(near, "point_id").select("lat", "lng", "city_key", "distance_km")
