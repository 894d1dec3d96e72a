"""Service taxonomy and price benchmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import json_len
from ..functions.text import blank_to_null, normalize_query
from .skew import place_in_group, top_per_group

# Raw category (lower case) to macro area; the last area is the default.
CATEGORY_GROUPS = {
    "atti immobiliari": "Atti immobiliari",
    "casa": "Atti immobiliari",
    "diritto di famiglia": "Famiglia e successioni",
    "famiglia e eredita": "Famiglia e successioni",
    "famiglia e eredità": "Famiglia e successioni",
    "diritto societario": "Diritto societario",
    "impresa": "Diritto societario",
    "consulenza": "Consulenza e altri atti",
    "atti notarili": "Consulenza e altri atti",
    "altri servizi": "Consulenza e altri atti",
    "enti e no profit": "Consulenza e altri atti",
}
DEFAULT_CATEGORY = "Consulenza e altri atti"

# Services that count as related when a provider's declared services are matched.
SERVICE_AFFINITY = {
    "acquisto-casa-con-mutuo": [
        "compravendita-immobiliare", "mutuo", "mutuo-ipotecario", "acquisto-prima-casa", "acquisto-seconda-casa",
        "preliminare-compravendita",
    ],
    "acquisto-prima-casa": [
        "compravendita-immobiliare", "acquisto-casa-con-mutuo", "acquisto-seconda-casa", "preliminare-compravendita",
    ],
    "acquisto-seconda-casa": [
        "compravendita-immobiliare", "acquisto-casa-con-mutuo", "acquisto-prima-casa", "preliminare-compravendita",
    ],
    "compravendita-immobiliare": [
        "acquisto-casa-con-mutuo", "acquisto-prima-casa", "acquisto-seconda-casa", "preliminare-compravendita", "mutuo",
    ],
    "preliminare-compravendita": ["compravendita-immobiliare", "acquisto-casa-con-mutuo", "acquisto-prima-casa"],
    "mutuo": ["mutuo-ipotecario", "acquisto-casa-con-mutuo", "compravendita-immobiliare"],
    "mutuo-ipotecario": ["mutuo", "acquisto-casa-con-mutuo"],
    "pratica-di-successione": ["testamento", "eredita", "atto-di-donazione"],
    "testamento": ["pratica-di-successione", "eredita"],
    "eredita": ["pratica-di-successione", "testamento"],
    "atto-di-donazione": ["pratica-di-successione"],
    "diritto-di-famiglia": ["convenzioni-matrimoniali", "separazione-dei-beni"],
    "convenzioni-matrimoniali": ["diritto-di-famiglia", "separazione-dei-beni"],
    "separazione-dei-beni": ["diritto-di-famiglia", "convenzioni-matrimoniali"],
}

# Request form profiles by words in the service's labels; the first hit counts.
INTAKE_RULES = [
    ("successione", ["successione", "eredita", "testamento"]),
    ("donazione", ["donazione"]),
    ("mutuo", ["mutuo", "ipoteca", "surroga"]),
    ("societa", ["srl", "societ", "start-up", "startup", "costituzione"]),
    ("procura", ["procura", "delega"]),
    ("autentica", ["autentica", "copia", "traduzione", "dichiarazione-sostitutiva"]),
    ("acquisto", ["acquisto", "compravendita", "preliminare", "casa", "immobile", "vendita"]),
]
DEFAULT_INTAKE = "generico"
RECORD_KINDS = ["service", "alias", "hub"]
TERM_TYPES = ["alias", "intent", "boost"]


def affinity_edges(spark: SparkSession) -> DataFrame:
    rows = [(slug, other) for slug, others in SERVICE_AFFINITY.items() for other in others]
    return spark.createDataFrame(rows, "slug string, related_slug string")


def seed_values(services: DataFrame, rows: list[tuple], schema: str, key: str) -> DataFrame:
    """Inline seed rows matched with the taxonomy by key. The seed is a literal of the program, so its size is fixed."""
    seed = services.sparkSession.createDataFrame(rows, schema)
    return services.join(F.broadcast(seed), key)


def macro_category(category: Column, groups: dict[str, str] | None = None, default: str = DEFAULT_CATEGORY) -> Column:
    table = groups or CATEGORY_GROUPS
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(lookup[F.lower(F.trim(category))], F.lit(default))


def intake_profile(labels: list[Column], rules=None, default: str = DEFAULT_INTAKE) -> Column:
    blob = F.lower(F.concat_ws(" ", *labels))
    out = F
    for profile, needles in rules or INTAKE_RULES:
        out = out.when(reduce(lambda a, b: a | b, [F.contains(blob, F.lit(n)) for n in needles]), profile)
    return out.otherwise(default)


def resolve_canonical(slugs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Requested slug to the service it stands for, following an alias once."""
    asked = taxonomy.select(
        F.col("slug").alias("requested_slug"), F.col("record_kind").alias("requested_kind"),
        F.col("is_searchable").alias("requested_searchable"), F.coalesce("canonical_id", "service_id").alias("_target"),
    )
    target = taxonomy.select("service_id", "slug", "name", "category", "priority", "is_searchable")
    return slugs.join(asked, "requested_slug").join(target, F.col("_target") == F.col("service_id")).drop("_target")


def best_benchmark(benchmarks: DataFrame, scope: str = "national") -> DataFrame:
    """The most trusted, then newest, benchmark of each service."""
    return top_per_group(
        benchmarks.filter(F.col("location_scope") == scope), ["service_id"],
        [F.col("confidence").desc_nulls_last(), F.col("updated_day").desc(), F.col("benchmark_id")], 1,
    )


_PRICES = ["price_min_cents", "price_avg_cents", "price_max_cents"]


def with_benchmark(services: DataFrame, benchmarks: DataFrame) -> DataFrame:
    best = best_benchmark(benchmarks).select(
        "service_id", *_PRICES, F.col("confidence").alias("price_confidence")
    )
    return services.join(best, "service_id", "left")


def searchable(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter(F.col("canonical_id").isNull() & F.col("is_searchable"))


def top_services(taxonomy: DataFrame, benchmarks: DataFrame, limit: int = 18) -> DataFrame:
    top = searchable(taxonomy).orderBy("priority", F.col("category").asc_nulls_last(), "name", "service_id").limit(limit)
    return with_benchmark(top, benchmarks)


def related_services(taxonomy: DataFrame, relations: DataFrame, limit: int = 6) -> DataFrame:
    """Per canonical searchable service: explicitly related ones by weight, then others of its category.

    The either-or condition is a union of two equality joins. Each category contributes its first limit+1
    members in sort order, and explicit relations their first `limit`, so no pair list grows with a category."""
    live = searchable(taxonomy).select("service_id", "name", "category", "priority")
    other = live.select(
        F.col("service_id").alias("related_id"), F.col("name").alias("related_name"),
        F.col("priority").alias("related_priority"), F.coalesce("category", F.lit("")).alias("_category"),
    )
    base = live.select("service_id", F.coalesce("category", F.lit("")).alias("_category"))
    order = [F.col("_kind"), F.col("weight").desc_nulls_last(), F.col("related_priority"), F.col("related_name"), F.col("related_id")]
    linked = (
        relations.groupBy("service_id", "related_id").agg(F.max("weight").alias("weight"))
        .join(base.select("service_id"), "service_id").join(other.drop("_category"), "related_id")
        .filter(F.col("service_id") != F.col("related_id")).withColumn("_kind", F.lit(0))
    )
    linked_top = top_per_group(linked, ["service_id"], order, limit)
    # A category list must outlast the service itself and every related one that sits in it.
    first = top_per_group(other, ["_category"], [F.col("related_priority"), F.col("related_name"), F.col("related_id")], 2 * limit + 1)
    same = (
        base.join(first, "_category").filter(F.col("service_id") != F.col("related_id")).drop("_category")
        .join(linked_top.select("service_id", "related_id"), ["service_id", "related_id"], "left_anti")
        .withColumn("weight", F.lit(None).cast("int")).withColumn("_kind", F.lit(1))
    )
    both = linked_top.select(*same.columns).unionByName(same)
    return top_per_group(both, ["service_id"], order, limit, "place").withColumn(
        "origin", F.when(F.col("_kind") == 0, "relation").otherwise("category")
    ).drop("_kind")


def related_services_priced(taxonomy: DataFrame, relations: DataFrame, benchmarks: DataFrame, limit: int = 6) -> DataFrame:
    """related_services with the label, category and best national prices of each related one."""
    about = with_benchmark(taxonomy.select("service_id", "slug", "name", "category"), benchmarks).withColumnRenamed("service_id", "related_id")
    return related_services(taxonomy, relations, limit).select("service_id", "related_id", "weight", "origin", "place").join(about, "related_id")


def service_list(taxonomy: DataFrame, benchmarks: DataFrame, contents: DataFrame, limit: int | None = None, short: int = 200) -> DataFrame:
    """Every record of the taxonomy - service, alias or hub - in one row for its editors: the slug an alias stands for,
    the mean national price, how many documents are asked for, and whether text (of more than `short` characters) and
    image are there. By priority, unknown last, then name, if a limit is given; without one in no order.

    contents: service_id (unique), required_documents (JSON list), html_content, image_url, content_status; a service
    may be missing there."""
    canonical = taxonomy.select(F.col("service_id").alias("canonical_id"), F.col("slug").alias("canonical_slug"))
    filled = lambda c, least: F.coalesce(F.length(F.trim(c)) > least, F.lit(False))
    listed = F.try_variant_get(F.try_parse_json("required_documents"), "$", "array<variant>")
    rows = with_benchmark(taxonomy, benchmarks).join(canonical, "canonical_id", "left").join(contents, "service_id", "left")
    rows = rows.select(
        "service_id", "slug", "name", "category", "record_kind", "is_searchable", "canonical_slug", "priority", "price_avg_cents",
        json_len(listed).alias("docs_count"), "content_status", filled("html_content", short).alias("has_html"), filled("image_url", 0).alias("has_image"),
    )
    return rows if limit is None else rows.orderBy(F.col("priority").asc_nulls_last(), "name", "service_id").limit(limit)


def related_or_category_fill(related: DataFrame, services: DataFrame, macro: Column, order: list[Column],
                             at_least: int = 3, limit: int = 6) -> DataFrame:
    """Related services of each service where there are enough, else others of its macro category."""
    rows = services.withColumn("_macro", macro)
    enough = related.groupBy("service_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= at_least)
    kept = related.join(enough.select("service_id"), "service_id", "left_semi").filter(F.col("place") <= limit).select(
        "service_id", "related_id", "place", F.lit("related").alias("origin")
    )
    poor = rows.join(enough.select("service_id"), "service_id", "left_anti").select("service_id", "_macro")
    first = top_per_group(rows, ["_macro"], order, limit + 1).select(
        "_macro", F.col("service_id").alias("related_id"), *[F.col(c).alias(f"_{c}") for c in ("priority", "name")]
    )
    filled = top_per_group(
        poor.join(first, "_macro").filter(F.col("service_id") != F.col("related_id")), ["service_id"],
        [F.col("_priority"), F.col("_name"), F.col("related_id")], limit, "place",
    ).select("service_id", "related_id", "place", F.lit("category").alias("origin"))
    return kept.unionByName(filled)


def provider_services_resolved(provider_services: DataFrame, taxonomy: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Declared services under their canonical service, the most trusted declaration of each, with prices."""
    target = taxonomy.select("service_id", F.coalesce("canonical_id", "service_id").alias("_target"))
    canonical = searchable_targets(taxonomy)
    mapped = provider_services.join(target, "service_id").drop("service_id").withColumnRenamed("_target", "service_id")
    best = top_per_group(
        mapped, ["provider_id", "service_id"], [F.col("confidence").desc_nulls_last(), F.col("source")], 1
    )
    return with_benchmark(best.join(canonical, "service_id"), benchmarks)


def searchable_targets(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter("is_searchable").select("service_id", "slug", "name", "category", "priority")


def expand_affinity(wanted: DataFrame, taxonomy: DataFrame, edges: DataFrame) -> DataFrame:
    """Asked slug to canonical service ids: its own as exact, those of its affine slugs as related."""
    canonical = taxonomy.select(F.col("slug").alias("_any"), F.coalesce("canonical_id", "service_id").alias("service_id"))
    own = wanted.select(F.col("slug")).distinct()
    exact = own.join(canonical, F.col("slug") == F.col("_any")).select("slug", "service_id", F.lit("exact").alias("match_kind"))
    by_slug = canonical.unionByName(
        taxonomy.filter("canonical_id IS NULL").select(F.col("slug").alias("_any"), "service_id")
    ).distinct()
    related = (
        own.join(edges, "slug").join(by_slug, F.col("related_slug") == F.col("_any"))
        .select("slug", "service_id").distinct()
        .join(exact.select("slug", "service_id"), ["slug", "service_id"], "left_anti")
        .withColumn("match_kind", F.lit("related"))
    )
    return exact.unionByName(related)


def search_terms_agg(taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms of each searchable service, one row a term: n_terms, place, term, term_type, weight, heaviest first. A
    service without terms has one row without a place."""
    order = [F.col("weight").desc_nulls_last(), F.col("term"), F.col("term_type")]
    placed = place_in_group(terms.select("service_id", "term", "term_type", "weight"), ["service_id"], order, "place")
    counts = terms.groupBy("service_id").agg(F.count("*").alias("n_terms"))
    return searchable(taxonomy).join(counts, "service_id", "left").join(placed, "service_id", "left").withColumn(
        "n_terms", F.coalesce("n_terms", F.lit(0).cast("bigint"))
    )


def category_prices(services: DataFrame, benchmarks: DataFrame, macro: Column) -> DataFrame:
    """Services and mean known price per macro category, rounded half up."""
    priced = with_benchmark(services, benchmarks).withColumn("category", macro)
    return priced.groupBy("category").agg(
        F.count("*").alias("services"),
        F.floor(F.avg(F.nullif(F.col("price_avg_cents"), F.lit(0))) + 0.5).cast("bigint").alias("avg_price_cents"),
    )


def group_by_category(services: DataFrame, default: str = "Altri servizi") -> DataFrame:
    """Services under their category, one row each: n_services of the category, place in priority order."""
    named = services.withColumn("category", F.coalesce(blank_to_null(F.col("category")), F.lit(default)))
    counts = named.groupBy("category").agg(F.count("*").alias("n_services"))
    placed = place_in_group(named, ["category"], [F.col("priority"), F.col("name"), F.col("service_id")], "place")
    return placed.join(counts, "category")


# Maintenance

def apply_aliases(taxonomy: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: slug, canonical_slug. Mapped rows become aliases that search does not offer."""
    target = taxonomy.select(F.col("slug").alias("canonical_slug"), F.col("service_id").alias("_target"))
    change = mapping.join(target, "canonical_slug").select("slug", "_target")
    hit = F.col("_target").isNotNull()
    return (
        taxonomy.join(change, "slug", "left")
        .withColumn("canonical_id", F.coalesce("_target", "canonical_id"))
        .withColumn("record_kind", F.when(hit, "alias").otherwise(F.col("record_kind")))
        .withColumn("is_searchable", ~hit & F.col("is_searchable"))
        .drop("_target")
    )


def mark_hubs(taxonomy: DataFrame, slugs: DataFrame) -> DataFrame:
    hit = F.coalesce("_hub", F.lit(False))
    return (
        taxonomy.join(slugs.select("slug").distinct().withColumn("_hub", F.lit(True)), "slug", "left")
        .withColumn("record_kind", F.when(hit, "hub").otherwise(F.col("record_kind")))
        .withColumn("is_searchable", ~hit & F.col("is_searchable"))
        .drop("_hub")
    )


def terms_from_synonyms(taxonomy: DataFrame, synonyms: DataFrame, weight: int = 90) -> DataFrame:
    """(service_id, synonym) rows to normalised alias terms on the canonical service, first wording kept."""
    target = taxonomy.select("service_id", F.coalesce("canonical_id", "service_id").alias("_target"))
    rows = (
        synonyms.join(target, "service_id").select(
            F.col("_target").alias("service_id"), F.trim("synonym").alias("term"),
            normalize_query(F.col("synonym")).alias("normalized_term"),
        ).filter("normalized_term <> ''")
    )
    first = rows.groupBy("service_id", "normalized_term").agg(F.min("term").alias("term"))
    return first.withColumn("term_type", F.lit("alias")).withColumn("weight", F.lit(weight))


def load_terms(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Terms by (service, type, normalised term); the greater weight and the new wording win."""
    key = ["service_id", "term_type", "normalized_term"]
    new = incoming.groupBy(*key).agg(F.max_by("term", F.struct("weight", "term")).alias("_term"), F.max("weight").alias("_weight"))
    return current.join(new, key, "full").select(
        *key, F.coalesce("_term", "term").alias("term"), F.greatest("weight", "_weight").alias("weight"),
        F.when(F.col("term").isNull(), "insert").when(F.col("_term").isNull(), "keep").otherwise("update").alias("action"),
    )


def load_relations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relation edges by (service, related, type); the new weight wins; no edge to itself."""
    key = ["service_id", "related_id", "relation_type"]
    new = incoming.filter("service_id <> related_id").groupBy(*key).agg(F.max("weight").alias("_weight"))
    return current.join(new, key, "full").select(*key, F.coalesce("_weight", "weight").alias("weight"))


def load_services(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Services by slug: new names and categories win where given, the lower priority number stays."""
    new = incoming.select(
        "slug", F.col("name").alias("_name"), F.col("category").alias("_category"), F.col("priority").alias("_priority")
    )
    return current.join(new, "slug", "full").select(
        "slug", F.coalesce(blank_to_null(F.col("_name")), F.col("name")).alias("name"),
        F.coalesce(F.col("_category"), F.col("category")).alias("category"),
        F.least("priority", "_priority").alias("priority"),
        F.when(F.col("service_id").isNull(), "insert").when(F.col("_name").isNull(), "keep").otherwise("update").alias("action"),
    )


def load_benchmarks(services: DataFrame, incoming: DataFrame, source: str) -> DataFrame:
    """Price rows in euro by service slug to integer cents, one per (service, scope), newest first."""
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    rows = incoming.join(services.select("slug", "service_id"), "slug").select(
        "service_id", "location_scope", cents("min_eur").alias("price_min_cents"), cents("avg_eur").alias("price_avg_cents"),
        cents("max_eur").alias("price_max_cents"), "valid_from", F.lit(source).alias("source"),
    )
    return top_per_group(
        rows, ["service_id", "location_scope", "source"], [F.col("valid_from").desc(), F.col("price_avg_cents")], 1
    )


def fill_defaults(taxonomy: DataFrame) -> DataFrame:
    """Labels and page texts for services that lack them; present values stay."""
    # The default texts.
    defaults = {
        "plain_language_name": F.col("name"),
        "user_intent": F.lit("Capire documenti, tempi e costo indicativo prima di contattare un notaio."),
        "seo_title": F.concat(F.initcap("name"), F.lit(": costo, documenti e preventivo notaio")),
        "seo_description": F.concat(
            F.lit("Guida al servizio notarile "), F.lower("name"),
            F.lit(": quando serve, documenti richiesti, prezzo indicativo e richiesta preventivo ai notai disponibili."),
        ),
        "remote_possible": F.lit(False),
        "requires_in_person": F.lit(True),
        "complexity": F.lit("media"),
    }
    known = set(taxonomy.columns)
    return taxonomy.withColumns(
        {c: F.coalesce(F.col(c), default) if c in known else default for c, default in defaults.items()}
    )


def taxonomy_fill(taxonomy: DataFrame, cards: DataFrame) -> DataFrame:
    """Fill description where a card has one, and synonyms only where there are none. cards: slug,
    description, synonyms."""
    new = cards.select("slug", F.col("description").alias("_description"), F.col("synonyms").alias("_synonyms"))
    return (
        taxonomy.join(new, "slug", "left")
        .withColumn("description", F.coalesce(F.nullif("_description", F.lit("")), F.col("description")))
        .withColumn("synonyms", F.when(F.size("synonyms") <= 0, F.coalesce("_synonyms", "synonyms")).otherwise(F.col("synonyms")))
        .drop("_description", "_synonyms")
    )


def taxonomy_checks(taxonomy: DataFrame, terms: DataFrame, relations: DataFrame) -> DataFrame:
    """Violations as (check, service_id): bad canonical links, unknown kinds and types, weights out of range."""
    target = taxonomy.select(F.col("service_id").alias("_id"), F.col("canonical_id").alias("_next"))
    linked = taxonomy.filter("canonical_id IS NOT NULL")
    to_target = linked.join(target, F.col("canonical_id") == F.col("_id"), "left")

    def bad(df: DataFrame, check: str, condition: Column) -> DataFrame:
        return df.filter(condition).select(F.lit(check).alias("check"), "service_id")

    parts = [
        bad(linked, "self", F.col("canonical_id") == F.col("service_id")),
        bad(to_target, "dangling", F.col("_id").isNull()),
        bad(to_target, "chained", F.col("_next").isNotNull()),
        bad(taxonomy, "kind", ~F.col("record_kind").isin(RECORD_KINDS)),
        bad(linked, "searchable alias", F.col("is_searchable")),
        bad(terms, "term type", ~F.col("term_type").isin(TERM_TYPES)),
        bad(terms, "weight", ~F.col("weight").between(0, 100)),
        bad(relations, "self relation", F.col("service_id") == F.col("related_id")),
    ]
    return reduce(DataFrame.unionByName, parts)
