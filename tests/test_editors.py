"""Editors' lists, prices of related services, hours as lists, marks of reviews against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from provider_analytics.functions.text import normalize_query
from provider_analytics.operators import extraction, reviews, taxonomy

TAXONOMY = "service_id bigint, slug string, name string, category string, record_kind string, is_searchable boolean, priority int, canonical_id bigint"
PRICES = "benchmark_id bigint, service_id bigint, location_scope string, price_min_cents int, price_avg_cents int, price_max_cents int, confidence double, updated_day int"


@pytest.fixture(scope="module")
def tables(spark):
    tax = spark.createDataFrame([
        (1, "mutuo", "Mutuo", "casa", "service", True, 2, None), (2, "prestito", "Prestito", "casa", "alias", False, None, 1),
        (3, "casa", "Casa", "casa", "service", True, 1, None),
    ], TAXONOMY)
    prices = spark.createDataFrame([
        (10, 3, "national", 1, 200, 3, 0.9, 5), (11, 3, "national", 1, 100, 3, 0.2, 9), (12, 1, "province", 1, 7, 3, 0.9, 5),
    ], PRICES)
    return tax, prices


def test_service_list(spark, tables):
    contents = spark.createDataFrame([
        (1, '["a","b","c"]', "x" * 201, "/i.webp", "live"), (2, "no list", " " * 300, "  ", None),
    ], "service_id bigint, required_documents string, html_content string, image_url string, content_status string")
    rows = taxonomy.service_list(*tables, contents, limit=10).collect()
    assert [(r.slug, r.canonical_slug, r.price_avg_cents, r.docs_count, r.content_status, r.has_html, r.has_image) for r in rows] == [
        ("casa", None, 200, 0, None, False, False), ("mutuo", None, None, 3, "live", True, True), ("prestito", "mutuo", None, 0, None, False, False)]
    assert taxonomy.service_list(*tables, contents.limit(0)).count() == 3


def test_related_services_priced(spark, tables):
    relations = spark.createDataFrame([(1, 3, 4)], "service_id bigint, related_id bigint, weight int")
    got = {(r.service_id, r.related_id): (r.origin, r.slug, r.price_avg_cents) for r in taxonomy.related_services_priced(tables[0], relations, tables[1]).collect()}
    assert got == {(1, 3): ("relation", "casa", 200), (3, 1): ("category", "mutuo", None)}


def test_a_day_without_hours_is_an_empty_list(spark):
    html = '<table class="orari_apertura"><tr><td>Lun 9-13 15-18</td><td>Mar</td><td> </td><td>Mer  chiuso</td></tr></table>'
    page = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    assert extraction.parse_microdata(page).first()["opening_hours"] == {"Lun": ["9-13 15-18"], "Mar": [], "Mer": ["chiuso"]}


def test_marks_of_reviews_against_a_loop(spark):
    rng = random.Random(2)
    stems = [s for words in reviews.ASPECTS.values() for side in words.values() for s in side]
    texts = [" ".join(rng.choice(stems + ["e", "Però", "niente"]) for _ in range(rng.randint(0, 5))) for _ in range(200)] + [None, "poco chiaro"]
    rows = spark.createDataFrame([(i % 7, i, t) for i, t in enumerate(texts)], "provider_id int, review_id int, text string").withColumn("t", normalize_query(F.col("text")))
    plain = {r.review_id: r.t or "" for r in rows.collect()}
    got = {(r.provider_id, r.aspect): (r.positive_hits, r.negative_hits, r.evidence) for r in reviews.aspect_sentiment(rows).collect()}
    for provider in range(7):
        mine = [i for i in range(len(texts)) if i % 7 == provider]
        for aspect, words in reviews.ASPECTS.items():
            pos, neg = ([i for i in mine if any(s in plain[i] for s in words[side])] for side in ("positive", "negative"))
            evidence = ",".join(str(i) for i in sorted({*pos, *neg})[:2])
            assert got[provider, aspect] == (len(pos), len(neg), evidence)
    with pytest.raises(ValueError):
        reviews.aspect_sentiment(rows, {f"a{i}": {"positive": ["x"], "negative": ["y"]} for i in range(63)})
