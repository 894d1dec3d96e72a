"""Record linkage between the register and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage
from ..operators.reviews import ASPECTS
from .queries_directory import hav
from .registry import query

# Register and listing rows in the form linkage reads; the listing's address is its city.
_P = "SELECT provider_id, full_name AS name, phone, comune AS address, comune, lat, lng FROM providers"
_L = "SELECT listing_id, name, phone, city AS address, city AS comune, lat, lng FROM listings"
_N = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS = "list_distinct(list_filter(string_split({0}, ' '), lambda t: len(t) >= 3 AND NOT list_contains(['notaio','notai','notarile','studio','dott','dottore','dr','avv','avvocato','associato','associati'], t)))"
# Candidates share the phone, or the surname and one more name word, or house number and street word; with
# city names for addresses the last is the number in the city name.
_NUM = f"regexp_extract({_N}, '\\\\b(\\\\d{{{{1,5}}}})(?:\\\\s*[a-z])?\\\\b', 1)"
_PAIRS = f"""SELECT p.provider_id, l.listing_id, p.pn, l.ln, len(list_intersect(p.pt, l.lt)) AS shared, len(p.pt) AS wanted, string_split(p.pn, ' ')[-1] AS surname, l.lt, p.pt,
    p.phone AS pp, substr(l.phone, 5) AS lp, {_N.format('p.comune')} AS pc, {_N.format('l.city')} AS lc, {hav('p.lat', 'p.lng', 'l.lat', 'l.lng')} AS km,
    regexp_extract({_N.format('p.comune')}, '\\b(\\d{{1,5}})(?:\\s*[a-z])?\\b', 1) AS pnum, regexp_extract({_N.format('l.city')}, '\\b(\\d{{1,5}})(?:\\s*[a-z])?\\b', 1) AS lnum
  FROM (SELECT *, {_N.format('full_name')} AS pn, {_TOKENS.format(_N.format('full_name'))} AS pt FROM providers) p
  JOIN (SELECT *, {_N.format('name')} AS ln, {_TOKENS.format(_N.format('name'))} AS lt FROM listings) l
    ON p.phone = substr(l.phone, 5) OR (list_contains(l.lt, string_split(p.pn, ' ')[-1]) AND len(list_intersect(p.pt, l.lt)) >= 2)
    OR {_NUM.format('p.comune')} = {_NUM.format('l.city')}"""
_SCORED = f"""SELECT provider_id, listing_id, CAST(CASE WHEN pp = lp THEN 55 ELSE 0 END + CASE WHEN list_contains(lt, surname) THEN 24 ELSE 0 END
    + CASE WHEN shared >= least(2, wanted) THEN 18 ELSE 0 END + CASE WHEN coalesce(pnum, '') <> '' AND pnum = lnum THEN 18 ELSE 0 END
    + CASE WHEN regexp_extract(pc, '^[a-z]{{3,}}') = regexp_extract(lc, '^[a-z]{{3,}}') THEN 16 ELSE 0 END + CASE WHEN contains(lc, pc) THEN 14 ELSE 0 END
    + CASE WHEN km <= 0.5 THEN 15 WHEN km <= 2 THEN 10 WHEN km > 20 THEN -35 ELSE 0 END AS INT) AS score, shared >= least(2, wanted) AS by_words FROM ({_PAIRS}) x"""


def _frames(d):
    return d.sql(_P), d.sql(_L)


def _scored_pairs(d, at_least):
    register, listings = _frames(d)
    p = linkage.prepare(register, "provider_id")
    l = linkage.prepare(listings, "listing_id")
    pairs = linkage.candidate_pairs(linkage.signatures(p, "provider_id"), linkage.signatures(l, "listing_id"))
    return linkage.match_score_places(pairs, at_least)


@query(
    "candidate_pairs",
    f"""SELECT provider_id, listing_id FROM ({_PAIRS}) x WHERE pp = lp OR (list_contains(lt, surname) AND shared >= 2)""",
)
def _(d):
    register, listings = _frames(d)
    pairs = linkage.candidate_pairs(
        linkage.signatures(linkage.prepare(register, "provider_id"), "provider_id"),
        linkage.signatures(linkage.prepare(listings, "listing_id"), "listing_id"),
    )
    named = linkage.shares_surname() & linkage.shares_names(F.lit(2))
    return pairs.filter(linkage.shares_phone() | named).select(
        F.col("p_first_key").alias("provider_id"), F.col("l_first_key").alias("listing_id")
    )


@query("match_score_places", f"SELECT provider_id, listing_id, score FROM ({_SCORED}) s WHERE score >= 70 AND by_words")
def _(d):
    # The fuzzy name measure has no SQL form; pairs whose names agree by words are compared.
    return _scored_pairs(d, 70).filter("array_contains(reasons, 'name +18')").select(
        F.col("p_first_key").alias("provider_id"), F.col("l_first_key").alias("listing_id"), "score"
    )


# Edges from the best to the worst; each is taken if both its ends are free when its turn comes.
_TAKEN = f"""WITH RECURSIVE seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, md5(concat(provider_id, '|', listing_id)), provider_id, listing_id) AS rn FROM ({_SCORED}) s WHERE score >= 70),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS provider_id, CAST(NULL AS BIGINT) AS listing_id, CAST(NULL AS INT) AS score, false AS taken, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ls
    UNION ALL
    SELECT s.rn, s.provider_id, s.listing_id, s.score, NOT list_contains(w.ps, s.provider_id) AND NOT list_contains(w.ls, s.listing_id),
      CASE WHEN list_contains(w.ps, s.provider_id) OR list_contains(w.ls, s.listing_id) THEN w.ps ELSE list_append(w.ps, s.provider_id) END,
      CASE WHEN list_contains(w.ps, s.provider_id) OR list_contains(w.ls, s.listing_id) THEN w.ls ELSE list_append(w.ls, s.listing_id) END
    FROM walk w JOIN seq s ON s.rn = w.rn + 1)
SELECT provider_id, listing_id, score FROM walk WHERE taken"""


@query("pick_match", _TAKEN)
def _(d):
    return linkage.link(*_frames(d))


# Candidates are in the same city and have numbers in their names that begin alike.
_DIRECTORY = """SELECT p.provider_id, l.listing_id, p.full_name AS p_name, p.comune AS p_comune, p.phone AS p_phone, l.name AS l_name, l.city AS l_city,
   CAST(NULL AS STRING) AS l_address, CAST(NULL AS STRING) AS l_description, l.phone AS l_phone, CASE WHEN l.listing_id % 2 = 0 THEN 'Studi Notarili' ELSE 'Altro' END AS l_category,
   l.website AS l_website, CAST(NULL AS STRING) AS l_email FROM providers p JOIN listings l ON l.city = p.comune AND left(right(l.name, 9), 6) = left(right(p.full_name, 9), 6)"""
_OVERLAP = f"len(list_intersect(list_filter(string_split({_N.format('p_name')}, ' '), lambda t: len(t) > 1), list_filter(string_split({_N.format('l_name')}, ' '), lambda t: len(t) > 1)))"


@query(
    "match_score_directory",
    f"""SELECT provider_id, listing_id, CAST(CASE WHEN {_OVERLAP} >= 2 THEN 55 WHEN {_OVERLAP} = 1 THEN 25 ELSE 0 END + 20 + CASE WHEN p_phone = substr(l_phone, 5) THEN 35 ELSE 0 END
          + CASE WHEN l_category = 'Studi Notarili' THEN 10 ELSE 0 END + 5 AS INT) AS score FROM ({_DIRECTORY}) t""",
)
def _(d):
    return linkage.match_score_directory(d.sql(_DIRECTORY)).select("provider_id", "listing_id", "score")


_PROFILE = """SELECT p.provider_id, l.listing_id, p.full_name AS p_name, p.comune AS p_comune, p.phone AS p_phone, p.email AS p_email, l.name AS l_name, '' AS l_first_name, '' AS l_last_name,
   l.city AS l_city, '' AS l_province, '' AS l_address, l.phone AS l_phone, q.email AS l_email, l.listing_id % 2 AS l_services
   FROM providers p JOIN listings l ON l.city = p.comune AND left(right(l.name, 9), 6) = left(right(p.full_name, 9), 6) JOIN providers q ON q.provider_id = l.listing_id"""


@query(
    "match_score_profile",
    f"""SELECT provider_id, listing_id, CAST(CASE WHEN {_OVERLAP} >= 2 THEN 55 WHEN {_OVERLAP} = 1 THEN 25 ELSE 0 END + CASE WHEN p_phone = substr(l_phone, 5) THEN 35 ELSE 0 END
          + CASE WHEN p_email = l_email THEN 25 ELSE 0 END + 20 + CASE WHEN l_services > 0 THEN 5 ELSE 0 END AS INT) AS score FROM ({_PROFILE}) t""",
)
def _(d):
    return linkage.match_score_profile(d.sql(_PROFILE)).select("provider_id", "listing_id", "score")


@query(
    "first_match_wins",
    f"""SELECT provider_id, listing_id, score FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY listing_id) AS rn FROM (
          SELECT provider_id, listing_id, CAST(CASE WHEN {_OVERLAP} >= 2 THEN 55 WHEN {_OVERLAP} = 1 THEN 25 ELSE 0 END + 20 + CASE WHEN p_phone = substr(l_phone, 5) THEN 35 ELSE 0 END
            + CASE WHEN l_category = 'Studi Notarili' THEN 10 ELSE 0 END + 5 AS INT) AS score FROM ({_DIRECTORY}) t) u WHERE score >= 80) v WHERE rn = 1""",
)
def _(d):
    scored = linkage.match_score_directory(d.sql(_DIRECTORY))
    return linkage.first_match_wins(
        scored.withColumn("try_order", F.col("listing_id")), "provider_id", "try_order", "listing_id", 80
    )


@query(
    "token_intersection",
    f"SELECT provider_id, listing_id, CAST({_OVERLAP} AS INT) AS shared FROM ({_DIRECTORY}) t",
)
def _(d):
    from ..functions.text import words

    shared = linkage.token_intersection(words(F.col("p_name")), words(F.col("l_name")))
    return d.sql(_DIRECTORY).select("provider_id", "listing_id", shared.alias("shared"))


@query(
    "sequence_ratio",
    """SELECT p.provider_id, CASE WHEN l.name LIKE 'Studio %' THEN round(2.0 * len(p.full_name) / (2 * len(p.full_name) + 7), 6) ELSE 1.0 END::DOUBLE AS ratio
       FROM providers p JOIN listings l ON l.listing_id = p.provider_id""",
)
def _(d):
    # A listing repeats the name in other case or with a seven-letter prefix, so the measure has a closed form.
    from ..functions.text import normalize_query

    pairs = d.providers.join(d.listings, F.col("provider_id") == F.col("listing_id")).select(
        "provider_id", normalize_query(F.col("full_name")).alias("a"), normalize_query(F.col("name")).alias("b")
    )
    return pairs.select("provider_id", F.round(linkage.sequence_ratio("a", "b"), 6).alias("ratio"))


_PHRASES = {"alpha": ["eau", "tion"], "beta": ["und", "thé"], "gamma": ["zzzz", "ent"]}


@query(
    "extract_services",
    """SELECT doc_id, slug, evidence FROM (
         SELECT doc_id, 'alpha' AS slug, CASE WHEN contains(t, 'eau') THEN 'eau' WHEN contains(t, 'tion') THEN 'tion' END AS evidence FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents) a
         UNION ALL SELECT doc_id, 'beta', CASE WHEN contains(t, 'und') THEN 'und' WHEN contains(t, 'the') THEN 'thé' END FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents) b
         UNION ALL SELECT doc_id, 'gamma', CASE WHEN contains(t, 'zzzz') THEN 'zzzz' WHEN contains(t, 'ent') THEN 'ent' END FROM (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents) c) u
       WHERE evidence IS NOT NULL""",
)
def _(d):
    return linkage.extract_services(d.documents, F.col("text"), _PHRASES).select("doc_id", "slug", "evidence")


_RECORD = """SELECT provider_id, concat(full_name, ' ', CASE provider_id % 4 WHEN 0 THEN 'Mutui e Garanzia' WHEN 1 THEN 'costituzione società' WHEN 2 THEN 'Eredità, procure' ELSE 'altro' END) AS record FROM providers"""


@query(
    "extract_record_services",
    f"""SELECT provider_id, s.slug, s.evidence FROM ({_RECORD}) r JOIN (VALUES (0, 'mutuo', 'mutui'), (1, 'diritto-societario', 'costituzione societa'),
          (2, 'eredita', 'eredita'), (2, 'procura', 'procure')) s(k, slug, evidence) ON s.k = provider_id % 4""",
)
def _(d):
    return linkage.extract_services(d.sql(_RECORD), F.col("record"), linkage.RECORD_PHRASES).select("provider_id", "slug", "evidence")


_MATCHED = "SELECT listing_id AS provider_id, listing_id, 70 + listing_id % 40 AS score FROM listings WHERE phone IS NOT NULL"
_EVIDENCE = "SELECT DISTINCT l_suppkey AS listing_id, replace(p_name, ' ', '-') AS slug, lower(p_name) AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey"


@query(
    "service_evidence",
    f"""SELECT provider_id, service_id, confidence, evidence FROM (SELECT m.provider_id, coalesce(t.canonical_id, t.service_id) AS service_id, least(m.score / 100.0, 0.95) AS confidence, e.evidence,
          row_number() OVER (PARTITION BY m.provider_id, coalesce(t.canonical_id, t.service_id) ORDER BY least(m.score / 100.0, 0.95) DESC, e.evidence) AS rn
        FROM ({_MATCHED}) m JOIN ({_EVIDENCE}) e ON e.listing_id = m.listing_id JOIN taxonomy t ON t.slug = e.slug) x WHERE rn = 1""",
)
def _(d):
    return linkage.service_evidence(d.sql(_MATCHED), d.sql(_EVIDENCE), d.taxonomy, "listing").drop("source")


@query(
    "record_no_match",
    f"""SELECT p.provider_id, 'listing' AS source, CASE WHEN m.provider_id IS NOT NULL THEN 'completed' ELSE 'no_match' END AS status, TIMESTAMP '2024-02-01 00:00:00' AS checked_at
        FROM providers p LEFT JOIN ({_MATCHED}) m ON m.provider_id = p.provider_id""",
)
def _(d):
    return linkage.record_no_match(d.providers, d.sql(_MATCHED), "listing", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


_GAZ = """SELECT concat('Via ', comune, ', ', comune, ', Italia') AS address, CASE WHEN min(provider_id) % 3 = 0 THEN NULL ELSE max(lat) END AS lat,
  CASE WHEN min(provider_id) % 3 = 0 THEN NULL ELSE max(lng) + min(provider_id) % 3 * 5 END AS lng FROM providers WHERE is_official GROUP BY comune"""


@query(
    "geocode_apply",
    f"""SELECT p.provider_id, CASE WHEN p.lat IS NOT NULL THEN 'present' WHEN g.address IS NULL THEN 'pending' WHEN g.lat IS NULL THEN 'empty'
            WHEN g.lat BETWEEN 35 AND 47.2 AND g.lng BETWEEN 6 AND 19.3 THEN 'completed' ELSE 'outside' END AS geocode,
          CASE WHEN p.lat IS NOT NULL THEN p.lat WHEN g.lat BETWEEN 35 AND 47.2 AND g.lng BETWEEN 6 AND 19.3 THEN g.lat END AS lat
        FROM providers p LEFT JOIN ({_GAZ}) g ON g.address = concat('Via ', p.comune, ', ', p.comune, ', Italia')""",
)
def _(d):
    rows = d.providers.withColumn("address", F.concat(F.lit(" Via "), "comune")).withColumn("cap", F.lit(" "))
    return linkage.geocode_apply(rows, d.sql(_GAZ)).select("provider_id", "geocode", "lat")


@query(
    "lookup_by_slug",
    """SELECT provider_id, concat('https://dir.example.org/notaio/', upper(slug), '/') AS url FROM providers p
       WHERE NOT EXISTS (SELECT 1 FROM observations o WHERE o.provider_id = p.provider_id AND o.source = 'source4' AND o.status = 'completed')""",
)
def _(d):
    urls = d.providers.select(F.concat(F.lit("https://dir.example.org/notaio/"), F.upper("slug"), F.lit("/")).alias("url"))
    done = d.observations.filter("source = 'source4' AND status = 'completed'")
    return linkage.lookup_by_slug(urls, d.providers, done, "notaio").select("provider_id", "url")


_REVIEWS_NOW = "SELECT provider_id, source, language AS author, published_day, sha256(text) AS text_hash, review_id, rating FROM reviews"
_NEW = "SELECT provider_id, source, language AS author, published_day, sha256(text) AS text_hash, review_id + 1000000 AS review_id, CAST(1 AS INT) AS rating FROM reviews WHERE rating = 5"


@query(
    "review_upsert",
    f"""SELECT provider_id, source, author, published_day, review_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, source, author, published_day, text_hash ORDER BY fresh DESC, review_id) AS rn
          FROM (SELECT *, 0 AS fresh FROM ({_REVIEWS_NOW}) a UNION ALL SELECT *, 1 AS fresh FROM ({_NEW}) b) u) v WHERE rn = 1""",
)
def _(d):
    from ..operators.reviews import review_upsert

    base = d.reviews.select("provider_id", "source", F.col("language").alias("author"), "published_day",
                            F.sha2("text", 256).alias("text_hash"), "review_id", "rating")
    new = base.filter("rating = 5").withColumn("review_id", F.col("review_id") + 1000000).withColumn("rating", F.lit(1))
    return review_upsert(base, new, [F.col("review_id")]).drop("text_hash")


@query("summarize_reviews", "SELECT provider_id, source, review_count, rating_avg FROM review_summaries")
def _(d):
    from ..operators.reviews import summarize_reviews

    return summarize_reviews(d.reviews)


_ASPECTS = {
    "clear": {"positive": ["eau", "und"], "negative": ["tion", "das ist"]},
    "quick": {"positive": ["the"], "negative": ["sch", "erre"]},
    "calm": {"positive": ["ing"], "negative": ["zzzz"]},
}


def _aspect_sql(aspects=_ASPECTS):
    norm = "trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))"
    hit = lambda stems: " OR ".join(f"contains(t, '{s}')" for s in stems)
    parts = " UNION ALL ".join(
        f"SELECT provider_id, review_id, {i} AS aspect_no, '{name}' AS aspect, {hit(w['positive'])} AS pos, {hit(w['negative'])} AS neg FROM x"
        for i, (name, w) in enumerate(aspects.items())
    )
    return f"""WITH x AS (SELECT provider_id, review_id, {norm} AS t FROM reviews), h AS ({parts}),
      c AS (SELECT provider_id, aspect_no, aspect, count(*) FILTER (pos) AS positive_hits, count(*) FILTER (neg) AS negative_hits FROM h GROUP BY provider_id, aspect_no, aspect),
      e AS (SELECT provider_id, aspect_no, string_agg(CAST(review_id AS STRING), ',' ORDER BY review_id) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, aspect_no ORDER BY review_id) AS rn
            FROM h WHERE pos OR neg) y WHERE rn <= 2 GROUP BY provider_id, aspect_no),
      s AS (SELECT c.*, coalesce(e.evidence, '') AS evidence, CASE WHEN positive_hits + negative_hits > 0 THEN positive_hits / (positive_hits + negative_hits) END AS share
            FROM c LEFT JOIN e ON e.provider_id = c.provider_id AND e.aspect_no = c.aspect_no),
      a AS (SELECT *, CASE WHEN share >= 0.67 THEN 'positive' WHEN share <= 0.33 THEN 'negative' ELSE 'neutral' END AS label, round_even(share, 2) AS score FROM s)"""


@query("aspect_sentiment", f"{_aspect_sql()} SELECT provider_id, aspect, positive_hits, negative_hits, evidence, label, score FROM a")
def _(d):
    from ..operators.reviews import aspect_sentiment

    return aspect_sentiment(d.reviews, _ASPECTS).drop("aspect_no")


@query(
    "aspect_sentiment_default_lexicon",
    f"{_aspect_sql(ASPECTS)} SELECT provider_id, aspect, positive_hits, negative_hits, evidence, label, score FROM a",
)
def _(d):
    from ..operators.reviews import aspect_sentiment

    return aspect_sentiment(d.reviews).drop("aspect_no")


@query(
    "overall_sentiment",
    f"""{_aspect_sql()} SELECT r.provider_id, coalesce(p.list, '') AS strengths, coalesce(n.list, '') AS concerns,
          CASE WHEN greatest(0, least(1, (rating_avg - 1) / 4)) >= 0.75 THEN 'positive' WHEN greatest(0, least(1, (rating_avg - 1) / 4)) <= 0.40 THEN 'negative' ELSE 'neutral' END AS label,
          CASE WHEN review_count > 0 THEN review_count * 2 END AS aggregate_count, true AS sample_is_partial
        FROM (SELECT provider_id, round(avg(CAST(rating AS DOUBLE)), 2) AS rating_avg, count(*) AS review_count FROM reviews GROUP BY provider_id) r
        LEFT JOIN (SELECT provider_id, string_agg(upper(aspect), ', ' ORDER BY aspect_no) AS list FROM a WHERE label = 'positive' GROUP BY provider_id) p ON p.provider_id = r.provider_id
        LEFT JOIN (SELECT provider_id, string_agg(upper(aspect), ', ' ORDER BY aspect_no) AS list FROM a WHERE label = 'negative' GROUP BY provider_id) n ON n.provider_id = r.provider_id""",
)
def _(d):
    from ..operators.reviews import aspect_sentiment, overall_sentiment

    ratings = d.reviews.groupBy("provider_id").agg(
        F.round(F.avg(F.col("rating").cast("double")), 2).alias("rating_avg"), F.count("*").alias("sample_count")
    ).withColumn("review_count", F.col("sample_count") * 2)
    out = overall_sentiment(aspect_sentiment(d.reviews, _ASPECTS), ratings, {k: k.upper() for k in _ASPECTS})
    return out.select("provider_id", "strengths", "concerns", "label", "aggregate_count", "sample_is_partial")
