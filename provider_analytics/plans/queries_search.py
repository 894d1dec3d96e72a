"""Free-text service search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import SERVICE_STOP_WORDS
from ..operators import search
from ..operators.skew import settle
from ..operators.taxonomy import searchable
from .registry import query

_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "[" + ",".join(f"'{w}'" for w in SERVICE_STOP_WORDS) + "]"
_GROUPS = ", ".join(f"('{a}', '{b}')" for g in search.TOKEN_GROUPS for a in g for b in g if a != b)
_TYPOS = "CASE WHEN len({0}) < 5 THEN 0 WHEN len({0}) < 9 THEN 1 ELSE 2 END"

# The scoring in plain SQL: all word pairs, all prefix pairs.
_SCORES = f"""
asked AS (SELECT DISTINCT query, {_NORM.format('query')} AS q FROM search_queries),
qs AS (SELECT DISTINCT q FROM asked WHERE q <> ''),
live AS (SELECT * FROM taxonomy WHERE canonical_id IS NULL AND is_searchable),
named AS (SELECT service_id, 'canonical' AS kind, 0 AS section, 0 AS weight, name AS label, {_NORM.format('name')} AS c FROM live
  UNION ALL SELECT service_id, 'canonical', 2, 0, replace(slug, '-', ' '), {_NORM.format('slug')} FROM live
  UNION ALL SELECT t.service_id, CASE term_type WHEN 'intent' THEN 'intent' ELSE 'alias' END, 3, weight, term, {_NORM.format('term')}
    FROM search_terms t JOIN live ON live.service_id = t.service_id),
cs AS (SELECT DISTINCT c FROM named WHERE c <> ''),
qt AS (SELECT q, toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos, len(toks) AS n FROM (
  SELECT q, list_filter(string_split(q, ' '), lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x)) AS toks FROM qs) a),
ct AS (SELECT c, toks, unnest(toks) AS t, generate_subscripts(toks, 1) AS pos, len(toks) AS n FROM (
  SELECT c, list_filter(string_split(c, ' '), lambda x: len(x) > 1 AND NOT list_contains({_STOP}, x)) AS toks FROM cs) a),
qv AS (SELECT DISTINCT t FROM qt UNION SELECT q FROM qs WHERE NOT contains(q, ' ')),
cv AS (SELECT DISTINCT t FROM ct UNION SELECT c FROM cs WHERE NOT contains(c, ' ')),
typos AS (SELECT a.t AS l, b.t AS r, damerau_levenshtein(a.t, b.t) AS distance FROM qv a JOIN cv b ON a.t <> b.t
  AND abs(len(a.t) - len(b.t)) <= 2 AND least({_TYPOS.format('a.t')}, {_TYPOS.format('b.t')}) > 0
  WHERE damerau_levenshtein(a.t, b.t) <= least({_TYPOS.format('a.t')}, {_TYPOS.format('b.t')})),
match AS (SELECT l, r FROM typos UNION SELECT a, b FROM (VALUES {_GROUPS}) g(a, b) UNION SELECT t, t FROM cv),
sim AS (SELECT q, c, CAST(qm AS DOUBLE) / qn * 0.55 + CAST(cm AS DOUBLE) / cn * 0.45 AS similarity FROM (
  SELECT qt.q, ct.c, qt.n AS qn, ct.n AS cn, count(DISTINCT qt.pos) AS qm, count(DISTINCT ct.pos) AS cm
  FROM qt JOIN match m ON m.l = qt.t JOIN ct ON ct.t = m.r GROUP BY qt.q, ct.c, qt.n, ct.n) s),
pre AS (SELECT q, c FROM qs JOIN cs ON starts_with(q, c) OR starts_with(c, q)),
fuz AS (SELECT l AS q, r AS c, CAST(30 - distance AS INT) AS fuzzy FROM typos WHERE l IN (SELECT q FROM qs) AND r IN (SELECT c FROM cs)),
pairs AS (SELECT q, c FROM sim UNION SELECT q, c FROM pre UNION SELECT q, c FROM fuz),
scored AS (SELECT p.q, p.c, k.kind, CAST(CASE
    WHEN p.q = p.c THEN CASE k.kind WHEN 'canonical' THEN 100 WHEN 'alias' THEN 90 ELSE 69 END
    WHEN pre.q IS NOT NULL THEN CASE k.kind WHEN 'canonical' THEN 80 WHEN 'alias' THEN 70 ELSE 65 END
    WHEN sim.similarity >= CASE k.kind WHEN 'intent' THEN 0.42 ELSE 0.5 END
      THEN CASE k.kind WHEN 'intent' THEN 50 ELSE 40 END + floor(least(9, sim.similarity * 9) + 0.5)
    ELSE coalesce(fuz.fuzzy, 0) END AS INT) AS score
  FROM pairs p JOIN (SELECT DISTINCT c, kind FROM named) k ON k.c = p.c
  LEFT JOIN sim ON sim.q = p.q AND sim.c = p.c LEFT JOIN pre ON pre.q = p.q AND pre.c = p.c LEFT JOIN fuz ON fuz.q = p.q AND fuz.c = p.c)
"""
_RANKED = f"""{_SCORES},
best AS (SELECT q, service_id, score, kind, label FROM (SELECT s.q, n.service_id, s.score, s.kind, n.label,
    row_number() OVER (PARTITION BY s.q, n.service_id ORDER BY s.score DESC, n.section, n.weight DESC, n.label) AS rn
  FROM scored s JOIN named n ON n.c = s.c AND n.kind = s.kind WHERE s.score >= 20) b WHERE rn = 1),
ranked AS (SELECT b.q, b.service_id, l.slug, b.score, b.label AS matched_term,
    CASE WHEN b.kind = 'intent' THEN 'intent' WHEN b.kind = 'canonical' AND b.score >= 80 THEN 'canonical' WHEN b.kind = 'alias' AND b.score >= 70 THEN 'alias'
      WHEN b.score >= 40 THEN 'token' ELSE 'fuzzy' END AS matched_by,
    row_number() OVER (PARTITION BY b.q ORDER BY b.score DESC, l.name, b.service_id) AS place FROM best b JOIN live l ON l.service_id = b.service_id)
"""


def inputs(d):
    tax = searchable(d.taxonomy).withColumn("plain_language_name", F.lit(None).cast("string"))
    terms = d.search_terms.withColumn("normalized_term", F.lit(None).cast("string"))
    return d.search_queries, tax, terms


def distinct_texts(d):
    queries, tax, terms = inputs(d)
    q = search.asked_texts(queries).select("q").distinct()
    named = settle(search.labels(tax, terms).withColumnRenamed("normalized", "c"), "labels")
    return q, named


@query("edit_distance_osa", f"WITH {_SCORES} SELECT l, r, CAST(distance AS INT) AS distance FROM typos")
def _(d):
    q, named = distinct_texts(d)
    return search.similar_tokens(search._vocabulary(q, "q"), search._vocabulary(named.select("c").distinct(), "c"))


@query("token_similarity", f"WITH {_SCORES} SELECT q, c, similarity FROM sim")
def _(d):
    q, named = distinct_texts(d)
    c = named.select("c").distinct()
    typos = search.similar_tokens(search._vocabulary(q, "q"), search._vocabulary(c, "c"))
    return search.token_similarity(q, c, typos, search.equivalent_tokens(d.spark))


@query("similar_texts", f"WITH {_SCORES} SELECT q, c, similarity FROM sim WHERE similarity >= 0.42")
def _(d):
    q, named = distinct_texts(d)
    c = named.select("c").distinct()
    typos = search.similar_tokens(search._vocabulary(q, "q"), search._vocabulary(c, "c"))
    return search.similar_texts(q, c, typos, search.equivalent_tokens(d.spark), 0.42)


@query("score_candidate", f"WITH {_SCORES} SELECT q, c, kind, score FROM scored WHERE score > 0")
def _(d):
    q, named = distinct_texts(d)
    return search.score_candidates(q, named.select("c", "kind").distinct(), search.equivalent_tokens(d.spark))


@query("fuzzy_score", f"WITH {_SCORES} SELECT q, c, fuzzy FROM fuz")
def _(d):
    q, named = distinct_texts(d)
    single = lambda df, c: df.filter(~F.contains(F.col(c), F.lit(" "))).select(F.col(c).alias("token")).distinct()
    close = search.similar_tokens(single(q, "q"), single(named, "c"))
    return close.select(F.col("l").alias("q"), F.col("r").alias("c"), (30 - F.col("distance")).alias("fuzzy"))


@query(
    "rank_services",
    f"WITH {_RANKED} SELECT a.query, r.slug, r.score, r.matched_by, r.matched_term, r.place FROM asked a JOIN ranked r ON r.q = a.q WHERE r.place <= 5",
)
def _(d):
    return search.rank_services(*inputs(d)).select("query", "slug", "score", "matched_by", "matched_term", "place")


@query("resolve_service", f"WITH {_RANKED} SELECT a.query, r.slug, r.score FROM asked a JOIN ranked r ON r.q = a.q WHERE r.place = 1")
def _(d):
    return search.resolve_service(*inputs(d)).select("query", "slug", "score")


@query(
    "zero_result_log",
    f"""WITH {_RANKED} SELECT a.q AS normalized, CAST(sum(s.asked) AS BIGINT) AS asked, count(*) AS spellings FROM asked a JOIN search_queries s ON s.query = a.query
        WHERE a.q NOT IN (SELECT q FROM ranked) GROUP BY a.q""",
)
def _(d):
    queries, tax, terms = inputs(d)
    return search.zero_result_log(queries, search.rank_services(queries, tax, terms, 1))


@query(
    "autocomplete_score",
    f"""WITH asked AS (SELECT DISTINCT {_NORM.format('query')} AS q FROM search_queries WHERE len({_NORM.format('query')}) >= 2),
        named AS (SELECT service_id, 0 AS section, name AS label, {_NORM.format('name')} AS c FROM taxonomy WHERE canonical_id IS NULL AND is_searchable
          UNION ALL SELECT t.service_id, 1, term, {_NORM.format('term')} FROM search_terms t JOIN taxonomy x ON x.service_id = t.service_id AND x.canonical_id IS NULL AND x.is_searchable),
        s AS (SELECT q, service_id, section, label, CASE WHEN q = c THEN 100 WHEN starts_with(c, q) THEN 85 WHEN contains(c, q) THEN 75
            WHEN share >= 0.66 THEN 50 + floor(share * 15 + 0.5) ELSE 0 END AS score FROM (
          SELECT q, service_id, section, label, c, CAST(len(list_filter(qt, lambda t: len(list_filter(string_split(c, ' '), lambda p: starts_with(p, t) OR starts_with(t, p))) > 0)) AS DOUBLE)
            / nullif(len(qt), 0) AS share
          FROM (SELECT q, list_filter(string_split(q, ' '), lambda t: len(t) > 1) AS qt FROM asked) a CROSS JOIN named) x),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, service_id ORDER BY score DESC, section, label) AS rn FROM s WHERE score > 0) y WHERE rn = 1)
        SELECT q, slug, CAST(score AS INT) AS score, matched_term, place FROM (SELECT b.q, t.slug, b.score, b.label AS matched_term,
          row_number() OVER (PARTITION BY b.q ORDER BY b.score DESC, t.name, t.service_id) AS place FROM b JOIN taxonomy t ON t.service_id = b.service_id) z WHERE place <= 6""",
)
def _(d):
    out = search.autocomplete(d.search_queries, searchable(d.taxonomy), d.search_terms)
    return out.select("q", "slug", "score", "matched_term", "place")
