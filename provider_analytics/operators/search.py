"""Free-text queries against the service taxonomy.

Every way in which a label can score - equal, prefix either way, shared or similar words - is an equality
join on something derived from both sides (the text, its prefixes, its words, its words with letters left
out). No query is ever compared with a label it has nothing in common with."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import is_generic_query, normalize_query, service_tokens
from .skew import settle, top_per_group

# Executors get the helpers below with the task; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words that stand for each other in a service query.
TOKEN_GROUPS = [
    ["donare", "donazione", "regalare", "dare", "cedere", "trasferire"],
    ["figlio", "figli", "familiare", "familiari"],
    ["casa", "immobile", "appartamento"],
    ["vivere", "viverci", "abitare"],
    ["vendere", "vendita", "cessione"],
    ["comprare", "acquisto"],
    ["eredita", "ereditaria", "successione"],
    ["societa", "societaria", "aziendale"],
]


def max_typos(token: Column) -> Column:
    """Letters that may be wrong in a word: none below five letters, one below nine, else two."""
    return F.when(F.length(token) < 5, 0).when(F.length(token) < 9, 1).otherwise(2)


def _osa(a: str, b: str) -> int:
    """Edits to turn a into b: insert, delete, replace, or swap two neighbours, no part edited twice."""
    two_back: list[int] = []
    back = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(back[j] + 1, row[j - 1] + 1, back[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two_back[j - 2] + 1)
            row.append(best)
        two_back, back = back, row
    return back[-1]


@F.pandas_udf(IntegerType())
def edit_distance_osa(left: pd.Series, right: pd.Series) -> pd.Series:
    """Restricted edit distance with swaps; meant for distinct word pairs that blocking has left over."""
    return pd.Series([_osa(a, b) for a, b in zip(left, right)], dtype="int32")


def _without_letters(token: Column, budget: Column) -> Column:
    """The word and every form of it with up to `budget` letters left out."""
    drop = lambda t: F.transform(
        F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t)))
    )
    once = drop(token)
    forms = F.when(budget >= 2, F.concat(F.array(token), once, F.flatten(F.transform(once, drop)))).otherwise(
        F.concat(F.array(token), once)
    )
    return F.array_distinct(forms)


def similar_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l, r, distance) of different words within the typo budget of the stricter word.

    Two words within d edits share a form with at most d letters left out, so blocking on those forms misses
    nothing. Words longer than the other side can answer are left out before their forms are made."""
    longest = right.agg(F.max(F.length("token")).alias("_longest"), F.max(max_typos(F.col("token"))).alias("_most"))  # one row
    lefts = left.select(F.col("token").alias("l")).distinct().withColumn("_lb", max_typos(F.col("l"))).filter("_lb > 0")
    rights = right.select(F.col("token").alias("r")).distinct().withColumn("_rb", max_typos(F.col("r"))).filter("_rb > 0")
    lefts = lefts.crossJoin(F.broadcast(longest)).filter(F.length("l") <= F.col("_longest") + F.col("_most")).select(
        "l", F.least("_lb", "_most").alias("_lb")
    )
    a = lefts.withColumn("_form", F.explode(_without_letters(F.col("l"), F.col("_lb"))))
    b = rights.withColumn("_form", F.explode(_without_letters(F.col("r"), F.col("_rb"))))
    allowed = F.least("_lb", "_rb")
    pairs = a.join(b, "_form").filter((F.col("l") != F.col("r")) & (F.abs(F.length("l") - F.length("r")) <= allowed)).select(
        "l", "r", allowed.alias("_allowed")
    ).distinct()
    return pairs.withColumn("distance", edit_distance_osa("l", "r")).filter(F.col("distance") <= F.col("_allowed")).drop("_allowed")


def equivalent_tokens(spark: SparkSession, groups: list[list[str]] | None = None) -> DataFrame:
    rows = [(a, b) for group in groups or TOKEN_GROUPS for a in group for b in group if a != b]
    return spark.createDataFrame(rows, "l string, r string")


def labels(taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """Everything a service can be found under: (service_id, kind, label, normalized, section, weight).
    Own names come first, then terms by weight and wording."""
    own = taxonomy.select(
        "service_id", F.lit("canonical").alias("kind"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("section"), F.col("name").alias("label")),
            F.struct(F.lit(1).alias("section"), F.coalesce("plain_language_name", F.lit("")).alias("label")),
            F.struct(F.lit(2).alias("section"), F.replace("slug", F.lit("-"), F.lit(" ")).alias("label")),
        )),
    ).withColumn("weight", F.lit(0)).withColumn("_text", F.col("label"))
    more = terms.join(taxonomy.select("service_id"), "service_id").select(
        "service_id", F.when(F.col("term_type") == "intent", "intent").otherwise("alias").alias("kind"), F.lit(3).alias("section"),
        F.col("term").alias("label"), F.col("weight").cast("int").alias("weight"),
        F.coalesce(F.nullif("normalized_term", F.lit("")), F.col("term")).alias("_text"),
    )
    # Written before they are normalised: else the filter goes below the grouping the labels come from, to every raw row.
    listed = settle(own.unionByName(more), "listed").withColumn("normalized", normalize_query(F.col("_text")))
    return listed.select(*own.columns[:-1], "normalized").filter("normalized <> ''")


def asked_texts(queries: DataFrame) -> DataFrame:
    """(query, q): the different queries with their normal form, those that have none left out. Each is normalised once;
    they are written before, as the filter would go below their grouping otherwise, to every raw row."""
    raw = settle(queries.select("query").distinct(), "queries")
    return settle(raw.withColumn("q", normalize_query(F.col("query"))).filter("q <> ''"), "asked")


def _words(texts: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Word positions of distinct normalised texts, with the number of words; `name` stands for the text if given."""
    listed = texts.select(F.col(name or key), service_tokens(F.col(key)).alias("_t"))
    return listed.select(name or key, F.size("_t").alias("_words"), F.posexplode("_t").alias("_at", "token"))


def _vocabulary(texts: DataFrame, key: str) -> DataFrame:
    """Words that typos are looked for in: those that carry meaning, and single-word texts whole."""
    single = texts.filter(~F.contains(F.col(key), F.lit(" "))).select(F.col(key).alias("token"))
    return _words(texts, key).select("token").unionByName(single).distinct()


def _numbered(texts: DataFrame, key: str, number: str) -> DataFrame:
    """The different texts, each with a number that stands for it wherever rows are dealt by words."""
    return settle(texts.select(key).distinct().withColumn(number, F.monotonically_increasing_id()), "numbered")


def token_similarity(queries: DataFrame, candidates: DataFrame, typos: DataFrame, groups: DataFrame) -> DataFrame:
    """(q, c, similarity): weighted share of words of either text that have a match in the other, for every pair with
    at least one match. Where only pairs from a similarity on are wanted, similar_texts finds these."""
    asked, named = _numbered(queries, "q", "_q"), _numbered(candidates, "c", "_c")
    q, c = _words(asked, "q", "_q"), _words(named, "c", "_c")
    match = typos.select("l", "r").unionByName(groups.select("l", "r")).distinct()
    left = q.select("_q", F.col("_words").alias("_qn"), F.col("_at").alias("_qa"), F.col("token").alias("l"))
    right = c.select("_c", F.col("_words").alias("_cn"), F.col("_at").alias("_ca"), F.col("token").alias("r"))
    same = left.join(right, F.col("l") == F.col("r"))
    close = left.join(match, "l").join(right, "r")
    columns = ["_q", "_c", "_qn", "_cn", "_qa", "_ca"]
    found = same.select(*columns).unionByName(close.select(*columns))
    counted = found.groupBy("_q", "_c", "_qn", "_cn").agg(F.count_distinct("_qa").alias("_qm"), F.count_distinct("_ca").alias("_cm"))
    similarity = F.col("_qm") / F.col("_qn") * _OF_QUERY + F.col("_cm") / F.col("_cn") * _OF_LABEL
    return counted.select("_q", "_c", similarity.alias("similarity")).join(named, "_c").join(asked, "_q").select("q", "c", "similarity")


#: Weights of the two shares of a similarity, and in how many steps the label's is told before the join.
_OF_QUERY, _OF_LABEL, _STEPS = 0.55, 0.45, 20


def similar_texts(queries: DataFrame, candidates: DataFrame, typos: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(q, c, similarity) of token_similarity, for the pairs that reach `least` > 0, found by a weighted prefix filter.

    Words of labels have one order, the rare before the frequent. A pair is met at the rarest label word that a word of
    the query matches; there, no more words of either text can match than those it has from that word on. What these
    counts allow of a similarity, known on both sides before the join, has to reach `least`, so a word that many
    labels have brings only texts together that are nearly nothing but such words. Pairs are then counted whole."""
    texts, named = _numbered(queries, "q", "_q"), _numbered(candidates, "c", "_c")
    q, c = _words(texts, "q", "_q"), _words(named, "c", "_c")
    vocabulary = settle(c.groupBy("token").agg(F.count("*").alias("_df")), "label-words")
    asked = q.select("token").distinct()
    edges = asked.join(vocabulary, "token").select(F.col("token").alias("l"), F.col("token").alias("r")).unionByName(
        asked.withColumnRenamed("token", "l").join(typos.select("l", "r").unionByName(groups.select("l", "r")), "l")).distinct()
    edges = edges.join(vocabulary.withColumnRenamed("token", "r"), "r").select("l", F.struct("_df", F.col("r").alias("word")).alias("_key"))
    keys = settle(q.select("_q", F.col("_words").alias("_qn"), F.col("_at").alias("_qa"), F.col("token").alias("l")).join(edges, "l").drop("l"), "query-keys")
    held = settle(c.join(vocabulary, "token").select("_c", F.col("_words").alias("_cn"), F.struct("_df", F.col("token").alias("word")).alias("_key")), "label-keys")

    from_here = lambda text: Window.partitionBy(text).orderBy(F.col("_key").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    commonest = keys.groupBy("_q", "_qn", "_qa").agg(F.max("_key").alias("_key")).select("_q", "_qn", "_key", F.lit(1).alias("_one"))
    points = keys.select("_q", "_qn", "_key").distinct().withColumn("_one", F.lit(0)).unionByName(commonest)
    most = points.withColumn("_most", F.sum("_one").over(from_here("_q"))).filter("_one = 0")
    lacking = least - 1e-9 - _OF_QUERY * F.col("_most") / F.col("_qn")
    first = F.greatest(F.lit(0), F.floor(lacking / _OF_LABEL * _STEPS)).cast("int")
    asks = most.withColumn("_first", first).filter(F.col("_first") <= _STEPS).select(
        "_q", "_key", F.explode(F.sequence(F.col("_first"), F.lit(_STEPS))).alias("_step"))
    share = F.count("*").over(from_here("_c")) / F.col("_cn")
    gives = held.withColumn("_step", F.floor(share * _STEPS + 1e-9).cast("int")).select("_c", "_key", "_step").distinct()
    pairs = settle(asks.join(gives, ["_key", "_step"]).select("_q", "_c").distinct(), "pairs")

    query_side = keys.groupBy("_q", "_qn").agg(F.collect_list(F.struct("_qa", F.col("_key.word").alias("word"))).alias("_asked"))
    label_side = held.groupBy("_c", "_cn").agg(F.collect_list("_key.word").alias("_held"))
    both = pairs.join(label_side, "_c").join(query_side, "_q")
    met = F.size(F.array_distinct(F.transform(F.filter("_asked", lambda a: F.array_contains("_held", a["word"])), lambda a: a["_qa"])))
    answered = F.size(F.filter("_held", lambda w: F.array_contains(F.col("_asked.word"), w)))
    similarity = met / F.col("_qn") * _OF_QUERY + answered / F.col("_cn") * _OF_LABEL
    close = both.select("_q", "_c", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    return close.join(named, "_c").join(texts, "_q").select("q", "c", "similarity")


def prefix_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, c) where one text starts with the other, equal ones included."""
    begin = lambda t, n: t.substr(F.lit(1), n)
    of_candidate = candidates.select(
        "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("c")), lambda n: begin(F.col("c"), n))).alias("q")
    )
    shorter = queries.join(of_candidate, "q").select("q", "c")
    # Only lengths that some candidate has; label lengths are few, so this is one short array.
    lengths = candidates.agg(F.collect_set(F.length("c")).alias("_lengths"))
    of_query = queries.crossJoin(F.broadcast(lengths)).select(
        "q", F.explode(F.transform(
            F.filter("_lengths", lambda n: n < F.length("q")), lambda n: begin(F.col("q"), n)
        )).alias("c"),
    )
    longer = of_query.join(candidates, "c").select("q", "c")
    return shorter.unionByName(longer)


#: Similarity from which on a label counts as similar, and an intent does.
_SIMILAR, _SIMILAR_INTENT = 0.5, 0.42


def score_candidates(queries: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """(q, c, kind, score) for distinct normalised queries (q) and distinct labels (c, kind), scores above zero.

    Equal 100/90/69, prefix 80/70/65 for canonical/alias/intent; similar words 40 to 49, for intents 50 to 59;
    a misspelt single word 28 or 29."""
    plain = candidates.select("c").distinct()
    typos = settle(similar_tokens(_vocabulary(queries, "q"), _vocabulary(plain, "c")), "typos")
    single = lambda c: ~F.contains(F.col(c), F.lit(" "))
    fuzzy = typos.join(queries.filter(single("q")), F.col("l") == F.col("q")).join(
        plain.filter(single("c")), F.col("r") == F.col("c")
    ).select("q", "c", (30 - F.col("distance")).alias("_fuzzy"))
    none_int, none_double = F.lit(None).cast("int"), F.lit(None).cast("double")
    ways = (
        prefix_pairs(queries, plain).select("q", "c", F.lit(1).alias("_prefix"), none_double.alias("_similarity"), none_int.alias("_fuzzy"))
        .unionByName(similar_texts(queries, plain, typos, groups, min(_SIMILAR, _SIMILAR_INTENT)).select(
            "q", "c", none_int.alias("_prefix"), F.col("similarity").alias("_similarity"), none_int.alias("_fuzzy")))
        .unionByName(fuzzy.select("q", "c", none_int.alias("_prefix"), none_double.alias("_similarity"), "_fuzzy"))
        .groupBy("q", "c").agg(F.max("_prefix").alias("_prefix"), F.max("_similarity").alias("_similarity"), F.max("_fuzzy").alias("_fuzzy"))
    )
    kind = F.col("kind")
    by_kind = lambda canonical, alias, intent: (
        F.when(kind == "canonical", canonical).when(kind == "alias", alias).otherwise(intent)
    )
    similar = F.col("_similarity") >= F.when(kind == "intent", _SIMILAR_INTENT).otherwise(_SIMILAR)
    level = F.floor(F.least(F.lit(9.0), F.col("_similarity") * 9) + 0.5).cast("int")
    score = (
        F.when(F.col("q") == F.col("c"), by_kind(100, 90, 69))
        .when(F.col("_prefix") == 1, by_kind(80, 70, 65))
        .when(similar, F.when(kind == "intent", 50).otherwise(40) + level)
        .otherwise(F.coalesce("_fuzzy", F.lit(0)))
    )
    return ways.join(candidates.select("c", "kind").distinct(), "c").select("q", "c", "kind", score.alias("score")).filter("score > 0")


def rank_services(queries: DataFrame, taxonomy: DataFrame, terms: DataFrame, limit: int = 5, least_score: int = 20) -> DataFrame:
    """Best services for each raw query: (query, service_id, slug, name, score, matched_by, matched_term, place).

    queries: query. taxonomy: searchable canonical services with plain_language_name. Equal queries after
    normalisation are scored once."""
    asked = asked_texts(queries)
    named = settle(labels(taxonomy, terms).withColumnRenamed("normalized", "c"), "labels")
    scores = score_candidates(
        asked.select("q").distinct(), named.select("c", "kind").distinct(), equivalent_tokens(taxonomy.sparkSession)
    )
    hits = scores.filter(F.col("score") >= least_score).join(named, ["c", "kind"])
    # The first label among the best: own names before terms, heavier terms before lighter.
    order = F.struct(-F.col("score"), "section", -F.col("weight"), "label")
    best = hits.groupBy("q", "service_id").agg(F.min_by(F.struct("score", "kind", F.col("label").alias("matched_term")), order).alias("b"))
    score, kind = F.col("b.score"), F.col("b.kind")
    matched_by = (
        F.when(kind == "intent", "intent")
        .when((kind == "canonical") & (score >= 80), "canonical")
        .when((kind == "alias") & (score >= 70), "alias")
        .when(score >= 40, "token").otherwise("fuzzy")
    )
    rows = best.select("q", "service_id", score.alias("score"), matched_by.alias("matched_by"), "b.matched_term").join(
        taxonomy.select("service_id", "slug", "name"), "service_id"
    )
    top = top_per_group(rows, ["q"], [F.col("score").desc(), F.collate("name", "it"), F.col("service_id")], max(1, limit), "place")
    return asked.join(top, "q").drop("q")


def resolve_service(queries: DataFrame, taxonomy: DataFrame, terms: DataFrame) -> DataFrame:
    """The one service a query means; generic queries mean none."""
    useful = settle(queries.select("query").distinct(), "queries").filter(~is_generic_query(F.col("query")))
    return rank_services(useful, taxonomy, terms, 1).drop("place")


def zero_result_log(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Queries that found nothing, by normalised text: how often asked, in how many spellings."""
    missed = queries.join(ranked.select("query").distinct(), "query", "left_anti")
    return missed.groupBy(normalize_query(F.col("query")).alias("normalized")).agg(
        F.sum("asked").alias("asked"), F.count("*").alias("spellings")
    )


def contained_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, c) where the text q, of two letters or more, occurs in c.

    A suffix array as rows: each place of a label is held under the letters that start there, in the powers of two that
    are the length of a query rounded down, and a query looks under its own beginning of that length. So the rows are at
    most the letters of the labels times the few powers in use, and what is met shares at least half of the query."""
    sized = queries.select("q").filter("length(q) >= 2").distinct().withColumn(
        "_level", F.expr("shiftleft(1, length(bin(length(q))) - 1)"))
    asks = sized.select("q", F.expr("left(q, _level)").alias("_start"))
    levels = sized.agg(F.collect_set("_level").alias("_levels"))  # one row, at most 30 numbers
    size = F.length("c")
    places = candidates.select("c").filter("length(c) >= 2").distinct().crossJoin(F.broadcast(levels)).select(
        "c", F.explode(F.array_distinct(F.flatten(F.transform(
            F.filter("_levels", lambda n: n <= size),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.col("c").substr(at, n)),
        )))).alias("_start"))
    return asks.join(places, "_start").filter(F.contains("c", F.col("q"))).select("q", "c")


#: Share of typed words that have to be answered for a suggestion.
_COVERED = 0.66


def covered_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, c, share): share of the words of q, two letters or more each, that begin or are begun by a word of c, where
    it reaches two thirds (0.66).

    Of n words as many have to be answered that any n - needed + 1 of them contain an answered one. So labels are met
    through those words of a query that the fewest labels answer, and then looked at whole: a word that every label
    has, and a long sentence with a few known words, bring no pairs."""
    texts = queries.select("q").distinct().withColumn("_t", F.filter(F.split("q", " "), lambda t: F.length(t) > 1))
    typed = texts.select("q", F.size("_t").alias("_n"), F.posexplode("_t").alias("_at", "t"))
    pieces = candidates.select("c").distinct().select("c", F.explode(F.array_distinct(F.split("c", " "))).alias("p"))
    answers = settle(prefix_pairs(typed.select(F.col("t").alias("q")).distinct(), pieces.select(F.col("p").alias("c")).distinct()).distinct().select(
        F.col("q").alias("t"), F.col("c").alias("p")), "answers")
    often = answers.join(pieces.groupBy("p").agg(F.count("*").alias("_df")), "p").groupBy("t").agg(F.sum("_df").alias("_df"))
    rarest = Window.partitionBy("q").orderBy(F.coalesce("_df", F.lit(0)), "_at")  # the words of one text
    telling = typed.join(often, "t", "left").withColumn("_rank", F.row_number().over(rarest)).filter(
        F.col("_rank") <= F.col("_n") - F.ceil(F.col("_n") * _COVERED - 1e-9) + 1)
    met = telling.select("q", "t").distinct().join(answers, "t").join(pieces, "p").select("q", "c").distinct()
    fits = lambda t, p: F.startswith(p, t) | F.startswith(t, p)
    answered = F.filter("_t", lambda t: F.exists(F.split("c", " "), lambda p: fits(t, p)))
    return met.join(texts, "q").select("q", "c", (F.size(answered) / F.size("_t")).alias("share")).filter(F.col("share") >= _COVERED)


def autocomplete(queries: DataFrame, services: DataFrame, terms: DataFrame, limit: int = 6) -> DataFrame:
    """Suggestions while typing: equal 100, prefix 85, contained 75, else by the share of typed words that
    begin, or are begun by, a word of the label (two thirds at least).

    queries: query. services: service_id, name, slug. terms: service_id, term."""
    asked = asked_texts(queries).select("q").distinct().filter("length(q) >= 2")
    own = services.select("service_id", F.col("name").alias("label"), F.lit(0).alias("_section"))
    listed = settle(own.unionByName(terms.join(services.select("service_id"), "service_id").select(
        "service_id", F.col("term").alias("label"), F.lit(1).alias("_section"))), "listed")
    named = settle(listed.withColumn("c", normalize_query(F.col("label"))).filter("c <> ''"), "labels")
    plain = named.select("c").distinct()
    contained = contained_pairs(asked, plain).select(
        "q", "c", F.when(F.col("q") == F.col("c"), 100).when(F.col("c").startswith(F.col("q")), 85).otherwise(75).alias("score")
    )
    coverage = covered_pairs(asked, plain).select("q", "c", (50 + F.floor(F.col("share") * 15 + 0.5)).cast("int").alias("score"))
    scores = contained.unionByName(coverage).groupBy("q", "c").agg(F.max("score").alias("score"))
    best = scores.join(named, "c").groupBy("q", "service_id").agg(
        F.max("score").alias("score"), F.min_by("label", F.struct(-F.col("score"), "_section", "label")).alias("matched_term")
    ).join(services.select("service_id", "name", "slug"), "service_id")
    return top_per_group(best, ["q"], [F.col("score").desc(), F.collate("name", "it"), F.col("service_id")], limit, "place")
