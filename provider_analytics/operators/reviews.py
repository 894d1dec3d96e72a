"""Reviews: latest, sentiment by lexicon, summaries, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_query
from .skew import settle, top_per_group

# Word stems that speak for or against a provider, by aspect, in report order.
ASPECTS = {
    "professionalita": {
        "positive": ["professional", "competent", "preparat", "precis", "scrupolos", "seri"],
        "negative": ["incompetent", "imprecis", "errore", "superficial"],
    },
    "chiarezza": {
        "positive": ["chiar", "spieg", "trasparent", "comprensib", "esaustiv"],
        "negative": ["poco chiar", "confus", "non spieg", "informazioni insufficienti"],
    },
    "disponibilita": {
        "positive": ["disponibil", "gentil", "cordial", "ascolto", "cortes"],
        "negative": ["scortes", "indisponibil", "maleducat", "non risponde"],
    },
    "rapidita": {
        "positive": ["rapid", "veloc", "puntual", "tempestiv", "attesa brev", "senza attesa"],
        "negative": [
            "lent", "ritard", "tempi lunghi", "lunga attesa", "sei mesi", "mesi per", "mai portato a termine",
        ],
    },
    "costi": {
        "positive": [
            "prezzo onesto", "prezzi onesti", "costi onesti", "ottimi sono i prezzi", "costo chiar",
            "preventivo chiar", "convenient",
        ],
        "negative": ["costos", "caro", "costo eccessiv", "sorpresa sul prezzo"],
    },
    "comunicazione": {
        "positive": ["comunicazione chiar", "rispost rapid", "sempre reperibil", "facile da contattare"],
        "negative": ["introvabil", "irreperibil", "non risponde", "lunga nelle risposte", "lunghe nelle risposte"],
    },
}
# How aspects are called in lists of strengths and concerns.
ASPECT_LABELS = {
    "professionalita": "Professionalità",
    "chiarezza": "Chiarezza",
    "disponibilita": "Disponibilità",
    "rapidita": "Tempi",
    "costi": "Trasparenza dei costi",
    "comunicazione": "Comunicazione",
}


def latest_reviews(reviews: DataFrame, k: int = 3) -> DataFrame:
    """Newest reviews with text per provider; k is kept between 1 and 5."""
    wanted = min(5, max(1, k))
    with_text = reviews.filter(F.trim("text") != "")
    return top_per_group(with_text, ["provider_id"], [F.col("published_day").desc_nulls_last(), F.col("review_id")], wanted, "place")


def _hit(text: Column, stems: list[str]) -> Column:
    out = F.lit(False)
    for stem in stems:
        out = out | F.contains(text, F.lit(stem))
    return out


def aspect_sentiment(reviews: DataFrame, aspects: dict | None = None) -> DataFrame:
    """Per provider and aspect: reviews for and against (one each per review at most), share, label and the
    first two reviews that say so. Stems are tested as plain substrings of the normalised text.

    The lexicon is a literal of the plan. Each text is read and normalised once and leaves two numbers, a bit for every
    aspect spoken for and one for every aspect spoken against; counts and evidence are worked out from these."""
    table = aspects or ASPECTS
    names = list(table)
    if len(names) > 62:
        raise ValueError("at most 62 aspects")
    bits = lambda t, side: reduce(
        Column.bitwiseOR, [F.when(_hit(t, table[name][side]), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, name in enumerate(names)])
    # Binding the text to a lambda variable makes sure it is normalised once per review, not once per stem.
    masks = F.transform(F.array(normalize_query(F.col("text"))), lambda t: F.struct(bits(t, "positive").alias("_pos"), bits(t, "negative").alias("_neg")))
    marks = settle(reviews.select("provider_id", "review_id", F.inline(masks)), "review-marks")
    has = lambda side, i: F.col(side).bitwiseAND(1 << i) != 0
    counted = marks.groupBy("provider_id").agg(*[
        F.count_if(has(side, i)).alias(f"{side}{i}") for i in range(len(names)) for side in ("_pos", "_neg")
    ]).select("provider_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("aspect_no"), F.lit(name).alias("aspect"), F.col(f"_pos{i}").alias("positive_hits"), F.col(f"_neg{i}").alias("negative_hits"))
        for i, name in enumerate(names)
    ])))
    spoken = F.array_compact(F.array(*[F.when(has("_pos", i) | has("_neg", i), F.lit(i)) for i in range(len(names))]))
    hits = marks.select("provider_id", "review_id", F.explode(spoken).alias("aspect_no"))
    evidence = top_per_group(
        hits, ["provider_id", "aspect_no"], [F.col("review_id")], 2,
    ).groupBy("provider_id", "aspect_no").agg(F.array_join(F.array_sort(F.collect_list("review_id")).cast("array<string>"), ",").alias("evidence"))
    total = F.col("positive_hits") + F.col("negative_hits")
    share = F.when(total > 0, F.col("positive_hits") / total)
    return (
        counted.join(evidence, ["provider_id", "aspect_no"], "left")
        .withColumn("evidence", F.coalesce("evidence", F.lit("")))
        .withColumn("_share", share)
        .withColumn("label", F.when(F.col("_share") >= 0.67, "positive").when(F.col("_share") <= 0.33, "negative").otherwise("neutral"))
        .withColumn("score", F.bround("_share", 2))
        .drop("_share")
    )


def overall_sentiment(aspects: DataFrame, ratings: DataFrame, labels: dict | None = None) -> DataFrame:
    """One row per provider: label and score from the mean rating, up to three strengths and concerns in
    aspect order, and whether the texts are only a sample of all ratings.

    ratings: provider_id, rating_avg (nullable), review_count, sample_count."""
    names = labels or ASPECT_LABELS
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    marked = aspects.withColumn("_name", F.coalesce(lookup[F.col("aspect")], F.col("aspect")))
    # At most one row per aspect and provider, so the lists are as short as the lexicon.
    ordered = lambda label: F.array_join(F.slice(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("aspect_no", "_name")))), lambda x: x["_name"]
    ), 1, 3), ", ")
    lists = marked.groupBy("provider_id").agg(ordered("positive").alias("strengths"), ordered("negative").alias("concerns"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce((F.col("rating_avg") - 1) / 4, F.lit(0.5))))
    total = F.when(F.coalesce("review_count", F.lit(0)) > 0, F.col("review_count")).otherwise(F.col("sample_count"))
    return (
        ratings.join(lists, "provider_id", "left")
        .withColumn("strengths", F.coalesce("strengths", F.lit("")))
        .withColumn("concerns", F.coalesce("concerns", F.lit("")))
        .withColumn("_score", score)
        .withColumn("label", F.when(F.col("_score") >= 0.75, "positive").when(F.col("_score") <= 0.40, "negative").otherwise("neutral"))
        .withColumn("score", F.bround("_score", 2))
        .withColumn("aggregate_count", total.cast("bigint"))
        .withColumn("sample_is_partial", total > F.col("sample_count"))
        .drop("_score")
    )


def review_upsert(current: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Reviews by (provider, source, author, published, text hash): the latest version of each wins; rows
    not seen again stay."""
    key = ["provider_id", "source", "author", "published_day", "text_hash"]
    both = current.withColumn("_rank", F.lit(1)).unionByName(incoming.withColumn("_rank", F.lit(0)))
    return top_per_group(both, key, [F.col("_rank"), *order], 1).drop("_rank")


def summarize_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("provider_id", "source").agg(
        F.count("*").alias("review_count"), F.round(F.avg(F.col("rating").cast("double")), 2).alias("rating_avg")
    )
