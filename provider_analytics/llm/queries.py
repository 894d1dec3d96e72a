"""The registered queries of this package and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (fair_mix, feistel, iblt, jaccard_join, language_id, licenses, lyndon_runs, packing, pii, tiff,
               token_alignment, url_filter, wavelet)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def joined(items: Column) -> Column:
    return F.array_join(items, ",")


#: Fixed values of the query.
URL_RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)

_URL_SQL = """
WITH rules(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
                                     ('net/es/', 'block'), ('net/fr/', 'block')),
cut AS (SELECT *, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
urls AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
fitting AS (
  SELECT page_id, host, path, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rule_host) DESC) AS place
  FROM parts LEFT JOIN cut ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE place = 1
"""


@register("op1_url_filter", _URL_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


#: Of the packing query: the limits of a sequence, and the id that ends a document.
PACK_LIMITS = packing.Limits(tokens=4096, segments=128, loss=4096)
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op2_vector_packing")
def op2_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    ids = packing.tokenize(table(spark, folder, "documents"), tokenizer_path(), END_ID)
    return packing.pack(ids, PACK_LIMITS).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@register("op3_tiff_pages")
def op3_tiff_pages(spark: SparkSession, folder: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff.with_features(tiff.pages_of(stored, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256")))
    return pages.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("bigint").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -16, 16)")).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", "compression", "error")


@register("op4_feistel_shards")
def op4_feistel_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = feistel.shard_documents(table(spark, folder, "documents"), shards=16, seed=42)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row")


@register("op5_license_rules")
def op5_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    return found.withColumns({"base_labels": joined(F.col("base_labels")), "labels": joined(F.col("labels")),
                              "detections": joined(F.transform("detections", lambda d: F.concat_ws(":", d["label"], d["start_word"], d["end_word"])))})


_MIX_SQL = r"""
WITH docs AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM sizes),
capped AS (SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / w AS ratio FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM capped),
filled AS (SELECT min(ratio) AS first_open, min_by(level, ratio) AS level FROM levels WHERE level < ratio),
targets AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL OR ratio <= f.level THEN CAST(cap AS DOUBLE) ELSE f.level * w END AS target
  FROM capped, filled f),
copies AS (SELECT doc_id, source, size, epoch, md5('7:' || epoch || ':' || doc_id) AS key FROM docs, (VALUES (0), (1)) e(epoch) WHERE size > 0),
queued AS (
  SELECT c.*, sum(size) OVER (PARTITION BY c.source ORDER BY epoch, key ROWS UNBOUNDED PRECEDING) / t.target AS finish
  FROM copies c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
used AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, key ROWS UNBOUNDED PRECEDING) AS used FROM queued),
taken AS (SELECT doc_id, count(*) AS copies FROM used WHERE used <= (SELECT sum(size) * CAST(1.5 AS DOUBLE) FROM docs) GROUP BY doc_id)
SELECT d.doc_id, d.size, d.source, t.source_size, t.target, coalesce(k.copies, 0) AS copies, coalesce(k.copies, 0) * d.size AS taken
FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON k.doc_id = d.doc_id
"""


@register("op6_fair_mix", _MIX_SQL)
def op6_fair_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    mixed = fair_mix.mix_sources(docs, fair_mix.word_count(F.col("text")), weights=(5, 2, 1), share=1.5, repeats=2, seed=7)
    return mixed.drop("row")


@register("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    predicted = language_id.predict_languages(docs, language_id.fit_languages(docs))
    return predicted.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op8_lookup_sketch")
def op8_lookup_sketch(spark: SparkSession, folder: str) -> DataFrame:
    sketched = iblt.fingerprint_documents(table(spark, folder, "documents"))
    return sketched.withColumns({"only_edited": F.size("only_edited"), "only_next": F.size("only_next")})


def spans_text(spans: Column) -> Column:
    return joined(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@register("op9_personal_data")
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = pii.find_pii(docs, pii.fit_pii(docs))
    strict = F.filter("spans", lambda s: s["strict"])
    kinds = F.transform(strict, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(strict), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@register("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: every tenth document by hash repeats the words of a stretch up to its end, as the query states."""
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = hashed.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    sized = words.withColumns({"n": F.size("words").cast("bigint"), "g": F.expr("h div 10")})
    cut = sized.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeats = F.expr("""array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a + 1), int(p)),
                        int((n - a + p - 1) div p))), 1, int(n - a))), ' ')""")
    return cut.select("doc_id", F.when(F.col("p").isNotNull(), repeats).otherwise(F.col("text")).alias("text"))


@register("op11_lyndon_runs")
def op11_lyndon_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = lyndon_runs.detect_runs(with_repeats(table(spark, folder, "documents")))
    runs = F.col("runs")  # by start and period: of equal exponents the first stays
    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.alignment_measures(table(spark, folder, "documents"), *files)


@register("op13_wavelet_shards")
def op13_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    files = wavelet.write_shards(table(spark, folder, "documents"), tokenizer_path(), END_ID)
    return wavelet.read_documents(files).select("doc_id", "start", F.col("tokens").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
