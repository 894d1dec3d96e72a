"""Row filters of the directory: text search, status guards, backlogs, content checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import records, text
from . import postings
from .skew import place_in_group, settle, top_per_group

BLOCK = 512  # ids of one term that meet at a time, on either side
_ALL = 2**31 - 1  # more partitions than any frame has


def published(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "published")


def _like_pattern(term: str) -> str:
    """Literal text inside a LIKE pattern."""
    return "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def ilike_search(df: DataFrame, term: str | None, columns: list[str]) -> DataFrame:
    """Case-insensitive contains over any of the columns; a blank term filters nothing."""
    needle = (term or "").strip()
    if not needle:
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")).ilike(_like_pattern(needle)) for c in columns]))


def term_key(column: Column) -> Column:
    """A search term as texts are searched for it."""
    return F.lower(F.trim(F.coalesce(column, F.lit(""))))


def containing(terms: DataFrame, df: DataFrame, key: str, columns: list[str], joined: bool = False) -> DataFrame:
    """(term, key) for every row of `df` that holds the term: in any of the columns, or in all of them put together.

    terms: term, as term_key makes it. A blank term, which filters nothing, is not answered here. Texts are indexed by
    their pieces of one to three characters; a term looks up its rarest piece only, and what that finds is tested
    whole. Equal texts are tested once."""
    values = [F.lower(F.concat_ws(" ", *columns))] if joined else [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    held = df.select(key, F.explode(F.array(*values)).alias("_text")).filter("_text <> ''").distinct()
    texts = held.select("_text").distinct()
    asked = terms.select("term").filter("term <> ''").distinct()
    sizes = asked.select(F.least(F.length("term"), F.lit(3)).alias("_n")).distinct()  # three rows at most

    def pieces(df_: DataFrame, column: str, size: Column) -> DataFrame:
        parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - size + 1), lambda i: F.substring(column, i, size)))
        return df_.filter(F.length(column) >= size).withColumn("_piece", F.explode(parts))

    spelled = pieces(texts.crossJoin(F.broadcast(sizes)), "_text", F.col("_n")).select("_piece", "_text")
    counts = spelled.groupBy("_piece").agg(F.count("*").alias("_count"))
    chosen = pieces(asked, "term", F.least(F.length("term"), F.lit(3))).join(counts, "_piece", "left").groupBy("term").agg(
        F.min_by("_piece", F.struct(F.coalesce("_count", F.lit(0)).alias("n"), F.col("_piece").alias("p"))).alias("_piece"))
    found = chosen.join(spelled, "_piece").filter(F.contains("_text", F.col("term"))).select("term", "_text")
    return found.join(held, "_text").select("term", key).distinct()


def search_texts(requests: DataFrame, df: DataFrame, key: str, columns: list[str], joined: bool = False) -> DataFrame:
    """(request_id, key) of a frame of requests (request_id, term): rows that hold the term. Requests for one term share
    one search; a request without a term is not answered, as it asks for everything."""
    asked = requests.select("request_id", term_key(F.col("term")).alias("term")).filter("term <> ''")
    return every_pair(asked, settle(containing(asked, df, key, columns, joined), "found"), "term", "request_id", key)


def every_pair(left: DataFrame, right: DataFrame, group: str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) of all rows that share a group, where the pairs are far more than the rows.

    Ids of a group are cut into blocks, and every two blocks meet on their own, so a group with many pairs spreads over all
    tasks and a task holds BLOCK rows at a time. Blocks are dealt as lists, which become rows last: the shuffle holds
    two ids for every BLOCK pairs. A column of the rows has runs or few values near each other, which takes little space in files."""

    def tiles(own: DataFrame, id_: str, other: DataFrame, names: tuple[str, str, str]) -> DataFrame:
        sizes = other.groupBy(group).agg(F.count("*").alias("_others"))
        placed = place_in_group(own.select(group, id_).join(sizes, group), [group], [F.col(id_)], "_place")
        block = F.floor((F.col("_place") - 1) / BLOCK).alias(names[0])
        lists = placed.groupBy(group, "_others", block).agg(F.collect_list(F.struct(F.col(id_).alias("id"))).alias(names[2]))  # a struct: ids may be null
        lists = lists.withColumn(names[2], F.col(names[2])["id"])
        meets = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_others") - 1) / BLOCK))
        return lists.withColumn(names[1], F.explode(meets)).drop("_others").repartition(tasks, *keys)

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for few bytes: rows come after the join
    keys = [group, "_block", "_other"]
    met = tiles(left, left_id, right, ("_block", "_other", "_left")).join(tiles(right, right_id, left, ("_other", "_block", "_right")), keys)
    # What one row becomes is held until it is taken, so the two lists become rows in two steps: coalesce, which deals nothing and
    # leaves so many partitions as they are, keeps generated code from making all rows of a meeting out of one.
    halves = met.select(F.explode("_left").alias(left_id), "_right").coalesce(_ALL)
    return halves.select(left_id, F.explode("_right").alias(right_id))


def ci_key(column: Column) -> Column:
    """Key column for case-insensitive equality."""
    return F.lower(F.trim(column))


def filter_any_column(df: DataFrame, needle: str, columns: list[str], keep_all_if_none: bool = False) -> DataFrame:
    """Needle in any of the columns; optionally the unfiltered rows when nothing matches."""
    wanted = needle.strip().lower()
    if not wanted:
        return df
    hit = F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))
    if not keep_all_if_none:
        return df.filter(hit)
    any_hit = df.agg(F.max(F.when(hit, 1).otherwise(0)).alias("_any"))  # one row
    return df.crossJoin(F.broadcast(any_hit)).filter(hit | (F.coalesce(F.col("_any"), F.lit(0)) == 0)).drop("_any")


def valid_profile_url(url: Column, hosts: list[str], path_prefixes: list[str], placeholders: list[str] = ()) -> Column:
    """Host on the list, path below one of the prefixes and not empty after it, no placeholder in it."""
    host, path = text.url_host(url), text.url_path(url)
    on_list = reduce(lambda a, b: a | b, [host.endswith(h) for h in hosts])
    below = reduce(lambda a, b: a | b, [path.startswith(p) & (F.length(path) > len(p)) for p in path_prefixes])
    placeholder = reduce(
        lambda a, b: a | b, [F.contains(F.concat(path, F.lit("/")), F.lit(p)) for p in placeholders], F.lit(False)
    )
    return on_list & below & ~placeholder


def stale_rows(df: DataFrame, checked_at: str, now: Column, days: int, limit: int, tie: str) -> DataFrame:
    """Never checked, or checked more than `days` ago; oldest first."""
    due = df.filter(F.col(checked_at).isNull() | (F.col(checked_at) < now - F.expr(f"INTERVAL {days} DAYS")))
    return due.orderBy(F.col(checked_at).asc_nulls_first(), tie).limit(limit)


def needs_geocode(providers: DataFrame, observations: DataFrame, source: str) -> DataFrame:
    """Published, no coordinates, an address to look up, and no settled attempt at the source yet."""
    settled = observations.filter((F.col("source") == source) & F.col("status").isin("completed", "empty"))
    return published(providers).filter(
        (F.col("lat").isNull() | F.col("lng").isNull())
        & (F.coalesce(F.trim("address"), F.lit("")) != "")
        & (F.coalesce(F.trim("comune"), F.lit("")) != "")
    ).join(settled.select("provider_id").distinct(), "provider_id", "left_anti")


def needs_enrichment(providers: DataFrame, observations: DataFrame, source: str, first_comuni: list[str],
                     offset: int, limit: int) -> DataFrame:
    """Published providers the source was never asked about; listed comuni first, in list order."""
    todo = published(providers).join(
        observations.filter(F.col("source") == source).select("provider_id").distinct(), "provider_id", "left_anti"
    )
    place = F.array_position(F.array(*[F.lit(c.lower()) for c in first_comuni]), F.lower("comune")) if first_comuni \
        else F.lit(0)
    first = F.when(place > 0, place).otherwise(F.lit(len(first_comuni) + 1))
    return todo.orderBy(first, "full_name", "provider_id").offset(offset).limit(limit)


def content_gap(df: DataFrame, body: str, short: int = 200) -> DataFrame:
    """How complete each editorial text is; `gap` marks missing or short ones."""
    size = F.length(F.trim(F.coalesce(F.col(body), F.lit(""))))
    return df.withColumn("chars", size.cast("bigint")).withColumn("has_text", size > short).withColumn("gap", size < short)


def content_validate(df: DataFrame, body: str, faqs_json: str, min_chars: int = 2500, min_faqs: int = 5,
                     min_question: int = 12, min_answer: int = 80, first: int = 6) -> DataFrame:
    """Accept generated content, or say why not."""
    parsed = records.canonical_json(F.col(faqs_json), records.FAQ_TYPE)["faqs"]
    good = F.size(F.filter(
        F.slice(parsed, 1, first),
        lambda f: (F.length(F.trim(f["question"])) >= min_question) & (F.length(F.trim(f["answer"])) >= min_answer),
    ))
    out = df.withColumn("good_faqs", F.greatest(F.coalesce(good, F.lit(0)), F.lit(0)).cast("bigint"))
    reason = (
        F.when(F.length(F.trim(F.coalesce(F.col(body), F.lit("")))) < min_chars, "body too short")
        .when(F.col("good_faqs") < min_faqs, "too few questions")
        .otherwise("ok")
    )
    return out.withColumn("verdict", reason)


def claimable_search(providers: DataFrame, term: str, limit: int = 12) -> DataFrame:
    """Providers an owner may look for: unowned first, exact name first. Terms under two characters find nothing."""
    needle = term.strip()
    found = ilike_search(published(providers), needle, ["full_name", "comune"]) if len(needle) >= 2 else providers.limit(0)
    return found.orderBy(
        F.col("owner_email").isNotNull(), F.lower("full_name") != needle.lower(), "full_name", "provider_id"
    ).limit(limit)


def claimable_searches(requests: DataFrame, providers: DataFrame, limit: int = 12) -> DataFrame:
    """The same for a frame of requests (request_id, term): request_id, provider_id, place. Equal terms are searched once."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = published(providers).select("provider_id", "full_name", low("full_name").alias("_name"), low("comune").alias("_comune"),
                                       F.col("owner_email").isNotNull().cast("int").alias("_owned"))
    asked = requests.select("request_id", term_key(F.col("term")).alias("term")).filter(F.length("term") >= 2)
    # Tiers: unowned or owned, and in each the exact name or one that holds the term.
    tiers = asked.select("term").distinct().withColumn("tier", F.explode(F.array(*map(F.lit, range(4)))))
    exact = F.col("tier") % 2 == 0
    keys = F.when(exact, F.array(F.concat(F.lit("=:"), "term"))).otherwise(postings.asked_pieces(F.col("term"), "t:"))
    wanted = settle(tiers.withColumn("key", F.explode(keys)), "asked-keys")
    distinct = wanted.select("key").distinct()
    entries = rows.select(F.concat(F.lit("=:"), "_name").alias("key"), "provider_id").join(distinct, "key", "left_semi").unionByName(
        postings.listed_pieces(rows, "provider_id", F.col("_name"), "t:", distinct).unionByName(
            postings.listed_pieces(rows, "provider_id", F.col("_comune"), "t:", distinct)).distinct())

    def test(df: DataFrame) -> DataFrame:
        equal = F.col("_name") == F.col("term")
        fits = F.when(exact, equal).otherwise(~equal & (F.contains("_name", F.col("term")) | F.contains("_comune", F.col("term"))))
        return df.filter(fits & (F.col("_owned") == F.floor(F.col("tier") / 2)))

    found = postings.first_matches(tiers, wanted, entries, rows, "provider_id", ["term"], [F.col("full_name"), F.col("provider_id")], test, limit)
    return asked.join(found, "term").select("request_id", "provider_id", "place")


def shortlist_by_name(candidates: DataFrame, name: str, url: str, group: list[str], position: str,
                      with_hit: int = 8, without_hit: int = 3) -> DataFrame:
    """Candidate URLs per provider by the number of name words in the URL: the best eight of those with a
    hit, or the first three when no URL has one."""
    lowered = F.lower(F.col(url))
    scored = candidates.withColumn(
        "hits", F.size(F.filter(text.url_name_tokens(F.col(name)), lambda t: F.contains(lowered, t))).cast("bigint")
    )
    order = [F.col("hits").desc(), F.col(position), F.col(url)]
    best = top_per_group(scored, group, order, with_hit, "place")
    top = best.groupBy(*group).agg(F.max("hits").alias("_top"))
    return best.join(top, group).filter(
        ((F.col("_top") > 0) & (F.col("hits") > 0)) | ((F.col("_top") == 0) & (F.col("place") <= without_hit))
    ).drop("_top")
