"""Relevance, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import place_in_group, top_per_group

PAGE_SIZE = 15
#: Up to this rank Spark cuts every group before the shuffle; later pages are numbered by one range sort.
CUT_RANK = 1000
#: Nearness adds to a score up to this distance.
NEARNESS_KM = 45.0


def relevance_score(rating: Column, reviews: Column, services: Column, km: Column) -> Column:
    """Reviews weigh by rating and by the order of magnitude of their number; nearness is worth up to 45."""
    count = F.coalesce(reviews, F.lit(0))
    from_reviews = F.when(count > 0, F.coalesce(rating, F.lit(0.0)) * F.log10(count + 1) * 12).otherwise(0.0)
    from_distance = F.when(km.isNull(), F.lit(-20.0)).otherwise(F.greatest(F.lit(0.0), F.lit(NEARNESS_KM) - km))
    return F.round(from_reviews + F.coalesce(services, F.lit(0)) * 6 + from_distance, 6)


def by_relevance(name: str = "full_name", tie: str = "provider_id") -> list[Column]:
    """Score, then distance with unknown last, then name in Italian order."""
    return [
        F.col("relevance_score").desc(),
        F.col("distance_km").asc_nulls_last(),
        F.collate(F.col(name), "it"),
        F.col(tie),
    ]


def rank_by_relevance(df: DataFrame, group: list[str], k: int) -> DataFrame:
    """First k rows per group by relevance, numbered in `place`."""
    return top_per_group(df, group, by_relevance(), k, "place")


def paginate(df: DataFrame, group: list[str], order: list[Column], page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page per group with `total`, `total_pages`, `page` (clamped to what exists) and `place`.

    Totals are a partial aggregate. Early pages are cut per task before the shuffle; for late ones all rows are
    numbered by a range sort, so a group of any size never has to fit one task."""
    wanted, size = max(1, page), max(1, page_size)
    ranked = top_per_group(df, group, order, wanted * size, "place") if wanted * size <= CUT_RANK else place_in_group(df, group, order, "place")
    return page_of(ranked, df.groupBy(*group).agg(F.count("*").alias("total")), group, wanted, size)


def page_of(ranked: DataFrame, totals: DataFrame, group: list[str], page: int, page_size: int) -> DataFrame:
    """The rows of one page, clamped to what exists, of rows with their `place`, given the `total` of each group."""
    pages = _paged(totals, page_size).withColumn("page", F.least(F.lit(page), F.col("total_pages")).cast("bigint"))
    return _on_page(ranked, pages, group, page_size)


def paginate_by(df: DataFrame, group: list[str], order: list[Column], asked: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Same, with the pages asked for in a frame: the group's columns and asked_page, several per group if need be.

    Groups are cut to the largest early page that anybody asks for. Only where a later page is asked for as well, and
    only in groups that have it, all rows are numbered by a range sort."""
    size = max(1, page_size)
    early = F.when(F.col("asked_page") <= CUT_RANK // size, F.greatest(F.lit(1), F.col("asked_page")))
    most, last = asked.agg(F.max(early), F.max("asked_page")).first()
    cut = (most or 0) * size
    pages = asked.join(_totals(df, group, size), group).withColumn(
        "page", F.least(F.greatest(F.lit(1), F.col("asked_page")), F.col("total_pages")).cast("bigint")
    )
    first = _on_page(top_per_group(df, group, order, cut, "place"), pages.filter(F.col("page") * size <= cut), group, size)
    if max(1, last or 1) * size <= cut:
        return first
    later = pages.filter(F.col("page") * size > cut)
    numbered = place_in_group(df.join(later.select(*group).distinct(), group, "left_semi"), group, order, "place")
    return first.unionByName(_on_page(numbered, later, group, size).select(*first.columns))


def _totals(df: DataFrame, group: list[str], size: int) -> DataFrame:
    return _paged(df.groupBy(*group).agg(F.count("*").alias("total")), size)


def _paged(totals: DataFrame, size: int) -> DataFrame:
    return totals.withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint"))


def _on_page(ranked: DataFrame, pages: DataFrame, group: list[str], size: int) -> DataFrame:
    return ranked.join(pages, group).filter(
        (F.col("place") > (F.col("page") - 1) * size) & (F.col("place") <= F.col("page") * size)
    )
