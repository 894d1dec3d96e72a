"""Top-k text search over postings in rank order.

Every row is listed under keys: the pieces of one to three characters of its texts, and whatever else a search can ask
for. Lists are in the order results are wanted in. A search falls into tiers, the better ones first; each tier reads the
shortest list that must hold all its rows, tests what it reads whole, and stops when it or the tiers before it have k
rows. Reading goes by windows that grow, so a tier reads little more than it needs, and rows handed on follow the
number of searches, not how many rows they match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import place_in_group, settle, top_per_group

#: Characters of a piece, rows of a list read at first, and how much further each round reads.
PIECE, FIRST, GROWTH = 3, 64, 32


def _pieces(column: Column, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - size + 1), lambda i: F.substring(column, i, size)))


def asked_pieces(term: Column, space: str) -> Column:
    """The keys under which every text that holds the term is listed; none for an empty term."""
    size = F.least(F.length(term), F.lit(PIECE))
    keys = F.transform(_pieces(term, size), lambda p: F.concat(F.lit(space), p))
    return F.when(F.length(term) > 0, keys).otherwise(F.array().cast("array<string>"))


def listed_pieces(rows: DataFrame, row: str, text: Column, space: str, asked: DataFrame) -> DataFrame:
    """(key, row) for the pieces of a text that are asked for (asked: key). Equal texts are cut once."""
    held = rows.select(row, text.alias("_text")).filter("_text <> ''")
    own = asked.filter(F.col("key").startswith(space))
    sizes = own.select((F.length("key") - len(space)).alias("_n")).distinct()  # PIECE rows at most
    cut = held.select("_text").distinct().crossJoin(F.broadcast(sizes)).filter(F.length("_text") >= F.col("_n"))
    keys = cut.select("_text", F.explode(_pieces(F.col("_text"), F.col("_n"))).alias("_piece"))
    found = keys.select("_text", F.concat(F.lit(space), "_piece").alias("key")).join(own, "key", "left_semi")
    return found.join(held, "_text").select("key", row)


def first_matches(tiers: DataFrame, wanted: DataFrame, entries: DataFrame, rows: DataFrame, row: str, search: list[str],
                  order: list[Column], test: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """search columns, tier, row, place: the k first rows of each search, tiers in ascending order, then `order`, total.

    tiers: search columns, tier (int), and what `test` needs. wanted: search columns, tier, key; a tier's rows must be in the
    list of each of its keys, and it reads the shortest. entries: (key, row), each once. rows: row and what `order`
    and `test` need. `test` keeps, of tiers joined with rows, the rows that belong; a row belongs to one tier of
    a search at most. Hot lists are ranges of one sort; a hot search or list meets a window of bounded size."""
    sub = [*search, "tier"]
    entries = settle(entries, "entries")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size"))
    chosen = wanted.join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(0))).groupBy(*sub).agg(
        F.min(F.struct("size", "key")).alias("_best")).select(*sub, "_best.key", "_best.size").filter("size > 0")
    still = settle(tiers.join(chosen, sub), "open-tiers")
    lists = entries.join(still.select("key").distinct(), "key", "left_semi").join(rows, row)
    lists = settle(place_in_group(lists, ["key"], order, "at"), "postings")
    found, low, high = None, 0, FIRST
    while not still.isEmpty():
        window = lists.filter((F.col("at") > low) & (F.col("at") <= high))
        hits = top_per_group(test(still.join(window, "key")), sub, [F.col("at")], k).select(*sub, row, "at")
        hits = settle(hits, "found")
        found = hits if found is None else found.unionByName(hits)
        longer = still.filter(F.col("size") > high)
        had = found.groupBy(*sub).agg(F.count("*").alias("_n")).withColumnRenamed("tier", "_tier")
        full = longer.select(*sub).join(had, search).filter("_tier <= tier").groupBy(*sub).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k)
        still = settle(longer.join(full.select(*sub), sub, "left_anti"), "open-tiers")
        low, high = high, high * GROWTH
    if found is None:
        found = still.join(rows.select(row), F.lit(False)).select(*sub, row, F.lit(0).cast("bigint").alias("at"))
    return top_per_group(found, search, [F.col("tier"), F.col("at")], k, "place").select(*sub, row, "place")
