"""Writes as new table versions: upserts, survivorship, patches, backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import top_per_group


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order."""
    return top_per_group(df, keys, order, 1)


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """New version of `target` with `incoming` (unique per key) inserted or merged, and what happened in `action`.

    `update` gives merged values of columns, written over `old.` and `new.` columns; other shared columns
    take the incoming value."""
    old, new = target.alias("old"), incoming.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    here = F.col("_old").isNotNull()
    there = F.col("_new").isNotNull()
    joined = old.select("*", F.lit(1).alias("_old")).alias("old").join(
        new.select("*", F.lit(1).alias("_new")).alias("new"), condition, "full"
    )
    columns = []
    for name in target.columns:
        if name in keys:
            value = F.coalesce(F.col(f"old.{name}"), F.col(f"new.{name}"))
        elif name not in incoming.columns:
            value = F.col(f"old.{name}")
        else:
            merged = (update or {}).get(name, F.col(f"new.{name}"))
            value = F.when(here & there, merged).when(there, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        columns.append(value.alias(name))
    action = F.when(here & there, "update").when(there, "insert").otherwise("keep")
    return joined.select(*columns, action.alias("action"))


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add rows whose key is new; of rows that repeat a new key the first in the given order is added."""
    fresh = top_per_group(incoming, keys, order, 1).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def keep_filled(old: Column, new: Column) -> Column:
    """The present value unless it is null or blank."""
    return F.coalesce(F.nullif(old, F.lit("")), new)


def survivorship(providers: DataFrame, matches: list[DataFrame], text_columns: list[str], number_columns: list[str]) -> DataFrame:
    """Fill gaps of the register from matched records, sources in the given order; filled values stay.

    Each match frame has provider_id (unique) and any of the columns."""
    out = providers
    for match in matches:
        present = [c for c in text_columns + number_columns if c in match.columns]
        patch = match.select("provider_id", *[F.col(c).alias(f"_new_{c}") for c in present])
        out = out.join(patch, "provider_id", "left").withColumns({
            c: keep_filled(F.col(c), F.nullif(f"_new_{c}", F.lit(""))) if c in text_columns
            else F.coalesce(F.col(c), F.col(f"_new_{c}")) for c in present
        }).drop(*[f"_new_{c}" for c in present])
    return out


def patch_columns(target: DataFrame, patches: DataFrame, key: str, overwrite: list[str] = (), keep_if_blank: list[str] = (),
                  replace_if_given: list[str] = ()) -> DataFrame:
    """Apply edit rows (unique per key): some columns are overwritten even with null, some only by
    non-blank text, some by any value that is not null."""
    changed = [*overwrite, *keep_if_blank, *replace_if_given]
    patch = patches.select(key, F.lit(True).alias("_edited"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    values = {}
    for c in overwrite:
        values[c] = F.when(F.col("_edited"), F.nullif(F.trim(f"_new_{c}"), F.lit(""))).otherwise(F.col(c))
    for c in keep_if_blank:
        values[c] = F.coalesce(F.nullif(f"_new_{c}", F.lit("")), F.col(c))
    for c in replace_if_given:
        values[c] = F.coalesce(f"_new_{c}", F.col(c))
    return target.join(patch, key, "left").withColumns(values).drop(*[f"_new_{c}" for c in changed])


def duplicate_guard(df: DataFrame, key: Column) -> DataFrame:
    """Keys held by more than one row; writing is refused while there are any."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, key: Column) -> None:
    found = duplicate_guard(df, key).limit(5).collect()
    if found:
        raise ValueError("duplicate keys: " + ", ".join(f"{r['key']} x{r['n']}" for r in found))


def normalize_slugs(df: DataFrame, slug: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(rows with lower-case slugs, backup of the rows that change)."""
    changed = df.filter(F.col(slug) != F.lower(slug))
    return df.withColumn(slug, F.lower(slug)), changed
