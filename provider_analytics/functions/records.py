"""JSON payloads, opening hours, hashes and small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAQ_TYPE = "struct<faqs:array<struct<question:string,answer:string>>>"


def strip_code_fence(value: Column) -> Column:
    """A JSON answer is often wrapped in a fenced block; keep the inside."""
    text = F.trim(value)
    text = F.regexp_replace(text, r"^```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(text, r"\s*```$", ""))


def canonical_json(value: Column, schema: str) -> Column:
    return F.from_json(strip_code_fence(value), schema)


def json_merge(base: Column, patch: Column) -> Column:
    """Map merge in which the patch wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k)), patch)


def json_get(items: Column, index: Column) -> Column:
    """Zero-based; out of range is null."""
    return F.get(items, index)


def json_len(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def _join_key(parts: list[Column], separator: str) -> Column:
    return F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def sha_key(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 over the joined fields; null counts as the empty string."""
    return F.sha2(_join_key(list(parts), separator), 256)


def review_id(place: Column, author: Column, time: Column, text: Column) -> Column:
    return sha_key(place, author, time, text)


def idempotency_hash(
    email: Column, service_slug: Column, comune: Column, message: Column, providers: Column, properties: Column
) -> Column:
    """Two requests are the same when all of these agree, the whole message among them."""
    return sha_key(
        F.lower(F.trim(email)),
        service_slug,
        F.lower(F.trim(comune)),
        F.lower(F.trim(message)),
        F.array_join(F.array_sort(providers.cast("array<string>")), ","),
        F.array_join(F.array_sort(properties.cast("array<string>")), ","),
    )


def cadastral_summary(sheet: Column, parcel: Column, unit: Column, section: Column, category: Column) -> Column:
    # Labels and default text of the summary line.
    labelled = [("Fg. ", sheet), ("Part. ", parcel), ("Sub. ", unit), ("Sez. ", section), ("Cat. ", category)]
    parts = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c)) for label, c in labelled]
    return F.coalesce(F.nullif(F.concat_ws(" · ", *parts), F.lit("")), F.lit("Dati catastali da completare"))


def open_now(periods: Column, at_utc: Column, zone: str = "Europe/Rome") -> Column:
    """Any period of today's weekday (0 = Sunday) that has begun and not ended; null without periods."""
    local = F.from_utc_timestamp(at_utc, zone)
    day = F.dayofweek(local) - 1
    clock = F.hour(local) * 100 + F.minute(local)
    hit = F.exists(
        periods,
        lambda p: (p["open_day"] == day)
        & (p["open_hhmm"].try_cast("int") <= clock)
        & (clock < p["close_hhmm"].try_cast("int")),
    )
    return F.when(F.size(periods) > 0, F.coalesce(hit, F.lit(False)))


def opening_spec(periods: Column) -> Column:
    """Complete periods only, as (weekday name, opens hh:mm, closes hh:mm)."""
    # Weekday names, Sunday first.
    names = F.array(*[F.lit(d) for d in
                      ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")])
    clock = lambda t: F.concat(t.substr(1, 2), F.lit(":"), t.substr(3, 2))
    complete = F.filter(
        periods,
        lambda p: p["open_day"].between(0, 6) & p["open_hhmm"].rlike(r"^\d{4}$") & p["close_hhmm"].rlike(r"^\d{4}$"),
    )
    return F.transform(
        complete,
        lambda p: F.struct(
            F.get(names, p["open_day"]).alias("day"),
            clock(p["open_hhmm"]).alias("opens"),
            clock(p["close_hhmm"]).alias("closes"),
        ),
    )


def compact_photos(photos: Column, limit: int = 5) -> Column:
    """First `limit` photos, of which those without a reference are then dropped."""
    return F.transform(
        F.filter(F.slice(photos, 1, limit), lambda p: F.coalesce(p["photo_reference"], F.lit("")) != ""),
        lambda p: F.struct(
            p["photo_reference"].alias("reference"),
            p["width"].alias("width"),
            p["height"].alias("height"),
            F.coalesce(p["html_attributions"], F.array().cast("array<string>")).alias("attributions"),
        ),
    )


def compact_hours(opening: Column) -> Column:
    """open_now, weekday_text and periods of an opening_hours record; lists that are missing are empty."""
    kinds = "weekday_text array<string>, periods array<struct<open: struct<day: int, time: string>, close: struct<day: int, time: string>>>"
    lists = [kind.split(" ", 1) for kind in kinds.split(", ", 1)]
    return F.struct(
        opening["open_now"].alias("open_now"),
        *[F.coalesce(opening[name].cast(kind), F.array().cast(kind)).alias(name) for name, kind in lists],
    )
