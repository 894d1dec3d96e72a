"""Radius and nearest-neighbour joins without a cross join.

Points are binned into square cells whose side halves from level to level. A radius join looks into the cells of the
level that fits the radius. For nearest neighbours a pyramid of cell counts tells, for every cell that holds a query
point, the finest cell around it that already holds k places; the far corner of that cell bounds the distance of the
k-th neighbour, so only cells within that bound are joined. Dense cities are searched in small cells and empty country
in large ones. A place with many providers on the very same spot contributes only its first k by the tie order, cut
before the shuffle, which changes no result. A crowded cell is left to adaptive execution, which splits it on either
side of the join. Coordinates are degrees; cells do not wrap at the date line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, distance_km
from .skew import place_in_group, settle, top_per_group

LEVELS = 18  # the finest side is 360 / 2**18 degrees, about 150 m
_KM_PER_DEGREE = EARTH_KM * 3.141592653589793 / 180
_HALF_WORLD_KM = 20038.0
_COARSE = 4  # below this level a cell spans more than 11 degrees and its corners bound nothing


def _cell(degrees: Column, offset: float, level: Column) -> Column:
    return F.floor((degrees + offset) * F.pow(F.lit(2.0), level) / 360).cast("bigint")


def _ancestor(cell: Column, level: Column) -> Column:
    return F.floor(cell / F.pow(F.lit(2.0), F.lit(LEVELS) - level)).cast("bigint")


def _located(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())


def _cover(points: DataFrame, finest: int = LEVELS, finer: int = 0) -> DataFrame:
    """Points (lat, lng, _km) with every cell _level, _ay, _ax that their circle touches, of a level on which these are few,
    or `finer` levels below it."""
    turn = F.sin(F.least(F.col("_km") / EARTH_KM, F.lit(1.5707963)))
    flat = F.cos(F.radians(F.col("lat")))
    wide = F.when(flat > turn, F.degrees(F.asin(turn / flat))).otherwise(F.lit(180.0))
    level = F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(F.lit(360.0) / F.greatest(F.col("_dlat"), F.lit(1e-9)))) + finer))
    rows = points.withColumn("_dlat", F.col("_km") / _KM_PER_DEGREE).withColumn("_dlng", wide).withColumn("_level", level.cast("int"))
    span = lambda mid, delta, offset, low, high: F.sequence(
        _cell(F.greatest(mid - delta, F.lit(low)), offset, F.col("_level")),
        _cell(F.least(mid + delta, F.lit(high)), offset, F.col("_level")),
    )
    rows = rows.withColumn("_ay", F.explode(span(F.col("lat"), F.col("_dlat"), 90.0, -90.0, 90.0)))
    return rows.withColumn("_ax", F.explode(span(F.col("lng"), F.col("_dlng"), 180.0, -180.0, 180.0))).drop("_dlat", "_dlng")


def within(points: DataFrame, places: DataFrame, max_km: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every place within max_km of every point: point_id, the columns in `carry`, all place columns, distance_km.

    points: (point_id, lat, lng and what max_km and `carry` use). places: (place_lat, place_lng, ...)."""
    here = _located(points, "lat", "lng").select("point_id", "lat", "lng", *carry, max_km.cast("double").alias("_km"))
    cover = _cover(here)
    levels = cover.select(F.col("_level").alias("_at")).distinct()  # at most LEVELS + 1 rows
    binned = _located(places, "place_lat", "place_lng").crossJoin(F.broadcast(levels)).withColumns({
        "_ay": _cell(F.col("place_lat"), 90.0, F.col("_at")), "_ax": _cell(F.col("place_lng"), 180.0, F.col("_at")),
    }).withColumnRenamed("_at", "_level")
    pairs = cover.join(binned, ["_level", "_ay", "_ax"]).withColumn(
        "distance_km", distance_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    )
    return pairs.filter(F.col("distance_km") <= F.col("_km")).drop("_level", "_ay", "_ax", "_km", "lat", "lng")


def places_around(points: DataFrame, places: DataFrame, max_km: float, tie: list[str], keep: list[str]) -> DataFrame:
    """(point_id, the columns `keep` of places, distance_km, place): every place within max_km of every point, numbered by
    distance and the `tie` columns, which have to make the order total.

    Points on one spot share one search. What is sorted is a distance and the number of the place in tie order, not its
    texts."""
    here = _located(points, "lat", "lng").select("point_id", "lat", "lng", F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string")).alias("_spot"))
    spots = here.select(F.col("_spot").alias("point_id"), "lat", "lng").distinct()
    located = _located(places, "place_lat", "place_lng").select("place_lat", "place_lng", *dict.fromkeys([*keep, *tie])).withColumn("_all", F.lit(0))
    numbered = place_in_group(located, ["_all"], [F.col(c) for c in tie], "_nth").select("place_lat", "place_lng", "_nth", *keep)
    near = within(spots, numbered, F.lit(max_km)).select(F.col("point_id").alias("_spot"), "_nth", "distance_km", *keep)
    ranked = place_in_group(near, ["_spot"], [F.col("distance_km"), F.col("_nth")], "place").drop("_nth")
    return here.select("point_id", "_spot").join(ranked, "_spot").drop("_spot")


def nearest_within(points: DataFrame, places: DataFrame, k: int, tie: list[str], max_km: Column | None = None) -> DataFrame:
    """The k nearest places of every point, optionally within a radius.

    points: (point_id, lat, lng, ...) with unique point_id; columns beyond these are carried when max_km
    uses them. places: (place_lat, place_lng, plus the `tie` columns that order places at equal distance).
    Returns point_id, all place columns, distance_km, and `place` = 1..k."""
    spots = top_per_group(_located(places, "place_lat", "place_lng"), ["place_lat", "place_lng"], [F.col(c) for c in tie], k)
    finest = F.lit(LEVELS)
    spots = settle(spots.withColumn("_cy", _cell(F.col("place_lat"), 90.0, finest)).withColumn(
        "_cx", _cell(F.col("place_lng"), 180.0, finest)
    ), "spots")
    every_level = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    up = lambda df: df.withColumn("_level", every_level).withColumns({
        "_ay": _ancestor(F.col("_cy"), F.col("_level")), "_ax": _ancestor(F.col("_cx"), F.col("_level"))})
    tree = up(spots.groupBy("_cy", "_cx").agg(F.count("*").alias("_n")))
    keys = ["_level", "_ay", "_ax"]
    full = tree.filter(F.col("_level") >= _COARSE).groupBy(*keys).agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= k).drop("_n")

    here = _located(points, "lat", "lng").select(
        "point_id", "lat", "lng", (max_km if max_km is not None else F.lit(_HALF_WORLD_KM)).cast("double").alias("_max"),
        _cell(F.col("lat"), 90.0, finest).alias("_cy"), _cell(F.col("lng"), 180.0, finest).alias("_cx"),
    )
    # Cells climb, not points: however many points share a cell, it asks once.
    asked = up(here.select("_cy", "_cx").distinct()).filter(F.col("_level") >= _COARSE)
    own = asked.join(full, keys).groupBy("_cy", "_cx").agg(F.max("_level").alias("_level"))
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_level"))
    south = F.floor((F.col("lat") + 90) / side) * side - 90
    west = F.floor((F.col("lng") + 180) / side) * side - 180
    corner = F.greatest(*[
        distance_km(F.col("lat"), F.col("lng"), south + dy * side, west + dx * side) for dy in (0, 1) for dx in (0, 1)
    ])
    reach = F.least(F.col("_max"), F.coalesce(corner * 1.001 + 0.001, F.lit(_HALF_WORLD_KM)))
    bounded = here.join(own, ["_cy", "_cx"], "left").withColumn("_km", reach).select("point_id", "lat", "lng", "_km")
    cells = _cover(bounded).join(tree.drop("_n"), keys).select("point_id", "lat", "lng", "_km", "_cy", "_cx")
    # Drop finest cells whose nearest edge is already out of reach, north or east, before places are read for them.
    fine = 360.0 / 2**LEVELS
    edge = lambda c, cell, offset: F.abs(F.col(c) - F.least(F.greatest(F.col(c), F.col(cell) * fine - offset), (F.col(cell) + 1) * fine - offset))
    dlat, dlng = edge("lat", "_cy", 90.0), edge("lng", "_cx", 180.0)
    sideways = F.when(dlng < 90, F.asin(F.sin(F.radians(dlng)) * F.cos(F.radians("lat"))) * EARTH_KM).otherwise(F.lit(0.0))
    cells = cells.filter((dlat * _KM_PER_DEGREE <= F.col("_km") + 0.01) & (sideways <= F.col("_km") + 0.01))

    pairs = cells.join(spots, ["_cy", "_cx"]).withColumn(
        "distance_km", distance_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    ).filter(F.col("distance_km") <= F.col("_km")).drop("_cy", "_cx", "_km", "lat", "lng")
    return top_per_group(pairs, ["point_id"], [F.col("distance_km"), *[F.col(c) for c in tie]], k, "place")


def neighbours(providers: DataFrame, k: int) -> DataFrame:
    """The k nearest other located providers of every located provider: (provider_id, neighbour_id,
    distance_km, place). Providers on one spot share one search, so copies of a spot cost nothing."""
    located = providers.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    spot = F.concat_ws(",", F.col("lat").cast("string"), F.col("lng").cast("string"))
    spots = located.select(spot.alias("point_id"), "lat", "lng").distinct()
    places = located.select(
        F.col("provider_id").alias("neighbour_id"), F.col("full_name").alias("neighbour_name"),
        F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"),
    )
    near = nearest_within(spots, places, k + 1, ["neighbour_name", "neighbour_id"])
    # One row per spot with its k+1 candidates: the join back to providers repeats nothing per candidate.
    lists = near.groupBy("point_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "neighbour_id", "distance_km"))).alias("_near")
    )
    attached = located.select("provider_id", spot.alias("point_id")).join(lists, "point_id")
    others = F.slice(F.filter("_near", lambda n: n["neighbour_id"] != F.col("provider_id")), 1, k)
    return attached.select("provider_id", F.posexplode(others).alias("_pos", "n")).select(
        "provider_id", F.col("n.neighbour_id").alias("neighbour_id"), F.col("n.distance_km").alias("distance_km"),
        (F.col("_pos") + 1).cast("bigint").alias("place"),
    )
