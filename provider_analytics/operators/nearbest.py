"""The k most relevant places around each point, by cells with bounds.

Places lie in cells, in the order of what they score wherever one stands. The nearest edge of a cell bounds what
nearness can add, so a point reads the first places of each cell around it and goes on only in cells whose next place
could still be among its k. How many places there are in all follows from cells that lie inside the circle, as
counted, and from those on its border, tested place by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, distance_km
from .geojoin import _KM_PER_DEGREE, _cell, _cover, _located
from .ranking import NEARNESS_KM, by_relevance, relevance_score
from .skew import place_in_group, settle, top_per_group

#: Places of a cell read at first, how much further each round reads, and by how many halvings cells are finer than the
#: radius asks for.
FIRST, GROWTH, FINER = 64, 16, 1
_CELL = ["_level", "_ay", "_ax"]
_SLACK = 1e-5  # scores are rounded to six digits


def _edges(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Least and greatest distance from a point to its cell _level, _ay, _ax, a little generous either way."""
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_level"))
    south, west = F.col("_ay") * side - 90, F.col("_ax") * side - 180
    off = lambda at, low: F.greatest(F.lit(0.0), low - at, at - low - side)
    dlat, dlng = off(lat, south), off(lng, west)
    sideways = F.when(dlng < 90, F.asin(F.sin(F.radians(dlng)) * F.cos(F.radians(lat))) * EARTH_KM).otherwise(F.lit(0.0))
    near = F.greatest(F.lit(0.0), F.greatest(dlat * _KM_PER_DEGREE, sideways) - 0.01)
    far = F.greatest(*[distance_km(lat, lng, south + dy * side, west + dx * side) for dy in (0, 1) for dx in (0, 1)])
    return near, far * 1.001 + 0.01


def best_within(points: DataFrame, places: DataFrame, max_km: float, k: int) -> tuple[DataFrame, DataFrame]:
    """(best, totals): the k best places of each point by relevance with distance_km, relevance_score and place, and
    point_id, total, how many places each point has within max_km. Points without a place have no row in either.

    points: point_id, lat, lng, one row a point. places: place_lat, place_lng, provider_id, full_name, rating_avg,
    review_count, services_count. A crowded cell is a range of one sort, read from its best place on."""
    here = _located(points, "lat", "lng").select("point_id", "lat", "lng", F.lit(float(max_km)).alias("_km"))
    cover = settle(_cover(here, finer=FINER), "cover")
    levels = cover.select(F.col("_level").alias("_at")).distinct()  # one row a radius
    fixed = relevance_score(F.col("rating_avg"), F.col("review_count"), F.col("services_count"), F.lit(NEARNESS_KM))
    binned = _located(places, "place_lat", "place_lng").crossJoin(F.broadcast(levels)).withColumns({
        "_ay": _cell(F.col("place_lat"), 90.0, F.col("_at")), "_ax": _cell(F.col("place_lng"), 180.0, F.col("_at")), "_fixed": fixed,
    }).withColumnRenamed("_at", "_level")
    binned = settle(binned, "binned")  # the range sort reads it twice
    ranked = settle(place_in_group(binned, _CELL, [F.col("_fixed").desc(), F.col("provider_id")], "_nth"), "ranked-places")
    counts = ranked.groupBy(*_CELL).agg(F.count("*").alias("_n"), F.max("_fixed").alias("_most"))
    near, far = _edges(F.col("lat"), F.col("lng"))
    cells = cover.join(counts, _CELL).withColumns({"_near": near, "_whole": far <= F.col("_km")}).filter(F.col("_near") <= F.col("_km"))
    cells = settle(cells, "cells")

    km = distance_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    border = cells.filter(~F.col("_whole")).select("point_id", "lat", "lng", "_km", *_CELL).join(ranked.select("place_lat", "place_lng", *_CELL), _CELL)
    counted = border.filter(km <= F.col("_km")).groupBy("point_id").agg(F.count("*").alias("_n"))
    totals = cells.filter("_whole").groupBy("point_id").agg(F.sum("_n").alias("_n")).unionByName(counted).groupBy("point_id").agg(
        F.sum("_n").cast("bigint").alias("total"))

    still, best, low, high = cells, None, 0, FIRST
    columns = [c for c in places.columns if c not in points.columns]
    while not still.isEmpty():
        window = ranked.filter((F.col("_nth") > low) & (F.col("_nth") <= high))
        read = still.select("point_id", "lat", "lng", "_km", *_CELL).join(window, _CELL).withColumn("distance_km", km).filter(F.col("distance_km") <= F.col("_km"))
        score = relevance_score(F.col("rating_avg"), F.col("review_count"), F.col("services_count"), F.col("distance_km"))
        found = read.withColumn("relevance_score", score).select("point_id", *columns, "distance_km", "relevance_score")
        best = settle(top_per_group(found if best is None else best.drop("place").unionByName(found), ["point_id"], by_relevance(), k, "place"), "best")
        # What a cell can still give: the fixed score of the last place read, and what its nearest edge adds.
        last = ranked.filter(F.col("_nth") == high).select(*_CELL, F.col("_fixed").alias("_next"))
        enough = best.filter(F.col("place") == k).select("point_id", F.col("relevance_score").alias("_least"))
        reach = F.col("_next") + F.greatest(F.lit(0.0), F.lit(NEARNESS_KM) - F.col("_near")) + _SLACK
        longer = still.filter(F.col("_n") > high).join(last, _CELL).join(enough, "point_id", "left")
        still = settle(longer.filter(F.col("_least").isNull() | (reach >= F.col("_least"))).drop("_next", "_least"), "cells")
        low, high = high, high * GROWTH
    if best is None:
        best = cells.join(ranked, F.lit(False)).select("point_id", *columns, F.lit(0.0).alias("distance_km"), F.lit(0.0).alias("relevance_score"), F.lit(1).cast("bigint").alias("place"))
    return best, totals
