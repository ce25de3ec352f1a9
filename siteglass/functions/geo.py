"""Distances, tiles and polygons as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radius, the distance decay and the tile size.
EARTH_M = 6_371_000.0
EARTH_MI = 3958.8
FULL_M, ZERO_M, SPAN_M, POWER = 402.0, 2414.0, 2012.0, 2.3135
TILE_DEG = 0.03


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x


def half_chord(lat1, lng1, lat2, lng2) -> Column:
    """Square of half the chord between two points of the unit sphere."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    return F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)


def haversine(lat1, lng1, lat2, lng2, radius: float = EARTH_M) -> Column:
    """Great-circle distance, in the unit of ``radius``."""
    return 2 * radius * F.asin(F.sqrt(F.least(half_chord(lat1, lng1, lat2, lng2), F.lit(1.0))))


def decay(meters) -> Column:
    """1 within a walk of 402 m, 0 from 2,414 m on, a power curve between."""
    m = _c(meters)
    return F.when(m <= FULL_M, 1.0).when(m >= ZERO_M, 0.0).otherwise(F.pow((F.lit(ZERO_M) - m) / SPAN_M, POWER))


def tile(value, size: float = TILE_DEG) -> Column:
    """Index of the tile that holds a coordinate."""
    return F.floor(_c(value) / F.lit(float(size))).cast("bigint")


def pad_degrees(meters: float, lat: float | None = None) -> float:
    """Degrees that cover ``meters`` along a meridian, or along the parallel at ``lat``.

    Derived from the radius that distances use, so a padded box holds every point in reach.
    """
    per_degree = math.pi * EARTH_M / 180
    if lat is None:
        return meters / per_degree
    half = math.sin(meters / (2 * EARTH_M)) / max(1e-9, math.cos(math.radians(min(89.9, abs(lat)))))
    return math.degrees(2 * math.asin(min(1.0, half)))


def drive_minutes(miles) -> Column:
    """Free-flow minutes of a drive by its length in miles."""
    return F.round(F.lit(5.31) * F.pow(_c(miles), 0.718), 1)


def centroid(ring) -> Column:
    """struct(x, y): area-weighted centroid of a ring of struct(x, y); null where the area is zero."""
    ring = _c(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("w"), (p["x"] + q["x"]).alias("x"), (p["y"] + q["y"]).alias("y")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    total = F.aggregate(cross, zero, lambda s, e: F.struct((s["a"] + e["w"]).alias("a"), (s["x"] + e["w"] * e["x"]).alias("x"), (s["y"] + e["w"] * e["y"]).alias("y")))
    return F.when(total["a"] != 0, F.struct((total["x"] / (3 * total["a"])).alias("x"), (total["y"] / (3 * total["a"])).alias("y")))


def inside(x, y, ring) -> Column:
    """Whether a point lies in a ring of struct(x, y), by the parity of edge crossings."""
    x, y, ring = _c(x), _c(y), _c(ring)
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, nxt, lambda p, q: F.when((p["y"] > y) != (q["y"] > y), x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]).otherwise(F.lit(False)))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1
