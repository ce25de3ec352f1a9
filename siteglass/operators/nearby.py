"""Joins of places within reach: tiles, radius joins, walk and transit scores, nearest lists."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, TILE_DEG, ZERO_M, decay, half_chord, haversine, pad_degrees, tile

# Weights of the Nth nearest amenity by category, and the transit constants.
WEIGHTS = {
    "grocery": (3.0,),
    "restaurants": (0.75, 0.45, 0.25, 0.25, 0.225, 0.225, 0.225, 0.225, 0.2, 0.2),
    "shopping": (0.5, 0.45, 0.4, 0.35, 0.3),
    "coffee": (1.25, 0.75),
    "banks": (1.0,),
    "parks": (1.0,),
    "schools": (1.0,),
    "books": (1.0,),
    "entertainment": (1.0,),
}
MULTIPLIER = 6.67
TRIPS = {"rail": 700.0, "ferry": 200.0, "bus": 350.0}
MODE_WEIGHT = {"rail": 2.0, "ferry": 1.5, "bus": 1.0}
MODE_ORDER = {"rail": 0, "ferry": 1, "bus": 2}
TRANSIT_NORM = 4000.0
NEAREST = 8


def pairs_in_reach(places: DataFrame, points: DataFrame, radius: float = ZERO_M, on: list[str] | None = None, size: float = TILE_DEG) -> DataFrame:
    """All pairs of a place and a point within ``radius`` meters, with ``meters``.

    Each place is sent to the tiles its reach can touch; points stay in their own tile, so the join is an equi-join on
    tiles that Spark can deal out and split, and no pair outside of neighbouring tiles is formed. The reach in degrees
    follows from the place's own latitude, tiles go round the date line, and a place whose reach holds a pole is sent
    to every tile of its parallels. A pair is first judged by its latitudes, then by the squared half chord, and only
    pairs in reach get their distance. For sides folded by coordinates; :func:`radius_join` folds them.
    Both sides carry lat and lng; the points' columns that both have are prefixed by p_. ``on`` names further equal columns. Rows
    without coordinates match nothing.
    """
    on = on or []
    slack = 1 + 1e-9  # for rounding: what tiles and the squared chord let through is still compared in meters
    pad_lat, chord = pad_degrees(radius) * slack, math.sin(min(math.pi / 2, radius / (2 * EARTH_M))) * slack
    count = max(1, math.floor(360 / size))
    wide = 360 / count
    edge = F.abs("lat") + pad_lat
    half = F.lit(chord) / F.cos(F.radians(edge))
    pad_lng = F.when((edge >= 90) | (half >= 1), F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(F.lit(1.0), half))))
    west, east = tile(F.col("lng") - pad_lng, wide), tile(F.col("lng") + pad_lng, wide)
    ty = F.sequence(tile(F.col("lat") - pad_lat, size), tile(F.col("lat") + pad_lat, size))
    tx = F.when(east - west >= count - 1, F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint"))).otherwise(F.transform(F.sequence(west, east), lambda t: F.pmod(t, F.lit(count).cast("bigint"))))
    left = places.where("lat is not null and lng is not null").withColumn("_ty", F.explode(ty)).withColumn("_tx", F.explode(tx))
    clash = {c: f"p_{c}" for c in points.columns if c in places.columns and c not in on}
    right = points.where("lat is not null and lng is not null").withColumnsRenamed(clash | {"lat": "p_lat", "lng": "p_lng"}).withColumns({"_ty": tile("p_lat", size), "_tx": F.pmod(tile("p_lng", wide), F.lit(count).cast("bigint"))})
    near = left.join(right, ["_ty", "_tx", *on]).where(F.abs(F.col("p_lat") - F.col("lat")) <= pad_lat)
    near = near.where(half_chord("lat", "lng", "p_lat", "p_lng") <= chord * chord)
    return near.withColumn("meters", haversine("lat", "lng", "p_lat", "p_lng")).where(F.col("meters") <= radius).drop("_ty", "_tx")


CROWD, SHARES = 64, 16  # points of one coordinate that count as a crowd, and the shares that its places are dealt in


def radius_join(places: DataFrame, points: DataFrame, radius: float = ZERO_M, on: list[str] | None = None, size: float = TILE_DEG, digits: int | None = None) -> DataFrame:
    """All pairs of a place and a point within ``radius`` meters, with ``meters``, rounded on request.

    As :func:`pairs_in_reach`, but tiles and distances are worked out once for a pair of coordinates; rows then meet by
    equal coordinates. That join is never a broadcast, so its work does not follow the splits of the places' files,
    and places near a crowd of points are dealt in shares, each of which meets the whole crowd.
    """
    on = on or []
    left = places.where("lat is not null and lng is not null")
    clash = {c: f"p_{c}" for c in points.columns if c in places.columns and c not in on}
    right = points.where("lat is not null and lng is not null").withColumnsRenamed(clash | {"lat": "p_lat", "lng": "p_lng"})
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    there = right.groupBy("p_lat", "p_lng", *on).agg(F.count(F.lit(1)).alias("_m"))
    near = pairs_in_reach(_spots(left, *on), there.withColumnsRenamed({"p_lat": "lat", "p_lng": "lng"}), radius, on, size)
    if digits is not None:
        near = near.withColumn("meters", F.round("meters", digits))
    crowd = F.col("_m") >= CROWD
    dealt = left.join(near, ["lat", "lng", *on]).withColumn("_share", F.when(crowd, (F.rand(0) * SHARES).cast("int")).otherwise(0))
    shares = F.when(crowd, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    met = right.join(there, ["p_lat", "p_lng", *on]).withColumn("_share", F.explode(shares)).drop("_m")
    return dealt.join(met.hint("merge"), ["p_lat", "p_lng", *on, "_share"]).select(*columns, "meters")


FINE_DEG = TILE_DEG / 3  # tiles of under half the reach: more rows of places, fewer pairs beyond the reach


def _spots(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct coordinates (and ``keys``): suites of one building are scored once."""
    return rows.where("lat is not null and lng is not null").select("lat", "lng", *keys).distinct()


def _cumulated() -> Column:
    """By category, the weights of the first 0, 1, 2, ... amenities together."""
    sums = {c: [sum(ws[:i]) for i in range(len(ws) + 1)] for c, ws in WEIGHTS.items()}
    return F.create_map(*(x for c, ws in sums.items() for x in (F.lit(c), F.array(*(F.lit(float(w)) for w in ws)))))


def walk_scores(listings: DataFrame, pois: DataFrame) -> DataFrame:
    """id, walk_score and score_breakdown (every category, zero-filled) of every listing with coordinates.

    Scores belong to places: listings are folded by coordinates first, amenities by coordinates and category. Counts
    and the nearest distance come from one hash aggregate with partial sums; only categories whose weights reach past
    the nearest amenity are ordered, under a limit per group that Spark applies before the shuffle too.
    """
    base = listings.where("lat is not null and lng is not null").select("id", "lat", "lng")
    points = pois.where(F.col("category").isin(*WEIGHTS) & F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng", "category").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs_in_reach(_spots(base), points, size=FINE_DEG).select("lat", "lng", "category", "meters", "n")
    spot = ["lat", "lng", "category"]
    stats = pairs.groupBy(*spot).agg(F.sum("n").alias("count"), F.min("meters").alias("nearest"))
    several = {c: len(ws) for c, ws in WEIGHTS.items() if len(ws) > 1}
    order = Window.partitionBy(*spot).orderBy("meters", "n", "p_lat", "p_lng")
    top = pairs_in_reach(_spots(base), points.where(F.col("category").isin(*several)), size=FINE_DEG).select(*spot, "meters", "n", "p_lat", "p_lng")
    top = top.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(several.values()))
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    used = top.withColumn("upto", upto).withColumn("w", F.try_element_at(_cumulated(), F.col("category")))
    most = F.size("w") - 1
    share = F.get("w", F.least(F.col("upto"), most).cast("int")) - F.get("w", F.least(F.col("upto") - F.col("n"), most).cast("int"))
    ordered = used.groupBy(*spot).agg(F.sum(share * decay("meters")).alias("several"))
    first = F.get(F.try_element_at(_cumulated(), F.col("category")), F.lit(1)) * decay("nearest")
    per = stats.join(ordered, spot, "left").select(*spot, F.when(F.col("category").isin(*several), F.coalesce("several", F.lit(0.0))).otherwise(first).alias("earned"), "count", "nearest")
    entry = F.struct("category", "earned", "count", "nearest")
    found = per.groupBy("lat", "lng").agg(F.map_from_entries(F.collect_list(F.struct("category", entry))).alias("found"), F.sum("earned").alias("total"))  # at most a row a category

    def one(c: str) -> Column:
        got = F.try_element_at("found", F.lit(c))
        return F.struct(F.round(F.coalesce(got["earned"], F.lit(0.0)), 3).alias("score"), F.lit(round(float(sum(WEIGHTS[c])), 3)).alias("weight"), F.coalesce(got["count"], F.lit(0)).alias("count"), F.bround(got["nearest"], 0).cast("bigint").alias("nearest_m"))

    scored = base.join(found, ["lat", "lng"], "left")
    total = F.coalesce("total", F.lit(0.0))
    return scored.select("id", F.least(F.lit(100), F.bround(total * MULTIPLIER, 0)).cast("int").alias("walk_score"), F.create_map(*(x for c in WEIGHTS for x in (F.lit(c), one(c)))).alias("score_breakdown"))


def transit_scores(listings: DataFrame, stations: DataFrame, stops: DataFrame) -> DataFrame:
    """id and transit_score: every route counts once, at its nearest stop.

    Stations carry mode and routes (one without routes is its own route), bus stops route_refs. Listings are folded by
    coordinates, stops by coordinates and route.
    """
    metro = ["metro"] if "metro" in stations.columns else []
    base = listings.where("lat is not null and lng is not null").select("id", "lat", "lng", *metro)
    routes = F.when(F.size(F.coalesce("routes", F.array())) > 0, F.col("routes")).otherwise(F.array("name"))
    rail = _spots(stations.select(*metro, "lat", "lng", F.coalesce("mode", F.lit("rail")).alias("mode"), F.explode(routes).alias("route")), *metro, "mode", "route")
    bus = _spots(stops.where(F.col("category") == "bus_stop").select("lat", "lng", F.explode("route_refs").alias("route")), "route").withColumn("mode", F.lit("bus"))
    spot, cols = ["lat", "lng", *metro], ["lat", "lng", *metro, "mode", "route", "meters"]
    near = pairs_in_reach(_spots(base, *metro), rail, on=metro, size=FINE_DEG).select(*cols).unionByName(pairs_in_reach(_spots(base, *metro), bus, size=FINE_DEG).select(*cols))
    trips = F.create_map(*(x for m in TRIPS for x in (F.lit(m), F.lit(TRIPS[m] * MODE_WEIGHT[m]))))
    each = near.groupBy(*spot, "mode", "route").agg(F.min("meters").alias("meters"))
    raw = each.groupBy(*spot).agg(F.sum(F.try_element_at(trips, F.col("mode")) * decay("meters")).alias("raw"))
    scaled = F.lit(100.0) * F.log1p(F.coalesce("raw", F.lit(0.0))) / math.log1p(TRANSIT_NORM)
    return base.join(raw, spot, "left").select("id", F.least(F.lit(100), F.bround(scaled, 0)).cast("int").alias("transit_score"))


def nearest_stations(listings: DataFrame, stations: DataFrame, n: int = NEAREST) -> DataFrame:
    """The n nearest stations of each listing: by rounded meters, rail before ferry before bus, then name.

    Only stations of the listing's own market count where both sides name one. Listings are folded by coordinates.
    """
    metro = ["metro"] if "metro" in stations.columns and "metro" in listings.columns else []
    pairs = pairs_in_reach(_spots(listings, *metro), stations.select("name", "lat", "lng", "mode", "routes", *metro), on=metro, size=FINE_DEG)
    told = F.array_join(F.when(F.size(F.coalesce("routes", F.array())) > 0, F.col("routes")).otherwise(F.array("name")), ",").alias("route")
    rows = pairs.select("lat", "lng", *metro, "name", "mode", told, F.bround("meters", 0).cast("bigint").alias("meters"))
    order = F.create_map(*(x for m, o in MODE_ORDER.items() for x in (F.lit(m), F.lit(o))))
    best = Window.partitionBy("lat", "lng", *metro).orderBy("meters", F.coalesce(F.try_element_at(order, F.col("mode")), F.lit(9)), "name", "route")
    top = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return listings.select("id", "lat", "lng", *metro).join(top, ["lat", "lng", *metro]).drop("lat", "lng", *metro)


def top_per_category(pois: DataFrame, n: int = 3, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """The n nearest named amenities of each listing and category, from rows (id, category, name, meters)."""
    best = Window.partitionBy(*keys, "category").orderBy("meters", "name")
    return pois.where("name is not null and category <> 'bus_stop'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def nearest_amenities(listings: DataFrame, pois: DataFrame, n: int = 3) -> DataFrame:
    """(id, category, name, meters, rank) of the n nearest named amenities by category; distances to the micrometre."""
    pairs = pairs_in_reach(_spots(listings), pois.select("category", "name", "lat", "lng"), size=FINE_DEG).withColumn("meters", F.round("meters", 6))
    top = top_per_category(pairs.select("lat", "lng", "category", "name", "meters"), n, ("lat", "lng"))
    return listings.select("id", "lat", "lng").join(top, ["lat", "lng"]).drop("lat", "lng")


def tiles_of(listings: DataFrame, size: float = TILE_DEG) -> DataFrame:
    """Listings by tile, with the box that covers every member's reach."""
    pad = pad_degrees(ZERO_M)
    rows = listings.where("lat is not null and lng is not null").select("id", "lat", "lng", tile("lat", size).alias("ty"), tile("lng", size).alias("tx"))
    out = rows.groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("members"))
    south, north = F.col("ty") * size, (F.col("ty") + 1) * size
    poleward = F.greatest(F.abs(south), F.abs(north)) + pad
    wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(ZERO_M / (2 * EARTH_M))) / F.cos(F.radians(poleward)))))
    return out.select("ty", "tx", "members", (south - pad).alias("min_lat"), (F.col("tx") * size - wide).alias("min_lng"), (north + pad).alias("max_lat"), ((F.col("tx") + 1) * size + wide).alias("max_lng"))


def pending(listings: DataFrame) -> DataFrame:
    """Listings that can be scored and are not yet."""
    return listings.where("lat is not null and walk_score is null")


def metro_of(points: DataFrame, metros: DataFrame) -> DataFrame:
    """``points`` with ``actual``: the first market whose box holds the coordinates, or null.

    The markets are a fixed table of a few rows, so they travel with the plan as one expression.
    """
    boxes = sorted(metros.collect(), key=lambda m: m.ord)  # fixed dimension
    found = F.coalesce(*(F.when(F.col("lat").between(m.min_lat, m.max_lat) & F.col("lng").between(m.min_lng, m.max_lng), m.metro) for m in boxes))
    return points.withColumn("actual", found)


def route_by_state(rows: DataFrame, states: dict[str, str]) -> DataFrame:
    """Before geocoding: a listing whose slug names another state moves to that state's market, or is dropped."""
    by_state = F.create_map(*(F.lit(x) for m, s in states.items() for x in (s, m)))
    target = F.try_element_at(by_state, F.col("geo_state"))
    kept = rows.withColumn("_target", target).where("geo_state is null or _target is not null")
    moved = F.col("_target").isNotNull() & (F.col("_target") != F.col("metro"))
    return kept.withColumns({"rerouted": F.coalesce(moved, F.lit(False)), "metro": F.coalesce("_target", "metro")}).drop("_target")


def place(rows: DataFrame, metros: DataFrame) -> DataFrame:
    """After geocoding: coordinates decide the market; outside of all, or rerouted and unconfirmed, is dropped."""
    located = metro_of(rows, metros)
    known = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    keep = F.when(known, F.col("actual").isNotNull()).otherwise(~F.coalesce("rerouted", F.lit(False)))
    return located.where(keep).withColumn("metro", F.when(known, F.col("actual")).otherwise(F.col("metro"))).drop("actual")


def airport_minutes(listings: DataFrame, airports: DataFrame) -> DataFrame:
    """Free-flow minutes from each listing to its market's airports, a fixed dimension that Spark sizes for itself."""
    from ..functions.geo import EARTH_MI, drive_minutes

    a = airports.select("metro", "airport", F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    pairs = listings.where("lat is not null and lng is not null").join(a, "metro")
    return pairs.select("id", "airport", drive_minutes(haversine("lat", "lng", "a_lat", "a_lng", EARTH_MI)).alias("minutes"))
