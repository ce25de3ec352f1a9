"""Distances, scores, tiles, markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import nearby
from ..schema import METROS, airports, metros
from .register import query
from .surrogates import LISTING_SQL, POI_SQL, STATION_SQL, listings, pois, stations, table


def _meters(a: str, b: str, radius: str = "6371000.0e0") -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0e0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"


_DECAY = "CASE WHEN meters <= 402 THEN 1.0e0 WHEN meters >= 2414 THEN 0.0e0 ELSE pow((2414.0e0 - meters) / 2012.0e0, 2.3135e0) END"
_BASE = f"WITH listing AS ({LISTING_SQL}), poi AS ({POI_SQL}), station AS ({STATION_SQL}) "


@query("SELECT s.s_suppkey AS a, n.n_nationkey AS b, round(" + _meters("s", "n") + ", 3) AS meters FROM (SELECT s_suppkey, 40.5 + CAST(s_suppkey * 41 % 400 AS DOUBLE) / 1000.0e0 AS lat, -74.2 + CAST(s_suppkey * 59 % 400 AS DOUBLE) / 1000.0e0 AS lng FROM supplier) s, (SELECT n_nationkey, 40.5 + n_nationkey / 100.0e0 AS lat, -74.0 - n_nationkey / 50.0e0 AS lng FROM nation) n")
def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS a", "40.5 + CAST(s_suppkey * 41 % 400 AS DOUBLE) / 1000.0e0 AS lat", "-74.2 + CAST(s_suppkey * 59 % 400 AS DOUBLE) / 1000.0e0 AS lng")
    n = table(spark, sf, "nation").selectExpr("n_nationkey AS b", "40.5 + n_nationkey / 100.0e0 AS blat", "-74.0 - n_nationkey / 50.0e0 AS blng")
    return s.crossJoin(F.broadcast(n)).select("a", "b", F.round(geo.haversine("lat", "lng", "blat", "blng"), 3).alias("meters"))  # nations are a fixed dimension


@query(_BASE + f"SELECT id, name, round(meters, 3) AS meters FROM (SELECT l.id, s.name, {_meters('l', 's')} AS meters FROM listing l, station s WHERE l.lat IS NOT NULL) WHERE meters <= 2414")
def radius_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nearby.radius_join(listings(spark, sf).select("id", "lat", "lng"), stations(spark, sf).select("name", "lat", "lng"), digits=3)
    return pairs.select("id", "name", "meters")


_W = "(VALUES " + ", ".join(f"('{c}', {i}, {w})" for c, ws in nearby.WEIGHTS.items() for i, w in enumerate(ws, 1)) + ") w(category, k, weight)"
_REACH = f"SELECT l.id, p.category, p.name, {_meters('l', 'p')} AS meters FROM (SELECT * FROM listing WHERE lat IS NOT NULL) l JOIN poi p ON p.lat BETWEEN l.lat - 0.03 AND l.lat + 0.03 AND p.lng BETWEEN l.lng - 0.04 AND l.lng + 0.04"
_WALK = f""", near AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY meters) AS k FROM ({_REACH}) WHERE meters <= 2414 AND category <> 'bus_stop'),
earned AS (SELECT id, n.category, sum(coalesce(w.weight, 0) * {_DECAY}) AS s, count(*) AS c, min(meters) AS m FROM near n LEFT JOIN {_W} ON w.category = n.category AND w.k = n.k GROUP BY id, n.category)"""


@query(_BASE + _WALK + " SELECT l.id, CAST(least(100, round_even(coalesce(sum(s), 0) * 6.67, 0)) AS INTEGER) AS walk_score FROM listing l LEFT JOIN earned e ON e.id = l.id WHERE l.lat IS NOT NULL GROUP BY l.id")
def walk_score(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.walk_scores(listings(spark, sf), pois(spark, sf)).select("id", "walk_score")


@query(
    _BASE + _WALK + f" SELECT l.id, d.category, round(coalesce(s, 0), 3) AS score, coalesce(c, 0) AS count, CAST(round_even(m, 0) AS BIGINT) AS nearest_m FROM listing l CROSS JOIN (SELECT DISTINCT category FROM {_W}) d LEFT JOIN earned e ON e.id = l.id AND e.category = d.category WHERE l.lat IS NOT NULL"
)
def walk_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = nearby.walk_scores(listings(spark, sf), pois(spark, sf)).select("id", F.explode("score_breakdown").alias("category", "b"))
    return rows.select("id", "category", "b.score", "b.count", "b.nearest_m")


_TRANSIT = f""", stop AS (SELECT id, mode, route, min(meters) AS meters FROM (SELECT l.id, s.mode, coalesce(s.route, s.name) AS route, {_meters('l', 's')} AS meters FROM listing l, station s WHERE l.lat IS NOT NULL
UNION ALL SELECT l.id, 'bus', p.route, {_meters('l', 'p')} FROM listing l JOIN poi p ON p.category = 'bus_stop' AND p.lat BETWEEN l.lat - 0.03 AND l.lat + 0.03 AND p.lng BETWEEN l.lng - 0.04 AND l.lng + 0.04 WHERE l.lat IS NOT NULL) WHERE meters <= 2414 GROUP BY id, mode, route),
raw AS (SELECT id, sum(CASE mode WHEN 'rail' THEN 1400.0e0 WHEN 'ferry' THEN 300.0e0 ELSE 350.0e0 END * {_DECAY}) AS raw FROM stop GROUP BY id)"""
_TRANSIT_SCORE = "CAST(least(100, round_even(100.0e0 * ln(1 + coalesce(raw, 0)) / ln(4001.0e0), 0)) AS INTEGER)"


@query(_BASE + _TRANSIT + f" SELECT l.id, {_TRANSIT_SCORE} AS transit_score FROM listing l LEFT JOIN raw r ON r.id = l.id WHERE l.lat IS NOT NULL")
def transit_score(spark: SparkSession, sf: str) -> DataFrame:
    s = stations(spark, sf).withColumn("routes", F.when(F.col("route").isNotNull(), F.array("route")))
    stops = pois(spark, sf).withColumn("route_refs", F.array("route"))
    return nearby.transit_scores(listings(spark, sf), s, stops)


@query(
    _BASE + _WALK + _TRANSIT + f""", walk AS (SELECT l.id, CAST(least(100, round_even(coalesce(sum(s), 0) * 6.67, 0)) AS INTEGER) AS walk_score, CAST(coalesce(sum(c), 0) AS BIGINT) AS amenities FROM listing l LEFT JOIN earned e ON e.id = l.id WHERE l.lat IS NOT NULL GROUP BY l.id)
SELECT l.id, w.walk_score, amenities, {_TRANSIT_SCORE} AS transit_score FROM listing l JOIN walk w ON w.id = l.id LEFT JOIN raw r ON r.id = l.id WHERE l.lat IS NOT NULL AND l.walk_score IS NULL"""
)
def enrich_pending(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import detail

    s = stations(spark, sf).withColumn("routes", F.when(F.col("route").isNotNull(), F.array("route")))
    out = detail.enrich(listings(spark, sf), pois(spark, sf).withColumn("route_refs", F.array("route")), s)
    amenities = F.aggregate(F.map_values("score_breakdown"), F.lit(0).cast("bigint"), lambda n, b: n + b["count"])
    return out.select("id", "walk_score", amenities.alias("amenities"), "transit_score")


@query(
    _BASE + f"""SELECT id, name, mode, CAST(rank AS INTEGER) AS rank, meters FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY meters, CASE mode WHEN 'rail' THEN 0 WHEN 'ferry' THEN 1 ELSE 2 END, name, route) AS rank FROM
(SELECT l.id, s.name, s.mode, coalesce(s.route, s.name) AS route, CAST(round_even({_meters('l', 's')}, 0) AS BIGINT) AS meters, {_meters('l', 's')} AS exact FROM listing l, station s WHERE l.lat IS NOT NULL) WHERE exact <= 2414) WHERE rank <= 6"""
)
def transit_nearest(spark: SparkSession, sf: str) -> DataFrame:
    s = stations(spark, sf).withColumn("routes", F.when(F.col("route").isNotNull(), F.array("route")))
    return nearby.nearest_stations(listings(spark, sf), s, 6).select("id", "name", "mode", "rank", "meters")


@query(
    _BASE + f"SELECT id, category, name, CAST(rank AS INTEGER) AS rank, round(round(meters, 6), 3) AS meters FROM (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY round(meters, 6), name) AS rank FROM ({_REACH}) WHERE meters <= 2414 AND name IS NOT NULL AND category <> 'bus_stop') WHERE rank <= 3"
)
def poi_top3(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.nearest_amenities(listings(spark, sf), pois(spark, sf)).select("id", "category", "name", "rank", F.round("meters", 3).alias("meters"))


@query(f"WITH listing AS ({LISTING_SQL}) SELECT CAST(floor(lat / 0.03e0) AS BIGINT) AS ty, CAST(floor(lng / 0.03e0) AS BIGINT) AS tx, count(*) AS members FROM listing WHERE lat IS NOT NULL GROUP BY ALL")
def tile_groups(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.tiles_of(listings(spark, sf)).select("ty", "tx", "members")


_POINT = {"id": "c_custkey", "lat": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 25.0e0 + CAST(c_custkey * 17 % 1700 AS DOUBLE) / 100.0e0 END", "lng": "-119.0e0 + CAST(c_custkey * 23 % 4600 AS DOUBLE) / 100.0e0", "geo_state": "CASE c_custkey % 6 WHEN 0 THEN 'tx' WHEN 1 THEN 'fl' WHEN 2 THEN 'ca' WHEN 3 THEN NULL ELSE 'ny' END", "metro": "'nyc'"}
_BOX = "CASE " + " ".join(f"WHEN lat BETWEEN {m['bbox'][0]} AND {m['bbox'][2]} AND lng BETWEEN {m['bbox'][1]} AND {m['bbox'][3]} THEN '{k}'" for k, m in METROS.items()) + " END"
_POINT_SQL = "WITH p AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _POINT.items()) + " FROM customer) "


@query(_POINT_SQL + f"SELECT id, {_BOX} AS actual FROM p")
def metro_route(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").selectExpr(*(f"{e} AS {c}" for c, e in _POINT.items()))
    return nearby.metro_of(points, metros(spark)).select("id", "actual")


@query(
    _POINT_SQL + f""", r AS (SELECT *, CASE geo_state WHEN 'ny' THEN 'nyc' WHEN 'fl' THEN 'mia' WHEN 'ca' THEN 'la' WHEN 'il' THEN 'chi' END AS target, {_BOX} AS actual FROM p),
k AS (SELECT *, coalesce(target, metro) AS m, coalesce(target <> metro, false) AS rerouted FROM r WHERE geo_state IS NULL OR target IS NOT NULL)
SELECT id, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN actual ELSE m END AS metro FROM k WHERE CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN actual IS NOT NULL ELSE NOT rerouted END"""
)
def place_listings(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "customer").selectExpr(*(f"{e} AS {c}" for c, e in _POINT.items()))
    routed = nearby.route_by_state(points, {k: m["state"] for k, m in METROS.items()})
    return nearby.place(routed, metros(spark)).select("id", "metro")


_AIR = "(VALUES " + ", ".join(f"('{k}', '{a}', {at[0]}, {at[1]})" for k, m in METROS.items() for a, at in m["airports"].items()) + ") a(metro, airport, lat, lng)"


@query(f"WITH listing AS ({LISTING_SQL}) SELECT l.id, a.airport, round(5.31 * pow({_meters('l', 'a', '3958.8e0')}, 0.718), 1) AS minutes FROM listing l JOIN {_AIR} ON a.metro = l.metro WHERE l.lat IS NOT NULL")
def airport_minutes(spark: SparkSession, sf: str) -> DataFrame:
    return nearby.airport_minutes(listings(spark, sf), airports(spark))


@query(
    """WITH r AS (SELECT p_partkey AS id, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey % 30 AS DOUBLE) AS y, CAST(p_size AS DOUBLE) AS w, CAST(p_partkey % 7 AS DOUBLE) AS h FROM part)
SELECT id, CASE WHEN w * h <> 0 THEN round(x + w / 2, 6) END AS cx, CASE WHEN w * h <> 0 THEN round(y + h / 2, 6) END AS cy FROM r"""
)
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "part").selectExpr("p_partkey AS id", "CAST(p_partkey % 50 AS DOUBLE) AS x", "CAST(p_partkey % 30 AS DOUBLE) AS y", "CAST(p_size AS DOUBLE) AS w", "CAST(p_partkey % 7 AS DOUBLE) AS h")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(F.col("w"), F.lit(0.0)), corner(F.col("w"), F.col("h")), corner(F.lit(0.0), F.col("h")))
    c = r.select("id", geo.centroid(ring).alias("c"))
    return c.select("id", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"))


@query(
    f"""WITH listing AS ({LISTING_SQL}), zone AS (SELECT s_name AS zone, 40.5 + CAST(s_suppkey * 41 % 400 AS DOUBLE) / 1000.0e0 AS y, -74.2 + CAST(s_suppkey * 59 % 400 AS DOUBLE) / 1000.0e0 AS x FROM supplier)
SELECT id, min(zone) AS zone FROM listing JOIN zone ON lng > x + 0.00013 AND lng < x + 0.01513 AND lat > y + 0.00013 AND lat < y + 0.01513 GROUP BY id"""
)
def zone_of(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.registry import zoned

    s = table(spark, sf, "supplier").selectExpr("s_name AS zone", "40.5 + CAST(s_suppkey * 41 % 400 AS DOUBLE) / 1000.0e0 AS y", "-74.2 + CAST(s_suppkey * 59 % 400 AS DOUBLE) / 1000.0e0 AS x")
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    polygons = s.select("zone", F.array(corner(0.00013, 0.00013), corner(0.01513, 0.00013), corner(0.01513, 0.01513), corner(0.00013, 0.01513)).alias("ring"))
    return zoned(listings(spark, sf).where("lat is not null"), polygons)
