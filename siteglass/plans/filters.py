"""Hard filters, predicates on pages and URLs, relaxation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rent, text
from ..operators.relaxation import relaxed_filter
from ..query import ListingQuery, matches, rent_ok, size_ok
from .register import query
from .surrogates import LISTING_SQL, listings, table

L = f"WITH listing AS ({LISTING_SQL}) "
YEARLY = "CASE rent_unit WHEN 'sf_yr' THEN asking_rent WHEN 'sf_mo' THEN asking_rent * 12 WHEN 'mo' THEN CASE WHEN size_sf > 0 THEN asking_rent * 12.0 / size_sf END END"

FULL = ListingQuery(
    property_types=("retail", "office", "flex"), transaction_type="lease", min_size_sf=500, max_size_sf=4500, max_rent_per_sf_yr=580.0,
    min_lat=40.52, max_lat=40.88, min_lng=-74.18, max_lng=-73.82, boroughs=("Brooklyn", "Queens"), neighborhood="brand#1", exclude_states=("nj",), exclude_cities=("Brand#13",), exclude_zip3=("103",),
)
FULL_WHERE = f"""status = 'available' AND metro = 'mia' AND property_type IN ('retail','office','flex') AND transaction_type = 'lease'
AND coalesce(divisible_max_sf, size_sf) >= 500 AND coalesce(divisible_min_sf, size_sf) <= 4500
AND (asking_rent IS NULL OR {YEARLY} <= 580.0) AND lat BETWEEN 40.52 AND 40.88 AND lng BETWEEN -74.18 AND -73.82
AND borough IN ('Brooklyn','Queens') AND neighborhood ILIKE '%brand#1%' AND coalesce(address,'') NOT ILIKE '%nj%'
AND coalesce(neighborhood,'') NOT ILIKE '%Brand#13%' AND coalesce(address,'') NOT ILIKE '% 103%'"""


@query(L + f"SELECT id, size_sf, asking_rent, rent_unit FROM listing WHERE {FULL_WHERE}")
def hard_filter(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(FULL, "mia")).select("id", "size_sf", "asking_rent", "rent_unit")


@query(L + f"SELECT id, {YEARLY} AS per_sf_yr FROM listing")
def rent_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("id", rent.yearly_rent("asking_rent", "rent_unit", "size_sf").alias("per_sf_yr"))


@query(L + f"SELECT id FROM listing WHERE asking_rent IS NULL OR {YEARLY} <= 47.5")
def rent_cap(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(rent_ok(47.5)).select("id")


@query(L + "SELECT id FROM listing WHERE coalesce(divisible_max_sf, size_sf) >= 2000 AND coalesce(divisible_min_sf, size_sf) <= 3000")
def size_band_divisible(spark: SparkSession, sf: str) -> DataFrame:
    low, high = size_ok(2000, 3000)
    return listings(spark, sf).where(low & high).select("id")


@query(L + "SELECT id, lat, lng FROM listing WHERE lat BETWEEN 40.6 AND 40.7 AND lng BETWEEN -74.1 AND -73.9 AND status = 'available'")
def bbox_filter(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(ListingQuery(min_lat=40.6, max_lat=40.7, min_lng=-74.1, max_lng=-73.9))).select("id", "lat", "lng")


@query(L + "SELECT id FROM listing WHERE status = 'available'")
def bbox_partial_ignored(spark: SparkSession, sf: str) -> DataFrame:
    """A box with a corner missing constrains nothing."""
    return listings(spark, sf).where(matches(ListingQuery(min_lat=40.6, max_lat=40.7, min_lng=-74.1))).select("id")


@query(L + "SELECT id FROM listing WHERE status = 'available' AND coalesce(address,'') NOT ILIKE '%ct%' OR status = 'available' AND address IS NULL")
def exclude_states(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(ListingQuery(exclude_states=("CT",)))).select("id")


@query(L + "SELECT id FROM listing WHERE status = 'available' AND coalesce(neighborhood,'') NOT ILIKE '%Brand#1%' AND coalesce(address,'') NOT ILIKE '% 105%'")
def exclude_cities_zip(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(ListingQuery(exclude_cities=("Brand#1",), exclude_zip3=("105",)))).select("id")


@query(L + "SELECT id, borough FROM listing WHERE status = 'available' AND borough IN ('Queens')")
def borough_in(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(ListingQuery(boroughs=("Queens",)))).select("id", "borough")


@query(L + "SELECT id, neighborhood FROM listing WHERE status = 'available' AND neighborhood ILIKE '%BRAND#2%'")
def neighborhood_like(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).where(matches(ListingQuery(neighborhood="BRAND#2"))).select("id", "neighborhood")


@query(L + "SELECT id FROM listing WHERE lat IS NOT NULL AND walk_score IS NULL")
def pending_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.nearby import pending

    return pending(listings(spark, sf)).select("id")


EMPTY = ListingQuery(property_types=("retail",), transaction_type="sale", min_size_sf=4000, max_size_sf=4100, max_rent_per_sf_yr=1.0, neighborhood="Brand#25")
_RUNG = f"""SELECT *, CASE
 WHEN base AND size0 AND rent0 AND hood THEN 0 WHEN base AND size0 AND hood THEN 1
 WHEN base AND size1 AND hood THEN 2 WHEN base AND size1 THEN 3 END AS rung FROM (
 SELECT *, status = 'available' AND metro = 'nyc' AND property_type = 'retail' AND transaction_type = 'sale' AS base,
 coalesce(divisible_max_sf, size_sf) >= 4000 AND coalesce(divisible_min_sf, size_sf) <= 4100 AS size0,
 coalesce(divisible_max_sf, size_sf) >= 2400 AND coalesce(divisible_min_sf, size_sf) <= 6560 AS size1,
 asking_rent IS NULL OR {YEARLY} <= 1.0 AS rent0, coalesce(neighborhood ILIKE '%Brand#25%', false) AS hood FROM listing)"""


@query(
    L + f"""SELECT id, CAST(rung AS INTEGER) AS rung, rung > 0 AS near_miss, ['', 'the rent cap', 'the rent cap and the size range', 'the rent cap and the size range and the neighborhood'][rung + 1] AS relaxed
FROM ({_RUNG}) WHERE rung = (SELECT min(rung) FROM ({_RUNG})) ORDER BY id LIMIT 200"""
)
def relax_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return relaxed_filter(listings(spark, sf), EMPTY, "nyc").select("id", "rung", "near_miss", "relaxed")


UNIT = """CASE WHEN period LIKE 'mo%' THEN CASE WHEN v BETWEEN 0.5 AND 90 THEN 'sf_mo' END WHEN period <> '' THEN CASE WHEN v BETWEEN 5 AND 1000 THEN 'sf_yr' END
WHEN v > 90 THEN CASE WHEN v <= 1000 THEN 'sf_yr' END WHEN v < 5 THEN CASE WHEN v >= 0.5 THEN 'sf_mo' END
WHEN metro = 'la' THEN 'sf_mo' WHEN metro IN ('nyc','mia','chi') THEN 'sf_yr' WHEN kind IN ('industrial','flex') THEN 'sf_mo' END"""
_UNIT_COLS = {
    "id": "p_partkey", "v": "CAST(p_partkey * p_partkey % 1300 AS DOUBLE) / CAST(1 + p_partkey % 9 AS DOUBLE)",
    "period": "CASE p_partkey % 5 WHEN 0 THEN 'month' WHEN 1 THEN 'yr' ELSE '' END",
    "metro": "CASE p_partkey % 6 WHEN 0 THEN 'la' WHEN 1 THEN 'mia' ELSE '' END", "kind": "CASE p_partkey % 3 WHEN 0 THEN 'flex' ELSE 'office' END",
}


@query("SELECT id, " + UNIT + " AS unit FROM (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _UNIT_COLS.items()) + " FROM part)")
def unit_for(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(*(f"{e} AS {c}" for c, e in _UNIT_COLS.items()))
    return rows.select("id", rent.unit_for("v", "period", "metro", "kind").alias("unit"))


_URL = "concat('https://www.', CASE p_partkey % 7 WHEN 0 THEN 'a.com/news/space-' WHEN 1 THEN 'b.com:8080/property/' WHEN 2 THEN 'c.com/2018/01/listing-' WHEN 3 THEN 'd.com/availability/' WHEN 4 THEN 'e.com/building/plan' WHEN 5 THEN 'f.com/welcome/' ELSE 'g.com/listings/x?p=' END, CAST(p_partkey AS VARCHAR(20)), CASE WHEN p_partkey % 7 = 4 THEN '.pdf' WHEN p_partkey % 10 = 6 THEN '-leased' ELSE '' END)"


@query(
    f"SELECT id, (NOT regexp_matches(path, '(?i){text.EDITORIAL}') AND NOT regexp_matches(path, '{text.DATED_PATH}') AND NOT regexp_matches(path, '(?i){text.NOT_A_PAGE}') AND regexp_matches(url, '(?i){text.INVENTORY}')) AS listing_page, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_matches(url, '(?i){text.OFF_MARKET}') AS gone FROM (SELECT p_partkey AS id, {_URL} AS url, string_split({_URL}, '?')[1] AS path FROM part)"
)
def url_classify(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", f"{_URL} AS url")
    return rows.select("id", text.is_listing_page("url").alias("listing_page"), text.domain("url").alias("host"), text.off_market("url").alias("gone"))
