"""Tables of the listing model over the tables at hand, by expressions that Spark and DuckDB read alike.

Nulls are derived from keys, so that null semantics are exercised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTING = {
    "id": "p_partkey",
    "metro": "CASE p_partkey % 4 WHEN 0 THEN 'nyc' WHEN 1 THEN 'mia' WHEN 2 THEN 'la' ELSE 'chi' END",
    "status": "CASE WHEN p_partkey % 5 = 0 THEN 'leased' ELSE 'available' END",
    "property_type": "CASE p_size % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'office' WHEN 2 THEN 'industrial' WHEN 3 THEN 'flex' ELSE 'land' END",
    "transaction_type": "CASE WHEN p_partkey % 6 = 0 THEN 'sale' ELSE 'lease' END",
    "address": "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat(CAST(p_partkey AS VARCHAR(20)), ' ', p_name, ' Street, CT ', CAST(10000 + p_partkey * 7 % 900 AS VARCHAR(20))) END",
    "neighborhood": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END",
    "borough": "CASE WHEN p_partkey % 3 = 0 THEN 'Brooklyn' WHEN p_partkey % 3 = 1 THEN 'Queens' END",
    "lat": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 40.5 + CAST(p_partkey * 37 % 400 AS DOUBLE) / 1000.0e0 END",
    "lng": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE -74.2 + CAST(p_partkey * 53 % 400 AS DOUBLE) / 1000.0e0 END",
    "size_sf": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size * 100 END",
    "divisible_min_sf": "CASE WHEN p_partkey % 10 = 3 THEN p_size * 40 END",
    "divisible_max_sf": "CASE WHEN p_partkey % 10 = 3 THEN p_size * 150 END",
    "asking_rent": "CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_retailprice / 20.0e0 END",
    "rent_unit": "CASE p_partkey % 7 WHEN 0 THEN 'sf_yr' WHEN 1 THEN 'sf_mo' WHEN 2 THEN 'mo' WHEN 3 THEN 'week' WHEN 4 THEN NULL ELSE 'sf_yr' END",
    "sale_price": "CASE WHEN p_partkey % 6 = 0 THEN CAST(p_partkey * 1000 + 50000 AS BIGINT) END",
    "our_description": "concat(p_type, ' space with ', p_name)",
    "walk_score": "CASE WHEN p_partkey % 4 = 0 THEN p_size END",
}
LISTING_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in LISTING.items()) + " FROM part"

POI = {
    "id": "l_orderkey * 10 + l_linenumber",
    "category": "CASE l_partkey % 10 WHEN 0 THEN 'grocery' WHEN 1 THEN 'restaurants' WHEN 2 THEN 'shopping' WHEN 3 THEN 'coffee' WHEN 4 THEN 'banks' WHEN 5 THEN 'parks' WHEN 6 THEN 'schools' WHEN 7 THEN 'books' WHEN 8 THEN 'entertainment' ELSE 'bus_stop' END",
    "name": "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE concat('place ', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20))) END",
    "lat": "40.5 + CAST(l_orderkey * 29 % 4000 AS DOUBLE) / 10000.0e0",
    "lng": "-74.2 + CAST(l_partkey * 31 % 4000 AS DOUBLE) / 10000.0e0",
    "route": "concat('B', CAST(l_suppkey % 40 AS VARCHAR(20)))",
}
POI_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in POI.items()) + " FROM lineitem"

STATION = {
    "name": "s_name",
    "lat": "40.5 + CAST(s_suppkey * 41 % 400 AS DOUBLE) / 1000.0e0",
    "lng": "-74.2 + CAST(s_suppkey * 59 % 400 AS DOUBLE) / 1000.0e0",
    "mode": "CASE WHEN s_suppkey % 5 = 0 THEN 'ferry' ELSE 'rail' END",
    "route": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('L', CAST(s_nationkey AS VARCHAR(20))) END",
}
STATION_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in STATION.items()) + " FROM supplier"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEALT = 4  # shares a core, so that a slow one is made up for


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose few bytes a row become a page or an address to be read, dealt over all cores by its key.

    Its file would be one or a few splits however many rows it has, and all reading would be done by as many tasks. The
    narrow rows are dealt, before the pages are made.
    """
    return table(spark, sf_dir, name).repartition(DEALT * spark.sparkContext.defaultParallelism, key)


def _view(spark: SparkSession, sf_dir: str, name: str, columns: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "part", LISTING)


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", POI)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "supplier", STATION)
