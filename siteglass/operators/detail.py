"""Lookups and the assembly of one listing's page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearby


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key: none or one. The filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def lookup_cached(ledger: DataFrame, request_hash: str) -> DataFrame:
    """One row (hit, response): a stored null is a hit, a missing key is none."""
    found = ledger.where(F.col("request_hash") == request_hash).agg(F.count(F.lit(1)).alias("n"), F.first("response").alias("response"))
    return found.select((F.col("n") > 0).alias("hit"), "response")


def fetch(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of a list of keys; absent ones are left out."""
    return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")


def feed_items(pages: DataFrame, limit: int | None = None, size: int = 100) -> DataFrame:
    """Items of numbered feed pages (page, body: a JSON list) up to the first page that is short, empty or no list."""
    lists = pages.select("page", F.from_json("body", "array<string>").alias("items")).withColumn("n", F.coalesce(F.size("items"), F.lit(0)))
    short = lists.agg(F.min(F.when(F.col("n") < size, F.col("page"))).alias("last"))
    kept = lists.crossJoin(F.broadcast(short)).where("last is null or page <= last")  # one row
    items = kept.select("page", F.posexplode("items").alias("at", "item"))
    return items if limit is None else items.orderBy("page", "at").limit(limit)


def decode_turns(turns: DataFrame) -> DataFrame:
    """Session turns with what they asked for as fields."""
    asked = F.from_json("musthaves", "property_types array<string>, transaction_type string, min_size_sf bigint, max_size_sf bigint, max_rent_per_sf_yr double")
    return turns.withColumn("asked", asked).select("session_id", "turn", "role", "message", "asked.*")


def decode_reasons(parcels: DataFrame, column: str = "missing_reason_json") -> DataFrame:
    """Why fields are missing, as a map; empty where nothing is said."""
    reasons = F.coalesce(F.from_json(column, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return parcels.withColumn("missing_reason", reasons).drop(column)


def enrich(listings: DataFrame, pois: DataFrame, stations: DataFrame) -> DataFrame:
    """Pending listings with their scores; those without coordinates are not scored rather than scored zero."""
    todo = nearby.pending(listings).select("id", "lat", "lng")
    return nearby.walk_scores(todo, pois).join(nearby.transit_scores(todo, stations, pois), "id")


def pages_of(listings: DataFrame, parcels: DataFrame, pois: DataFrame, stations: DataFrame, airports: DataFrame) -> DataFrame:
    """Listings with their parcel, nearest amenities, stations and airports; what is not known is an empty panel."""
    near = nearby.nearest_amenities(listings, pois).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("category", "rank", "name", F.bround("meters", 0).cast("int").alias("meters")))).alias("amenities"))
    rail = nearby.nearest_stations(listings, stations, 6).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "name", "meters"))).alias("transit"))
    drive = nearby.airport_minutes(listings, airports).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("airport", "minutes"))).alias("airports"))
    out = listings.join(parcels.select("parcel_id", F.struct("*").alias("parcel")), "parcel_id", "left")
    for panel in (near, rail, drive):
        out = out.join(panel, "id", "left")
    return out
