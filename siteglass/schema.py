"""Schemas of the tables the library works on, and small reference dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DDL strings, accepted wherever Spark takes a schema.
LISTING = (
    "id bigint, source string, source_url string, status string, metro string, transaction_type string, address string, "
    "neighborhood string, borough string, lat double, lng double, parcel_id string, property_type string, subtype string, size_sf int, "
    "divisible_min_sf int, divisible_max_sf int, total_building_sf int, floor string, ceiling_height_ft double, "
    "asking_rent double, rent_unit string, lease_type string, sale_price bigint, availability_date string, "
    "lease_term_months int, condition string, broker_name string, broker_firm string, broker_phone string, "
    "broker_email string, features array<string>, highlights array<string>, photo_urls array<string>, "
    "our_description string, walk_score int, transit_score int, "
    "score_breakdown map<string,struct<score:double,weight:double,count:bigint,nearest_m:bigint>>, "
    "semantic_score double, score double, first_seen timestamp, last_seen timestamp"
)
PARCEL = (
    "parcel_id string, metro string, owner_name string, zoning string, far_built double, far_allowed double, year_built int, "
    "lot_sqft int, bldg_sqft int, floors int, units int, use_code string, missing_reason map<string,string>"
)
POI = "category string, name string, lat double, lng double, route_refs array<string>"
STATION = "name string, lat double, lng double, mode string, routes array<string>"
TURN = "session_id string, turn int, role string, message string, musthaves string, created_at timestamp"
LEDGER = "request_hash string, provider string, response string, cost_cents bigint, created_at timestamp"
CRAWL_LOG = "domain string, url string, status int, etag string, last_modified string, fetched_at timestamp"

PROPERTY_TYPES = ("retail", "office", "industrial", "flex", "land")
RENT_UNITS = ("sf_yr", "sf_mo", "mo")

# The markets (bbox: min_lat, min_lng, max_lat, max_lng), in the order in which the first match wins.
METROS: dict[str, dict] = {
    "nyc": {
        "name": "New York City", "state": "ny", "bbox": (40.4774, -74.2591, 40.9176, -73.7002), "center": (40.7580, -73.9855), "shipped": True,
        "airports": {"JFK": (40.6413, -73.7781), "LGA": (40.7769, -73.8740), "EWR": (40.6895, -74.1745)},
        "boroughs": ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island"),
    },
    "mia": {
        "name": "Miami", "state": "fl", "bbox": (25.55, -80.50, 25.98, -80.10), "center": (25.7743, -80.1937), "shipped": True,
        "airports": {"MIA": (25.7959, -80.2870), "FLL": (26.0742, -80.1506)},
        "boroughs": ("Miami", "Miami Beach", "Coral Gables", "Doral", "Hialeah"),
    },
    "la": {
        "name": "Los Angeles", "state": "ca", "bbox": (33.70, -118.70, 34.35, -117.85), "center": (34.0522, -118.2437), "shipped": True,
        "airports": {"LAX": (33.9416, -118.4085), "BUR": (34.2007, -118.3587), "LGB": (33.8177, -118.1516), "SNA": (33.6757, -117.8683), "ONT": (34.0560, -117.6012)},
        "boroughs": ("Downtown", "Hollywood", "Westside", "San Fernando Valley", "South Bay"),
    },
    "chi": {
        "name": "Chicago", "state": "il", "bbox": (41.469, -88.264, 42.154, -87.524), "center": (41.8781, -87.6298), "shipped": False,
        "airports": {"ORD": (41.9742, -87.9073), "MDW": (41.7868, -87.7522)},
        "boroughs": ("Loop", "West Loop", "River North", "Lincoln Park", "Hyde Park"),
    },
}


def metros(spark: SparkSession) -> DataFrame:
    """One row a market, with its place in the order of matching."""
    rows = [(k, i, m["name"], m["state"], *m["bbox"], list(m["boroughs"]), m["shipped"]) for i, (k, m) in enumerate(METROS.items())]
    return spark.createDataFrame(rows, "metro string, ord int, name string, state string, min_lat double, min_lng double, max_lat double, max_lng double, boroughs array<string>, shipped boolean")


def airports(spark: SparkSession) -> DataFrame:
    """One row an airport: metro, airport, lat, lng."""
    return spark.createDataFrame([(k, a, *at) for k, m in METROS.items() for a, at in m["airports"].items()], "metro string, airport string, lat double, lng double")
