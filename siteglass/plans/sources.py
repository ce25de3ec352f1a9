"""Sources read from rows built out of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files, registry
from .register import query
from .surrogates import dealt, table


@query(
    """SELECT p_partkey || ' ' || p_name AS address, p_brand AS neighborhood, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size * 100 AS BIGINT) END AS size_sf, CASE WHEN p_partkey % 4 <> 3 THEN CAST(1200 + p_size AS DOUBLE) + 0.5 END AS asking_rent,
CASE WHEN p_partkey % 4 <> 3 THEN 'sf_yr' END AS rent_unit, 'csv://nyc/' || p_partkey || '/' || p_partkey || ' ' || p_name AS source_url FROM part WHERE p_partkey % 5 <> 0"""
)
def csv_normalize(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(
        "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE concat(p_partkey, ' ', p_name) END AS ` Address`", "p_brand AS Neighborhood", "CASE WHEN p_partkey % 6 = 0 THEN 'call us' ELSE format_number(p_size * 100, 0) END AS SF",
        "concat('$', format_number(1200 + p_size + 0.5D, 2)) AS Rent", "CASE WHEN p_partkey % 4 <> 3 THEN 'sf_yr' END AS rent_unit", "'ignored' AS Colour", "p_partkey AS _position",
    )
    return files.csv_fields(rows, "nyc", "_position").select("address", "neighborhood", "size_sf", "asking_rent", "rent_unit", "source_url")


@query(
    """SELECT 'https://x.com/p/' || p_partkey AS source_url, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || ' Main St' ELSE p_partkey || ' ' || p_name END AS address, CASE WHEN p_partkey % 2 = 0 THEN 'retail' END AS property_type, CAST(1000 + p_size AS INTEGER) AS size_sf,
CAST(p_size + 40 AS DOUBLE) AS asking_rent, 'sf_yr' AS rent_unit, CASE WHEN p_partkey % 5 = 0 THEN 'ny' END AS geo_state FROM part WHERE p_partkey % 7 <> 0"""
)
def feed_pick(spark: SparkSession, sf: str) -> DataFrame:
    rows = dealt(spark, sf, "part", "p_partkey").selectExpr(
        "p_partkey AS id", "concat('https://x.com/p/', p_partkey) AS link", "concat('a-', replace(p_name, ' ', '-'), CASE WHEN p_partkey % 5 = 0 THEN '-ny-2' ELSE '-zz' END) AS slug",
        "named_struct('rendered', concat(p_partkey, ' ', p_name, CASE WHEN p_partkey % 7 = 0 THEN ' - <b>Leased</b>' ELSE '' END)) AS title", "named_struct('rendered', '') AS guid",
        "CASE WHEN p_partkey % 2 = 0 THEN map('type', 'Retail', 'square_feet', format_number(1000 + p_size, 0), 'address', CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey, ' Main St') ELSE '' END) ELSE map() END AS acf",
        "map('property_type', 'castle', 'size', concat(1000 + p_size, ' SF'), 'street_address', CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey, ' Main St') ELSE '' END) AS meta", "map('rent', concat('$', p_size + 40, '/SF/yr')) AS extra",
    )
    return files.wordpress_listings(rows, "x", "X", "nyc").select("source_url", "address", "property_type", "size_sf", "asking_rent", "rent_unit", "geo_state")


_NODE = """concat('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">', CASE p_partkey % 3 WHEN 0 THEN concat('{"@graph":[{"@type":"Organization","address":{"streetAddress":"1 HQ"}},', n, ']}') WHEN 1 THEN concat('[', n, ']') ELSE n END, '</script></html>')"""


@query("SELECT 'u' || p_partkey AS source_url, p_partkey || ' Oak St, Miami' AS address, CAST(p_size * 10 AS INTEGER) AS size_sf, CASE WHEN p_size + 100 <= 1000 THEN CAST(p_size + 100 AS DOUBLE) END AS asking_rent, 'sf_yr' AS rent_unit FROM part WHERE p_partkey % 4 <> 0")
def json_nodes(spark: SparkSession, sf: str) -> DataFrame:
    node = """concat('{"@type":"', CASE WHEN p_partkey % 4 = 0 THEN 'Organization' ELSE 'Place' END, '","address":{"streetAddress":"', p_partkey, ' Oak St","addressLocality":"Miami"},"floorSize":{"value":"', p_size * 10, '"},"offers":{"price":"', p_size + 100, '"}}')"""
    pages = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey", f"{node} AS n").selectExpr("concat('u', p_partkey) AS url", f"{_NODE} AS html")
    return files.jsonld_listings(pages, "x", "X", "mia").select("source_url", "address", "size_sf", "asking_rent", "rent_unit")


@query("SELECT 'https://x.com/building/b' || p_partkey || '#listing-' || k AS source_url, p_partkey || ' Elm St' AS address, CAST(p_size * 100 + k AS INTEGER) AS size_sf, 'office' AS property_type FROM part, (VALUES (1), (2)) v(k)")
def app_state(spark: SparkSession, sf: str) -> DataFrame:
    body = """concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"__APOLLO_STATE__":{"Building:1":{"__typename":"Building","slug":"/b', p_partkey, '/","address":"', p_partkey, ' Elm St","listings":[{"__ref":"Listing:1"},{"__ref":"Listing:2"},{"__ref":"Listing:3"},{"__ref":"Listing:4"}]},"Building:2":{"__typename":"Building","slug":"/other","address":"9 Far St","listings":[{"__ref":"Listing:1"}]},',
'"Listing:1":{"id":1,"status":"AVAILABLE","squareFeet":', p_size * 100 + 1, ',"details":{"Property Type":"Office"}},"Listing:2":{"id":2,"status":"AVAILABLE","squareFeet":0,"estimatedSquareFeet":', p_size * 100 + 2, ',"details":{"Property Type":"Office"}},"Listing:3":{"id":3,"status":"UNAVAILABLE","squareFeet":5000},"Listing:4":{"id":4,"status":"AVAILABLE","squareFeet":0}}}}}</script>')"""
    pages = dealt(spark, sf, "part", "p_partkey").selectExpr("concat('https://x.com/building/b', p_partkey) AS url", f"{body} AS html")
    return files.app_state_listings(pages, "x", "X", "nyc").select("source_url", "address", "size_sf", "property_type")


@query("SELECT p_partkey AS id, 'https://www.x.com/l/' || p_partkey AS url, CAST(0 AS INTEGER) AS position FROM part UNION ALL SELECT p_partkey, 'https://www.x.com/m/' || p_partkey, CAST(1 AS INTEGER) FROM part")
def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    maps = table(spark, sf, "part").selectExpr("p_partkey AS name", "concat('<urlset><url><loc> http://inner:4500/l/', p_partkey, ' </loc></url><url><loc>https://www.x.com/m/', p_partkey, '</loc></url></urlset>') AS body")
    return files.sitemap_urls(maps, "https://www.x.com/").select(F.col("name").alias("id"), "url", "position")


@query(
    """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'https://data.cityofnewyork.us/resource/92iy-9c3n.json?$where=:id=''row-' || c_custkey || '''' ELSE 'https://data.cityofnewyork.us/resource/92iy-9c3n.json?bbl=1' || c_custkey || '&address=' || c_custkey || '+BROAD+STREET' END AS source_url,
c_custkey || ' BROAD STREET' AS address, 'Staten Island' AS borough, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 40.5e0 END AS lat, 'nyc:1' || c_custkey AS parcel_id FROM customer WHERE c_custkey % 5 <> 0"""
)
def storefronts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey % 2 = 0 THEN concat('row-', c_custkey) END AS `:id`", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('1', c_custkey) END AS bbl", "CASE WHEN c_custkey % 3 = 0 THEN concat(c_custkey, ' BROAD STREET') END AS property_street_address_or",
        "CAST(c_custkey AS STRING) AS property_number", "'BROAD STREET' AS property_street", "'STATEN ISLAND' AS borough", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '40.5' END AS latitude", "'-74.1' AS longitude", "c_mktsegment AS primary_business_activity",
    )
    return registry.storefronts(rows).select("source_url", "address", "borough", "lat", "parcel_id")


@query("SELECT o_orderkey AS document_id, o_orderdate AS recorded_datetime FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def recorded_documents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    legals = o.selectExpr("o_orderkey AS document_id", "'1' AS borough", "CAST(o_custkey AS STRING) AS block", "'0041' AS lot")
    return registry.recorded_documents(legals, o.selectExpr("o_orderkey AS document_id", "o_orderdate AS recorded_datetime"), "1000070041")


@query(
    """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'grocery' WHEN 1 THEN 'bus_stop' WHEN 2 THEN 'parks' ELSE 'entertainment' END AS category, CASE WHEN event_id % 6 = 1 THEN 'B1,B4' ELSE '' END AS routes FROM events WHERE event_id % 6 < 4 AND event_id % 5 <> 0"""
)
def route_refs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").selectExpr(
        "'node' AS type", "event_id AS id", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 40.0D END AS lat", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN -74.0D END AS lon",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE named_struct('lat', 40.1D, 'lon', -74.1D) END AS center",
        "map('name', CAST(event_id AS STRING), CASE event_id % 6 WHEN 0 THEN 'shop' WHEN 1 THEN 'highway' WHEN 2 THEN 'leisure' ELSE 'amenity' END, CASE event_id % 6 WHEN 0 THEN 'supermarket' WHEN 1 THEN 'bus_stop' WHEN 2 THEN 'garden' WHEN 3 THEN 'pub' ELSE 'bench' END, 'route_ref', 'B1;B4; ') AS tags",
    )
    return registry.places(e).select(F.col("name").cast("bigint").alias("id"), "category", F.array_join("route_refs", ",").alias("routes"))


@query(
    """SELECT 'nyc:10083' || lpad('' || p_partkey, 5, '0') AS parcel_id, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS owner_name, CAST(p_size AS INTEGER) AS floors, CASE WHEN p_partkey % 4 <> 0 THEN 1931 END AS year_built, CASE WHEN p_partkey % 2 = 0 THEN 3.44e0 ELSE 15.0e0 END AS far_allowed FROM part"""
)
def parcel_cast(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr(
        "concat('10083', lpad(p_partkey, 5, '0'), '.00000000') AS bbl", "CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '' END AS ownername", "'C5-3' AS zonedist1", "'27.1' AS builtfar", "CASE WHEN p_partkey % 2 = 0 THEN '0.00' ELSE '15.0' END AS commfar", "'3.44' AS residfar",
        "CASE WHEN p_partkey % 4 <> 0 THEN '1931' ELSE 'unknown' END AS yearbuilt", "'91351' AS lotarea", "'2812739' AS bldgarea", "concat(p_size, '.0000000') AS numfloors", "'1' AS unitstotal", "'05' AS landuse",
    )
    return registry.parcels_nyc(rows).select("parcel_id", "owner_name", "floors", "year_built", F.round("far_allowed", 2).alias("far_allowed"))


@query("SELECT pin, name, year_built FROM (SELECT p_partkey AS pin, p_name AS name FROM part) LEFT JOIN (SELECT l_partkey, arg_max(1900 + CAST(l_quantity AS INTEGER), l_orderkey * 10 + l_linenumber) AS year_built FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY l_partkey) ON l_partkey = pin")
def latest_characteristics(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").selectExpr("p_partkey AS pin", "p_name AS name")
    c = table(spark, sf, "lineitem").where("l_partkey % 3 = 0").selectExpr("l_partkey AS pin", "l_orderkey * 10 + l_linenumber AS tax_year", "1900 + CAST(l_quantity AS INT) AS year_built")
    return registry.latest_characteristics(a, c)


@query("SELECT s_suppkey AS id, 'A' || k AS airport, round((s_suppkey * 60 + k * 100) / 60.0, 1) AS minutes FROM supplier, (VALUES (1), (2)) v(k) WHERE NOT (k = 2 AND s_suppkey % 3 = 0)")
def routed_minutes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "array('A1', 'A2') AS airports", "array(0D, CAST(s_suppkey * 60 + 100 AS DOUBLE), CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey * 60 + 200 AS DOUBLE) END) AS durations")
    return registry.routed_minutes(rows)


@query("SELECT n_name AS name, 40.0e0 + n_nationkey AS lat, CASE WHEN n_nationkey % 2 = 0 THEN 'red,blue' ELSE '' END AS lines FROM nation")
def station_feed(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    rows = n.selectExpr("n_nationkey AS stop", "n_name AS name", "CAST(40.0D + n_nationkey AS STRING) AS lat", "'-87'  AS lng", "CASE WHEN n_nationkey % 2 = 0 THEN 'Red & Blue lines' ELSE 'none' END AS said", "1 AS seq")
    rows = rows.unionByName(n.selectExpr("n_nationkey AS stop", "'again' AS name", "'0' AS lat", "'0' AS lng", "'' AS said", "2 AS seq")).withColumn("stop", F.col("stop").cast("string"))
    out = registry.stations_of_feed(rows, "stop", "name", "lat", "lng", registry.named_lines("said", ("red", "blue")))
    return out.select("name", "lat", F.array_join("routes", ",").alias("lines"))


@query("SELECT p_partkey AS asked, 'r1' AS source FROM part WHERE p_partkey % 2 = 0")
def geocoder_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = dealt(spark, sf, "part", "p_partkey")
    said = p.selectExpr("p_partkey", "concat(p_partkey, ' West 38th Street') AS asked", "CASE WHEN p_partkey % 2 = 0 THEN concat(p_partkey, ' W 38 ST') ELSE concat(p_partkey, ' E 39 ST') END AS label", "'r1' AS source", "1 AS rank")
    more = said.withColumns({"source": F.lit("r2"), "rank": F.lit(2)})
    got = registry.accepted_answers(said.unionByName(more))
    return got.select(F.col("p_partkey").alias("asked"), "source")


@query("SELECT 'la:' || p_partkey AS parcel_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1931 END AS year_built, CAST(p_size * 10 AS INTEGER) AS lot_sqft, CAST(p_size AS INTEGER) AS bldg_sqft, CASE WHEN p_partkey % 2 = 0 THEN 'Commercial' ELSE 'Stores' END AS use_code, 'owner_name,zoning' AS missing FROM part")
def parcels_la(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS AIN", "CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE '1931' END AS YearBuilt1", "p_size * 10 + 0.9D AS `Shape.STArea()`", "p_size + 0.2D AS SQFTmain1", "1 AS Units1", "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'Stores' END AS UseType", "'Commercial' AS UseDescription")
    return registry.parcels_la(rows).select("parcel_id", "year_built", "lot_sqft", "bldg_sqft", "use_code", F.array_join(F.array_sort(F.map_keys("missing_reason")), ",").alias("missing"))


@query("SELECT 'chi:' || p_partkey AS parcel_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'O ' || p_brand END AS owner_name, 1899 AS year_built, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END AS floors, CASE WHEN p_partkey % 2 = 0 THEN 'B3-2' END AS zoning, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'zoning' END AS missing FROM part")
def parcels_chicago(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("CAST(p_partkey AS STRING) AS pin", "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('O ', p_brand) END AS owner_address_name", "'1899.0' AS char_yrblt", "'6159.0' AS char_land_sf", "'x' AS char_bldg_sf", "CASE WHEN p_partkey % 5 = 0 THEN 'Story' ELSE concat(p_size, ' Story +') END AS char_type_resd", "'5-17' AS class", "CASE WHEN p_partkey % 2 = 0 THEN 'B3-2' END AS z")
    return registry.parcels_chicago(rows, "z").select("parcel_id", "owner_name", "year_built", "floors", "zoning", F.array_join(F.map_keys("missing_reason"), ",").alias("missing"))


@query("SELECT 'mia:' || p_partkey AS parcel_id, p_name AS owner_name, CAST(p_size AS INTEGER) AS units, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size * 100 AS INTEGER) END AS bldg_sqft, 'STORE' AS use_code FROM part")
def parcels_miami(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS FOLIO", "p_name AS TRUE_OWNER1", "1950 AS YEAR_BUILT", "'7000' AS LOT_SIZE", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size * 100 END AS BUILDING_ACTUAL_AREA", "2 AS FLOOR_COUNT", "p_size AS UNIT_COUNT", "'STORE' AS DOR_DESC")
    return registry.parcels_miami(rows).select("parcel_id", "owner_name", "units", "bldg_sqft", "use_code")


_WORDS = "concat('<html><head><title>x</title></head><body><h1>', p_partkey, ' Main St - Firm</h1><p>Size: ', format_number(p_size + 1000, 0), ' SF retail, ', format_number(p_size + 1000, 0), ' SF. Asking rent: $50/SF. ', p_partkey, ' Main St, Miami, FL</p></body></html>')"


@query(
    """SELECT 'https://b/' || p_partkey || '-main-st/' AS source_url, p_partkey || ' Main St' AS address, p_partkey || ' Main St, Miami, FL' AS geo_hint, CAST(p_size + 1000 AS INTEGER) AS size_sf, 50.0e0 AS asking_rent, 'sf_yr' AS rent_unit, 'retail' AS property_type, 'lease' AS transaction_type FROM part
UNION ALL SELECT 'https://b/' || p_partkey || '-main-st/', p_partkey || ' Main St', p_partkey || ' Main St, Miami, FL', CAST(p_size + 1000 AS INTEGER), 50.0e0, 'sf_yr', 'retail', 'lease' FROM part WHERE p_partkey % 10 = 0"""
)
def page_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listings from the words of pages; a page stored twice gives its listing twice."""
    pages = dealt(spark, sf, "part", "p_partkey").selectExpr("p_partkey", "concat('https://b/', p_partkey, '-main-st/') AS url", f"{_WORDS} AS html")
    out = files.page_listings(pages.unionByName(pages.where("p_partkey % 10 = 0")), "b", "B", "mia")
    return out.select("source_url", "address", "geo_hint", "size_sf", "asking_rent", "rent_unit", "property_type", "transaction_type")


@query(
    """SELECT CASE p_partkey % 4 WHEN 0 THEN 'https://b/building/' || p_partkey || '#listing-1' WHEN 1 THEN 'https://b/ld/' || p_partkey ELSE 'https://b/' || p_partkey || '-main-st/' END AS source_url, CASE p_partkey % 4 WHEN 0 THEN 'app_state' WHEN 1 THEN 'jsonld' ELSE 'page' END AS rung,
CASE p_partkey % 4 WHEN 0 THEN p_partkey || ' Elm St' WHEN 1 THEN p_partkey || ' Oak St, Miami' ELSE p_partkey || ' Main St' END AS address, CAST(p_size + 1000 AS INTEGER) AS size_sf FROM part WHERE p_partkey % 4 <> 3"""
)
def extraction_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """Each page by its first reading that yields; the words of the pages of the first two rungs would yield too."""
    state = """concat('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"__APOLLO_STATE__":{"B:1":{"__typename":"Building","slug":"/', p_partkey, '","address":"', p_partkey, ' Elm St","listings":[{"__ref":"L:1"}]},"L:1":{"id":1,"status":"AVAILABLE","squareFeet":', p_size + 1000, '}}}}}</script>')"""
    node = """concat('<script type="application/ld+json">{"@type":"Place","address":{"streetAddress":"', p_partkey, ' Oak St","addressLocality":"Miami"},"floorSize":{"value":"', p_size + 1000, '"}}</script>')"""
    pages = dealt(spark, sf, "part", "p_partkey").selectExpr(
        "CASE p_partkey % 4 WHEN 0 THEN concat('https://b/building/', p_partkey) WHEN 1 THEN concat('https://b/ld/', p_partkey) WHEN 2 THEN concat('https://b/', p_partkey, '-main-st/') ELSE concat('https://b/about/', p_partkey) END AS url",
        f"CASE p_partkey % 4 WHEN 0 THEN concat({state}, {_WORDS}) WHEN 1 THEN concat({node}, {_WORDS}) WHEN 2 THEN {_WORDS} ELSE '<h1>About us</h1>' END AS html",
    )
    return files.extraction_ladder(pages, "b", "B", "mia").select("source_url", "rung", "address", "size_sf")
