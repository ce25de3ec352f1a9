"""Saves, portfolios, sessions, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import workspace as ws
from ..sources.exports import bar_width, export_fields, map_pins, to_api
from .register import query
from .surrogates import LISTING_SQL, listings, table

L = f"WITH listing AS ({LISTING_SQL}) "


@query(L + "SELECT id FROM listing WHERE status = 'available' AND id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def saved_semi(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.relaxation import hard_filter
    from ..query import ListingQuery

    saved = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    return hard_filter(listings(spark, sf), ListingQuery(), saved=saved, limit=None).select("id")


@query(L + "SELECT id FROM listing WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def not_embedded_anti(spark: SparkSession, sf: str) -> DataFrame:
    return ws.not_embedded(listings(spark, sf), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "listing_id")).select("id")


@query(L + "SELECT id, address, o_orderdate AS saved_at FROM listing JOIN orders ON o_orderkey = id WHERE metro = 'mia'")
def saved_inner_sorted(spark: SparkSession, sf: str) -> DataFrame:
    saved = table(spark, sf, "orders").select(F.col("o_orderkey").alias("listing_id"), F.col("o_orderdate").alias("saved_at"))
    return ws.saved_listings(listings(spark, sf), saved, "mia").select("id", "address", "saved_at")


@query("SELECT l_orderkey AS portfolio_id, id, price FROM (SELECT p_partkey AS id, p_retailprice AS price FROM part) JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey = 7) ON l_partkey = id")
def portfolio_items(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("portfolio_id"), F.col("l_partkey").alias("listing_id")).where("portfolio_id = 7").distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return ws.portfolio_listings(parts, items, 7).select(F.lit(7).cast("bigint").alias("portfolio_id"), "id", "price")


@query("SELECT s.conv_id, s.first_role, count(t.turn) AS turns FROM (SELECT conv_id, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id) s LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') t ON t.conv_id = s.conv_id GROUP BY ALL")
def session_turn_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    sessions = c.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"))
    return ws.counted_children(sessions, c.where("role = 'assistant'"), "conv_id", "turn", "turns").select("conv_id", "first_role", "turns")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def portfolio_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return ws.counted_children(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_orderkey", "items")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 8")
def last_turns(spark: SparkSession, sf: str) -> DataFrame:
    return ws.last_turns(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn")


@query(L + "SELECT id, address, property_type AS \"propertyType\", size_sf AS \"sizeSf\", our_description AS description, asking_rent AS \"askingRent\", rent_unit AS \"rentUnit\" FROM listing")
def api_projection(spark: SparkSession, sf: str) -> DataFrame:
    return to_api(listings(spark, sf).select("id", "address", "property_type", "size_sf", "our_description", "asking_rent", "rent_unit"))


@query(L + "SELECT id, '{\"id\":' || id || ',\"lat\":' || printf('%.3f', lat).regexp_replace('0+$', '').regexp_replace('[.]$', '.0') || ',\"lng\":' || printf('%.3f', lng).regexp_replace('0+$', '').regexp_replace('[.]$', '.0') || ',\"label\":\"' || coalesce(address, '') || '\"}' AS pin FROM (SELECT id, CASE WHEN lat IS NULL THEN NULL ELSE 40.125 + id % 8 / 8.0 END AS lat, -73.125 - id % 8 / 8.0 AS lng, address FROM listing) WHERE lat IS NOT NULL")
def map_pin(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).selectExpr("id", "CASE WHEN lat IS NULL THEN NULL ELSE 40.125D + id % 8 / 8.0D END AS lat", "-73.125D - id % 8 / 8.0D AS lng", "address")
    return map_pins(rows)


@query(L + "SELECT id, CASE WHEN w <> 0 THEN CAST(round_even(100.0 * s / w, 0) AS INTEGER) ELSE 0 END AS width FROM (SELECT id, CAST(id % 7 AS DOUBLE) AS s, CAST(id % 5 AS DOUBLE) AS w FROM listing)")
def score_bar(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS s", "CAST(id % 5 AS DOUBLE) AS w").select("id", bar_width("s", "w").alias("width"))


_MONEY2 = "format('{:,.2f}', asking_rent)"
_MONEY0 = "format('{:,}', CAST(round_even(asking_rent, 0) AS BIGINT))"
_SAFE = "(SELECT * REPLACE (CASE WHEN asking_rent IS NOT NULL THEN CAST(id % 900 AS DOUBLE) + 0.25e0 END AS asking_rent) FROM listing)"


@query(L + f"SELECT id, CASE WHEN asking_rent IS NULL THEN CASE WHEN sale_price IS NOT NULL THEN '$' || format('{{:,}}', sale_price) END WHEN rent_unit = 'sf_mo' THEN '$' || {_MONEY2} || '/SF/mo' WHEN rent_unit = 'mo' THEN '$' || {_MONEY0} || '/mo' ELSE '$' || {_MONEY2} || '/SF/yr' END AS money FROM {_SAFE}")
def rent_display(spark: SparkSession, sf: str) -> DataFrame:
    return _quarters(spark, sf).select("id", text.rent_display().alias("money"))


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    """Listings with rents that print alike everywhere."""
    return listings(spark, sf).withColumn("asking_rent", F.when(F.col("asking_rent").isNotNull(), (F.col("id") % 900).cast("double") + 0.25))


@query(
    L + f"""SELECT id, upper(s[1]) || s[2:] || ' at ' || coalesce(address, '') || CASE WHEN divisible_min_sf <> 0 AND divisible_max_sf <> 0 AND divisible_min_sf <> divisible_max_sf THEN ', divisible ' || format('{{:,}}', divisible_min_sf) || '-' || format('{{:,}}', divisible_max_sf) || ' SF' ELSE '' END
|| CASE WHEN asking_rent <> 0 THEN ', asking $' || CASE coalesce(rent_unit, 'sf_yr') WHEN 'sf_mo' THEN {_MONEY2} || '/SF/mo' WHEN 'mo' THEN {_MONEY0} || '/mo' ELSE {_MONEY2} || '/SF/yr' END WHEN sale_price <> 0 THEN ', asking $' || format('{{:,}}', sale_price) ELSE '' END || '.' AS sentence
FROM (SELECT *, concat_ws(' ', CASE WHEN size_sf <> 0 THEN format('{{:,}}', size_sf) || ' SF' END, coalesce(nullif(property_type, ''), 'commercial space'), CASE WHEN neighborhood <> '' THEN 'in ' || neighborhood END) AS s FROM {_SAFE})"""
)
def describe(spark: SparkSession, sf: str) -> DataFrame:
    rows = _quarters(spark, sf).withColumns({"floor": F.lit(None).cast("string"), "total_building_sf": F.lit(None).cast("int")})
    return rows.select("id", text.describe().alias("sentence"))


@query(L + "SELECT id, coalesce(address, '') || ' ' || coalesce(neighborhood, '') || ' ' || coalesce(property_type, '') || ' ' || coalesce(our_description, '') AS body FROM listing")
def embedding_text(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("id", text.text_of("address", "neighborhood", "property_type", "our_description").alias("body"))


@query(L + "SELECT id, concat_ws(chr(10), 'address: ' || address, 'neighborhood: ' || neighborhood, 'property_type: ' || property_type, 'size_sf: ' || size_sf, 'rent_unit: ' || rent_unit, 'sale_price: ' || sale_price) AS facts FROM listing")
def listing_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).select("id", "address", "neighborhood", "property_type", "size_sf", "rent_unit", "sale_price")
    missing = {c: F.lit(None).cast("string") for c in text.FACTS if c not in rows.columns}
    breakdown = F.lit(None).cast("map<string,struct<score:double,weight:double,count:bigint,nearest_m:bigint>>")
    return rows.withColumns({**missing, "score_breakdown": breakdown}).select("id", text.listing_facts().alias("facts"))


@query(L + "SELECT address, neighborhood, borough, metro, property_type, transaction_type, size_sf, asking_rent, sale_price, our_description FROM listing WHERE status = 'available'")
def export_list(spark: SparkSession, sf: str) -> DataFrame:
    out = export_fields(listings(spark, sf).where("status = 'available'"))
    return out.select("address", "neighborhood", "borough", "metro", "property_type", "transaction_type", "size_sf", "asking_rent", "sale_price", "our_description")
