"""Lookups, feeds, decodings, the pages of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detail, search
from ..schema import airports
from ..sources import registry
from .places import _BASE, _meters
from .register import query
from .surrogates import LISTING_SQL, listings, pois, stations, table

L = f"WITH listing AS ({LISTING_SQL}) "


@query(L + "SELECT id, address, size_sf FROM listing WHERE id = 42")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return detail.lookup(listings(spark, sf), "id", 42).select("id", "address", "size_sf")


@query("SELECT count(*) > 0 AS hit, any_value(CASE WHEN event_id % 2 = 0 THEN event_type END) AS response FROM events WHERE event_id = 77")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A stored null is a hit."""
    rows = table(spark, sf, "events").selectExpr("CAST(event_id AS STRING) AS request_hash", "CASE WHEN event_id % 2 = 0 THEN event_type END AS response")
    return detail.lookup_cached(rows, "77")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT s_suppkey * 3 FROM supplier)")
def in_list_fetch(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("k"))
    return detail.fetch(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", ids)


@query("SELECT CAST(n_nationkey AS BIGINT) AS page, CAST(k AS INTEGER) AS at, n_nationkey || '-' || k AS item FROM nation, (VALUES (0), (1)) v(k) WHERE n_nationkey < 6 OR n_nationkey = 6 AND k = 0")
def feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS page", "CASE WHEN n_nationkey = 6 THEN concat('[\"', n_nationkey, '-0\"]') WHEN n_nationkey = 9 THEN 'busy' ELSE concat('[\"', n_nationkey, '-0\", \"', n_nationkey, '-1\"]') END AS body")
    return detail.feed_items(n, size=2)


@query("SELECT o_orderkey AS turn, 'retail,office' AS types, 'lease' AS transaction_type, CAST(o_orderkey % 900 AS BIGINT) AS max_size_sf FROM orders")
def turn_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("CAST(o_custkey AS STRING) AS session_id", "o_orderkey AS turn", "'user' AS role", "o_orderpriority AS message", "concat('{\"property_types\":[\"retail\",\"office\"],\"transaction_type\":\"lease\",\"max_size_sf\":', o_orderkey % 900, '}') AS musthaves")
    return detail.decode_turns(rows).select("turn", F.array_join("property_types", ",").alias("types"), "transaction_type", "max_size_sf")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS owner FROM part")
def parcel_reasons(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN concat('{\"owner_name\":\"', p_name, '\"}') WHEN p_partkey % 3 = 1 THEN 'broken' END AS missing_reason_json")
    return detail.decode_reasons(rows).select("id", F.try_element_at("missing_reason", F.lit("owner_name")).alias("owner"))


@query("SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL")
def postings_index(spark: SparkSession, sf: str) -> DataFrame:
    return search.postings(table(spark, sf, "documents"), "doc_id", ["text"], stemmed=False).select("id", "term", "tf")


@query("SELECT l_suppkey AS id, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS flags, count(DISTINCT l_returnflag) = 1 AS one FROM lineitem GROUP BY l_suppkey")
def distinct_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return g.select("id", F.array_join("f", ",").alias("flags"), (F.size("f") == 1).alias("one"))


@query("SELECT metro, property_type, count(*) AS n, CAST(sum(coalesce(size_sf, 0)) AS BIGINT) AS sf FROM (VALUES ('nyc'), ('mia'), ('la'), ('chi')) m(metro), (VALUES ('retail', 1500), ('office', 4200), ('industrial', 25000)) t(property_type, size_sf) GROUP BY ALL")
def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    return registry.seed(spark).groupBy("metro", "property_type").agg(F.count(F.lit(1)).alias("n"), F.sum("size_sf").alias("sf"))


@query("SELECT page_id, 'Ä ' || page_id AS body FROM pages")
def decoded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN 'iso-8859-1' WHEN 1 THEN NULL ELSE 'no-such-set' END AS charset")
    body = F.concat(F.lit("Ä "), F.col("page_id").cast("string"))
    return p.select("page_id", text.decode_bytes(F.when(F.col("charset") == "iso-8859-1", F.encode(body, "ISO-8859-1")).otherwise(F.encode(body, "UTF-8")), "charset").alias("body"))


@query()
def page_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.to_markdown("html").alias("body"))


@query(
    _BASE + f"""SELECT l.id, CASE WHEN p.p_partkey IS NOT NULL THEN 'nyc:' || l.id END AS parcel, coalesce(n, 0) AS stations, coalesce(a, 0) AS airports FROM listing l LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey = l.id
LEFT JOIN (SELECT id, least(6, count(*)) AS n FROM (SELECT l.id, {_meters('l', 's')} AS m FROM listing l, station s WHERE l.lat IS NOT NULL) WHERE m <= 2414 GROUP BY id) s ON s.id = l.id
LEFT JOIN (SELECT id, CAST(CASE metro WHEN 'nyc' THEN 3 WHEN 'la' THEN 5 ELSE 2 END AS BIGINT) AS a FROM listing WHERE lat IS NOT NULL) a ON a.id = l.id"""
)
def listing_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = listings(spark, sf).withColumn("parcel_id", F.concat(F.lit("nyc:"), F.col("id").cast("string")))
    parcels = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("nyc:"), F.col("p_partkey").cast("string")).alias("parcel_id"), F.col("p_name").alias("owner_name"))
    s = stations(spark, sf).withColumn("routes", F.when(F.col("route").isNotNull(), F.array("route")))
    out = detail.pages_of(rows, parcels, pois(spark, sf), s, airports(spark))
    return out.select("id", F.col("parcel.parcel_id").alias("parcel"), F.coalesce(F.size("transit"), F.lit(0)).cast("bigint").alias("stations"), F.coalesce(F.size("airports"), F.lit(0)).cast("bigint").alias("airports"))
