"""Upserts, toggles, ledgers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, upsert
from .register import query
from .surrogates import table

ARRIVAL = {
    "source_url": "CAST(l_orderkey AS VARCHAR(20))",
    "seq": "l_linenumber",
    "size_sf": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 100 END",
    "asking_rent": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_extendedprice END",
    "status": "CASE WHEN l_partkey % 7 = 0 THEN 'leased' END",
    "seen_at": "l_shipdate",
}
_A = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in ARRIVAL.items()) + " FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1)"


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Sightings of a listing, one an order and line (the least row where a line repeats)."""
    rows = table(spark, sf, "lineitem")
    values = [c for c in rows.columns if c not in ("l_orderkey", "l_linenumber")]
    first = ["l_partkey", "l_suppkey", "l_extendedprice"]
    once = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct(*values), F.struct(*first)).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    return once.selectExpr(*(f"{e} AS {c}" for c, e in ARRIVAL.items()))


@query(
    f"SELECT source_url, arg_max(size_sf, seq) FILTER (WHERE size_sf IS NOT NULL) AS size_sf, arg_max(asking_rent, seq) FILTER (WHERE asking_rent IS NOT NULL) AS asking_rent, coalesce(arg_max(status, seq) FILTER (WHERE status IS NOT NULL), 'available') AS status, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM ({_A}) GROUP BY source_url"
)
def upsert_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.coalescing_upsert(arrivals(spark, sf), defaults={"status": "available"})


@query(f"SELECT source_url, size_sf, asking_rent, status FROM ({_A}) QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY seq DESC) = 1")
def upsert_replace(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.replacing_upsert(arrivals(spark, sf).drop("seen_at"), "source_url")


@query(f"SELECT source_url, arg_min(seen_at, seq) AS seen_at, CAST(sum(coalesce(size_sf, 0)) AS BIGINT) AS size_sf FROM ({_A}) GROUP BY source_url")
def upsert_accumulate(spark: SparkSession, sf: str) -> DataFrame:
    rows = arrivals(spark, sf).withColumn("size_sf", F.coalesce("size_sf", F.lit(0)))
    return upsert.accumulating_upsert(rows, "source_url", "size_sf", ["seen_at"])


@query("SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 2 = 0)")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "lineitem").where("l_partkey % 2 = 0").select(F.col("l_orderkey").alias("id")).distinct()
    new = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit(1).alias("seq"))
    return upsert.insert_or_ignore(old, new, ["id"])


@query("SELECT user_id AS k, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_value_kv(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.last_value(table(spark, sf, "events").select(F.col("user_id").alias("k"), "value", F.col("event_id").alias("seq")), "k", "value")


@query("SELECT user_id AS listing_id FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) % 2 = 1")
def toggle_parity(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.toggled(table(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("listing_id")), "listing_id")


@query(
    "SELECT l_orderkey AS parent, CAST(l_linenumber AS BIGINT) AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, CAST(-1 AS BIGINT) FROM orders WHERE o_orderstatus = 'P'"
)
def replace_children(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").cast("bigint").alias("v"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"), F.lit(-1).cast("bigint").alias("v"))
    return upsert.replace_children(old, new, "parent")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return upsert.cascade(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query(
    "SELECT p_partkey AS id, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size END, 0), CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 END) AS size_sf FROM part"
)
def fact_merge(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    feed = part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size END AS size_sf")
    pages = part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS id", "p_size * 10 AS size_sf")
    return upsert.fill_missing(feed, pages, "id", ["size_sf"])


def spend(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("request_hash"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cost_cents"), F.col("o_orderdate").alias("created_at"))


@query("SELECT CAST(s AS BIGINT) AS spent, greatest(0, 1000000000 - CAST(s AS BIGINT)) AS remaining FROM (SELECT coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS s FROM orders WHERE strftime(o_orderdate, '%Y-%m') = '1997-05')")
def month_spend(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.budget_left(spend(spark, sf), "1997-05", 1_000_000_000)


@query(
    """WITH calls AS (SELECT event_id AS seq, user_id * 10 + event_id % 7 AS request_hash, CAST(event_id % 5 + 1 AS BIGINT) AS cost_cents, ts AS created_at FROM events),
told AS (SELECT *, row_number() OVER (PARTITION BY request_hash ORDER BY seq) > 1 AS hit, strftime(created_at, '%Y-%m') AS month FROM calls)
SELECT seq, hit, hit OR sum(CASE WHEN hit THEN 0 ELSE cost_cents END) OVER (PARTITION BY month ORDER BY seq ROWS UNBOUNDED PRECEDING) <= 1000 AS accepted FROM told"""
)
def budget_admission(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "events").selectExpr("event_id AS seq", "user_id * 10 + event_id % 7 AS request_hash", "CAST(event_id % 5 + 1 AS BIGINT) AS cost_cents", "ts AS created_at")
    return ledger.admitted(calls, 1000).select("seq", "hit", "accepted")


LOG = {
    "seq": "event_id", "domain": "event_type", "url": "CAST(user_id AS VARCHAR(20))", "status": "CASE WHEN event_id % 3 < 2 THEN 429 ELSE 200 END",
    "etag": "CASE WHEN event_id % 4 = 0 THEN concat('e', CAST(event_id AS VARCHAR(20))) END", "last_modified": "CASE WHEN event_id % 6 = 0 THEN concat('m', CAST(event_id AS VARCHAR(20))) END", "fetched_at": "ts",
}
_LOG = "WITH log AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in LOG.items()) + " FROM events) "


def crawl_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*(f"{e} AS {c}" for c, e in LOG.items()))


@query(_LOG + "SELECT domain, count(*) AS fetched FROM log WHERE CAST(fetched_at AS DATE) = DATE '2024-01-05' GROUP BY domain")
def daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fetched_today(crawl_log(spark, sf), "2024-01-05")


@query(_LOG + "SELECT DISTINCT url FROM log WHERE fetched_at > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 24 HOURS AND fetched_at <= TIMESTAMP '2024-01-10 12:00:00'")
def ttl_recent(spark: SparkSession, sf: str) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'")
    return ledger.fresh_urls(crawl_log(spark, sf).where(F.col("fetched_at") <= now), now)


@query(_LOG + "SELECT url, etag, last_modified FROM log WHERE etag IS NOT NULL OR last_modified IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) = 1")
def latest_validator(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.validators(crawl_log(spark, sf))


@query(
    _LOG + """, f AS (SELECT *, status IN (429, 503) AS fail FROM log), g AS (SELECT *, sum(CASE WHEN fail THEN 0 ELSE 1 END) OVER (PARTITION BY domain, url ORDER BY fetched_at, seq ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT seq, CAST(least(6, sum(CASE WHEN fail THEN 1 ELSE 0 END) OVER (PARTITION BY domain, url, island ORDER BY fetched_at, seq ROWS UNBOUNDED PRECEDING)) AS INTEGER) AS streak FROM g"""
)
def failure_streak(spark: SparkSession, sf: str) -> DataFrame:
    rows = crawl_log(spark, sf).withColumn("k", F.concat_ws("|", "domain", "url"))
    return ledger.failure_streaks(rows, F.col("status").isin(429, 503), ["fetched_at", "seq"], "k").select("seq", "streak")


@query("SELECT event_id AS id, greatest(4.0, CASE WHEN event_id % 3 = 0 THEN 10.0 ELSE 0.0 END) * pow(2.0, event_id % 7) AS wait FROM events")
def backoff_delay(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 3 = 0 THEN 10.0D END AS site", "event_id % 7 AS streak")
    return rows.select("id", ledger.delay_seconds(4.0, "site", "streak").alias("wait"))


@query("SELECT event_id AS id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS request_hash FROM events")
def request_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), ledger.request_hash("user_id", "event_type").alias("request_hash"))


@query(
    "SELECT event_type AS source, count(*) AS fetched, count(*) FILTER (WHERE event_id % 2 = 0) AS saved, count(*) FILTER (WHERE event_id % 5 = 0) AS no_pin, count(*) FILTER (WHERE event_id % 11 = 0) AS error FROM events GROUP BY event_type"
)
def crawl_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.crawl_stats(table(spark, sf, "events").selectExpr("event_type AS source", "event_id % 2 = 0 AS saved", "event_id % 5 = 0 AS no_pin", "event_id % 11 = 0 AS error"))
