"""What is written and read back: appended logs, exports, station bundles, backfilled vectors, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger, parse, upsert
from ..operators import workspace as ws
from ..session import shared_folder
from ..sources import exports, registry
from ..streaming import crawl
from .folds import _A, _LOG, arrivals, crawl_log
from .register import query
from .surrogates import LISTING_SQL, listings, table

L = f"WITH listing AS ({LISTING_SQL}) "


@query(_LOG + "SELECT seq, domain, url, status FROM log")
def append_log(spark: SparkSession, sf: str) -> DataFrame:
    """A log that two crawls have added to."""
    log, path = crawl_log(spark, sf).select("seq", "domain", "url", "status"), shared_folder(spark)
    upsert.append(log.where("seq % 2 = 0"), path)
    upsert.append(log.where("seq % 2 <> 0"), path)
    return spark.read.schema(log.schema).parquet(path)


@query(L + "SELECT address, metro, property_type, CAST(size_sf AS BIGINT) AS size_sf, our_description FROM listing WHERE status = 'available'")
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    exports.write_csv(listings(spark, sf).where("status = 'available'"), path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("address", "metro", "property_type", F.col("size_sf").cast("bigint").alias("size_sf"), "our_description")


@query(L + "SELECT id, address, metro, CAST(size_sf AS BIGINT) AS size_sf, asking_rent, 'listing' AS left_as FROM listing")
def export_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Listings as their JSON lines say; a table that may not leave is not written."""
    path, rows = shared_folder(spark), listings(spark, sf)
    names = exports.write_corpus({"listing": rows, "chat": table(spark, sf, "conversations")}, path)
    back = spark.read.schema(rows.schema).json(f"{path}/listing.jsonl")
    return back.select("id", "address", "metro", F.col("size_sf").cast("bigint").alias("size_sf"), "asking_rent", F.lit(",".join(names)).alias("left_as"))


@query("SELECT s_name AS name, 40.5e0 + s_suppkey AS lat, -74.0e0 AS lng, CASE WHEN s_suppkey % 5 = 0 THEN 'ferry' ELSE 'rail' END AS mode FROM supplier")
def station_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """A bundle as it is read from its file, next to a market that has none."""
    path = shared_folder(spark)
    rows = table(spark, sf, "supplier").selectExpr("s_name AS name", "40.5D + s_suppkey AS lat", "-74.0D AS lng", "CASE WHEN s_suppkey % 5 = 0 THEN 'ferry' ELSE 'rail' END AS mode")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(f"{path}/nyc.json")  # a bundle is one file
    return registry.stations(spark, f"{path}/nyc.json").unionByName(registry.stations(spark, f"{path}/mia.json")).select("name", "lat", "lng", "mode")


_BODY = "coalesce(address, '') || ' ' || coalesce(neighborhood, '') || ' ' || coalesce(property_type, '') || ' ' || coalesce(our_description, '')"


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[len(t) % 5, len(t) % 3, 1.0] for t in texts]


@query(L + f", v AS (SELECT id, length({_BODY}) % 5 AS a, length({_BODY}) % 3 AS b FROM listing WHERE id NOT IN (SELECT vec_id FROM embeddings)) SELECT id AS listing_id, round(a / sqrt(a * a + b * b + 1), 4) AS x, round(b / sqrt(a * a + b * b + 1), 4) AS y FROM v")
def embed_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the listings that have none, of length one, by an embedder that looks at lengths of texts."""
    there = table(spark, sf, "embeddings").select(F.col("vec_id").alias("listing_id"))
    out = ws.embed(listings(spark, sf), there, _lengths)
    return out.select("listing_id", F.round(F.col("vector")[0].cast("double"), 4).alias("x"), F.round(F.col("vector")[1].cast("double"), 4).alias("y"))


_SEARCH = {
    "id": "o_orderkey", "metro": "CASE o_orderkey % 5 WHEN 0 THEN 'nyc' WHEN 1 THEN 'mia' WHEN 2 THEN 'la' WHEN 3 THEN 'chi' ELSE 'sea' END", "neighborhood": "o_orderpriority",
    "min_lat": "CASE WHEN o_orderkey % 3 = 0 THEN 0.0e0 ELSE 40.5e0 END", "min_lng": "-74.1e0", "max_lat": "40.75e0", "max_lng": "-73.9e0",
}


@query(
    "SELECT id, CASE WHEN away THEN '' ELSE neighborhood END AS neighborhood, CASE WHEN away THEN 0 ELSE named END AS boroughs, CASE WHEN away THEN 0.0e0 ELSE max_lat END AS max_lat FROM (SELECT *, (min_lat <> 0 AND metro IN ('mia', 'la', 'chi')) OR (named = 1 AND metro <> 'nyc') AS away FROM (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _SEARCH.items())
    + ", CAST(o_custkey % 2 AS INTEGER) AS named FROM orders))"
)
def guarded_places(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier turns without the places of another market."""
    turns = table(spark, sf, "orders").selectExpr(*(f"{e} AS {c}" for c, e in _SEARCH.items()), "CASE WHEN o_custkey % 2 = 1 THEN array('Brooklyn') ELSE CAST(array() AS ARRAY<STRING>) END AS boroughs")
    return parse.guard_places(turns).select("id", "neighborhood", F.size("boroughs").alias("boroughs"), "max_lat")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Nothing matches those constraints in this market yet. Try widening the size range or the rent cap.' ELSE '1 match. The closest is ' || o_orderstatus || ' — ' || o_orderpriority || '.' END AS reply FROM orders")
def empty_reply(spark: SparkSession, sf: str) -> DataFrame:
    """An empty result has no closest listing, and an answer of its own."""
    n = F.col("o_orderkey") % 2
    said = parse.reply(n, F.lit(False), F.lit(""), F.when(n != 0, F.col("o_orderstatus")), F.when(n != 0, F.col("o_orderpriority")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), said.alias("reply"))


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey < 10")
def listed_sources(spark: SparkSession, sf: str) -> DataFrame:
    """URLs on the hosts of listed sources."""
    urls = table(spark, sf, "customer").selectExpr("c_custkey AS id", "concat('https://www.n', c_nationkey, '.com/for-lease/', c_custkey) AS url")
    sources = table(spark, sf, "nation").where("n_nationkey < 10").selectExpr("concat('https://www.n', n_nationkey, '.com') AS url")
    return ledger.listed_only(urls, sources).select("id")


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl log as a stream over the folder that crawls append to."""
    log, path = crawl_log(spark, sf).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), shared_folder(spark)
    upsert.append(log, path)
    return spark.readStream.schema(log.schema).parquet(path)


@query(_LOG + "SELECT DISTINCT url FROM log")
def stream_first_fetches(spark: SparkSession, sf: str) -> DataFrame:
    """The URLs a stream lets through; all that has arrived is one batch, so each comes once."""
    return crawl.run_available(crawl.first_fetches(_arriving(spark, sf)), shared_folder(spark)).select("url")


@query(_LOG + "SELECT CAST(fetched_at AS DATE) AS day, domain, count(*) AS fetched FROM log GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by domain and day as the stream last gave them."""
    out = crawl.run_available(crawl.daily_counts(_arriving(spark, sf)), shared_folder(spark), "update")
    return out.groupBy(F.col("day").cast("date").alias("day"), "domain").agg(F.max("fetched").alias("fetched"))


@query(
    _LOG + """, f AS (SELECT *, status IN (429, 503) AS fail FROM log), ok AS (SELECT domain, max(fetched_at) AS t FROM f WHERE NOT fail GROUP BY domain)
SELECT domain, CAST(least(6, count(*) FILTER (WHERE fail AND (t IS NULL OR fetched_at > t))) AS INTEGER) AS streak FROM f LEFT JOIN ok USING (domain) GROUP BY domain"""
)
def stream_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Refusals in a row by domain as the stream last gave them."""
    out = crawl.run_available(crawl.streaks(_arriving(spark, sf)), shared_folder(spark), "update")
    return out.groupBy("domain").agg(F.max_by("streak", "epoch").alias("streak"))


@query(
    f"""SELECT source_url, arg_max(size_sf, seq) FILTER (WHERE size_sf IS NOT NULL) AS size_sf, arg_max(asking_rent, seq) FILTER (WHERE asking_rent IS NOT NULL) AS asking_rent, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
coalesce(min(seen_at) FILTER (WHERE seq <= 3), min(seen_at)) AS first_seen, coalesce(max(seen_at) FILTER (WHERE seq > 3), max(seen_at)) AS last_seen FROM ({_A}) GROUP BY source_url"""
)
def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a stream that folds sightings: the second finds what was appended since, and the table of the first."""
    folder, rows = shared_folder(spark), arrivals(spark, sf)
    for part in (rows.where("seq <= 3"), rows.where("seq > 3")):
        upsert.append(part, f"{folder}/log")
        log = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        crawl.run_batches(log, folder, crawl.upsert_batches(f"{folder}/table"))
    current = spark.read.text(f"{folder}/table/_current").first().value
    return spark.read.parquet(current)
