"""Readers, exports and streams."""

import csv
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siteglass.sources import exports, files, registry
from siteglass.plans.register import QUERIES
from siteglass.streaming import crawl


def test_csv_upload(spark, tmp_path):
    p = tmp_path / "up.csv"
    p.write_text('﻿ Address,SF,Size,Rent,rent_unit,Colour\n"1 A St","3,200",,"$45.50",sf_yr,red\n,100,,,,\n2 B St,big,900,50,,\n"3 C\nSt",,,,,\n', encoding="utf-8")
    got = {r.address: r for r in files.read_csv(spark, str(p), "nyc").collect()}
    assert set(got) == {"1 A St", "2 B St", "3 C\nSt"}
    assert (got["1 A St"].size_sf, got["1 A St"].asking_rent, got["1 A St"].source_url) == (3200, 45.5, "csv://nyc/0/1 A St")
    assert (got["2 B St"].size_sf, got["2 B St"].asking_rent, got["2 B St"].source_url) == (900, None, "csv://nyc/2/2 B St")


def test_wordpress_feed(spark):
    rows = [
        (1, "https://x/1", "280-broadway-new-york-ny", "280 Broadway &#8211; Retail", {"address": "", "size": "1,500 SF", "type": "Retail", "rent": "$2.25/SF/Mo"}),
        (2, "https://x/2", "gone", "105 Mile &#8211; Leased", {"address": "105 Mile"}),
        (3, "https://x/3", "no", "Great corner!", {}),
        (4, "", "9-austin-tx-3", "T", {"street_address": "9 Elm &amp; Oak", "property_type": "castle", "square_feet": "1.5"}),
    ]
    df = spark.createDataFrame([(i, u, s, t, a) for i, u, s, t, a in rows], "id long, link string, slug string, t string, acf map<string,string>").selectExpr("id", "link", "slug", "named_struct('rendered', t) AS title", "named_struct('rendered', concat('g', id)) AS guid", "acf", "CAST(NULL AS map<string,string>) AS meta", "CAST(NULL AS map<string,string>) AS extra")
    got = {r.source_url: r for r in files.wordpress_listings(df, "x", "Firm", "la").collect()}
    assert set(got) == {"https://x/1", "g4"}
    a, b = got["https://x/1"], got["g4"]
    assert (a.address, a.size_sf, a.asking_rent, a.rent_unit, a.geo_state, a.property_type) == ("280 Broadway – Retail", 1500, 2.25, "sf_mo", "ny", "retail")
    assert (b.address, b.size_sf, b.property_type, b.geo_state) == ("9 Elm & Oak", None, None, "tx") and b.our_description.startswith("Commercial space at 9 Elm & Oak")


LD = '<script type="application/ld+json">%s</script>'
STATE = {"Building:1": {"__typename": "Building", "slug": "/one", "address": "1 Elm St", "listings": [{"__ref": "L:1"}, {"__ref": "L:2"}]}, "L:1": {"id": 1, "status": "AVAILABLE", "squareFeet": 5438, "details": {"Property Type": "Office"}}, "L:2": {"id": 2, "status": "UNAVAILABLE", "squareFeet": 900}}


def test_extraction_ladder(spark):
    pages = [
        ("https://b/building/one", '<script id="__NEXT_DATA__" type="application/json">' + json.dumps({"props": {"pageProps": {"__APOLLO_STATE__": STATE}}}) + "</script>"),
        ("https://b/ld", LD % json.dumps({"@graph": [{"@type": "Organization", "address": {"streetAddress": "1 HQ"}}, {"@type": ["Place"], "address": {"streetAddress": "7 Oak St", "addressLocality": "Miami"}, "floorSize": {"value": "2100"}, "offers": {"price": "58"}, "image": "i.jpg"}]})),
        ("https://b/5-main-st/", "<h1>5 Main St - Firm</h1><p>Size: 1,400 SF retail, 1,400 SF. Asking rent: $50/SF. 5 Main St, Miami, FL</p>"),
        ("https://b/nothing", "<h1>About us</h1>"),
        ("https://b/x", None),
        ("https://b/9-elm-st-leased/", "<h1>9 Elm St</h1> 1,000 SF"),
    ]
    got = {r.source_url: r for r in files.extraction_ladder(spark.createDataFrame(pages, "url string, html string"), "b", "B", "mia").collect()}
    assert {u: r.rung for u, r in got.items()} == {"https://b/building/one#listing-1": "app_state", "https://b/ld": "jsonld", "https://b/5-main-st/": "page"}
    assert (got["https://b/ld"].address, got["https://b/ld"].size_sf, got["https://b/ld"].asking_rent, got["https://b/ld"].photo_urls) == ("7 Oak St, Miami", 2100, 58.0, ["i.jpg"])
    page = got["https://b/5-main-st/"]
    assert (page.size_sf, page.asking_rent, page.rent_unit, page.geo_state, page.property_type, page.transaction_type) == (1400, 50.0, "sf_yr", "fl", "retail", "lease")
    assert got["https://b/building/one#listing-1"].size_sf == 5438


def test_sitemaps(spark):
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>http://inner:4500/s{i}.xml</loc></sitemap>" for i in range(15)) + "</sitemapindex>"
    maps = spark.createDataFrame([("i", index), ("m", "<urlset><url><loc>https://w.com/retail/1</loc></url><url><loc>https://w.com/home/2</loc></url></urlset>")], "name string, body string")
    got = [(r.name, r.url) for r in files.sitemap_urls(maps, "https://w.com/", "https://w.com/retail").collect()]
    assert len(got) == 13 and ("i", "https://w.com/s0.xml") in got and ("m", "https://w.com/retail/1") in got


def test_parcels_and_null_reasons(spark):
    la = spark.createDataFrame([("1", "1931", 5679.9, 0, 3, None, "Commercial")], "AIN string, YearBuilt1 string, `Shape.STArea()` double, Units1 int, SQFTmain1 int, UseType string, UseDescription string")
    r = registry.parcels_la(la).first()
    assert (r.parcel_id, r.year_built, r.lot_sqft, r.units, r.use_code) == ("la:1", 1931, 5679, 0, "Commercial") and set(r.missing_reason) == {"owner_name", "zoning"} and r.owner_name is None
    chi = spark.createDataFrame([("9", "", "1899.0", "6159.0", "bad", "3 Story +", "5-17", "B3-2"), ("8", "O", None, "", "1", "x", "", None)], "pin string, owner_address_name string, char_yrblt string, char_land_sf string, char_bldg_sf string, char_type_resd string, class string, z string")
    a, b = registry.parcels_chicago(chi, "z").orderBy(F.col("pin").desc()).collect()
    assert (a.year_built, a.floors, a.bldg_sqft, a.zoning, a.missing_reason, a.owner_name) == (1899, 3, None, "B3-2", {}, None)
    assert (b.floors, b.zoning, set(b.missing_reason)) == (None, None, {"zoning"})


def test_places_and_empty_answers(spark):
    rows = [("node", 1, 1.0, 2.0, None, {"amenity": "cafe"}), ("way", 2, None, None, (3.0, 4.0), {"shop": "mall", "name": "M"}), ("node", 3, 1.0, 1.0, None, {"highway": "bus_stop", "route_ref": "B1;B4; "}), ("node", 4, 1.0, 1.0, None, {"amenity": "bench"}), ("node", 5, None, None, None, {"amenity": "cafe"}), ("node", 6, 1.0, 1.0, None, None)]
    got = registry.places(spark.createDataFrame(rows, registry.ELEMENT)).collect()
    assert sorted(r.category for r in got) == ["bus_stop", "coffee", "shopping"] and next(r.route_refs for r in got if r.category == "bus_stop") == ["B1", "B4"]
    assert registry.require_rows(spark.range(2), "x").count() == 2
    with pytest.raises(Exception, match="no rows"):
        registry.require_rows(spark.range(0), "places").collect()
    assert registry.stations(spark, "/nowhere/at/all.json").count() == 0
    assert registry.seed(spark).count() == 12


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A, St", None, 5, ["x"]), (2, "B", "n", None, None)], "id long, address string, neighborhood string, size_sf int, features array<string>")
    exports.write_csv(rows, f"{tmp_path}/c")
    text = next((tmp_path / "c").glob("part-*")).read_text()
    got = list(csv.DictReader(io.StringIO(text)))
    assert list(got[0]) == exports.FIELDS and [r["address"] for r in got] == ["A, St", "B"] and got[0]["neighborhood"] == ""
    book = zipfile.ZipFile(io.BytesIO(exports.workbook(rows)))
    assert book.testzip() is None and book.read("xl/worksheets/sheet1.xml").count(b"<row>") == 3
    made = exports.write_corpus({"listing": rows, "chat": rows, "portfolio_item": rows, "poi": rows}, f"{tmp_path}/all")
    assert made == ["listing"] and (tmp_path / "all" / "listing.jsonl").exists()
    api = exports.to_api(rows).orderBy("id").collect()
    assert api[1].features == [] and exports.to_api(rows).columns[3] == "sizeSf"


def test_streams_agree_with_batches(spark, tmp_path):
    schema = "domain string, url string, status int, fetched_at timestamp"
    rows = [("a", f"u{i % 4}", 429 if i % 5 else 200, f"2024-01-0{1 + i // 20} 0{i % 10}:00:00") for i in range(40)]
    spark.createDataFrame(rows, "domain string, url string, status int, t string").select("domain", "url", "status", F.to_timestamp("t").alias("fetched_at")).coalesce(1).write.parquet(f"{tmp_path}/log")
    log = spark.readStream.schema(schema).parquet(f"{tmp_path}/log")

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    assert {r.url for r in run(crawl.first_fetches(log), "append", "firsts")} == {"u0", "u1", "u2", "u3"}
    assert run(crawl.streaks(log), "update", "streaks")[-1].domain == "a"
    counts = run(crawl.daily_counts(log), "update", "days")
    assert sum(r.fetched for r in counts) == 40
    batch = spark.createDataFrame([("k", 1, "csv", "a", None), ("k", 2, "csv", None, 5)], "source_url string, seq int, source string, address string, size_sf int").withColumn("seen_at", F.lit("2024-01-01").cast("timestamp"))
    fold = crawl.upsert_batches(f"{tmp_path}/table")
    fold(batch, 0)
    fold(batch.where("seq = 2").withColumn("size_sf", F.lit(7)), 1)
    path = spark.read.text(f"{tmp_path}/table/_current").first().value
    got = spark.read.parquet(path).collect()
    assert [(r.source_url, r.address, r.size_sf) for r in got] == [("k", "a", 7)]


def test_workbook_holds_all_rows(spark):
    rows = spark.range(100_001).selectExpr("id", "'a' as address")
    book = zipfile.ZipFile(io.BytesIO(exports.workbook(rows)))
    assert book.read("xl/worksheets/sheet1.xml").count(b"<row>") == 100_002
    book = zipfile.ZipFile(io.BytesIO(exports.workbook(rows.limit(7), sheet_rows=3)))
    assert [book.read(f"xl/worksheets/sheet{i}.xml").count(b"<row>") for i in (1, 2, 3)] == [4, 4, 2] and book.testzip() is None
    assert all(book.read(f).count(b"heet3") for f in ("[Content_Types].xml", "xl/_rels/workbook.xml.rels")) and book.read("xl/workbook.xml").count(b"<sheet ") == 3
    assert zipfile.ZipFile(io.BytesIO(exports.workbook(rows.limit(0)))).read("xl/worksheets/sheet1.xml").count(b"<row>") == 1


def test_zones_judge_copies_once(spark):
    """200 points of one place in 200 copies of a ring: one pair is judged, every point is told the least zone."""
    ring = [(0.0, 0.0), (0.015, 0.0), (0.015, 0.015), (0.0, 0.015)]
    other = [(x + 0.004, y + 0.004) for x, y in ring]
    polygons = spark.createDataFrame([(f"z{i:03}", ring) for i in range(200)] + [("a", other), ("b", other), (None, ring)], "zone string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(i, 0.002, 0.002) for i in range(200)] + [(500, 0.012, 0.012), (501, 5.0, 5.0), (502, None, None), (503, 0.012, 0.012), (503, 0.002, 0.002)], "id int, lat double, lng double")
    got = registry.zoned(points, polygons)
    assert {r.id: r.zone for r in got.collect()} == {i: "z000" for i in range(200)} | {500: "a", 503: "a"}
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    judged = next(i for i, line in enumerate(plan) if "exists" in line or "zip_with" in line)
    assert sum("Aggregate [" in line for line in plan[judged:]) >= 2


WORK = ("ArrowEvalPython", "from_json", "get_json_object", "regexp_", "RLIKE", "lambda")


@pytest.mark.parametrize("name", ["page_listings", "city_of", "app_state", "extraction_ladder", "told_facts", "geocoder_answers", "address_match", "json_nodes", "html_facts"])
def test_pages_are_read_after_rows_are_dealt(spark, name):
    """Below the exchange that deals the narrow rows out, in the few splits of their file, nothing is read."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in plan]
    dealt = [i for i, line in enumerate(plan) if "hashpartitioning(p_partkey" in line and "REPARTITION_BY_NUM" in line]
    below = [line for i in dealt for line in plan[i + 1 : next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))]]
    assert dealt and sum("Scan parquet" in line for line in plan) == len(dealt)
    assert not [line for line in below if any(w in line for w in WORK)]
