"""Listing semantics on small tables with nulls, edges and ties."""

import pytest
from pyspark.sql import functions as F

from siteglass.functions import geo, rent, text
from siteglass.functions.facts import Page
from siteglass.operators import ledger, nearby, parse, search, upsert, workspace
from siteglass.operators.relaxation import hard_filter, relaxed_filter
from siteglass.query import ListingQuery, drop_foreign_places, ladder, merge
from siteglass.schema import METROS, airports, metros

COLS = "id long, metro string, status string, property_type string, transaction_type string, address string, neighborhood string, borough string, lat double, lng double, size_sf int, divisible_min_sf int, divisible_max_sf int, asking_rent double, rent_unit string"


@pytest.fixture(scope="module")
def listings(spark):
    def row(i, **kw):
        base = {"id": i, "metro": "mia", "status": "available", "property_type": "retail", "transaction_type": "lease", "address": f"{i} Main St, FL 33127", "neighborhood": "Wynwood", "borough": "Miami", "lat": 25.8, "lng": -80.2, "size_sf": 1500, "divisible_min_sf": None, "divisible_max_sf": None, "asking_rent": 60.0, "rent_unit": "sf_yr"}
        return tuple({**base, **kw}.values())

    rows = [
        row(1),
        row(2, asking_rent=None, rent_unit=None),
        row(3, rent_unit=None),
        row(4, rent_unit="week"),
        row(5, asking_rent=6.0, rent_unit="sf_mo"),
        row(6, asking_rent=9000.0, rent_unit="mo"),
        row(7, asking_rent=9000.0, rent_unit="mo", size_sf=None),
        row(8, size_sf=None),
        row(9, size_sf=None, divisible_min_sf=500, divisible_max_sf=3000),
        row(10, address=None, neighborhood=None),
        row(11, lat=None, lng=None),
        row(12, status="leased"),
        row(13, lat=26.0, lng=-80.0),
        row(14, address="9 Court St, CT 06001"),
        row(15, asking_rent=95.0),
    ]
    return spark.createDataFrame(rows, COLS)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_rent_caps(listings):
    assert ids(hard_filter(listings, ListingQuery(max_rent_per_sf_yr=72.0), "mia")) == [1, 2, 5, 6, 8, 9, 10, 11, 13, 14]
    assert ids(hard_filter(listings, ListingQuery(max_rent_per_sf_yr=71.99), "mia")) == [1, 2, 8, 9, 10, 11, 13, 14]


def test_sizes_use_the_split_and_null_fails(listings):
    assert ids(hard_filter(listings, ListingQuery(min_size_sf=2000))) == [9]
    assert ids(hard_filter(listings, ListingQuery(max_size_sf=1000))) == [9]
    assert 8 not in ids(hard_filter(listings, ListingQuery(min_size_sf=1)))


def test_boxes_are_inclusive_and_all_or_nothing(listings):
    box = ListingQuery(min_lat=25.8, max_lat=26.0, min_lng=-80.2, max_lng=-80.0)
    assert 13 in ids(hard_filter(listings, box)) and 1 in ids(hard_filter(listings, box)) and 11 not in ids(hard_filter(listings, box))
    assert 11 in ids(hard_filter(listings, ListingQuery(min_lat=25.8, max_lat=26.0, min_lng=-80.2)))


def test_excludes_take_null_as_empty(listings):
    got = ids(hard_filter(listings, ListingQuery(exclude_states=("ct",), exclude_cities=("wyn",), exclude_zip3=("331",))))
    assert got == [10]


def test_limit_is_by_id_and_saved_applies_to_every_rung(listings, spark):
    assert ids(hard_filter(listings, ListingQuery(), limit=3)) == [1, 2, 3]
    saved = spark.createDataFrame([(5,), (12,)], "listing_id long")
    out = relaxed_filter(listings, ListingQuery(max_rent_per_sf_yr=1.0, min_size_sf=1400), "mia", saved).collect()
    assert [(r.id, r.near_miss, r.relaxed) for r in out] == [(5, True, "the rent cap")]


def test_ladder_is_cumulative_and_ends(listings):
    q = ListingQuery(max_rent_per_sf_yr=1.0, min_size_sf=2000, max_size_sf=2100, neighborhood="Brickell")
    assert [w for _, w in ladder(q)] == ["", "the rent cap", "the rent cap and the size range", "the rent cap and the size range and the neighborhood"]
    assert [(s.min_size_sf, s.max_size_sf) for s, _ in ladder(q)] == [(2000, 2100), (2000, 2100), (1200, 3360), (1200, 3360)]
    out = relaxed_filter(listings, q, "mia").collect()
    assert out and all(r.rung == 3 and r.near_miss for r in out)
    assert relaxed_filter(listings, ListingQuery(property_types=("land",), min_size_sf=10), "mia").count() == 0
    exact = relaxed_filter(listings, ListingQuery(max_rent_per_sf_yr=100.0, min_size_sf=1400), "mia").collect()
    assert not exact[0].near_miss and exact[0].relaxed == ""


def test_turns_merge_and_foreign_places_go():
    prior = ListingQuery(transaction_type="sale", neighborhood="SoHo", boroughs=("Brooklyn",), max_size_sf=900)
    assert merge(prior, ListingQuery(max_size_sf=1200)).transaction_type == "sale"
    assert merge(prior, ListingQuery(), clear=("max_size_sf",)).max_size_sf == 0
    assert drop_foreign_places(prior, "mia").neighborhood == "" and drop_foreign_places(prior, "nyc") == prior
    box = ListingQuery(min_lat=40.7, max_lat=40.8, min_lng=-74.0, max_lng=-73.9)
    assert not drop_foreign_places(box, "la").has_bbox and drop_foreign_places(box, "nyc").has_bbox


@pytest.mark.parametrize(
    ("value", "period", "metro", "kind", "want"),
    [(2.25, "", "la", "", "sf_mo"), (16.5, "", "mia", "industrial", "sf_yr"), (60.0, "", "", "flex", "sf_mo"), (60.0, "", "", "office", None), (95.0, "", "la", "", "sf_yr"), (3.0, "", "nyc", "", "sf_mo"), (10.0, "mo", "nyc", "", "sf_mo"), (200.0, "month", "", "", None), (4.0, "yr", "", "", None), (0.2, "", "la", "", None), (2000.0, "", "nyc", "", None)],
)
def test_units(spark, value, period, metro, kind, want):
    got = spark.range(1).select(rent.unit_for(F.lit(value), F.lit(period), F.lit(metro), F.lit(kind)).alias("u")).first().u
    assert got == want
    if kind == "":
        assert Page("", metro, kind)._unit(value, period) == want


def test_feed_rents(spark):
    cases = {"$2.25/SF/Mo": (2.25, "sf_mo"), "45": (45.0, "sf_yr"), "6,500,000": (None, None), "call": (None, None), "$1,000.50 per sf per year": (None, None), None: (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "price string")
    got = {r.price: (r.f.asking_rent, r.f.rent_unit) for r in df.select("price", rent.feed_rent("price", F.lit("nyc"), F.lit("")).alias("f")).collect()}
    assert got == cases


PAGES = [
    ("Size: 3,305 SF Rent/SF: $ 60 Monthly Rent: $ 16,525 3,305 SF", "nyc", {"size_sf": 3305, "asking_rent": 60.0, "rent_unit": "sf_yr"}),
    ("540 Rose Avenue For Lease - $10.00/SF/Mo. NNN", "la", {"asking_rent": 10.0, "rent_unit": "sf_mo"}),
    ("asking rents held flat at $78.23/SF in the market", "nyc", {"asking_rent": None, "size_sf": None}),
    ("Filter by size: 1,000 SF 1,999 SF 4,999 SF 9,999 SF", "nyc", {"size_sf": None}),
    ("1450 Brickell is a 35-story, 625,800 RSF Class A office tower. Building Size: 625,800 SF Typical Floor Size: 17,881 SF", "mia", {"total_building_sf": 625800, "size_sf": None, "property_type": "office"}),
    ("Total Square Feet ±9,113 SF Proposed Divisions Retail A: 1,608 SF Retail B: 2,450 SF Retail C: 2,286 SF Retail D: 2,769 SF", "mia", {"total_building_sf": 9113, "size_sf": 2769, "divisible_min_sf": 1608, "divisible_max_sf": 2769}),
    ("Property Total SF: 125,514 Available Unit(s) SF 5,961-9,358", "la", {"size_sf": 9358, "divisible_min_sf": 5961, "total_building_sf": 125514}),
    ("1025 Westwood For Sale – $14,995,000 ($810/SF)", "la", {"sale_price": 14995000, "asking_rent": None, "transaction_type": "sale"}),
    ("For Sale or Lease — $45/SF/yr", "nyc", {"asking_rent": 45.0, "rent_unit": "sf_yr"}),
    ("Triple net charges ±$1.41/SF/Mo.", "la", {"asking_rent": None}),
    ("a rebuilt port, 28 acres of public open space, and more than 275,000 SF of new development", "nyc", {"size_sf": None, "total_building_sf": None}),
    ("For Lease: 25,000 SF industrial building in Vernon", "la", {"size_sf": 25000, "property_type": "industrial"}),
    ("Suite 401. Size: 3,305 SF. Suites Available: Suite 900: 12,000 SF, Suite 1100: 20,600 SF. About 3,305 SF", "nyc", {"size_sf": 3305}),
    ("a 7,000 SF shop. Building Size: 3,500 SF", "mia", {"size_sf": None, "total_building_sf": 3500}),
    ("Monthly Rent: $8,000", "mia", {"asking_rent": 8000.0, "rent_unit": "mo"}),
    ("Asking Rent Upon Request. Asking Price $6,500,000", "nyc", {"sale_price": 6500000}),
]


@pytest.mark.parametrize(("page", "metro", "want"), PAGES)
def test_facts_of_pages(page, metro, want):
    got = Page(page, metro).facts()
    assert {k: got.get(k) for k in want} == want


def test_page_text_and_headlines(spark):
    html = "<html><head><title>Low - Site</title><style>x</style></head><body><nav>Home</nav><h1>5 Oak St | Firm</h1><p>A&nbsp;&amp;&nbsp;B &ndash; 1,500 SF</p><script>var a</script><footer>f</footer></body></html>"
    df = spark.createDataFrame([(html,), (None,), ("<title> T </title>",)], "h string")
    rows = df.select(text.page_text("h", text.unescape).alias("t"), text.headline("h").alias("head"), text.raw_headline("h").alias("raw")).collect()
    assert rows[0].t == "Low - Site 5 Oak St | Firm A & B – 1,500 SF" and rows[0].head == "5 Oak St" and rows[0].raw == "5 Oak St | Firm"
    assert rows[1].t is None and rows[2].head == "T"


def test_addresses(spark):
    cases = [
        ("350 5th Ave, New York, NY", "350 5 AVENUE, MANHATTAN", True),
        ("57 West 38th Street, New York, NY", "57 W 41 ST, NEW YORK", False),
        ("57 West 38th Street", "57 E 38 ST", False),
        ("302 South Drive", "302 S DR", False),
        ("205 hallock rd stony brook ny", "205 DAHILL ROAD, Brooklyn, NY", False),
        ("205 hallock rd stony brook ny", "205 Hallock Road, Stony Brook", True),
        ("Broadway", "280 Broadway", False),
        ("", "x", False),
    ]
    df = spark.createDataFrame(cases, "asked string, got string, want boolean")
    assert [r.ok for r in df.select(text.address_matches("asked", "got").alias("ok")).collect()] == [c[2] for c in cases]
    ranges = {"1160 1170 N Gilbert Street": "1160 N Gilbert Street", "1321 5 Avenue": None, "1170 1160 X": None, "12 Main": None}
    df = spark.createDataFrame([(k,) for k in ranges], "a string")
    assert {r.a: r.c for r in df.select("a", text.collapse_range("a").alias("c")).collect()} == ranges


def test_slugs_and_urls(spark):
    slugs = {"2446-broadway-new-york-ny": ("ny", "2446 broadway new york ny"), "2732-e-15th-st-panama-city-fl-2": ("fl", "2732 e 15th st panama city fl"), "big-deal-ny": ("ny", None), "la": (None, None), "12": (None, None)}
    df = spark.createDataFrame([(k,) for k in slugs], "s string")
    assert {r.s: (r.a, r.b) for r in df.select("s", text.slug_state("s").alias("a"), text.slug_address("s").alias("b")).collect()} == slugs
    urls = {"https://x.com/property/1": True, "https://x.com/articles/space-2": False, "https://x.com/2018/01/space": False, "https://x.com/listing/a.pdf": False, "https://x.com/p?listing=1": True, "https://x.com/": False}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    assert {r.u: r.ok for r in df.select("u", text.is_listing_page("u").alias("ok")).collect()} == urls


def test_match_expression(spark):
    df = spark.createDataFrame([(["Macy's", "co-working", "Macy"],)], "w array<string>")
    assert df.select(text.match_expression("w").alias("e")).first().e == '"Macy" OR "s" OR "co" OR "working"'


def test_decay_and_walk_score_limits(spark):
    got = spark.createDataFrame([(0.0,), (402.0,), (2414.0,), (9999.0,), (1408.0,)], "m double").select(geo.decay("m").alias("d")).collect()
    assert [r.d for r in got[:4]] == [1.0, 1.0, 0.0, 0.0] and abs(got[4].d - 0.5**2.3135) < 1e-9
    assert sum(sum(w) for w in nearby.WEIGHTS.values()) == pytest.approx(15.0)


def test_radius_join_equals_all_pairs(spark):
    import math
    import random

    rng = random.Random(1)
    places = [(i, 40.7 + rng.uniform(-0.1, 0.1), -74 + rng.uniform(-0.1, 0.1)) for i in range(60)] + [(98, None, 1.0)]
    points = [(i, 40.7 + rng.uniform(-0.1, 0.1), -74 + rng.uniform(-0.1, 0.1)) for i in range(200)]

    def dist(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    want = {(a[0], b[0]) for a in places if a[1] for b in points if dist(a, b) <= 2414}
    got = nearby.radius_join(spark.createDataFrame(places, "id long, lat double, lng double"), spark.createDataFrame(points, "id long, lat double, lng double"))
    assert {(r.id, r.p_id) for r in got.collect()} == want and len(want) > 50
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()


def test_walk_and_transit_scores(spark):
    at = (40.75, -73.98)
    base = spark.createDataFrame([(1, *at), (2, 10.0, 10.0), (3, None, None)], "id long, lat double, lng double")
    pois = [(c, f"{c}{i}", *at, []) for c, w in nearby.WEIGHTS.items() for i in range(len(w) + 1)]
    walk = {r.id: r for r in nearby.walk_scores(base, spark.createDataFrame(pois, "category string, name string, lat double, lng double, route_refs array<string>")).collect()}
    assert walk[1].walk_score == 100 and walk[2].walk_score == 0 and 3 not in walk
    assert set(walk[2].score_breakdown) == set(nearby.WEIGHTS) and walk[1].score_breakdown["coffee"]["count"] == 3 and walk[2].score_breakdown["coffee"]["nearest_m"] is None
    stations = spark.createDataFrame([("A", *at, "rail", ["1"]), ("B", *at, "rail", ["1"]), ("C", *at, "ferry", None)], "name string, lat double, lng double, mode string, routes array<string>")
    stops = spark.createDataFrame([("bus_stop", "s", *at, ["M1"]), ("bus_stop", "t", *at, ["M1", "M2"])], "category string, name string, lat double, lng double, route_refs array<string>")
    import math

    got = {r.id: r.transit_score for r in nearby.transit_scores(base, stations, stops).collect()}
    assert got == {1: round(100 * math.log1p(1400 + 300 + 700) / math.log1p(4000)), 2: 0}
    near = nearby.nearest_stations(base, stations).collect()
    assert [(r.name, r.route) for r in sorted(near, key=lambda r: r.rank)] == [("A", "1"), ("B", "1"), ("C", "C")]


def test_markets(spark):
    rows = spark.createDataFrame([(1, 40.75, -73.98, None, "mia"), (2, 30.0, -90.0, None, "nyc"), (3, None, None, "fl", "nyc"), (4, None, None, "tx", "nyc"), (5, None, None, None, "nyc"), (6, 25.8, -80.2, "fl", "nyc")], "id long, lat double, lng double, geo_state string, metro string")
    got = nearby.place(nearby.route_by_state(rows, {k: m["state"] for k, m in METROS.items()}), metros(spark))
    assert {r.id: r.metro for r in got.collect()} == {1: "nyc", 5: "nyc", 6: "mia"}
    mins = nearby.airport_minutes(spark.createDataFrame([(1, "mia", 25.7743, -80.1937)], "id long, metro string, lat double, lng double"), airports(spark)).collect()
    assert {r.airport for r in mins} == {"MIA", "FLL"} and all(5 < r.minutes < 60 for r in mins)


def test_upsert_keeps_what_is_known(spark):
    rows = [("u", 1, "a", 10, None, 1), ("u", 2, None, None, "leased", 2), ("u", 3, "b", None, None, 3), ("v", 1, None, None, None, 4), (None, 1, "x", 1, None, 5)]
    df = spark.createDataFrame(rows, "source_url string, seq int, address string, size_sf int, status string, seen_at int")
    got = {r.source_url: r for r in upsert.coalescing_upsert(df, defaults={"status": "available"}).collect()}
    assert (got["u"].address, got["u"].size_sf, got["u"].status, got["u"].first_seen, got["u"].last_seen) == ("b", 10, "leased", 1, 3)
    assert got["v"].status == "available" and set(got) == {"u", "v"}
    replaced = {r.source_url: r for r in upsert.replacing_upsert(df.drop("seen_at").where("source_url is not null"), "source_url", fixed=("address",)).collect()}
    assert (replaced["u"].address, replaced["u"].size_sf) == ("a", None)


def test_fill_missing_and_merge(spark):
    feed = spark.createDataFrame([(1, 0, None), (2, 5, "x"), (3, None, "")], "id long, size_sf int, floor string")
    pages = spark.createDataFrame([(1, 7, "2"), (2, 9, "3")], "id long, size_sf int, floor string")
    assert {r.id: (r.size_sf, r.floor) for r in upsert.fill_missing(feed, pages, "id", ["size_sf", "floor"]).collect()} == {1: (7, "2"), 2: (5, "x"), 3: (None, None)}
    old = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q")], "source_url string, size_sf int, floor string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3, None)], "source_url string, size_sf int, floor string")
    assert sorted(tuple(r) for r in upsert.merge_into(old, new).collect()) == [("a", 1, "p"), ("b", 2, "z"), ("c", 3, None)]


def test_streaks_budget_and_toggles(spark):
    log = spark.createDataFrame([("d", i, s) for i, s in enumerate([429, 503, 200, 429, 429] + [429] * 8)], "domain string, t int, status int")
    got = [r.streak for r in ledger.failure_streaks(log, F.col("status").isin(429, 503), ["t"]).orderBy("t").collect()]
    assert got == [1, 2, 0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 6]
    calls = spark.createDataFrame([(i, f"k{i % 80}", 1, "2024-05-01") for i in range(200)], "seq int, request_hash string, cost_cents int, day string").withColumn("created_at", F.to_timestamp("day"))
    rows = ledger.admitted(calls, 60).orderBy("seq").collect()
    assert all(r.accepted for r in rows[:60]) and not any(r.accepted for r in rows[60:80]) and all(r.accepted for r in rows[80:])
    assert ids_of(upsert.toggled(spark.createDataFrame([(1,), (2,), (1,), (2,), (2,)], "k int"), "k"), "k") == [2]
    assert ledger.month_spend(calls.limit(0), "2024-05").first().spent == 0


def ids_of(df, c):
    return sorted(r[c] for r in df.collect())


def test_bm25_matches_known_scores(spark):
    docs = spark.createDataFrame([(1, "100 NW 24th St", "Ground floor retail space with loading docks", "Wynwood"), (2, "200 Brickell Ave", "Office tower suite", "Brickell"), (3, "300 NE 2nd Ave", "Retail corner", "Wynwood")], "id long, address string, our_description string, neighborhood string")
    got = {r.id: r.score for r in search.bm25(docs, "id", ["address", "our_description", "neighborhood"], ["Wynwood", "retail"]).collect()}
    assert set(got) == {1, 3} and got[3] < got[1] < 0 and abs(got[3]) < 1e-5
    assert search.bm25(docs, "id", ["our_description"], ["load"]).count() == 1
    assert search.bm25(docs, "id", ["our_description"], []).count() == 0


def test_porter():
    from siteglass.functions.porter import plain, porter

    words = "caresses ponies cats feed agreed plastered motoring sing conflated troubled sized hopping falling failing filing happy sky relational conditional valenci digitizer operator feudalism decisiveness hopefulness formaliti sensitiviti triplicate formative formalize electriciti hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adoption communism activate effective rate cease controll roll loaded loading docks"
    stems = "caress poni cat feed agre plaster motor sing conflat troubl size hop fall fail file happi sky relat condit valenc digit oper feudal decis hope formal sensit triplic form formal electr hope good reviv allow infer airlin adjust defens irrit replac adopt commun activ effect rate ceas control roll load load dock"
    assert [porter(w) for w in words.split()] == stems.split()
    assert plain("café") == "cafe"


def test_fusion(spark):
    ranked = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "id long, rank int")
    got = {r.id: r.score for r in search.rrf([ranked([7, 9, 3]), ranked([9, 3])]).collect()}
    assert max(got, key=got.get) == 9 and got[7] == 1 / 61
    cand = spark.createDataFrame([(3,), (7,), (9,), (11,)], "id long")
    placed = [(r.id, r.semantic_score) for r in search.semantic_scores(cand, search.rrf([ranked([7, 3])])).orderBy("position").collect()]
    assert placed == [(7, 1.0), (3, 0.75), (9, 0.5), (11, 0.25)]
    assert search.semantic_scores(cand.limit(1), None).first().semantic_score == 1.0
    unit = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id long, v array<float>").select("id", search.normalized("v").alias("u")).orderBy("id").collect()
    assert unit[0].u == pytest.approx([0.6, 0.8]) and unit[1].u == [0.0, 0.0]


def test_messages(spark):
    said = [("retail in Wynwood ~1,500 SF under $8k/mo", "mia"), ("industrial for sale", "la"), ("office under 2,000 sf at $30/sf in Brooklyn", "nyc"), (None, "nyc")]
    rows = parse.parse_messages(spark.createDataFrame(said, "message string, metro string")).collect()
    assert (rows[0].property_types, rows[0].min_size_sf, rows[0].max_size_sf, rows[0].max_rent_per_sf_yr) == (["retail"], 1125, 1875, 64.0)
    assert rows[0].keywords[:2] == ["retail", "wynwood"] and rows[0].transaction_type == "lease" and rows[1].transaction_type == "sale"
    assert (rows[2].max_size_sf, rows[2].max_rent_per_sf_yr, rows[2].boroughs) == (2000, 30.0, ["Brooklyn"]) and rows[3].keywords == []
    turns = spark.createDataFrame([("s", 1, "retail for sale", "mia"), ("s", 2, "over 900 sf", "mia"), ("t", 1, "office", "mia")], "session string, turn int, message string, metro string")
    got = {(r.session, r.turn): r for r in parse.merge_turns(parse.parse_messages(turns, unstated=""), "session", "turn").collect()}
    assert got["s", 2].transaction_type == "sale" and got["s", 2].min_size_sf == 900 and got["s", 2].property_types == ["retail"] and got["t", 1].transaction_type == ""


def test_sentences(spark):
    df = spark.createDataFrame([(2769, "retail", None, "Wynwood", 60.0, "sf_yr", None, 1608, 2769, "1 A St", None), (None, None, None, None, 3.2, "sf_mo", None, None, None, "2 B St", 625800), (2100, "office", "3", None, None, None, 6500000, None, None, "3 C St", None)], "size_sf int, property_type string, floor string, neighborhood string, asking_rent double, rent_unit string, sale_price long, divisible_min_sf int, divisible_max_sf int, address string, total_building_sf int")
    assert [r.s for r in df.select(text.describe().alias("s")).collect()] == [
        "2,769 SF retail in Wynwood at 1 A St, divisible 1,608-2,769 SF, asking $60/SF/yr.",
        "Space in a 625,800 SF commercial space at 2 B St, asking $3.20/SF/mo.",
        "2,100 SF office on floor 3 at 3 C St, asking $6,500,000.",
    ]
    assert [r.s for r in df.select(text.rationale(64.0).alias("s")).collect()] == ["2,769 SF retail in Wynwood at $60/SF/yr (under your $64 cap)", "2 B St", "2,100 SF office asking $6,500,000"]


def test_embedding_backfill(spark):
    rows = spark.createDataFrame([(i, f"{i} St", None, "retail", "d") for i in range(5)], "id long, address string, neighborhood string, property_type string, our_description string")
    have = spark.createDataFrame([(0, [1.0])], "listing_id long, vector array<float>")
    got = workspace.embed(rows, have, lambda texts: [[3.0, 4.0] for _ in texts], batch=2).collect()
    assert sorted(r.listing_id for r in got) == [1, 2, 3, 4] and got[0].vector == pytest.approx([0.6, 0.8])


def test_radius_join_near_poles_and_the_date_line(spark):
    import math
    import random

    from siteglass.operators.nearby import radius_join

    rng = random.Random(6)
    spots = [(89.99, 10.0), (89.985, -170.0), (-90.0, 0.0), (76.0, 20.0), (80.3, 179.999), (0.0, 179.995), (10.0, -179.999), (40.0, -74.0), (60.0, 0.0)]
    points = [(min(90.0, max(-90.0, la + rng.uniform(-0.03, 0.03))), (ln + rng.choice([rng.uniform(-0.04, 0.04), rng.uniform(-0.2, 0.2), rng.uniform(-180, 180)]) + 540) % 360 - 180) for la, ln in spots for _ in range(120)]

    def meters(a, b):
        (p, q), (r, s) = (map(math.radians, x) for x in (a, b))
        return 2 * 6_371_000 * math.asin(math.sqrt(min(1, math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2)))

    want = {(i, j) for i, a in enumerate(spots) for j, b in enumerate(points) if meters(a, b) <= 2414}
    places = spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], "id int, lat double, lng double")
    found = spark.createDataFrame([(j, *x) for j, x in enumerate(points)], "point int, lat double, lng double")
    for size in (0.03, 0.01, 0.007):
        rows = radius_join(places, found, size=size).select("id", "point").collect()
        assert len(rows) == len(want) and {(r.id, r.point) for r in rows} == want
    assert len(want) > 150


def test_ranks_in_parts_equal_one_order(spark):
    import random

    from siteglass.operators.search import ranks

    rng = random.Random(8)
    rows = spark.createDataFrame([(i, rng.choice([None, rng.random(), 0.5, -1.0])) for i in range(3000)], "id int, s double")
    for down in (True, False):
        one, many = (sorted(map(tuple, ranks(rows, "s", down, parts).collect())) for parts in (1, 16))
        assert one == many
    assert ranks(rows.where("id < 0"), "s", True, 16).count() == 0


def test_walk_scores_fold_places(spark):
    from siteglass.operators.nearby import walk_scores

    places = spark.createDataFrame([(1, 40.0, -74.0), (2, 40.0, -74.0), (3, None, None), (4, 41.0, -74.0)], "id int, lat double, lng double")
    pois = spark.createDataFrame([("coffee", 40.0, -74.0)] * 3 + [("coffee", 40.01, -74.0), ("grocery", 40.001, -74.0), ("zoo", 40.0, -74.0)], "category string, lat double, lng double")
    got = {r.id: r for r in walk_scores(places, pois).collect()}
    assert set(got) == {1, 2, 4} and got[1].walk_score == got[2].walk_score == round((1.25 + 0.75 + 3) * 6.67) and got[4].walk_score == 0
    assert got[1].score_breakdown["coffee"]["count"] == 4 and got[1].score_breakdown["coffee"]["score"] == 2.0 and got[1].score_breakdown["banks"]["count"] == 0


def test_radius_join_works_distances_out_by_coordinates(spark):
    """Copies of a coordinate meet every point once, a crowd of points included; the last join is dealt, not broadcast."""
    from siteglass.operators.nearby import CROWD, radius_join

    places = spark.createDataFrame([(i, 40.0, -74.0) for i in range(40)] + [(99, 41.0, -74.0), (100, None, -74.0)], "id int, lat double, lng double")
    points = spark.createDataFrame([(f"a{i}", 40.001, -74.0) for i in range(CROWD + 9)] + [("b", 40.01, -74.0), ("b", 40.01, -74.0), ("far", 42.0, -74.0)], "name string, lat double, lng double")
    got = radius_join(places, points, digits=3)
    rows = [tuple(r) for r in got.select("id", "name", "p_lat", "meters").collect()]
    assert len(rows) == 40 * (CROWD + 9 + 2) and len(set(rows)) == 40 * (CROWD + 9 + 1)
    assert {r[1:] for r in rows if r[1] == "b"} == {("b", 40.01, 1111.949)} and {r[0] for r in rows} == set(range(40))
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(lines) if "Join" in line)
    assert "SortMergeJoin" in lines[last] and "_share" in lines[last] and all("ASIN" not in line for line in lines[: last + 1])


def test_semantic_scores_round_ties_as_sql(spark):
    """Of 2,000 and 6,000 places some lie halfway between two thousandths; the database decides on the double."""
    import duckdb

    from siteglass.operators.search import semantic_scores

    for n in (80, 2000, 6000):
        got = semantic_scores(spark.range(n), None, 1 if n == 80 else 8).collect()
        want = duckdb.sql(f"SELECT i, round(1 - i / CAST({n} AS DOUBLE), 3) AS s, round(round(1 - i / CAST({n} AS DOUBLE), 3) * 100, 1) AS t FROM range({n}) r(i)").fetchall()
        assert sorted((r.position, r.semantic_score, r.score) for r in got) == sorted(want)
