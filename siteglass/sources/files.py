"""Readers of listing files and captured responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rent import feed_rent
from ..functions.steps import settled
from ..functions.text import describe, off_market, slug_address, slug_state, unescape
from ..schema import PROPERTY_TYPES

# Headers of an uploaded file and the fields they fill, a later one over an earlier.
CSV_FIELDS = {
    "address": "address", "neighborhood": "neighborhood", "borough": "borough", "type": "property_type", "property_type": "property_type",
    "size": "size_sf", "size_sf": "size_sf", "sf": "size_sf", "rent": "asking_rent", "asking_rent": "asking_rent", "rent_unit": "rent_unit",
    "lease_type": "lease_type", "price": "sale_price", "sale_price": "sale_price", "lat": "lat", "lng": "lng", "broker": "broker_name",
    "broker_firm": "broker_firm", "phone": "broker_phone", "email": "broker_email", "url": "source_url", "description": "our_description",
}
CSV_NUMBERS = {"size_sf": "bigint", "sale_price": "bigint", "asking_rent": "double", "lat": "double", "lng": "double"}
LISTING_NODES = (
    "realestatelisting product offer place accommodation apartment house residence singlefamilyresidence room suite commercialproperty "
    "landmarksorhistoricalbuildings selfstorage warehouse"
).split()


def _number(c: Column, kind: str) -> Column:
    v = F.regexp_replace(c, "[$,]", "").try_cast("double")
    return v.try_cast(kind) if kind != "double" else v


def csv_fields(rows: DataFrame, metro: str, position: str) -> DataFrame:
    """Rows of text columns as listings: aliases mapped, numbers parsed one by one, rows without an address out.

    A number that cannot be read leaves its own field null. ``position`` is the row's place in its file, which makes
    the key of rows without a URL. A rent without a unit is dropped, as no search could place it.
    """
    given = [(c, CSV_FIELDS[c.strip().lstrip("﻿").lower()]) for c in rows.columns if c.strip().lstrip("﻿").lower() in CSV_FIELDS]
    out: dict[str, list[Column]] = {}
    for c, field in given:
        raw = F.nullif(F.col(f"`{c}`"), F.lit(""))
        out.setdefault(field, []).insert(0, _number(raw, CSV_NUMBERS[field]) if field in CSV_NUMBERS else raw)
    fields = {f: F.coalesce(*cs) if f in out else F.lit(None).cast(CSV_NUMBERS.get(f, "string")) for f in dict.fromkeys(CSV_FIELDS.values()) for cs in [out.get(f, [])]}
    fields["source_url"] = F.coalesce(fields["source_url"], F.concat(F.lit(f"csv://{metro}/"), F.col(position).cast("string"), F.lit("/"), fields["address"]))
    told = fields["rent_unit"].isNotNull()
    fields["asking_rent"] = F.when(told, fields["asking_rent"])
    return rows.select(F.lit(metro).alias("metro"), F.lit("csv").alias("source"), *(c.alias(f) for f, c in fields.items())).where("address is not null")


def read_csv(spark: SparkSession, path: str, metro: str) -> DataFrame:
    """An uploaded CSV file as listings. The rows' places are counted through the whole file.

    A row's place is its place in its split plus the rows of the splits before it; there is one count a split.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    split, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = numbered.groupBy(split.alias("_split")).agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("_split", (F.sum("n").over(Window.orderBy("_split")) - F.col("n")).alias("_ahead"))  # a row a split
    placed = numbered.withColumn("_split", split).join(F.broadcast(ahead), "_split").withColumn("_position", F.col("_ahead") + place)
    return csv_fields(placed.drop("_at", "_split", "_ahead"), metro, "_position")


def _pick(maps: list[Column], keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in keys for m in maps))


def _first_number(c: Column, kind: str = "int") -> Column:
    return F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), "([0-9.]+)", 1).try_cast(kind)


# The names under which feeds give a field, the first that has a value counts.
FEED_KEYS = {
    "kind": ("property_type", "type"), "address": ("address", "property_address", "street_address"), "neighborhood": ("neighborhood", "submarket"),
    "size_sf": ("size", "square_feet", "sf", "total_sf"), "divisible_min_sf": ("divisible_min", "min_sf"), "divisible_max_sf": ("divisible_max", "max_sf"),
    "rent": ("asking_rent", "rent", "price_per_sf"), "broker_name": ("broker", "agent", "contact_name"), "broker_phone": ("phone", "contact_phone"),
    "broker_email": ("email", "contact_email"), "photo": ("featured_image", "image", "thumbnail"),
}
WP_SCHEMA = "id bigint, link string, slug string, title struct<rendered:string>, guid struct<rendered:string>, acf map<string,string>, meta map<string,string>, extra map<string,string>"


def wordpress_listings(items: DataFrame, source: str, firm: str, metro: str) -> DataFrame:
    """Items of a WordPress listing feed (``WP_SCHEMA``) as listings.

    Fields are looked up in the custom fields, then in the item; a title stands in for an address only if it begins
    like one; what is off the market goes.
    """
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.when(F.size(F.coalesce("acf", none)) > 0, F.col("acf")), F.col("meta"), none)
    read = items.select("slug", "title", "link", "guid", own.alias("own"), F.coalesce("extra", none).alias("extra"))
    looked = F.struct(*(_pick([F.col("own"), F.col("extra")], keys).alias(name) for name, keys in FEED_KEYS.items()))
    title = F.trim(unescape(F.regexp_replace(F.coalesce("title.rendered", F.lit("")), "<[^>]+>", "")))
    rows = read.select("slug", title.alias("title"), F.coalesce(F.nullif("link", F.lit("")), F.col("guid.rendered"), F.lit("")).alias("source_url"), F.explode(F.array(looked)).alias("f"))
    kind = F.lower("f.kind")
    address = F.coalesce("f.address", F.when(F.col("title").rlike("^[0-9]+\\s+\\S"), F.col("title")))
    cols = {
        "title": F.col("title"),
        "address": F.trim(unescape(address)),
        "geo_hint": slug_address(F.coalesce("slug", F.lit(""))),
        "geo_state": slug_state(F.coalesce("slug", F.lit(""))),
        "neighborhood": F.trim(unescape("f.neighborhood")),
        "property_type": F.when(kind.isin(*PROPERTY_TYPES), kind),
        **{c: _first_number(F.col(f"f.{c}")) for c in ("size_sf", "divisible_min_sf", "divisible_max_sf")},
        "rent": feed_rent("f.rent", F.lit(metro), kind),
        **{c: F.col(f"f.{c}") for c in ("broker_name", "broker_phone", "broker_email")},
        "photo_urls": F.array_compact(F.array("f.photo")),
        "source_url": F.col("source_url"),
    }
    rows = rows.select("slug", *(c.alias(n) for n, c in cols.items())).where(F.col("address").isNotNull() & ~off_market("title", "slug", "address", "source_url"))
    return _finish(rows.withColumns({"asking_rent": F.col("rent.asking_rent"), "rent_unit": F.col("rent.rent_unit")}).drop("title", "slug", "rent"), source, firm, metro)


def _finish(rows: DataFrame, source: str, firm: str, metro: str) -> DataFrame:
    """Where the rows come from, defaults, and a description of their own facts."""
    rows = rows.withColumns({"source": F.lit(source), "broker_firm": F.lit(firm), "metro": F.lit(metro), "transaction_type": F.coalesce("transaction_type", F.lit("lease")) if "transaction_type" in rows.columns else F.lit("lease")})
    need = {"floor": "string", "total_building_sf": "int", "sale_price": "bigint", "divisible_min_sf": "int", "divisible_max_sf": "int", "asking_rent": "double", "rent_unit": "string", "neighborhood": "string"}
    full = rows.withColumns({c: F.lit(None).cast(t) for c, t in need.items() if c not in rows.columns})
    return full.withColumn("our_description", describe())


def jsonld_listings(pages: DataFrame, source: str, firm: str, metro: str) -> DataFrame:
    """The first real-estate node with a street of each page (url, html) that has one.

    All ld+json blocks count; a block may be a node, a list of nodes, or a graph. A block that is no JSON is passed over.
    """
    blocks = F.regexp_extract_all("html", F.lit("(?is)<script[^>]+type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), 1)
    rows = pages.select("url", F.posexplode(blocks).alias("block", "body"))
    rows = settled(rows, "url", "block", F.try_parse_json("body").alias("v")).where("v is not null")
    text = settled(rows, "url", "block", F.to_json("v").alias("j"), F.expr("schema_of_variant(v)").alias("kind"))
    nodes = F.when(F.col("kind").startswith("ARRAY"), F.from_json("j", "array<string>")).otherwise(F.coalesce(F.from_json(F.get_json_object("j", "$.@graph"), "array<string>"), F.array("j")))
    each = text.select("url", "block", F.posexplode(nodes).alias("at", "node"))

    def path(p: str) -> Column:
        return F.get_json_object("node", p)

    types = F.coalesce(F.from_json(path("$.@type"), "array<string>"), F.array(F.coalesce(path("$.@type"), path("$.type"))))
    street = F.coalesce(path("$.address.streetAddress"), F.when(~F.coalesce(path("$.address"), F.lit("")).startswith("{"), path("$.address")))
    city, size = path("$.address.addressLocality"), path("$.floorSize.value")
    image = F.coalesce(F.from_json(path("$.image"), "array<string>"), F.array_compact(F.array(path("$.image"))))
    found = each.where(F.exists(types, lambda t: F.lower(t).isin(*LISTING_NODES)) & (F.coalesce(street, F.lit("")) != ""))
    rows = found.select(
        "url",
        F.struct(
            "block",
            "at",
            F.trim(unescape(F.concat_ws(", ", street, city))).alias("address"),
            city.alias("neighborhood"),
            F.when(size.rlike("^[0-9]+$"), size.try_cast("int")).alias("size_sf"),
            feed_rent(path("$.offers.price"), F.lit(metro), F.lower(F.coalesce(path("$.@type"), F.lit("")))).alias("rent"),
            image.alias("photo_urls"),
        ).alias("n"),
    )
    best = rows.groupBy("url").agg(F.min_by("n", F.struct("n.block", "n.at")).alias("n")).select(F.col("url").alias("source_url"), "n.address", "n.neighborhood", "n.size_sf", "n.rent.asking_rent", "n.rent.rent_unit", "n.photo_urls", F.lit(None).cast("string").alias("property_type"))
    return _finish(best.where(~off_market("address", "source_url")), source, firm, metro)


def app_state_listings(pages: DataFrame, source: str, firm: str, metro: str, bounds: tuple[int, int] = (100, 2_000_000)) -> DataFrame:
    """Available suites of the building a page (url, html) is about, from the page's embedded state: a row a suite."""
    body = F.regexp_extract("html", '(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    state = F.from_json(F.get_json_object(body, "$.props.pageProps.__APOLLO_STATE__"), "map<string,string>")
    path = F.regexp_replace(F.regexp_replace("url", "^.*?//[^/]+/building", ""), "/+$", "")
    rows = settled(pages, "url", path.alias("path"), state.alias("state")).where("state is not null")
    nodes = F.transform(F.map_values("state"), lambda v: F.from_json(v, "__typename string, slug string, address string, listings array<string>"))
    here = F.filter(nodes, lambda v: (v["__typename"] == "Building") & (F.regexp_replace(F.coalesce(v["slug"], F.lit("")), "/+$", "") == F.col("path")))
    rows = rows.select("url", "state", F.inline(F.slice(here, 1, 1)))
    refs = F.transform("listings", lambda r: F.coalesce(F.get_json_object(r, "$.__ref"), r))
    suites = rows.select("url", "state", "address", F.explode(refs).alias("ref"))
    read = F.from_json(F.try_element_at("state", F.col("ref")), "id string, status string, squareFeet string, estimatedSquareFeet string, floorAndSuite string, details map<string,string>")
    suites = settled(suites, "url", "address", read.alias("s"))
    size = F.coalesce(F.nullif(F.col("s.squareFeet").try_cast("double"), F.lit(0.0)), F.col("s.estimatedSquareFeet").try_cast("double"))
    kind = F.lower(F.try_element_at("s.details", F.lit("Property Type")))
    out = suites.where((F.col("s.status") == "AVAILABLE") & size.between(*bounds) & (F.coalesce("address", F.lit("")) != ""))
    out = out.select(
        F.concat("url", F.lit("#listing-"), F.col("s.id")).alias("source_url"),
        F.trim(unescape("address")).alias("address"),
        size.cast("int").alias("size_sf"),
        F.nullif("s.floorAndSuite", F.lit("")).alias("floor"),
        F.when(kind.isin(*PROPERTY_TYPES), kind).alias("property_type"),
        F.nullif(F.try_element_at("s.details", F.lit("Lease Type")), F.lit("")).alias("lease_type"),
    )
    return _finish(out.where(~off_market("address", "source_url")), source, firm, metro)


def page_listings(pages: DataFrame, source: str, firm: str, metro: str) -> DataFrame:
    """Listings read from the words of pages (url, html): an address and at least one hard fact each."""
    from ..functions.facts import page_facts
    from ..functions.text import city_of, headline, page_text, raw_headline, slug_title

    slug = F.regexp_replace(F.element_at(F.split(F.regexp_replace("url", "/+$", ""), "/"), -1), "[/?#].*$", "")
    words = pages.select("url", page_text("html", unescape).alias("text"), raw_headline("html", unescape).alias("raw"), headline("html").alias("head"), slug_title(slug).alias("slug"))
    read = settled(words, *words.columns)
    address = F.when(F.col("head").rlike("^[0-9]+\\s+\\S"), F.col("head")).when(F.col("slug").rlike("^[0-9]+\\s+\\S"), F.col("slug"))
    rows = read.withColumn("address", F.trim(unescape(address))).where(F.col("address").isNotNull() & ~off_market("raw", "address", "url"))
    rows = rows.withColumns({"f": page_facts("text", F.lit(metro)), "city": city_of("text", "address")})
    rows = settled(rows, "url", "address", "f", "city").where(F.coalesce("f.size_sf", "f.asking_rent", "f.sale_price", "f.total_building_sf").isNotNull())
    out = rows.select(F.col("url").alias("source_url"), "address", F.when(F.col("city").isNotNull(), F.concat_ws(", ", "address", "city.city", "city.state")).alias("geo_hint"), F.lower("city.state").alias("geo_state"), "f.*")
    return _finish(out, source, firm, metro)


LADDER = (app_state_listings, jsonld_listings, page_listings)


def extraction_ladder(pages: DataFrame, source: str, firm: str, metro: str) -> DataFrame:
    """Listings of pages by the first of three readings that yields any: embedded state, ld+json, the page's words.

    Each reading goes over the pages once; of a page's listings those of its first reading stay.
    """
    found = None
    for i, read in enumerate(LADDER):
        got = read(pages, source, firm, metro).withColumns({"rung": F.lit(read.__name__.removesuffix("_listings")), "_rung": F.lit(i)})
        found = got if found is None else found.unionByName(got, allowMissingColumns=True)
    first = F.min("_rung").over(Window.partitionBy(F.regexp_replace("source_url", "#listing-.*$", "")))
    return found.withColumn("_first", first).where("_rung = _first").drop("_rung", "_first")


def sitemap_urls(maps: DataFrame, base: str, scope: str | None = None, limit: int = 12) -> DataFrame:
    """(url, position) of the pages that sitemaps (name, body) list, on the public host, below ``scope``."""
    from ..functions.text import public_url

    locs = F.regexp_extract_all("body", F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), 1)
    rows = maps.select("name", F.contains("body", F.lit("<sitemapindex")).alias("index"), F.posexplode(locs).alias("position", "url")).withColumn("url", public_url("url", F.lit(base)))
    rows = rows.where(~F.col("index") | (F.col("position") < limit))
    return rows if scope is None else rows.where(F.col("index") | F.col("url").startswith(scope))
