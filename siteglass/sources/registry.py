"""Public registries, places, parcels and geocoder answers as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import settled
from ..functions.text import address_matches
from ..schema import PARCEL, STATION

# The registry's address, and the tags of each category of place.
STOREFRONTS = "https://data.cityofnewyork.us/resource/92iy-9c3n.json"
CATEGORIES = {
    "grocery": ("shop", ("supermarket", "grocery", "convenience", "greengrocer")),
    "restaurants": ("amenity", ("restaurant", "fast_food")),
    "shopping": ("shop", ("clothes", "department_store", "mall", "hardware", "electronics")),
    "coffee": ("amenity", ("cafe",)),
    "banks": ("amenity", ("bank",)),
    "parks": ("leisure", ("park", "garden")),
    "schools": ("amenity", ("school",)),
    "books": ("amenity", ("library",)),
    "entertainment": ("amenity", ("cinema", "theatre", "nightclub", "pub", "bar")),
}
LINE_COLOURS = ("red", "blue", "g", "brn", "p", "y", "pnk", "o")
ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
OWNER_UNPUBLISHED = "the owner of record is not published in this county's open data"
ZONING_UNPUBLISHED = "zoning is set by the municipality, and no layer of it is at hand"


def _blank(c: str | Column) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def storefronts(rows: DataFrame) -> DataFrame:
    """Registry rows (all text) as retail listings; keyed on the row where it has a key, else on lot and address."""
    row_id = F.col("`:id`") if ":id" in rows.columns else F.lit(None).cast("string")
    street = F.trim(F.concat_ws(" ", F.coalesce("property_number", F.lit("")), F.coalesce("property_street", F.lit(""))))
    address = F.coalesce(_blank("property_street_address_or"), _blank(street))
    by_row = F.concat(F.lit(STOREFRONTS + "?$where=:id='"), row_id, F.lit("'"))
    by_lot = F.concat(F.lit(STOREFRONTS + "?bbl="), F.col("bbl"), F.lit("&address="), F.url_encode(address))
    use = F.coalesce(_blank("primary_business_activity"), F.lit("not stated"))
    text = F.concat(F.lit("Vacant storefront at "), address, F.lit(" from the city's storefront registry (last reported use: "), use, F.lit("). A vacancy lead without a broker, not a listing."))
    return rows.select(
        F.lit("nyc_storefront").alias("source"),
        F.when(_blank(row_id).isNotNull(), by_row).otherwise(by_lot).alias("source_url"),
        F.lit("nyc").alias("metro"),
        F.lit("available").alias("status"),
        address.alias("address"),
        F.nullif(F.initcap("borough"), F.lit("")).alias("borough"),
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lng"),
        F.lit("retail").alias("property_type"),
        F.lit("lease").alias("transaction_type"),
        F.concat(F.lit("nyc:"), F.col("bbl")).alias("parcel_id"),
        text.alias("our_description"),
    ).where("address is not null and parcel_id is not null")


def lot_parts(bbl: str | Column) -> Column:
    """struct(borough, block, lot) of a ten-digit lot number, without leading zeros."""
    b = F.col(bbl) if isinstance(bbl, str) else bbl
    return F.struct(F.substring(b, 1, 1).alias("borough"), F.substring(b, 2, 5).cast("int").cast("string").alias("block"), F.substring(b, 7, 4).cast("int").cast("string").alias("lot"))


def recorded_documents(legals: DataFrame, master: DataFrame, bbl: str, newest: int = 20) -> DataFrame:
    """The newest recorded documents of a lot: legals give the document ids, master the documents."""
    part = lot_parts(F.lit(bbl))
    ids = legals.where((F.col("borough") == part["borough"]) & (F.col("block").cast("int").cast("string") == part["block"]) & (F.col("lot").cast("int").cast("string") == part["lot"])).select("document_id").distinct()
    return master.join(ids, "document_id", "left_semi").orderBy(F.col("recorded_datetime").desc(), "document_id").limit(newest)


def places(elements: DataFrame) -> DataFrame:
    """Map elements (``ELEMENT``) as places: a category by tag, bus stops with their routes; others are dropped."""
    lat, lng = F.coalesce("lat", "center.lat"), F.coalesce("lon", "center.lon")
    kind = F.coalesce(*(F.when(F.try_element_at("tags", F.lit(k)).isin(*vs), c) for c, (k, vs) in CATEGORIES.items()))
    routes = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("tags", F.lit("route_ref")), F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    bus = F.coalesce(F.try_element_at("tags", F.lit("highway")) == "bus_stop", F.lit(False))
    out = elements.select(F.when(bus, "bus_stop").otherwise(kind).alias("category"), F.try_element_at("tags", F.lit("name")).alias("name"), lat.alias("lat"), lng.alias("lng"), F.when(bus, routes).otherwise(F.array().cast("array<string>")).alias("route_refs"))
    return out.where("category is not null and lat is not null and lng is not null")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, failing if it has no rows: an empty answer is a failure, not an empty place."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    checked = n.select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"{what}: no rows"))).otherwise(F.lit(True)).alias("_ok"))
    return df.crossJoin(F.broadcast(checked)).where("_ok").drop("_ok")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """A station bundle; a missing one has no stations."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(STATION).option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], STATION)


def stations_of_feed(rows: DataFrame, key: str, name: str, lat: str, lng: str, routes: Column, mode: str = "rail", seq: str = "seq") -> DataFrame:
    """One station a stop id, the first that comes; rows without id, name or coordinates are dropped."""
    clean = rows.where(_blank(key).isNotNull() & _blank(name).isNotNull() & F.col(lat).isNotNull() & F.col(lng).isNotNull())
    best = clean.withColumn("_routes", routes).groupBy(key).agg(F.min_by(F.struct(F.col(name).alias("name"), F.col(lat).try_cast("double").alias("lat"), F.col(lng).try_cast("double").alias("lng"), F.lit(mode).alias("mode"), F.col("_routes").alias("routes")), seq).alias("s"))
    return best.select("s.*")


def named_lines(text: str | Column, lines: tuple[str, ...]) -> Column:
    """The line names that a text holds as words."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.array(*(F.lit(x) for x in lines)), lambda x: F.regexp_like(t, F.concat(F.lit("(?i)\\b"), x, F.lit("\\b"))))


# ---------------------------------------------------------------- parcels


def _whole(c: str) -> Column:
    """A whole number that may be written as a decimal."""
    return F.col(f"`{c}`").cast("string").try_cast("double").try_cast("int")


def _direct(c: str) -> Column:
    """A number as published, cut to a whole one."""
    return F.col(f"`{c}`").try_cast("double").try_cast("int")


def _parcel(rows: DataFrame, metro: str, key: Column, reasons: dict[str, str], **fields: Column) -> DataFrame:
    """The parcel schema; what is not published is null, with its reason."""
    names = [(f.split()[0], f.split(maxsplit=1)[1]) for f in PARCEL.split(", ")]
    why = F.map_filter(F.create_map(*(x for k, v in reasons.items() for x in (F.lit(k), F.when(fields.get(k, F.lit(None)).isNull(), v)))) if reasons else F.create_map().cast("map<string,string>"), lambda k, v: v.isNotNull())
    made = {"parcel_id": F.concat(F.lit(f"{metro}:"), key), "metro": F.lit(metro), "missing_reason": why} | fields
    return rows.select(*(made.get(n, F.lit(None)).cast(t).alias(n) for n, t in names))


def parcels_nyc(rows: DataFrame) -> DataFrame:
    lot = F.col("bbl").try_cast("double").cast("bigint").cast("string")
    allowed = F.coalesce(F.nullif(F.col("commfar").try_cast("double"), F.lit(0.0)), F.col("residfar").try_cast("double"))
    return _parcel(
        rows, "nyc", lot, {}, owner_name=_blank("ownername"), zoning=_blank("zonedist1"), far_built=F.col("builtfar").try_cast("double"), far_allowed=allowed,
        year_built=_whole("yearbuilt"), lot_sqft=_whole("lotarea"), bldg_sqft=_whole("bldgarea"), floors=_whole("numfloors"), units=_whole("unitstotal"), use_code=_blank("landuse"),
    )


def parcels_la(rows: DataFrame) -> DataFrame:
    return _parcel(
        rows, "la", F.col("AIN").cast("string"), {"owner_name": OWNER_UNPUBLISHED, "zoning": ZONING_UNPUBLISHED}, owner_name=F.lit(None).cast("string"), zoning=F.lit(None).cast("string"),
        year_built=_direct("YearBuilt1"), lot_sqft=_direct("Shape.STArea()"), bldg_sqft=_direct("SQFTmain1"), units=_direct("Units1"), use_code=F.coalesce(_blank("UseType"), _blank("UseDescription")),
    )


def parcels_chicago(rows: DataFrame, zoning: str | None = None) -> DataFrame:
    """``zoning`` names a column where the city's layer has an answer."""
    z = F.col(zoning) if zoning else F.lit(None).cast("string")
    return _parcel(
        rows, "chi", F.col("pin"), {"zoning": ZONING_UNPUBLISHED}, owner_name=F.coalesce(_blank("owner_address_name"), _blank("mail_address_name")) if "mail_address_name" in rows.columns else _blank("owner_address_name"), zoning=z,
        year_built=_whole("char_yrblt"), lot_sqft=_whole("char_land_sf"), bldg_sqft=_whole("char_bldg_sf"), floors=F.nullif(F.regexp_extract("char_type_resd", "^([0-9]+)", 1), F.lit("")).try_cast("int"), use_code=_blank("class"),
    )


def parcels_miami(rows: DataFrame, zoning: str | None = None) -> DataFrame:
    z = F.col(zoning) if zoning else F.lit(None).cast("string")
    return _parcel(
        rows, "mia", F.col("FOLIO").cast("string"), {"zoning": ZONING_UNPUBLISHED}, owner_name=_blank("TRUE_OWNER1"), zoning=z,
        year_built=_direct("YEAR_BUILT"), lot_sqft=_direct("LOT_SIZE"), bldg_sqft=_direct("BUILDING_ACTUAL_AREA"), floors=_direct("FLOOR_COUNT"), units=_direct("UNIT_COUNT"), use_code=_blank("DOR_DESC"),
    )


def latest_characteristics(addresses: DataFrame, characteristics: DataFrame, key: str = "pin", year: str = "tax_year") -> DataFrame:
    """Address rows with the latest year's characteristics, whose columns win where both have one."""
    values = [c for c in characteristics.columns if c not in (key, year)]
    latest = characteristics.groupBy(key).agg(F.max_by(F.struct(*values), year).alias("c"))
    joined = addresses.join(latest, key, "left")
    own = [c for c in addresses.columns if c != key]
    return joined.select(key, *(F.coalesce(F.col(f"c.{c}"), F.col(c)).alias(c) if c in values else F.col(c) for c in own), *(F.col(f"c.{c}").alias(c) for c in values if c not in own))


def zoned(points: DataFrame, polygons: DataFrame, key: str = "id", size: float = 0.01) -> DataFrame:
    """(key, zone) of points in polygons (zone, ring of struct(x, y)): met by tile, decided by edge crossings.

    Points are folded by coordinates and polygons by ring first, so copies of either are judged once.
    """
    from ..functions.geo import inside, tile

    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    rings = polygons.groupBy("ring").agg(F.min("zone").alias("zone"))
    boxes = rings.withColumns({"tx": F.explode(F.sequence(tile(F.array_min(xs), size), tile(F.array_max(xs), size)))}).withColumn("ty", F.explode(F.sequence(tile(F.array_min(ys), size), tile(F.array_max(ys), size))))
    at = points.select("lat", "lng").distinct().withColumns({"tx": tile("lng", size), "ty": tile("lat", size)})
    spots = at.join(boxes, ["tx", "ty"]).where(inside("lng", "lat", "ring")).groupBy("lat", "lng").agg(F.min("zone").alias("zone"))
    return points.select(key, "lat", "lng").join(spots, ["lat", "lng"]).groupBy(key).agg(F.min("zone").alias("zone"))


def accepted_answers(answers: DataFrame, asked: str = "asked", got: str = "label") -> DataFrame:
    """Geocoder answers that name the address asked for; the best ranked of each."""
    ok = settled(answers, *answers.columns, address_matches(asked, got).alias("_ok")).where("_ok").drop("_ok")
    values = [c for c in answers.columns if c != asked]
    return ok.groupBy(asked).agg(F.min_by(F.struct(*values), F.col("rank")).alias("a")).select(asked, "a.*")


def routed_minutes(tables: DataFrame) -> DataFrame:
    """(id, airport, minutes) of routed tables (id, airports, durations in seconds, the first of them to itself)."""
    rows = tables.select("id", F.explode(F.arrays_zip(F.col("airports").alias("airport"), F.slice(F.col("durations"), F.lit(2), F.size("durations")).alias("seconds"))).alias("x"))
    return rows.where("x.seconds is not null and x.airport is not null").select("id", "x.airport", F.round(F.col("x.seconds") / 60, 1).alias("minutes"))


def seed(spark: SparkSession) -> DataFrame:
    """A dozen demonstration listings, three in each market."""
    from ..schema import METROS

    rows = []
    for i, (metro, m) in enumerate(METROS.items()):
        lat, lng = m["center"]
        hood = m["boroughs"][0]
        rows += [
            (f"seed://{metro}/1", metro, f"{100 + i} Main Street", hood, "retail", "lease", 1500, 60.0, "sf_yr", None, lat, lng),
            (f"seed://{metro}/2", metro, f"{200 + i} Market Street", hood, "office", "lease", 4200, 3.5, "sf_mo", None, lat + 0.01, lng),
            (f"seed://{metro}/3", metro, f"{300 + i} Dock Road", hood, "industrial", "sale" if i == 0 else "lease", 25000, None, None, 6_500_000 if i == 0 else None, lat, lng + 0.01),
        ]
    return spark.createDataFrame(rows, "source_url string, metro string, address string, neighborhood string, property_type string, transaction_type string, size_sf int, asking_rent double, rent_unit string, sale_price bigint, lat double, lng double").withColumns({"source": F.lit("seed"), "status": F.lit("available")})
