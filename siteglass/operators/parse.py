"""Searches in plain words, read by rules: columns over a table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..schema import METROS, PROPERTY_TYPES

# How messages state areas and rents, and how many keywords count.
AREA = "\\s*([0-9,]+)\\s*(?:sf|sq|square)"
AT_MOST, AT_LEAST = "(?:under|below|less than|max|up to)" + AREA, "(?:over|above|at least|min|minimum)" + AREA
ABOUT = "([0-9,]{3,})\\s*(?:sf|sq ?ft|square feet)"
MONTHLY, PER_AREA = "\\$\\s*([0-9,.]+)\\s*(k)?\\s*(?:/|per |a )\\s*mo", "\\$\\s*([0-9,.]+)\\s*(?:/|per )\\s*(?:sf|psf)"
BUYING = ("for sale", "buy", "purchase")
WORD = "([a-z][a-z-]{2,})"
KEYWORDS = 8
NOTHING = "Nothing matches those constraints in this market yet. Try widening the size range or the rent cap."
FIELDS = ("property_types", "transaction_type", "min_size_sf", "max_size_sf", "max_rent_per_sf_yr", "boroughs", "neighborhood", "keywords")


def _figure(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(F.regexp_extract(text, pattern, group), ",", "").try_cast("double")


def parse_messages(messages: DataFrame, message: str = "message", metro: str = "metro", unstated: str = "lease") -> DataFrame:
    """Adds the fields of a query; zero, '' and empty arrays stand for what is not stated.

    ``unstated`` is the transaction type of a message that names none ('' on later turns, so an earlier one holds).
    """
    q = F.lower(F.coalesce(message, F.lit("")))
    high, low, about = (_figure(q, p).cast("bigint") for p in (AT_MOST, AT_LEAST, ABOUT))
    loose = F.coalesce(high, F.lit(0)) + F.coalesce(low, F.lit(0)) == 0
    size = F.coalesce(F.nullif(high, F.lit(0)), F.nullif(low, F.lit(0)), F.when(loose, about), F.lit(0))
    gross = _figure(q, MONTHLY) * F.when(F.regexp_extract(q, MONTHLY, 2) == "k", 1000).otherwise(1)
    cap = F.when(q.rlike(MONTHLY), F.when(size > 0, F.round(gross * 12 / size, 2))).otherwise(_figure(q, PER_AREA))
    kinds = F.filter(F.array(*(F.lit(t) for t in PROPERTY_TYPES)), lambda t: F.contains(q, t))
    first = F.coalesce(*(F.when((F.col(metro) == m) & F.contains(q, F.lit(b.lower())), b) for m, spec in METROS.items() for b in spec["boroughs"]))
    words = F.filter(F.regexp_extract_all(q, F.lit(WORD), 1), lambda w: ~w.isin(*STOP_WORDS))
    return messages.withColumns(
        {
            "property_types": kinds,
            "transaction_type": F.when(q.rlike("|".join(BUYING)), "sale").otherwise(unstated),
            "min_size_sf": F.coalesce(F.when(loose, F.floor(about * 0.75)).otherwise(low), F.lit(0)).cast("bigint"),
            "max_size_sf": F.coalesce(F.when(loose, F.floor(about * 1.25)).otherwise(high), F.lit(0)).cast("bigint"),
            "max_rent_per_sf_yr": F.coalesce(cap, F.lit(0.0)),
            "boroughs": F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")),
            "neighborhood": F.lit(""),
            "keywords": F.slice(words, 1, KEYWORDS),
        }
    )


def _stated(c: str, kind: str) -> Column:
    return F.size(c) > 0 if kind == "array" else F.col(c) != (F.lit("") if kind == "string" else F.lit(0))


def merge_turns(turns: DataFrame, session: str, order: str) -> DataFrame:
    """Each turn with the fields in force: the last stated value of every field in its session so far."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {f.name: f.dataType.typeName() for f in turns.schema}
    empty = {"array": F.array().cast("array<string>"), "string": F.lit("")}
    return turns.withColumns({c: F.coalesce(F.last(F.when(_stated(c, kinds[c]), F.col(c)), ignorenulls=True).over(w), empty.get(kinds[c], F.lit(0))) for c in FIELDS})


def reply(results: int | Column, near_miss: Column, relaxed: Column, address: Column, rationale: Column) -> Column:
    """The deterministic answer above a list of results, an empty one too."""
    n = results if isinstance(results, Column) else F.lit(results)
    lead = F.when(near_miss & (relaxed != ""), F.concat(F.lit("Nothing matched exactly — I relaxed "), relaxed, F.lit(". "))).when(near_miss, "Nothing matched exactly, so here are the closest misses. ").otherwise("")
    found = F.concat(lead, n.cast("string"), F.when(n != 1, " matches. ").otherwise(" match. "), F.lit("The closest is "), address, F.lit(" — "), rationale, F.lit("."))
    return F.when(n == 0, NOTHING).otherwise(found)


def guard_places(queries: DataFrame, metro: str = "metro") -> DataFrame:
    """Queries without a box or boroughs that belong to another market than theirs.

    A box counts once all four sides are set. A market that is not known has no box to leave and no boroughs to share.
    """
    boxes = F.create_map(*(x for m, spec in METROS.items() for x in (F.lit(m), F.array(*map(F.lit, spec["bbox"])))))
    names = F.create_map(*(x for m, spec in METROS.items() for x in (F.lit(m), F.array(*map(F.lit, spec["boroughs"])))))
    box, known = F.try_element_at(boxes, F.col(metro)), F.coalesce(F.try_element_at(names, F.col(metro)), F.array().cast("array<string>"))
    sides = ("min_lat", "min_lng", "max_lat", "max_lng")
    inside = F.col("min_lat").between(box[0], box[2]) & F.col("max_lat").between(box[0], box[2]) & F.col("min_lng").between(box[1], box[3]) & F.col("max_lng").between(box[1], box[3])
    boxed = F.col("min_lat") * F.col("min_lng") * F.col("max_lat") * F.col("max_lng") != 0
    foreign = F.coalesce(boxed & ~inside, F.lit(False)) | F.coalesce((F.size("boroughs") > 0) & ~F.arrays_overlap("boroughs", known), F.lit(False))
    empty = {**{c: F.lit(0.0) for c in sides}, "boroughs": F.array().cast("array<string>"), "neighborhood": F.lit("")}
    return queries.withColumn("_foreign", foreign).withColumns({c: F.when(F.col("_foreign"), v).otherwise(F.col(c)) for c, v in empty.items()}).drop("_foreign")
