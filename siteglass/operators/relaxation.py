"""Hard filter with a relaxation ladder, in one pass over the listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..query import ListingQuery, ladder, matches

LIMIT = 200


def hard_filter(listings: DataFrame, q: ListingQuery, metro: str | None = None, saved: DataFrame | None = None, limit: int | None = LIMIT) -> DataFrame:
    """Listings that meet every constraint, the first ``limit`` by id (None: all)."""
    out = listings.where(matches(q, metro))
    if saved is not None:
        out = out.join(saved.select(F.col(saved.columns[0]).alias("id")), "id", "left_semi")
    return out if limit is None else out.orderBy("id").limit(limit)


def relaxed_filter(listings: DataFrame, q: ListingQuery, metro: str | None = None, saved: DataFrame | None = None, limit: int | None = LIMIT) -> DataFrame:
    """As :func:`hard_filter`, easing constraints in the disclosed order until something matches.

    Every listing is tagged with the first rung it qualifies for, and the lowest rung that has any listing wins; so
    one scan decides, whatever the number of rungs. Adds rung, near_miss and relaxed.
    """
    rungs = ladder(q)
    rung = F.coalesce(*(F.when(matches(step, metro), i) for i, (step, _) in enumerate(rungs)))
    tagged = listings.withColumn("rung", rung).where("rung is not null")
    if saved is not None:
        tagged = tagged.join(saved.select(F.col(saved.columns[0]).alias("id")), "id", "left_semi")
    best = tagged.agg(F.min("rung").alias("best"))
    words = F.element_at(F.array(*(F.lit(w) for _, w in rungs)), F.col("rung") + 1)
    out = tagged.join(F.broadcast(best), F.col("rung") == F.col("best"), "left_semi").withColumns({"near_miss": F.col("rung") > 0, "relaxed": words})
    return out if limit is None else out.orderBy("id").limit(limit)
