"""Rents as columns: yearly rent per square foot, the unit of a bare figure, feed prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible bands of a rent per square foot and year, or month.
YEAR_BAND = (5.0, 1000.0)
MONTH_BAND = (0.5, 90.0)
YEARLY_METROS = ("nyc", "mia", "chi")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def yearly_rent(rent, unit, size) -> Column:
    """Rent per square foot and year; null where the unit is unknown, or a gross rent has no size."""
    rent, unit, size = _c(rent), _c(unit), _c(size)
    return F.when(unit == "sf_yr", rent).when(unit == "sf_mo", rent * 12).when((unit == "mo") & (size > 0), rent * 12.0 / size)


def unit_for(value, period, metro, kind) -> Column:
    """Unit of a figure per square foot: the stated period inside its band, else what its size, market or type settles."""
    value, period, metro, kind = _c(value), F.lower(F.coalesce(_c(period), F.lit(""))), F.coalesce(_c(metro), F.lit("")), F.coalesce(_c(kind), F.lit(""))
    (ylo, yhi), (mlo, mhi) = YEAR_BAND, MONTH_BAND
    said_month, said = period.startswith("mo"), period != ""
    by_market = F.when(metro == "la", "sf_mo").when(metro.isin(*YEARLY_METROS), "sf_yr").when(kind.isin("industrial", "flex"), "sf_mo")
    return (
        F.when(value.isNull(), None)
        .when(said_month, F.when(value.between(mlo, mhi), "sf_mo"))
        .when(said, F.when(value.between(ylo, yhi), "sf_yr"))
        .when(value > mhi, F.when(value <= yhi, "sf_yr"))
        .when(value < ylo, F.when(value >= mlo, "sf_mo"))
        .otherwise(by_market)
    )


def feed_rent(price, metro, kind) -> Column:
    """struct(asking_rent, rent_unit) of a feed's price field; null fields where it cannot be told."""
    raw = _c(price).cast("string")
    value = F.regexp_replace(F.regexp_extract(raw, "([0-9][0-9,]*\\.?[0-9]*)", 1), ",", "").try_cast("double")
    month = raw.rlike("(?i)/\\s*sf\\s*/?\\s*mo|per\\s+sf\\s+per\\s+month|/\\s*mo\\b")
    year = raw.rlike("(?i)/\\s*sf\\s*/?\\s*(?:yr|year)|per\\s+sf\\s+per\\s+year|/\\s*yr\\b")
    unit = unit_for(value, F.when(month, "mo").when(year, "yr").otherwise(""), metro, kind)
    return F.struct(F.when(unit.isNotNull(), value).alias("asking_rent"), unit.alias("rent_unit"))
