"""What a search asks for: predicates, merging of turns, the relaxation stages."""

from __future__ import annotations

import functools
import operator
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions.rent import yearly_rent
from .schema import METROS


@dataclass(frozen=True)
class ListingQuery:
    """Empty, zero or no value means unconstrained."""

    property_types: tuple[str, ...] = ()
    transaction_type: str = ""
    min_size_sf: int = 0
    max_size_sf: int = 0
    max_rent_per_sf_yr: float = 0.0
    min_lat: float = 0.0
    max_lat: float = 0.0
    min_lng: float = 0.0
    max_lng: float = 0.0
    boroughs: tuple[str, ...] = ()
    neighborhood: str = ""
    exclude_states: tuple[str, ...] = ()
    exclude_cities: tuple[str, ...] = ()
    exclude_zip3: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()

    @property
    def has_bbox(self) -> bool:
        return all((self.min_lat, self.max_lat, self.min_lng, self.max_lng))


def rent_ok(cap: float) -> Column:
    """A listing without a rent passes any cap; a rent of unknown unit passes none."""
    return F.col("asking_rent").isNull() | (yearly_rent("asking_rent", "rent_unit", "size_sf") <= cap)


def size_ok(low: int = 0, high: int = 0) -> list[Column]:
    """The largest split must reach ``low``, the smallest must not exceed ``high``; no size fails either."""
    out = []
    if low:
        out.append(F.coalesce("divisible_max_sf", "size_sf") >= low)
    if high:
        out.append(F.coalesce("divisible_min_sf", "size_sf") <= high)
    return out


def _lacks(column: str, pattern: str) -> Column:
    return ~F.coalesce(F.col(column), F.lit("")).ilike(pattern)


def place_ok(q: ListingQuery) -> list[Column]:
    out = []
    if q.boroughs:
        out.append(F.col("borough").isin(*q.boroughs))
    if q.neighborhood:
        out.append(F.col("neighborhood").ilike(f"%{q.neighborhood}%"))
    return out


def predicates(q: ListingQuery, metro: str | None = None, rent: bool = True, size: bool = True, place: bool = True) -> list[Column]:
    """The conjunction a query stands for; the flags leave the soft constraints out."""
    out = [F.col("status") == "available"]
    if metro:
        out.insert(0, F.col("metro") == metro)
    if q.property_types:
        out.append(F.col("property_type").isin(*q.property_types))
    if q.transaction_type:
        out.append(F.col("transaction_type") == q.transaction_type)
    if q.has_bbox:
        out += [F.col("lat").between(q.min_lat, q.max_lat), F.col("lng").between(q.min_lng, q.max_lng)]
    out += [_lacks("address", f"%{s}%") for s in q.exclude_states]
    out += [_lacks("neighborhood", f"%{s}%") for s in q.exclude_cities]
    out += [_lacks("address", f"% {z}%") for z in q.exclude_zip3]
    if size:
        out += size_ok(q.min_size_sf, q.max_size_sf)
    if rent and q.max_rent_per_sf_yr:
        out.append(rent_ok(q.max_rent_per_sf_yr))
    if place:
        out += place_ok(q)
    return out


def matches(q: ListingQuery, metro: str | None = None, **parts: bool) -> Column:
    return functools.reduce(operator.and_, predicates(q, metro, **parts))


def merge(prior: ListingQuery, new: ListingQuery, clear: tuple[str, ...] = ()) -> ListingQuery:
    """A later turn's stated fields win; ``clear`` names fields to drop although nothing replaces them."""
    base = replace(prior, **{f: type(getattr(prior, f))() for f in clear})
    return replace(base, **{k: getattr(new, k) for k, v in asdict(new).items() if v})


def drop_foreign_places(q: ListingQuery, metro: str) -> ListingQuery:
    """Forget a box or boroughs that belong to another market."""
    lat0, lng0, lat1, lng1 = METROS[metro]["bbox"]
    far = q.has_bbox and not (lat0 <= q.min_lat and q.max_lat <= lat1 and lat0 <= q.max_lat and q.min_lat <= lat1 and lng0 <= q.min_lng <= lng1 and lng0 <= q.max_lng <= lng1)
    strange = bool(q.boroughs) and not set(q.boroughs) & set(METROS[metro]["boroughs"])
    if far or strange:
        return replace(q, min_lat=0.0, max_lat=0.0, min_lng=0.0, max_lng=0.0, boroughs=(), neighborhood="")
    return q


# The constraints a search eases in turn, how each is disclosed, and what its fields are multiplied by
# (zero empties a field of any kind).
STAGES = (("rent", "the rent cap"), ("size", "the size range"), ("neighborhood", "the neighborhood"))
EASING = {"rent": {"max_rent_per_sf_yr": 0}, "size": {"min_size_sf": 0.6, "max_size_sf": 1.6}, "neighborhood": {"neighborhood": 0, "boroughs": 0}}


def relaxed(q: ListingQuery, stage: str) -> ListingQuery | None:
    """``q`` with the fields of one stage eased, or None where none of them says anything."""
    held = {field: getattr(q, field) for field in EASING[stage]}
    return replace(q, **{f: type(v)(v * EASING[stage][f]) for f, v in held.items()}) if any(held.values()) else None


def ladder(q: ListingQuery) -> list[tuple[ListingQuery, str]]:
    """The query and its cumulative relaxations, each with the words that disclose it."""
    out, said = [(q, "")], []
    for stage, words in STAGES:
        eased = relaxed(out[-1][0], stage)
        if eased is not None:
            said.append(words)
            out.append((eased, " and ".join(said)))
    return out
