"""Values worked out once, though a plan uses them often."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """``rows`` as a select of ``columns``, each worked out where it stands.

    A plan moves a filter below the columns it looks at, down to the scan, and writes their expressions out at every
    use. Through a generator of one row no filter moves, and what is above reads values.
    """
    return rows.select(F.inline(F.array(F.struct(*columns))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it may use more than once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
