"""Folds of arriving rows into keyed tables. ``seq`` is the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _latest(c: str, seq: str) -> Column:
    """The last value that is not null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))


def coalescing_upsert(rows: DataFrame, key: str = "source_url", seq: str = "seq", seen: str | None = "seen_at", defaults: dict | None = None) -> DataFrame:
    """One row a key: every column keeps its last value that is not null; first and last sighting on request.

    Rows without a key (or, where the column exists, without a source) are refused. ``defaults`` fill what stays null,
    as at the first insert.
    """
    rows = rows.where(F.col(key).isNotNull() & (F.col("source").isNotNull() if "source" in rows.columns else F.lit(True)))
    values = [c for c in rows.columns if c not in (key, seq, seen)]
    times = [F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen")] if seen else []
    out = rows.groupBy(key).agg(*(_latest(c, seq).alias(c) for c in values), *times)
    for c, v in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out


def merge_into(old: DataFrame, new: DataFrame, key: str = "source_url") -> DataFrame:
    """An existing keyed table with folded new rows on top: a null never overwrites."""
    n = new.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in new.columns if c != key))
    both = old.join(n, F.col(key) == F.col("_key"), "full_outer")

    def pick(c: str) -> Column:
        if c == key:
            return F.coalesce(key, "_key")
        if c not in new.columns:
            return F.col(c)
        if c == "first_seen":
            return F.coalesce(F.col(c), F.col(f"_new_{c}"))
        return F.coalesce(F.col(f"_new_{c}"), F.col(c))

    return both.select(*(pick(c).alias(c) for c in old.columns))


def replacing_upsert(rows: DataFrame, key: str, seq: str = "seq", fixed: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the last one as a whole, nulls included; ``fixed`` columns keep the first row's value."""
    values = [c for c in rows.columns if c not in (key, seq)]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*values), seq).alias("last"), F.min_by(F.struct(*values), seq).alias("first"))
    return picked.select(key, *(F.col(f"{'first' if c in fixed else 'last'}.{c}").alias(c) for c in values))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """New rows whose key is not there yet, the first of each key."""
    values = [c for c in new.columns if c not in (*keys, seq)]
    once = new.groupBy(*keys).agg(*(F.min_by(F.struct(F.col(c)), seq)[c].alias(c) for c in values))
    return once.join(old.select(*keys), keys, "left_anti")


def accumulating_upsert(rows: DataFrame, key: str, cost: str, kept: list[str], seq: str = "seq") -> DataFrame:
    """One row a key: the first row's ``kept`` columns and the sum of all costs."""
    return rows.groupBy(key).agg(*(F.min_by(F.struct(F.col(c)), seq)[c].alias(c) for c in kept), F.sum(cost).alias(cost))


def last_value(rows: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(F.col(value)), seq)[value].alias(value))


def toggled(events: DataFrame, key: str) -> DataFrame:
    """Keys that are set after an odd number of toggles."""
    return events.groupBy(key).agg((F.count(F.lit(1)) % 2 == 1).alias("saved")).where("saved").select(key)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that comes again are replaced as a whole."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(children: DataFrame, deleted: DataFrame, parent: str) -> DataFrame:
    """Children whose parent is not deleted."""
    return children.join(deleted.select(parent), parent, "left_anti")


def fill_missing(feed: DataFrame, pages: DataFrame, key: str, facts: list[str]) -> DataFrame:
    """Facts of a detail page where the feed has none (null or zero)."""
    p = pages.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_page_{c}") for c in facts))
    joined = feed.join(p, F.col(key) == F.col("_key"), "left")
    numeric = {f.name for f in feed.schema if f.dataType.typeName() in ("integer", "long", "double", "float")}

    def one(c: str) -> Column:
        own = F.nullif(F.col(c), F.lit(0)) if c in numeric else F.nullif(F.col(c), F.lit(""))
        return F.coalesce(own, F.col(f"_page_{c}"))

    return joined.select(*(one(c).alias(c) if c in facts else F.col(c) for c in feed.columns))


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table that only grows: the crawl log, chats, turns. A table that is there must have their columns."""
    spark = rows.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        there = dict(spark.read.parquet(path).dtypes)
        if there != dict(rows.dtypes):
            raise ValueError(f"{path} holds {there}")
    rows.write.mode("append").parquet(path)
