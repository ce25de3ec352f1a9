"""Logs and ledgers: spending, caps, freshness, back-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain

STREAK_CAP = 6


def month_spend(ledger: DataFrame, month: str) -> DataFrame:
    """Cents spent in a month (yyyy-MM): one row, 0 where nothing was."""
    return ledger.where(F.date_format("created_at", "yyyy-MM") == month).agg(F.coalesce(F.sum("cost_cents"), F.lit(0)).cast("bigint").alias("spent"))


def budget_left(ledger: DataFrame, month: str, cap: int) -> DataFrame:
    return month_spend(ledger, month).select("spent", F.greatest(F.lit(0).cast("bigint"), F.lit(cap) - F.col("spent")).alias("remaining"))


def admitted(calls: DataFrame, cap: int, key: str = "request_hash", seq: str = "seq", cost: str = "cost_cents") -> DataFrame:
    """Which calls of a month pass the budget, in order: a repeated request is free and never refused.

    Costs accumulate per month by day and then ``seq``. The running total of a month is that of its days before (a few
    rows) and that within the day, so no task holds more than a day.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    told = calls.withColumns({"month": F.date_format("created_at", "yyyy-MM"), "_day": F.to_date("created_at"), "hit": ~first})
    paid = F.when(~F.col("hit"), F.col(cost)).otherwise(0)
    days = told.groupBy("month", "_day").agg(F.sum(paid).alias("_sum"))
    ahead = days.select("month", "_day", F.coalesce(F.sum("_sum").over(Window.partitionBy("month").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    spent = F.col("_ahead") + F.sum(paid).over(Window.partitionBy("month", "_day").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return told.join(ahead, ["month", "_day"]).withColumn("accepted", F.col("hit") | (spent <= cap)).drop("_day", "_ahead")


def fetched_today(log: DataFrame, day: str) -> DataFrame:
    """Fetches by domain on a day."""
    return log.where(F.to_date("fetched_at") == F.lit(day).cast("date")).groupBy("domain").agg(F.count(F.lit(1)).alias("fetched"))


def fresh_urls(log: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """URLs fetched within the last hours."""
    return log.where(F.col("fetched_at") > now - F.expr(f"INTERVAL {hours} HOURS")).select("url").distinct()


def validators(log: DataFrame) -> DataFrame:
    """The latest validator (etag, last_modified) of every URL that ever had one."""
    return log.where("etag is not null or last_modified is not null").groupBy("url").agg(F.max_by(F.struct("etag", "last_modified"), "fetched_at").alias("v")).select("url", "v.etag", "v.last_modified")


def failure_streaks(log: DataFrame, failed: Column, order: list, key: str = "domain", cap: int = STREAK_CAP) -> DataFrame:
    """Consecutive failures up to each row, reset by a success, capped."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = log.withColumn("_fail", failed)
    island = F.sum(F.when(F.col("_fail"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_island", island)
    run = F.sum(F.col("_fail").cast("int")).over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("streak", F.least(run, F.lit(cap)).cast("int")).drop("_fail", "_island")


def delay_seconds(own: float, site, streak) -> Column:
    """The longer of our delay and the site's, doubled by every failure in a row."""
    base = F.greatest(F.lit(own), F.coalesce(F.col(site) if isinstance(site, str) else site, F.lit(0.0)))
    return base * F.pow(F.lit(2.0), F.col(streak) if isinstance(streak, str) else streak)


def request_hash(*columns: str) -> Column:
    """Digest of a request's fields, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256)


def crawl_stats(rows: DataFrame) -> DataFrame:
    """By source: rows fetched, saved, without a pin, and in error, from flags of the same names."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), *(F.count_if(F.col(c)).alias(c) for c in ("saved", "no_pin", "error")))


def listed_only(urls: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """URLs on a host that a listed source names; others are never fetched. ``sources``: one row a source, with its url."""
    hosts = sources.select(domain(F.col("url")).alias("_host")).where("_host <> ''").distinct()
    return urls.withColumn("_host", domain(F.col(url))).join(hosts, "_host", "left_semi").drop("_host")
