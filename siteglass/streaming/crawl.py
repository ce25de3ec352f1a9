"""Streaming forms of crawl bookkeeping: fresh URLs, daily caps, failure streaks, upserts.

These are additions: the batch operators define the semantics, and a stream over the same rows agrees with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.ledger import STREAK_CAP
from ..operators.upsert import coalescing_upsert, merge_into


def first_fetches(log: DataFrame, hours: int = 24) -> DataFrame:
    """The first fetch of each URL within any ``hours``; late duplicates inside the watermark are dropped too."""
    return log.withWatermark("fetched_at", f"{hours} hours").dropDuplicatesWithinWatermark(["url"])


def daily_counts(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Fetches by domain and day, final once the watermark has passed the day."""
    return log.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 day"), "domain").agg(F.count(F.lit(1)).alias("fetched")).select(F.col("window.start").alias("day"), "domain", "fetched")


def streaks(log: DataFrame) -> DataFrame:
    """Consecutive refusals (429, 503) by domain after each batch: state is one number a domain."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).sort_values("fetched_at")
        for status in rows["status"]:
            streak = min(streak + 1, STREAK_CAP) if status in (429, 503) else 0
        state.update((streak,))
        yield pd.DataFrame({"domain": [key[0]], "streak": [streak]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return log.select("domain", "fetched_at", "status").groupBy("domain").applyInPandasWithState(update, "domain string, streak int", "streak int", "update", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, key: str = "source_url", seq: str = "seq", seen: str = "seen_at"):
    """A ``foreachBatch`` function that folds every batch into the Parquet table at ``path``.

    Each version is written beside the last one and then named in ``_current``; a batch that is replayed folds to the
    same table, as a null never overwrites and an equal value changes nothing.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = coalescing_upsert(batch, key, seq, seen)
        versions = spark.read.text(f"{path}/_current").collect() if _exists(spark, f"{path}/_current") else []
        out = merge_into(spark.read.parquet(versions[0].value), new, key) if versions else new
        target = f"{path}/version-{epoch}"
        out.write.mode("overwrite").parquet(target)
        spark.createDataFrame([(target,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_current")

    return fold


def run_available(out: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has arrived, and the rows it gave, with the batch (``epoch``) that gave them.

    Each batch has a folder of its own, so one that is replayed after a lost driver replaces itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    run_batches(out, folder, write, mode)
    return out.sparkSession.read.schema(StructType([*out.schema, StructField("epoch", IntegerType())])).parquet(f"{folder}/rows")


def run_batches(out: DataFrame, folder: str, fold, mode: str = "append") -> None:
    """Hand all that has arrived since the last run to a ``foreachBatch`` function."""
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(fold).trigger(availableNow=True).start().awaitTermination()


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
