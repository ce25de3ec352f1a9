"""Saved listings, portfolios, sessions and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def saved_listings(listings: DataFrame, saved: DataFrame, metro: str | None = None) -> DataFrame:
    """Saved listings, latest first."""
    rows = listings if metro is None else listings.where(F.col("metro") == metro)
    return rows.join(saved.select(F.col("listing_id").alias("id"), "saved_at"), "id").orderBy(F.col("saved_at").desc(), "id")


def portfolio_listings(listings: DataFrame, items: DataFrame, portfolio_id: int) -> DataFrame:
    own = items.where(F.col("portfolio_id") == portfolio_id).select(F.col("listing_id").alias("id"))
    return listings.join(own, "id")


def counted_children(parents: DataFrame, children: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Every parent with its number of children, 0 included; children are counted before they are joined."""
    n = children.groupBy(key).agg(F.count(counted).alias(name))
    return parents.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def last_turns(turns: DataFrame, key: list[str], order: str, n: int = 8) -> DataFrame:
    """The last n turns of each session, in order of time."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return turns.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def not_embedded(listings: DataFrame, vectors: DataFrame) -> DataFrame:
    """Listings without a vector."""
    return listings.join(vectors.select(F.col("listing_id").alias("id")), "id", "left_anti")


def embed(listings: DataFrame, vectors: DataFrame, embedder, batch: int = 64) -> DataFrame:
    """(listing_id, vector) of listings that have none, by ``embedder(list of texts) -> list of vectors``."""
    import math

    import pandas as pd

    from ..functions.text import text_of

    rows = not_embedded(listings, vectors).select("id", text_of("address", "neighborhood", "property_type", "our_description").alias("text"))

    def run(parts):
        for part in parts:
            for lo in range(0, len(part), batch):
                some = part.iloc[lo : lo + batch]
                out = []
                for v in embedder(some["text"].tolist()):
                    norm = math.sqrt(sum(x * x for x in v))
                    out.append([float(x / norm) if norm else float(x) for x in v])
                yield pd.DataFrame({"listing_id": some["id"].to_numpy(), "vector": out})

    return rows.mapInPandas(run, "listing_id bigint, vector array<float>")
