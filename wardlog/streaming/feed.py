"""Incremental tail over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

RING = 500


def latest_seq(feed: DataFrame) -> DataFrame:
    return feed.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("latest"))


def ring(feed: DataFrame, size: int = RING) -> DataFrame:
    """What a viewer can still see: the newest `size` events."""
    return feed.orderBy(F.desc("seq")).limit(size)


def snapshot_after(feed: DataFrame, after: int = 0, limit: int = 0, size: int = RING) -> DataFrame:
    """Events past the cursor in order, the newest `limit` of them."""
    fresh = ring(feed, size).where(F.col("seq") > after)
    if limit:
        fresh = fresh.orderBy(F.desc("seq")).limit(limit)
    return fresh.orderBy("seq")
