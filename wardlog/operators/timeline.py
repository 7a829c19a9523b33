"""Event-time building blocks that stay balanced when one key holds most of the rows.

Rows are first collapsed to one *slot* per key and second, which a map-side combine does before
any shuffle; a key then has at most 86 400 slots a day however many rows it has. Slots are laid
out in time chunks, so one key is spread over many tasks, and look-back windows see a copy of the
slots just before the chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardlog.session import materialise

DAY = 86400


def chunked(slots: DataFrame, look_back: int, epoch: str = "epoch",
            chunk: str = "_chunk", own: str = "_own", length: int = DAY) -> DataFrame:
    """Add the time chunk, plus a context copy in the next chunk for slots its look-back needs.

    A chunk is at least four look-backs long, so at most about a quarter of the slots is copied.
    """
    length = max(length, 4 * look_back)
    index = F.floor(F.col(epoch) / length)
    copies = F.when(
        F.col(epoch) + look_back >= (index + 1) * length,
        F.array(F.struct(index.alias("c"), F.lit(True).alias("o")),
                F.struct((index + 1).alias("c"), F.lit(False).alias("o")))
    ).otherwise(F.array(F.struct(index.alias("c"), F.lit(True).alias("o"))))
    return (slots.withColumn("_copy", F.explode(copies))
            .withColumn(chunk, F.col("_copy.c")).withColumn(own, F.col("_copy.o"))
            .drop("_copy"))


def trailing(slots: DataFrame, keys: Sequence[str], sums: dict[str, tuple[str, int]],
             epoch: str = "epoch") -> DataFrame:
    """For each slot, sums over `[t - W, t - 1]`; `sums` maps a name to (column, W).

    Each is the difference of two sums from the chunk's start on. A sliding frame would be added up
    anew for every slot, which is work with the square of the slots in a window.
    """
    look_back = max(window for _, window in sums.values())
    base = Window.partitionBy(*keys, "_chunk").orderBy(epoch)

    def upto(column: str, end: int) -> Column:
        frame = base.rangeBetween(Window.unboundedPreceding, end)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    return (chunked(slots, look_back, epoch)
            .withColumns({name: upto(column, -1) - upto(column, -window - 1)
                          for name, (column, window) in sums.items()})
            .where("_own").drop("_own", "_chunk"))


def previous(slots: DataFrame, keys: Sequence[str], window: int, into: str,
             epoch: str = "epoch") -> DataFrame:
    """Time of the slot before, where it lies in `[t - W, t - 1]`, else NULL."""
    before = F.lag(epoch).over(Window.partitionBy(*keys, "_chunk").orderBy(epoch))
    return (chunked(slots, window, epoch).withColumn(into, before)
            .withColumn(into, F.when(F.col(into) >= F.col(epoch) - window, F.col(into)))
            .where("_own").drop("_own", "_chunk"))


def in_even_parts(df: DataFrame, *order: str, part: str = "_part") -> DataFrame:
    """Rows dealt by Spark into ranges of equal size of the given order, with the number of the range.

    The bounds come from a sample of the rows themselves, so they are close together where rows are. Stored, as the
    numbers have to stay what they are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))


def running_totals(slots: DataFrame, keys: Sequence[str], totals: dict[str, Column],
                   order: str = "epoch", chunk: Column | None = None) -> DataFrame:
    """Running sums up to and including each slot, per key, as a two-level prefix sum.

    Chunk totals are summed first (one row per key and chunk), so no task walks a whole key.
    `chunk` has to be a non-decreasing function of `order`; the default is the day.
    """
    chunk = F.floor(F.col(order) / DAY) if chunk is None else chunk
    parts = slots.withColumn("_chunk", chunk)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (parts.groupBy(*keys, "_chunk")
               .agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()])
               .select(*keys, "_chunk",
                       *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0))
                         .alias(f"_off_{name}") for name in totals]))
    if keys:
        joined = parts.join(offsets, [*keys, "_chunk"])
    else:
        joined = parts.join(offsets, "_chunk")
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (joined.withColumns({name: F.sum(value).over(within) + F.col(f"_off_{name}")
                                for name, value in totals.items()})
            .drop("_chunk", *[f"_off_{name}" for name in totals]))
