"""Ordered sequences: at least N preconditions within W before a trigger; a hit resets.

With `a` the running number of preconditions and `live` those of the last W seconds, a trigger can
only fire when `live >= N`, and fires when it is also N preconditions past the last one that fired.
Those able to fire are thus a sorted list of distinct `a`, from which the hits are the greedy
selection with distance N. The selection depends on what came before only through the last chosen
value, which takes N forms at a block's origin (1 to N-1 below it, or N and more). So each block of
values is reduced to a table of N exits, tables of FAN blocks are composed to one, and entries are
handed down again. The selection itself walks sorted rows and keeps one value, so no task holds more
than a block of values or FAN tables of a source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardlog.session import materialise

BLOCK = 16384
FAN = 4096


def _exits(values: np.ndarray, origin: int, distance: int) -> np.ndarray:
    """Last chosen value of a block, by how far below its origin the one chosen before lies."""
    entries = origin - np.arange(1, distance + 1)
    after = np.append(np.searchsorted(values, values + distance), len(values))
    final = np.append(values, 0)
    for i in range(len(values) - 1, -1, -1):
        if after[i] < len(values):
            final[i] = final[after[i]]
    first = np.searchsorted(values, entries + distance)
    return np.where(first < len(values), final[first], entries)


def _through(state: np.ndarray, origin: int, exits: np.ndarray, distance: int) -> np.ndarray:
    return exits[np.minimum(origin - state, distance) - 1]


def select_apart(points: DataFrame, distance: int, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Greedy selection per `_g` of distinct integers `a` that are `distance` apart.

    Returns (_g, a, last) where `last` is the value chosen before, NULL for the first.
    """
    block = max(block, distance)
    free = -10 * distance
    keyed = materialise(points.select("_g", F.col("a").cast("bigint").alias("a")).distinct().withColumn(
        "b", F.floor(F.col("a") / block)))   # narrow, and used several times

    def reduce_block(part: pd.DataFrame) -> pd.DataFrame:
        b = int(part["b"].iloc[0])
        exits = _exits(np.sort(part["a"].to_numpy()), b * block, distance)
        return pd.DataFrame({"_g": part["_g"].iloc[:1].to_numpy(), "b": [b], "exits": [exits]})

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        s = int(part["s"].iloc[0])
        state = s * fan * block - np.arange(1, distance + 1)
        for b, exits in sorted(zip(part["b"], part["exits"]), key=lambda x: x[0]):
            state = _through(state, b * block, np.asarray(exits), distance)
        return pd.DataFrame({"_g": part["_g"].iloc[:1].to_numpy(), "s": [s], "exits": [state]})

    def walk(part: pd.DataFrame, at: str, width: int, entry: int) -> list[int]:
        state, entries = np.array([entry]), []
        for number, exits in zip(part[at], part["exits"]):
            entries.append(int(state[0]))
            state = _through(state, number * width, np.asarray(exits), distance)
        return entries

    def enter_fans(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("s")
        return part[["_g", "s"]].assign(entry=walk(part, "s", fan * block, free))

    def enter_blocks(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("b")
        return part[["_g", "b"]].assign(entry=walk(part, "b", block, int(part["entry"].iloc[0])))

    def pick(batches):
        """Rows come sorted by source, block and value; only the last chosen value is kept."""
        block_of, last = None, free
        for part in batches:
            chosen = []
            for g, b, a, entry in zip(part["_g"], part["b"], part["a"], part["entry"]):
                if (g, b) != block_of:
                    block_of, last = (g, b), entry
                if a - last >= distance:
                    chosen.append((g, a, last))
                    last = a
            yield pd.DataFrame(chosen, columns=["_g", "a", "last"]).astype({"a": "int64", "last": "int64"})

    # a source of one block starts free; only longer ones need tables
    long = keyed.join(keyed.groupBy("_g").agg(F.min("b").alias("_lo"), F.max("b").alias("_hi")).where("_lo < _hi").select("_g"),
                      "_g", "left_semi")
    if long.isEmpty():
        ready = keyed.withColumn("entry", F.lit(free).cast("bigint"))
    else:
        tables = (long.groupBy("_g", "b").applyInPandas(reduce_block, "_g string, b bigint, exits array<bigint>")
                  .withColumn("s", F.floor(F.col("b") / fan)))
        fans = tables.groupBy("_g", "s").applyInPandas(compose, "_g string, s bigint, exits array<bigint>")
        entered = fans.groupBy("_g").applyInPandas(enter_fans, "_g string, s bigint, entry bigint")
        inside = tables.join(entered, ["_g", "s"]).groupBy("_g", "s").applyInPandas(
            enter_blocks, "_g string, b bigint, entry bigint")
        ready = keyed.join(inside, ["_g", "b"], "left").withColumn("entry", F.coalesce("entry", F.lit(free)))
    ready = ready.select("_g", "b", "a", "entry")
    picked = ready.repartition("_g", "b").sortWithinPartitions("_g", "b", "a").mapInPandas(
        pick, "_g string, a bigint, last bigint")
    return picked.select("_g", "a", F.when(F.col("last") > free, F.col("last")).alias("last"))
