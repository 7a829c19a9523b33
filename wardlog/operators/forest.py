"""Isolation forest (Liu, Ting and Zhou 2008): trees on small seeded samples, scored in batches.

Rows reach a tree by the order of a seeded hash of their key, so the same data gives the same
forest whatever the partitioning. A tree sees `sample_size` rows and is built in one group; the
node table has at most `trees * (2 * sample_size - 1)` rows, which is what gets broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

NODE = ("tree INT, node INT, feature INT, split DOUBLE, left INT, right INT, size INT")
DRAWS = 8
MIN_ROWS = 10


def average_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = n[big] - 1
    out[big] = 2 * (np.log(m) + np.euler_gamma) - 2 * m / n[big]
    return out


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree in breadth-first order; a leaf has feature -1 and its size."""
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, None)]
    while waiting:
        rows, depth, parent = waiting.pop(0)
        number = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows)])
        if parent is not None:
            nodes[parent[0]][parent[1]] = number
        if depth >= limit or len(rows) < 2:
            continue
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if not len(varying):
            continue
        feature = int(rng.choice(varying))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = points[rows, feature] <= split
        nodes[number][:2] = [feature, split]
        waiting.append((rows[goes_left], depth + 1, (number, 2)))
        waiting.append((rows[~goes_left], depth + 1, (number, 3)))
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    """Node table plus what scoring needs: sample size, and the bounds of the training scores."""

    nodes: pd.DataFrame
    sample_size: int
    low: float | None = None
    high: float | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.nodes, NODE)

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.sample_size, self.low, self.high)],
                              "sample_size INT, low DOUBLE, high DOUBLE").write.mode(
            "overwrite").parquet(f"{path}/bounds")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forest":
        bounds = spark.read.parquet(f"{path}/bounds").first()
        nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
        return Forest(nodes, bounds.sample_size, bounds.low, bounds.high)


def train(df: DataFrame, key: Sequence[str], vector: str = "features", trees: int = 100,
          sample_size: int = 256, seed: int = 42) -> Forest:
    """Fit on an array column; `key` identifies a row."""
    total = df.count()
    if total < MIN_ROWS:
        raise ValueError(f"{total} rows; at least {MIN_ROWS} are needed")
    sample_size = min(sample_size, total)
    limit = int(np.ceil(np.log2(max(sample_size, 2))))
    # every row draws a ticket for every tree; about DRAWS times as many as are needed get through, and
    # the smallest tickets of a tree are its sample, exactly as if all had been ranked
    bound = -(1 << 63) + int(min(1.0, DRAWS * sample_size / total) * (1 << 64))
    ticket = lambda tree: F.xxhash64(F.lit(seed), tree, *key)
    through = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                       lambda tree: ticket(tree) <= F.lit(min(bound, (1 << 63) - 1)))
    draws = (df.select(*key, vector, F.explode(through).alias("tree"))
             .withColumn("_draw", ticket(F.col("tree"))))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", *key))
    samples = (draws.withColumn("_rank", rank).where(F.col("_rank") <= sample_size)
               .select("tree", "_rank", vector))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        points = np.stack(group.sort_values("_rank")[vector].to_numpy()).astype(float)
        grown = _grow(points, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["feature", "split", "left", "right", "size"])
        out.insert(0, "node", np.arange(len(out)))
        out.insert(0, "tree", tree)
        return out

    nodes = samples.groupBy("tree").applyInPandas(build, NODE).toPandas()
    return Forest(nodes.sort_values(["tree", "node"], ignore_index=True), sample_size)


def raw_score(forest: Forest, spark: SparkSession, vector: str = "features"):
    """Column: 2 ** (-mean depth / expected depth), higher is more isolated."""
    tables = []
    for _, t in forest.nodes.groupby("tree", sort=True):
        tables.append(tuple(t[c].to_numpy() for c in ("feature", "split", "left", "right"))
                      + (average_path(t["size"].to_numpy()),))
    shared = spark.sparkContext.broadcast(tables)
    expected = float(average_path(np.array([forest.sample_size]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=float)
        points = np.stack(vectors.to_numpy()).astype(float)
        depth = np.zeros(len(points))
        everyone = np.arange(len(points))
        for feature, split, left, right, rest in shared.value:
            at = np.zeros(len(points), dtype=np.int64)
            moving = everyone
            while True:
                moving = moving[feature[at[moving]] >= 0]
                if not len(moving):
                    break
                here = at[moving]
                goes_left = points[moving, feature[here]] <= split[here]
                at[moving] = np.where(goes_left, left[here], right[here])
                depth[moving] += 1
            depth += rest[at]
        return pd.Series(np.power(2.0, -depth / len(shared.value) / expected))

    return score(F.col(vector))


def with_raw_scores(forest: Forest, df: DataFrame, vector: str = "features") -> DataFrame:
    return df.withColumn("raw_score", raw_score(forest, df.sparkSession, vector))


def fit_bounds(forest: Forest, scored: DataFrame) -> Forest:
    """Remember the range of the training scores."""
    row = scored.agg(F.min("raw_score").alias("low"), F.max("raw_score").alias("high")).first()
    forest.low, forest.high = row.low, row.high
    return forest


def normalise(forest: Forest, scored: DataFrame, threshold: float = 0.6) -> DataFrame:
    """`anomaly_score` in [0, 1] on the training range, and `label`."""
    span = (forest.high - forest.low) or 1e-9
    score = F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (F.col("raw_score") - F.lit(forest.low)) / F.lit(span)))
    return (scored.withColumn("anomaly_score", score)
            .withColumn("label", (F.col("anomaly_score") >= threshold).cast("int"))
            .drop("raw_score"))


def predict(forest: Forest, df: DataFrame, threshold: float = 0.6,
            vector: str = "features") -> DataFrame:
    return normalise(forest, with_raw_scores(forest, df, vector), threshold)
