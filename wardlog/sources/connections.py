"""Public network-connection benchmark: header-less CSV, 41 features, label, optional difficulty."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardlog.constants import CATEGORICAL_COLUMNS, CONNECTION_COLUMNS

CSV_SCHEMA = ", ".join(f"`{c}` STRING" for c in (*CONNECTION_COLUMNS, "label", "difficulty"))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    """42 or 43 columns; a missing trailing column is NULL."""
    return spark.read.csv(path, schema=CSV_SCHEMA, mode="PERMISSIVE", header=False)


def binary_label(label=None):
    label = F.col("label") if label is None else label
    return F.when(F.lower(F.trim(label)) == "normal", 0).otherwise(1)


def fit_encoders(train: DataFrame) -> StringIndexerModel:
    """Codes in lexical order, learnt once from the training file; unseen values come last."""
    return StringIndexer(
        inputCols=list(CATEGORICAL_COLUMNS), outputCols=[f"{c}_code" for c in CATEGORICAL_COLUMNS],
        stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)


def encode(df: DataFrame, encoders: StringIndexerModel) -> DataFrame:
    """Numeric columns (text that is not a number becomes 0), `y`, and the array `features`."""
    coded = encoders.transform(df)
    columns = [F.col(f"{c}_code") if c in CATEGORICAL_COLUMNS
               else F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
               for c in CONNECTION_COLUMNS]
    numbers = coded.select("*", binary_label().alias("y"),
                           F.array(*columns).alias("features"))
    return numbers.select(
        *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(CONNECTION_COLUMNS)],
        "label", "difficulty", "y", "features")


def load_pair(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Train and test file sharing the encoder fitted on train."""
    first = read_connections(spark, train)
    encoders = fit_encoders(first)
    return encode(first, encoders), encode(read_connections(spark, test), encoders)


def profile(encoded: DataFrame) -> DataFrame:
    attack = F.sum("y")
    return encoded.agg(
        F.count("*").alias("samples"), F.lit(len(CONNECTION_COLUMNS)).alias("features"),
        (F.count("*") - attack).alias("normal"), attack.alias("attack"),
        F.round(F.coalesce(F.try_divide(attack, F.count("*")), F.lit(0.0)), 4)
        .alias("attack_ratio"))


def normal_only(encoded: DataFrame) -> DataFrame:
    return encoded.where("y = 0")
