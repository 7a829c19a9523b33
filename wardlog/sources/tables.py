"""Tables the jobs write: partitioned appends, replacement of one partition, run log, latest."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_DATE = "event_date"


def append_events(events: DataFrame, path: str, source_id: int | None = None) -> None:
    """Events by date; within a date clustered by source, which gives tight row-group statistics.

    A hot source spreads over the hour as well, so it does not end up in one task.
    """
    dated = events.withColumn(EVENT_DATE, F.to_date("ts"))
    if source_id is not None:
        dated = dated.withColumn("source_id", F.lit(source_id))
    (dated.repartition(EVENT_DATE, F.floor(F.col("epoch") / 3600), "src_ip")
     .sortWithinPartitions(EVENT_DATE, "src_ip", "ts")
     .write.mode("append").partitionBy(EVENT_DATE).parquet(path))


def append(df: DataFrame, path: str, *partition: str) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in `df` (for instance one algorithm's results)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet; anything else that is wrong with it is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def info_documents(task_rows: DataFrame, kind: str, *columns: str) -> DataFrame:
    """(task_id, kind, content): the named columns as one JSON document per row."""
    return task_rows.select("task_id", F.lit(kind).alias("kind"),
                            F.to_json(F.struct(*columns)).alias("content"))


def read_info(info: DataFrame, kind: str, schema: str) -> DataFrame:
    """Documents of one kind with their content parsed by the schema of that kind."""
    return (info.where(F.col("kind") == kind)
            .withColumn("document", F.from_json("content", schema))
            .select(*[c for c in info.columns if c != "content"], "document.*"))
