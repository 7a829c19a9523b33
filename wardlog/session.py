"""Session helpers: the settings the jobs rely on, and where checkpoints go."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # recording the Python call site of every expression takes half the time of building a plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # HotSpot never compiles a longer method; Spark then takes several short ones instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "wardlog", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings for a session somebody else built."""
    for key in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.skewJoin.enabled", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, SETTINGS[key])
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give an input of fewer splits than cores (one small file) the session's parallelism.

    Inputs with enough splits are returned as they are.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, *keys) if df.rdd.getNumPartitions() < wanted else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    A local session that names none, as in tests, gets one in its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Drops the shuffle files of a query when it ends. Otherwise they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: ContextVar[list[str] | None] = ContextVar("checkpoints of the step", default=None)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no recomputation.

    Spark removes the files of a table that is no longer used (SETTINGS), `step` those of what was made in it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    if _MADE.get() is not None:
        path = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if path.isDefined():
            _MADE.get().append(path.get())
    return out


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """A step of a job that leaves nothing on disk but what it writes: shuffle files go when their query ends, what was
    materialised goes with the step. So nothing that was built in it may be evaluated after it."""
    before, made = spark.conf.get(SHUFFLE_CLEANUP, None), []
    token = _MADE.set(made)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        _MADE.reset(token)
        spark.conf.set(SHUFFLE_CLEANUP, before or "false")
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
