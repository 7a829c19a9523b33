"""Continuous ingest: parse, store, detect per micro-batch, with exactly the batch plans.

Each micro-batch is a commit (`sources.commits`): it reads the record of the commit before, the stored events and hits
around the times of its own lines, and nothing else of the past. Lines may come in any order: what `upkeep` finds
to have changed is stored, also hits on earlier events that a late line completes, and hits that it takes back. So
whatever the batches, the hits are those of `detect` over all stored events. A batch that was committed is not
repeated; one that was interrupted before is. Rules are re-read at the start of each batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wardlog import schema
from wardlog.operators.alerts import consolidate
from wardlog.plans.upkeep import current, refreshed
from wardlog.sources import logs
from wardlog.sources.commits import UNTIMED, CommitLog, Record
from wardlog.sources.rules import Rule, load_rules

LINES = "seq BIGINT, value STRING"
TABLES = {"events": schema.EVENT + ", late BOOLEAN", "hits": schema.HIT + ", live BOOLEAN, known BOOLEAN",
          "progress": "epoch BIGINT, parsed BIGINT, late BIGINT, newest BIGINT, hits BIGINT"}


@dataclass
class Ingest:
    """`delay` seconds behind the newest time a line counts as late. Lines dated more than `ahead` seconds past the clock
    are stored and examined like others, but do not move the newest time."""

    spark: SparkSession
    out: str
    rules: Callable[[], list[Rule]]
    year: int | Column
    delay: int = 600
    ahead: int = 86400
    clock: Callable[[], float] = time.time

    @classmethod
    def with_rule_table(cls, spark: SparkSession, out: str, path: str, year: int | Column,
                        **more) -> "Ingest":
        return cls(spark, out, lambda: load_rules(spark.read.parquet(path)), year, **more)

    @property
    def log(self) -> CommitLog:
        return CommitLog(self.spark, self.out, TABLES)

    def _whole(self, name: str) -> DataFrame:
        log = self.log
        return log.read(name, log.record())

    def events(self) -> DataFrame:
        return self._whole("events").drop("late")

    def late(self) -> DataFrame:
        return self._whole("events").where("late").drop("late")

    def hits(self) -> DataFrame:
        return current(self._whole("hits"))

    def alerts(self, **options) -> DataFrame:
        return consolidate(self.hits(), **options)

    def progress(self) -> DataFrame:
        """A row per batch: lines parsed, late ones, newest time, hits that batch has changed."""
        return self._whole("progress").drop("epoch").withColumnRenamed("commit", "batch")

    def process(self, lines: DataFrame, batch: int) -> None:
        log = self.log
        before = log.record(batch - 1) if batch else Record()
        if before.commit != batch - 1:      # a number was skipped, or the tables are older than this stream
            before = log.record()
        if before.commit >= batch or log.record(batch).commit == batch:
            return
        rules, seen = self.rules(), Observation(f"batch-{batch}")
        names = [c.split()[0] for c in schema.EVENT.split(", ") if c]
        late = (F.coalesce(F.col("epoch") < before.newest - self.delay, F.lit(False))
                if before.newest is not None else F.lit(False))
        parsed = logs.accepted(logs.parse(lines, year=self.year, keep=("seq",))).select(*names).withColumn("late", late)
        latest = F.max(F.when(F.col("epoch") <= int(self.clock()) + self.ahead, F.col("epoch")))
        folders = log.write("events", parsed.observe(
            seen, F.count("*").alias("parsed"), F.count_if("late").alias("late"), latest.alias("newest")), batch)
        counts = seen.get
        known = [n for n in (before.newest, counts["newest"]) if n is not None]
        record = Record(batch, max(known, default=None),
                        {t: {d: list(f) for d, f in before.files.get(t, {}).items()} for t in TABLES})
        self._extend(record, "events", folders)
        changed = self._detect(log, before, record, folders, rules, batch) if counts["parsed"] and rules else 0
        row = self.spark.createDataFrame([(None, counts["parsed"], counts["late"], record.newest, changed)], TABLES["progress"])
        self._extend(record, "progress", log.write("progress", row.coalesce(1), batch))
        log.finish(record, before)

    @staticmethod
    def _extend(record: Record, table: str, folders: dict[str, list]) -> None:
        for day, found in folders.items():
            record.files[table].setdefault(day, []).extend(found)

    def _detect(self, log: CommitLog, before: Record, record: Record, folders: dict, rules: list[Rule], batch: int) -> int:
        own = log.read("events", record, folders, {batch})
        stored = lambda days, untimed=False: current(
            log.read("hits", before, [*days, *([UNTIMED] if untimed else [])]))
        counted = Observation(f"hits-{batch}")
        changes = refreshed(own, own, sorted(int(d) for d in folders if d != UNTIMED), rules,
                            lambda days: log.read("events", record, days), stored,
                            [int(d) for d in record.files["events"] if d != UNTIMED])
        self._extend(record, "hits", log.write("hits", changes.observe(counted, F.count("*").alias("hits")), batch))
        return counted.get["hits"]

    def start(self, lines: DataFrame, checkpoint: str, interval: str = "2 seconds",
              available_now: bool = False) -> StreamingQuery:
        """`lines` is a stream of (seq, value)."""
        writer = lines.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint)
        writer = (writer.trigger(availableNow=True) if available_now
                  else writer.trigger(processingTime=interval))
        return writer.start()


def read_line_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """Dropped parquet files of (seq, value)."""
    return (spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(folder))


class SourceProgress(StreamingQueryListener):
    """Rows read and status per query, for a status page."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.status: dict[str, str] = {}

    def onQueryStarted(self, event):
        self.status[str(event.id)] = "running"

    def onQueryProgress(self, event):
        name = str(event.progress.id)
        self.rows[name] = self.rows.get(name, 0) + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.status[str(event.id)] = "failed" if event.exception else "finished"
