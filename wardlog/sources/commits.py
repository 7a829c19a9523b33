"""Tables that grow by commits: rows by day and commit, and one small record that says which folders count.

A commit writes its rows to folders of its own and then its record; readers look at folders that the newest record
names, so an interrupted commit leaves nothing behind and can be repeated. The record is read by its number: neither
reading nor writing looks through the past. When a day has FAN folders of one level, they are merged into
one of the next, so a day has a few dozen folders at most, and a row is rewritten a few times at most.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY = 86400
UNTIMED = "untimed"     # the day of rows without a time
FAN = 16


class Folder:
    """The few things jobs do with files themselves, on whatever store the path is of."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str | None:
        at = self._at(name)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All of the text or nothing: written aside, then renamed."""
        aside, at = self._at(f"_{name}"), self._at(name)
        stream = self.fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.delete(at, False)
        if not self.fs.rename(aside, at):
            raise OSError(f"cannot write {at}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


@dataclass
class Record:
    """What a commit leaves to the next: per table and day the folders that count, as (commit, level, name)."""

    commit: int = -1
    newest: int | None = None
    files: dict[str, dict[str, list]] = field(default_factory=dict)
    runs: dict[str, dict] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    garbage: list[str] = field(default_factory=list)


def day_of(epoch: Column) -> Column:
    return F.coalesce(F.floor(epoch / DAY).cast("string"), F.lit(UNTIMED))


def days_between(first: int, last: int) -> range:
    return range(first // DAY, last // DAY + 1)


class CommitLog:
    """The tables under `root`; `schemas` maps their names to DDL. `day` says what divides rows, by default the day of `epoch`."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str], day: Column | None = None) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas
        self.day = day_of(F.col("epoch")) if day is None else day
        self.folder = Folder(spark, self.root)

    def record(self, commit: int | None = None) -> Record:
        """The record of a commit, or the newest one. Only the last two are kept, so finding it stays cheap."""
        if commit is None:
            found = [int(n.removeprefix("record-")) for n in self.folder.names() if n.startswith("record-")]
            commit = max(found, default=-1)
        text = self.folder.read(f"record-{commit}")
        return Record(**json.loads(text)) if text else Record()

    def write(self, table: str, df: DataFrame, commit: int, name: str | None = None,
              day: Column | None = None) -> dict[str, list]:
        """Write rows to the folder of a commit, by their day or what is given: {day: [[commit, level, folder]]}."""
        name = name or f"{table}/commit={commit}"
        if "commit" not in df.columns:
            df = df.withColumn("commit", F.lit(commit).cast("bigint"))
        # files of about the advisory size, whatever a day holds
        (df.withColumn("day", self.day if day is None else day).hint("rebalance", "day")
         .write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}"))
        return {h.removeprefix("day="): [[commit, 0, name]] for h in self.folder.names(name) if h.startswith("day=")}

    def read(self, table: str, record: Record, days: Iterable[str] | None = None,
             commits: set[int] | None = None) -> DataFrame:
        """Rows of the wanted days with the `commit` they are of; everything by default."""
        by_day = record.files.get(table, {})
        wanted = by_day if days is None else [h for h in map(str, days) if h in by_day]
        groups: dict[str, list[str]] = {}
        for day in wanted:
            for commit, _, name in by_day[day]:
                if commits is None or commit in commits:
                    groups.setdefault(name, []).append(f"{self.root}/{name}/day={day}")
        paths = [p for found in groups.values() for p in found]
        schema = f"{self.schemas[table]}, commit BIGINT"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def finish(self, record: Record, before: Record, compact: bool = True) -> Record:
        """Merge crowded days, publish the record, and remove what the record before last needed."""
        record.garbage = list(record.garbage)
        if compact:
            for table, days in record.files.items():
                self._compact(table, days, record)
        self.folder.write(f"record-{record.commit}", json.dumps(asdict(record)))
        for name in before.garbage:
            self.folder.delete(name)
        for name in self.folder.names():
            if name.startswith("record-") and int(name.removeprefix("record-")) < before.commit:
                self.folder.delete(name)
        return record

    def _compact(self, table: str, days: dict[str, list], record: Record) -> None:
        """One job for all days that have too many folders of a level."""
        crowded = {}
        for day, found in days.items():
            levels = [level for _, level, _ in found]
            level = next((x for x in sorted(set(levels)) if levels.count(x) >= FAN), None)
            if level is not None:
                crowded[day] = (level, [f for f in found if f[1] <= level])
        if not crowded:
            return
        name = f"{table}/merged={record.commit}"
        rows = self.read(table, Record(files={table: {h: f for h, (_, f) in crowded.items()}}))
        self.write(table, rows, record.commit, name)
        for day, (level, merged) in crowded.items():
            days[day] = [f for f in days[day] if f not in merged] + [[record.commit, level + 1, name]]
            record.garbage += [f"{n}/day={day}" for _, _, n in merged]
