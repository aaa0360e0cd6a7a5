"""Versioned tables in a directory: build beside, check the count, switch a pointer, clean up, export.

Layout: root/table/version=V/ and numbered pointer files root/table/_active/N. Readers see the version that the
last whole pointer names, so a version that is being built or failed its check is never read. A pointer is
created, never changed: a writer that dies leaves the one before in force, and of two writers one fails.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _last_pointer(fs, Path, folder: str) -> tuple[int, str | None]:
    """From the highest number down to the first pointer that is whole, read through the file system."""
    path = Path(folder)
    names = sorted((s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(path) else []
    for name in names:
        file = fs.open(Path(f"{folder}/{name}"))
        text = bytes(file.readAllBytes()).decode()
        file.close()
        if text.endswith("\n") and text.strip():
            return int(names[0]), text.strip()
    return (int(names[0]) if names else 0), None


def _write_pointer(fs, Path, path: str, text: str) -> None:
    file = fs.create(Path(path), False)  # fails if another writer was first
    file.write(bytearray(f"{text}\n".encode()))
    file.close()


class Manifest:
    """One state over several tables: numbered files, created and never changed, of which the last whole one counts. All that a
    state names is written before, so a publication that fails leaves every table at the state before."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self.Path = path, jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self) -> dict:
        text = _last_pointer(self.fs, self.Path, self.path)[1]
        if text is None:
            raise LookupError(f"{self.path} has no state")
        return json.loads(text)

    def switch(self, state: dict, expected: str | None = None) -> None:
        """Moves to ``state``, a dict with the name ``state``; ``expected`` is the name that must be active until then."""
        number, now = _last_pointer(self.fs, self.Path, self.path)
        name = json.loads(now)["state"] if now else None
        if expected is not None and name != expected:
            raise ValueError(f"{self.path} is at {name}, not at {expected}")
        _write_pointer(self.fs, self.Path, f"{self.path}/{number + 1:012d}", json.dumps(state))


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[str]:
        fs, Path = self._fs()
        if not fs.exists(Path(self.path)):
            return []
        return sorted(s.getPath().getName().removeprefix("version=") for s in fs.listStatus(Path(self.path)) if s.getPath().getName().startswith("version="))

    def _pointer(self) -> tuple[int, str | None]:
        """Number and text of the last whole pointer; the number is that of the last file, whole or not."""
        fs, Path = self._fs()
        return _last_pointer(fs, Path, f"{self.path}/_active")

    def active(self) -> str | None:
        return self._pointer()[1]

    def read(self) -> DataFrame:
        if (version := self.active()) is None:
            raise LookupError(f"{self.path} has no active version")
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def build(self, df: DataFrame, version: str) -> int:
        """Writes a version beside the active one; returns its rows as read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.spark.read.parquet(f"{self.path}/version={version}").count()

    def switch(self, version: str, expected: str | None = None) -> None:
        """Points readers at a version. ``expected`` is the version that must be active until then (compare and set)."""
        fs, Path = self._fs()
        number, now = self._pointer()
        if expected is not None and now != expected:
            raise ValueError(f"{self.path} is at {now}, not at {expected}")
        _write_pointer(fs, Path, f"{self.path}/_active/{number + 1:012d}", version)

    def publish(self, df: DataFrame, version: str, expected: int | None = None) -> int:
        """Build, compare the count, switch. A wrong count drops the new version and leaves the active one."""
        n = self.build(df, version)
        if expected is not None and n != expected:
            self.drop(version)
            raise ValueError(f"version {version} has {n} rows, not {expected}")
        self.switch(version)
        return n

    def drop(self, version: str) -> None:
        if version == self.active():
            raise ValueError("the active version stays")
        fs, Path = self._fs()
        fs.delete(Path(f"{self.path}/version={version}"), True)

    def collect_garbage(self, keep: list[str]) -> list[str]:
        """Drops versions that are neither active nor listed."""
        active = self.active()
        gone = [v for v in self.versions() if v != active and v not in keep]
        fs, Path = self._fs()
        for v in gone:
            fs.delete(Path(f"{self.path}/version={v}"), True)
        return gone


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of the same key replaced and new ones added."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def without(table: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """The table less the rows with a key of ``removed``: bulk and cascading deletes."""
    return table.join(removed.select(*keys).distinct(), keys, "left_anti")


def updated_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The table with columns changed where the condition holds."""
    return table.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def claim(jobs: DataFrame, worker: Column, now: Column, lease_seconds: int = 120) -> DataFrame:
    """Jobs after one worker took the oldest queued one; a job that is not queued any more is never taken."""
    first = jobs.filter("stage = 'queued' AND NOT cancel_requested").orderBy("created_at", "id").limit(1).select("id")
    mine = first.withColumn("mine", F.lit(True))
    out = jobs.join(F.broadcast(mine), "id", "left")
    got = F.coalesce(F.col("mine"), F.lit(False))
    return out.withColumns(
        {
            "stage": F.when(got, "running").otherwise(F.col("stage")),
            "lease_owner": F.when(got, worker).otherwise(F.col("lease_owner")),
            "lease_until": F.when(got, now + F.expr(f"interval {lease_seconds} seconds")).otherwise(F.col("lease_until")),
            "attempt": F.col("attempt") + got.cast("int"),
        }
    ).drop("mine")


def reap(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has run out are failed."""
    return updated_where(jobs, (F.col("stage") == "running") & (F.col("lease_until") < now), stage=F.lit("failed"))


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Jobs with those of ``wanted`` whose document has no queued or running job yet."""
    busy = jobs.filter(F.col("stage").isin("queued", "running")).select("document_id")
    return jobs.unionByName(wanted.dropDuplicates(["document_id"]).join(busy, "document_id", "left_anti").select(*jobs.columns))


def append_audit(rows: DataFrame, path: str, max_detail: int = 500) -> bool:
    """Appends audit rows, detail cut to its limit; a failure is logged and reported, never raised."""
    try:
        rows.withColumn("detail", F.substring("detail", 1, max_detail)).write.mode("append").parquet(path)
        return True
    except Exception:  # an audit must not stop what it records
        logging.getLogger(__name__).exception("audit rows were not written to %s", path)
        return False


def export_memories(memories: DataFrame, path: str, fmt: str = "csv", most: int = 10_000) -> None:
    """The newest ``most`` memories (the feature's own limit) as CSV or JSON lines, scores with four digits. CSV begins with
    a byte-order mark for spreadsheet programs."""
    rows = memories.orderBy(F.desc("updated_at"), F.desc("id")).limit(most).withColumn("score", F.round("score", 4))
    if fmt == "json":
        rows.write.mode("overwrite").json(path)
        return
    names = rows.columns
    marked = rows.withColumnRenamed(names[0], "﻿" + names[0])
    marked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
