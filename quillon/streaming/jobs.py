"""Ingestion as streams: a job queue from files, leases and pending cancels as keyed state, cache entries that expire key by
key, idempotent publishing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..staging import new_path

JOBS = "job_id long, document_id long, event string, at timestamp"
STATE = "stage string, attempt int, lease_until long, pending boolean"
#: Events in the life of a job and the stages they lead to; others change nothing. A running job that shall be cancelled is
#: so at its next border between two parts of its work, if it gets there; one that succeeds first keeps what it made.
MOVES = {
    ("", "enqueue"): "queued",
    ("queued", "claim"): "running",
    ("queued", "cancel"): "cancelled",
    ("running", "succeed"): "succeeded",
    ("running", "fail"): "failed",
    ("failed", "retry"): "queued",
}
LEASE_SECONDS = 120


def job_events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Job events from JSON files, oldest first; repeats of the same event within a day are dropped."""
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", per_trigger).option("latestFirst", "false").json(path)
    return stream.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["job_id", "event", "at"])


def step(stage: str, attempt: int, lease_until: int, pending: bool, event: str, at_ms: int, lease_seconds: int = LEASE_SECONDS) -> tuple[str, int, int, bool]:
    """The next (stage, attempt, lease end in ms, cancel pending). A heartbeat or a border renews a running job's lease; a lease
    that ran out before an event has failed the job first."""
    if stage == "running" and lease_until < at_ms:
        stage, pending = "failed", False
    if stage == "running" and event in ("heartbeat", "border"):
        if event == "border" and pending:
            return "cancelled", attempt, lease_until, False
        return stage, attempt, at_ms + 1000 * lease_seconds, pending
    if stage == "running" and event == "cancel":
        return stage, attempt, lease_until, True
    new = MOVES.get((stage, event), stage)
    if (stage, new) == ("queued", "running"):
        return new, attempt + 1, at_ms + 1000 * lease_seconds, False
    return new, attempt, lease_until, pending and new == "running"


def job_stages(events: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """job_id, stage, attempt after each batch of events; a running job whose lease passes the watermark is failed."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, attempt, lease, pending = state.get if state.exists else ("", 0, 0, False)
        if state.hasTimedOut:
            stage, pending = ("failed", False) if stage == "running" else (stage, pending)
        else:
            rows = pd.concat(list(parts)).sort_values(["at", "event"])
            for event, at in zip(rows.event, rows["at"], strict=True):
                stage, attempt, lease, pending = step(stage, attempt, lease, pending, event, int(at.timestamp() * 1000), lease_seconds)
        state.update((stage, attempt, lease, pending))
        if stage == "running":
            state.setTimeoutTimestamp(max(lease, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"job_id": [key[0]], "stage": [stage], "attempt": [attempt]})

    return events.groupBy("job_id").applyInPandasWithState(fold, "job_id long, stage string, attempt int", STATE, "update", GroupStateTimeout.EventTimeTimeout)


class CacheUses(StatefulProcessor):
    """Lives of cache entries by key: an entry that is not used for ``ttl_ms`` of event time is gone, and a later use makes
    a new one. Its state goes by a timer of its own key, so what is kept is the entries that are alive."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "since_ms long, last_ms long, uses long")

    def _row(self, key, since: int, last: int, uses: int, expired: bool) -> tuple:
        return (key, since, last, uses, expired)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["key", "since_ms", "last_ms", "uses", "expired"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self.entry.get(), []
        if held:
            self.handle.deleteTimer(held[1] + self.ttl_ms)
        for at in sorted(int(t) for part in rows for t in part["at_ms"]):
            if held and at - held[1] > self.ttl_ms:
                out.append(self._row(key[0], *held, True))
                held = None
            held = (held[0], max(held[1], at), held[2] + 1) if held else (at, at, 1)
        self.entry.update(held)
        self.handle.registerTimer(held[1] + self.ttl_ms)
        yield self._frame([*out, self._row(key[0], *held, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        self.entry.clear()
        yield self._frame([self._row(key[0], *held, True)] if held else [])

    def close(self) -> None:
        pass


def live_entries(touches: DataFrame, ttl_seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """key, since, last, uses, expired: the life of each cache entry, after each batch of uses (key, at) that touched it, and once
    more when the watermark shows that it expired. Sessions need the RocksDB state store for this."""
    touches.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = dict(touches.dtypes)["key"]
    keyed = touches.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at")).groupBy("key")  # as numbers, free of time zones
    lives = keyed.transformWithStateInPandas(CacheUses(1000 * ttl_seconds), f"key {kind}, since_ms long, last_ms long, uses long, expired boolean", "Update", "EventTime")
    return lives.select("key", F.timestamp_millis("since_ms").alias("since"), F.timestamp_millis("last_ms").alias("last"), "uses", "expired")


def run_to_end(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """All rows that a stream gives until it has read what there is, with the number of the batch that gave them."""
    spark = stream.sparkSession
    out = new_path(spark, name)

    def one(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-checkpoint")).foreachBatch(one).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'{n} {k}' for n, k in stream.dtypes)}, batch int").parquet(out)


def publish_each(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, str], None]):
    """Starts a query that hands each micro-batch with its stable version name to ``write``; after a restart the same batch
    has the same name, so a write that overwrites its version is idempotent."""

    def one(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, f"{batch_id:010d}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
