"""Stages written to the folder that all executors share, and broadcasts of counted size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 100_000
#: What a batch between Spark and Python may hold. Spark's own limits allow 64 MB, of which several copies may be in
#: memory at once for each core.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the shared place the cluster names in ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (tests, notebooks) gets a temporary folder; on a cluster, whose
    executors would not see it, this is an error. The folder goes when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _FALLBACK:
            _FALLBACK[app] = tempfile.mkdtemp(prefix="quillon-")
        base = _FALLBACK[app]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quillon-{app}")
    fs = path.getFileSystem(conf)
    path = fs.makeQualified(path)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    uri = path.toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """A stage that is read more than once, written and read back: its lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Limits this session's Arrow batches, as rows here are whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 10_000, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows put together until they hold ``rows`` or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table of texts over all cores, if its files have fewer splits than there are cores; a table of many
    splits stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a hint to broadcast it, if a count finds at most ``rows`` rows; else as it is, for a shuffle join."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fold_groups(df: DataFrame, key: str, order: str, fn: Callable[[list[dict]], list[tuple]], schema: str, size: int = 4096) -> DataFrame:
    """Rows that ``fn`` makes of each group's rows, in order. Sorted rows stream by, so a task holds one group at a time."""
    kinds = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if group and row[key] != group[0][key]:
                        out += fn(group)
                        group = []
                        if len(out) >= size:
                            yield batch_of(out)
                            out = []
                    group.append(row)
        if group:
            out += fn(group)
        if out:
            yield batch_of(out)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def stream_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[Iterator[dict]], Iterable[tuple]], schema: StructType, size: int = 256) -> DataFrame:
    """Rows that ``fold`` makes of each group, whose rows it gets one by one in order; a task holds what ``fold`` keeps of them.
    Null keys are a group."""
    kinds = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                yield from batch.slice(start, size).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in groupby(rows(batches), key=itemgetter(*keys)):
            for row in fold(group):
                out.append(row)
                if len(out) >= size:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def ordered_runs(df: DataFrame, key: str, order: list[str], value: str, name: str = "runs") -> DataFrame:
    """``df`` with ``place``, the number of the row within its ``key`` in the order, ``filled``, its ``value`` or the last one before it
    that is not null, and ``run``, a number that grows where filled changes.

    Ranges of the sort order are scanned apart, so a key of any share of the rows is in many tasks. What was open at the end
    of a range is carried into the next one for the keys that reach over its border, which are two rows a range at most."""
    spark = df.sparkSession
    kinds = dict(df.dtypes)
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    added = [("part", "int"), ("place", "bigint"), ("filled", kinds[value]), ("run", "bigint")]
    schema = ", ".join(f"`{n}` {k}" for n, k in [*df.dtypes, *added])
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, filled, run = TaskContext.get().partitionId(), (), -1, None, 0
        for batch in batches:
            rows = []
            for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist(), strict=True):
                if (k,) != last:
                    last, place, filled, run = (k,), -1, None, 0
                place += 1
                if v is not None and v != filled:
                    filled, run = v, run + 1
                rows.append((part, place, filled, run))
            if rows:
                cols = [pa.array(c, out.field(n).type) for c, (n, _) in zip(zip(*rows, strict=True), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], schema=out)

    # written, so that ranges and places stay the same when a task runs again
    local = staged(ranged.mapInArrow(scan, schema), name)
    ends = local.groupBy(key, "part").agg(F.count("*").alias("n"), F.max_by("filled", "place").alias("end"), F.max("run").alias("runs"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col("place"))).alias("first"))
    over = ends.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("parts")).filter("parts > 1")
    carried, held = [], {}
    for r in sorted(ends.join(over, F.col(key).eqNullSafe(F.col("_k"))).collect(), key=lambda r: r["part"]):
        start, carry, base = held.get(r[key], (0, None, 0))
        same = carry is not None and r["first"] == carry
        carried.append((r[key], r["part"], start, carry, base, same))
        held[r[key]] = start + r["n"], carry if r["end"] is None else r["end"], base + r["runs"] - (1 if same and r["runs"] else 0)
    borders = spark.createDataFrame(carried, f"_key {kinds[key]}, _part int, _start long, _carry {kinds[value]}, _base long, _same boolean")
    joined = local.join(F.broadcast(borders), F.col(key).eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    more = F.when(F.coalesce("_same", F.lit(False)) & (F.col("run") > 0), 1).otherwise(0)
    whole = {"place": F.col("place") + F.coalesce("_start", F.lit(0)), "filled": F.coalesce("filled", "_carry"), "run": F.coalesce("_base", F.lit(0)) + F.col("run") - more}
    return joined.withColumns(whole).select(*df.columns, "place", "filled", "run")
