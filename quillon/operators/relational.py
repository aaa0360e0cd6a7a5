"""Relational building blocks: optional filters, paging, lookups, set operations, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def where_given(df: DataFrame, **conditions: tuple[Column, object]) -> DataFrame:
    """Keeps rows that meet every condition whose value is not None; each is (column, value). Names ending in
    ``_contains`` test for a substring, those ending in ``_in`` for membership."""
    for name, (column, value) in conditions.items():
        if value is None:
            continue
        if name.endswith("_contains"):
            df = df.filter(column.contains(value))
        elif name.endswith("_in"):
            df = df.filter(column.isin(list(value)))
        else:
            df = df.filter(column == F.lit(value))
    return df


def same_scope(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of scope columns: a null matches only a null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of page ``number`` (from 1) in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def cursor_page(messages: DataFrame, before_id: int | None, size: int, id_col: str = "id") -> DataFrame:
    """The newest ``size`` rows below a cursor, oldest first, with has_more."""
    older = messages if before_id is None else messages.filter(F.col(id_col) < before_id)
    got = older.orderBy(F.desc(id_col)).limit(size + 1)
    place = F.row_number().over(W.orderBy(F.desc(id_col)))  # over at most size + 1 rows
    got = got.withColumn("place", place)
    return got.withColumn("has_more", F.max("place").over(W.partitionBy()) > size).filter(F.col("place") <= size).drop("place").orderBy(id_col)


def counts_by(df: DataFrame, key: str, values: list) -> DataFrame:
    """One row: rows for each of the fixed values of the key, 0 if absent, and in all (other values included)."""
    return df.agg(*(F.count_if(F.col(key) == F.lit(v)).alias(f"n_{v}") for v in values), F.count("*").alias("total"))


def queue_backlog(jobs: DataFrame, now: Column) -> DataFrame:
    """Per stage: jobs, oldest creation time and its wait in seconds, never below 0."""
    by = jobs.groupBy("stage").agg(F.count("*").alias("n_jobs"), F.min("created_at").alias("oldest"))
    return by.withColumn("wait_s", F.greatest(F.unix_seconds(now) - F.unix_seconds(F.col("oldest").cast("timestamp")), F.lit(0)))


def with_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with their citations as an array in order of rank."""
    listed = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("citations"))
    return messages.join(listed, messages["id"] == listed["message_id"], "left").drop("message_id")


def latest_before(events: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Each row with the last non-null ``value`` of earlier rows of its key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn(name, F.last(value, ignorenulls=True).over(w))


def recent_turns(messages: DataFrame, turns: int = 6, long: int = 500, keep: int = 400, mark: str = "…") -> DataFrame:
    """The last 2 x ``turns`` messages of each conversation in order; long assistant texts are cut."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    short = F.when((F.col("role") == "assistant") & (F.length("text") > long), F.concat(F.substring("text", 1, keep), F.lit(mark))).otherwise(F.col("text"))
    return messages.withColumn("place", place).filter(F.col("place") <= 2 * turns).withColumn("text", short).drop("place")


def queued_ahead(jobs: DataFrame) -> DataFrame:
    """Queued jobs with the number of queued jobs of smaller id. Ranks are made per range of ids and offset by the
    counts of the ranges before, so no single task sees the whole queue."""
    queued = jobs.filter("stage = 'queued'")
    width = 1 << 16
    ranged = queued.withColumn("bucket", F.floor(F.col("id") / width))
    sizes = ranged.groupBy("bucket").agg(F.count("*").alias("k"))
    before = sizes.withColumn("offset", F.coalesce(F.sum("k").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inside = F.row_number().over(W.partitionBy("bucket").orderBy("id")) - 1
    return ranged.withColumn("inside", inside).join(before, "bucket").withColumn("ahead", (F.col("inside") + F.col("offset")).cast("long")).drop("bucket", "inside", "offset")


def evict_oldest(entries: DataFrame, scope: list[str], cap: int, share: float = 0.2) -> DataFrame:
    """Entries less the oldest ``share`` of cap in each scope that has reached its cap."""
    total = F.count("*").over(W.partitionBy(*scope))
    age = F.row_number().over(W.partitionBy(*scope).orderBy("updated_at", "id"))
    kill = max(1, int(cap * share))
    return entries.withColumns({"total": total, "age": age}).filter((F.col("total") < cap) | (F.col("age") > kill)).drop("total", "age")


def dotted_key(number: Column) -> Column:
    """Sort key of a dotted number: its parts as integers."""
    return F.transform(F.filter(F.split(number, r"\."), lambda x: x != ""), lambda x: x.cast("int"))
