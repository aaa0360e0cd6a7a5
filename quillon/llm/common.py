"""Shared helpers of the training-data operators: stored stages, Arrow mapping, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import BATCH_ROWS, bound_batches, new_path, spread, staged  # noqa: F401

#: Rows handed to a per-batch function at once; keeps a slice of long texts small.
SLICE_ROWS = 256
#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_SPACE = " \t\n\v\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
_BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Tables of long texts, on which work by row outweighs reading.
TEXTS = {"documents", "pages", "conversations"}


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: its lineage ends there, and lost executors cost only a reread."""
    bound_batches(df.sparkSession)
    return staged(df, name)


#: Rows up to which the small side of a join may be broadcast, once they are counted.
BROADCAST_ROWS = 500_000


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of narrow rows with a hint to broadcast it if it has few ``rows``."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def map_rows(df: DataFrame, fn: Callable[[list[tuple]], Iterator[tuple] | list[tuple]], schema: str) -> DataFrame:
    """``fn`` turns a slice of at most SLICE_ROWS input tuples into output tuples of ``schema``."""
    spark = df.sparkSession
    bound_batches(spark)
    out = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in spark.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = iter(fn(list(zip(*(c.to_pylist() for c in part.columns), strict=True))))
                while rows := list(islice(made, BATCH_ROWS)):
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def lower_ascii(text) -> object:
    """Column: A-Z to a-z, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def byte_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() cuts at exactly these six characters."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(_BYTES_LOWER) if lower else raw).split()


def doc_fold(doc_id, folds: int = 5):
    """Column: crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df
