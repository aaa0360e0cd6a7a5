"""Which texts contain which others, without comparing all with all.

Each pattern is filed under its rarest pair of neighbouring characters, by how many texts have that pair; texts
meet the patterns filed under the pairs they have. A text that contains a pattern has all of its pairs, so nothing
is lost, and a frequent pair is a key only for patterns that have no rarer one, such as those of two characters,
for which every meeting is a match.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import grams
from ..staging import bound_batches, small, staged

#: Patterns up to which texts are scanned for all of them at once, and bytes of text scanned in one step.
SCANNED, STEP = 20_000, 1 << 20


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern), each once, of texts (text) that contain patterns (pattern) of two characters or more."""
    held = staged(texts.select("text").filter("length(text) >= 2").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram")), "text-pairs")
    return held.join(small(_filed(held, patterns)), "gram").filter(F.contains("text", "pattern")).select("text", "pattern")


def holders(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, pattern), each once, as containing() for long texts (id, text), equal ids being one text: only their ids travel with
    their pairs of characters, and a text is read once more for the patterns it may hold."""
    held = staged(texts.select("id", F.explode(grams(F.col("text"))).alias("gram")), "text-pairs")
    met = held.join(small(_filed(held, patterns)), "gram").select("id", "pattern")
    return texts.select("id", "text").join(met, "id").filter(F.contains("text", "pattern")).select("id", "pattern").distinct()


class _Windows:
    """Patterns of at least ``width`` bytes, each filed under one of its windows of that width, the one that fewest of them share."""

    def __init__(self, patterns: list[bytes], width: int):
        self.width, self.patterns = width, patterns
        shared = Counter(w for p in patterns for w in {p[i : i + width] for i in range(len(p) - width + 1)})
        self.offset = np.array([min(range(len(p) - width + 1), key=lambda i: shared[p[i : i + width]]) for p in patterns])
        self.length = np.array([len(p) for p in patterns])
        key = np.array([int.from_bytes(p[o : o + width], "little") for p, o in zip(patterns, self.offset, strict=True)], np.uint64)
        self.order = np.argsort(key, kind="stable")
        self.keys, self.first, self.count = np.unique(key[self.order], return_index=True, return_counts=True)
        edge = lambda part: np.array([list(p[part]) for p in patterns], np.uint8)
        self.head, self.tail = edge(slice(None, width)), edge(slice(-width, None))
        self.seen = np.zeros(1 << 18, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def found(self, windows: np.ndarray, start: int, data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, pattern, position) of places whose windows at either end and in between fit; ``windows`` begin at ``start``."""
        near = np.flatnonzero(self.seen[self._slot(windows)])
        place = np.minimum(np.searchsorted(self.keys, windows[near]), len(self.keys) - 1)
        own = self.keys[place] == windows[near]
        near, place = near[own] + start, place[own]
        for a in range(0, len(near), 4096):
            at, group = near[a : a + 4096], place[a : a + 4096]
            n = self.count[group]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pattern = self.order[np.repeat(self.first[group], n) + nth]
            at = np.repeat(at, n)
            row = np.searchsorted(bounds, at, "right") - 1
            begin = at - self.offset[pattern]
            end = begin + self.length[pattern]
            fits = (begin >= bounds[row]) & (end <= bounds[row + 1])
            row, pattern, begin, end = row[fits], pattern[fits], begin[fits], end[fits]
            wide = np.arange(self.width)
            same = (data[begin[:, None] + wide] == self.head[pattern]).all(axis=1) & (data[(end - self.width)[:, None] + wide] == self.tail[pattern]).all(axis=1)
            yield row[same], pattern[same], begin[same]


def scanned(texts: DataFrame, patterns: list[str]) -> DataFrame:
    """(id, pattern), each once, of texts (id, text) that contain patterns, of which there are at most SCANNED, none of them empty.
    A task reads its texts as bytes once; where a window of eight bytes (or four, two, one for shorter patterns) is one of a
    pattern, the pattern is compared. Nothing but the matches is shuffled."""
    spark = texts.sparkSession
    bound_batches(spark)
    schema = f"id {dict(texts.dtypes)['id']}, pattern string"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    shared = spark.sparkContext.broadcast([p.encode() for p in patterns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = lambda p: min(8, 1 << (len(p).bit_length() - 1))
        classes = [_Windows(own, w) for w in (1, 2, 4, 8) if (own := [p for p in shared.value if width(p) == w])]
        for batch in batches:
            if not batch.num_rows:
                continue
            text = pa.concat_arrays([batch.column(1).cast(pa.large_binary()).fill_null(b"")])
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[: bounds[-1]]
            hits: set[tuple[int, bytes]] = set()
            ids, codes = batch.column(0), batch.column(0).dictionary_encode()
            code = codes.indices.fill_null(-1).to_numpy()
            for start in range(int(bounds[0]), len(data), STEP):
                w = {1: data[start : start + STEP + 7].astype(np.uint64)}
                for n in (1, 2, 4):
                    w[2 * n] = w[n][:-n] | (w[n][n:] << np.uint64(8 * n))
                for c in classes:
                    for rows, which, begins in c.found(w[c.width][:STEP], start, data, bounds):
                        for row, k, begin in zip(code[rows].tolist(), which.tolist(), begins.tolist(), strict=True):
                            p = c.patterns[k]
                            if (row, p) not in hits and data[begin : begin + len(p)].tobytes() == p:
                                hits.add((row, p))
            if hits:
                rows, found = zip(*hits, strict=True)
                names = codes.dictionary.take(pa.array([None if r < 0 else r for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([names.cast(ids.type), pa.array([p.decode() for p in found], pa.string())], schema=out)

    return texts.select("id", "text").mapInArrow(run, schema).distinct()


def _filed(held: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, gram): each pattern's rarest pair of characters among those ``held``."""
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = patterns.select("pattern").filter("length(pattern) >= 2").distinct().select("pattern", F.explode(grams(F.col("pattern"))).alias("gram"))
    # a pattern with a pair that no text has is in none of them
    rated = own.join(often, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rated.groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("x")).filter("x.n > 0").select("pattern", F.col("x.gram").alias("gram"))
