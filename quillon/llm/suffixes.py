"""Repeated strings of a corpus by common-prefix interval trees over enhanced suffix arrays.

Goal: every string of MIN_BYTES bytes that starts at two or more places of the corpus.

1. Each such string holds exactly one anchor: the GRAM bytes in it whose hash is least (the last one, if
   tied). Equal strings have equal anchors, so only strings that share an anchor need to meet. The
   strings of one anchor are consecutive; together they are a segment of the document.
2. Anchors are counted as (hash, count); those found once end there. Equal segments become one, with the
   number of their places, so groups of copies shrink to one member before any text moves.
3. Segments of one anchor go to one task, which builds a suffix array over the starts of their strings
   by prefix doubling, takes common-prefix lengths from the doubling ranks, and scans them with a stack:
   an interval of suffixes that share MIN_BYTES or more is a maximal repeat if the bytes to the left of
   its suffixes differ (or a segment starts there). Its occurrences are all suffixes of the interval.
4. What the repeats cover goes back to all places of each segment, is merged per document and cut out.

An anchor with more than HOT distinct segments (a passage in very many surroundings) would be a group
without bound. Its segments are split: strings in which the anchor stands at nearly the same place share
more bytes than the anchor, and those bytes are a longer anchor of their own. Parts are made equal and
counted as in 2, those of one longer anchor meet as in 3, and what is still above HOT is split again, at
last into single strings, of which equal ones are one. Every string is thus solved by a suffix array.

Defined cases: a null text is the empty text; documents shorter than MIN_BYTES lose nothing; rows
repeated with the same id and text are different places, so both lose all that is long enough (their
text travels once); matches never span documents. An empty table gives no rows; long texts are cut in
strides; where documents come back, their own columns cannot clash with those used here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_rows, store, table

MIN_BYTES, GRAM = 200, 40
HOT = 512
#: Windows handled at once in one document; bounds memory for long texts.
STRIDE = 1 << 22
#: Segment bytes in one suffix array.
ARRAY_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 24) - 1)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64, to the powers 0 to n - 1."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the bytes at each place."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % width, ~np.uint64(0), np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def placed(h: np.ndarray) -> np.ndarray:
    """Hashes as anchors compare: by their upper bits, of equals the last one first; the place is in the lower bits."""
    return (h & ~PLACE) | (PLACE - np.arange(len(h), dtype=np.uint64))


def segments_of(text: bytes, length: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of each segment; starts of a segment follow one another."""
    n = len(text) - length + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, n, STRIDE):
        part = raw[at : min(len(raw), at + STRIDE + length - 1)]
        h = gram_hashes(part, gram)
        place = (PLACE - (sliding_min(placed(h), length - gram + 1) & PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        out.append((first + at, np.diff(np.append(first, len(place))), h[place[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# -- suffix array of a group of segments -------------------------------------------------------------


class SuffixArray:
    """Suffixes of ``segments`` that start at least ``length`` bytes before their segment's end, in order,
    with common-prefix lengths of neighbours. A prefix never reaches over its segment's end."""

    def __init__(self, segments: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(s) for s in segments], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        self.end = self.begin + sizes
        self.text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
        n = len(self.text)
        owner = np.repeat(np.arange(len(segments)), sizes + 1)
        self.left_over = self.end[owner] - np.arange(n)
        self.first = np.zeros(n, bool)
        self.first[self.begin] = True
        longest = int(sizes.max(initial=1))
        padded = np.concatenate([self.text, np.zeros(8, np.uint8)])
        valid = self.left_over
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | np.where(valid > k, padded[k : n + k], 0).astype(np.uint64)
        self.word = word
        self.ranks, width = [(8, self._rank(word))], 8
        while 3 * width < longest:
            self.ranks.append((3 * width, self._rank(self._triple(np.arange(n)))))
            width *= 3
        starts = np.flatnonzero(self.left_over >= length)
        self.order = starts[np.argsort(self._triple(starts))]  # the last step is needed for these alone
        self.common = self._common(self.order[:-1], self.order[1:])

    def _triple(self, places: np.ndarray) -> np.ndarray:
        """Sort keys for thrice the widest ranked prefix: three ranks of 21 bits, 0 where the segment has ended."""
        width, rank = self.ranks[-1]
        if len(self.text) >= 1 << 21:
            raise ValueError("too much text for one array")
        key = rank[places].astype(np.uint64)
        for k in (width, 2 * width):
            ahead = np.where(self.left_over[places] > k, rank[np.minimum(places + k, len(rank) - 1)] + 1, 0)
            key = (key << np.uint64(21)) | ahead.astype(np.uint64)
        return key

    @staticmethod
    def _rank(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, where it reaches ``length``; else something less."""
        every = np.zeros(len(a), np.int64)
        alive, last = np.arange(len(a)), len(self.text) - 1
        found, most = every.copy(), np.minimum(self.left_over[a], self.left_over[b])
        for width, rank in reversed(self.ranks):
            for _ in range(2 if width != self.ranks[-1][0] else 3):
                x, y = np.minimum(a + found, last), np.minimum(b + found, last)
                found = found + np.where((found < most) & (rank[x] == rank[y]), width, 0)
            hope = found + width > self.length  # what is left agrees on less than ``width`` more
            a, b, alive, found, most = a[hope], b[hope], alive[hope], found[hope], most[hope]
        differ = self.word[np.minimum(a + found, last)] ^ self.word[np.minimum(b + found, last)]
        for k in range(1, 8):
            found = found + ((found < most) & (differ >> np.uint64(64 - 8 * k) == 0))
        every[alive] = np.minimum(found, most)
        return every

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """(length, low, high): suffixes order[low] to order[high] are all occurrences of a maximal repeat."""
        # a different value for each place that starts a segment: what stands to its left is not known
        left = np.where(self.first, 256 + np.arange(len(self.text)), np.concatenate([[0], self.text[:-1].astype(np.int64)]))[self.order]
        long = np.concatenate([[False], self.common >= self.length, [False]])
        lows, highs = np.flatnonzero(~long[:-1] & long[1:]), np.flatnonzero(long[:-1] & ~long[1:])
        for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
            commons, lefts = self.common[low:high].tolist(), left[low : high + 1].tolist()
            stack: list[list[int]] = []  # [length, low, byte to the left or -1 if they differ]
            for i in range(len(commons) + 1):
                now = commons[i] if i < len(commons) else 0
                at, seen = i, lefts[i]
                while stack and stack[-1][0] > now:
                    length, start, byte = stack.pop()
                    byte = byte if byte == seen else -1
                    if byte == -1:
                        yield length, low + start, low + i
                    at, seen = start, byte
                if stack and stack[-1][0] == now:
                    if stack[-1][2] != seen:
                        stack[-1][2] = -1
                elif now:
                    stack.append([now, at, seen])

    def covered(self, whole: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per segment the stretches that maximal repeats cover; ``whole`` marks segments with several places."""
        reach = np.zeros(len(self.order), np.int64)
        for length, low, high in sorted(self.maximal_repeats()):
            reach[low : high + 1] = length
        edge = np.zeros(len(self.text) + 1, np.int64)
        hit = reach > 0
        np.add.at(edge, self.order[hit], 1)
        np.add.at(edge, self.order[hit] + reach[hit], -1)
        np.add.at(edge, self.begin[whole], 1)
        np.add.at(edge, self.end[whole], -1)
        inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
        lows, highs = np.flatnonzero(~inside[:-1] & inside[1:]), np.flatnonzero(inside[:-1] & ~inside[1:])
        owner = np.searchsorted(self.begin, lows, side="right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.begin]
        for k, a, b in zip(owner.tolist(), lows.tolist(), highs.tolist(), strict=True):
            out[k].append((a - int(self.begin[k]), b - int(self.begin[k])))
        return out


# -- Spark stages ------------------------------------------------------------------------------------

ANCHORS = "d long, k long, start int, n_starts int, anchor long, same long"


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, d, k, raw: d and k (id and hash of id and text) name a row by its content, so that names do
    not change when a lost task is run again. Equal rows have equal names."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return documents.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(doc_id, raw, F.octet_length(raw)).alias("k"), raw.cast("binary").alias("raw"))


def _long_list(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64())


def anchor_counts(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, n): segments of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                found = [segments_of(raw, length, gram)[2] for raw in batch.column(0).slice(at, SLICE_ROWS).to_pylist()]
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return rows.select("raw").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Every segment: its document's name, place, anchor and content hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                d, k, raws = (c.slice(at, SLICE_ROWS).to_pylist() for c in batch.columns)
                found = [segments_of(raw, length, gram) for raw in raws]
                sizes = [len(f[0]) for f in found]
                if not sum(sizes):
                    continue
                start, n, anchor = (np.concatenate([f[i] for f in found]) for i in range(3))
                same = [xxhash.xxh64_intdigest(raw[a : a + m + length - 1]) for raw, (s, c, _) in zip(raws, found, strict=True) for a, m in zip(s.tolist(), c.tolist(), strict=True)]
                name = [np.repeat(np.array(x, np.int64), sizes) for x in (d, k)]
                yield pa.RecordBatch.from_arrays(
                    [_long_list(name[0]), _long_list(name[1]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), _long_list(anchor), _long_list(np.array(same, np.uint64).view(np.int64))],
                    names=["d", "k", "start", "n_starts", "anchor", "same"],
                )

    return rows.select("d", "k", "raw").mapInArrow(run, ANCHORS)


def cut_out(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of segments from documents with lists of the segments that they stand for."""

    def fn(rows: list[tuple]) -> Iterator[tuple]:
        for raw, starts, counts, anchor, same, places, hot in rows:
            for a, m, g, s, n, many in zip(starts, counts, anchor, same, places, hot, strict=True):
                yield g, s, n, many, raw[a : a + m + length - 1]

    return map_rows(joined, fn, "anchor long, same long, places long, hot boolean, payload binary")


def split_by_context(segments: DataFrame, width: int, length: int, gram: int) -> DataFrame:
    """Parts (anchor, same, places, at, payload, of_anchor, of_same, shift) of segments (anchor, same, places, at, payload).

    A part holds the strings in which the old anchor stands at a place of one cell of ``width`` places; the bytes that
    all strings of the cell share, whatever the segment, are the part's anchor. So equal strings have equal anchors
    again. ``at`` is the place of the old anchor in the first string, null if not known yet."""
    last = length - gram

    def fn(rows: list[tuple]) -> Iterator[tuple]:
        for anchor, same, places, at, payload in rows:
            if at is None:
                at = int(placed(gram_hashes(np.frombuffer(payload[:length], np.uint8), gram)).argmin())
            i, n = 0, len(payload) - length + 1
            while i < n:
                low = (at - i) // width * width
                high, end = min(low + width - 1, last), min(n, at - low + 1)
                context, part = payload[at - low : at - high + length], payload[i : end - 1 + length]
                names = (xxhash.xxh3_64_intdigest(context, low), xxhash.xxh64_intdigest(part))
                yield *(x - (1 << 64) if x >> 63 else x for x in names), places, at - i, part, anchor, same, i
                i = end

    return map_rows(segments.select("anchor", "same", "places", "at", "payload"), fn, "anchor long, same long, places long, at int, payload binary, of_anchor long, of_same long, shift int")


def repeats_of_hot(segments: DataFrame, widths: list[int], length: int, gram: int, hot: int) -> DataFrame:
    """As repeats_of, for segments (with ``at``) of anchors that have more than ``hot`` of them."""
    parts = store(split_by_context(segments, widths[0], length, gram), "segments-parts")
    distinct = store(parts.groupBy("anchor", "same").agg(F.sum("places").alias("places"), F.first("at").alias("at"), F.first("payload").alias("payload")), "segments-distinct")
    sizes = store(distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("places").alias("m")).filter("m > 1").select("anchor", "n"), "anchors-sizes")
    large = (F.col("n") > hot) & F.lit(len(widths) > 1)
    found = repeats_of(distinct.join(sizes.filter(~large), "anchor"), length)
    if sizes.filter(large).limit(1).count():
        found = found.unionByName(repeats_of_hot(distinct.join(sizes.filter(large), "anchor"), widths[1:], length, gram, hot))
    found = store(found, "segments-covered")
    shift = F.col("shift")
    return parts.drop("payload").join(found, ["anchor", "same"]).select(F.col("of_anchor").alias("anchor"), F.col("of_same").alias("same"), (F.col("low") + shift).alias("low"), (F.col("high") + shift).alias("high"))


def repeats_of(segments: DataFrame, length: int) -> DataFrame:
    """(anchor, same, low, high): what maximal repeats cover of each distinct segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            cover = SuffixArray([r[3] for r in rows], length).covered(np.array([r[2] > 1 for r in rows]))
            out = [(r[0], r[1], a, b) for r, spans in zip(rows, cover, strict=True) for a, b in spans]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["anchor", "same", "low", "high"])

        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= ARRAY_BYTES and row[0] != rows[-1][0]:  # anchors stay whole
                    yield solve(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        if rows:
            yield solve(rows)

    return segments.select("anchor", "same", "places", "payload").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, same long, low int, high int")


def one_of_each(rows: DataFrame) -> DataFrame:
    """keyed() rows with each name once."""
    again = store(rows.groupBy("d", "k").agg(F.count("*").alias("n")).filter("n > 1").select("d", "k"), "names-again")
    if not again.limit(1).count():
        return rows.select("d", "k", "raw")
    twice = rows.join(again, ["d", "k"], "left_semi").groupBy("d", "k").agg(F.first("raw").alias("raw"))
    return rows.join(again, ["d", "k"], "left_anti").select("d", "k", "raw").unionByName(twice)


def repeat_spans(rows: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(d, k, low, high): stretches of keyed() rows covered by strings that start elsewhere too; they may overlap."""
    twice = store(anchor_counts(rows, length, gram).filter("n > 1").select("anchor"), "anchors-twice")
    shared = store(anchors(rows, length, gram).join(twice, "anchor"), "anchors-shared")
    distinct = shared.groupBy("anchor", "same").agg(F.count("*").alias("places"), F.min(F.struct("d", "k", "start", "n_starts")).alias("at"))
    distinct = store(distinct.select("anchor", "same", "places", "at.*"), "segments-distinct")
    many = store(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor"), "anchors-hot")
    cold, warm = (distinct.join(many, "anchor", how).withColumn("hot", F.lit(how == "left_semi")) for how in ("left_anti", "left_semi"))
    lists = cold.unionByName(warm).groupBy("d", "k").agg(F.collect_list(F.struct("start", "n_starts", "anchor", "same", "places", "hot")).alias("s"))
    joined = one_of_each(rows).join(lists, ["d", "k"]).select("raw", "s.start", "s.n_starts", "s.anchor", "s.same", "s.places", "s.hot")
    cut = store(cut_out(joined, length), "segments-cut")
    covered = repeats_of(cut.filter("not hot"), length)
    if many.limit(1).count():
        places = length - gram + 1
        widths = [max(1, round(places ** (2 / 3))), max(1, round(places ** (1 / 3))), 1]
        covered = covered.unionByName(repeats_of_hot(cut.filter("hot").withColumn("at", F.lit(None).cast("int")), widths, length, gram, hot))
    covered = store(covered, "segments-covered")
    return shared.join(covered, ["anchor", "same"]).select("d", "k", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))


def merged(spans: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching stretches as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def with_spans(rows: DataFrame, keyed_rows: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """``rows`` (with d and k) and the lists low, high of their repeated stretches, null if there are none."""
    spans = store(repeat_spans(keyed_rows, length, gram, hot), "spans").groupBy("d", "k").agg(F.collect_set(F.struct("low", "high")).alias("s"))
    return rows.join(spans, ["d", "k"], "left").withColumns({"low": F.col("s.low"), "high": F.col("s.high")}).drop("d", "k", "s")


def remove_repeats(documents: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    rows = keyed(documents)
    joined = with_spans(rows, rows, length, gram, hot).select("doc_id", "raw", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for doc_id, raw, low, high in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in batch.columns), strict=True):
                    spans = merged(zip(low or (), high or (), strict=True))
                    out.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), without(raw, spans)))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def strip_repeats(documents: DataFrame, length: int = MIN_BYTES, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The documents with repeated stretches cut out of ``text`` and ``n_chars`` counted anew; all rows stay. A
    character of which only some bytes are cut goes whole. Other columns are as they were."""
    names, schema = documents.columns, documents.schema
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # whole rows travel as one column, so no name of theirs can clash
    named = documents.select(F.struct("*").alias("row"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("d"), F.xxhash64(doc_id, raw, F.octet_length(raw)).alias("k"))
    joined = with_spans(named, keyed(documents), length, gram, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.column(0).flatten()
            low, high = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = [t if not a else without(t.encode(), merged(zip(a, b, strict=True))).decode("utf-8", "ignore") for t, a, b in zip(cols[text].to_pylist(), low, high, strict=True)]
            if count is not None:
                kind = cols[count].type
                cols[count] = pa.array([n if not a else len(t) for n, t, a in zip(cols[count].to_pylist(), texts, low, strict=True)], kind)
            cols[text] = pa.array(texts, cols[text].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select("row", "low", "high").mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
