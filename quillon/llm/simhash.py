"""SimHash fingerprints and near-duplicate classes by bit-sliced comparison.

Only distinct fingerprints are compared. Those within radius 2 agree on at least two of four 16-bit
blocks, so each is filed under the six pairs of blocks. A file of more than GROUP_MAX members is filed
again by pairs of four 8-bit blocks of the rest, which leaves 16 free bits: at most 65,536 members, as
they are distinct. So every group that a task compares has a proven bound, and no pair within the radius
is lost.

In a group the fingerprints lie vertically, one bit plane after another, 64 members to a machine word. A
carry-save counter adds the planes in which members and query differ; it starts so that it overflows
just when a distance exceeds the radius, and each block of 64 lanes is abandoned by itself once all its
lanes have overflowed.
A task unites what it finds and emits a star for each set, never all pairs.

Defined cases: a null or wordless text has fingerprint zero, linked like any other; texts of fewer than
three words have one shingle; rows with equal ids share a class only if their fingerprints link; null
ids get a class whose id is the smallest id in it, null if there is none. An empty table gives no rows; other columns are not
read, so their names may clash; long texts are hashed in spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_words, map_rows, store, table
from .components import connected_components

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
GROUP_MAX, SMALL = 4096, 32
PAIRS = list(combinations(range(4), 2))


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles, repeats included."""
    words = byte_words(text)
    if not words:
        return 0
    joined, width = b" ".join(words), min(SHINGLE_WORDS, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts[at : min(n, at + (1 << 15))], ends[at + width - 1 :], strict=False)], np.uint64)
        counts += bits_of(hashes).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def bits_of(values: np.ndarray) -> np.ndarray:
    """(n, 64 x words) of 0 and 1, lowest bit first, of (n,) or (n, words)."""
    return np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little")


def planes_of(values: np.ndarray) -> np.ndarray:
    """(bits, blocks): plane k holds bit k of 64 values in each machine word."""
    bits = bits_of(values)
    bits = np.vstack([bits, np.zeros((-len(bits) % 64, bits.shape[1]), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


FULL = ~np.uint64(0)


def count_planes(plane: Callable[[int, np.ndarray], np.ndarray], n_planes: int, over: np.ndarray, radius: int, every: int = 4) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Adds up planes for blocks of 64 lanes by carry-save counters that overflow just when a count passes ``radius``.

    ``plane(k, blocks)`` gives plane k of the named blocks; lanes set in ``over`` count as beyond from the start.
    Each ``every`` planes the blocks of which all lanes have overflowed are abandoned, each by itself. Returns the
    blocks that are left, their lanes beyond the radius, and their counters."""
    n_counters = radius.bit_length()
    start = (1 << n_counters) - 1 - radius
    blocks = np.flatnonzero(over != FULL)
    over = over[blocks]
    counters = [np.full_like(over, FULL if start >> k & 1 else 0) for k in range(n_counters)]
    for k in range(n_planes):
        carry = plane(k, blocks)
        for c in range(n_counters):
            counters[c], carry = counters[c] ^ carry, counters[c] & carry
        over |= carry
        if k % every == every - 1:
            live = over != FULL
            if not live.all():
                blocks, over, counters = blocks[live], over[live], [c[live] for c in counters]
                if not len(blocks):
                    break
    return blocks, over, counters


def near_lanes(blocks: np.ndarray, over: np.ndarray, counters: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, lane, distance) of the lanes within the radius."""
    row, lane = np.nonzero(lanes(~over[:, None]))
    value = np.zeros(len(row), np.int64)
    for k, c in enumerate(counters):
        value |= (c[row] >> lane.astype(np.uint64) & np.uint64(1)).astype(np.int64) << k
    return blocks[row], lane, value - ((1 << len(counters)) - 1 - radius)


def lanes(words: np.ndarray) -> np.ndarray:
    """0/1 for each lane of a row of words."""
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")


def close_pairs(values: np.ndarray, radius: int = RADIUS, queries: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j and distances of all pairs within the radius, in one group."""
    planes, n = planes_of(values), len(values)
    words, place = planes.shape[1], np.arange(planes.shape[1] * 64)
    found = []
    for at in range(0, n, queries):
        asked = np.arange(at, min(n, at + queries))
        first = at // 64  # only members at or after the queries
        wide = words - first
        beyond = (place[None, first * 64 :] <= asked[:, None]) | (place[None, first * 64 :] >= n)
        over = np.ascontiguousarray(np.packbits(beyond, axis=1, bitorder="little")).view("<u8").ravel()
        flips = np.where(bits_of(values[asked]).T.astype(bool), FULL, np.uint64(0))
        query, word = np.divmod(np.arange(len(over)), wide)
        left = count_planes(lambda k, b, f=flips, q=query, w=word, first=first: planes[k, first + w[b]] ^ f[k, q[b]], len(planes), over, radius)
        block, lane, distance = near_lanes(*left, radius)
        found.append((asked[query[block]], (first + word[block]) * 64 + lane, distance))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cross_pairs(asked: np.ndarray, values: np.ndarray, radius: int = RADIUS, queries: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i in ``asked`` and j in ``values`` and distances of all pairs within the radius, between two groups."""
    planes = planes_of(values)
    words = planes.shape[1]
    beyond = (np.arange(words * 64) >= len(values)).astype(np.uint8)
    last = np.packbits(beyond, bitorder="little").view("<u8")
    found = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(asked), queries):
        part = asked[at : at + queries]
        flips = np.where(bits_of(part).T.astype(bool), FULL, np.uint64(0))
        query, word = np.divmod(np.arange(len(part) * words), words)
        left = count_planes(lambda k, b, f=flips, q=query, w=word: planes[k, w[b]] ^ f[k, q[b]], len(planes), np.tile(last, len(part)), radius)
        block, lane, distance = near_lanes(*left, radius)
        found.append((at + query[block], word[block] * 64 + lane, distance))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def small_pairs(values: np.ndarray, group: np.ndarray, radius: int = RADIUS, most: int = SMALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As close_pairs, for many groups of at most ``most`` members at once; ``group`` ascends."""
    found = [(np.empty(0, np.int64),) * 3]
    for lag in range(1, most):
        i = np.nonzero(group[lag:] == group[:-lag])[0] if lag < len(group) else np.empty(0, np.int64)
        if not len(i):
            break
        for at in range(0, len(i), 1 << 14):
            part = i[at : at + (1 << 14)]
            planes = planes_of(values[part] ^ values[part + lag])
            over = np.zeros(planes.shape[1], np.uint64)
            over[-1:] = FULL << np.uint64(len(part) % 64) if len(part) % 64 else 0
            block, lane, distance = near_lanes(*count_planes(lambda k, b, p=planes: p[k, b], len(planes), over, radius), radius)
            place = part[block * 64 + lane]
            found.append((place, place + lag, distance))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def stars(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One edge for each value that is not the least of its set of linked values."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up] if up in root else up
        return x

    for x, y in zip(values[i].tolist(), values[j].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    out = [(find(x), x) for x in list(root) if find(x) != x]
    return np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of groups (table, key) whose rows come one group after another."""

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(bounds, len(key)))
        group = np.repeat(np.arange(len(bounds)), sizes)
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        unsigned = fp.view(np.uint64)
        place = np.flatnonzero(small)
        i, j, _ = small_pairs(unsigned[place], group[place])
        parts_i, parts_j = [place[i]], [place[j]]
        for g in np.flatnonzero(sizes > SMALL):
            i, j, _ = close_pairs(unsigned[bounds[g] : bounds[g] + sizes[g]])
            parts_i.append(i + bounds[g])
            parts_j.append(j + bounds[g])
        a, b = stars(fp, np.concatenate(parts_i), np.concatenate(parts_j))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held.append((np.stack(cols[:-1], axis=1), cols[-1]))
        n_held += batch.num_rows
        if n_held < 1 << 16:
            continue
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1  # the last group may go on
        if last:
            yield solve(key[:last], fp[:last])
        held, n_held = [(key[last:], fp[last:])], len(fp) - last
    if n_held:
        key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        yield solve(key, fp)


def link_edges(fingerprints: DataFrame, group_max: int = GROUP_MAX) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` linked within the radius."""

    def masked(mask: int):
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    def block(k: int, width: int, base: int = 0) -> int:
        return ((1 << width) - 1) << (base + k * width)

    filed = store(
        fingerprints.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), masked(block(p, 16) | block(q, 16)).alias("key")) for t, (p, q) in enumerate(PAIRS)))).alias("f")).select("f.t", "f.key", "fp"),
        "simhash-files",
    )
    sizes = store(filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    members = filed.join(sizes, ["t", "key"])
    cold = members.filter(F.col("n") <= group_max).select(F.col("t"), F.lit(-1).alias("u"), "key", "fp")
    again = []
    for t, (p, q) in enumerate(PAIRS):
        rest = [r for r in range(4) if r not in (p, q)]
        quarters = [block(h, 8, 16 * r) for r in rest for h in range(2)]
        again += [F.struct(F.lit(t).alias("t2"), F.lit(u).alias("u"), masked(block(p, 16) | block(q, 16) | quarters[x] | quarters[y]).alias("key2")) for u, (x, y) in enumerate(PAIRS)]
    hot = members.filter(F.col("n") > group_max).select("t", "fp", F.explode(F.array(*again)).alias("f")).filter("f.t2 = t").select("t", "f.u", F.col("f.key2").alias("key"), "fp")
    grouped = cold.unionByName(hot).repartition("t", "u", "key").sortWithinPartitions("t", "u", "key", "fp")
    return grouped.mapInArrow(_edges, "a long, b long")


def simhash_classes(documents: DataFrame) -> DataFrame:
    """doc_id, k (hash of id and text), fp, label (one fingerprint of the class), component_id of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    prints = store(map_rows(rows, lambda part: [(i, k, fingerprint(t)) for i, t, k in part], "doc_id long, k long, fp long"), "simhash")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    edges = store(link_edges(distinct.select("fp")), "simhash-edges")
    labels = connected_components(edges)
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    labelled = store(labelled, "simhash-labelled")
    least = store(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "simhash-least")
    classes = store(labelled.join(least, "label").select("fp", "label", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "k", "fp", "label", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
