"""Near-duplicate classes by the Jaccard similarity of 5-word shingles, searched by bit-sliced SimHash.

1. Each document's set of distinct 5-word shingles gets a SimHash of BITS bits and BANDS keys, each of
   BAND_ROWS min-hashes. Equal sets become one at once. Sets of similarity 0.8 share none of the keys with
   a chance of 1 in 100,000.
2. Members of one key are compared by their fingerprints as bit planes (simhash.count_planes). At similarity
   0.8 fingerprints differ in 39 bits on average, with a deviation of 6; RADIUS lies over six deviations above
   that, and as far below the 128 bits of unrelated sets. A task emits a forest of the closest pairs, which are
   verified by the exact similarity of both sets and connected; a key of more than CHUNK members is dealt out
   in chunks for that.
3. No link is lost where a forest's pair fails: keys whose members are still in several classes are compared once
   more, and of every pair within the radius that lies between classes both members are handed to a task that
   verifies the pair with their shingles. Of the keys that a pair shares the least one answers for it. A key of
   many members is cut into blocks of about CHUNK, and those outside its largest class meet all blocks, a block
   being one row: a key of n members, o of them outside, makes (o / CHUNK) x (n / CHUNK) pairs of blocks, and
   no pair of documents becomes a row but a verified link that connects two classes of a task.

Defined cases: null and wordless texts have the empty set and are one class; a text of fewer than five words
is one shingle; repeated rows are one set; null ids come first where the least id stays; an empty table has no
classes; long texts are sketched in spans of SPAN shingles, and blocks are cut by shingles, not by members alone;
columns of the documents pass through in a struct, so their names may clash with those used here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_words, map_rows, maybe_broadcast, store
from .components import connected_components
from .simhash import SMALL, bits_of, close_pairs, cross_pairs, small_pairs

SHINGLE_WORDS = 5
#: A link: at least 4/5 of the shingles of two sets are in both.
SHARE = (4, 5)
BITS, RADIUS = 256, 76
BANDS, BAND_ROWS = 16, 3
CHUNK = 1024
#: A set weighs 1 and 1 more for each so many shingles, when blocks are cut.
WEIGHT_SHINGLES = 512
#: Distances that count as equally close, up to each bound; 39 is similarity 0.8 on average.
STEPS = np.array([24, 32, 39, 46])
#: Shingles sketched at once; bounds memory for long texts.
SPAN = 1 << 13
_RNG = np.random.default_rng(20)
_FLIP, _TIMES = (_RNG.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)[:, None] for _ in range(2))
_TIMES = _TIMES << np.uint64(1) | np.uint64(1)


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    words = byte_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    """(n, words) of independent hash words."""
    x = h[:, None] + np.arange(BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch(text: str | None) -> tuple[int, list[int], list[int], int]:
    """Name of the shingle set, its fingerprint as signed 64-bit words, its keys (none for the empty set), and its weight."""
    h = shingle_set(text)
    name = xxhash.xxh3_64_intdigest(h.tobytes())
    counts, least = np.zeros(BITS, np.int64), np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(h), SPAN):
        part = h[at : at + SPAN]
        counts += bits_of(_mixed(part)).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[None] ^ _FLIP) * _TIMES).min(axis=1))
    fp = np.packbits(2 * counts > len(h), bitorder="little").view("<i8").tolist()
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = [xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)] if len(h) else []
    return _signed(name), fp, [_signed(k) for k in keys], 1 + len(h) // WEIGHT_SHINGLES


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def closest_tree(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """(child, parent) of a forest of pairs in low STEPS of distance that connects what the pairs connect; each member is
    child once at most. Of parents in one step the first is taken, so that many groups name the same pair."""
    far = np.int32(len(STEPS) + 1) * np.int32(n)
    apart = np.full((n, n), far, np.int32)
    apart[i, j] = apart[j, i] = np.searchsorted(STEPS, d).astype(np.int32) * np.int32(n)
    best, parent, waits = np.full(n, far, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)
    out = []
    for _ in range(n):
        v = int((best + waits).argmin())  # members already in the forest wait behind all others
        if best[v] < far:
            out.append((v, int(parent[v])))
        waits[v] = 2 * far
        offer = np.where(apart[v] < far, apart[v] + np.int32(v), far)
        closer = (offer < best) & (waits == 0)
        parent[closer] = v
        best[closer] = offer[closer]
    return out


def closest_links(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """As closest_tree, for the pairs i < j of many small groups: pairs in order of step and place, less those that join nothing."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    order = np.lexsort((j, i, np.searchsorted(STEPS, d)))
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((y, x))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the groups (key, salt), whose rows (key, salt, s, fp) come one group after another."""

    def solve(key: np.ndarray, s: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(bounds, len(key)))
        place = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        i, j, d = small_pairs(fp[place], np.repeat(np.arange(len(bounds)), sizes)[place], RADIUS)
        links = closest_links(place[i], place[j], d)
        for g in np.flatnonzero(sizes > SMALL):
            at = int(bounds[g])
            links += [(at + v, at + u) for v, u in closest_tree(int(sizes[g]), *close_pairs(fp[at : at + sizes[g]], RADIUS))]
        child, parent = (s[np.array(x, np.int64)] for x in (zip(*links, strict=True) if links else ([], [])))
        return pa.RecordBatch.from_arrays([pa.array(child), pa.array(parent)], names=["child", "parent"])

    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]]
        held.append((np.stack(cols[:2], axis=1), cols[2], _prints(batch.column(3))))
        n_held += batch.num_rows
        if n_held < 1 << 14:
            continue
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = int(np.flatnonzero((parts[0] != parts[0][-1]).any(axis=1)).max(initial=-1)) + 1  # the last group may go on
        if last:
            yield solve(*(p[:last] for p in parts))
        held, n_held = [tuple(p[last:] for p in parts)], len(parts[0]) - last
    if n_held:
        yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _prints(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)


def filed(sets: DataFrame) -> DataFrame:
    """key, s, weight, n of the sets under each key that several have."""
    each = sets.select("s", "weight", F.explode("keys").alias("key"))
    sizes = each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return each.join(sizes, "key").select("key", "s", "weight", "n")


def close_sets(members: DataFrame, sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(child, parent), each once: forests over the pairs within the radius of each key's members, dealt out in chunks."""
    # a power of two and two ways of dealing, so that groups of about the same members have the same chunks
    chunks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("n") / chunk, F.lit(1.0))))).cast("int")
    salt = F.pmod(F.xxhash64("s", F.pmod(F.col("key"), F.lit(2))), chunks).cast("int")
    full = members.select("key", salt.alias("salt"), "s").join(sets.select("s", "fp"), "s").select("key", "salt", "s", "fp")
    grouped = full.repartition("key", "salt").sortWithinPartitions("key", "salt", "s")
    return grouped.mapInArrow(_compare, "child long, parent long").distinct()


# -- pairs between classes ---------------------------------------------------------------------------

MEMBER = "struct<s:bigint,label:bigint,fp:array<bigint>,keys:array<bigint>>"


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, s, label) of all sets that are in a pair within the radius and between classes, for rows (tile, key, a, b): members
    of a are compared with those of b, or with one another where b is null."""

    def side(column: pa.Array) -> tuple[np.ndarray, ...]:
        flat = column.flatten()
        sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
        keys = flat.field("keys").flatten().to_numpy().reshape(-1, BANDS)
        return flat.field("s").to_numpy(), flat.field("label").to_numpy(), _prints(flat.field("fp")), keys, sizes, np.concatenate([[0], np.cumsum(sizes)])

    def answers(keys_i: np.ndarray, keys_j: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The key is the least of those that both have."""
        return np.where(keys_i == keys_j, keys_i, np.iinfo(np.int64).max).min(axis=1) == key

    for batch in batches:
        if not batch.num_rows:
            continue
        tile, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        (s, label, fp, keys, sizes, start), (s2, label2, fp2, keys2, sizes2, start2) = side(batch.column(2)), side(batch.column(3))
        alone = np.array([x is None for x in batch.column(3).value_lengths().to_pylist()])
        row = np.repeat(np.arange(len(tile)), sizes)
        place = np.flatnonzero((alone & (sizes <= SMALL))[row])
        i, j, _ = small_pairs(fp[place], row[place], RADIUS)
        found = [(place[i], place[j], None)]
        for r in np.flatnonzero(~(alone & (sizes <= SMALL))):
            own = slice(start[r], start[r + 1])
            if alone[r]:
                i, j, _ = close_pairs(fp[own], RADIUS)
                found.append((start[r] + i, start[r] + j, None))
            else:
                i, j, _ = cross_pairs(fp[own], fp2[start2[r] : start2[r + 1]], RADIUS)
                found.append((start[r] + i, start2[r] + j, r))
        out = []
        for i, j, r in found:
            s_, label_, keys_ = (s, label, keys) if r is None else (s2, label2, keys2)
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                use = label[x] != label_[y]
                x, y = x[use], y[use]
                use = answers(keys[x], keys_[y], key[row[x]])
                x, y = x[use], y[use]
                out += [np.stack([tile[row[x]], s[x], label[x]]), np.stack([tile[row[x]], s_[y], label_[y]])]
        if out:
            rows = np.unique(np.concatenate(out, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["tile", "s", "label"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) that connect the classes of each tile, whose rows (tile, s, label, fp, shingles) come one tile after
    another. The closest pairs are verified first; pairs within a class that has grown meanwhile need no more."""

    def solve(s: list[int], label: list[int], fp: list[np.ndarray], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        links, (part, whole) = [], SHARE
        i, j, d = close_pairs(np.stack(fp), RADIUS) if len(s) > 1 else ((), (), ())
        for n in np.argsort(d, kind="stable"):
            x, y = int(i[n]), int(j[n])
            a, b = find(label[x]), find(label[y])
            if a == b:
                continue
            total = len(sets[x]) + len(sets[y])
            if min(len(sets[x]), len(sets[y])) * (part + whole) < total * part:
                continue
            if len(np.intersect1d(sets[x], sets[y], assume_unique=True)) * (part + whole) >= total * part:
                root[max(a, b)] = min(a, b)
                links.append((s[x], s[y]))
        return links

    last, held = None, ([], [], [], [])
    for batch in batches:
        links = []
        prints, flat = _prints(batch.column(3)), batch.column(4).flatten().to_numpy()
        ends = np.cumsum([0, *batch.column(4).value_lengths().to_pylist()])
        for n, (tile, s, label) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
            if tile != last:
                links += solve(*held) if last is not None else []
                last, held = tile, ([], [], [], [])
            for into, value in zip(held, (s, label, prints[n].copy(), flat[ends[n] : ends[n + 1]].copy()), strict=True):
                into.append(value)
        if links:
            yield _pairs(links)
    if last is not None and (links := solve(*held)):
        yield _pairs(links)


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])


def between_classes(members: DataFrame, sets: DataFrame, labels: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """tile, s, label: the sets of all pairs that share a key, lie within the radius and are in two classes; both of a pair are in
    a tile together."""
    placed = members.join(labels, "s", "left").select("key", "s", "weight", F.coalesce("label", "s").alias("label"))
    placed = store(placed, "neardup-placed")
    held = placed.groupBy("key", "label").agg(F.sum("weight").alias("w"))
    keys = held.groupBy("key").agg(F.max_by("label", F.struct("w", "label")).alias("main"), F.max("w").alias("inside"), F.sum("w").alias("w"), F.count("*").alias("classes"))
    keys = store(keys.filter("classes > 1").drop("classes"), "neardup-open")
    side = F.when(F.col("w") <= chunk, -1).when(F.col("label") == F.col("main"), 1).otherwise(0)
    weight = F.when(F.col("label") == F.col("main"), F.col("inside")).otherwise(F.col("w") - F.col("inside"))
    block = F.when(F.col("w") <= chunk, 0).otherwise(F.pmod(F.xxhash64("s", "key"), F.ceil(weight / chunk))).cast("int")
    open_ = placed.join(keys, "key").select("key", side.alias("side"), block.alias("block"), "s", "label")
    full = open_.join(sets.select("s", "fp", "keys"), "s")
    blocks = full.groupBy("key", "side", "block").agg(F.collect_list(F.struct("s", "label", "fp", "keys")).alias("m"))  # about chunk members
    blocks = store(blocks, "neardup-blocks")
    alone = blocks.filter("side <= 0").select("key", "m", F.lit(None).cast(f"array<{MEMBER}>").alias("other"), F.xxhash64("key", "side", "block").alias("tile"))
    outside = blocks.filter("side = 0").select("key", F.col("block").alias("own"), "m")
    every = blocks.filter("side >= 0").select("key", "side", "block", F.col("m").alias("other"))
    across = outside.join(every, "key").filter("side = 1 OR block > own").select("key", "m", "other", F.xxhash64("key", "own", "side", "block").alias("tile"))
    tiles = alone.unionByName(across).select("tile", "key", "m", "other")
    return tiles.repartition("tile").mapInArrow(_between, "tile long, s long, label long")


def row_name() -> list[Column]:
    """A row's id and the hash of its text; equal rows have equal names."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return [doc_id.alias("id"), F.xxhash64(doc_id, text).alias("k")]


def _shingles(rows: DataFrame, sets: DataFrame, asked: DataFrame) -> DataFrame:
    """s, shingles of the sets ``asked`` (s), from the text of the first row of each."""
    own = store(sets.join(asked, "s", "left_semi").select("s", F.col("first.id").alias("i"), F.col("first.k").alias("h")), "neardup-asked")
    texts = rows.join(maybe_broadcast(own, own.count()), (F.col("k") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")))
    held = map_rows(texts.select("s", "text"), lambda part: [(s, shingle_set(t).view(np.int64).tolist()) for s, t in part], "s long, shingles array<long>")
    return store(held.groupBy("s").agg(F.first("shingles").alias("shingles")), "neardup-shingles")


def near_duplicate_classes(documents: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k, s) of the documents, and classes (s, label, first) of the sets; first is the least (id, k) of a set."""
    rows = documents.select(*row_name(), F.col("text").cast("string").alias("text"))
    prints = store(map_rows(rows, lambda part: [(i, k, *sketch(t)) for i, k, t in part], "id long, k long, s long, fp array<long>, keys array<long>, weight int"), "neardup-prints")
    sets = store(prints.groupBy("s").agg(F.min(F.struct("id", "k")).alias("first"), *(F.first(c).alias(c) for c in ("fp", "keys", "weight"))), "neardup-sets")
    members = store(filed(sets), "neardup-members")
    edges = store(close_sets(members, sets, chunk), "neardup-edges")
    ends = edges.select(F.col("child").alias("s")).unionByName(edges.select(F.col("parent").alias("s"))).distinct()
    held = _shingles(rows, sets, ends)
    pairs = edges.join(held.select(F.col("s").alias("child"), F.col("shingles").alias("x")), "child").join(held.select(F.col("s").alias("parent"), F.col("shingles").alias("y")), "parent")
    part, whole = SHARE  # both / (x + y - both) >= part / whole
    alike = F.size(F.array_intersect("x", "y")) * (part + whole) >= (F.size("x") + F.size("y")) * part
    links = store(pairs.filter(alike).select(F.col("child").alias("a"), F.col("parent").alias("b")), "neardup-links")
    labels = connected_components(links).withColumnRenamed("node", "s")
    near = store(between_classes(members, sets, labels, chunk), "neardup-between")
    if near.limit(1).count():
        told = near.join(_shingles(rows, sets, near.select("s").distinct()), "s").join(sets.select("s", "fp"), "s")
        told = told.select("tile", "s", "label", "fp", "shingles").repartition("tile").sortWithinPartitions("tile", "s")
        more = store(told.mapInArrow(_verify, "a long, b long"), "neardup-links")
        labels = connected_components(links.unionByName(more)).withColumnRenamed("node", "s")
    classes = store(sets.select("s", "first").join(labels, "s", "left").select("s", F.coalesce("label", "s").alias("label"), "first"), "neardup-classes")
    return prints.select("id", "k", "s"), classes


def keep_one_of_each(documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The documents, all columns as they are, less all but one row of each class: the row with the least (id, text hash)
    stays, of equal rows any one."""
    prints, classes = near_duplicate_classes(documents, chunk)
    stays = classes.groupBy("label").agg(F.min("first").alias("first")).select("first.id", "first.k", F.lit(True).alias("stays"))
    names = prints.groupBy("id", "k").agg(F.count("*").alias("n"))
    names = store(names.join(stays.withColumnRenamed("id", "i"), [names["k"] == stays["k"], F.col("id").eqNullSafe(F.col("i"))], "left").select("id", names["k"], "n", F.coalesce("stays", F.lit(False)).alias("stays")), "neardup-names")
    gone = names.filter("not stays").select(F.col("id").alias("i"), F.col("k").alias("h"))
    rows = documents.select(F.struct("*").alias("row"), *row_name())
    kept = rows.join(maybe_broadcast(gone, gone.count()), (F.col("k") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
    if names.filter("stays and n > 1").limit(1).count():  # equal rows are one document
        kept = kept.groupBy("id", "k").agg(F.first("row").alias("row"))
    return kept.select("row.*")
