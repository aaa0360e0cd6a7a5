"""Conversation prefix trie: what conversations have in common from their first turn on, and what sharing it would save.

1. A turn is named by a hash of its role and text. Turns of one name are compared as text; names that stand for
   several texts get a number for each, so (name, number) is exact.
2. running() gives each turn its place and the polynomial fingerprint of the prefix that ends there, by numpy
   scans over sorted ranges whose borders are carried from one to the next: a conversation of any length is
   numbered and hashed without being in one task.
3. Fingerprints of rebuilt conversations follow from those of the given ones by modular arithmetic.
4. Prefixes of one depth and fingerprint are a candidate group. Each member is verified turn by turn against the
   representative, the member with the least id: the last turns must be equal, and the prefixes before them must be
   in one group, which is verified likewise. Least and greatest values of a group tell whether all members are
   equal, without a join; groups in which they are not are split until none is left.
5. The nodes whose least member is the same conversation are a chain, the lower end of that conversation's path.
   Sums over subtrees go up the tree of chains by pointer doubling, then along each chain by a running sum.

Defined cases: turns are ordered by turn, null first, then by the hash of role and text; null role and text are
empty; rows without conv_id belong to no conversation; repeated rows are turns of their own; other columns are not
looked at, so their names may clash; an empty table has no nodes; texts of any length are hashed on the JVM, and
only narrow rows are sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, maybe_broadcast, store, table

#: Family of conversations that share a beginning, and the number of lengths that it may have.
FAMILY, HEADS = 5, 9
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_664_525_013)
#: Ids that one piece of a list of members holds.
PIECE = 4096
MAX_ROUNDS = 60
KEY = ["d", "f0", "f1", "g"]


# -- running sums ------------------------------------------------------------------------------------


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out


def running(rows: DataFrame, key: str, order: list[str], sums: list[tuple[str, str, int, int | None]]) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within each value of the long ``key`` in the sort order, and for each of ``sums``
    (column, name, base, prime) the sum of column x base ** place over all rows up to this one (name) and before it (name_),
    modulo the prime; with base 1 and no prime, plain sums.

    Each range of the sort order sums by itself. Only keys that reach over a border of ranges need an offset: at most one
    a border, so what the driver adds up has two rows a range at most."""
    spark = rows.sparkSession
    bound_batches(spark)
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    extra = [("part", "int"), ("place", "bigint"), *((n, "bigint") for _, name, *_ in sums for n in (name, f"{name}_"))]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*rows.dtypes, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held, carry = TaskContext.get().partitionId(), None, 0, [0] * len(sums)
        tables = [np.ones(1, np.int64)] * len(sums)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            keys, at = batch.column(key).to_numpy(), np.arange(n)
            begins = np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]])
            first = np.maximum.accumulate(np.where(begins, at, -1))  # -1: goes on from the batch before
            goes_on = first < 0
            place = np.where(goes_on, held + at, at - first)
            out = []
            for i, (column, _, base, prime) in enumerate(sums):
                term = batch.column(column).to_numpy().astype(np.int64)
                if prime:
                    if len(tables[i]) <= place.max():
                        tables[i] = _powers(base, prime, int(place.max()) + 1)
                    term = np.mod(term, prime) * tables[i][place] % prime
                total = np.cumsum(term)
                local = np.where(goes_on, total + carry[i], total - (total - term)[first])
                before = local - term
                if prime:
                    local, before = local % prime, before % prime
                carry[i] = int(local[-1])
                out += [local, before]
            last, held = keys[-1], int(place[-1]) + 1
            added = [pa.array(np.full(n, part, np.int32)), pa.array(place), *(pa.array(x) for x in out)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(name for name, _ in extra)])

    # written, so that ranges and places stay the same when a task runs again
    local = store(ranged.mapInArrow(run, schema), "running")
    ends = sorted(map(tuple, local.groupBy("part").agg(F.min(key), F.max(key)).collect()))  # a row for each range
    over = {a[2] for a, b in zip(ends, ends[1:], strict=False) if a[2] == b[1]}
    names = [name for _, name, *_ in sums]
    offsets, seen = [], {}
    if over:
        last_row = [F.max_by(name, "place").alias(name) for name in names]
        pieces = local.filter(F.col(key).isin(list(over))).groupBy(key, "part").agg(F.count("*").alias("n"), *last_row).collect()
        for r in sorted(pieces, key=lambda r: r["part"]):
            start, so_far = seen.get(r[key], (0, [0] * len(sums)))
            scale = [pow(base, start, prime) if prime else 1 for _, _, base, prime in sums]
            offsets.append((r[key], r["part"], start, *so_far, *scale))
            so_far = [(s + r[name] * w) % prime if prime else s + r[name] for s, name, w, (*_, prime) in zip(so_far, names, scale, sums, strict=True)]
            seen[r[key]] = start + r["n"], so_far
    columns = [f"_{n}_{what}" for what in ("offset", "scale") for n in names]
    moved = spark.createDataFrame(offsets, ", ".join(["_key long", "_part int", "_start long", *(f"{c} long" for c in columns)]))
    joined = local.join(F.broadcast(moved), (F.col(key) == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    whole = {"place": F.col("place") + F.coalesce("_start", F.lit(0))}
    for _, name, _, prime in sums:
        for n in (name, f"{name}_"):
            value = F.coalesce(f"_{name}_offset", F.lit(0)) + F.coalesce(f"_{name}_scale", F.lit(1)) * F.col(n)
            whole[n] = value % prime if prime else value
    return joined.withColumns(whole).select(*rows.columns, *(n for n, _ in extra if n != "part"))


# -- turns and rebuilt conversations -----------------------------------------------------------------


def turn_name() -> Column:
    return F.xxhash64("role", "text")


def named_turns(conversations: DataFrame) -> DataFrame:
    """c, turn, x, v, size of each turn: (x, v) is equal just where role and text are; size is the text's UTF-8 bytes."""
    empty = F.lit("")
    given = conversations.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    turns = given.filter("c IS NOT NULL").withColumn("x", turn_name())
    texts = turns.select("x", "role", "text").distinct()
    shared = store(texts.groupBy("x").agg(F.count("*").alias("n")).filter("n > 1").select("x"), "trie-shared-names")
    size = F.octet_length("text").cast("long").alias("size")
    if not shared.limit(1).count():
        return turns.select("c", "turn", "x", F.lit(0).alias("v"), size)
    from pyspark.sql import Window as W

    numbers = texts.join(shared, "x").withColumn("v", F.row_number().over(W.partitionBy("x").orderBy("role", "text")))
    return turns.join(numbers, ["x", "role", "text"], "left").select("c", "turn", "x", F.coalesce("v", F.lit(0)).alias("v"), size)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rebuilt conversations: their turns c, d (depth), x, v, size, fingerprints f0, f1 of the prefix that ends there and p0, p1
    of the one before, g and pg (0: parts of groups), is_last; and the conversations c, length."""
    sums = [("x", f"f{i}", BASES[i], PRIMES[i]) for i in range(2)]
    scanned = store(running(store(turns, "trie-turns"), "c", ["turn", "x", "v"], sums), "trie-scanned")
    head = F.pmod(F.crc32(F.col("c").cast("string")), F.lit(HEADS)).cast("int")
    family = F.col("c") - F.col("c") % FAMILY
    # at most HEADS - 1 turns of a conversation are in its array
    early = F.when(F.col("place") < HEADS - 1, F.struct("place", "x", "v", "size", "f0", "f1", "f0_", "f1_"))
    convs = store(scanned.groupBy("c").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(early)).alias("own")).withColumns({"h": head, "b": family}), "trie-conversations")
    firsts = convs.filter(F.col("c") == F.col("b")).select("b", F.col("own").alias("base"))
    both = convs.join(firsts, "b", "left").withColumn("base", F.coalesce("base", F.slice("own", 1, 0)))
    k = F.least("h", F.size("base"))
    both = both.withColumns({"k": k, "length": k + F.greatest(F.col("n") - F.col("h"), F.lit(0))})
    both = store(both.withColumn("base", F.slice("base", 1, "k")), "trie-heads")
    begin = both.select("c", "length", F.explode("base").alias("t"))
    d = F.col("t.place") + 1
    begin = begin.select("c", d.alias("d"), "t.x", "t.v", "t.size", "t.f0", "t.f1", F.col("t.f0_").alias("p0"), F.col("t.f1_").alias("p1"), (d == F.col("length")).alias("is_last"))

    # own turns after the first h: the sum up to h gives way to that of the beginning, and depths shrink by h - k
    zero = F.lit(0).cast("long")
    at = lambda array, n, field: F.when(F.col(n) > 0, F.try_element_at(array, F.col(n))[field]).otherwise(zero)
    shift = [F.element_at(F.array(*(F.lit(pow(BASES[i], -j, PRIMES[i])) for j in range(HEADS))), (F.col("h") - F.col("k") + 1)).cast("long") for i in range(2)]
    moves = both.filter("n > h").select("c", "h", "k", "length", *(e.alias(f"{n}{i}") for i in range(2) for n, e in (("cut", at("own", "h", f"f{i}")), ("put", at("base", "k", f"f{i}")), ("shift", shift[i]))))
    rest = scanned.filter(F.col("place") >= head).join(moves, "c")
    d = F.col("place") + 1 - F.col("h") + F.col("k")
    moved = lambda i, end: F.pmod(F.col(f"put{i}") + F.col(f"shift{i}") * F.pmod(F.col(f"f{i}{end}") - F.col(f"cut{i}"), F.lit(PRIMES[i])), F.lit(PRIMES[i]))
    rest = rest.select("c", d.alias("d"), "x", "v", "size", moved(0, "").alias("f0"), moved(1, "").alias("f1"), moved(0, "_").alias("p0"), moved(1, "_").alias("p1"), (d == F.col("length")).alias("is_last"))
    parts = begin.unionByName(rest).withColumns({"g": F.lit(0), "pg": F.lit(0)})
    return store(parts, "trie-rebuilt"), both.select("c", "length")


# -- nodes -------------------------------------------------------------------------------------------


def verified(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns, with groups (d, f0, f1, g) split until all members equal their representative, and the groups: m (least
    member), n, size, and the group before (p0, p1, pg)."""
    facts = ["x", "v", "p0", "p1", "pg"]
    for round_ in range(1, 1_000):
        ends = [f(c).alias(f"{name}_{c}") for c in facts for name, f in (("lo", F.min), ("hi", F.max))]
        groups = turns.groupBy(*KEY).agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("size").alias("size"), F.min_by(F.struct(*facts), "c").alias("rep"), *ends)
        groups = store(groups, "trie-groups")
        mixed = groups.filter(" OR ".join(f"lo_{c} <> hi_{c}" for c in facts)).select(*KEY, "rep")
        if not mixed.limit(1).count():
            return turns, groups.select(*KEY, "m", "n", "size", *(F.col(f"rep.{c}").alias(c) for c in facts[2:]))
        told = turns.join(mixed, KEY, "left")
        differs = F.col("rep").isNotNull() & (F.struct(*facts) != F.col("rep"))
        told = store(told.withColumn("g", F.when(differs, F.lit(round_)).otherwise(F.col("g"))).drop("rep"), "trie-split")
        above = told.select("c", (F.col("d") + 1).alias("d"), F.col("g").alias("up"))
        turns = store(told.join(above, ["c", "d"], "left").withColumn("pg", F.coalesce("up", F.lit(0))).drop("up"), "trie-split")
    raise RuntimeError("groups did not settle")


def end_lists(ends: DataFrame) -> DataFrame:
    """For each node (d, f0, f1, g) in rows with c, ends_sha256 of its ids in ascending order. Ranges of ids become pieces of
    text first, so that the one task that must digest a node's list reads pieces, as they come, never the list."""
    key_schema = "d long, f0 long, f1 long, g int"
    names = [*KEY, "first", "ids"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in KEY]
            ids = batch.column("c").to_pylist()
            new = np.any([x[1:] != x[:-1] for x in cols], axis=0)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
            cuts = [i for a, b in zip(starts, starts[1:], strict=False) for i in range(a, b, PIECE)]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[cuts]) for x in cols), pa.array([ids[a] for a in cuts], pa.int64()), pa.array(texts, pa.string())], names=names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == last:
                    sha.update(b",")
                else:
                    if sha:
                        done.append((*last, sha.hexdigest()))
                    last, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            if done:
                yield as_batch(done)
        if sha:
            yield as_batch([(*last, sha.hexdigest())])

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*KEY, "ends_sha256"])

    ranged = ends.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c")
    packed = store(ranged.mapInArrow(pieces, f"{key_schema}, first long, ids string"), "trie-pieces")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, f"{key_schema}, ends_sha256 string")


# -- sums over subtrees ------------------------------------------------------------------------------


def chain_totals(nodes: DataFrame) -> DataFrame:
    """m, up, at, saved, leaves: chains, the chain and depth that each hangs on (up is null for the root's), and sums over all that
    hangs on it. Each round doubles how far down a sum reaches."""
    chains = nodes.groupBy("m").agg(F.min_by("pm", "d").alias("up"), (F.min("d") - 1).alias("at"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    chains = store(chains.withColumn("anc", F.col("up")), "trie-chains")
    for _ in range(MAX_ROUNDS):
        moving = chains.filter("anc IS NOT NULL")
        if not moving.limit(1).count():
            return chains.drop("anc")
        below = moving.groupBy(F.col("anc").alias("m")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        grown = chains.join(below, "m", "left").withColumns({"saved": F.col("saved") + F.coalesce("s", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("l", F.lit(0))}).drop("s", "l")
        over = moving.select(F.col("m").alias("anc"), F.col("anc").alias("next"))  # chains under the root's have no row here
        chains = store(grown.join(over, "anc", "left").select("m", "up", "at", "saved", "leaves", F.col("next").alias("anc")), "trie-chains")
    raise RuntimeError("chains did not settle")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    turns, convs = rebuilt(named_turns(conversations))
    turns, groups = verified(turns)
    whole = convs.agg(F.min("c").alias("m"), F.count("*").alias("n"))
    root = whole.filter("m IS NOT NULL").select(F.lit(0).cast("long").alias("d"), *(F.lit(0).cast("long").alias(x) for x in ("f0", "f1")), F.lit(0).alias("g"), "m", "n", F.lit(0).cast("long").alias("size"))
    above = groups.select((F.col("d") + 1).alias("d"), F.col("f0").alias("p0"), F.col("f1").alias("p1"), F.col("g").alias("pg"), F.col("m").alias("pm"))
    deep = groups.filter("d > 1").join(above, ["d", "p0", "p1", "pg"])
    high = groups.filter("d = 1").join(F.broadcast(whole.select(F.col("m").alias("pm"))))  # one row
    columns = [*KEY, "m", "n", "size", "pm"]
    nodes = store(deep.select(columns).unionByName(high.select(columns)).unionByName(root.withColumn("pm", F.lit(None).cast("long"))), "trie-nodes")
    kids = nodes.filter("d > 0").groupBy(F.col("pm").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, ["m", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = store(nodes.withColumns({"saved": (F.col("n") - 1) * F.col("size"), "leaves": (F.col("n_children") == 0).cast("long")}), "trie-nodes")
    chains = store(chain_totals(nodes), "trie-totals")
    hung = chains.filter("up IS NOT NULL").groupBy(F.col("up").alias("m"), F.col("at").alias("d")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    own = nodes.join(hung, ["m", "d"], "left").select(*nodes.drop("saved", "leaves").columns, (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (-F.col("d")).alias("up"))
    summed = running(own, "m", ["up"], [("saved", "saved_tokens", 1, None), ("leaves", "n_leaves", 1, None)])
    bare = convs.filter("length = 0").select(F.lit(0).cast("long").alias("d"), *(F.lit(0).cast("long").alias(x) for x in ("f0", "f1")), F.lit(0).alias("g"), "c")
    ends = store(turns.filter("is_last").select(*KEY, "c").unionByName(bare), "trie-ends")
    listed = summed.join(end_lists(ends), KEY, "left")
    return listed.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("pm").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = {
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, CAST(c AS VARCHAR) AS s, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, n, c - c % 5 AS b, xor(list_reduce(range(0, 8 * length(s)), lambda x, i:
    CASE WHEN i % 8 = 0 THEN CASE WHEN xor(x, ascii(s[i // 8 + 1])) & 1 = 1 THEN xor(xor(x, ascii(s[i // 8 + 1])) >> 1, 3988292384) ELSE xor(x, ascii(s[i // 8 + 1])) >> 1 END
      WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, 4294967295), 4294967295) % 9 AS h FROM n),
k AS (SELECT h.c, h.n, h.b, h.h, least(h.h, coalesce(o.n, 0)) AS k FROM h LEFT JOIN h o ON o.c = h.b),
r AS (SELECT k.c, pos AS d, role, text FROM k JOIN t ON t.c = k.b AND pos <= k.h UNION ALL SELECT k.c, pos - h + k, role, text FROM k JOIN t ON t.c = k.c AND pos > h),
p AS (SELECT c, d, text, list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY d) AS prefix FROM r),
a AS (SELECT c, d, text, min(c) OVER (PARTITION BY d, prefix) AS m FROM p UNION ALL SELECT c, 0, '', min(c) OVER () FROM k),
l AS (SELECT c, max(d) AS d FROM a GROUP BY c),
o AS (SELECT m, d, count(*) AS n, octet_length(encode(any_value(text))) AS size FROM a GROUP BY m, d),
u AS (SELECT o.*, a.m AS pm FROM o LEFT JOIN a ON a.c = o.m AND a.d = o.d - 1),
x AS (SELECT pm AS m, d - 1 AS d, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL),
e AS (SELECT a.m, a.d, string_agg(CAST(a.c AS VARCHAR), ',' ORDER BY a.c) AS ids FROM a JOIN l ON l.c = a.c AND l.d = a.d GROUP BY a.m, a.d),
z AS (SELECT a.m, a.d, sum((u.n - 1) * u.size) AS saved, count(*) FILTER (x.n IS NULL) AS leaves FROM u LEFT JOIN x ON x.m = u.m AND x.d = u.d JOIN a ON a.c = u.m AND a.d <= u.d GROUP BY a.m, a.d)
SELECT u.m AS conv_id, u.d AS depth, pm AS parent_conv_id, u.n AS n_convs, coalesce(x.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN z ON z.m = u.m AND z.d = u.d LEFT JOIN x ON x.m = u.m AND x.d = u.d LEFT JOIN e ON e.m = u.m AND e.d = u.d"""
}
