"""Benchmark decontamination: short test items found inside long documents, by DataFrame functions only.

Items and documents are sets of 5-word shingles. An item is found in a document when at least CONTAINED
of its distinct shingles occur there. Candidates come from a containment search with bottom-k MinHash
sketches partitioned by size: items fall into size classes (powers of two), and a class keeps, of each
item, the k smallest shingle hashes, with k one more than the shingles that a contained item of the
class may miss. One of the k therefore occurs in every document that contains the item, so the search
loses nothing, whatever a document's length; documents too short for the class's smallest item are left
out. Candidate pairs are then verified by counting equal shingles as text.

Items with the same shingles form one class, shown by its smallest id and the list of its members. The
sketch and the list of candidate documents are broadcast only if their counted rows stay below
common.BROADCAST_ROWS, and joined by a shuffle otherwise. Before a shuffle join with the sketch, document
shingles pass a blocked Bloom filter of its hashes: BLOCKS bitmaps of 4 KB, 64 MB as arrays at most, are
broadcast whatever the sketch's size; each hash sets two bits of one block. The filter has no false negative.

Defined cases: null texts have no words; an item without words is never found; an item of fewer than
five words is one shingle, found only in a document of just these words; documents with equal id and
text give one row for each item; a null document id is kept as null. An empty table of documents
or items gives no rows; a text of any length is one row's array of words; where documents come back, their columns
travel in a struct, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import lower_ascii, maybe_broadcast, store, table

SHINGLE_WORDS = 5
CONTAINED = 0.8
#: Bitmaps of the Bloom filter, a power of two, each of 32,768 bits.
BLOCKS = 8192


def words_of(text: Column) -> Column:
    """Array of the lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return F.filter(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), "[ \\t-\\r]+"), lambda w: w != "")


def places(words: str) -> Column:
    """First places of the shingles: one for a short text, none without words."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - SHINGLE_WORDS, F.lit(0))))


def shingle_texts(words: str) -> Column:
    return F.transform(places(words), lambda i: F.concat_ws(" ", F.slice(F.col(words), i + 1, SHINGLE_WORDS)))


def shingle_hashes(hashes: str, words: str) -> Column:
    """Hashes of the shingles from the hashes of their words; missing words of a short text are skipped."""
    return F.transform(places(words), lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(SHINGLE_WORDS))))


def missing_allowed(size: Column) -> Column:
    """Shingles that an item of ``size`` may lack and still be contained."""
    return size - F.ceil(size * CONTAINED - 1e-9)


def item_classes(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes (item_id, item_ids, n_shingles) and their shingles (item_id, shingle, h)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.withColumn("shingles", F.array_sort(F.array_distinct(shingle_texts("words")))).filter("size(shingles) > 0")
    classes = items.groupBy("shingles").agg(F.min("item_id").alias("item_id"), F.concat_ws(",", F.transform(F.array_sort(F.collect_set("item_id")), lambda i: i.cast("string"))).alias("item_ids"))
    classes = store(classes.select("item_id", "item_ids", F.size("shingles").alias("n_shingles"), "shingles"), "items")
    exploded = classes.select("item_id", "n_shingles", F.explode("shingles").alias("shingle"))
    words = exploded.withColumn("w", F.split("shingle", " "))
    hashed = words.withColumn("h", F.xxhash64(*(F.get(F.transform("w", lambda x: F.xxhash64(x)), F.lit(k)) for k in range(SHINGLE_WORDS))))
    return classes.drop("shingles"), hashed.drop("w")


def sketches(shingles: DataFrame) -> DataFrame:
    """Bottom-k MinHash sketches (item_id, h, least_words) by size class."""
    size = F.col("n_shingles")
    low = F.pow(F.lit(2), F.floor(F.log2(size))).cast("long")  # the class holds sizes low to 2 low - 1
    k = missing_allowed(2 * low - 1) + 1
    ordered = shingles.groupBy("item_id", "n_shingles").agg(F.array_sort(F.collect_set("h")).alias("hs"))
    least_words = F.when(low == 1, 1).otherwise(F.ceil(low * CONTAINED - 1e-9) + SHINGLE_WORDS - 1)
    return ordered.select("item_id", F.explode(F.slice("hs", F.lit(1), F.least(k, F.size("hs")).cast("int"))).alias("h"), least_words.alias("least_words"))


def filter_bits(h: Column) -> tuple[Column, list[Column]]:
    """Block of a hash and the positions of its two bits there, from different bits of the hash."""
    return (h.bitwiseAND(F.lit(BLOCKS - 1))).cast("int"), [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(32767)) for n in (49, 34)]


def bloom_filter(hashes: DataFrame) -> DataFrame:
    """Blocked Bloom filter (block, quads) of the column h: a block's bits in 1024 numbers of 32 bits, first byte highest."""
    block, bits = filter_bits(F.col("h"))
    maps = hashes.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    quad = lambda i: F.conv(F.hex(F.substring("bitmap", i * 4 + 1, F.lit(4))), 16, 10).cast("long")
    return maps.select("block", F.transform(F.sequence(F.lit(0), F.lit(1023)), quad).alias("quads"))


def passing(stream: DataFrame, bloom: DataFrame) -> DataFrame:
    """Rows of ``stream`` whose h may be in the filter."""
    block, bits = filter_bits(F.col("h"))
    is_set = [F.getbit(F.get("quads", F.shiftright(p, 5).cast("int")), (24 - p.bitwiseAND(F.lit(24)) + p.bitwiseAND(F.lit(7))).cast("int")) == 1 for p in bits]
    return stream.withColumn("block", block).join(F.broadcast(bloom), "block").filter(is_set[0] & is_set[1]).select(*stream.columns)


def verified(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), item_id, item_ids, n_shared, n_shingles of each containment."""
    classes, shingles = item_classes(benchmark)
    shingles = store(shingles, "item-shingles")
    sketch = store(sketches(shingles), "sketches")
    n_sketch, n_shingles = sketch.count(), shingles.count()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t"), words_of(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    stream = hashed.select("doc_id", "t", F.size("words").alias("n_words"), F.explode(shingle_hashes("hashes", "words")).alias("h"))
    if n_sketch > common.BROADCAST_ROWS:
        stream = passing(stream, store(bloom_filter(sketch), "sketch-filter"))
    pairs = stream.join(maybe_broadcast(sketch, n_sketch), "h").filter("n_words >= least_words").select("doc_id", "t", "item_id").distinct()
    pairs = store(pairs, "candidates")

    # only candidate documents are read as text
    wanted = store(pairs.select("doc_id", "t").distinct(), "candidate-docs")
    n_wanted = wanted.count()
    here = docs.withColumn("t", F.xxhash64("text"))
    asked = maybe_broadcast(wanted.select(F.col("doc_id").alias("d"), F.col("t").alias("u")), n_wanted)
    chosen = here.join(asked, (F.col("t") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("doc_id", "t", words_of(F.col("text")).alias("words"))
    held = chosen.select("doc_id", "t", F.explode(F.array_distinct(shingle_texts("words"))).alias("shingle"))
    hits = held.join(maybe_broadcast(shingles.select("shingle", "item_id"), n_shingles), "shingle").select("doc_id", "t", "item_id", "shingle").distinct()
    counted = hits.groupBy("doc_id", "t", "item_id").agg(F.count("*").alias("n_shared"))
    right = pairs.select(F.col("doc_id").alias("d"), F.col("t").alias("u"), F.col("item_id").alias("i"))
    counted = counted.join(right, (F.col("t") == F.col("u")) & (F.col("item_id") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    return counted.join(maybe_broadcast(classes, n_shingles), "item_id").filter(F.col("n_shared") >= F.ceil(F.col("n_shingles") * CONTAINED - 1e-9))


def found_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, item_ids, n_shared, n_shingles, containment for each document and item class found in it."""
    out = verified(documents, benchmark)
    return out.groupBy("doc_id", "item_id", "item_ids").agg(F.max("n_shared").alias("n_shared"), F.max("n_shingles").cast("long").alias("n_shingles")).withColumn("containment", F.round(F.col("n_shared") / F.col("n_shingles"), 6))


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns as they are, less those that contain an item."""
    found = store(verified(documents, benchmark).select(F.col("doc_id").alias("i"), F.col("t").alias("h")).distinct(), "contaminated")
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    clean = rows.join(maybe_broadcast(found, found.count()), (F.col("t") == F.col("h")) & F.col("id").eqNullSafe(F.col("i")), "left_anti")
    return clean.select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op4_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, hash(w) AS t, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM dw WHERE len(w) > 0)),
isx AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 5], ' ') AS s FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM iw WHERE len(w) > 0)),
sets AS (SELECT item_id, list_sort(list(s)) AS ss FROM isx GROUP BY item_id),
cls AS (SELECT min(item_id) AS item_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, ss FROM sets GROUP BY ss),
cs AS (SELECT item_id, item_ids, len(ss) AS n_shingles, unnest(ss) AS s FROM cls)
SELECT doc_id, item_id, item_ids, max(n) AS n_shared, CAST(max(n_shingles) AS BIGINT) AS n_shingles, round(max(n) / max(n_shingles), 6) AS containment
FROM (SELECT doc_id, t, item_id, item_ids, count(*) AS n, max(n_shingles) AS n_shingles FROM ds JOIN cs USING (s) GROUP BY doc_id, t, item_id, item_ids)
WHERE n >= ceil(n_shingles * 0.8 - 1e-9) GROUP BY doc_id, item_id, item_ids
"""
}
