"""BM25 over postings in blocks: counted terms, block maxima, pruned scoring, and a stored index of segments.

A posting row holds one term's chunks in one block of at most BLOCK chunks of a knowledge base: ids, term
frequencies and lengths, with the greatest frequency and the least length, which bound every score in the block
from above whatever the corpus's mean length has become. A task scores whole blocks for a batch of questions and
keeps k chunks a question: a block is left out for a question whose bound stays below the k-th score so far. So
what is shuffled are the posting rows of asked terms and k rows a question and task, never a row for each
question and chunk.

The index on disk is a set of segments, each of the chunks that one version brought, and a manifest (see store)
that says which of them are active and has the merged counts. A batch of questions reads only the buckets of its
terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import analyze
from ..staging import bound_batches, small, staged
from .store import Manifest

#: Okapi constants, as published for the variant with a floor for negative idf.
K1, B, FLOOR = 1.5, 0.75, 0.25
#: Chunks of a block, buckets of terms, and questions that one broadcast holds.
BLOCK, BUCKETS, BLOCK_QUESTIONS = 1024, 64, 20_000
#: Questions whose terms are weighed at once: a matrix of their terms by a block's chunks.
AT_ONCE = 256
#: Scores are rounded to this many digits; a bound that rounds below the k-th score leaves a block out.
DIGITS = 6


def in_scope(chunk_kb: Column, question_kb: Column) -> Column:
    return question_kb.isNull() | (question_kb == chunk_kb)


def top_k(scored: DataFrame, by: list[str], k: int, id_col: str = "chunk_id") -> DataFrame:
    """Rows of rank 1 to k in each group, with the rank; Spark keeps only k rows a group before its shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# -- counts ------------------------------------------------------------------------------------------


def analysed(chunks: DataFrame) -> DataFrame:
    """kb, chunk_id, analysed_terms: the words of the chunks, found once and written for all that read them."""
    return staged(chunks.select("kb", "chunk_id", analyze(F.col("content")).alias("analysed_terms")), "analysed")


def _terms(chunks: DataFrame) -> Column:
    return F.col("analysed_terms") if "analysed_terms" in chunks.columns else analyze(F.col("content"))


def term_table(chunks: DataFrame) -> DataFrame:
    """kb, term, df, n, words of all terms, from one pass: n and words are chunks and words that were counted at this
    term, so that they sum to those of the knowledge base. Only partial sums by (kb, term) are shuffled."""
    terms = chunks.select("kb", _terms(chunks).alias("terms"))
    each = terms.select("kb", F.size("terms").alias("dl"), F.posexplode_outer(F.array_distinct("terms")).alias("at", "term"))
    once = F.coalesce(F.col("at"), F.lit(0)) == 0
    return each.groupBy("kb", "term").agg(F.count("term").alias("df"), F.count_if(once).alias("n"), F.sum(F.when(once, F.col("dl")).otherwise(0)).alias("words"))


def corpus_stats(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a term_table: (kb, n, avgdl, mean) and (kb, term, idf); an idf below zero becomes FLOOR times the knowledge
    base's mean idf."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # terms of equal document frequency have equal idf, so the mean needs a row for each frequency only
    levels = table.groupBy("kb", "df").agg(F.count("term").alias("terms"), F.sum("n").alias("k"), F.sum("words").alias("w"))
    whole = W.partitionBy("kb")
    levels = levels.withColumns({"n": F.sum("k").over(whole), "avgdl": F.sum("w").over(whole) / F.sum("k").over(whole)})
    size = levels.groupBy("kb").agg(F.first("n").alias("n"), F.first("avgdl").alias("avgdl"), (F.sum(raw * F.col("terms")) / F.sum("terms")).alias("mean"))
    size = staged(size, "sizes")  # read by each of the joins below and in search()
    idf = table.filter("term IS NOT NULL").select("kb", "term", "df").join(small(size), "kb")
    return size, idf.select("kb", "term", F.when(raw < 0, FLOOR * F.col("mean")).otherwise(raw).alias("idf"))


# -- postings ----------------------------------------------------------------------------------------


def postings(chunks: DataFrame, wanted: list[str] | None = None, whole: bool = False) -> DataFrame:
    """kb, term, block, ids, tfs, dls, max_tf, min_dl of chunks (kb, chunk_id, content), of the ``wanted`` terms or all. A task
    makes blocks of the chunks it reads, so no row for a chunk and term is shuffled; block names are unique to the task. With
    ``whole``, a row without a term has all chunks of its block, so that posting_counts() need not read the chunks."""
    spark = chunks.sparkSession
    bound_batches(spark)
    kind = dict(chunks.dtypes)
    schema = f"kb {kind['kb']}, term string, block long, ids array<{kind['chunk_id']}>, tfs array<int>, dls array<int>, max_tf int, min_dl int"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    shared = None if wanted is None else spark.sparkContext.broadcast(wanted)  # the terms of a block of questions

    def rows_of(kb, place: np.ndarray, ids: pa.Array, dl: np.ndarray, code: np.ndarray, at: np.ndarray, names: pa.Array, block: int) -> pa.RecordBatch | None:
        """Posting rows of the chunks ``place``; code and at are term and chunk of each word."""
        number = np.full(len(dl), -1)
        number[place] = np.arange(len(place))
        own = number[at] >= 0
        pairs, tf = np.unique(code[own].astype(np.int64) * len(place) + number[at[own]], return_counts=True)
        if not len(pairs):
            return None
        term, chunk = np.divmod(pairs, len(place))
        starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        dls = dl[place][chunk].astype(np.int32)
        bounds = pa.array(np.append(starts, len(pairs)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, x) for x in (ids.take(pa.array(place[chunk])), pa.array(tf.astype(np.int32)), pa.array(dls))]
        n = len(starts)
        columns = [pa.array([kb] * n, out.field(0).type), names.take(pa.array(term[starts])), pa.array(np.full(n, block)), *lists, pa.array(np.maximum.reduceat(tf, starts).astype(np.int32)), pa.array(np.minimum.reduceat(dls, starts))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        asked = None if shared is None else pa.array(shared.value, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            words, sizes = batch.column(2).flatten(), batch.column(2).value_lengths().fill_null(0).to_numpy()
            if asked is None:
                coded = words.dictionary_encode()
                code, names = coded.indices.to_numpy(), coded.dictionary
            else:
                code, names = pc.index_in(words, value_set=asked).fill_null(-1).to_numpy(), asked
            at = np.repeat(np.arange(batch.num_rows), sizes)[code >= 0]
            code = code[code >= 0]
            kbs = batch.column(0).dictionary_encode()
            for i, kb in enumerate(kbs.dictionary.to_pylist()):
                place = np.flatnonzero(kbs.indices.fill_null(-1).to_numpy() == i)
                for first in range(0, len(place), BLOCK):
                    if whole:
                        own = place[first : first + BLOCK]
                        one = [[kb], [None], [block], [batch.column(1).take(pa.array(own)).to_pylist()], [[0] * len(own)], [sizes[own].tolist()], [0], [int(sizes[own].min())]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, out, strict=True)], schema=out)
                    made = rows_of(kb, place[first : first + BLOCK], batch.column(1), sizes, code, at, names, block)
                    block += 1
                    if made is not None:
                        yield made

    return chunks.select("kb", "chunk_id", _terms(chunks).alias("terms")).mapInArrow(run, schema)


def posting_counts(rows: DataFrame) -> DataFrame:
    """What term_table() counts, from the posting rows of all terms, those of whole blocks among them."""
    every = F.col("term").isNull()
    one = rows.select("kb", "term", F.size("ids").cast("long").alias("k"), F.when(every, F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)).alias("w"))
    counted = [F.sum(F.when(every, 0).otherwise(F.col("k"))).alias("df"), F.sum(F.when(every, F.col("k")).otherwise(0)).alias("n"), F.sum(F.coalesce("w", F.lit(0))).alias("words")]
    return one.groupBy("kb", "term").agg(*counted)


class _Best:
    """The k best chunks of each question in one knowledge base, over the blocks that a task has seen of it."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.scores: list[np.ndarray] = [np.empty(0)] * n
        self.ids: list[np.ndarray] = [np.empty(0, object)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores[q]) >= self.k:
            better = scores >= self.least[q]
            scores, ids = scores[better], ids[better]
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        if len(scores) > self.k:
            kth = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            keep = np.flatnonzero(scores >= kth)
            keep = sorted(keep.tolist(), key=lambda i: (-scores[i], ids[i]))[: self.k]
            scores, ids = scores[keep], ids[keep]
        if len(scores) == self.k:
            self.least[q] = scores.min()
        self.scores[q], self.ids[q] = scores, ids


def score_blocks(rows: DataFrame, questions: list[tuple], k: int, qid_kind: str, counter=None) -> DataFrame:
    """qid, kb, chunk_id, score: the ``k`` best chunks of each question and task, from posting rows with idf and avgdl.

    ``questions`` are (qid, scope, {term: times}); ``counter``, an accumulator, counts blocks and those left out."""
    spark = rows.sparkSession
    bound_batches(spark)
    kind = dict(rows.dtypes)
    schema = f"qid {qid_kind}, kb {kind['kb']}, chunk_id {kind['ids'].removeprefix('array<')[:-1]}, score double"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    asked: dict[str, list[tuple[int, int]]] = {}
    for i, (_, _, terms) in enumerate(questions):
        for term, times in terms.items():
            asked.setdefault(term, []).append((i, times))
    by_term = {t: tuple(np.array(x) for x in zip(*pairs, strict=True)) for t, pairs in asked.items()}
    shared = spark.sparkContext.broadcast(([q[:2] for q in questions], by_term))

    def solve(best: _Best, inside: np.ndarray, parts: list[pa.RecordBatch]) -> None:
        by_term = shared.value[1]
        column = lambda name: pa.chunked_array([p.column(name) for p in parts])
        number = lambda name: column(name).to_numpy().astype(float)
        names = column("term").to_pylist()
        avgdl = column("avgdl")[0].as_py()
        norm = lambda dl: K1 * (1 - B + B * dl / avgdl)
        idf, max_tf = number("idf"), number("max_tf")
        top = max_tf * (K1 + 1) / (max_tf + norm(number("min_dl")))
        at, times = [np.concatenate(x) for x in zip(*(by_term[t] for t in names), strict=True)]
        term = np.repeat(np.arange(len(names)), [len(by_term[t][0]) for t in names])
        bound = np.bincount(at, np.maximum(times * idf[term] * top[term], 0), len(inside))
        hit = np.bincount(at, minlength=len(inside)) > 0
        open_ = hit & inside & (np.round(bound + 10.0**-DIGITS, DIGITS) >= best.least)
        if counter is not None:
            counter.add((int((hit & inside).sum()), int((hit & inside & ~open_).sum())))
        if not open_.any():
            return
        flat = lambda name: np.concatenate([p.column(name).flatten().to_numpy(zero_copy_only=False) for p in parts])
        ids, place = np.unique(flat("ids"), return_inverse=True)
        tf, dl = flat("tfs").astype(float), flat("dls").astype(float)
        weight = tf * (K1 + 1) / (tf + norm(dl))
        line = np.repeat(np.arange(len(names)), np.concatenate([p.column("ids").value_lengths().to_numpy() for p in parts]))
        order = np.argsort(at, kind="stable")
        at, times, term = at[order], times[order], term[order]
        first = np.searchsorted(at, np.arange(len(inside) + 1))
        asked = np.flatnonzero(open_)
        for begin in range(0, len(asked), AT_ONCE):
            some = asked[begin : begin + AT_ONCE]
            used = np.zeros(len(names), bool)
            for q in some:
                used[term[first[q] : first[q + 1]]] = True
            own_line = np.cumsum(used) - 1
            dense = np.zeros((int(used.sum()), len(ids)))
            here = used[line]
            dense[own_line[line[here]], place[here]] = weight[here]
            for q in some:
                own = slice(first[q], first[q + 1])
                part = dense[own_line[term[own]]]
                found = np.flatnonzero(part.any(axis=0))
                score = np.round((times[own] * idf[term[own]]) @ part[:, found], DIGITS) + 0.0
                best.add(q, score, ids[found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        best = inside = kb = number = None
        block: list[pa.RecordBatch] = []  # the rows of a block, as they came

        def flush() -> Iterator[pa.RecordBatch]:
            found = ((names[q][0], kb, i, float(s)) for q in range(len(names)) for i, s in zip(best.ids[q], best.scores[q], strict=True))
            while some := list(islice(found, 1 << 14)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            kbs, blocks = batch.column("kb").to_pylist(), batch.column("block").to_numpy()
            starts = [0, *(i for i in range(1, len(kbs)) if (kbs[i], blocks[i]) != (kbs[i - 1], blocks[i - 1]))]
            for a, b in zip(starts, [*starts[1:], len(kbs)], strict=True):
                if block and (kbs[a], blocks[a]) != (kb, number):
                    solve(best, inside, block)
                    block = []
                if best is None or kbs[a] != kb:
                    if best is not None:
                        yield from flush()
                    kb = kbs[a]
                    best, inside = _Best(len(names), k), np.array([scope is None or scope == kb for _, scope in names])
                number = blocks[a]
                block.append(batch.slice(a, b - a))
        if block:
            solve(best, inside, block)
        if best is not None:
            yield from flush()

    ordered = rows.repartition("kb", "block").sortWithinPartitions("kb", "block", "term")
    return ordered.select("kb", "block", "term", "ids", "tfs", "dls", "max_tf", "min_dl", "idf", "avgdl").mapInArrow(run, schema)


def _asked(questions: DataFrame) -> DataFrame:
    """qid, scope, terms: the words of each question with how often it says them."""
    words = questions.select("qid", F.col("kb").alias("scope"), analyze(F.col("question")).alias("words"))
    times = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.size(F.filter("words", lambda w: w == t)).alias("times")))
    return words.select("qid", "scope", times.alias("terms"))


def search(find, size: DataFrame, idf: DataFrame, questions: DataFrame, k: int, counter=None, block: int = BLOCK_QUESTIONS) -> DataFrame:
    """qid, kb, chunk_id, score, rank by BM25, from ``find``(terms), which gives the posting rows of a list of terms. Questions are
    counted and travel in broadcasts of about ``block``."""
    asked = staged(_asked(questions), "asked")
    parts = -(-asked.count() // block)
    own = F.pmod(F.xxhash64(F.col("qid")), F.lit(max(parts, 1)))
    found = []
    for i in range(max(parts, 1)):
        rows = [(q.qid, q.scope, {t.term: t.times for t in q.terms}) for q in asked.filter(own == i).collect()]
        terms = sorted({t for *_, own_terms in rows for t in own_terms})
        wanted = asked.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        known = small(staged(idf.join(small(wanted), "term").join(small(size.select("kb", "avgdl")), "kb"), "asked-terms"))
        found.append(score_blocks(find(terms).join(known, ["kb", "term"]), rows, k, dict(questions.dtypes)["qid"], counter))
    return top_k(reduce(DataFrame.unionByName, found), ["qid", "kb"], k)


def bm25(questions: DataFrame, chunks: DataFrame, k: int = 50, pad: bool = False) -> DataFrame:
    """qid, kb, chunk_id, score, rank: the k best chunks of each knowledge base in the question's scope. A word
    said twice counts twice. With ``pad``, chunks without a common word follow with score 0, by id."""
    words = analysed(chunks)
    size, idf = corpus_stats(staged(term_table(words), "terms"))
    best = search(lambda terms: postings(words, terms), size, idf, questions, k)
    if not pad:
        return best
    # at most k more rows of each knowledge base are ever needed
    spare = small(top_k(chunks.select("kb", "chunk_id", F.lit(0.0).alias("score")), ["kb"], 2 * k).drop("rank"))
    own = questions.filter("kb IS NOT NULL").select("qid", "kb").join(spare, "kb")
    every = questions.filter("kb IS NULL").select("qid").join(spare)  # the stated questions against 2 k rows a knowledge base
    both = best.drop("rank").unionByName(own.unionByName(every).select("qid", "kb", "chunk_id", "score"))
    return top_k(both.groupBy("qid", "kb", "chunk_id").agg(F.sum("score").alias("score")), ["qid", "kb"], k)


# -- the stored index --------------------------------------------------------------------------------


class PostingsIndex:
    """Postings on disk: segments root/postings/segment=S/bucket=N and their counts, of which a manifest names the active ones.

    add() writes the segment of a version's chunks; publish() merges the counts of the segments that shall be active
    and moves the manifest. Readers see one whole state or the one before."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.manifest = spark, root.rstrip("/"), Manifest(spark, f"{root.rstrip('/')}/manifest")

    def add(self, chunks: DataFrame, segment: str, buckets: int = BUCKETS) -> None:
        """Writes the postings and counts of ``chunks`` (kb, chunk_id, content) beside what is active."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        rows = postings(chunks, whole=True).withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "term")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings/segment={segment}")
        stored = self.spark.read.parquet(f"{self.root}/postings/segment={segment}")
        posting_counts(stored).write.mode("overwrite").parquet(f"{self.root}/counts/segment={segment}")

    def publish(self, segments: list[str], state: str, expected: str | None = None, buckets: int = BUCKETS, **tables: str) -> None:
        """Makes ``segments`` the active ones, with the sum of their counts; other ``tables`` (name=version) move along."""
        merged = None
        for s in segments:
            part = self.spark.read.parquet(f"{self.root}/counts/segment={s}")
            merged = part if merged is None else merged.unionByName(part)
        merged = merged.groupBy("kb", "term").agg(*(F.sum(c).alias(c) for c in ("df", "n", "words")))
        path = f"{self.root}/merged/{state}"
        merged.write.mode("overwrite").parquet(f"{path}/terms")
        size, idf = corpus_stats(self.spark.read.parquet(f"{path}/terms"))
        size.write.mode("overwrite").parquet(f"{path}/size")
        bucketed = idf.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/idf")
        self.manifest.switch({"state": state, "segments": segments, "buckets": buckets, **tables}, expected)

    def read(self, terms: list[str], now: dict | None = None) -> DataFrame:
        """Posting rows of ``terms`` in the active segments; the scan reads only the terms' buckets."""
        now = now or self.manifest.read()
        rows = None
        for s in now["segments"]:
            part = self._pruned(f"{self.root}/postings/segment={s}", terms, now["buckets"])
            # blocks of different segments are different blocks
            part = part.withColumn("block", F.xxhash64(F.lit(s), "block"))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def _pruned(self, path: str, terms: list[str], buckets: int) -> DataFrame:
        named = self.spark.createDataFrame([(t,) for t in terms], "term string")
        numbers = named.select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct().collect()  # at most ``buckets``
        return self.spark.read.parquet(path).filter(F.col("bucket").isin([r.b for r in numbers])).drop("bucket").join(small(named), "term", "left_semi")

    def search(self, questions: DataFrame, k: int = 50, counter=None) -> DataFrame:
        """As bm25(), over the active segments."""
        now = self.manifest.read()
        size = self.spark.read.parquet(f"{self.root}/merged/{now['state']}/size")
        terms = [r.term for r in _asked(questions).select(F.explode("terms.term").alias("term")).distinct().collect()]
        idf = self._pruned(f"{self.root}/merged/{now['state']}/idf", terms, now["buckets"])
        return search(lambda asked: self.read(asked, now), size, idf, questions, k, counter)
