"""Hybrid retrieval over chunks as one lazy plan for a batch of questions.

chunks: kb, chunk_id, content and what else the caller keeps. questions: qid, question, kb (null: every
knowledge base). All sorts are total: score descending, then id ascending.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import analyze, squash
from ..staging import gathered, small, staged
from .lexical import BLOCK_QUESTIONS, bm25, corpus_stats, in_scope, postings, term_table, top_k  # noqa: F401
from .tables import answer_tables
from .understanding import DEFAULT as LEXICON
from .understanding import Lexicon, expand, focus, is_enumeration, named_documents, table_kind

RRF_K = 60
TOP_VECTOR, TOP_LEXICAL, TOP_RERANK, TOP_FINAL = 50, 50, 100, 5
MIN_CONTENT = 40
EXPANDED_CHAPTER, EXPANDED_UNIT, UNIT_POOL, UNIT_LEAST = 15, 40, 200, 4


# -- lexical (see lexical.py) ------------------------------------------------------------------------


def normalised_by_kb(hits: DataFrame) -> DataFrame:
    """Scores over their knowledge base's best; knowledge bases whose best is not positive go."""
    best = F.max("score").over(W.partitionBy("qid", "kb"))
    return hits.withColumn("best", best).filter("best > 0").withColumn("score", F.round(F.col("score") / F.col("best"), 6)).drop("best")


# -- vectors -----------------------------------------------------------------------------------------


def vector_search(vectors: DataFrame, questions: DataFrame, k: int = TOP_VECTOR, clamp: bool = True, block: int = BLOCK_QUESTIONS) -> DataFrame:
    """qid, kb, chunk_id, score, rank: the k nearest by cosine among vectors (kb, chunk_id, embedding) in the scope
    of each question (qid, kb, vector). A question with a list ``doc_ids`` is asked of the vectors of these documents
    (doc_id) only. Questions are counted and travel in broadcasts of about ``block``; each task keeps its own k best
    for a block with one matrix product, so what is shuffled does not grow with the vectors."""
    spark = vectors.sparkSession
    parts = -(-questions.count() // block)
    if parts > 1:
        own = F.pmod(F.xxhash64(F.col("qid")), F.lit(parts))
        found = [vector_search(vectors, questions.filter(own == i), k, clamp, 2 * block) for i in range(parts)]
        return reduce(DataFrame.unionByName, found)
    scoped = "doc_ids" in questions.columns
    asked = questions.select("qid", "kb", "vector", F.col("doc_ids") if scoped else F.lit(None).alias("doc_ids")).collect()  # one block
    shared = spark.sparkContext.broadcast([(q.qid, q.kb, [float(x) for x in q.vector], None if q.doc_ids is None else set(q.doc_ids)) for q in asked])
    schema = f"qid {dict(questions.dtypes)['qid']}, kb {dict(vectors.dtypes)['kb']}, chunk_id {dict(vectors.dtypes)['chunk_id']}, score double"

    out_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def unit(m: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            kbs, ids = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_pylist()
            place = np.argsort(np.array(ids), kind="stable")
            matrix = unit(np.array(batch.column(2).to_pylist(), np.float64))[place]
            kbs, ids = kbs[place], [ids[i] for i in place]
            docs = np.array(batch.column(3).to_pylist(), dtype=object)[place] if scoped else None
            for at in range(0, len(shared.value), 256):
                block = shared.value[at : at + 256]
                scores = np.round(unit(np.array([q[2] for q in block])) @ matrix.T, 6) + 0.0
                rows = []
                for (qid, kb, _, only), s in zip(block, np.maximum(scores, 0) if clamp else scores, strict=True):
                    own = np.arange(len(ids)) if kb is None else np.flatnonzero(kbs == kb)
                    if only is not None:
                        own = np.array([i for i in own if docs[i] in only], np.int64)
                    for i in own[np.argsort(-s[own], kind="stable")[:k]]:
                        rows.append((qid, kbs[i], ids[i], float(s[i])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    columns = ["kb", "chunk_id", "embedding", *(["doc_id"] if scoped else [])]
    return top_k(vectors.select(*columns).mapInArrow(run, schema), ["qid"], k)


def backfill(lexical: DataFrame, nearest: DataFrame, vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """The vector list with the lexical hits that it lacks, at their true cosine (which may be negative)."""
    from ..functions.vectors import cosine

    lacking = lexical.select("qid", "chunk_id").distinct().join(nearest.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    found = lacking.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(questions.select("qid", "vector"), "qid")
    found = found.select("qid", "chunk_id", F.round(cosine(F.col("embedding"), F.col("vector")), 6).alias("score"))
    return nearest.select("qid", "chunk_id", "score").unionByName(found)


def rrf(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """qid, chunk_id, score: reciprocal-rank fusion of lists (qid, chunk_id, score)."""
    parts = []
    for hits in ranked:
        rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id")))
        parts.append(hits.select("qid", "chunk_id", (1.0 / (k + rank)).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))


def rrf_share(score: Column, n_lists: Column) -> Column:
    """Fused score as a number from 0 to 1; not a probability."""
    return F.when(n_lists == 0, 0.0).otherwise(F.least(F.lit(1.0), score / (2.0 * n_lists)))


# -- after the candidates ----------------------------------------------------------------------------


def long_enough(chunks: DataFrame, least: int = MIN_CONTENT) -> DataFrame:
    from ..functions.text import strip

    return chunks.filter(F.length(strip(F.col("content"))) >= least)


def overlap_rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the chunk has."""
    words = questions.select("qid", F.array_distinct(analyze(F.col("question"))).alias("q"))
    text = candidates.join(chunks.select("chunk_id", "content"), "chunk_id").join(words, "qid")
    share = F.size(F.array_intersect("q", analyze(F.col("content")))) / F.greatest(F.size("q"), F.lit(1))
    return text.withColumn("score", F.round(share, 6)).drop("content", "q")


def hydrate(results: DataFrame, chunks: DataFrame, active: DataFrame | None = None, least: int = MIN_CONTENT) -> DataFrame:
    """Ranked results with their source. ``active`` (doc_id, version) keeps chunks of published versions only. The
    snippet is the parent's text where the chunk is short."""
    if active is not None:
        chunks = chunks.join(active.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    text = F.coalesce(F.col("parent_context"), F.col("content")) if "parent_context" in chunks.columns else F.col("content")
    full = results.join(chunks.withColumn("full_text", text), "chunk_id").filter(F.length("full_text") >= least)
    snippet = F.when(F.length("content") < 80, F.col("full_text")).otherwise(F.col("content"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id")))
    return full.withColumns({"snippet": snippet, "score": F.round("score", 4), "rank": rank}).drop("full_text", "content")


def evidence_level(scores: Column, sufficient: float = 0.8, strong: float = 0.6, partial: float = 0.5, weak: float = 0.3) -> Column:
    """sufficient, partial, weak or none, from scores in order of rank (the first counts, not the greatest)."""
    first = F.greatest(F.coalesce(F.get(scores, F.lit(0)), F.lit(0.0)), F.lit(0.0))
    n_strong = F.size(F.filter(scores, lambda s: s >= strong))
    return (
        F.when(F.coalesce(F.size(scores), F.lit(0)) <= 0, "none")
        .when((first >= sufficient) | (n_strong >= 2), "sufficient")
        .when(first >= partial, "partial")
        .when(first >= weak, "weak")
        .otherwise("none")
    )


def contract(row: DataFrame) -> DataFrame:
    """Results as the retriever's public structure: text, score, and a source of nine fields."""
    names = ["chunk_id", "kb", "doc_id", "source", "page", "section", "block_type", "clause_no", "formula_no"]
    fields = [F.col(n) if n in row.columns else F.lit(None).cast("string").alias(n) for n in names]
    return row.select("qid", "rank", F.struct(F.col("snippet").alias("text"), "score", F.struct(*fields).alias("source")).alias("result"))


# -- expansion ---------------------------------------------------------------------------------------


def chapter_of(section: Column) -> Column:
    """First part of a section path."""
    parts = F.filter(F.transform(F.split(section, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(F.get(parts, F.lit(0)), section)


def under_component(section: Column, component: Column) -> Column:
    """The section lies in the component, and no numbered attachment is nested below it."""
    parts = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    marks = F.transform(parts, lambda p: F.startswith(p, component))
    at = F.array_position(marks, F.lit(True)).cast("int")
    below = F.slice(parts, at + 1, F.greatest(F.size(parts), F.lit(1)))
    return (at > 0) & ~F.exists(below, lambda p: p.rlike(r"^附件\d"))


def matched_component(section: Column, focused: Column) -> Column:
    """Deepest part of a section path that, without its leading number, holds the focus or is held by it; null if none."""
    parts = F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != "")
    bare = lambda p: F.regexp_replace(p, r"^[\d.]+\s*", "")
    fits = F.filter(parts, lambda p: F.contains(bare(p), focused) | F.contains(focused, bare(p)))
    return F.when(F.length(focused) > 0, F.try_element_at(fits, F.lit(-1)))


def voted_chapter(pool: DataFrame, chunks: DataFrame, least: int = UNIT_LEAST, depth: int = UNIT_POOL) -> DataFrame:
    """qid, chapter: the chapter that most of the best ``depth`` hits (qid, chunk_id, rank) point to, each with weight
    one over its rank; ties go to the larger chapter, then by name. Chapters of fewer than ``least`` chunks lose."""
    placed = chunks.filter("section is not null and section <> ''").select("chunk_id", chapter_of(F.col("section")).alias("chapter"))
    sizes = placed.groupBy("chapter").agg(F.count("*").alias("size"))
    votes = pool.filter(F.col("rank") <= depth).join(placed, "chunk_id").groupBy("qid", "chapter").agg(F.round(F.sum(1.0 / F.col("rank")), 6).alias("votes"))
    order = W.partitionBy("qid").orderBy(F.desc("votes"), F.desc("size"), "chapter")
    return votes.join(sizes, "chapter").withColumn("r", F.row_number().over(order)).filter((F.col("r") == 1) & (F.col("size") >= least)).select("qid", "chapter", "votes", "size")


def chapter_members(chapters: DataFrame, chunks: DataFrame, cap: int = EXPANDED_UNIT) -> DataFrame:
    """All chunks of each question's chapter, by id, at most ``cap`` (the feature's own limit). Chapters are cut to the cap
    before questions meet them."""
    order = W.partitionBy("chapter").orderBy("chunk_id")
    placed = chunks.select("chunk_id", chapter_of(F.col("section")).alias("chapter")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    return chapters.join(placed, "chapter").select("qid", "chapter", "chunk_id", "rank")


def component_members(asked: DataFrame, chunks: DataFrame, least: int = UNIT_LEAST) -> DataFrame:
    """qid, chunk_id: the chunks under each question's section part (qid, kb, component), where there are at least ``least``.
    Chunks meet questions by each part of their path, never all by all."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("section", F.lit("")), "/"), lambda p: F.trim(p)), lambda p: p != ""))
    paths = chunks.select("kb", "chunk_id", "section", F.explode(parts).alias("part"))
    # a part belongs to a component that it starts with: components are few, the parts are cut to their lengths
    lengths = F.array_sort(F.collect_set(F.length("component")))
    sizes = asked.groupBy().agg(lengths.alias("sizes"))
    heads = paths.join(F.broadcast(sizes)).select("kb", "chunk_id", "section", "part", F.explode("sizes").alias("size")).filter(F.length("part") >= F.col("size"))
    heads = heads.select("kb", "chunk_id", "section", F.col("part").substr(F.lit(1), F.col("size")).alias("component")).distinct()
    own = asked.select("qid", F.col("kb").alias("scope"), "component").join(heads, "component").filter(in_scope(F.col("kb"), F.col("scope")))
    own = own.filter(under_component(F.col("section"), F.col("component"))).select("qid", "chunk_id").distinct()
    return own.withColumn("n", F.count("*").over(W.partitionBy("qid"))).filter(F.col("n") >= least).drop("n")


def whole_document(results: DataFrame, chunks: DataFrame, cap: int = 60, least: int = MIN_CONTENT) -> DataFrame:
    """Chunks of the best hit's document, by id, at most ``cap`` (the feature's own limit). Documents are cut to the cap
    before questions meet them."""
    best = results.filter("rank = 1").select("qid", "doc_id")
    order = W.partitionBy("doc_id").orderBy("chunk_id")
    firsts = chunks.filter(F.length("content") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    return best.join(firsts, "doc_id")


def table_citations(answers: DataFrame, tables: DataFrame) -> DataFrame:
    """Answers of the table channel as results: one a question, of score 1 and rank 1."""
    at = tables.select("table_id", "kb", "doc_id", "source", "section", *(["chunk_id"] if "chunk_id" in tables.columns else []))
    one = answers.select("qid", "table_id", F.col("answer").alias("snippet")).join(at, "table_id").drop("table_id")
    return one.withColumns({"score": F.lit(1.0), "rank": F.lit(1), "block_type": F.lit("table"), "expanded": F.lit("table")})


def candidates(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP_FINAL, rerank=None) -> DataFrame:
    """qid, chunk_id, score, rank of all candidates, and the trace of stages: vectors and words are searched, lexical hits
    get a cosine, both lists are fused and cut to TOP_RERANK, short chunks go, and what lies behind the cut fills up
    to k where fewer are left; a reranker, if given, orders them anew. A question's list ``doc_ids``, if there is one,
    limits both searches; its lexical search goes five times as deep before."""
    nearest = vector_search(vectors, questions)
    if "doc_ids" in questions.columns:
        deep = bm25(questions, chunks, 5 * TOP_LEXICAL).join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(questions.select("qid", "doc_ids"), "qid")
        lexical = deep.filter(F.when(F.col("doc_ids").isNull(), F.col("rank") <= TOP_LEXICAL).otherwise(F.array_contains("doc_ids", F.col("doc_id")))).drop("doc_ids", "doc_id")
    else:
        lexical = bm25(questions, chunks)
    lexical = staged(normalised_by_kb(lexical).drop("rank"), "lexical")
    listed = staged(backfill(lexical, nearest, vectors, questions), "listed")
    fused = rrf(listed, lexical)
    ranked = fused.withColumn("fused_rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id")))).withColumnRenamed("score", "fused_score")
    kept = ranked.join(long_enough(chunks).select("chunk_id", F.lit(True).alias("long")), "chunk_id", "left")
    inside = F.col("fused_rank") <= TOP_RERANK
    n_kept = F.count_if(inside & F.col("long")).over(W.partitionBy("qid"))
    kept = kept.withColumn("room", F.greatest(F.lit(0), F.lit(k) - n_kept)).filter((inside & F.col("long")) | (~inside & (F.col("fused_rank") <= TOP_RERANK + F.col("room"))))
    kept = kept.withColumn("score", F.col("fused_score")).drop("long", "room")
    if rerank is not None:
        kept = rerank(kept, questions, chunks)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), F.asc("chunk_id"))))
    trace = listed.groupBy("qid", "chunk_id").agg(F.max("score").alias("vector_score"))
    words = lexical.groupBy("qid", "chunk_id").agg(F.max("score").alias("lexical_score"))
    return kept.join(trace, ["qid", "chunk_id"], "left").join(words, ["qid", "chunk_id"], "left")


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP_FINAL, rerank=None, tables: DataFrame | None = None, lex: Lexicon = LEXICON) -> DataFrame:
    """qid, chunk_id, score, rank, expanded and the trace of stages, for questions (qid, question, kb, vector and, if asked
    of certain documents only, doc_ids).

    Questions that ``tables`` answer exactly get that answer (expanded is table); the others are expanded with terms,
    searched and ranked (candidates). With a reranker, which sees the question's focus, the section part that the best
    hit shares with the focus comes whole (chapter); a question that asks for all of something gets the chapter that
    its hits vote for (enumeration); any other its k best."""
    answered = None
    if tables is not None:
        words = analyze(F.col("question")) if not lex.words else F.split("question", lex.words)
        open_ = questions.filter("doc_ids IS NULL") if "doc_ids" in questions.columns else questions
        asked = open_.select("qid", "kb", table_kind(F.col("question"), lex).alias("kind"), words.alias("words"))
        answered = staged(table_citations(answer_tables(asked, tables), tables), "table-answers")
        questions = questions.join(answered.select("qid"), "qid", "left_anti")
    questions = staged(questions.withColumns({"asked": F.col("question"), "question": expand(F.col("question"), lex)}), "questions")
    aimed = questions.withColumn("question", focus(F.col("question"), lex))
    order = None if rerank is None else lambda cut, _, texts: rerank(cut, aimed, texts)
    pool = staged(candidates(questions, chunks, vectors, k, order), "candidates")
    placed = chunks.select("chunk_id", "section") if "section" in chunks.columns else None
    best = pool.filter(F.col("rank") <= k).withColumn("expanded", F.lit(None).cast("string"))
    if placed is not None:
        grown = pool.limit(0).select("qid", "chunk_id", "score", "rank").withColumn("expanded", F.lit(None).cast("string"))
        if order is not None:
            top = pool.filter("rank = 1").join(placed, "chunk_id").join(aimed.select("qid", "kb", F.col("question").alias("focused")), "qid")
            parts = top.withColumn("component", matched_component(F.col("section"), F.col("focused"))).filter("component IS NOT NULL").select("qid", "kb", "component")
            members = order(component_members(parts, chunks).withColumn("score", F.lit(0.0)), None, chunks)
            grown = staged(top_k(members.select("qid", "chunk_id", "score"), ["qid"], EXPANDED_CHAPTER).withColumn("expanded", F.lit("chapter")), "chapters")
        listing = questions.filter(is_enumeration(F.col("asked"), lex)).select("qid").join(grown.select("qid").distinct(), "qid", "left_anti")
        units = voted_chapter(pool.join(listing, "qid", "left_semi"), chunks)
        listed = chapter_members(units, chunks, EXPANDED_UNIT if order is None else 2 * EXPANDED_UNIT).withColumn("score", F.lit(0.0)).select("qid", "chunk_id", "score")
        if order is not None:
            listed = order(listed, None, chunks).select("qid", "chunk_id", "score")
        grown = staged(grown.unionByName(top_k(listed, ["qid"], EXPANDED_UNIT).withColumn("expanded", F.lit("enumeration"))), "expanded")
        best = best.join(grown.select("qid").distinct(), "qid", "left_anti").unionByName(grown, allowMissingColumns=True)
        best = best.join(chunks.select("chunk_id", F.col("kb").alias("own")), "chunk_id").join(questions.select("qid", F.col("kb").alias("scope")), "qid")
        best = best.filter(in_scope(F.col("own"), F.col("scope"))).drop("own", "scope")
    return best if answered is None else best.unionByName(answered, allowMissingColumns=True)


def respond(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP_FINAL, rerank=None, tables: DataFrame | None = None, active: DataFrame | None = None, documents: DataFrame | None = None, lex: Lexicon = LEXICON) -> DataFrame:
    """qid, rank, result, level: the retriever's whole answer to a batch of questions.

    ``active`` (doc_id, version) leaves only chunks and vectors of published versions. A question that names documents
    (doc_id, filename, kb) and has no ``doc_ids`` of its own is asked of these. What retrieve() finds becomes the public
    structure (contract) with its source; level says how far the cosines of a question's results support an answer,
    and is sufficient where a table answers exactly."""
    if active is not None:  # by document and version, as two versions of a document may be stored
        keys = ["doc_id", "version"]
        # written, as they are read by every stage below, each of which would move all texts again
        chunks, vectors = (staged(df.join(active.select(*keys), keys, "left_semi"), "published") for df in (chunks, vectors))
    if documents is not None:
        named = named_documents(questions, documents, lex).groupBy("qid").agg(F.collect_list("doc_id").alias("named"))  # a document a name
        given = F.col("doc_ids") if "doc_ids" in questions.columns else F.lit(None).cast("array<bigint>")
        questions = questions.join(named, "qid", "left").withColumn("doc_ids", F.coalesce(given, F.col("named").cast("array<bigint>"))).drop("named")
    found = staged(retrieve(questions, chunks, vectors, k, rerank, tables, lex), "found")
    plain = found.filter("expanded IS NULL OR expanded <> 'table'").select("qid", "chunk_id", "score", "rank", "expanded", "vector_score")
    full = hydrate(plain.drop("rank"), chunks)
    exact = found.filter("expanded = 'table'") if tables is not None else None
    rows = full if exact is None else full.unionByName(exact.select(*(c for c in exact.columns if c in {*full.columns, "block_type"})), allowMissingColumns=True)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("vector_score", F.lit(0.0)).alias("s")))), lambda x: x["s"])  # k a question
    level = rows.groupBy("qid").agg(F.when(F.bool_or(F.coalesce(F.col("expanded") == "table", F.lit(False))), "sufficient").otherwise(evidence_level(scores)).alias("level"))
    return contract(rows).join(level, "qid")


def normal_name(text: Column) -> Column:
    return F.lower(squash(text))
