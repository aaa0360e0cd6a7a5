"""Retrieval over the documents, embeddings and benchmark tables: a knowledge base is a language or a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import analyze
from ..functions.vectors import dot, norm
from ..operators import retrieval as R
from ..operators.lexical import PostingsIndex
from ..staging import new_path, small
from .registry import query, read


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("kb"), F.col("doc_id").alias("chunk_id"), "doc_id", F.col("source").alias("section"), F.col("text").alias("content"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.lit(None).cast("string").alias("kb"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("kb"), F.col("vec_id").alias("chunk_id"), "embedding")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100."""
    return read(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("kb"), F.col("embedding").alias("vector"))


TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
BM25 = f"""
d AS (SELECT lang AS kb, doc_id AS chunk_id, {TERMS} AS terms FROM documents),
s AS (SELECT kb, count(*) AS n, avg(len(terms)) AS avgdl FROM d GROUP BY kb),
p AS (SELECT kb, chunk_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT kb, chunk_id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL),
i0 AS (SELECT p.kb, term, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM p JOIN s USING (kb) GROUP BY p.kb, term),
i AS (SELECT kb, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY kb) ELSE raw END AS idf FROM i0),
q AS (SELECT item_id AS qid, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
b AS (SELECT qid, p.kb, chunk_id, round(sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM p JOIN q USING (term) JOIN s ON s.kb = p.kb JOIN i ON i.kb = p.kb AND i.term = p.term GROUP BY qid, p.kb, chunk_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid, kb ORDER BY score DESC, chunk_id) AS rank FROM b QUALIFY rank <= 50)
"""
COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))"


@query("r1_tokens", rf"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term")
def r1_tokens(spark, sf_dir):
    terms = read(spark, sf_dir, "documents").select("doc_id", F.explode_outer(analyze(F.col("text"))).alias("term")).filter("term IS NOT NULL")
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("k")).groupBy("term").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))


@query("r2_bm25", f"WITH {BM25} SELECT qid, kb, chunk_id, score, rank FROM bm WHERE rank <= 10")
def r2_bm25(spark, sf_dir):
    return R.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), 50).filter("rank <= 10").select("qid", "kb", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("k4_stored_postings", f"WITH {BM25} SELECT qid, kb, chunk_id, score, rank FROM bm")
def k4_stored_postings(spark, sf_dir):
    """An index of two segments, of which one is then replaced by the segment of a newer version."""
    index, all_ = PostingsIndex(spark, new_path(spark, "postings")), chunks(spark, sf_dir)
    revised = F.col("chunk_id") % 10 == 3
    index.add(all_.filter(~revised), "first")
    index.add(all_.filter(revised).withColumn("content", F.reverse("content")), "draft")
    index.publish(["first", "draft"], "one")
    index.add(all_.filter(revised), "final")
    index.publish(["first", "final"], "two", expected="one")
    return index.search(questions(spark, sf_dir)).select("qid", "kb", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("r3_bm25_normalised", f"WITH {BM25}, n AS (SELECT *, max(score) OVER (PARTITION BY qid, kb) AS best FROM bm) SELECT qid, kb, chunk_id, round(score / best, 6) AS score FROM n WHERE best > 0")
def r3_bm25_normalised(spark, sf_dir):
    return R.normalised_by_kb(R.bm25(questions(spark, sf_dir), chunks(spark, sf_dir), 50)).select("qid", "kb", "chunk_id", "score")


@query("a8_corpus_stats", f"WITH d AS (SELECT lang AS kb, len({TERMS}) AS dl FROM documents) SELECT kb, count(*) AS n, round(avg(dl), 6) AS avgdl FROM d GROUP BY kb")
def a8_corpus_stats(spark, sf_dir):
    return R.corpus_stats(R.term_table(chunks(spark, sf_dir)))[0].select("kb", "n", F.round("avgdl", 6).alias("avgdl"))


@query("r4_vector_top50", f"""SELECT q.vec_id AS qid, e.vec_id AS chunk_id, greatest(round({COS}, 6), 0) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(round({COS}, 6), 0) DESC, e.vec_id) AS rank
FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0 QUALIFY rank <= 50""")
def r4_vector_top50(spark, sf_dir):
    return R.vector_search(vectors(spark, sf_dir), vector_questions(spark, sf_dir)).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query("r5_cosine", f"SELECT q.vec_id AS qid, e.vec_id AS chunk_id, round({COS}, 6) AS cosine FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 100 = 0")
def r5_cosine(spark, sf_dir):
    # a vector's length is found once, not again for each pair
    asked = vector_questions(spark, sf_dir).withColumn("length", norm(F.col("vector")))
    near = vectors(spark, sf_dir).withColumn("size", norm(F.col("embedding"))).join(small(asked), "kb")
    sizes = F.col("size") * F.col("length")
    near = near.withColumn("cosine", F.when(sizes == 0, F.lit(0.0)).otherwise(dot(F.col("embedding"), F.col("vector")) / sizes))
    return near.select("qid", "chunk_id", F.round("cosine", 6).alias("cosine"))


def _mixed(spark, sf_dir):
    """Questions with words and a vector: benchmark items and the vectors with their ids; chunks whose ids have vectors."""
    v = vectors(spark, sf_dir)
    asked = questions(spark, sf_dir).join(v.select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("vector")), "qid")
    return asked, chunks(spark, sf_dir), v.withColumn("kb", F.col("kb").cast("string"))


HYBRID = f"""WITH {BM25},
lx0 AS (SELECT qid, kb, chunk_id, score, max(score) OVER (PARTITION BY qid, kb) AS best FROM bm JOIN (SELECT vec_id AS qid FROM embeddings) USING (qid)),
lx AS (SELECT qid, kb, chunk_id, round(score / best, 6) AS score FROM lx0 WHERE best > 0),
v AS (SELECT q.vec_id AS qid, e.vec_id AS chunk_id, round({COS}, 6) AS c FROM embeddings q JOIN (SELECT item_id FROM benchmark) b ON b.item_id = q.vec_id CROSS JOIN embeddings e),
vt AS (SELECT qid, chunk_id, greatest(c, 0) AS score, row_number() OVER (PARTITION BY qid ORDER BY greatest(c, 0) DESC, chunk_id) AS r FROM v QUALIFY r <= 50),
vl AS (SELECT qid, chunk_id, score FROM vt UNION ALL SELECT qid, chunk_id, c FROM v WHERE (qid, chunk_id) IN (SELECT (qid, chunk_id) FROM lx) AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM vt)),
parts AS (SELECT qid, chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)) AS part FROM vl
  UNION ALL SELECT qid, chunk_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id)) FROM lx),
fused AS (SELECT qid, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY qid, chunk_id)
"""


@query("r7_rrf", HYBRID + "SELECT qid, chunk_id, score FROM fused")
def r7_rrf(spark, sf_dir):
    asked, c, v = _mixed(spark, sf_dir)
    nearest, lexical = R.vector_search(v, asked), R.normalised_by_kb(R.bm25(asked, c))
    return R.rrf(R.backfill(lexical, nearest, v, asked), lexical)


@query("r20_retrieve", HYBRID + r""",
cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS fr FROM fused QUALIFY fr <= 100),
ok AS (SELECT cut.* FROM cut JOIN documents ON doc_id = chunk_id WHERE length(trim(text, E' \t\n\r')) >= 40)
SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ok QUALIFY rank <= 5""")
def r20_retrieve(spark, sf_dir):
    asked, c, v = _mixed(spark, sf_dir)
    return R.retrieve(asked, c, v).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


LIVE = HYBRID.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 9)").replace("CROSS JOIN embeddings e)", "CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id % 10 <> 9)) e)")


@query("r20_responses", LIVE + r""",
cut AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS fr FROM fused QUALIFY fr <= 100),
ok AS (SELECT cut.*, text, lang, source FROM cut JOIN documents ON doc_id = chunk_id WHERE length(trim(text, E' \t\n\r')) >= 40),
best5 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ok QUALIFY rank <= 5),
near5 AS (SELECT t.*, coalesce((SELECT max(vl.score) FROM vl WHERE vl.qid = t.qid AND vl.chunk_id = t.chunk_id), 0) AS near FROM best5 t),
lev AS (SELECT qid, max(CASE WHEN rank = 1 THEN near END) AS top, count(*) FILTER (near >= 0.6) AS strong FROM near5 GROUP BY qid)
SELECT qid, rank, chunk_id, sha256(text) AS text, round(score, 4) AS score, lang AS kb, source AS section, CASE WHEN top >= 0.8 OR strong >= 2 THEN 'sufficient' WHEN top >= 0.5 THEN 'partial' WHEN top >= 0.3 THEN 'weak' ELSE 'none' END AS level FROM near5 JOIN lev USING (qid)""")
def r20_responses(spark, sf_dir):
    """Whole answers from the published versions; each tenth document has none."""
    asked, c, v = _mixed(spark, sf_dir)
    c = c.withColumn("version", F.lit(2))
    v = v.withColumns({"doc_id": F.col("chunk_id"), "version": F.lit(2)})
    old = c.withColumns({"version": F.lit(1), "chunk_id": F.col("chunk_id") + 1_000_000_000, "content": F.lit("withdrawn text of an old version")})
    live = c.filter("doc_id % 10 <> 9").select("doc_id", "version")
    r = R.respond(asked, c.unionByName(old), v, active=live)
    return r.select("qid", F.col("rank").cast("long").alias("rank"), F.col("result.source.chunk_id").alias("chunk_id"), F.sha2("result.text", 256).alias("text"), "result.score", F.col("result.source.kb").alias("kb"), F.col("result.source.section").alias("section"), "level")


@query("r9_rerank")
def r9_rerank(spark, sf_dir):
    asked, c, v = _mixed(spark, sf_dir)
    return R.retrieve(asked, c, v, rerank=R.overlap_rerank).select("qid", "chunk_id", "score", F.col("rank").cast("long").alias("rank"), "fused_rank")


@query("r16_hydrate", f"""WITH {BM25}, o AS (SELECT qid, chunk_id, max(score) AS score FROM bm GROUP BY qid, chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM o QUALIFY r <= 5)
SELECT qid, chunk_id, source AS section, text AS snippet, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank
FROM t JOIN documents d ON d.doc_id = t.chunk_id WHERE length(text) >= 40""")
def r16_hydrate(spark, sf_dir):
    best = R.bm25(questions(spark, sf_dir), chunks(spark, sf_dir)).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    top = R.top_k(best, ["qid"], 5).drop("rank")
    return R.hydrate(top, chunks(spark, sf_dir)).select("qid", "chunk_id", "section", "snippet", "score", F.col("rank").cast("long").alias("rank"))


@query("r15_voted_chapter", f"""WITH {BM25}, o AS (SELECT qid, chunk_id, max(score) AS score FROM bm GROUP BY qid, chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM o QUALIFY r <= 200),
z AS (SELECT source AS chapter, count(*) AS size FROM documents GROUP BY 1),
v AS (SELECT qid, source AS chapter, round(sum(1.0::DOUBLE / r), 6) AS votes FROM t JOIN documents d ON d.doc_id = t.chunk_id GROUP BY 1, 2)
SELECT qid, chapter, votes, size FROM v JOIN z USING (chapter) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, size DESC, chapter) = 1 AND size >= 4""")
def r15_voted_chapter(spark, sf_dir):
    best = R.bm25(questions(spark, sf_dir), chunks(spark, sf_dir)).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    return R.voted_chapter(R.top_k(best, ["qid"], 200), chunks(spark, sf_dir))


@query("r18_evidence", f"""WITH s AS (SELECT q.vec_id AS qid, greatest(round({COS}, 6), 0) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY greatest(round({COS}, 6), 0) DESC, e.vec_id) AS rank
FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5),
g AS (SELECT qid, max(CASE WHEN rank = 1 THEN score END) AS top, count(*) FILTER (score >= 0.6) AS strong FROM s GROUP BY qid)
SELECT qid, CASE WHEN top >= 0.8 OR strong >= 2 THEN 'sufficient' WHEN top >= 0.5 THEN 'partial' WHEN top >= 0.3 THEN 'weak' ELSE 'none' END AS level FROM g""")
def r18_evidence(spark, sf_dir):
    hits = R.vector_search(vectors(spark, sf_dir), vector_questions(spark, sf_dir), 6).filter("qid <> chunk_id")
    hits = R.top_k(hits.drop("rank"), ["qid"], 5)
    scores = hits.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    return scores.select("qid", R.evidence_level(F.col("scores")).alias("level"))
