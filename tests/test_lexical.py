"""BM25 over blocks of postings against brute force; the stored index against a rebuild."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import functions as F

from quillon.operators import lexical as L
from quillon.operators.store import Manifest

CHUNK, QUESTION = "kb string, chunk_id long, content string", "qid long, question string, kb string"


def corpus(seed=1, n=400):
    rng = random.Random(seed)
    words = [f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(5000)]
    rows = [(rng.choice(["a", "a", "b"]), i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(n)]
    rows += [("a", n + i, "tie w1 w2") for i in range(60)] + [("b", n + 100, ""), ("b", n + 101, None), ("one", n + 102, "w1 alone"), (None, n + 103, "w1 w2")]
    asked = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 8]))), rng.choice([None, "a", "b"])) for i in range(30)]
    return rows, [*asked, (100, "tie w1 w1", None), (101, "nowhere", None), (102, "", "a"), (103, None, None)]


def by_hand(rows, asked, k):
    out = []
    for kb in {r[0] for r in rows if r[0] is not None}:
        docs = {i: Counter((t or "").lower().split()) for b, i, t in rows if b == kb}
        df = Counter(w for d in docs.values() for w in d)
        n, avgdl = len(docs), sum(d.total() for d in docs.values()) / len(docs)
        raw = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {w: x if x >= 0 else L.FLOOR * mean for w, x in raw.items()}
        for qid, question, scope in asked:
            if scope not in (None, kb):
                continue
            q = Counter((question or "").lower().split())
            scores = []
            for i, d in docs.items():
                if q.keys() & d.keys():
                    s = sum(c * idf[w] * d[w] * (L.K1 + 1) / (d[w] + L.K1 * (1 - L.B + L.B * d.total() / avgdl)) for w, c in q.items() if w in d)
                    scores.append((-round(s, 6), i))
            out += [(qid, kb, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def plain(df):
    return sorted((r.qid, r.kb, r.chunk_id, round(r.score, 6), r["rank"]) for r in df.collect())


def same(got, want):
    assert [(g[0], g[1], g[2], g[4]) for g in got] == [(w[0], w[1], w[2], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("k", [1, 10, 1000])
@pytest.mark.parametrize("block", [1024, 7])
def test_blocks_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows, asked = corpus()
    got = plain(L.bm25(spark.createDataFrame(asked, QUESTION), spark.createDataFrame(rows, CHUNK).repartition(3), k))
    same(got, by_hand(rows, asked, k))


class Pair(AccumulatorParam):
    def zero(self, _):
        return (0, 0)

    def addInPlace(self, a, b):
        return (a[0] + b[0], a[1] + b[1])


def test_blocks_below_the_kth_score_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    rows, asked = corpus(n=600)
    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    size, idf = L.corpus_stats(L.term_table(chunks))
    count = spark.sparkContext.accumulator((0, 0), Pair())
    got = plain(L.search(lambda terms: L.postings(chunks, terms), size, idf, questions, 2, count))
    same(got, by_hand(rows, asked, 2))
    seen, left_out = count.value
    assert 0.2 * seen < left_out < seen


def test_questions_in_several_broadcasts(spark):
    rows, asked = corpus(n=50)
    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    size, idf = L.corpus_stats(L.term_table(chunks))
    same(plain(L.search(lambda terms: L.postings(chunks, terms), size, idf, questions, 5, block=9)), by_hand(rows, asked, 5))
    assert L.bm25(questions, chunks.limit(0)).count() == 0 == L.bm25(questions.limit(0), chunks).count()


def test_only_rows_of_k_a_task_are_shuffled_by_question(spark):
    rows, asked = corpus(n=50)
    plan = L.bm25(spark.createDataFrame(asked, QUESTION), spark.createDataFrame(rows, CHUNK), 5)._jdf.queryExecution().executedPlan().toString()
    scored = plan[: plan.index("MapInArrow")]  # what lies above the scoring of blocks
    assert scored.count("Exchange hashpartitioning(qid") == 1 and "WindowGroupLimit" in scored and "Join" not in scored


def test_index_updated_by_segments_equals_a_rebuild(spark, tmp_path):
    rows, asked = corpus()
    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    index = L.PostingsIndex(spark, f"{tmp_path}/index")
    with pytest.raises(LookupError):
        index.search(questions)
    index.add(chunks.filter("chunk_id % 3 <> 0"), "s1")
    index.add(chunks.filter("chunk_id % 3 = 0").selectExpr("kb", "chunk_id", "concat(content, ' w1 w1 old') AS content"), "s2")
    index.publish(["s1", "s2"], "v1", chunks="c1", vectors="e1")
    before = plain(index.search(questions, 10))
    index.add(chunks.filter("chunk_id % 3 = 0"), "s3")
    assert plain(index.search(questions, 10)) == before  # nothing moves before it is published
    with pytest.raises(ValueError):
        index.publish(["s1", "s3"], "v2", expected="v0")
    assert plain(index.search(questions, 10)) == before and index.manifest.read()["vectors"] == "e1"
    index.publish(["s1", "s3"], "v2", expected="v1", chunks="c2", vectors="e2")
    same(plain(index.search(questions, 10)), by_hand(rows, asked, 10))
    assert {k: index.manifest.read()[k] for k in ("state", "chunks", "vectors")} == {"state": "v2", "chunks": "c2", "vectors": "e2"}


def test_index_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    rows, _ = corpus()
    index = L.PostingsIndex(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(rows, CHUNK), "s1")
    index.publish(["s1"], "v1")
    found = index.read(["w1"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan)
    assert {r.term for r in found.collect()} == {"w1"}


def test_a_manifest_that_was_not_written_whole_does_not_count(spark, tmp_path):
    m = Manifest(spark, f"{tmp_path}/m")
    m.switch({"state": "a"})
    (tmp_path / "m" / f"{2:012d}").write_text('{"state": "b"')
    assert m.read() == {"state": "a"}
    m.switch({"state": "c"}, expected="a")
    assert m.read() == {"state": "c"}


def test_whole_answers_of_tables_named_documents_and_live_versions(spark):
    from quillon.operators import retrieval as R
    from tests import inline_cases as I

    rows = [("a", i, d, s, t, 1) for i, d, s, t in I.SECTIONS] + [("a", 100 + i, d, s, "旧版：" + t, 0) for i, d, s, t in I.SECTIONS]
    chunks = spark.createDataFrame(rows, "kb string, chunk_id long, doc_id long, section string, content string, version int")
    vectors = spark.createDataFrame([("a", i, d, I.VECTORS[i], 1) for i, d, _, _ in I.SECTIONS], "kb string, chunk_id long, doc_id long, embedding array<double>, version int")
    active = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, version int")  # document 3 is withdrawn
    files = spark.createDataFrame([(2, "总则说明.pdf", "a"), (3, "水泵手册.pdf", "a")], "doc_id long, filename string, kb string")
    asked = [(1, "动力配电箱的数量是多少", "a", [1.0, 0.0, 0.0]), (2, "《总则说明》写了什么", "a", [1.0, 0.0, 0.0]), (3, "水泵选型", "a", [0.0, 0.0, 1.0])]
    questions = spark.createDataFrame(asked, "qid long, question string, kb string, vector array<double>")
    found = R.respond(questions, chunks, vectors, 3, tables=I.tables(spark), active=active, documents=files).collect()
    by = {q: sorted((r for r in found if r.qid == q), key=lambda r: r["rank"]) for q in (1, 2, 3)}
    assert [(r.result.text, r.level) for r in by[1]] == [("动力配电箱 数量: 3", "sufficient")]
    assert sorted(r.result.source.chunk_id for r in by[2]) == [11, 12, 13]  # of the named document only, though others are nearer
    assert by[3] and all(r.result.source.chunk_id < 20 for r in by[3])  # neither old versions nor the withdrawn document
    assert all(len(r.result.source) == 9 for r in found)


def test_batches_are_bounded_and_questions_are_weighed_in_parts(spark, monkeypatch):
    from quillon import staging
    from quillon.operators import lexical

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    chunks = spark.createDataFrame([("a" if i % 3 else "b", i, " ".join(f"w{i * j % 17}" for j in range(1, 9))) for i in range(300)], "kb string, chunk_id long, content string")
    asked = spark.createDataFrame([(q, f"w{q % 17} w{q * 3 % 17} w{q % 17}", None if q % 2 else "a") for q in range(40)], "qid long, question string, kb string")
    rows = lambda: sorted(tuple(r) for r in lexical.bm25(asked, chunks, 7).collect())
    want = rows()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == staging.BATCH_ROWS
    monkeypatch.setattr(lexical, "AT_ONCE", 3)
    assert rows() == want and len(want) > 100


def test_batches_are_put_together_again():
    from quillon import staging

    parts = [pa.record_batch({"x": list(range(n))}) for n in (3, 0, 4, 9, 1)]
    assert [b.num_rows for b in staging.gathered(parts, 6)] == [7, 9, 1]


def test_lengths_of_vectors_are_found_before_pairs(spark, sf):
    from quillon import plans

    plan = plans.queries()["r5_cosine"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[0].count("aggregate(") == 1


def test_chunks_are_analysed_once(spark, tmp_path):
    rows, asked = corpus(n=50)
    rows = [*rows, (rows[0][0], 99_999, "")]  # a chunk without words counts in the means
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    chunks, questions = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, QUESTION)
    counted = chunks.withColumn("content", read("content"))
    same(plain(L.bm25(questions, counted, 5)), by_hand(rows, asked, 5))
    assert seen.value == len(rows)
    index = L.PostingsIndex(spark, f"{tmp_path}/index")
    index.add(counted, "s1")
    assert seen.value == 2 * len(rows)
    told = lambda df: sorted((r.kb, r.term or "", r.df, r.n, r.words) for r in df.filter("kb IS NOT NULL").groupBy("kb", "term").agg(*(F.sum(c).alias(c) for c in ("df", "n", "words"))).collect())
    totals = lambda found: ({(k, t): d for k, t, d, _, _ in found if t}, {k: (sum(n for a, _, _, n, _ in found if a == k), sum(w for a, *_, w in found if a == k)) for k, *_ in found})
    assert totals(told(spark.read.parquet(f"{tmp_path}/index/counts/segment=s1"))) == totals(told(L.term_table(chunks)))
