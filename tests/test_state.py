"""Caches, memory, versions, evaluation, answers and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import hash_embedding, profile_fingerprint
from quillon.functions.vectors import cosine
from quillon.operators import answers as A
from quillon.operators import evaluation as E
from quillon.operators import memory as M
from quillon.operators import relational as Q
from quillon.operators import retrieval as R
from quillon.operators import store as S
from quillon.streaming import jobs as J

ENTRY = "id long, user_id long, kb_id long, doc_scope string, style string, status string, subject string, vector array<double>, answer string, hit_count int, updated_at timestamp"
ASKED = "qid long, user_id long, kb_id long, doc_scope string, style string, subject string, vector array<double>"


def at(spark, text):
    return F.lit(text).cast("timestamp")


def entries(spark, rows):
    return spark.createDataFrame([(*r[:-1], 0, r[-1]) for r in rows], ENTRY.replace("updated_at timestamp", "t string")).withColumn("updated_at", F.col("t").cast("timestamp")).drop("t")


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0, 0.0], [1.0, 0.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([0.0, 0.0], [1.0, 1.0], 0), ([1.0, 0.0], [0.94, (1 - 0.94**2) ** 0.5], 0.94)])
def test_cosine(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b")).alias("v")).first().v == pytest.approx(want)


def test_cache_takes_only_the_best(spark):
    e = entries(spark, [(1, 1, None, None, "s", "good", "x", [1.0, 0.0], "one", "2024-01-01"), (2, 1, None, None, "s", "good", "other", [1.0, 0.1], "two", "2024-01-02"), (3, 1, 5, None, "s", "good", "x", [1.0, 0.0], "kb", "2024-01-02")])
    a = spark.createDataFrame([(1, 1, None, None, "s", "x", [1.0, 0.0]), (2, 1, None, None, "s", "y", [1.0, 0.0]), (3, 2, None, None, "s", "x", [1.0, 0.0]), (4, 1, 5, None, "s", None, [1.0, 0.0])], ASKED)
    got = {r.qid: r.answer for r in M.find_cached(e, a, at(spark, "2024-01-03")).collect()}
    assert got == {1: "one", 4: "kb"}  # 2: the best is of another subject; 3: another user
    assert M.find_cached(e, a, at(spark, "2024-01-03"), ttl_seconds=3600).count() == 0
    moved = {r.id: r.hit_count for r in M.touched(e, M.find_cached(e, a, at(spark, "2024-01-03")), at(spark, "2024-01-03")).collect()}
    assert moved == {1: 1, 2: 0, 3: 1}


def test_memory_prefers_bad(spark):
    e = entries(spark, [(1, 1, None, None, None, "good", "x", [1.0, 0.0], "g", "2024-01-02"), (2, 1, None, None, None, "bad", "x", [0.99, 0.1], "b", "2024-01-01")])
    a = spark.createDataFrame([(1, 1, None, None, None, "x", [1.0, 0.0]), (2, 1, 3, None, None, "x", [1.0, 0.0])], ASKED)
    assert [(r.qid, r.status, r.force_rerank) for r in M.recall(e, a).collect()] == [(1, "bad", True)]
    fresh = entries(spark, [(9, 1, None, None, None, "good", "x", [1.0, 0.0], "new", "2024-02-01")])
    assert {(r.id, r.answer) for r in M.remember(e, fresh).collect()} == {(2, "b"), (9, "new")}


def remembered_by_hand(held, fresh, limit, pool, cap):
    """Rows as dicts, one after the other, as the store of one knowledge base would take them."""
    held = sorted(held, key=lambda r: (r["t"], r["id"]))
    for new in sorted(fresh, key=lambda r: (r["t"], r["id"])):
        if not new["answer"]:
            continue
        own = lambda r: (r["user_id"], r["kb_id"]) == (new["user_id"], new["kb_id"])  # noqa: B023, E731
        scope = [r for r in held if own(r) and (r["doc_scope"], r["style"]) == (new["doc_scope"], new["style"])]
        twin = None
        for r in scope[::-1][:pool]:
            a, b = r["vector"], new["vector"]
            size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
            near = len(a) == len(b) and (sum(x * y for x, y in zip(a, b, strict=True)) / size if size else 0) >= limit
            subject = not r["subject"] or not new["subject"] or r["subject"] in new["subject"] or new["subject"] in r["subject"]
            if near and subject:
                twin = r
                break
        new = dict(new)
        if twin:
            held.remove(twin)
        if twin and twin["status"] == new["status"]:
            new["hit_count"] = twin["hit_count"]
        elif sum(map(own, held)) >= cap:
            for r in [r for r in held if own(r)][: max(1, int(cap * 0.2))]:
                held.remove(r)
        held = sorted([*held, new], key=lambda r: (r["t"], r["id"]))
    return held


@pytest.mark.parametrize(("seed", "pool", "cap"), [(0, 100, 300), (1, 3, 10), (2, 2, 5)])
def test_remember_in_order(spark, seed, pool, cap):
    rng = random.Random(seed)
    kinds = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.9], [0.0, 0.0, 0.0], [1.0, 0.0]]
    rows = [
        {
            "id": i, "user_id": rng.choice([1, 1, 1, 2, None]), "kb_id": rng.choice([5, None]), "doc_scope": rng.choice(["d", None, None]), "style": "s", "status": rng.choice(["good", "bad"]),
            "subject": rng.choice(["x", "xy", "z", "", None]), "vector": rng.choice(kinds), "answer": rng.choice(["a", "b", "b", "", None]), "hit_count": rng.randrange(9), "t": f"2024-01-{1 + i // 12:02d}",
        }
        for i in range(240)
    ]
    frame = lambda part: spark.createDataFrame([tuple(r.values()) for r in part], ENTRY.replace("updated_at timestamp", "t string")).withColumn("updated_at", F.col("t").cast("timestamp"))
    told = lambda df: sorted((r.id, r.hit_count, r.answer) for r in df.collect())
    want = sorted((r["id"], r["hit_count"], r["answer"]) for r in remembered_by_hand([], rows, 0.93, pool, cap))
    whole = M.remember(frame(rows).limit(0), frame(rows), pool=pool, cap=cap)
    assert told(whole) == want and whole.columns == frame(rows).columns
    some = M.remember(M.remember(frame(rows).limit(0), frame(rows[:96]), pool=pool, cap=cap), frame(rows[96:]), pool=pool, cap=cap)
    assert told(some) == want  # batches are like one by one
    assert told(M.remember(frame(rows), frame(rows).limit(0))) == sorted((r["id"], r["hit_count"], r["answer"]) for r in rows)


def test_eviction_and_embedding_cache(spark):
    e = entries(spark, [(i, 1, None, None, None, "good", None, [1.0], str(i), f"2024-01-{i:02d}") for i in range(1, 11)])
    assert sorted(r.id for r in M.store_cached(e, entries(spark, [(99, 1, None, None, None, "good", None, [1.0], "n", "2024-02-01")]), at(spark, "2024-02-01"), cap=10).collect()) == [*range(3, 11), 99]
    chunks = spark.createDataFrame([(1, "h1", "a"), (2, "h1", "a"), (3, "h2", "b")], "chunk_id int, content_hash string, content string")
    p = profile_fingerprint(model="m", dim=64)
    cache = spark.createDataFrame([("h2", "x" * 32, [0.0])], "content_hash string, profile string, vector array<double>")
    full, cache2 = M.embed_missing(chunks, cache, p, hash_embedding)
    assert full.count() == 3 and cache2.count() == 3 and M.embed_missing(chunks, cache2, p, hash_embedding)[1].count() == 3


def test_versions(spark, tmp_path):
    t = S.VersionedTable(spark, str(tmp_path), "chunks")
    assert t.active() is None and t.publish(spark.range(3), "a", 3) == 3
    with pytest.raises(ValueError):
        t.publish(spark.range(4), "b", 5)
    assert t.active() == "a" and t.versions() == ["a"] and t.read().count() == 3
    t.publish(spark.range(4), "c")
    assert t.read().count() == 4 and t.collect_garbage([]) == ["a"] and t.versions() == ["c"]
    with pytest.raises(ValueError):
        t.drop("c")


def test_jobs_table(spark):
    jobs = spark.createDataFrame([(1, 7, "queued", 0, None, None, False, "2024-01-02"), (2, 8, "queued", 0, None, None, False, "2024-01-01"), (3, 9, "running", 1, "w", "2024-01-01", False, "2024-01-01")], "id long, document_id long, stage string, attempt int, lease_owner string, lease_until string, cancel_requested boolean, created_at string")
    jobs = jobs.withColumns({"lease_until": F.col("lease_until").cast("timestamp"), "created_at": F.col("created_at").cast("timestamp")})
    now = at(spark, "2024-01-03")
    assert {r.id: r.stage for r in S.claim(jobs, F.lit("w2"), now).collect()} == {1: "queued", 2: "running", 3: "running"}
    assert {r.id: r.stage for r in S.reap(jobs, now).collect()} == {1: "queued", 2: "queued", 3: "failed"}
    assert S.enqueue(jobs, jobs.filter("id < 3").withColumn("id", F.col("id") + 10)).count() == 3
    assert {(r.id, r.ahead) for r in Q.queued_ahead(jobs).collect()} == {(1, 0), (2, 1)}


def test_export_and_audit(spark, tmp_path):
    m = spark.createDataFrame([(1, 0.123456, "2024-01-01"), (2, 0.5, "2024-01-02")], "id long, score double, updated_at string")
    S.export_memories(m, str(tmp_path / "c"), most=1)
    text = next((tmp_path / "c").glob("part-*.csv")).read_text()
    assert text.startswith("﻿id") and "\n2,0.5," in text
    rows = spark.createDataFrame([("a", "x" * 900)], "action string, detail string")
    assert S.append_audit(rows, str(tmp_path / "audit")) and len(spark.read.parquet(str(tmp_path / "audit")).first().detail) == 500
    assert not S.append_audit(rows, "/proc/none/audit")


def test_evidence_levels(spark):
    for scores, want in (([0.85], "sufficient"), ([0.1, 0.7, 0.65], "sufficient"), ([0.55], "partial"), ([0.3, 0.9], "weak"), ([0.1], "none"), ([], "none")):
        assert spark.createDataFrame([(scores,)], "s array<double>").select(R.evidence_level(F.col("s")).alias("v")).first().v == want


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, i, 1.0 / i) for i in range(1, 6)], "qid int, chunk_id int, score double")
    b = spark.createDataFrame([(1, i, float(i)) for i in range(4, 9)], "qid int, chunk_id int, score double")
    x, y = ({(r.chunk_id, r.score) for r in R.rrf(*p).collect()} for p in ((a, b), (b, a)))
    assert x == y and (8, round(1 / 61, 6)) in x


def test_bm25_order_padding_and_scope(spark):
    c = spark.createDataFrame([("k", 1, "明渠 水深 计算"), ("k", 2, "水泵 选型"), ("k", 3, "明渠 流速"), ("z", 4, "明渠 水深")], "kb string, chunk_id int, content string")
    q = spark.createDataFrame([(1, "明渠 水深", "k"), (2, "明渠 水深", "none")], "qid int, question string, kb string")
    got = R.bm25(q, c, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got if r.qid == 1] == [1, 3] and got[0].score > got[1].score and not [r for r in got if r.qid == 2]
    padded = [r.chunk_id for r in R.bm25(q, c, 3, pad=True).orderBy("rank").collect() if r.qid == 1]
    assert padded == [1, 3, 2]


def test_contract_has_nine_fields(spark):
    rows = spark.createDataFrame([(1, 1, 5, "text", 0.5)], "qid int, rank int, chunk_id int, snippet string, score double")
    got = json.loads(R.contract(rows).select(F.to_json("result", {"ignoreNullFields": "false"}).alias("j")).first().j)
    assert set(got) == {"text", "score", "source"} and len(got["source"]) == 9


def test_sections(spark):
    f = lambda s, c: spark.createDataFrame([(s, c)], "s string, c string").select(R.under_component(F.col("s"), F.col("c")).alias("v")).first().v
    assert f("5 应急保障 / 5.1 制度", "5 应急保障") and not f("15 应急保障", "5 应急保障") and not f("5 应急保障 / 附件5", "5 应急保障") and not f(None, "5")


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "general", "k", ["alpha"], ["4.3"]), (2, "table", "k", ["beta"], None), (3, "general", "z", ["none"], ["9"])], "qid int, intent string, kb string, expect_keywords array<string>, expect_clauses array<string>")
    res = spark.createDataFrame([(1, 6, "has alpha", "4.3 title", "f", 1, None), (2, 1, "beta", None, "f", 0, None), (1, 1, "no", "4.30 x", "f", None, None)], "qid int, rank int, snippet string, section string, source string, page int, clause_no string")
    got = {r.qid: r for r in E.scored_questions(gold, res).collect()}
    assert (got[1].recall5, got[1].recall10, got[1].clause5, got[1].clause10, got[1].citation) == (False, True, False, True, True)
    assert (got[2].recall5, got[2].clause5, got[2].citation) == (True, None, False) and not got[3].recall10
    total = next(r for r in E.summary(E.scored_questions(gold, res)).collect() if r.intent is None and r.kb is None)
    assert (total.n, total.recall5, total.recall10, total.clause10, total.clause_n) == (3, 0.3333, 0.6667, 0.5, 2)
    m = lambda v: spark.createDataFrame([("r5", v)], "measure string, value double")
    assert [E.gate(m(v), m(0.9)).first().passed for v in (0.9, 0.89, 0.8899)] == [True, True, False]
    chunks = spark.createDataFrame([("k", "alpha text"), ("k", "beta")], "kb string, content string")
    assert [(r.qid, r.keyword) for r in E.unsupported_gold(gold, chunks).collect()] == [(3, "none")]
    t = spark.createDataFrame([(1, 1), (1, 2)], "qid int, chunk_id int")
    assert {(r.chunk_id, r.lost_at) for r in E.root_cause(t, ("vector", t), ("fused", t.filter("chunk_id = 1"))).collect()} == {(1, None), (2, "fused")}


def test_verdicts(spark):
    d = spark.createDataFrame([("see [1] and [9]", 2, 'ok {"enumeration": true, "complete": false, "note": "n"}'), ("", 2, "junk"), ("x [7]", 0, None)], "answer string, n_sources int, reply string")
    got = A.citation_verdict(d).withColumn("v", A.completeness_verdict(F.col("reply"))).collect()
    assert [(r.bad_numbers, r.ok) for r in got] == [([9], False), ([], True), ([], True)]
    assert [(r.v.enumeration, r.v.complete) for r in got] == [(True, False), (False, True), (False, True)]
    one = spark.createDataFrame([(["a", "b", "c"],)], "c array<string>")
    assert one.select(A.picked_lines(F.col("c"), F.lit("`[0, 2, 9]`"))).first()[0] == ["a", "c"] and one.select(A.picked_lines(F.col("c"), F.lit("no"))).first()[0] == []
    assert one.select(A.confirmed_numbers(F.col("c"), F.lit('{"missing": ["b", "z"]}'))).first()[0] == ["b"] and one.select(A.confirmed_numbers(F.col("c"), F.lit("no"))).first()[0] == ["a", "b", "c"]


def test_job_steps():
    assert J.step("", 0, 0, False, "enqueue", 0) == ("queued", 0, 0, False)
    assert J.step("queued", 0, 0, False, "claim", 1000) == ("running", 1, 121_000, False)
    assert J.step("running", 1, 121_000, False, "heartbeat", 61_000) == ("running", 1, 181_000, False)
    assert J.step("running", 1, 121_000, False, "succeed", 122_000) == ("failed", 1, 121_000, False)
    assert J.step("succeeded", 1, 0, False, "cancel", 0)[0] == "succeeded"


def test_a_cancel_waits_for_the_border():
    pending = J.step("running", 1, 121_000, False, "cancel", 2000)
    assert pending == ("running", 1, 121_000, True)
    assert J.step(*pending, "heartbeat", 3000) == ("running", 1, 123_000, True)
    assert J.step(*pending, "border", 3000) == ("cancelled", 1, 121_000, False)
    assert J.step(*pending, "succeed", 3000) == ("succeeded", 1, 121_000, False)  # what is made stays
    assert J.step(*pending, "fail", 3000) == ("failed", 1, 121_000, False)
    assert J.step("running", 1, 121_000, False, "border", 3000) == ("running", 1, 123_000, False)
    assert J.step("queued", 0, 0, False, "cancel", 0)[0] == "cancelled"


def test_cache_entries_expire_by_key_and_survive_a_restart(spark, tmp_path):
    src, ckpt, out = (str(tmp_path / x) for x in ("src", "ckpt", "out"))

    def run(rows, batch):
        spark.createDataFrame(rows, "key long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        stream = J.live_entries(spark.readStream.schema("key long, at timestamp").parquet(src), 600, "0 seconds")
        q = stream.writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{out}/run={batch}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return {(r.key, r.since.strftime("%H:%M"), r.uses, r.expired) for r in spark.read.parquet(f"{out}/run={batch}").collect()}

    first = run([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:04:00"), (1, "2024-01-01 00:30:00")], 1)
    assert first >= {(1, "00:00", 2, True), (1, "00:30", 1, False), (2, "00:04", 1, False)}
    second = run([(1, "2024-01-01 00:35:00"), (2, "2024-01-01 00:36:00"), (3, "2024-01-01 01:30:00")], 2)
    # the state of 1 was kept over the restart; 2 had expired, so its use made a new entry
    assert {(1, "00:30", 2, False), (2, "00:36", 1, False), (3, "01:30", 1, False)} <= second | first and (2, "00:04", 1, True) in first | second
    third = run([(4, "2024-01-01 03:00:00")], 3)
    assert {(1, "00:30", 2, True), (2, "00:36", 1, True)} <= second | third


def test_job_stream_survives_a_restart(spark, tmp_path):
    src, ckpt, out = (str(tmp_path / x) for x in ("src", "ckpt", "out"))

    def feed(n, rows):
        spark.createDataFrame(rows, "job_id long, document_id long, event string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").json(src)

    def run():
        q = J.job_stages(J.job_events(spark, src)).writeStream.outputMode("update").option("checkpointLocation", ckpt).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/v={i}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    feed(0, [(1, 1, "enqueue", "2024-01-01 00:00:00"), (1, 1, "enqueue", "2024-01-01 00:00:00"), (2, 2, "enqueue", "2024-01-01 00:00:01"), (1, 1, "claim", "2024-01-01 00:00:05")])
    run()
    feed(1, [(1, 1, "heartbeat", "2024-01-01 00:01:00"), (1, 1, "succeed", "2024-01-01 00:02:30"), (2, 2, "cancel", "2024-01-01 00:03:00")])
    run()
    rows = spark.read.option("recursiveFileLookup", "false").parquet(out).orderBy("v").collect()
    last = {r.job_id: (r.stage, r.attempt) for r in rows}
    assert last == {1: ("succeeded", 1), 2: ("cancelled", 0)}


def test_publishing_batches(spark, tmp_path):
    spark.range(5).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
    q = J.publish_each(stream, str(tmp_path / "ck"), lambda b, v: b.write.mode("overwrite").parquet(str(tmp_path / "out" / v)))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out" / "*")).count() == 5


def test_white_space_goes_as_by_the_expression_and_hashes_are_made_once(spark, sf):
    import re

    from quillon import plans
    from quillon.functions.text import NARROW_SPACES, SPACE, WIDE_SPACES, squash, strip

    marks = NARROW_SPACES + WIDE_SPACES
    rows = [(None,), ("",), (" ",), (marks,), (f"{marks}a{marks}é b​{marks}",), ("a\tb c",), ("中　文 ",), ("\x1c\x85x\x1f",), ("a ",)]
    got = spark.createDataFrame(rows, "t string").select("t", squash(F.col("t")).alias("s"), strip(F.col("t")).alias("e"), F.regexp_replace("t", SPACE + "+", "").alias("x")).collect()
    own = f"[{re.escape(marks)}]+"
    assert all(r.s == r.x and r.s == (None if r.t is None else re.sub(own, "", r.t)) for r in got)
    assert all(r.e == (None if r.t is None else r.t.strip(marks)) for r in got)
    plan = plans.queries()["m1_embed_missing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "documents.parquet" not in plan  # only the stage of hashes is read, more than once


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scanned_texts_hold_what_they_contain(spark, seed, monkeypatch):
    import random

    from quillon.operators import substrings as P

    rng = random.Random(seed)
    monkeypatch.setattr(P, "STEP", rng.choice([5, 64, 1 << 20]))  # matches reach over steps, never over texts
    letters = rng.choice(["ab", "abcdefgh ", "aé中𐍈"])
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(i % 7, word(rng.randrange(60))) for i in range(120)] + [(3, None), (None, word(30)), (4, "")]
    patterns = sorted({word(rng.randrange(1, 30)) for _ in range(60)} | {t[rng.randrange(len(t)) :] for _, t in texts if t} | {texts[0][1][:40] or "a"})
    got = sorted((r.id is None, r.id or 0, r.pattern) for r in P.scanned(spark.createDataFrame(texts, "id long, text string").repartition(3), patterns).collect())
    assert got == sorted({(i is None, i or 0, p) for i, t in texts for p in patterns if t and p in t})


def test_few_and_many_keywords_give_the_same(spark, monkeypatch):
    gold = spark.createDataFrame([(1, "k", ["alpha", "zz"]), (2, "k", ["b", "", "beta x"]), (3, "j", ["", "a"]), (4, None, ["alpha"])], "qid long, kb string, expect_keywords array<string>")
    chunks = spark.createDataFrame([("k", "alpha text"), ("k", "beta"), ("j", "none"), (None, "alpha")], "kb string, content string")
    few = sorted((r.qid, r.keyword) for r in E.unsupported_gold(gold, chunks).collect())
    monkeypatch.setattr(E, "SCANNED", 2)
    assert few == sorted((r.qid, r.keyword) for r in E.unsupported_gold(gold, chunks).collect()) == [(1, "zz"), (2, "beta x"), (3, "a"), (4, "alpha")]
