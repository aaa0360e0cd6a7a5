"""Text structure, table, cache, memory and evaluation operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import memory as M
from ..operators import retrieval as R
from ..operators import structure as S
from ..operators import tables as T
from ..operators import understanding as U
from ..sources import readers
from ..staging import staged
from . import retrieval_queries as RQ
from .registry import query, read

SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SQUASH = f"regexp_replace(text, '{SPACE}', '', 'g')"
LINES = f"SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents"


def blocks(spark, sf_dir):
    """One block a line of each document; the page is the document's own number in its source."""
    lines = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("idx", "text"))
    return lines.select("doc_id", "idx", "text", F.col("source").alias("section"), F.lit(1).alias("page"), F.lit("paragraph").alias("block_type"))


@query("c10_content_hash", f"SELECT doc_id, sha256({SQUASH}) AS content_hash FROM documents")
def c10_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("c17_repeated_lines", f"WITH l AS (SELECT DISTINCT source, doc_id, regexp_replace(line, '{SPACE}', '', 'g') AS key FROM ({LINES})) SELECT source, key, count(*) AS n_pages FROM l WHERE length(key) BETWEEN 4 AND 60 GROUP BY ALL HAVING count(*) >= 3")
def c17_repeated_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.lit(0).alias("idx"), "text", F.col("doc_id").alias("page"))
    return S.repeated_lines(d, share=0.0).withColumnRenamed("doc_id", "source")


@query("c17_without_repeated", f"""WITH l AS (SELECT doc_id, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, regexp_replace(line, '{SPACE}', '', 'g') AS key FROM l),
r AS (SELECT source, key FROM (SELECT DISTINCT source, doc_id, key FROM k) WHERE length(key) BETWEEN 4 AND 60 GROUP BY ALL HAVING count(*) >= 3)
SELECT doc_id, count(*) AS n_lines FROM k WHERE (source, key) NOT IN (SELECT (source, key) FROM r) GROUP BY doc_id
HAVING trim(string_agg(line, chr(10) ORDER BY i), E' \\n\\t\\r') <> ''""")
def c17_without_repeated(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("idx"), "text", F.col("doc_id").alias("page"), F.lit("paragraph").alias("block_type"))
    rep = S.repeated_lines(d, share=0.0).select("doc_id", "key")
    return S.without_lines(d, rep).select(F.col("page").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"))


@query("c19_garble", "SELECT doc_id, round(length(regexp_replace(text, '[^\\x{FFFD}\\x{E000}-\\x{F8FF}]', '', 'g')) / length(text), 6) AS ratio FROM documents WHERE length(text) > 0")
def c19_garble(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.length("text") > 0).select("doc_id", F.round(X.garble_ratio(F.col("text")), 6).alias("ratio"))


@query("c6_parent_child")
def c6_parent_child(spark, sf_dir):
    return C.chunk_documents(blocks(spark, sf_dir)).select("doc_id", "chunk_index", "content_hash", "parent_hash", "block_type", F.length("content").alias("n_chars"))


@query("c1_structure_chunks")
def c1_structure_chunks(spark, sf_dir):
    return C.chunk_documents(blocks(spark, sf_dir), "structure").select("doc_id", "chunk_index", "content_hash", F.length("content").alias("n_chars"))


@query("s3_paragraphs", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n\\s*\\n')) AS p FROM documents) WHERE trim(p, E' \\n\\t\\r') <> '' GROUP BY doc_id")
def s3_paragraphs(spark, sf_dir):
    return readers.text_blocks(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("s2_markdown")
def s2_markdown(spark, sf_dir):
    return readers.markdown_blocks(read(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


@query("s_html_blocks")
def s_html_blocks(spark, sf_dir):
    return readers.html_blocks(read(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("f10_redact", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', '***', 'g'), '(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;''"\\]+', '\1***', 'g'), '(?i)(\bbearer\s+)[^\s,;''"\\]+', '\1***', 'g'),
'(?i)(x-api-key\s*[:=]\s*)[^\s,;''"\\]+', '\1***', 'g'), '(?i)(api[_-]?key\s*[:=]\s*)[^\s,;''"\\]+', '\1***', 'g'), '(?i)(password\s*[:=]\s*)[^\s,;''"\\]+', '\1***', 'g'),
'(?i)sk-[A-Za-z0-9_-]{6,}', 'sk-***', 'g'), '(://[^:/@\s]+:)[^@\s]+(@)', '\1***\2', 'g')) AS masked FROM documents""")
def f10_redact(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("masked"))


@query("m3_hash_embedding", "SELECT item_id, i, CAST('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2) AS INT) / 255.0::DOUBLE AS v FROM benchmark, range(64) r(i)")
def m3_hash_embedding(spark, sf_dir):
    v = F.posexplode(X.hash_embedding(F.col("text"))).alias("i", "v")
    return read(spark, sf_dir, "benchmark").select("item_id", v).withColumn("i", F.col("i").cast("long"))


@query("r12_follow_ups")
def r12_follow_ups(spark, sf_dir):
    users = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return U.rewritten(users).select("conv_id", "turn", "search_text")


#: Words of the sheets that the part table is read as.
SHEETS = T.TableLexicon(name_columns=("name",), count_columns=("size",), generic=("parts", "sheet"), units=("parts",), containers=("sheet",), stop=())


def _sheets(spark, sf_dir):
    """The part table as a spreadsheet of one sheet a brand: heads and cells."""
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("table_id"), "p_name", "p_type", F.col("p_size").cast("string").alias("size"))
    heads = rows.groupBy("table_id").agg(F.count("*").alias("n_rows")).select(
        "table_id", F.lit("part").alias("kb"), F.lit(1).alias("doc_id"), F.lit("parts.xlsx").alias("source"), F.concat(F.lit("parts.xlsx / "), "table_id").alias("section"),
        F.array(F.lit("name"), F.lit("type"), F.lit("size")).alias("columns"), "n_rows",
    )
    return heads, rows.select("table_id", F.col("p_partkey").alias("row_no"), F.posexplode(F.array("p_name", "p_type", "size")).alias("col", "value"))


CELLS = "c AS (SELECT p_brand AS t, p_partkey AS k, col, v, replace(v, ' ', '') AS x FROM (SELECT p_brand, p_partkey, unnest([0, 1, 2]) AS col, unnest([p_name, p_type, CAST(p_size AS VARCHAR)]) AS v FROM part)), n AS (SELECT DISTINCT t, x FROM c WHERE length(x) >= 2)"
POINTS = """8 * CAST(contains(t, w) AS INT) + 8 * CAST(contains('parts.xlsx', w) AS INT) + 3 * CAST(contains('parts', w) AS INT)
+ 3 * CAST(list_bool_or([contains(h, w) OR contains(w, h) FOR h IN ['name', 'type', 'size']]) AS INT) + 2 * CAST(EXISTS (SELECT 1 FROM n WHERE n.t = tabs.t AND (contains(x, w) OR contains(w, x))) AS INT)"""


def answers_sql(questions: str) -> str:
    """Answers to questions (qid, kind, ws: list of words) from the sheets, said by comparing all with all."""
    return f"""WITH {CELLS}, tabs AS (SELECT p_brand AS t, count(*) AS rows FROM part GROUP BY 1), q AS ({questions}),
d AS (SELECT DISTINCT ws FROM q), w AS (SELECT ws, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS w FROM d),
pw AS (SELECT w, t, {POINTS} AS p FROM (SELECT DISTINCT w FROM w) CROSS JOIN tabs), f AS (SELECT ws, pos, w.w, t, p FROM w JOIN pw USING (w) WHERE p > 0),
s AS (SELECT ws, t, sum(p) AS s FROM f GROUP BY ALL), b0 AS (SELECT ws, arg_min(t, (-s, t)) AS t FROM s GROUP BY ws),
b AS (SELECT * FROM b0 WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.ws = b0.ws AND length(w) >= 3 AND w NOT IN ('parts', 'sheet') AND NOT EXISTS (SELECT 1 FROM f WHERE f.ws = w.ws AND f.pos = w.pos AND f.t = b0.t))),
j AS (SELECT b.ws, b.t, arg_min((col, x), (pos, col, k)) AS s FROM b JOIN w ON w.ws = b.ws AND w.w NOT IN ('parts', 'sheet') JOIN c ON c.t = b.t AND length(x) >= 2 AND (contains(x, w.w) OR contains(w.w, x)) GROUP BY ALL),
m AS (SELECT j.ws, j.t, s[2] AS x, count(*) AS n, min(k) AS k FROM j JOIN c ON c.t = j.t AND c.col = s[1] AND c.x = s[2] GROUP BY ALL),
a1 AS (SELECT m.ws, 'count' AS kind, m.x AS subject, m.x || ' 数量: ' || CASE WHEN n = 1 THEN coalesce(nullif(v, ''), '1') ELSE CAST(n AS VARCHAR) END AS answer, m.t AS table_id, CAST(n AS INT) AS n_rows FROM m LEFT JOIN c ON c.t = m.t AND c.k = m.k AND c.col = 2),
z AS (SELECT f.ws, f.t, tabs.rows, EXISTS (SELECT 1 FROM w WHERE w.ws = f.ws AND w.w NOT IN ('parts', 'sheet') AND contains(f.t, w.w)) AS named FROM f JOIN b USING (ws) JOIN tabs ON tabs.t = f.t WHERE f.w = 'parts' AND f.ws NOT IN (SELECT ws FROM j)),
a2 AS (SELECT ws, 'count' AS kind, 'parts' AS subject, 'parts 总数: ' || sum(rows) AS answer, min(t) AS table_id, CAST(sum(rows) AS INT) AS n_rows FROM z WHERE named OR (SELECT count(*) FROM z y WHERE y.ws = z.ws AND y.named) <> 1 GROUP BY ws),
r AS (SELECT b.ws, b.t, arg_min(w, pos) AS pick FROM b JOIN w ON w.ws = b.ws AND length(w) >= 3 AND w NOT IN ('parts', 'sheet') JOIN c ON c.t = b.t AND col = 0 AND contains(x, w) GROUP BY ALL),
l AS (SELECT b.ws, b.t, pick, v, min(k) AS k, count(*) AS n FROM b LEFT JOIN r ON r.ws = b.ws JOIN c ON c.t = b.t AND col = 0 AND (pick IS NULL OR contains(x, pick)) GROUP BY ALL),
a3 AS (SELECT ws, 'enum' AS kind, 'name' AS subject, coalesce(pick || ' 相关: ', '') || string_agg(v, '、' ORDER BY k) AS answer, t AS table_id, CAST(sum(n) AS INT) AS n_rows FROM l GROUP BY ws, t, pick),
a AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3)
SELECT qid, q.kind, subject, answer, table_id, n_rows FROM q JOIN a ON a.ws = q.ws AND a.kind = q.kind"""


@query("x4_assembled_tables", "SELECT p_brand AS table_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_no, unnest([0, 1, 2]) AS col, unnest([p_name, p_type, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END]) AS value FROM part")
def x4_assembled_tables(spark, sf_dir):
    """Sheets cut into slices of 16 keys, in which some rows lack their last cell."""
    rows = read(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    row = F.when(F.col("p_size") % 7 == 0, F.array("p_name", "p_type")).otherwise(F.array("p_name", "p_type", "size"))
    slices = rows.groupBy(F.col("p_brand").alias("table_id"), F.floor(F.col("p_partkey") / 16).alias("row_index")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("row")))).alias("rows"))
    parts = slices.select("table_id", "row_index", F.array(F.lit("name"), F.lit("type"), F.lit("size")).alias("columns"), F.transform("rows", lambda r: r["row"]).alias("rows"), F.lit("s").alias("section"), F.lit("f").alias("source"), F.lit(1).alias("doc_id"), F.lit("k").alias("kb"))
    return T.assembled(parts)[1].withColumns({"row_no": F.col("row_no").cast("long"), "col": F.col("col").cast("int")})


@query("x9_table_scores", f"WITH {CELLS}, tabs AS (SELECT DISTINCT p_brand AS t FROM part) SELECT w AS brand, t AS table_id, {POINTS} AS score FROM (SELECT DISTINCT p_brand AS w FROM part) CROSS JOIN tabs")
def x9_table_scores(spark, sf_dir):
    """Each brand's word against each sheet, those without a point included."""
    heads, cells = _sheets(spark, sf_dir)
    words = heads.select(F.col("table_id").alias("brand"))
    places, _ = T.word_places(words.select(F.col("brand").alias("word")), heads, cells)
    scores = places.groupBy(F.col("word").alias("brand"), "table_id").agg(F.sum("points").alias("points"))
    pairs = words.crossJoin(heads.select("table_id"))  # the brands squared: the rows of the answer
    return pairs.join(scores, ["brand", "table_id"], "left").select("brand", "table_id", F.coalesce("points", F.lit(0)).cast("int").alias("score"))


@query("x11_counts", answers_sql("SELECT p_partkey AS qid, 'count' AS kind, [replace(p_name, ' ', ''), p_brand] AS ws FROM part"))
def x11_counts(spark, sf_dir):
    """How many of each part's name its sheet has, asked once for each part."""
    asked = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.lit("part").alias("kb"), F.lit("count").alias("kind"), F.array(X.squash(F.col("p_name")), "p_brand").alias("words"))
    return T.answer_cells(asked, *_sheets(spark, sf_dir), lex=SHEETS)


ASKED = [("count", ["parts"]), ("enum", ["ring"]), ("enum", []), ("count", ["absent", "parts"]), ("enum", ["parts", "sheet"])]
ASKED_SQL = " UNION ALL ".join(f"SELECT CAST(row_number() OVER (ORDER BY p_brand) * 10 + {i} AS BIGINT) AS qid, '{kind}' AS kind, list_concat([p_brand], {words or 'CAST([] AS VARCHAR[])'}) AS ws FROM (SELECT DISTINCT p_brand FROM part)" for i, (kind, words) in enumerate(ASKED))


@query("x14_sheet_answers", answers_sql(ASKED_SQL))
def x14_sheet_answers(spark, sf_dir):
    """Totals and lists of each brand's sheet, and questions that no sheet answers."""
    heads, cells = _sheets(spark, sf_dir)
    number = F.row_number().over(W.orderBy("table_id"))  # of the sheets
    asked = heads.select("table_id", number.alias("i")).select("table_id", "i", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.lit(kind).alias("kind"), F.array(*(F.lit(w) for w in words)).cast("array<string>").alias("more")) for j, (kind, words) in enumerate(ASKED)))).alias("a"))
    asked = asked.select((F.col("i") * 10 + F.col("a.j")).cast("long").alias("qid"), F.lit("part").alias("kb"), "a.kind", F.concat(F.array("table_id"), "a.more").alias("words"))
    return T.answer_cells(asked, heads, cells, SHEETS)


def _cache(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("user_id"), F.lit(None).cast("long").alias("kb_id"), F.lit(None).cast("string").alias("doc_scope"), F.lit("s").alias("style"),
        F.when(F.col("vec_id") % 3 == 0, "bad").otherwise("good").alias("status"), F.lit(None).cast("string").alias("subject"), F.col("embedding").alias("vector"),
        F.concat(F.lit("answer "), "vec_id").alias("answer"), F.timestamp_seconds(F.col("vec_id")).alias("updated_at"),
    )
    asked = e.filter("id % 100 = 0").select(F.col("id").alias("qid"), "user_id", "kb_id", "doc_scope", "style", "subject", "vector")
    return e, asked


POOL = f"""p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS place FROM embeddings),
n AS (SELECT q.vec_id AS qid, e.vec_id AS id, round({RQ.COS}, 6) AS sim FROM embeddings q JOIN p e ON q.label = e.label WHERE q.vec_id % 100 = 0 AND e.place <= POOL_SIZE)"""


@query("m5_cache_find", f"WITH {POOL.replace("POOL_SIZE", "200")} SELECT qid, id, 'answer ' || id AS answer, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id DESC) AS r FROM n) WHERE r = 1 AND sim >= 0.2")
def m5_cache_find(spark, sf_dir):
    e, asked = _cache(spark, sf_dir)
    return M.find_cached(e, asked, F.lit("2024-01-01").cast("timestamp"), limit=0.2)


@query("m7_memory_recall", f"WITH {POOL.replace("POOL_SIZE", "100")} SELECT qid, id, CASE WHEN id % 3 = 0 THEN 'bad' ELSE 'good' END AS status, 'answer ' || id AS answer, sim, id % 3 = 0 AS force_rerank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END, sim DESC, id DESC) AS r FROM n WHERE sim >= 0.1) WHERE r = 1")
def m7_memory_recall(spark, sf_dir):
    e, asked = _cache(spark, sf_dir)
    return M.recall(e, asked, limit=0.1)


@query("m8_remember")
def m8_remember(spark, sf_dir):
    """All vectors as answers that 97 users rate one after the other: the memories that are left."""
    e = _cache(spark, sf_dir)[0].withColumns({"user_id": F.col("id") % 97, "hit_count": F.lit(0)})
    return M.remember(e.limit(0), e).select("user_id", "id", "status")


@query("e4_recall", f"""WITH {RQ.BM25}, o AS (SELECT qid, chunk_id, max(score) AS score FROM bm GROUP BY qid, chunk_id),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM o QUALIFY r <= 10),
h AS (SELECT b.item_id AS qid, max(CASE WHEN r <= 5 AND contains(d.text, b.text) THEN 1 ELSE 0 END) AS h5, max(CASE WHEN contains(d.text, b.text) THEN 1 ELSE 0 END) AS h10
  FROM benchmark b LEFT JOIN t ON t.qid = b.item_id LEFT JOIN documents d ON d.doc_id = t.chunk_id GROUP BY b.item_id)
SELECT count(*) AS n, round(avg(h5), 4) AS recall5, round(avg(h10), 4) AS recall10 FROM h""")
def e4_recall(spark, sf_dir):
    asked, c = RQ.questions(spark, sf_dir), RQ.chunks(spark, sf_dir)
    best = R.bm25(asked, c).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    top = R.top_k(best, ["qid"], 10).join(c.select("chunk_id", "section", F.col("content").alias("snippet")), "chunk_id")
    top = top.select("qid", "rank", "snippet", "section", F.lit("").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("clause_no"))
    gold = asked.select("qid", F.lit("general").alias("intent"), "kb", F.array("question").alias("expect_keywords"), F.lit(None).cast("array<string>").alias("expect_clauses"))
    return E.summary(E.scored_questions(gold, top)).filter("intent IS NULL AND kb IS NULL").select("n", "recall5", "recall10").limit(1)


@query("s14_json_columns", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s14_json_columns(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f3_profile_and_hash", """SELECT item_id, substr(sha256('{"dim": 64, "model": "hash"}'), 1, 32) AS profile, sha256(""" + SQUASH + ") AS content_hash FROM benchmark")
def f3_profile_and_hash(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.profile_fingerprint(model="hash", dim=64).alias("profile"), X.content_hash(F.col("text")).alias("content_hash"))


@query("f14_head_and_tail", "SELECT doc_id, sha256(CASE WHEN length(text) <= 4000 THEN text ELSE text[1:2400] || chr(10) || '…' || chr(10) || text[-1600:] END) AS cut FROM documents")
def f14_head_and_tail(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(X.head_and_tail(F.col("text")), 256).alias("cut"))


@query("c25_section_prefix", "SELECT doc_id, sha256('## ' || source || chr(10) || text) AS content FROM documents")
def c25_section_prefix(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(X.section_prefix(F.col("source")), "text"), 256).alias("content"))


@query("m1_embed_missing", f"SELECT doc_id, sha256({SQUASH}) AS content_hash, CASE WHEN sha256({SQUASH}) < '8' THEN 0.5 ELSE CAST('0x' || substr(sha256((SELECT min(d.text) FROM documents d WHERE sha256({SQUASH.replace('text', 'd.text')}) = sha256({SQUASH.replace('text', 'documents.text')}))), 1, 2) AS INT) / 255.0::DOUBLE END AS first FROM documents")
def m1_embed_missing(spark, sf_dir):
    """Half of the contents are in the cache, with a vector of their own; the others are embedded once each."""
    chunks = staged(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), X.content_hash(F.col("text")).alias("content_hash")), "hashed")
    profile = X.profile_fingerprint(model="hash", dim=64)
    cache = chunks.filter("content_hash < '8'").select("content_hash").distinct().select("content_hash", profile.alias("profile"), F.array(F.lit(0.5)).alias("vector"))
    full, _ = M.embed_missing(chunks, cache, profile, X.hash_embedding)
    return full.select("doc_id", "content_hash", F.col("vector")[0].alias("first"))


@query("r17_whole_document", f"""WITH {RQ.BM25}, o AS (SELECT qid, chunk_id, max(score) AS score FROM bm GROUP BY qid, chunk_id),
t AS (SELECT qid, arg_max(source, (score, -chunk_id)) AS source FROM o JOIN documents d ON d.doc_id = o.chunk_id GROUP BY qid)
SELECT qid, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY qid ORDER BY d.doc_id) AS rank FROM t JOIN documents d USING (source) WHERE length(text) >= 40 QUALIFY rank <= 60""")
def r17_whole_document(spark, sf_dir):
    c = RQ.chunks(spark, sf_dir).drop("doc_id").withColumnRenamed("section", "doc_id")  # a source as the document, its rows as chunks
    best = R.bm25(RQ.questions(spark, sf_dir), c).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    top = R.top_k(best, ["qid"], 1).join(c.select("chunk_id", "doc_id"), "chunk_id")
    return R.whole_document(top, c).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


@query("k1_chunk_rows")
def k1_chunk_rows(spark, sf_dir):
    return C.chunk_store_rows(C.chunk_documents(blocks(spark, sf_dir))).select("doc_id", "chunk_index", "parent_index", "block_type")


@query("r21_contract")
def r21_contract(spark, sf_dir):
    best = R.bm25(RQ.questions(spark, sf_dir), RQ.chunks(spark, sf_dir)).groupBy("qid", "chunk_id").agg(F.max("score").alias("score"))
    hydrated = R.hydrate(R.top_k(best, ["qid"], 5).drop("rank"), RQ.chunks(spark, sf_dir))
    return R.contract(hydrated).select("qid", "rank", F.to_json("result").alias("result"))
