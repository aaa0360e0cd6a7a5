"""Operators on inputs of the domain that each query and its SQL derive from the given tables in the same way: numbered
lines and titles from documents, sheets and pages from parts, jobs from events, feedback from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import evaluation as E
from ..operators import layout as L
from ..operators import memory as M
from ..operators import relational as Q
from ..operators import store as D
from ..operators import structure as S
from ..operators import understanding as U
from ..sources import readers
from ..streaming.jobs import job_stages, live_entries, run_to_end
from .registry import query, read

STRIPPED = r"regexp_replace(line, '^[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '')"

# -- structure ---------------------------------------------------------------------------------------


def numbered_documents(spark, sf_dir) -> DataFrame:
    """Blocks of documents whose lines are numbered by their place, each seventh left as it is."""
    number = lambda x, i: F.when(i % 7 == 3, x).otherwise(F.concat((F.floor(i / 10) + 1).cast("string"), F.lit("."), (i % 10 + 1).cast("string"), F.lit(" "), x))
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), number), "\n")
    return read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("idx"), text.alias("text"), F.lit(1).alias("page"), F.lit("paragraph").alias("block_type"), F.col("source").alias("section"))


NUMBERED = rf"""(SELECT doc_id, regexp_extract({STRIPPED}, '^(\d{{1,3}}(?:\.\d{{1,3}}){{0,3}})\.?\s*', 1) AS number FROM (SELECT doc_id, CASE WHEN i % 7 = 3 THEN x ELSE (i // 10 + 1) || '.' || (i % 10 + 1) || ' ' || x END AS line
FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))))"""


@query("c16_document_numbers", f"SELECT doc_id, number, count(*) AS n FROM {NUMBERED} WHERE number <> '' AND CAST(string_split(number, '.')[1] AS INT) < 100 GROUP BY ALL")
def c16_document_numbers(spark, sf_dir):
    return S.numbered_lines(numbered_documents(spark, sf_dir)).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@query("c16_document_siblings", rf"""WITH n AS (SELECT DISTINCT doc_id, regexp_extract(number, '^(.*)\.\d+$', 1) AS parent, CAST(regexp_extract(number, '(\d+)$', 1) AS INT) AS k FROM {NUMBERED} WHERE contains(number, '.') AND CAST(string_split(number, '.')[1] AS INT) < 100)
SELECT a.doc_id, a.parent || '.' || (a.k + 1) AS number FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.parent = b.parent AND b.k = a.k + 2 WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = a.doc_id AND c.parent = a.parent AND c.k = a.k + 1)""")
def c16_document_siblings(spark, sf_dir):
    return S.missing_siblings(S.numbered_lines(numbered_documents(spark, sf_dir)))


@query("c12_document_titles", r"""SELECT doc_id, CAST(CASE WHEN regexp_matches(line, '^第[0-9]+章') THEN 1 WHEN regexp_matches(line, '^\d{1,3}\.\d{1,3} 标题$') THEN 2 ELSE 0 END AS INT) AS level, count(*) AS n
FROM (SELECT doc_id, CASE i % 4 WHEN 0 THEN '第' || (i // 4 + 1) || '章 ' || x WHEN 1 THEN (i % 900) || '.1.2 ' || x WHEN 2 THEN (i % 900 + 1) || '.1 标题' ELSE 'x ' || x END AS line
FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))) GROUP BY ALL""")
def c12_document_titles(spark, sf_dir):
    """Levels of lines made into chapters, clauses, titles and plain text by their place."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))
    i, x = F.col("i"), F.col("x")
    kinds = [F.concat(F.lit("第"), F.floor(i / 4) + 1, F.lit("章 "), x), F.concat(i % 900, F.lit(".1.2 "), x), F.concat(i % 900 + 1, F.lit(".1 标题")), F.concat(F.lit("x "), x)]
    line = F.when(i % 4 == 0, kinds[0]).when(i % 4 == 1, kinds[1]).when(i % 4 == 2, kinds[2]).otherwise(kinds[3])
    return lines.select("doc_id", S.heading_level(line).cast("int").alias("level")).groupBy("doc_id", "level").agg(F.count("*").alias("n"))


@query("c15_restored_titles", """WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
SELECT doc_id, CAST(i AS INT) AS idx, 0 AS line, 0 AS kind, CAST(i AS INT) AS n, 'heading' AS block_type, (i + 1) || ' 标题' AS text FROM l WHERE i % 7 = 3 AND i < 99
UNION ALL SELECT doc_id, CAST(i AS INT), 0, 1, 0, CASE WHEN i % 7 = 3 OR i % 7 = 5 AND i >= 99 THEN 'paragraph' ELSE 'heading' END, CASE WHEN i % 7 = 3 THEN x WHEN i % 7 = 5 AND i >= 99 THEN (i + 1) || ' 标题' || chr(10) || 'x' || x ELSE (i + 1) || ' 标题' END FROM l
UNION ALL SELECT doc_id, CAST(i AS INT), 1, 1, 0, 'paragraph', 'x' || x FROM l WHERE i % 7 = 5 AND i < 99""")
def c15_restored_titles(spark, sf_dir):
    """Documents with a numbered title for each line, of which each seventh is lost and another stands inside a paragraph; the
    contents list the first 99."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "x"))
    i, x = F.col("i"), F.col("x")
    title = F.concat((i + 1).cast("string"), F.lit(" 标题"))
    text = F.when(i % 7 == 3, x).when(i % 7 == 5, F.concat(title, F.lit("\nx"), x)).otherwise(title)
    page = F.floor(i / 5).cast("int") + 1
    blocks = lines.select("doc_id", i.alias("idx"), text.alias("text"), page.alias("page"), F.when((i % 7).isin(3, 5), "paragraph").otherwise("heading").alias("block_type"))
    entries = lines.filter(i < 99).select("doc_id", i.alias("n"), (i + 1).cast("string").alias("number"), F.lit("标题").alias("title"), page.alias("physical_page"))
    return L.injected(blocks, entries).select("doc_id", "idx", "line", "kind", "n", "block_type", "text")


@query("s12_source_engines", """SELECT source, total, CASE WHEN total <= 0 THEN 'text' WHEN layout AND ((scanned >= 3 AND scanned >= 0.3 * total) OR (complex_pages >= 3 AND complex_pages >= 0.3 * total)) THEN 'layout' WHEN scanned > 0 THEN 'ocr' ELSE 'text' END AS engine
FROM (SELECT source, count(*) AS total, count(*) FILTER (lang = 'de') AS scanned, count(*) FILTER (doc_id % 3 = 0) AS complex_pages, length(source) > 4 AS layout FROM documents GROUP BY source)""")
def s12_source_engines(spark, sf_dir):
    """A source as a file of which some pages are scanned and some have tables."""
    pages = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "de").alias("scanned"), F.count_if(F.col("doc_id") % 3 == 0).alias("complex_pages"))
    return pages.select("source", "total", S.route_engine(F.col("total"), F.col("scanned"), F.col("complex_pages"), F.length("source") > 4).alias("engine"))


# -- parts as pages ----------------------------------------------------------------------------------


@query("s11_part_pages", """SELECT CAST(p_partkey // 16 AS BIGINT) AS page_id, 0 AS table_no, 'name|type|size' AS header, 'name|type|size;' || string_agg(p_name || '|' || p_type || '|' || p_size, ';' ORDER BY p_partkey) AS cells FROM part GROUP BY p_partkey // 16""")
def s11_part_pages(spark, sf_dir):
    """Each 16 parts as a page of HTML with a table."""
    row = F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>"), "p_type", F.lit("</td><td>"), "p_size", F.lit("</td></tr>"))
    rows = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 16).cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("tr")))).alias("r"))
    html = F.concat(F.lit("<p>x</p><table><tr><th>name</th><th>type</th><th>size</th></tr>"), F.array_join(F.transform("r", lambda r: r["tr"]), ""), F.lit("</table>"))
    found = readers.html_tables(rows.select("page_id", html.alias("html")))
    return found.select("page_id", "table_no", F.array_join("header_path", "|").alias("header"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@query("s16_part_rotation", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 270 WHEN p_partkey % 5 = 1 THEN 90 WHEN CAST(p_size AS DOUBLE) > 30.0 THEN 90 ELSE 0 END AS turn FROM part")
def s16_part_rotation(spark, sf_dir):
    declared = F.when(F.col("p_partkey") % 5 == 0, 90).when(F.col("p_partkey") % 5 == 1, 270).otherwise(0)
    return read(spark, sf_dir, "part").select("p_partkey", L.rotation(F.col("p_size").cast("double"), F.lit(25.0), declared).alias("turn"))


@query("t5_part_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 13, p_partkey) AS place FROM part")
def t5_part_order(spark, sf_dir):
    number = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 13).cast("string"), F.col("p_partkey").cast("string"))
    rank = F.row_number().over(W.partitionBy("p_brand").orderBy(Q.dotted_key(number)))
    return read(spark, sf_dir, "part").select("p_partkey", rank.cast("long").alias("place"))


@query("c11_part_clauses", """SELECT p_partkey, p_size || '.' || (p_partkey % 10) || '.' || (p_partkey % 7 + 1) AS clause, CASE WHEN p_partkey % 3 = 0 THEN p_size || '.3-' || (p_partkey % 9) WHEN p_partkey % 3 = 1 THEN p_size || '.' || (p_partkey % 100) END AS formula FROM part""")
def c11_part_clauses(spark, sf_dir):
    """Sections that end in a clause number, and formula numbers in brackets of both kinds."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey")
    chapter = F.concat(size, F.lit("."), (key % 10).cast("string"))
    section = F.concat(chapter, F.lit(" 章 / "), chapter, F.lit("."), (key % 7 + 1).cast("string"), F.lit(" "), "p_name")
    content = F.when(key % 3 == 0, F.concat(F.lit("见式("), size, F.lit(".3-"), (key % 9).cast("string"), F.lit(")和(3.45)"))).when(key % 3 == 1, F.concat(F.lit("见（"), size, F.lit("."), (key % 100).cast("string"), F.lit("）"))).otherwise("无")
    return read(spark, sf_dir, "part").select("p_partkey", X.clause_no(section).alias("clause"), X.formula_no(content).alias("formula"))


@query("s20_order_dates", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN trim(o_orderpriority) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS cell FROM orders")
def s20_order_dates(spark, sf_dir):
    """Dates as spreadsheets have them: with dots, with a midnight time; and cells that are none."""
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    cell = F.when(k == 0, F.date_format(d, "yyyy.M.d")).when(k == 1, F.date_format(d, "yyyy-MM-dd 00:00:00")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.iso_date_cell(cell).alias("cell"))


# -- state -------------------------------------------------------------------------------------------


def jobs(spark, sf_dir) -> DataFrame:
    """An event as a job of its user's document."""
    stage = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), stage.alias("stage"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("lease_owner"),
        (F.col("ts") + F.expr("interval 90 seconds")).alias("lease_until"), (F.col("event_id") % 16 == 0).alias("cancel_requested"), F.col("ts").alias("created_at"),
    )


JOBS = "j AS (SELECT event_id AS id, user_id AS document_id, (['queued', 'running', 'done', 'failed'])[event_id % 4 + 1] AS stage, ts + INTERVAL 90 SECOND AS lease_until, event_id % 16 = 0 AS cancel_requested, ts AS created_at FROM events)"


@query("g1_event_claim", f"WITH {JOBS} SELECT id, CASE WHEN id = (SELECT id FROM j WHERE stage = 'queued' AND NOT cancel_requested ORDER BY created_at, id LIMIT 1) THEN 'running' ELSE stage END AS stage FROM j")
def g1_event_claim(spark, sf_dir):
    return D.claim(jobs(spark, sf_dir), F.lit("w"), F.lit("2024-03-01").cast("timestamp")).select("id", "stage")


@query("g3_event_reap", f"WITH {JOBS} SELECT id, CASE WHEN stage = 'running' AND lease_until < TIMESTAMP '2024-01-05 00:00:00' THEN 'failed' ELSE stage END AS stage FROM j")
def g3_event_reap(spark, sf_dir):
    return D.reap(jobs(spark, sf_dir), F.lit("2024-01-05").cast("timestamp")).select("id", "stage")


@query("g2_event_enqueue", f"WITH {JOBS} SELECT id, document_id FROM j UNION ALL SELECT c_custkey + 1000000000, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT document_id FROM j WHERE stage IN ('queued', 'running') AND document_id IS NOT NULL)")
def g2_event_enqueue(spark, sf_dir):
    """A job for each customer's document that has none waiting or running."""
    now = jobs(spark, sf_dir)
    wanted = read(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000_000).alias("id"), F.col("c_custkey").alias("document_id"), F.lit("queued").alias("stage"), F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("lease_owner"), F.lit(None).cast("timestamp").alias("lease_until"), F.lit(False).alias("cancel_requested"), F.lit("2024-03-01").cast("timestamp").alias("created_at"))
    return D.enqueue(now, wanted).select("id", "document_id")


@query("d1_order_upserts", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'new' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey % 7 <> 0
UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey % 10 = 4 AND o_custkey % 7 <> 0""")
def d1_order_upserts(spark, sf_dir):
    """Orders with some replaced, some added, and those of some customers deleted."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_custkey")
    fresh = orders.filter("o_orderkey % 10 = 3").withColumn("status", F.lit("new")).unionByName(orders.filter("o_orderkey % 10 = 4").withColumns({"o_orderkey": F.col("o_orderkey") + 1_000_000_000, "status": F.lit("added")}))
    gone = read(spark, sf_dir, "orders").filter("o_custkey % 7 = 0").select("o_custkey")
    return D.without(D.upserted(orders, fresh, ["o_orderkey"]), gone, ["o_custkey"]).select("o_orderkey", "status")


RATED = "m AS (SELECT conv_id * 1000 + turn AS id, conv_id, role, text AS content, (['up', 'down', 'none'])[(conv_id + turn) % 3 + 1] AS feedback FROM conversations)"


@query("m9_conversation_feedback", f"WITH {RATED} SELECT * FROM (SELECT m.id AS message_id, (SELECT arg_max(content, q.id) FROM m q WHERE q.conv_id = m.conv_id AND q.role = 'user' AND q.id < m.id) AS question, content AS answer, CASE feedback WHEN 'up' THEN 'good' ELSE 'bad' END AS status FROM m WHERE role = 'assistant' AND feedback <> 'none') WHERE question IS NOT NULL")
def m9_conversation_feedback(spark, sf_dir):
    feedback = F.element_at(F.array(*map(F.lit, ("up", "down", "none"))), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    messages = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), feedback.alias("feedback"))
    return M.feedback_entries(messages)


@query("m6_embedding_cache", "SELECT id FROM (SELECT vec_id AS id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS age FROM embeddings) WHERE n < 50 OR age > 10 UNION ALL SELECT vec_id + 1000000000 FROM embeddings WHERE vec_id % 50 = 0")
def m6_embedding_cache(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("user_id"), F.lit(None).cast("long").alias("kb_id"), F.timestamp_seconds(F.col("vec_id")).alias("updated_at"))
    fresh = rows.filter("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return M.store_cached(rows, fresh, F.lit("2024-01-01").cast("timestamp"), cap=50).select("id")


#: A year; the query's own leases do not run out.
LEASE = 31_536_000
STEP = """{'ms': x.ms, 'ev': x.ev, 'lease': CASE WHEN s.stage = 'queued' AND x.ev = 'claim' OR s.stage = 'running' AND (x.ev = 'heartbeat' OR x.ev = 'border' AND NOT s.p) THEN x.ms + 31536000000 ELSE s.lease END,
'n': s.n + CASE WHEN s.stage = 'queued' AND x.ev = 'claim' THEN 1 ELSE 0 END, 'p': s.stage = 'running' AND (s.p OR x.ev = 'cancel') AND x.ev NOT IN ('succeed', 'fail') AND NOT (x.ev = 'border' AND s.p),
'stage': CASE WHEN s.stage = '' AND x.ev = 'enqueue' THEN 'queued' WHEN s.stage = 'queued' AND x.ev = 'claim' THEN 'running' WHEN s.stage = 'queued' AND x.ev = 'cancel' THEN 'cancelled' WHEN s.stage = 'running' AND x.ev = 'border' AND s.p THEN 'cancelled'
  WHEN s.stage = 'running' AND x.ev = 'succeed' THEN 'succeeded' WHEN s.stage = 'running' AND x.ev = 'fail' THEN 'failed' WHEN s.stage = 'failed' AND x.ev = 'retry' THEN 'queued' ELSE s.stage END}"""
EVENTS = ("enqueue", "claim", "heartbeat", "cancel", "border", "fail", "retry", "succeed", "claim", "border")


def event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of files; a pattern, as a stream's plain path must be a folder."""
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("g5_job_stream", f"""WITH e AS (SELECT user_id % 500 AS job_id, epoch_ms(ts) AS ms, ({list(EVENTS)})[(event_id * 7 + user_id) % 10 + 1] AS ev FROM events),
l AS (SELECT job_id, list({{'ms': ms, 'ev': ev, 'lease': CAST(0 AS BIGINT), 'n': 0, 'p': false, 'stage': ''}} ORDER BY ms, ev) AS xs FROM e GROUP BY job_id),
f AS (SELECT job_id, list_reduce(xs, lambda s, x: {STEP}, {{'ms': CAST(0 AS BIGINT), 'ev': '', 'lease': CAST(0 AS BIGINT), 'n': 0, 'p': false, 'stage': ''}}) AS s FROM l)
SELECT job_id, s.stage AS stage, CAST(s.n AS INT) AS attempt FROM f""")
def g5_job_stream(spark, sf_dir):
    """Events as those of 500 jobs, read as a stream and folded by keyed state: a cancel waits for the job's next border."""
    events = event_stream(spark, sf_dir).withWatermark("ts", "1 day")
    kind = F.element_at(F.array(*map(F.lit, EVENTS)), ((F.col("event_id") * 7 + F.col("user_id")) % 10 + 1).cast("int"))
    told = events.select((F.col("user_id") % 500).alias("job_id"), kind.alias("event"), F.timestamp_millis(F.unix_millis("ts")).alias("at"), "ts")
    stages = run_to_end(job_stages(told, LEASE), "job-stages")
    return stages.groupBy("job_id").agg(F.max_by("stage", "batch").alias("stage"), F.max_by("attempt", "batch").alias("attempt"))


@query("g9_cache_uses", """WITH u AS (SELECT user_id AS key, date_trunc('milliseconds', ts) AS used FROM events), g AS (SELECT *, CASE WHEN used - lag(used) OVER (PARTITION BY key ORDER BY used) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM u),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY used ROWS UNBOUNDED PRECEDING) AS life FROM g)
SELECT key, min(used) AS since, max(used) AS last, count(*) AS uses FROM n GROUP BY key, life""")
def g9_cache_uses(spark, sf_dir):
    """Events as uses of their user's cache entry, which is gone after six hours without one."""
    events = event_stream(spark, sf_dir)
    touches = events.select(F.col("user_id").alias("key"), F.timestamp_millis(F.unix_millis("ts")).alias("at"))
    lives = run_to_end(live_entries(touches, 6 * 3600), "cache-uses")
    local = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return lives.groupBy("key", "since").agg(F.max("last").alias("last"), F.max("uses").alias("uses")).select("key", local("since"), local("last"), "uses")


# -- evaluation --------------------------------------------------------------------------------------

SCORED = """r AS (SELECT doc_id // 10 AS qid, doc_id % 10 + 1 AS rank, text AS snippet, source || ' / ' || lang AS section, source, doc_id % 2 AS page FROM documents),
g AS (SELECT doc_id // 10 AS qid, lang AS kb, substr(text, 11, 12) AS word, CASE WHEN doc_id % 20 = 6 THEN source END AS clause FROM documents WHERE doc_id % 10 = 6),
b AS (SELECT g.*, rank, contains(concat_ws(' ', coalesce(snippet, ''), coalesce(section, ''), coalesce(source, '')), word) AS hit, regexp_matches(section || ' ', '(^|[\\s/（(])' || clause || '($|[^0-9.])') AS part FROM g LEFT JOIN r ON r.qid = g.qid AND rank <= 10)"""


@query("e2_document_scores", f"WITH {SCORED} SELECT qid, bool_or(coalesce(hit, false) AND rank <= 5) AS recall5, bool_or(coalesce(hit, false)) AS recall10, CASE WHEN any_value(clause) IS NOT NULL THEN bool_or(part AND rank <= 5) END AS clause5, CASE WHEN any_value(clause) IS NOT NULL THEN bool_or(part) END AS clause10, true AS citation FROM b GROUP BY qid")
def e2_document_scores(spark, sf_dir):
    """Ten documents as the results of a question, whose expected word is in the seventh."""
    docs = read(spark, sf_dir, "documents")
    qid = F.floor(F.col("doc_id") / 10).cast("long").alias("qid")
    hits = docs.select(qid, (F.col("doc_id") % 10 + 1).alias("rank"), F.col("text").alias("snippet"), F.concat_ws(" / ", "source", "lang").alias("section"), "source", (F.col("doc_id") % 2).cast("int").alias("page"), F.lit(None).cast("string").alias("clause_no"))
    gold = docs.filter("doc_id % 10 = 6").select(qid, F.lit("general").alias("intent"), F.col("lang").alias("kb"), F.array(F.substring("text", 11, 12)).alias("expect_keywords"), F.when(F.col("doc_id") % 20 == 6, F.array("source")).alias("expect_clauses"))
    return E.scored_questions(gold, hits).select("qid", "recall5", "recall10", "clause5", "clause10", "citation")


@query("e6_benchmark_support", "SELECT item_id AS qid, text AS keyword FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = (['en', 'de', 'es', 'fr'])[b.item_id % 4 + 1] AND contains(d.text, b.text))")
def e6_benchmark_support(spark, sf_dir):
    """Benchmark items that no document of a language holds."""
    lang = F.element_at(F.array(*map(F.lit, ("en", "de", "es", "fr"))), (F.col("item_id") % 4 + 1).cast("int"))
    gold = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), lang.alias("kb"), F.array("text").alias("expect_keywords"))
    return E.unsupported_gold(gold, read(spark, sf_dir, "documents").select(F.col("lang").alias("kb"), F.col("text").alias("content")))


@query("e7_traced_documents", "SELECT doc_id % 100 AS qid, doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'vector' WHEN doc_id % 7 = 0 THEN 'fused' END AS lost_at FROM documents")
def e7_traced_documents(spark, sf_dir):
    target = read(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("qid"), F.col("doc_id").alias("chunk_id"))
    return E.root_cause(target, ("vector", target.filter("chunk_id % 3 <> 0")), ("fused", target.filter("chunk_id % 7 <> 0"))).select("qid", "chunk_id", "lost_at")


@query("e4_brand_gate", "WITH v AS (SELECT p_brand AS measure, p_partkey % 2 AS half, round(avg(p_size) / 50, 4) AS value FROM part GROUP BY ALL) SELECT a.measure, round(a.value - b.value, 9) >= -0.01 AS passed FROM v a JOIN v b ON a.measure = b.measure AND a.half = 1 AND b.half = 0")
def e4_brand_gate(spark, sf_dir):
    half = lambda k: read(spark, sf_dir, "part").filter(F.col("p_partkey") % 2 == k).groupBy(F.col("p_brand").alias("measure")).agg(F.round(F.avg("p_size") / 50, 4).alias("value"))
    return E.gate(half(1), half(0)).select("measure", "passed")


@query("e8_part_scores", """SELECT engine, round((coalesce(clean, 0) * 2 + coalesce(tables, 0)) / nullif((CASE WHEN clean IS NULL THEN 0 ELSE 2 END) + (CASE WHEN tables IS NULL THEN 0 ELSE 1 END), 0), 4) AS score
FROM (SELECT p_partkey AS engine, CASE WHEN p_partkey % 3 <> 0 THEN p_size / 64.0::DOUBLE END AS clean, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 64) / 64.0::DOUBLE END AS tables FROM part)""")
def e8_part_scores(spark, sf_dir):
    k = F.col("p_partkey")
    metrics = read(spark, sf_dir, "part").select(k.alias("engine"), F.when(k % 3 != 0, F.col("p_size") / 64.0).alias("clean"), F.when(k % 5 != 0, (k % 64) / 64.0).alias("tables"))
    return E.weighted_score(metrics, {"clean": 2.0, "tables": 1.0}).select("engine", "score")


# -- answers -----------------------------------------------------------------------------------------

CITED = "(SELECT doc_id, text || ' [' || (doc_id % 7) || '] x[' || (doc_id % 3) || '].' AS answer, doc_id % 5 AS n FROM documents)"
BAD = r"list_sort(list_distinct(list_filter([CAST(x AS BIGINT) FOR x IN regexp_extract_all(answer, '\[(\d+)\]', 1)], lambda x: x < 1 OR x > n)))"


def cited(spark, sf_dir) -> DataFrame:
    """Documents as answers with two citation marks."""
    k = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(k, F.concat("text", F.lit(" ["), (k % 7).cast("string"), F.lit("] x["), (k % 3).cast("string"), F.lit("].")).alias("answer"), (k % 5).alias("n_sources"))


@query("f13_document_citations", f"SELECT doc_id, array_to_string({BAD}, ',') AS bad FROM {CITED}")
def f13_document_citations(spark, sf_dir):
    return cited(spark, sf_dir).select("doc_id", F.array_join(X.bad_citations(F.col("answer"), F.col("n_sources")).cast("array<string>"), ",").alias("bad"))


@query("v2_document_verdicts", f"SELECT doc_id, n = 0 OR len({BAD}) = 0 AS ok FROM {CITED}")
def v2_document_verdicts(spark, sf_dir):
    return A.citation_verdict(cited(spark, sf_dir)).select("doc_id", "ok")


@query("v1_document_replies", "SELECT doc_id, doc_id % 3 = 0 AS enumeration, NOT (doc_id % 3 = 0 AND doc_id % 2 = 0) AS complete, CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS note FROM documents")
def v1_document_replies(spark, sf_dir):
    """Replies of a model about documents: an object in some text, text without one, and none."""
    k = F.col("doc_id")
    given = F.to_json(F.struct(F.lit(True).alias("enumeration"), (k % 2 != 0).alias("complete"), F.col("source").alias("note")))
    reply = F.when(k % 3 == 0, F.concat(F.lit("ok "), given, F.lit(" done"))).when(k % 3 == 1, F.lit("junk"))
    return read(spark, sf_dir, "documents").select("doc_id", A.completeness_verdict(reply).alias("v")).select("doc_id", "v.*")


@query("v3_document_picks", "SELECT doc_id, array_to_string(list_transform(list_filter([doc_id % 4, doc_id % 5], lambda i: i < 3), lambda i: ([source, lang, 'c'])[i + 1]), ',') AS picked, CASE WHEN doc_id % 2 = 0 THEN lang ELSE concat_ws(',', source, lang, 'c') END AS confirmed FROM documents")
def v3_document_picks(spark, sf_dir):
    k, given = F.col("doc_id"), F.array("source", "lang", F.lit("c"))
    places = F.concat(F.lit("`["), (k % 4).cast("string"), F.lit(", "), (k % 5).cast("string"), F.lit("]`"))
    reply = F.when(k % 2 == 0, F.concat(F.lit('{"missing": ["'), "lang", F.lit('", "z"]}'))).otherwise("no")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(A.picked_lines(given, places), ",").alias("picked"), F.array_join(A.confirmed_numbers(given, reply), ",").alias("confirmed"))


@query("f15_document_prompts", """WITH e AS (SELECT doc_id // 3 AS qid, string_agg('[' || (doc_id % 3 + 1) || '] ' || source || CASE WHEN doc_id % 4 <> 0 THEN ' p. ' || (doc_id % 4) ELSE '' END || ': ' || text[1:200], chr(10) ORDER BY doc_id) AS evidence FROM documents GROUP BY 1)
SELECT c_custkey AS qid, sha256('Answer from these.' || chr(10) || chr(10) || CASE WHEN evidence IS NOT NULL THEN evidence || chr(10) || chr(10) ELSE '' END || 'Who is ' || c_name || '?') AS prompt FROM customer LEFT JOIN e ON qid = c_custkey""")
def f15_document_prompts(spark, sf_dir):
    """Prompts about customers, with three documents each as the evidence."""
    k = F.col("doc_id")
    results = read(spark, sf_dir, "documents").select(F.floor(k / 3).cast("long").alias("qid"), (k % 3 + 1).alias("rank"), "source", (k % 4).cast("int").alias("page"), F.col("text").alias("snippet"))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("Who is "), "c_name", F.lit("?")).alias("question"))
    return A.prompts(asked, A.numbered_evidence(results), "Answer from these.").select("qid", F.sha2("prompt", 256).alias("prompt"))


@query("r13_named_customers", """WITH s AS (SELECT c_custkey AS doc_id, c_name AS stem, c_mktsegment AS kb FROM customer), q AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 200 = 0 THEN c_name ELSE substr(c_name, 1, 17) END AS name, CASE WHEN c_custkey % 300 = 0 THEN 'BUILDING' END AS scope FROM customer WHERE c_custkey % 100 = 0),
c AS (SELECT qid, name, doc_id, CASE WHEN stem = name THEN 2.0 ELSE least(length(stem), length(name)) / greatest(length(stem), length(name)) END AS ratio FROM q JOIN s ON (contains(stem, name) OR contains(name, stem)) AND (scope IS NULL OR scope = kb))
SELECT qid, arg_max(doc_id, (ratio, -doc_id)) AS doc_id FROM c GROUP BY qid, name""")
def r13_named_customers(spark, sf_dir):
    """Customers as files; questions name every hundredth of them, in full or but for its last digit."""
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat("c_name", F.lit(".pdf")).alias("filename"), F.col("c_mktsegment").alias("kb"))
    k = F.col("c_custkey")
    name = F.when(k % 200 == 0, F.col("c_name")).otherwise(F.substring("c_name", 1, 17))
    asked = read(spark, sf_dir, "customer").filter(k % 100 == 0).select(k.alias("qid"), F.concat(F.lit("在"), name, F.lit("中有什么内容要写")).alias("question"), F.when(k % 300 == 0, F.lit("BUILDING")).alias("kb"))
    return U.named_documents(asked, files)
