"""Relational statements on the star schema, events and conversations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import in_pieces
from ..operators import evaluation as E
from ..operators import memory as M
from ..operators import relational as R
from .registry import query, read


@query("p1_projection", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def p1_projection(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("p2_predicates", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal < 5000 AND c_nationkey <> 3 AND c_name IS NOT NULL")
def p2_predicates(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.filter(c.c_mktsegment.isin("BUILDING", "MACHINERY") & (c.c_acctbal < 5000) & (c.c_nationkey != 3) & c.c_name.isNotNull()).select("c_custkey", "c_mktsegment")


@query("p3_substring", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, '1') OR contains(p_type, 'A')")
def p3_substring(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.filter(p.p_name.contains("1") | p.p_type.contains("A")).select("p_partkey", "p_name")


@query("p4_ilike", "SELECT s_suppkey FROM supplier WHERE s_name ILIKE '%SUPPLIER%1%'")
def p4_ilike(spark, sf_dir):
    return read(spark, sf_dir, "supplier").filter(F.col("s_name").ilike("%SUPPLIER%1%")).select("s_suppkey")


@query("p5_optional_filters", "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND contains(props, '7')")
def p5_optional_filters(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return R.where_given(e, event_type=(e.event_type, "click"), user=(e.user_id, None), props_contains=(e.props, "7")).select("event_id", "user_id")


@query("p6_null_safe_scope", "WITH a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS s FROM labels), b AS (SELECT DISTINCT s FROM a) SELECT doc_id, b.s AS s FROM a JOIN b ON a.s IS NOT DISTINCT FROM b.s")
def p6_null_safe_scope(spark, sf_dir):
    a = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("quality")).alias("s"))
    b = a.select((F.col("s") + 0).cast("int").alias("s")).distinct()
    return a.join(b, R.same_scope(a, b, ["s"])).select("doc_id", b["s"])


@query("p14_expiry", "SELECT event_id FROM events WHERE NOT (TIMESTAMP '2024-01-15' - ts > INTERVAL 5 DAY)")
def p14_expiry(spark, sf_dir):
    return read(spark, sf_dir, "events").filter(M.alive(F.col("ts"), F.lit("2024-01-15").cast("timestamp"), 5 * 86_400)).select("event_id")


@query("j1_inner_join", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j1_inner_join(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("j2_active_version_join", "SELECT d.doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def j2_active_version_join(spark, sf_dir):
    active = read(spark, sf_dir, "labels").filter("quality = 1")
    return read(spark, sf_dir, "documents").join(active, "doc_id", "left_semi").select("doc_id", "source")


@query("j3_semi_and_anti", "SELECT o_orderkey, (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) AS in_debt FROM orders")
def j3_semi_and_anti(spark, sf_dir):
    o, debt = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").filter("c_acctbal < 0")
    on = F.col("o_custkey") == F.col("c_custkey")
    return o.join(debt, on, "left_semi").select("o_orderkey", F.lit(True).alias("in_debt")).unionByName(o.join(debt, on, "left_anti").select("o_orderkey", F.lit(False).alias("in_debt")))


@query("j4_lookup_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def j4_lookup_left(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j6_ordered_lists", "SELECT l_orderkey AS id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS parts FROM lineitem GROUP BY l_orderkey")
def j6_ordered_lists(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").cast("string").alias("source"))
    got = R.with_citations(li.select(F.col("message_id").alias("id")).distinct(), li)
    return got.select("id", F.concat_ws(",", F.transform("citations", lambda c: c["source"])).alias("parts"))


@query("j11_scalar_subquery", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order FROM customer")
def j11_scalar_subquery(spark, sf_dir):
    last = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("last_order"))
    return read(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", "last_order")


@query("j13_previous_question", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations")
def j13_previous_question(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return R.latest_before(c, "conv_id", ["turn"], F.when(F.col("role") == "user", F.col("text")), "previous").select("conv_id", "turn", "previous")


@query("a1_counts", "SELECT count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders")
def a1_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@query("a2_sum_or_zero", "SELECT s_suppkey, coalesce(sum(l_quantity), 0) AS hits FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_returnflag = 'R' GROUP BY s_suppkey")
def a2_sum_or_zero(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return read(spark, sf_dir, "supplier").join(li, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce("q", F.lit(0.0)).alias("hits"))


@query("a3_conditional_counts", "SELECT source, count(*) AS total, count(*) FILTER (quality = 1) AS good, count(*) - count(*) FILTER (quality = 1) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY source")
def a3_conditional_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("good")).withColumn("bad", F.col("total") - F.col("good"))


@query("a4_fixed_levels", "SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS \"n_1-URGENT\", count(*) FILTER (o_orderpriority = '2-HIGH') AS \"n_2-HIGH\", count(*) FILTER (o_orderpriority = 'none') AS n_none, count(*) AS total FROM orders")
def a4_fixed_levels(spark, sf_dir):
    return R.counts_by(read(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "none"])


@query("a5_tristate", "WITH t AS (SELECT CASE WHEN toxic = 1 THEN NULL ELSE quality = 1 END AS done FROM labels) SELECT count(done) AS verified, count(*) FILTER (done) AS complete, count(*) FILTER (NOT done) AS incomplete FROM t")
def a5_tristate(spark, sf_dir):
    done = F.when(F.col("toxic") != 1, F.col("quality") == 1)
    return read(spark, sf_dir, "labels").agg(F.count(done).alias("verified"), F.count_if(done).alias("complete"), F.count_if(~done).alias("incomplete"))


@query("a6_queue_backlog", "SELECT event_type AS stage, count(*) AS n_jobs, min(ts) AS oldest, greatest(CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(min(ts))) AS BIGINT), 0) AS wait_s FROM events GROUP BY event_type")
def a6_queue_backlog(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("ts").alias("created_at"))
    return R.queue_backlog(jobs, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("a7_kb_statistics", "SELECT lang AS kb, count(*) AS n_docs, sum(n_chars) AS n_chars, count(*) FILTER (l.quality = 1) AS n_ready, CASE WHEN count(*) FILTER (l.quality = 1) = 0 THEN 'empty' WHEN count(*) FILTER (l.quality = 1) < count(*) THEN 'partial' ELSE 'ready' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang")
def a7_kb_statistics(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    by = d.groupBy(F.col("lang").alias("kb")).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count_if(F.col("quality") == 1).alias("n_ready"))
    return by.withColumn("status", F.when(F.col("n_ready") == 0, "empty").when(F.col("n_ready") < F.col("n_docs"), "partial").otherwise("ready"))


@query("a12_best_by_key", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def a12_best_by_key(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("a13_first_occurrence", "SELECT text_hash, doc_id FROM (SELECT sha256(text) AS text_hash, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def a13_first_occurrence(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("a15_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def a15_grouping_sets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.groupingSets([[], ["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("a16_mean_and_spread", "SELECT event_type AS measure, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY event_type")
def a16_mean_and_spread(spark, sf_dir):
    return E.rounds(read(spark, sf_dir, "events").select(F.col("event_type").alias("measure"), "value"))


@query("a17_median_and_mode", "WITH m AS (SELECT p_brand, median(p_size) AS mid FROM part GROUP BY p_brand), w AS (SELECT p_brand, p_size, sum(p_retailprice) AS weight FROM part GROUP BY ALL) SELECT p_brand, mid, (SELECT arg_max(p_size, (round(weight, 4), p_size)) FROM w WHERE w.p_brand = m.p_brand) AS heaviest FROM m")
def a17_median_and_mode(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    mid = p.groupBy("p_brand").agg(F.median("p_size").alias("mid"))
    heavy = p.groupBy("p_brand", "p_size").agg(F.round(F.sum("p_retailprice"), 4).alias("w")).groupBy("p_brand").agg(F.max_by("p_size", F.struct("w", "p_size")).alias("heaviest"))
    return mid.join(heavy, "p_brand")


@query("a20_histogram", "SELECT event_type, CAST(least(floor(value / 10), 20) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def a20_histogram(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.least(F.floor(F.col("value") / 10), F.lit(20)).alias("bucket")).agg(F.count("*").alias("n"))


@query("w2_share_of_best", "SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def w2_share_of_best(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / F.max("o_totalprice").over(W.partitionBy("o_custkey")), 6).alias("share"))


@query("w4_runs", "WITH f AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations) SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM f")
def w4_runs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(w))).cast("int"))
    return c.select("conv_id", "turn", F.sum("new").over(w).alias("run"))


@query("w5_newest_pool", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def w5_newest_pool(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return read(spark, sf_dir, "events").withColumn("place", place).filter("place <= 3").select("event_id", "user_id")


@query("w6_eviction", "WITH t AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age FROM events) SELECT event_id, user_id FROM t WHERE total < 8 OR age > 1")
def w6_eviction(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("updated_at"))
    return R.evict_oldest(e, ["user_id"], 8).select(F.col("id").alias("event_id"), "user_id")


@query("w7_recent_turns", "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 500 THEN text[1:400] || '…' ELSE text END AS text FROM t WHERE r <= 12")
def w7_recent_turns(spark, sf_dir):
    return R.recent_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("w8_queue_position", "SELECT event_id AS id, count(*) OVER (ORDER BY event_id) - 1 AS ahead FROM events WHERE event_type = 'view'")
def w8_queue_position(spark, sf_dir):
    jobs = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "queued").otherwise("done").alias("stage"))
    return R.queued_ahead(jobs).select("id", "ahead")


@query("t2_paging", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def t2_paging(spark, sf_dir):
    return R.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20)


@query("t3_cursor", "SELECT event_id AS id, true AS has_more FROM (SELECT event_id FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 30)")
def t3_cursor(spark, sf_dir):
    return R.cursor_page(read(spark, sf_dir, "events").select(F.col("event_id").alias("id")), 500, 30)


@query("u1_union_pool", "SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def u1_union_pool(spark, sf_dir):
    a = read(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return a.union(read(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")).distinct()


@query("u2_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def u2_difference(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_partkey"))


@query("u3_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def u3_intersection(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).intersect(read(spark, sf_dir, "part").filter("p_size > 25").select("p_partkey"))


@query("k8_pieces", "SELECT conv_id, turn, i AS piece, text[1 + i * 50 : 50 + i * 50] AS data FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / 50) AS BIGINT))) AS i FROM conversations WHERE role = 'assistant')")
def k8_pieces(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.posexplode(in_pieces(F.col("text"))).alias("piece", "data")).withColumn("piece", F.col("piece").cast("long"))
