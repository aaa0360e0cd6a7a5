"""Cases of operators on text of the domain that the given tables have none of: small inline tables of Chinese documents.

Where SQL can say the rule, the oracle computes it from the same rows. Where it cannot, the oracle states the rows that
follow from the rule, written out by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import answers as A
from quillon.operators import chunking as C
from quillon.operators import evaluation as E
from quillon.operators import layout as L
from quillon.operators import memory as M
from quillon.operators import relational as Q
from quillon.operators import retrieval as R
from quillon.operators import store as D
from quillon.operators import structure as S
from quillon.operators import tables as T
from quillon.operators import understanding as U
from quillon.sources import readers

QUERIES, ORACLE = {}, {}


def query(name, sql):
    """Keeps a case (spark, sf_dir) -> DataFrame and the SQL of its rows."""

    def add(fn):
        QUERIES[name], ORACLE[name] = fn, sql
        return fn

    return add


KINDS = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def literal(v: object) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def stated(schema: str, rows: list[tuple]) -> str:
    """SQL for the given rows."""
    cols = [c.split() for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {KINDS[k]})" for v, (_, k) in zip(r, cols, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {values}) AS t({', '.join(n for n, _ in cols)})"


BLOCK = "doc_id long, idx int, text string, page int, block_type string, section string"
BLOCKS = [
    (1, 0, "第一章 总则", 1, "heading", None),
    (1, 1, "页眉文字\n1.1.1 应符合下列规定\n1.1.2 宜采用钢管", 1, "paragraph", "总则"),
    (1, 2, "页眉文字\n1.1.4 不得使用旧料\n1.1 范围", 2, "paragraph", "总则"),
    (1, 3, "页眉文字\n1.3 术语\n购买热线 13800000000", 3, "paragraph", "总则"),
    (1, 4, "3.2 引用标准", 3, "heading", None),
    (2, 0, "一、概述", 1, "heading", None),
    (2, 1, "2.1.1 甲\n2.1.3 丙\n没有编号的一行正文", 1, "paragraph", "概述"),
    (2, 2, "附录A", 2, "heading", None),
    (2, 3, "（三）要求\n120 不是编号", 2, "paragraph", "附录A"),
]
LINES = f"SELECT doc_id, idx, page, block_type, line FROM (SELECT doc_id, idx, page, block_type, unnest(string_split(text, chr(10))) AS line FROM ({stated(BLOCK, BLOCKS)}))"


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLOCKS, BLOCK)


# -- structure ---------------------------------------------------------------------------------------


@query("c12_heading_levels", rf"""SELECT doc_id, line, CAST(CASE WHEN regexp_matches(line, '^第[一二三四五六七八九十百千0-9]+[章节篇讲卷部]|^附录\s*[A-Z]') THEN 1
WHEN regexp_matches(line, '^\d{{1,3}}(\.\d{{1,3}}){{2,}}\s*[一-龥A-Za-z]') THEN 0
WHEN regexp_matches(line, '^\d{{1,3}}(\.\d{{1,3}}){{0,3}}\.?\s*[一-龥A-Za-z]') AND length(line) <= 30 AND NOT regexp_matches(line, '[，。；：？！、]') THEN length(regexp_replace(regexp_extract(line, '^[\d.]+'), '[^.]', '', 'g')) + 1
WHEN regexp_matches(line, '^[一二三四五六七八九十]+、|^[（(][一二三四五六七八九十]+[）)]') THEN 2 ELSE 0 END AS BIGINT) AS level FROM ({LINES})""")
def c12_heading_levels(spark, sf_dir):
    return S.lines_of(blocks(spark)).select("doc_id", "line", S.heading_level(F.col("line")).cast("long").alias("level"))


NUMBERED = rf"SELECT doc_id, page, regexp_extract(line, '^(\d{{1,3}}(?:\.\d{{1,3}}){{0,3}})\.?\s*', 1) AS number FROM ({LINES})"


@query("c16_numbered_lines", f"SELECT doc_id, number, count(*) AS n FROM ({NUMBERED}) WHERE number <> '' AND CAST(string_split(number, '.')[1] AS INT) < 100 GROUP BY ALL")
def c16_numbered_lines(spark, sf_dir):
    return S.numbered_lines(blocks(spark)).groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@query("c16_missing_siblings", rf"""WITH n AS (SELECT DISTINCT doc_id, regexp_extract(number, '^(.*)\.\d+$', 1) AS parent, CAST(regexp_extract(number, '(\d+)$', 1) AS INT) AS k FROM ({NUMBERED}) WHERE contains(number, '.'))
SELECT a.doc_id, a.parent || '.' || (a.k + 1) AS number FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.parent = b.parent AND b.k = a.k + 2 WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = a.doc_id AND c.parent = a.parent AND c.k = a.k + 1)""")
def c16_missing_siblings(spark, sf_dir):
    return S.missing_siblings(S.numbered_lines(blocks(spark)))


CLAUSES = rf"SELECT DISTINCT doc_id, page, regexp_extract(c, '^(\d+\.\d+)', 1) AS section, CAST(regexp_extract(c, '(\d+)$', 1) AS INT) AS k FROM (SELECT doc_id, page, unnest(regexp_extract_all(line, '\d{{1,2}}\.\d{{1,2}}\.\d{{1,2}}')) AS c FROM ({LINES}))"


@query("a18_clause_gaps", f"""WITH c AS ({CLAUSES}), r AS (SELECT doc_id, section, min(k) AS a, max(k) AS b, string_agg(DISTINCT CAST(k AS VARCHAR), ',' ORDER BY CAST(k AS VARCHAR)) AS present FROM c GROUP BY ALL),
h AS (SELECT doc_id, section, present, unnest(range(a, b)) AS k FROM r)
SELECT doc_id, section, present, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS missing FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = h.doc_id AND c.section = h.section AND c.k = h.k) GROUP BY ALL""")
def a18_clause_gaps(spark, sf_dir):
    gaps = S.clause_gaps(blocks(spark))
    return gaps.select("doc_id", "section", F.array_join(F.col("present").cast("array<string>"), ",").alias("present"), F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


CHUNKS = [(1, 1, "## 总则\n页眉文字\n1.1.1 应符合下列规定"), (1, 2, "1.1.4 不得使用旧料接 1.1 范围 之后"), (2, 1, "2.1.1 甲\n没有编号的一行正文的续文")]


@query("c18_completeness", f"""WITH k AS (SELECT doc_id, page, regexp_replace(line, '\\s', '', 'g') AS key FROM ({LINES}) WHERE block_type <> 'heading'), c AS (SELECT doc_id, regexp_replace(content, '\\s', '', 'g') AS body FROM ({stated("doc_id long, page int, content string", CHUNKS)}))
SELECT doc_id, count(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND contains(body, key))) AS missing_lines FROM k WHERE length(key) >= 4 GROUP BY doc_id""")
def c18_completeness(spark, sf_dir):
    return S.completeness(blocks(spark), spark.createDataFrame(CHUNKS, "doc_id long, page int, content string")).select("doc_id", "missing_lines")


@query("c17_adverts", stated("doc_id long, line string", [(1, "购买热线 13800000000")]))
def c17_adverts(spark, sf_dir):
    return S.advert_candidates(blocks(spark)).select("doc_id", "line")


ROUTES = "total int, scanned int, complex_pages int, layout boolean"
ROUTED = [(0, 0, 0, True), (10, 5, 0, True), (10, 5, 0, False), (10, 0, 4, True), (10, 2, 0, True), (10, 0, 0, False), (100, 5, 5, True)]


@query("s12_route_engine", f"SELECT *, CASE WHEN total <= 0 THEN 'text' WHEN layout AND ((scanned >= 3 AND scanned >= 0.3 * total) OR (complex_pages >= 3 AND complex_pages >= 0.3 * total)) THEN 'layout' WHEN scanned > 0 THEN 'ocr' ELSE 'text' END AS engine FROM ({stated(ROUTES, ROUTED)})")
def s12_route_engine(spark, sf_dir):
    return spark.createDataFrame(ROUTED, ROUTES).withColumn("engine", S.route_engine(*map(F.col, ("total", "scanned", "complex_pages", "layout"))))


ELEMENT = "doc_id long, idx int, element_id string, type string, text string, page_start int, page_end int, bbox array<double>, reading_order int, heading_level int, table struct<rows:array<array<string>>,header_path:array<string>>, parent_id string"


@query("c23_validation", stated("element_id string, error string", [("a", "repeated id"), ("a", "empty text"), ("a", "pages reversed"), ("a", "bbox"), ("a", "reading order"), ("b", "heading level"), ("b", "table width"), ("b", "parent missing"), ("b", "page below 1")]))
def c23_validation(spark, sf_dir):
    rows = [
        (1, 0, "a", "paragraph", "文", 1, 2, [0.0, 0.0, 1.0, 1.0], 0, None, None, None),
        (1, 1, "a", "paragraph", " ", 3, 2, [0.0, 0.0, 1.0], 5, None, None, None),
        (1, 2, "b", "table", "表", 0, 1, None, 2, 9, ([["1"]], ["h", "i"]), "zz"),
        (1, 3, "c", "figure", "", 1, 1, None, 3, 1, None, "b"),
    ]
    return S.validation_errors(spark.createDataFrame(rows, ELEMENT)).select("element_id", "error")


# -- pages and layout --------------------------------------------------------------------------------

PAGES = [
    (1, 2, "目 录\n1 总则……………1\n1.1 适用范围 ... 3\n2\n主要符号\n5\n3 基本规定（7）\n4 作用 9\n附录A\n综合变形模量\n21\n"),
    (1, 3, "5 检验 30\n6 验收 31"),
    (1, 4, "1 总则\n正文"),
    (2, 1, "没有目录的文件"),
]
CONTENTS = [("1", "总则", 1), ("1.1", "适用范围", 3), ("2", "主要符号", 5), ("3", "基本规定", 7), ("4", "作用", 9), ("", "附录A 综合变形模量", 21), ("5", "检验", 30), ("6", "验收", 31)]


@query("c13_contents", stated("doc_id long, page_no int, number string, title string, printed_page int", [(1, 2 if i < 6 else 3, *e) for i, e in enumerate(CONTENTS)]))
def c13_contents(spark, sf_dir):
    return L.contents_of(spark.createDataFrame(PAGES, "doc_id long, page int, text string")).drop("level")


HEADING = "doc_id long, idx int, text string, page int, block_type string"
HEADINGS = [(1, 0, "0.9 前言", 1, "heading"), (1, 1, "1 总则", 5, "heading"), (1, 2, "正文", 5, "paragraph"), (1, 3, "3 基本规定", 11, "heading"), (1, 4, "9.9 其他", 12, "heading"), (1, 5, "4 作用", 14, "heading"), (2, 0, "1 无目录", 1, "heading")]
ENTRIES = stated("doc_id long, number string, printed_page int", [(1, n, p) for n, _, p in CONTENTS])
OFFSETS = rf"""SELECT doc_id, off, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, off) AS r FROM (SELECT doc_id, off, count(*) AS n FROM (SELECT e.doc_id, h.page - e.printed_page AS off FROM ({ENTRIES}) e JOIN (SELECT doc_id, regexp_extract(text, '^(\d[\d.]*)\s', 1) AS number, arg_min(page, idx) AS page FROM ({stated(HEADING, HEADINGS)}) WHERE block_type = 'heading' GROUP BY 1, 2) h ON e.doc_id = h.doc_id AND e.number = h.number WHERE e.number <> '') GROUP BY doc_id, off)"""


@query("c14_physical_pages", f"SELECT e.number, e.printed_page + o.off AS physical_page FROM ({ENTRIES}) e LEFT JOIN (SELECT * FROM ({OFFSETS}) WHERE r = 1 AND n >= 2) o ON e.doc_id = o.doc_id")
def c14_physical_pages(spark, sf_dir):
    entries = L.contents_of(spark.createDataFrame(PAGES, "doc_id long, page int, text string"))
    heads = spark.createDataFrame(HEADINGS, HEADING).filter("block_type = 'heading'")
    return L.aligned(entries, L.page_offsets(entries, heads)).select("number", "physical_page")


@query("c15_outline", stated("doc_id long, idx int, block_type string", [(1, 0, "paragraph"), (1, 1, "heading"), (1, 2, "paragraph"), (1, 3, "heading"), (1, 4, "soft_heading"), (1, 5, "heading"), (2, 0, "heading")]))
def c15_outline(spark, sf_dir):
    entries = L.contents_of(spark.createDataFrame(PAGES, "doc_id long, page int, text string"))
    return L.with_outline(spark.createDataFrame(HEADINGS, HEADING), entries).select("doc_id", "idx", "block_type")


TEXTS = [("中 文 字", "中文字"), ("系数 0 . 9 5 取", "系数 0.95 取"), ("3.4 米", "3.4 米"), ("9.4. 3 条", "9.4. 3 条"), ("2020 - 10", "2020-10"), ("表 1 数据", "表1 数据")]


@query("c22_normal_text", stated("raw string, clean string", TEXTS))
def c22_normal_text(spark, sf_dir):
    return spark.createDataFrame([t[:1] for t in TEXTS], "raw string").select("raw", L.normal_text(F.col("raw")).alias("clean"))


FORMULAS = [(r"\alpha + \beta \leq 2", "α + β ≤ 2"), (r"\begin{array}{c} x \times y \end{array}", "c x × y"), (r"\mathrm{Re} = \rho v d", "Re = ρ v d"), (r"J _ { 1 }", "J_1")]


@query("c22_clean_latex", stated("raw string, clean string", FORMULAS))
def c22_clean_latex(spark, sf_dir):
    return spark.createDataFrame([t[:1] for t in FORMULAS], "raw string").select("raw", L.clean_latex(F.col("raw")).alias("clean"))


GRID = "<table><tr><th rowspan='2'>名称</th><th colspan='2'>数量</th></tr><tr><td>甲</td><td>乙</td></tr><tr><td>水泵</td><td>1</td><td>2</td></tr></table>"
ITEM = "doc_id long, idx int, type string, text string, text_level int, page_idx int, table_body string"
ITEMS = [
    (1, 0, "header", "页眉", None, 0, None),
    (1, 1, "text", "第一章 总则", 1, 0, None),
    (1, 2, "text", "1.1", 2, 0, None),
    (1, 3, "text", "适 用 范 围", None, 0, None),
    (1, 4, "text", "正文一段。", None, 1, None),
    (1, 5, "table", "表 1 设备", None, 1, GRID),
]


@query("s10_layout_elements", stated("reading_order int, type string, text string, path string, page int", [
    (0, "heading", "第一章总则", "第一章总则", 1), (1, "heading", "1.1 适用范围", "第一章总则/1.1 适用范围", 1), (2, "paragraph", "正文一段。", "第一章总则/1.1 适用范围", 2),
    (3, "table", "表1 设备\n名称 | 数量 | 数量\n名称 | 甲 | 乙\n水泵 | 1 | 2", "第一章总则/1.1 适用范围", 2)]))
def s10_layout_elements(spark, sf_dir):
    return L.layout_elements(spark.createDataFrame(ITEMS, ITEM)).select("reading_order", "type", "text", F.array_join("section_path", "/").alias("path"), "page")


@query("c9_table_data", stated("table_id string, columns string, rows string, section string", [("doc1:t3", "名称|数量|数量", "名称|甲|乙;水泵|1|2", "第一章总则 / 1.1 适用范围")]))
def c9_table_data(spark, sf_dir):
    made = L.element_blocks(L.layout_elements(spark.createDataFrame(ITEMS, ITEM)))
    chunks = C.chunk_documents(made).withColumns({"source": F.lit("规范.pdf"), "kb": F.lit("k")})
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return T.assemble(C.chunk_tables(chunks)).select("table_id", F.array_join("columns", "|").alias("columns"), cells.alias("rows"), "section")


@query("c24_document_model", stated("reading_order int, type string, path string", [(0, "heading", "第一章总则"), (1, "heading", "第一章总则/1.1 适用范围"), (2, "paragraph", "第一章总则/1.1 适用范围"), (3, "table", "第一章总则/1.1 适用范围")]))
def c24_document_model(spark, sf_dir):
    made = L.block_elements(L.element_blocks(L.layout_elements(spark.createDataFrame(ITEMS, ITEM))))
    return made.select("reading_order", "type", F.array_join("section_path", "/").alias("path"))


@query("c5_contents_chunks", "SELECT page, '## 目录' || chr(10) || trim(text, ' ' || chr(10)) AS content FROM (" + stated("doc_id long, page int, text string", PAGES[:2]) + ")")
def c5_contents_chunks(spark, sf_dir):
    return C.contents_chunks(spark.createDataFrame(PAGES[:2], "doc_id long, page int, text string")).select("page", "content")


@query("s11_html_tables", stated("page_id long, table_no int, header string, cells string", [(1, 0, "名称|数量|数量", "名称|数量|数量;名称|甲|乙;水泵|1|2"), (3, 1, "a", "a;b")]))
def s11_html_tables(spark, sf_dir):
    rows = [(1, f"<p>x</p>{GRID}"), (2, None), (3, "<table><tr><td> </td></tr></table><table><tr><td>a</td></tr><tr><td><b>b</b></td></tr></table>")]
    found = readers.html_tables(spark.createDataFrame(rows, "page_id long, html string"))
    return found.select("page_id", "table_no", F.array_join("header_path", "|").alias("header"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


STRIP = "doc_id long, page int, x double, y double, height double, text string"
STRIPS = [(1, 1, 0.0, 10.0, 10.0, "第一行文"), (1, 1, 0.0, 12.0, 10.0, "第一行文字"), (1, 1, 0.0, 30.0, 10.0, "第二行"), (1, 1, 50.0, 31.0, 10.0, "另一列")]


@query("s16_merged_strips", stated("idx int, text string", [(0, "第一行文字"), (1, "第二行"), (2, "另一列")]))
def s16_merged_strips(spark, sf_dir):
    return L.merged_strips(spark.createDataFrame(STRIPS, STRIP)).select("idx", "text")


TURNS = [(100.0, 200.0, 90), (100.0, 200.0, 270), (300.0, 200.0, 0), (210.0, 200.0, 0)]


@query("s17_rotation", f"SELECT width, height, CASE WHEN declared = 90 THEN 270 WHEN declared = 270 THEN 90 WHEN width > 1.2 * height THEN 90 ELSE 0 END AS turn FROM ({stated('width double, height double, declared int', TURNS)})")
def s17_rotation(spark, sf_dir):
    return spark.createDataFrame(TURNS, "width double, height double, declared int").select("width", "height", L.rotation(F.col("width"), F.col("height"), F.col("declared")).alias("turn"))


OCR = [(1, 1, 0, "3.2 引用标准", 10.0), (1, 1, 1, "正文一行。", 10.0), (1, 1, 2, "正文二行。", 10.0), (1, 1, 3, "大字标题", 14.0), (1, 1, 4, "尾行。", 10.0)]


@query("s18_ocr_blocks", stated("idx int, text string, block_type string", [(1, "3.2 引用标准", "heading"), (2, "正文一行。\n正文二行。", "paragraph"), (3, "大字标题", "heading"), (4, "尾行。", "paragraph")]))
def s18_ocr_blocks(spark, sf_dir):
    return L.ocr_blocks(spark.createDataFrame(OCR, "doc_id long, page int, idx int, text string, height double")).select("idx", "text", "block_type")


# -- tables and questions ----------------------------------------------------------------------------

TABLE = "table_id string, columns array<string>, rows array<array<string>>, section string, source string, doc_id long, kb string, chunk_id long"
DEVICES = [["1", "动力配电箱", "XL-21", "台", "3"], ["2", "水泵", "KQW", "台", "2"], ["3", "照明配电箱", "PZ30", "台", "5"]]


def tables(spark: SparkSession) -> DataFrame:
    plans = lambda n, tag: [[str(i), f"{tag}{i}方案"] for i in range(n)]
    rows = [
        ("doc1:t", ["序号", "名 称", "型号规格", "单位", "数量"], DEVICES, "材料表.xlsx / 电气设备", "材料表.xlsx", 1, "a", 900),
        ("doc2:a", ["序号", "方案名称"], plans(4, "制度"), "已报送方案台账.xlsx / 制度体系", "已报送方案台账.xlsx", 2, "a", 901),
        ("doc2:b", ["序号", "方案名称"], plans(36, "临建"), "已报送方案台账.xlsx / 备案版", "已报送方案台账.xlsx", 2, "a", 902),
    ]
    return spark.createDataFrame(rows, TABLE)


ASKED = [(1, None, "count", "动力配电箱 的 数量 是 多少"), (2, None, "count", "一共 多少 方案 台账"), (3, None, "count", "制度体系 一共 多少 方案"), (4, None, "count", "肖家湾 水泵 有 几台"), (5, None, "enum", "设备 名称 有哪些 配电箱"), (6, "b", "count", "动力配电箱 数量")]


@query("x14_table_answers", stated("qid long, kind string, answer string, n_rows int", [(1, "count", "动力配电箱 数量: 3", 1), (2, "count", "方案 总数: 40", 40), (3, "count", "方案 总数: 4", 4), (5, "enum", "配电箱 相关: 动力配电箱、照明配电箱", 2)]))
def x14_table_answers(spark, sf_dir):
    asked = spark.createDataFrame(ASKED, "qid long, kb string, kind string, said string").withColumn("words", F.split("said", " "))
    return T.answer_tables(asked, tables(spark)).select("qid", "kind", "answer", "n_rows")


CELLS = stated("id string, name string, model string, unit string, n string", [tuple(r) for r in DEVICES])


@query("x6_table_lookups", f"""SELECT (SELECT string_agg(DISTINCT unit, ',') FROM ({CELLS})) AS units, (SELECT n FROM ({CELLS}) WHERE name = '水泵') AS pumps, (SELECT count(*) FROM ({CELLS}) WHERE unit = '台') AS matching,
(SELECT count(*) FROM ({CELLS}) WHERE n > '2') AS later, (SELECT count(*) FROM ({CELLS}) WHERE 'KQW' IN (id, name, model, unit, n)) AS with_cell, CAST(0 AS BIGINT) AS absent""")
def x6_table_lookups(spark, sf_dir):
    c, r = F.col("columns"), F.col("rows")
    size = lambda x: F.size(x).cast("long")
    return tables(spark).filter("table_id = 'doc1:t'").select(
        F.array_join(T.unique_values(c, r, F.lit("单位")), ",").alias("units"),
        T.lookup(c, r, F.lit("名称"), F.lit("水 泵"), F.lit("数量"))[0].alias("pumps"),
        size(T.matching_rows(c, r, F.lit("单位"), F.lit("台"))).alias("matching"),
        size(T.rows_after(c, r, F.lit("数量"), F.lit("2"))).alias("later"),
        size(T.rows_with_cell(r, F.lit("KQW"))).alias("with_cell"),
        size(T.column_values(c, r, F.lit("无此列"))).alias("absent"),
    )


@query("x3_assembled_slices", stated("table_id string, cells string", [("t", "1|2;3|"), ("u", "9")]))
def x3_assembled_slices(spark, sf_dir):
    parts = [("t", 2, ["a", "b"], [["3"]], "s", "f", 1, "k"), ("t", 0, ["a", "b"], [["1", "2", "x"]], "s", "f", 1, "k"), ("u", 0, ["a"], [["9"]], "s", "f", 1, "k")]
    df = spark.createDataFrame(parts, "table_id string, row_index int, columns array<string>, rows array<array<string>>, section string, source string, doc_id long, kb string")
    return T.assemble(df).select("table_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


QUESTIONS = [
    (1, "水泵有几台？", "count", False, False, "水泵有几台？"),
    (2, "请列出所有方案名称", "enum", True, False, "请列出所有方案名称"),
    (3, "水力半径的定义是什么？", None, False, False, "水力半径"),
    (4, "预警信息分为哪几个等级？", "count", True, False, "预警信息 分级"),
    (5, "今天水位多少", "count", True, True, "今天水位多少"),
    (6, "当前正常蓄水位是多少", "count", True, False, "当前正常蓄水位"),
    (7, "随便一句没有问法的话", None, False, False, "随便一句没有问法的话"),
]


@query("r10_question_kinds", stated("qid long, kind string, enumeration boolean, real_time boolean, focused string", [(q, *r) for q, _, *r in QUESTIONS]))
def r10_question_kinds(spark, sf_dir):
    q = F.col("question")
    return spark.createDataFrame([r[:2] for r in QUESTIONS], "qid long, question string").select("qid", U.table_kind(q).alias("kind"), U.is_enumeration(q).alias("enumeration"), U.is_real_time(q).alias("real_time"), U.focus(q).alias("focused"))


ASKS = [("大坝万一垮了怎么办？", "大坝万一垮了怎么办？ 溃坝"), ("桥垮了怎么办？", "桥垮了怎么办？"), ("水流平稳还是乱", "水流平稳还是乱 层流 紊流"), ("  ", "  "), (None, None)]


@query("r11_expansion", stated("question string, expanded string", ASKS))
def r11_expansion(spark, sf_dir):
    return spark.createDataFrame([a[:1] for a in ASKS], "question string").select("question", U.expand(F.col("question")).alias("expanded"))


TALK = [(1, 0, "水库的调度要求是什么？"), (1, 1, "还有呢"), (1, 2, "那第三条呢"), (1, 3, "例5.6为我详细讲解一下"), (1, 4, "谢谢"), (2, 0, "总结一下")]
SOUGHT = ["水库的调度要求是什么？", "水库的调度要求是什么 还有呢", "水库的调度要求是什么 那第三条呢", "例5.6为我详细讲解一下", "谢谢", "总结一下"]


@query("r12_chinese_follow_ups", stated("conv_id long, turn int, search_text string", [(c, t, s) for (c, t, _), s in zip(TALK, SOUGHT, strict=True)]))
def r12_chinese_follow_ups(spark, sf_dir):
    return U.rewritten(spark.createDataFrame(TALK, "conv_id long, turn int, text string")).select("conv_id", "turn", "search_text")


@query("r13_named_documents", stated("qid long, doc_id long", [(1, 6), (5, 7)]))
def r13_named_documents(spark, sf_dir):
    docs = spark.createDataFrame([(6, "重庆市防汛抗旱应急预案.pdf", "a"), (7, "水力学第5版.pdf", "a"), (8, "数字孪生水利导则.docx", "b"), (9, "水利技术标准编写规定.pdf", "b")], "doc_id long, filename string, kb string")
    asked = [(1, "重庆市防汛抗旱应急预案中后期处置有什么要求", None), (2, "预案中规定了什么", None), (3, "在数字孪生工程中如何建设", None), (4, "《水力学第5版》讲了什么", "b"), (5, "《水力学第5版》讲了什么", "a")]
    return U.named_documents(spark.createDataFrame(asked, "qid long, question string, kb string"), docs)


# -- the whole retrieval -----------------------------------------------------------------------------

BODY = "本节规定应急物资储备与调拨的一般程序，以及责任单位在汛期前后应当完成的检查、登记、补充和报告等工作内容，"
SECTIONS = [(i, 1, f"5 应急保障 / 5.{i} 保障{i}", f"应急保障第{i}项。{BODY}编号甲{i}。") for i in range(1, 7)]
SECTIONS += [(i, 2, f"1 总则 / 1.{i} 说明", f"总则说明第{i}项。{BODY}编号乙{i}。") for i in range(11, 14)] + [(20, 3, "9 水泵", f"水泵选型。{BODY}编号丙。"), (21, 3, "9 水泵", "短")]
VECTORS = {**{i: [1.0, 0.1 * i, 0.0] for i in range(1, 7)}, **{i: [0.1, 1.0, 0.1 * (i - 10)] for i in range(11, 14)}, 20: [0.0, 0.0, 1.0], 21: [0.0, 0.1, 1.0]}


def whole_retrieval(spark: SparkSession, rerank=None) -> DataFrame:
    chunks = spark.createDataFrame([("a", i, d, s, t) for i, d, s, t in SECTIONS], "kb string, chunk_id long, doc_id long, section string, content string")
    vectors = spark.createDataFrame([("a", i, d, VECTORS[i]) for i, d, _, _ in SECTIONS], "kb string, chunk_id long, doc_id long, embedding array<double>")
    asked = [
        (1, "动力配电箱的数量是多少", "a", [1.0, 0.0, 0.0], None),
        (2, "应急保障有哪些？", "a", [1.0, 0.2, 0.0], None),
        (3, "水泵选型", "a", [0.0, 0.0, 1.0], None),
        (4, "总则说明", "a", [1.0, 0.1, 0.0], [2]),
        (5, "应急保障", "b", [1.0, 0.0, 0.0], None),
    ]
    questions = spark.createDataFrame(asked, "qid long, question string, kb string, vector array<double>, doc_ids array<bigint>")
    words = tables(spark).select("*")
    return R.retrieve(questions, chunks, vectors, 3, rerank, words)


@query("r20_whole_plan", stated("qid long, expanded string, chunks string", [(1, "table", "900"), (2, "enumeration", "1,2,3,4,5,6"), (3, None, "20,13,12"), (4, None, "11,12,13")]))
def r20_whole_plan(spark, sf_dir):
    found = whole_retrieval(spark)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",")
    return found.groupBy("qid", "expanded").agg(listed.alias("chunks"))


@query("r14_chapter_expansion", stated("qid long, expanded string, chunks string", [(1, "table", "900"), (2, "chapter", "1,2,3,4,5,6")]))
def r14_chapter_expansion(spark, sf_dir):
    found = whole_retrieval(spark, R.overlap_rerank).filter("expanded IS NOT NULL")
    return found.groupBy("qid", "expanded").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("chunks"))


@query("r22_table_citation", stated("qid long, snippet string, block_type string, score double, rank int, doc_id long, source string", [(1, "动力配电箱 数量: 3", "table", 1.0, 1, 1, "材料表.xlsx")]))
def r22_table_citation(spark, sf_dir):
    asked = spark.createDataFrame(ASKED[:1], "qid long, kb string, kind string, said string").withColumn("words", F.split("said", " "))
    return R.table_citations(T.answer_tables(asked, tables(spark)), tables(spark)).select("qid", "snippet", "block_type", "score", "rank", "doc_id", "source")


# -- text functions ----------------------------------------------------------------------------------

PLACES = [("7.4 明渠均匀流 / 7.4.1 一般规定", "见式(7.4.3-1)和(3.45)", "7.4.1", "7.4.3-1"), ("总则", "见（5.48）", None, "5.48"), ("附录/3 数据", "无", None, None)]


@query("c11_clause_and_formula", stated("section string, clause string, formula string", [(s, c, f) for s, _, c, f in PLACES]))
def c11_clause_and_formula(spark, sf_dir):
    return spark.createDataFrame([p[:2] for p in PLACES], "section string, content string").select("section", X.clause_no(F.col("section")).alias("clause"), X.formula_no(F.col("content")).alias("formula"))


CITED = [(1, "见 [1] 与 [9]，[0]。", 3, "0,9", "见 |[1]| 与 [9]，[0]。"), (2, "[2][3]完", 3, "", "[2]|[3]|完"), (3, "无引用", 3, "", "无引用")]


@query("f13_citations", stated("id long, bad string, pieces string", [(i, b, p) for i, _, _, b, p in CITED]))
def f13_citations(spark, sf_dir):
    df = spark.createDataFrame([c[:3] for c in CITED], "id long, answer string, n int")
    pieces = F.array_join(F.transform(X.cited_pieces(F.col("answer"), F.col("n")), lambda x: x["text"]), "|")
    return df.select("id", F.array_join(X.bad_citations(F.col("answer"), F.col("n")).cast("array<string>"), ",").alias("bad"), pieces.alias("pieces"))


CELL_DATES = ["2025.9.5", "2025-09-01 00:00:00", "001", " x ", None]


@query("s20_date_cells", f"SELECT id, CASE WHEN regexp_matches(c, '^\\d{{4}}[.-]\\d{{1,2}}[.-]\\d{{1,2}}$') THEN strftime(CAST(replace(c, '.', '-') AS DATE), '%Y-%m-%d') ELSE c END AS cell FROM (SELECT id, regexp_replace(trim(coalesce(cell, '')), '\\s+00:00:00$', '') AS c FROM ({stated('id long, cell string', list(enumerate(CELL_DATES)))}))")
def s20_date_cells(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(CELL_DATES)), "id long, cell string").select("id", X.iso_date_cell(F.col("cell")).alias("cell"))


# -- state, evaluation, answers ----------------------------------------------------------------------

JOB = "id long, document_id long, stage string, attempt int, lease_owner string, lease_until string, cancel_requested boolean, created_at string"
JOBS = [(1, 7, "queued", 0, None, None, False, "2024-01-02"), (2, 8, "queued", 0, None, None, False, "2024-01-01"), (3, 9, "running", 1, "w", "2024-01-01", False, "2024-01-01"), (4, 5, "queued", 0, None, None, True, "2023-01-01")]


def jobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(JOBS, JOB).withColumns({c: F.col(c).cast("timestamp") for c in ("lease_until", "created_at")})


@query("g1_claim", f"SELECT id, CASE WHEN id = (SELECT id FROM j WHERE stage = 'queued' AND NOT cancel_requested ORDER BY created_at, id LIMIT 1) THEN 'running' ELSE stage END AS stage FROM j".replace("FROM j", f"FROM ({stated(JOB, JOBS)})"))
def g1_claim(spark, sf_dir):
    return D.claim(jobs(spark), F.lit("w2"), F.lit("2024-01-03").cast("timestamp")).select("id", "stage")


@query("g3_reap", f"SELECT id, CASE WHEN stage = 'running' AND lease_until < '2024-01-03' THEN 'failed' ELSE stage END AS stage FROM ({stated(JOB, JOBS)})")
def g3_reap(spark, sf_dir):
    return D.reap(jobs(spark), F.lit("2024-01-03").cast("timestamp")).select("id", "stage")


@query("g2_enqueue", f"SELECT id, document_id FROM ({stated(JOB, JOBS)}) UNION ALL SELECT 11, 70")
def g2_enqueue(spark, sf_dir):
    wanted = jobs(spark).limit(0).unionByName(spark.createDataFrame([(10, 7, "queued", 0, None, None, False, "2024-02-01"), (11, 70, "queued", 0, None, None, False, "2024-02-01")], JOB).withColumns({c: F.col(c).cast("timestamp") for c in ("lease_until", "created_at")}))
    return D.enqueue(jobs(spark), wanted).select("id", "document_id")


STORE = [(1, "a", 1), (2, "b", 1), (3, "c", 2)]


@query("d1_upsert_and_delete", f"SELECT id, CASE WHEN id = 2 THEN 'new' ELSE v END AS v FROM ({stated('id long, v string, doc_id long', STORE)}) WHERE doc_id <> 2 UNION ALL SELECT 9, 'added'")
def d1_upsert_and_delete(spark, sf_dir):
    kind = "id long, v string, doc_id long"
    more = D.upserted(spark.createDataFrame(STORE, kind), spark.createDataFrame([(2, "new", 1), (9, "added", 1)], kind), ["id"])
    return D.without(more, spark.createDataFrame([(2,)], "doc_id long"), ["doc_id"]).select("id", "v")


MESSAGES = [(1, 1, "user", "问一", None), (2, 1, "assistant", "答一", "up"), (3, 1, "user", "问二", None), (4, 1, "assistant", "答二", "down"), (5, 1, "assistant", "答三", "none"), (6, 2, "assistant", "无问", "up")]
MESSAGE = "id long, conversation_id long, role string, content string, feedback string"


@query("m9_feedback", f"SELECT m.id AS message_id, (SELECT content FROM ({stated(MESSAGE, MESSAGES)}) q WHERE q.conversation_id = m.conversation_id AND q.role = 'user' AND q.id < m.id ORDER BY q.id DESC LIMIT 1) AS question, content AS answer, CASE feedback WHEN 'up' THEN 'good' ELSE 'bad' END AS status FROM ({stated(MESSAGE, MESSAGES)}) m WHERE role = 'assistant' AND feedback IN ('up', 'down') AND conversation_id = 1")
def m9_feedback(spark, sf_dir):
    return M.feedback_entries(spark.createDataFrame(MESSAGES, MESSAGE))


ENTRY = [(i, 1, "2024-01-%02d" % i) for i in range(1, 11)] + [(50, 2, "2023-01-01")]


@query("m6_stored_cache", f"SELECT id FROM ({stated('id long, user_id long, t string', ENTRY)}) WHERE user_id = 2 OR id > 2 UNION ALL SELECT 99")
def m6_stored_cache(spark, sf_dir):
    rows = lambda x: spark.createDataFrame(x, "id long, user_id long, t string").select("id", "user_id", F.lit(None).cast("long").alias("kb_id"), F.col("t").cast("timestamp").alias("updated_at"))
    return M.store_cached(rows(ENTRY), rows([(99, 1, "2024-02-01")]), F.lit("2024-02-01").cast("timestamp"), cap=10).select("id")


GOLD = [(1, "general", "k", "alpha", "4.3"), (2, "table", "k", "beta", None), (3, "general", "z", "none", "9")]
HITS = [(1, 6, "has alpha", "4.3 title", "f", 1, None), (2, 1, "beta", None, "f", 0, None), (1, 1, "no", "4.30 x", "f", None, None)]


@query("e2_question_scores", stated("qid long, recall5 boolean, recall10 boolean, clause5 boolean, clause10 boolean, citation boolean", [(1, False, True, False, True, True), (2, True, True, None, None, False), (3, False, False, False, False, False)]))
def e2_question_scores(spark, sf_dir):
    gold = spark.createDataFrame(GOLD, "qid long, intent string, kb string, word string, clause string").select("qid", "intent", "kb", F.array("word").alias("expect_keywords"), F.when(F.col("clause").isNotNull(), F.array("clause")).alias("expect_clauses"))
    hits = spark.createDataFrame(HITS, "qid long, rank int, snippet string, section string, source string, page int, clause_no string")
    return E.scored_questions(gold, hits).select("qid", "recall5", "recall10", "clause5", "clause10", "citation")


MEASURES = [("r5", 0.9, 0.9), ("r10", 0.89, 0.9), ("mrr", 0.8899, 0.9), ("new", 1.0, 0.5)]


@query("e4_gate", f"SELECT measure, value >= base - 0.01 - 1e-9 AS passed FROM ({stated('measure string, value double, base double', MEASURES)})")
def e4_gate(spark, sf_dir):
    rows = spark.createDataFrame(MEASURES, "measure string, value double, base double")
    return E.gate(rows.select("measure", "value"), rows.select("measure", F.col("base").alias("value"))).select("measure", "passed")


@query("e7_root_cause", stated("chunk_id long, lost_at string", [(1, None), (2, "fused"), (3, "vector")]))
def e7_root_cause(spark, sf_dir):
    t = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "qid long, chunk_id long")
    return E.root_cause(t, ("vector", t.filter("chunk_id < 3")), ("fused", t.filter("chunk_id = 1"))).select("chunk_id", "lost_at")


@query("e6_unsupported_gold", stated("qid long, keyword string", [(3, "none")]))
def e6_unsupported_gold(spark, sf_dir):
    gold = spark.createDataFrame(GOLD, "qid long, intent string, kb string, word string, clause string").select("qid", "kb", F.array("word").alias("expect_keywords"))
    return E.unsupported_gold(gold, spark.createDataFrame([("k", "alpha text"), ("k", "beta")], "kb string, content string"))


PARSED = [("a", 0.9, 0.5, None), ("b", 1.0, None, None), ("c", None, None, None)]


@query("e8_weighted_score", f"SELECT engine, round((coalesce(clean, 0) * 2 + coalesce(tables, 0)) / nullif((CASE WHEN clean IS NULL THEN 0 ELSE 2 END) + (CASE WHEN tables IS NULL THEN 0 ELSE 1 END), 0), 4) AS score FROM ({stated('engine string, clean double, tables double, extra double', PARSED)})")
def e8_weighted_score(spark, sf_dir):
    return E.weighted_score(spark.createDataFrame(PARSED, "engine string, clean double, tables double, extra double"), {"clean": 2.0, "tables": 1.0}).select("engine", "score")


ANSWERS = [(1, "see [1] and [9]", 2), (2, "", 2), (3, "x [7]", 0), (4, "[2]", 2)]


@query("v2_citation_verdict", stated("id long, ok boolean", [(1, False), (2, True), (3, True), (4, True)]))
def v2_citation_verdict(spark, sf_dir):
    return A.citation_verdict(spark.createDataFrame(ANSWERS, "id long, answer string, n_sources int")).select("id", "ok")


REPLIES = [(1, 'ok {"enumeration": true, "complete": false, "note": "缺三条"}', True, False, "缺三条"), (2, "junk", False, True, ""), (3, None, False, True, "")]


@query("v1_completeness_verdict", stated("id long, enumeration boolean, complete boolean, note string", [(i, *r) for i, _, *r in REPLIES]))
def v1_completeness_verdict(spark, sf_dir):
    return spark.createDataFrame([r[:2] for r in REPLIES], "id long, reply string").select("id", A.completeness_verdict(F.col("reply")).alias("v")).select("id", "v.*")


PICKS = [(1, "`[0, 2, 9]`", "a,c", "a,b,c"), (2, "no", "", "a,b,c"), (3, '{"missing": ["b", "z"]}', "", "b")]


@query("v3_model_lists", stated("id long, picked string, confirmed string", [(i, p, c) for i, _, p, c in PICKS]))
def v3_model_lists(spark, sf_dir):
    given = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    df = spark.createDataFrame([p[:2] for p in PICKS], "id long, reply string")
    return df.select("id", F.array_join(A.picked_lines(given, F.col("reply")), ",").alias("picked"), F.array_join(A.confirmed_numbers(given, F.col("reply")), ",").alias("confirmed"))


FOUND = [(1, 1, "规范.pdf", 3, "第一段"), (1, 2, "手册.pdf", None, "第二段")]


@query("f15_prompt", "SELECT CAST(1 AS BIGINT) AS qid, '依据' || chr(10) || chr(10) || '[1] 规范.pdf p. 3: 第一段' || chr(10) || '[2] 手册.pdf: 第二段' || chr(10) || chr(10) || '问' AS prompt")
def f15_prompt(spark, sf_dir):
    evidence = A.numbered_evidence(spark.createDataFrame(FOUND, "qid long, rank int, source string, page int, snippet string"))
    return A.prompts(spark.createDataFrame([(1, "问")], "qid long, question string"), evidence, "依据")


@query("t5_dotted_order", "SELECT number, row_number() OVER (ORDER BY list_transform(string_split(number, '.'), lambda x: CAST(x AS INT))) AS place FROM (VALUES ('1.10'), ('1.2'), ('1'), ('2.1.3')) t(number)")
def t5_dotted_order(spark, sf_dir):
    from pyspark.sql import Window as W

    df = spark.createDataFrame([("1.10",), ("1.2",), ("1",), ("2.1.3",)], "number string")
    return df.withColumn("place", F.row_number().over(W.orderBy(Q.dotted_key(F.col("number")))).cast("long"))
