"""Literals of the table channel and of question understanding."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import tables as T
from quillon.operators import understanding as U
from quillon.operators.substrings import containing


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("v")).first().v


@pytest.mark.parametrize(("q", "want"), [("水泵有几台？", "count"), ("请列出所有方案名称", "enum"), ("什么是径流？", None), ("一共多少方案有哪些", "count")])
def test_table_kind(spark, q, want):
    assert value(spark, U.table_kind(F.col("q")), q=q) == want


@pytest.mark.parametrize(("q", "want"), [("水力半径的定义是什么？", "水力半径"), ("预警信息分为哪几个等级？", "预警信息 分级"), ("随便一句没有问法的话", "随便一句没有问法的话")])
def test_focus(spark, q, want):
    assert value(spark, U.focus(F.col("q")), q=q) == want


def test_expansion(spark):
    assert "溃坝" in value(spark, U.expand(F.col("q")), q="大坝万一垮了怎么办？")
    for q in ("桥垮了怎么办？", "", "  ", None):
        assert value(spark, U.expand(F.col("q")), q=q) == q


@pytest.mark.parametrize(("q", "want"), [("今天水位多少", True), ("当前正常蓄水位是多少", False), ("现在几点了", True), ("水库的作用是什么", False), ("", False)])
def test_real_time(spark, q, want):
    assert value(spark, U.is_real_time(F.col("q")), q=q) is want


def test_follow_ups(spark):
    rows = [(1, 0, "水库的调度要求是什么？"), (1, 1, "还有呢"), (1, 2, "那第三条呢"), (1, 3, "例5.6为我详细讲解一下"), (1, 4, "谢谢"), (2, 0, "总结一下")]
    got = U.rewritten(spark.createDataFrame(rows, "conv_id int, turn int, text string")).orderBy("conv_id", "turn").collect()
    assert [r.search_text for r in got] == ["水库的调度要求是什么？", "水库的调度要求是什么 还有呢", "水库的调度要求是什么 那第三条呢", "例5.6为我详细讲解一下", "谢谢", "总结一下"]


def test_named_documents(spark):
    docs = spark.createDataFrame([(6, "重庆市防汛抗旱应急预案.pdf", "a"), (7, "水力学第5版.pdf", "a"), (8, "数字孪生水利导则.docx", "b"), (9, "水利技术标准编写规定.pdf", "b")], "doc_id int, filename string, kb string")
    asked = spark.createDataFrame([(1, "重庆市防汛抗旱应急预案中后期处置有什么要求", None), (2, "预案中规定了什么", None), (3, "在数字孪生工程中如何建设", None), (4, "《水力学第5版》讲了什么", "b")], "qid int, question string, kb string")
    assert {(r.qid, r.doc_id) for r in U.named_documents(asked, docs).collect()} == {(1, 6)}


COLUMNS = ["序号", "名 称", "型号规格", "单位", "数量", "备 注"]
ROWS = [["1", "动力配电箱", "XL-21", "台", "3", ""], ["2", "水泵", "KQW", "台", "2", "备用"], ["3", "照明配电箱", "PZ30", "台", "5", ""]]


@pytest.fixture(scope="module")
def tables(spark):
    plans = lambda n, tag: [[str(i), f"{tag}{i}方案"] for i in range(n)]
    rows = [
        ("doc1:t", COLUMNS, ROWS, "材料表.xlsx / 电气设备", "材料表.xlsx", 1, "a"),
        ("doc2:a", ["序号", "方案名称"], plans(4, "制度"), "已报送方案台账.xlsx / 制度体系", "已报送方案台账.xlsx", 2, "a"),
        ("doc2:b", ["序号", "方案名称"], plans(36, "临建"), "已报送方案台账.xlsx / 备案版", "已报送方案台账.xlsx", 2, "a"),
    ]
    return spark.createDataFrame(rows, "table_id string, columns array<string>, rows array<array<string>>, section string, source string, doc_id int, kb string")


def test_table_primitives(spark, tables):
    one = tables.filter("table_id = 'doc1:t'")
    got = one.select(
        T.unique_values(F.col("columns"), F.col("rows"), F.lit("名称")).alias("names"),
        T.lookup(F.col("columns"), F.col("rows"), F.lit("名称"), F.lit("动力 配电箱"), F.lit("数量")).alias("n"),
        T.matching_rows(F.col("columns"), F.col("rows"), F.lit("单位"), F.lit("台")).alias("m"),
        T.rows_with_cell(F.col("rows"), F.lit("备用")).alias("w"),
        T.column_values(F.col("columns"), F.col("rows"), F.lit("无")).alias("none"),
        T.rows_after(F.col("columns"), F.col("rows"), F.lit("数量"), F.lit("2")).alias("after"),
    ).first()
    assert got.names == ["动力配电箱", "水泵", "照明配电箱"] and got.n == ["3"] and len(got.m) == 3 and got.w == [ROWS[1]] and got.none == [] and len(got.after) == 2


def test_table_answers(spark, tables):
    asked = spark.createDataFrame(
        [
            (1, None, "count", ["动力配电箱", "的", "数量", "是", "多少"]),
            (2, None, "count", ["一共", "多少", "方案", "台账"]),
            (3, None, "count", ["制度体系", "一共", "多少", "方案"]),
            (4, None, "count", ["肖家湾", "水泵", "有", "几台"]),
            (5, None, "enum", ["设备", "名称", "有哪些", "配电箱"]),
            (6, "b", "count", ["动力配电箱", "数量"]),
        ],
        "qid int, kb string, kind string, words array<string>",
    )
    got = {r.qid: r for r in T.answer_tables(asked, tables).collect()}
    assert got[1].answer == "动力配电箱 数量: 3" and got[1].n_rows == 1
    assert got[2].answer == "方案 总数: 40" and got[3].answer == "方案 总数: 4"
    assert 4 not in got and 6 not in got and got[5].answer == "配电箱 相关: 动力配电箱、照明配电箱"


def test_assembly_pads_rows(spark):
    parts = spark.createDataFrame([("t", 2, ["a", "b"], [["3"]], "s", "f", 1, "k"), ("t", 0, ["a", "b"], [["1", "2", "x"]], "s", "f", 1, "k")], "table_id string, row_index int, columns array<string>, rows array<array<string>>, section string, source string, doc_id int, kb string")
    assert T.assemble(parts).first().rows == [["1", "2"], ["3", ""]]


@pytest.mark.parametrize(("cell", "want"), [("2025.9.5", "2025-09-05"), ("2025-09-01 00:00:00", "2025-09-01"), ("001", "001"), (None, "")])
def test_cell_dates(spark, cell, want):
    assert value(spark, X.iso_date_cell(F.col("c")), c=cell) == want


@pytest.mark.parametrize(("text", "want"), [("见8.2.3条", True), ("见8.2.30条", False), ("见18.2.3条", False)])
def test_clause_boundary(spark, text, want):
    assert value(spark, X.contains_clause(F.col("t"), F.lit("8.2.3")), t=text) is want


def test_text_functions(spark):
    assert value(spark, X.clause_no(F.col("s")), s="7.4 明渠均匀流 / 7.4.1 一般规定") == "7.4.1"
    assert value(spark, X.formula_no(F.col("s")), s="见式(7.4.3-1)和(3.45)") == "7.4.3-1" and value(spark, X.formula_no(F.col("s")), s="见（5.48）") == "5.48"
    assert value(spark, X.redact(F.col("s")), s="Authorization: Bearer abc.def, password=hunter2 sk-abcdef123 postgres://u:pw@h") == "Authorization: Bearer ***, password=*** sk-*** postgres://u:***@h"
    assert value(spark, X.analyze(F.col("s")), s="Hello, 水力学 x1") == ["hello", "水力", "力学", "x1"]
    assert value(spark, X.bad_citations(F.col("s"), F.lit(3)), s="a [1] b [4] c [0] d [4]") == [0, 4]
    assert value(spark, X.path_template(F.col("s")), s="/kb/12/docs/7") == "/kb/{id}/docs/{id}"
    assert value(spark, X.first_json_object(F.col("s")), s='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert value(spark, X.in_pieces(F.col("s"), 2), s="abcde") == ["ab", "cd", "e"]
    assert len(value(spark, X.hash_embedding(F.col("s")), s="x")) == 64


def test_slices_are_numbered_without_gathering_a_table(spark):
    schema = "table_id string, row_index int, columns array<string>, rows array<array<string>>, section string, source string, doc_id int, kb string"
    rows = [("t", i, ["a", "b"] if i else ["a", "b", "c"], [[f"{i}.{j}", "x", "y", "z"][: 1 + j % 4] for j in range(i % 5)], f"s{i}", "f", i, "k") for i in range(40)]
    heads, cells = T.assembled(spark.createDataFrame(rows, schema).repartition(3))
    want = [(r + [""] * 3)[:3] for _, _, _, own, *_ in rows for r in own]
    got = sorted((r.row_no, r.col, r.value) for r in cells.collect())
    assert got == [(n, c, v) for n, r in enumerate(want) for c, v in enumerate(r)]
    head = heads.first()
    assert head.columns == ["a", "b", "c"] and head.section == "s0" and head.n_rows == len(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_containing_equals_all_with_all(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abac漢😀 ", k=rng.choice([0, 1, 2, 3, 5, 9])))
    texts, patterns = [word() for _ in range(300)] + [None], [word() for _ in range(80)] + [None]
    got = containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {(t, p) for t in texts if t for p in patterns if p and len(p) >= 2 and p in t}


def test_a_frequent_pair_is_no_key_for_patterns_with_a_rarer_one(spark):
    texts = spark.createDataFrame([(f"ab{i}",) for i in range(500)], "text string")
    patterns = spark.createDataFrame([(f"ab{i}",) for i in range(0, 500, 10)], "pattern string")
    found = containing(texts, patterns)
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*\(gram#\d+ = gram#\d+\)", joined)
    assert found.count() == sum(str(j).startswith(str(i)) for i in range(0, 500, 10) for j in range(500))


def test_table_queries_hold_no_table_as_an_array(spark, sf):
    from quillon import plans

    for name in ("x9_table_scores", "x11_counts", "x14_sheet_answers"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "array<array<string>>" not in plan and plan.count("collect_list") <= (name != "x9_table_scores")  # the list that is the answer


def test_empty_tables_and_questions(spark, tables):
    asked = spark.createDataFrame([(1, None, "count", ["水泵", "多少"]), (2, None, None, ["水泵"]), (3, None, "enum", None)], "qid int, kb string, kind string, words array<string>")
    assert [r.answer for r in T.answer_tables(asked, tables).collect()] == ["水泵 数量: 2"]
    assert T.answer_tables(asked, tables.limit(0)).count() == 0 == T.answer_tables(asked.limit(0), tables).count()


def test_equal_questions_and_cells_are_one_row(spark, monkeypatch):
    stages = {}
    plain = T.staged
    monkeypatch.setattr(T, "staged", lambda df, name: stages.setdefault(name, plain(df, name)))
    table = spark.createDataFrame([("t", ["名称", "数量"], [["水泵", "2"]] * 40, "s", "f", 1, "a")], "table_id string, columns array<string>, rows array<array<string>>, section string, source string, doc_id int, kb string")
    asked = spark.createDataFrame([(i // 2, None, "count", ["水泵"]) for i in range(60)], "qid int, kb string, kind string, words array<string>")
    got = T.answer_tables(asked, table).collect()
    assert sorted(r.qid for r in got) == [i // 2 for i in range(60)] and {(r.answer, r.n_rows) for r in got} == {("水泵 数量: 40", 40)}
    assert stages["asked-once"].count() == 1 and stages["distinct-cells"].count() == 2


def test_scores_of_all_pairs_of_brands_and_sheets(spark, sf):
    from quillon import plans

    rows = plans.queries()["x9_table_scores"](spark, sf).collect()
    brands = {r.brand for r in rows}
    assert {(r.brand, r.table_id) for r in rows} == {(a, b) for a in brands for b in brands} and any(r.score == 0 for r in rows)
