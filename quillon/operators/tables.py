"""Exact answers from tables held in chunks: reassembly, cell tests, scoring, counts, totals, lists.

A table is a head (table_id, kb, doc_id, source, section, columns, n_rows) and cells (table_id, row_no, col, value): a
sheet of any length is as many rows as it has cells, never an array. Questions meet cells through the distinct
values that contain one of their words or are contained in one. Words of a question are given as an array, so any
analyzer may make them. Small tables may also be given whole, as rows of arrays (columns, rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import squash
from ..staging import staged
from .substrings import containing


@dataclass(frozen=True)
class TableLexicon:
    """Fixed values of the Chinese engineering domain."""

    name_columns: tuple[str, ...] = ("名称", "方案", "项目", "工程", "设备", "材料", "措施", "内容", "类别", "类型")
    name_end: str = "名称"
    count_columns: tuple[str, ...] = ("数量", "个数", "台数", "套数", "件数", "总量", "合计")
    generic: tuple[str, ...] = ("方案", "项目", "工程", "措施", "内容", "设备", "材料", "名称", "制度", "台账", "管理", "施工", "体系", "预案", "清单", "一览表", "汇总")
    units: tuple[str, ...] = ("方案", "设备", "项目", "工程", "措施", "材料", "内容")
    containers: tuple[str, ...] = ("台账", "文档", "文件")
    stop: tuple[str, ...] = (
        "数量", "多少", "几个", "几台", "几套", "几座", "几处", "个数", "台数", "套数", "共计", "合计", "有哪些", "哪些", "列出", "清单",
        "一览", "名单", "所有", "全部", "都有", "都包含", "包含", "包括", "什么", "请问", "请", "的", "是", "吗", "呢", "如何", "怎么",
        "怎样", "有", "几", "个", "台", "套", "座", "中", "里", "内", "谁", "哪里", "哪", "您好", "你好", "帮我", "查", "查询",
        "一共", "总共", "这份", "请以", "表格", "形式", "输出", "给我", "不用", "不要", "关心", "麻烦", "需要", "别", "这", "那",
    )
    signal: str = "多少|几台|几套|几座|几个|几处|数量|个数|台数|套数|共计|合计|有哪些|哪些|列出|清单|一览|名单|所有|全部|都有|都包含|几级|几种|几类"
    clause_end: str = "[。！？!；;\\n]"
    comma: str = "，"
    list_comma: str = "、"


DEFAULT = TableLexicon()


def assembled(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and cells of tables from their slices (table_id, row_index, columns, rows, section, source, doc_id, kb): rows are
    numbered in order of row_index, and cut to the width of the first slice's columns. Cells that a short row lacks are
    empty. Slices are numbered by their sizes alone; no table is gathered."""
    slices = staged(parts, "slices")
    order = W.partitionBy("table_id").orderBy("row_index", F.col("columns").cast("string"), F.xxhash64(F.to_json("rows"))).rowsBetween(W.unboundedPreceding, -1)
    sized = slices.withColumn("before", F.coalesce(F.sum(F.size("rows")).over(order), F.lit(0)))
    first = F.min_by(F.struct("columns", "section", "source", "doc_id", "kb"), F.struct("row_index", "before"))
    heads = sized.groupBy("table_id").agg(first.alias("f"), F.sum(F.size("rows")).alias("n_rows"))
    heads = staged(heads.select("table_id", "f.kb", "f.doc_id", "f.source", "f.section", "f.columns", "n_rows"), "table-heads")
    rows = sized.select("table_id", "before", F.posexplode("rows").alias("at", "row")).join(heads.select("table_id", F.size("columns").alias("width")), "table_id")
    fit = F.slice(F.concat("row", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    return heads, rows.select("table_id", (F.col("before") + F.col("at")).alias("row_no"), F.posexplode(fit).alias("col", "value"))


def assemble(parts: DataFrame) -> DataFrame:
    """Small tables from their slices as rows of arrays: assembled(), gathered again."""
    heads, cells_ = assembled(parts)
    rows = cells_.groupBy("table_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: c["value"]).alias("row"))
    whole = rows.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "row"))), lambda r: r["row"]).alias("rows"))
    return heads.drop("n_rows").join(whole, "table_id")


def as_cells(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads and cells of tables given as rows of arrays (columns, rows)."""
    full = tables.filter("size(columns) > 0 and size(rows) > 0")
    heads = full.select("table_id", "kb", "doc_id", "source", "section", "columns", F.size("rows").cast("long").alias("n_rows"))
    return heads, full.select("table_id", F.posexplode("rows").alias("row_no", "row")).select("table_id", F.col("row_no").cast("long"), F.posexplode("row").alias("col", "value"))


def namespaced(table_id: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("doc"), doc_id.cast("string"), F.lit(":"), table_id)


def column_index(columns: Column, name: Column) -> Column:
    """Place (from 0) of a column by its normal form, null if absent."""
    at = F.array_position(F.transform(columns, squash), squash(name))
    return F.when(at > 0, (at - 1).cast("int"))


def cells(rows: Column, at: Column) -> Column:
    return F.transform(rows, lambda r: F.get(r, at))


def column_values(columns: Column, rows: Column, name: Column) -> Column:
    at = column_index(columns, name)
    return F.when(at.isNull(), F.array().cast("array<string>")).otherwise(cells(rows, at))


def unique_values(columns: Column, rows: Column, name: Column) -> Column:
    """Distinct values in order of first occurrence."""
    return F.array_distinct(column_values(columns, rows, name))


def matching_rows(columns: Column, rows: Column, name: Column, value: Column) -> Column:
    at = column_index(columns, name)
    return F.when(at.isNull(), F.array().cast("array<array<string>>")).otherwise(F.filter(rows, lambda r: squash(F.get(r, at)) == squash(value)))


def lookup(columns: Column, rows: Column, where: Column, value: Column, get: Column) -> Column:
    at = column_index(columns, get)
    return F.when(at.isNull(), F.array().cast("array<string>")).otherwise(cells(matching_rows(columns, rows, where, value), at))


def rows_after(columns: Column, rows: Column, name: Column, iso_date: Column) -> Column:
    """Rows whose ISO date is later; text order is date order."""
    at = column_index(columns, name)
    return F.when(at.isNull(), F.array().cast("array<array<string>>")).otherwise(F.filter(rows, lambda r: squash(F.get(r, at)) > iso_date))


def rows_with_cell(rows: Column, value: Column) -> Column:
    return F.filter(rows, lambda r: F.exists(r, lambda c: squash(c) == squash(value)))


def name_column(columns: Column, lex: TableLexicon = DEFAULT) -> Column:
    """Place of the first column of names, null without one."""
    at = F.array_position(F.transform(columns, lambda c: squash(c).isin(*lex.name_columns) | squash(c).endswith(lex.name_end)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def count_column(columns: Column, lex: TableLexicon = DEFAULT) -> Column:
    at = F.array_position(F.transform(columns, lambda c: squash(c).isin(*lex.count_columns)), True)
    return F.when(at > 0, (at - 1).cast("int"))


def content_words(words: Column, lex: TableLexicon = DEFAULT) -> Column:
    """Words of two characters or more that say what is asked for, each once, in order."""
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (F.length(w) >= 2) & ~w.isin(*lex.stop)))


def question_core(question: Column, lex: TableLexicon = DEFAULT) -> Column:
    """The clauses that ask; the whole question if none does."""
    clauses = F.filter(F.transform(F.split(question, lex.clause_end), lambda c: F.trim(c)), lambda c: c != "")
    core = F.filter(clauses, lambda c: c.rlike(lex.signal))
    return F.when(F.size(core) > 0, F.array_join(core, lex.comma)).otherwise(F.trim(question))


def _either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def _stem(source: Column) -> Column:
    return F.regexp_replace(squash(F.coalesce(source, F.lit(""))), r"\.[^.]+$", "")


def _parts(section: Column) -> Column:
    return F.filter(F.split(squash(F.coalesce(section, F.lit(""))), r"[/\\]"), lambda p: p != "")


def sheet_name(section: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), r"[/\\]"), lambda p: F.trim(p)), lambda p: p != ""), F.lit(-1)), F.lit(""))


def word_places(words: DataFrame, heads: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the words (word) stand: (word, table_id, points), one row for each kind of place in a table (8 for each section part
    that contains the word, 3 for the file's name, 3 for the columns and 2 for the cells that contain it or are contained
    in it); and (word, text) of the cell values among them."""
    text = squash(F.col("value"))
    values = staged(cells.select("table_id", text.alias("text")).filter("length(text) >= 2").distinct(), "cell-values")
    names = heads.select("table_id", F.explode(F.transform("columns", squash)).alias("text")).distinct()
    parts = heads.select("table_id", F.explode(_parts(F.col("section"))).alias("text")).groupBy("table_id", "text").agg(F.count("*").alias("n"))
    stems = heads.select("table_id", _stem(F.col("source")).alias("text"))
    words = words.select("word").distinct()
    inner = [values.select("text"), names.select("text")]
    texts = inner[0].unionByName(inner[1]).unionByName(parts.select("text")).unionByName(stems.select("text"))
    holds = staged(containing(texts, words.select(F.col("word").alias("pattern"))).select("text", F.col("pattern").alias("word")), "texts-of-words")
    held = containing(words.select(F.col("word").alias("text")), inner[0].unionByName(inner[1]).select(F.col("text").alias("pattern"))).select(F.col("pattern").alias("text"), F.col("text").alias("word"))
    either = staged(holds.unionByName(held).distinct(), "words-and-texts")
    # a column's name of one character may stand in a word, which pairs of characters do not tell
    single = names.filter("length(text) = 1").join(words.select("word", F.explode(F.array_distinct(F.split("word", ""))).alias("text")), "text").select("word", "table_id")
    near = either.join(names, "text").select("word", "table_id").unionByName(single).distinct()
    in_cells = either.join(values, "text").select("word", "table_id").distinct()
    in_parts = holds.join(parts, "text").groupBy("word", "table_id").agg((8 * F.sum("n")).alias("points"))
    flat = lambda df, n: df.select("word", "table_id", F.lit(n).cast("long").alias("points"))
    places = in_parts.unionByName(flat(holds.join(stems, "text"), 3)).unionByName(flat(near, 3)).unionByName(flat(in_cells, 2))
    return staged(places, "word-places"), staged(either.join(values.select("text").distinct(), "text", "left_semi").select("word", "text"), "word-cells")


def answer_cells(questions: DataFrame, heads: DataFrame, cells: DataFrame, lex: TableLexicon = DEFAULT) -> DataFrame:
    """qid, kind, subject, answer, table_id, n_rows for each question (qid, kb, kind, words) that a table answers exactly;
    no row for any other, which then goes to retrieval. Tables are scored for the questions of their scope with which they
    share a word; of the best one only the cells that a question needs are read. Questions of one scope, kind and list of words
    are answered once, and equal cells of a column are one row with their number, so no pair of a question and a row is made."""
    heads = staged(heads.filter("size(columns) > 0 and n_rows > 0").withColumns({"names": name_column(F.col("columns"), lex), "counts": count_column(F.col("columns"), lex)}), "heads")
    cells = cells.join(heads.select("table_id"), "table_id", "left_semi")
    normal = cells.groupBy("table_id", "col", squash(F.col("value")).alias("text"), "value").agg(F.min("row_no").alias("row_no"), F.count("*").alias("n"))
    normal = staged(normal, "distinct-cells")
    every = questions.filter("kind is not null").select("qid", F.col("kb").alias("scope"), "kind", content_words(F.col("words"), lex).alias("words")).filter("size(words) > 0")
    every = staged(every.withColumn("asked", F.to_json(F.struct("scope", "kind", "words"))), "asked")
    asked = staged(every.select(F.col("asked").alias("qid"), "scope", "kind", "words").distinct(), "asked-once")
    said = asked.select("qid", "scope", "kind", "words", F.posexplode("words").alias("at", "word"))
    places, values = word_places(said.select("word"), heads, normal)
    met = said.select("qid", "scope", "at", "word").join(places, "word").join(heads.select("table_id", "kb"), "table_id").filter(F.col("scope").isNull() | (F.col("scope") == F.col("kb")))
    found = staged(met.groupBy("qid", "table_id", "at", "word").agg(F.sum("points").alias("points")), "word-points")
    scores = found.groupBy("qid", "table_id").agg(F.sum("points").alias("score"))
    best = scores.groupBy("qid").agg(F.min(F.struct((-F.col("score")).alias("s"), "table_id")).alias("x")).select("qid", F.col("x.table_id").alias("table_id"))
    needed = said.filter((F.length("word") >= 3) & ~F.col("word").isin(*lex.generic, *lex.units, *lex.stop)).select("qid", "at")
    lacking = needed.join(best, "qid").join(found, ["qid", "table_id", "at"], "left_anti").select("qid").distinct()
    best = best.join(lacking, "qid", "left_anti").join(asked.select("qid", "kind", "words"), "qid").join(heads.select("table_id", "doc_id", "columns", "names", "counts"), "table_id")
    best = staged(best, "best-tables")

    # a named thing: the first specific word that names a cell, in the column of names if there; its cell in the count
    # column, or the number of its rows
    own = best.select("qid", "table_id", "kind", "names", "counts", F.posexplode("words").alias("at", "word"))
    specific = own.filter((F.col("kind") == "count") & ~F.col("word").isin(*lex.generic, *lex.units))
    hits = specific.join(values, "word").join(normal, ["table_id", "text"])
    order = F.struct("at", F.when(F.col("col") == F.col("names"), -1).otherwise(F.col("col")), "row_no")
    named = staged(hits.groupBy("qid", "table_id", "counts").agg(F.min_by(F.struct("col", "text"), order).alias("s")).select("qid", "table_id", "counts", "s.col", "s.text"), "subjects")
    rows = named.join(normal.drop("value"), ["table_id", "col", "text"]).groupBy("qid", "table_id", "counts", "text").agg(F.sum("n").alias("n"), F.min("row_no").alias("row_no"))
    one = cells.select("table_id", "row_no", F.col("col").alias("counts"), "value")
    told = rows.join(one, ["table_id", "row_no", "counts"], "left")
    number = F.when((F.col("n") == 1) & F.col("counts").isNotNull(), F.coalesce(F.nullif("value", F.lit("")), F.lit("1"))).otherwise(F.col("n").cast("string"))
    counts = told.select("qid", F.lit("count").alias("kind"), F.col("text").alias("subject"), F.concat("text", F.lit(" 数量: "), number).alias("answer"), "table_id", F.col("n").cast("int").alias("n_rows"))

    # no named thing: rows of one named sheet, else of all sheets of the best table's document
    open_ = best.filter("kind = 'count'").join(named.select("qid"), "qid", "left_anti").select("qid", F.col("doc_id").alias("anchor"))
    units = found.join(open_, "qid").filter(F.col("word").isin(*lex.units))
    unit = units.groupBy("qid").agg(F.min_by("word", "at").alias("u"))
    pool = units.join(unit, "qid").filter("word = u").select("qid", "anchor", "table_id", "u").join(heads.select("table_id", "doc_id", "section", F.col("n_rows").alias("rows")), "table_id").join(asked.select("qid", "words"), "qid")
    says = F.exists(F.filter("words", lambda x: (x != F.col("u")) & ~x.isin(*lex.containers)), lambda x: sheet_name(F.col("section")).contains(x))
    pool = staged(pool.withColumn("named", says).drop("words", "section"), "sheets")
    n_named = pool.groupBy("qid").agg(F.count_if("named").alias("n_named"))
    aim = pool.join(n_named, "qid").filter(F.when(F.col("n_named") == 1, F.col("named")).otherwise(F.col("doc_id") == F.col("anchor")))
    total = aim.groupBy("qid", F.col("u").alias("subject")).agg(F.sum("rows").cast("int").alias("n_rows"), F.min("table_id").alias("table_id"))
    totals = total.select("qid", F.lit("count").alias("kind"), "subject", F.concat("subject", F.lit(" 总数: "), "n_rows").alias("answer"), "table_id", "n_rows")

    # a list: the names, of rows with the first specific word that occurs among them
    lists = best.filter("kind = 'enum' AND names IS NOT NULL").select("qid", "table_id", "names", "columns", "words")
    listed = staged(lists.join(normal, "table_id").filter("col = names").select("qid", "table_id", "columns", "names", "words", "row_no", "text", "value", "n"), "listed")
    picks = F.filter("words", lambda x: (F.length(x) >= 3) & ~x.isin(*lex.generic) & F.contains("text", x))
    first = listed.select("qid", F.explode(F.transform(picks, lambda x: F.struct(F.array_position("words", x).alias("at"), x.alias("word")))).alias("p")).groupBy("qid").agg(F.min("p").alias("p"))
    chosen = listed.join(first.select("qid", F.col("p.word").alias("pick")), "qid", "left").filter(F.col("pick").isNull() | F.contains("text", "pick"))
    each = chosen.groupBy("qid", "table_id", F.get("columns", F.col("names")).alias("subject"), "pick", "value").agg(F.min("row_no").alias("row_no"), F.sum("n").alias("n"))
    values_ = F.transform(F.array_sort(F.collect_list(F.when(F.col("value") != "", F.struct("row_no", "value")))), lambda x: x["value"])  # the answer itself
    text = F.concat(F.when(F.col("pick").isNotNull(), F.concat("pick", F.lit(" 相关: "))).otherwise(""), F.array_join("names", lex.list_comma))
    enums = each.groupBy("qid", "table_id", "subject", "pick").agg(values_.alias("names"), F.sum("n").cast("int").alias("n_rows")).filter("size(names) > 0")
    enums = enums.select("qid", F.lit("enum").alias("kind"), "subject", text.alias("answer"), "table_id", "n_rows")
    told_once = counts.unionByName(totals).unionByName(enums)
    return told_once.withColumnRenamed("qid", "asked").join(every.select("qid", "asked"), "asked").select("qid", "kind", "subject", "answer", "table_id", "n_rows")


def answer_tables(questions: DataFrame, tables: DataFrame, lex: TableLexicon = DEFAULT) -> DataFrame:
    """answer_cells() for tables given as rows of arrays."""
    return answer_cells(questions, *as_cells(tables), lex)
