"""Structure, chunking and readers: literals and properties."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import chunking as C
from quillon.operators import structure as S
from quillon.sources import readers as R

BLOCKS = "doc_id long, idx int, text string, section string, page int, block_type string"


@pytest.mark.parametrize(("text", "level"), [("第三章 总则", 1), ("附录A", 1), ("3.2 引用标准", 2), ("1 总则", 1), ("8.2.3 应符合下列规定", 0), ("一、概述", 2), ("1 小时内报本级防办，不得延误", 0), ("普通文字", 0), ("", 0)])
def test_heading_level(spark, text, level):
    assert spark.createDataFrame([(text,)], "t string").select(S.heading_level(F.col("t")).alias("v")).first().v == level


def test_clause_gaps_and_siblings(spark):
    b = spark.createDataFrame([(1, 0, "8.2.1 甲\n8.2.2 乙\n8.2.4 丁", None, 12, "paragraph"), (1, 1, "2020.10.01", None, 1, "paragraph")], BLOCKS)
    assert [(r.section, r.present, r.missing, r.pages) for r in S.clause_gaps(b).collect()] == [("8.2", [1, 2, 4], [3], [12])]
    assert [r.number for r in S.missing_siblings(S.numbered_lines(b)).collect()] == ["8.2.3"]


def test_boilerplate(spark):
    rows = [(1, i, "页眉文字\n第一行水印\n正文内容" + str(i) + "\n页脚文字", None, i + 1, "paragraph") for i in range(10)] + [(1, 10, "页眉文字", None, 3, "paragraph"), (1, 11, "页眉文字", None, 4, "heading")]
    b = spark.createDataFrame(rows, BLOCKS)
    rep = S.repeated_lines(b)
    assert {r.key for r in rep.collect()} == {"页眉文字", "第一行水印", "页脚文字"}
    got = {r.idx: r.text for r in S.without_lines(b, rep).collect()}
    assert got == {i: f"正文内容{i}" for i in range(10)} | {11: "页眉文字"}


def test_quality(spark):
    q = spark.createDataFrame(
        [(1, 50, 0, 50, 8000, 0.0, 5, 0, None, None), (2, 50, 10, 40, 6000, 0.0, 5, 5000, 0.95, [0.95]), (3, 5, 0, 5, 100, 0.0, 0, 0, None, None)],
        "id int, pages int, ocr_pages int, text_pages int, total_chars int, garble_ratio double, tables int, table_chars int, mean_conf double, confidences array<double>",
    )
    got = {r.id: r for r in S.quality_score(q).collect()}
    assert got[1].score > 80 and not got[1].needs_review and got[2].needs_review and got[3].needs_review


def test_validation(spark):
    schema = "doc_id int, idx int, element_id string, type string, text string, page_start int, page_end int, bbox array<double>, reading_order int, heading_level int, table struct<rows:array<array<string>>,header_path:array<string>>, parent_id string"
    rows = [
        (1, 0, "a", "paragraph", "x", 1, 2, [0.0, 0.0, 1.0, 1.0], 0, None, None, None),
        (1, 1, "a", "paragraph", " ", 3, 2, [0.0, 0.0, 1.0], 5, 9, ([["1"]], ["h", "i"]), "zz"),
        (1, 2, "f", "figure", "", 0, None, None, 2, None, None, "a"),
    ]
    got = {(r.element_id, r.error) for r in S.validation_errors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "repeated id"), ("a", "empty text"), ("a", "pages reversed"), ("a", "bbox"), ("a", "reading order"), ("a", "heading level"), ("a", "table width"), ("a", "parent missing"), ("f", "page below 1")}


def test_markdown_and_text(spark):
    md = "# A\n\npara one\n## B\npara two\n# C\n### D\n### E\nlast"
    d = spark.createDataFrame([(1, md), (2, None)], "doc_id long, text string")
    got = [(r.text, r.section, r.block_type) for r in R.markdown_blocks(d).orderBy("idx").collect()]
    assert got == [("A", None, "heading"), ("para one", "A", "paragraph"), ("B", "A", "heading"), ("para two", "A/B", "paragraph"), ("C", None, "heading"), ("D", "C", "heading"), ("E", "C/D", "heading"), ("last", "C/D/E", "paragraph")]
    t = spark.createDataFrame([(1, "one\n two \n\n\n three\n")], "doc_id long, text string")
    assert [r.text for r in R.text_blocks(t).orderBy("idx").collect()] == ["one two", "three"]


def test_html_table_spans():
    html = "<table><tr><th>a</th><th colspan=2>b</th></tr><tr></tr><tr><td rowspan='2'>x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"
    assert R.html_table(html) == [["a", "b", "b"], ["x", "1", "2"], ["x", "3", "4"]] and R.html_table("") is None


def test_html_tables_in_pages(spark):
    p = spark.createDataFrame([(1, "<p>x</p><table><tr><td>h</td></tr><tr><td>v</td></tr></table>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.header_path, r.rows) for r in R.html_tables(p).collect()] == [(1, ["h"], [["h"], ["v"]])]


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f"<w:document {w}><w:body>{p('One', 'Heading1')}{p('text')}{p('Two', 'Heading 2')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    assert R.docx_parts(packed({"word/document.xml": doc})) == [("One", None, "heading"), ("text", "One", "paragraph"), ("Two", "One", "heading"), ("a | b", "One/Two", "table")]
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>h</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></sheetData></worksheet>',
    }
    assert R.xlsx_sheets(packed(book)) == [("S", [["h", "", "7"]])]


def test_uploads(spark):
    rows = [("a.pdf", b"%PDF-1.4"), ("b.pdf", b"nope"), ("c.txt", b"ok"), ("d.txt", b"a\0b"), ("e.docx", packed({"x": "y"})), ("f.xlsx", b"PK\x03\x04broken"), ("g.docx", b"")]
    got = {r.filename: r.problem for r in R.upload_problems(spark.createDataFrame(rows, "filename string, content binary")).collect()}
    assert got == {"a.pdf": None, "b.pdf": "CONTENT_MISMATCH", "c.txt": None, "d.txt": "BINARY_TEXT", "e.docx": None, "f.xlsx": "BAD_ZIP", "g.docx": "CONTENT_MISMATCH"}


def test_chunks_lose_no_line(spark):
    rows, i = [], 0
    for d in (1, 2):
        for s in range(4):
            rows.append((d, i, f"Section {s}", None, s + 1, "heading"))
            for k in range(9):
                i += 1
                rows.append((d, i, " ".join(f"word{d}{s}{k}{j}" for j in range(12)), f"Section {s}", s + 1, "table" if k == 5 else "paragraph"))
            i += 1
    b = spark.createDataFrame(rows, BLOCKS)
    for how in ("parent_child", "structure"):
        c = C.chunk_documents(b, how)
        checked = S.completeness(b, c).collect()
        assert len(checked) == 2 and all(r.missing_lines == 0 and r.uncovered_pages == [] for r in checked)
        assert all(r.content in r.parent_content or re.sub(r"^## .*\n", "", r.content) in r.parent_content for r in c.collect())
    stored = C.chunk_store_rows(C.chunk_documents(b)).collect()
    assert all(r.parent_index is None or any(p.chunk_index == r.parent_index and p.doc_id == r.doc_id and p.block_type == "parent" for p in stored) for r in stored)
    assert len({(r.doc_id, r.chunk_index) for r in stored}) == len(stored)


def test_splitting_and_merging():
    text = "。".join("字" * 30 for _ in range(20))
    parts = C.split_long(text, 100, 31)
    assert all(len(p) <= 100 for p in parts) and set("".join(parts)) == {"字", "。"} and len(parts) > 6
    assert C.split_long("a" * 250, 100) == ["a" * 100, "a" * 100, "a" * 50]
    got = C.merge_tiny([C.Block("## s\nab", "s"), C.Block("## s\n" + "c" * 50, "s", 2), C.Block("x", "t"), C.Block("y", "u")])
    assert [c.text for c in got] == ["## s\nab\n" + "c" * 50, "x", "y"]
    assert C.is_noise("## a / b\nb", "a / b") and C.is_noise("图1.2 (a)", None) and not C.is_noise("表1.2 参数", None)


def by_hand(rows):
    """place, last value so far and run of each row (key, i, value), in order."""
    out, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        place, filled, run = last.get(k, (-1, None, 0))
        if v is not None and v != filled:
            filled, run = v, run + 1
        last[k] = out[k, i] = place + 1, filled, run
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_cross_ranges(spark, seed):
    from quillon.staging import ordered_runs

    rng = random.Random(seed)
    rows = [(k, i, rng.choice([None, None, None, "a", "b"]) if n < 3000 else None if rng.random() < 0.999 else rng.choice("ab")) for k, n in ((1, 2500), (2, 1), (None, 2000), (3, 4000), (4, 5)) for i in range(n)]
    got = ordered_runs(spark.createDataFrame([(*r, "x") for r in rows], "k long, i long, v string, other string"), "k", ["i"], "v").collect()
    want = by_hand(rows)
    assert {(r.k, r.i): (r.place, r.filled) for r in got} == {k: w[:2] for k, w in want.items()}
    for k in (1, 2, None, 3, 4):  # runs are told apart just where they change, and grow
        own = sorted((r.i, r.run) for r in got if r.k == k)
        steps = [(b[1] - a[1] > 0, want[k, b[0]][2] != want[k, a[0]][2]) for a, b in zip(own, own[1:], strict=False)]
        assert all(a == b for a, b in steps) and all(b[1] >= a[1] for a, b in zip(own, own[1:], strict=False))


def test_a_long_document_is_chunked_as_by_one_fold(spark):
    rng = random.Random(5)
    rows = []
    for d, n in ((1, 3000), (2, 4), (None, 600)):
        section = None
        for i in range(n):
            section = rng.choice([section] * 30 + [f"s{rng.randrange(9)}", None, ""])
            rows.append((d, i, "w " * rng.choice([1, 20, 120]), section, i // 50, rng.choice(["paragraph"] * 8 + ["table", "heading", "soft_heading"])))
    df = spark.createDataFrame(rows, BLOCKS)
    made = C.chunk_documents(df.repartition(7))
    got = sorted(((r.doc_id or 0, r.chunk_index, r.content, r.parent_content, r.page) for r in made.collect()))
    want = []
    for d in (1, 2, None):
        own = [C.Block(t, s, p, k) for a, _, t, s, p, k in rows if a == d]
        want += [(d or 0, i, c.text, p, c.page) for i, (c, p) in enumerate(C.parent_child(own))]
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]


def test_token_counts_may_measure_chunks(spark):
    words = " ".join(f"w{i}" for i in range(90))
    df = spark.createDataFrame([(1, i, words, "s", 1, "paragraph") for i in range(12)], BLOCKS)
    tokens = C.chunk_documents(df, count=lambda t: len(t.split())).collect()
    assert all(len(r.content.split()) <= C.CHILD_MAX + 2 for r in tokens) and len(tokens) < len(C.chunk_documents(df).collect())


def test_a_section_is_folded_once_and_measured_in_proportion(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(text):
        calls.add(1)
        return len(text)

    n = 600
    df = spark.createDataFrame([(1, i, "x", "s", 1, "paragraph") for i in range(n)], BLOCKS)
    assert C.chunk_documents(df, count=count).count() > 1
    assert calls.value <= 3 * n


def test_lines_left_are_counted_where_they_are_removed(spark):
    rows = [(1, 0, "keep this\nfoot line\n\nkeep that", None, 1, "paragraph"), (1, 1, "foot  line\nfoot line", None, 2, "paragraph"), (1, 2, "foot line", None, 3, "heading"), (2, 0, "foot line\n\n ", None, 1, "paragraph"), (2, 1, None, None, 1, "heading")]
    removed = spark.createDataFrame([(1, "footline"), (1, "footline"), (3, "keepthis")], "doc_id long, key string")
    got = {(r.doc_id, r.idx): (r.n_lines, r.text) for r in S.without_lines(spark.createDataFrame(rows, BLOCKS), removed).collect()}
    assert got == {(1, 0): (3, "keep this\n\nkeep that"), (1, 2): (0, "foot line"), (2, 0): (3, "foot line"), (2, 1): (1, None)}
