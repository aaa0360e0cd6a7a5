"""Readers: markdown, plain text, CSV, DOCX, spreadsheets, HTML tables, layout output; upload checks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import iso_date_cell, strip

READERS = {"md": "markdown", "markdown": "markdown", "txt": "text", "csv": "csv", "docx": "docx", "xlsx": "excel", "xls": "excel", "pdf": "pdf"}


def reader_for(filename: Column) -> Column:
    """Name of the reader of a file, by its extension; null if there is none."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    return F.create_map(*(F.lit(x) for kv in READERS.items() for x in kv))[ext]


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text, else as GBK."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "GBK"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def markdown_blocks(documents: DataFrame) -> DataFrame:
    """doc_id, idx, text, section, block_type of markdown (doc_id, text). A heading cuts the stack of titles only where
    the stack is that deep; otherwise it is appended, so titles after a skipped level nest."""
    schema = f"doc_id {dict(documents.dtypes)['doc_id']}, idx int, text string, section string, block_type string"
    kinds = to_arrow_schema(documents.sparkSession.createDataFrame([], schema).schema)
    heading = re.compile(r"(#{1,6})\s+(.+)")

    def blocks(doc_id: object, text: str | None) -> Iterator[tuple]:
        stack: list[str] = []
        lines = (x.strip() for x in re.split(r"\r\n|\r|\n", text or ""))
        for idx, line in enumerate(x for x in lines if x):
            if m := heading.fullmatch(line):
                title = m[2].strip()
                if len(stack) >= len(m[1]):
                    stack = stack[: len(m[1]) - 1]
                yield doc_id, idx, title, "/".join(stack) or None, "heading"
                stack = [*stack, title]
            else:
                yield doc_id, idx, line, "/".join(stack) or None, "paragraph"

    return _streamed(documents.select("doc_id", "text"), lambda row: blocks(*row), schema, kinds)


def _streamed(rows: DataFrame, fn: Callable[[tuple], Iterable[tuple]], schema: str, kinds: pa.Schema, size: int = 4096) -> DataFrame:
    """What ``fn`` makes of each row, in batches of at most ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = chain.from_iterable(fn(tuple(c[i].as_py() for c in batch.columns)) for i in range(batch.num_rows))
            while part := list(islice(made, size)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)


def text_blocks(documents: DataFrame) -> DataFrame:
    """Paragraphs of plain text: blank lines part them, their lines are joined by blanks."""
    joined = lambda p: F.array_join(F.filter(F.transform(F.split(p, r"\r\n|\r|\n"), strip), lambda x: x != ""), " ")
    paras = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n"), joined), lambda p: p != "")
    return documents.select("doc_id", F.posexplode(paras).alias("idx", "text")).select("doc_id", "idx", "text", F.lit(None).cast("string").alias("section"), F.lit("paragraph").alias("block_type"))


def csv_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Each row of CSV files as a line of cells; no row is a header, blank rows go."""
    rows = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"').withColumn("file", F.input_file_name())
    cells = [iso_date_cell(F.col(c)) for c in rows.columns if c != "file"]
    line = F.array_join(F.array(*cells), " | ")
    return rows.select("file", line.alias("text"), F.lit("table").alias("block_type")).filter(F.regexp_replace("text", r"[ |]", "") != "")


def table_struct(header: Column, rows: Column) -> Column:
    """{rows, header_path} of a sheet, cells in normal form."""
    clean = lambda r: F.transform(r, iso_date_cell)
    return F.struct(F.concat(F.array(clean(header)), F.transform(rows, clean)).alias("rows"), clean(header).alias("header_path"))


# -- files that Spark has no reader for ---------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_parts(content: bytes) -> list[tuple[str, str | None, str]]:
    """(text, section, block_type) of a DOCX body: styled headings make the path, table rows are lines of cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str | None, str]] = []
    stack: list[str] = []
    text_of = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body:
        if e.tag == f"{_W}p" and (text := text_of(e).strip()):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            level = re.search(r"(?i)^(?:heading|标题)\s*(\d)", style.get(f"{_W}val", "") if style is not None else "")
            if level:
                n = int(level[1])
                stack = [*(stack[: n - 1] if len(stack) >= n else stack), text]
                out.append((text, "/".join(stack[:-1]) or None, "heading"))
            else:
                out.append((text, "/".join(stack) or None, "paragraph"))
        elif e.tag == f"{_W}tbl":
            for row in e.iter(f"{_W}tr"):
                out.append((" | ".join(text_of(c).strip() for c in row.iter(f"{_W}tc")), "/".join(stack) or None, "table"))
    return out


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cell texts) of an XLSX file, from its XML."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
            target = targets[sheet.get(rel)].lstrip("/")
            grid: list[list[str]] = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{ns}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{ns}c"):
                    col = 0
                    for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                        col = col * 26 + ord(ch) - 64
                    v = c.find(f"{ns}v")
                    cells[col - 1] = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), grid))
    return out


def html_table(html: str | None) -> list[list[str]] | None:
    """Grid of an HTML table with spans filled; rows without text go; None without rows. Row 0 is the header."""
    rows = re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html or "")
    grid: dict[tuple[int, int], str] = {}
    for r, raw in enumerate(rows):
        c = 0
        for m in re.finditer(r"(?is)<(td|th)\b([^>]*)>(.*?)</\1>", raw):
            while (r, c) in grid:
                c += 1
            span = {k.lower(): int(n) for k, n in re.findall(r"(?i)(rowspan|colspan)\s*=\s*[\"']?(\d+)", m[2])}
            text = re.sub(r"<[^>]+>", "", m[3]).strip()
            for i in range(span.get("rowspan", 1)):
                for j in range(span.get("colspan", 1)):
                    grid[r + i, c + j] = text
            c += span.get("colspan", 1)
    full = []
    for r in range(max((k[0] for k in grid), default=-1) + 1):
        width = max((k[1] for k in grid if k[0] == r), default=-1) + 1
        full.append([grid.get((r, i), "") for i in range(width)])
    full = [row for row in full if any(row)]
    return full or None


def html_tables(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, table_no, header_path, rows of each table in the HTML of pages."""
    schema = f"page_id {dict(pages.dtypes)['page_id']}, table_no int, header_path array<string>, rows array<array<string>>"
    kinds = to_arrow_schema(pages.sparkSession.createDataFrame([], schema).schema)

    def grids(row: tuple) -> Iterator[tuple]:
        page_id, html = row
        for i, t in enumerate(re.findall(r"(?is)<table\b.*?</table>", html or "")):
            if grid := html_table(t):
                yield page_id, i, grid[0], grid

    return _streamed(pages.select("page_id", column), grids, schema, kinds)


def read_docx(files: DataFrame) -> DataFrame:
    """path, idx, text, section, block_type of DOCX files (path, content)."""
    schema = "path string, idx int, text string, section string, block_type string"
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    return _streamed(files.select("path", "content"), lambda row: ((row[0], i, *part) for i, part in enumerate(docx_parts(row[1]))), schema, kinds)


def read_xlsx(files: DataFrame) -> DataFrame:
    """path, sheet, header_path, rows of the sheets with a row in XLSX files (path, content), cells in normal form."""
    schema = "path string, sheet string, grid array<array<string>>"
    kinds = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    raw = _streamed(files.select("path", "content"), lambda row: ((row[0], name, grid) for name, grid in xlsx_sheets(row[1])), schema, kinds)
    table = table_struct(F.get("grid", F.lit(0)), F.slice("grid", F.lit(2), F.greatest(F.size("grid") - 1, F.lit(0))))
    return raw.filter("size(grid) > 0").withColumn("table", table).select("path", "sheet", "table.header_path", "table.rows")


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, idx, text, block_type of the visible paragraphs and headings of raw pages, by built-in expressions."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style|nav|head)\b.*?</\1>|<!--.*?-->", " ")
    cut = F.split(F.regexp_replace(bare, r"(?i)<(h[1-6]|p|li|div|br|article|ul|ol)\b[^>]*>|</(h[1-6]|p|li|div|article)>", "\n"), "\n")
    clean = F.filter(F.transform(cut, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))), lambda x: x != "")
    return pages.select("page_id", F.posexplode(clean).alias("idx", "text")).withColumn("block_type", F.lit("paragraph"))


# -- upload checks ------------------------------------------------------------------------------------

MAX_UNPACKED, MAX_RATIO = 200 * 1024 * 1024, 500


def zip_problem(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
    except zipfile.BadZipFile:
        return "BAD_ZIP"
    if sum(i.file_size for i in infos) > MAX_UNPACKED or any(i.compress_size and i.file_size > i.compress_size * MAX_RATIO for i in infos):
        return "ZIP_BOMB"
    return None


def upload_problems(files: DataFrame) -> DataFrame:
    """Files (filename, content) with problem: a false signature, a NUL in the first 4096 bytes of text, a bad or oversized
    archive, or null."""

    @F.pandas_udf("string")
    def zipped(content):
        return content.map(lambda c: None if c is None else zip_problem(bytes(c)))

    ext = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    wrong = ((ext == "pdf") & (head != "25504446")) | (ext.isin("docx", "xlsx") & (head != "504B0304"))
    binary = ext.isin("md", "markdown", "txt", "csv") & F.hex(F.substring("content", 1, 4096)).rlike("^(..)*?00")
    return files.withColumn("problem", F.when(wrong, "CONTENT_MISMATCH").when(binary, "BINARY_TEXT").when(ext.isin("docx", "xlsx"), zipped("content")))
