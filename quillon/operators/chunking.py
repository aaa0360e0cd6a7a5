"""Chunks from blocks: ordered folds inside a document, documents in parallel.

Parents and children are folded section by section: a document is cut where the fold's state is reset anyway, at a
change of section, and chunks are numbered afterwards from one narrow row a section, so a document of any length is in many tasks, and what one
task holds is a section. Chunks by structure are folded document by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, strip
from ..staging import fold_groups, ordered_runs, small, staged

CHILD_MIN, CHILD_MAX, PARENT_MAX = 200, 500, 1600
#: Where long text is cut, best first.
SEPARATORS = ["\n\n", "\n", "。", "；", "，", " ", ""]
#: A text with three characters that are neither white space nor brackets.
THREE_MARKS = re.compile(r"(?:[\s()\[\]（）]*[^\s()\[\]（）]){3}")
CHUNK_SCHEMA = "doc_id long, chunk_index int, content string, section string, page int, block_type string, content_hash string, parent_content string, parent_hash string, table_data struct<table_id:string,columns:array<string>,rows:array<array<string>>,row_index:int>"


def digest(text: str) -> str:
    return hashlib.sha256("".join(text.split()).encode()).hexdigest()


def prefixed(section: str | None, text: str) -> str:
    return f"## {section}\n{text}" if section else text


@dataclass
class Block:
    text: str
    section: str | None = None
    page: int | None = None
    kind: str = "paragraph"
    table_id: str | None = None
    table: dict | None = None  # rows and header_path of a block; of a chunk what table_data() gives


def split_long(text: str, size: int, overlap: int = 0, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters where a separator allows: the first separator present cuts, small pieces are
    packed with up to ``overlap`` characters of the one before, large ones are cut by the next separators."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    atoms = list(text) if sep == "" else [a + (sep if i < text.count(sep) else "") for i, a in enumerate(text.split(sep))]
    out: list[str] = []
    pack: list[str] = []

    def flush() -> None:
        if pack:
            out.append("".join(pack))

    for a in (a for a in atoms if a):
        if len(a) > size and rest:
            flush()
            pack.clear()
            out.extend(split_long(a, size, overlap, rest))
            continue
        if pack and sum(map(len, pack)) + len(a) > size:
            flush()
            while pack and (sum(map(len, pack)) > overlap or sum(map(len, pack)) + len(a) > size):
                pack.pop(0)
        pack.append(a)
    flush()
    return [p.strip() for p in out if p.strip()]


def structure_chunks(blocks: list[Block], size: int = 512, overlap: int = 50, levels: dict[int, int] | None = None) -> list[Block]:
    """Headings and page ends break hard, soft headings start a group, tables and figures stand alone; up to 1.5 times
    ``size`` is not cut. Headings without a path of their own are stacked by ``levels`` (place to level)."""
    own_paths = any(b.section for b in blocks if b.kind == "heading") or (not any(b.kind == "heading" for b in blocks) and any(b.section for b in blocks))
    out: list[Block] = []
    held: list[list[Block]] = []  # groups; a soft heading begins a new one
    stack: list[str] = []
    section: str | None = None

    def emit(text: str, page: int | None, kind: str) -> None:
        whole = prefixed(section, text)
        for t in [whole] if len(whole) <= 1.5 * size else [prefixed(section, p) for p in split_long(text, size, overlap)]:
            out.append(Block(t, section, page, kind))

    def flush() -> None:
        groups: list[list[str]] = []
        for g in held:
            texts = [b.text for b in g]
            if groups and len("\n".join(groups[-1] + texts)) <= 1.5 * size:
                groups[-1] += texts
            else:
                groups.append(texts)
        page = held[0][0].page if held else None
        for g in groups:
            if text := "\n".join(g).strip():
                emit(text, page, "text")
        held.clear()

    last_page: int | None = None
    for i, b in enumerate(blocks):
        page = b.page or last_page
        if b.kind == "heading":
            flush()
            last_page = b.page
            if not own_paths:
                level = (levels or {}).get(i) or len(stack) + 1
                stack = [*stack[: level - 1], b.text.strip()]
                section = " / ".join(stack)
            continue
        if own_paths and b.kind != "soft_heading" and b.section and b.section != section:
            flush()
            section = b.section
        if b.kind in ("table", "figure"):
            flush()
            emit(b.text, page, b.kind)
            continue
        if held and held[0][0].page != page:
            flush()
        last_page = page
        item = Block(b.text, section, page, b.kind)
        if b.kind == "soft_heading" or not held:
            held.append([item])
        else:
            held[-1].append(item)
        if sum(len(x.text) for g in held for x in g) >= size:
            flush()
    flush()
    return out


def merge_tiny(chunks: list[Block], least: int = 40) -> list[Block]:
    """A chunk shorter than ``least`` joins the next of its section; figures never do."""
    out: list[Block] = []
    for c in chunks:
        if out and out[-1].kind != "figure" and c.kind != "figure" and len(out[-1].text) < least and out[-1].section == c.section:
            p = out.pop()
            bare = lambda x: x.text.removeprefix(prefixed(x.section, ""))
            c = Block(prefixed(c.section, f"{bare(p)}\n{bare(c)}"), c.section, c.page or p.page, "table" if "table" in (c.kind, p.kind) else "text")
        out.append(c)
    return out


def is_noise(content: str, section: str | None) -> bool:
    """Nothing but the section's own title, or labels of figures."""
    body = content.split("\n", 1)[-1].strip()
    if not body or (section and body == section.split("/")[-1].strip()):
        return True
    bare = re.sub(r"图\d+(?:\.\d+)*", "", body) if "图" in body else body
    bare = re.sub(r"(?m)^\(\w\)\s*$", "", bare) if "(" in bare else bare
    return THREE_MARKS.match(bare) is None


def table_data(pack: list[Block]) -> dict | None:
    """What the table channel reads of a chunk: its table, less the header row, if the chunk is one table and nothing else."""
    found = {b.table_id: b.table for b in pack if b.table_id and b.table}
    if len(found) != 1 or any(b.kind != "table" for b in pack):
        return None
    ((table_id, table),) = found.items()
    columns, rows = table.get("header_path") or [], table.get("rows") or []
    return {"table_id": table_id, "columns": columns, "rows": rows[1:] if columns and rows[:1] == [columns] else rows, "row_index": 0}


def parent_child(blocks: list[Block], count=len) -> Iterator[tuple[Block, str]]:
    """Children (packed to CHILD_MAX tokens, flushed only from CHILD_MIN on, tables apart) with their parent's text: the
    section, or stretches of its children up to PARENT_MAX."""
    groups: list[list[Block]] = []
    for b in (b for b in blocks if b.kind != "heading"):
        section = b.section or (groups[-1][0].section if groups else None)
        if groups and groups[-1][0].section == section:
            groups[-1].append(b)
        else:
            groups.append([b if b.section == section else replace(b, section=section)])
    for group in groups:
        section, children = group[0].section, []
        pack: list[Block] = []
        size = 0
        for atom in group:
            more = count(atom.text)
            apart = pack and (pack[0].kind == "table") != (atom.kind == "table")
            if pack and (apart or (size + more > CHILD_MAX and size >= CHILD_MIN)):
                children.append(pack)
                pack, size = [], 0
            pack.append(atom)
            size += more
        if pack:
            children.append(pack)
        texts = ["\n".join(b.text for b in c) for c in children]
        parents, fits, size = [], count("\n".join(b.text for b in group)) <= PARENT_MAX, 0
        for t in texts:
            more = count(t)
            if parents and (fits or size + more <= PARENT_MAX):
                parents[-1].append(t)
                size += more
            else:
                parents.append([t])
                size = more
        wholes = (whole for p in parents for whole in [prefixed(section, "\n".join(p))] * len(p))
        for pack, text, whole in zip(children, texts, wholes, strict=True):
            kind = "table" if all(b.kind == "table" for b in pack) else "text"
            page = next((b.page for b in pack if b.page), None)
            child = Block(prefixed(section, text), section, page, kind, table=table_data(pack))
            if not is_noise(child.text, section):
                yield child, whole


def chunk_documents(blocks: DataFrame, how: str = "parent_child", count=len) -> DataFrame:
    """Chunks of blocks (doc_id, idx, text, section, page, block_type and, if known, table_id and table of rows and
    header_path) by document, as CHUNK_SCHEMA. ``count`` measures a text; a tokenizer's count may take the place of
    characters."""
    known = [c for c in ("doc_id", "idx", "text", "section", "page", "block_type", "table_id", "table") if c in blocks.columns]

    def row_of(r: dict) -> Block:
        return Block(r["text"] or "", r["section"], r["page"], r["block_type"], r.get("table_id"), r.get("table"))

    def by_document(rows: list[dict]) -> list[tuple]:
        chunks = merge_tiny(structure_chunks([row_of(r) for r in rows]))
        return [(rows[0]["doc_id"], i, c.text, c.section, c.page, c.kind, digest(c.text), c.text, digest(c.text), None) for i, c in enumerate(chunks)]

    def by_section(rows: list[dict]) -> list[tuple]:
        out, last, hashed = [], None, ""
        for i, (c, p) in enumerate(parent_child([row_of({**r, "section": r["filled"]}) for r in rows], count)):
            if p != last:
                last, hashed = p, digest(p)
            out.append((rows[0]["doc_id"], i, c.text, c.section, c.page, c.kind, digest(c.text), p, hashed, c.table, rows[0]["run"]))
        return out

    given = blocks.select(*known)
    if how != "parent_child":
        return fold_groups(given, "doc_id", "idx", by_document, CHUNK_SCHEMA)
    # an empty section is none, as is a null one
    told = given.filter("block_type <> 'heading' OR block_type IS NULL").withColumn("section", F.nullif("section", F.lit("")))
    runs = ordered_runs(told, "doc_id", ["idx"], "section", "sections").withColumn("unit", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run"))
    made = staged(fold_groups(runs, "unit", "idx", by_section, f"{CHUNK_SCHEMA}, stretch long"), "chunks")
    # a section's chunks follow those of the sections before it: one narrow row a section is summed, and only later sections move
    sizes = made.groupBy(F.col("doc_id").alias("_doc"), F.col("stretch").alias("_stretch")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("_doc").orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    later = staged(sizes.withColumn("_before", before).filter("_before > 0").drop("n"), "chunks-before")
    moved = made.join(small(later), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("stretch") == F.col("_stretch")), "left")
    number = (F.col("chunk_index") + F.coalesce("_before", F.lit(0))).cast("int")
    return moved.withColumn("chunk_index", number).select(*(c for c in made.columns if c != "stretch"))


def contents_chunks(pages: DataFrame, title: str = "目录") -> DataFrame:
    """doc_id, page, section, content, content_hash: each page of contents (doc_id, page, text) with text as a chunk of its own."""
    body = strip(F.coalesce("text", F.lit("")))
    content = F.concat(F.lit(f"## {title}\n"), body)
    return pages.filter(body != "").select("doc_id", "page", F.lit(title).alias("section"), content.alias("content"), content_hash(content).alias("content_hash"))


def chunk_tables(chunks: DataFrame) -> DataFrame:
    """Slices of the tables that chunks carry, as tables.assemble() takes them; names hold within a document only."""
    t = F.col("table_data")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(":"), t["table_id"])
    return chunks.filter("table_data IS NOT NULL").select(name.alias("table_id"), t["row_index"].alias("row_index"), t["columns"].alias("columns"), t["rows"].alias("rows"), "section", "source", "doc_id", "kb")


def chunk_store_rows(chunks: DataFrame) -> DataFrame:
    """Rows as they are stored: parents once per document and hash, numbered first, then children with parent_index."""
    parents = chunks.groupBy("doc_id", "parent_hash").agg(F.min("chunk_index").alias("first"), F.min_by("parent_content", "chunk_index").alias("content"), F.min_by("section", "chunk_index").alias("section"))
    parents = parents.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("first")) - 1)
    n = parents.groupBy("doc_id").agg(F.count("*").alias("n_parents"))
    at = parents.select("doc_id", "parent_hash", F.col("chunk_index").alias("parent_index"))
    children = chunks.join(at, ["doc_id", "parent_hash"]).join(n, "doc_id")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1 + F.col("n_parents")
    children = children.select("doc_id", place.cast("int").alias("new_index"), "content", "section", "parent_index", F.col("block_type")).withColumnRenamed("new_index", "chunk_index")
    return parents.select("doc_id", "chunk_index", "content", "section", F.lit(None).cast("int").alias("parent_index"), F.lit("parent").alias("block_type")).unionByName(children)
