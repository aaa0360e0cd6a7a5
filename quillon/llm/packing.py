"""Token ids in fixed-width bit-packed shards with random access.

Documents are range-partitioned by id, so shard k holds smaller ids than shard k+1 and ids ascend inside
a shard. A shard streams blocks of BLOCK_IDS ids, each id in the least number of bits that holds the
vocabulary, each block on a byte border; a footer has the byte offset of every block and, per document,
its id and the place of its first id. Any range of ids is read by seeking to its blocks and unpacking
them with numpy.

Shard: blocks | footer | footer length (u64) | magic. Footer: bits, block ids, ids, documents, blocks
(u64 each), block offsets (u64, blocks + 1), document starts (u64, documents + 1), document ids (i64),
null flags (u8). All little-endian.

Defined cases: a null text is the empty text (just the end id); null document ids come first; rows with
equal ids follow in order of their text's hash, in as many shards as they need; an empty table writes no shard. Other columns are not read, so their names may
clash; a text of any length is encoded in one task, its ids are written in blocks.
"""

from __future__ import annotations

import io
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary
from .common import SLICE_ROWS, new_path, store, table

MAGIC = b"FWBITS01"
BLOCK_IDS = 1 << 16
END_ID = 0
#: Pieces of text in each of a worker's two memo generations.
MEMO_PIECES = 300_000
#: Longer pieces are not kept: they seldom come again.
MEMO_CHARS = 24
#: White space right before a blank or newline: a cut between the two would not be safe.
_UNSAFE = re.compile(r"\s[ \n]")


class LibraryEncoder:
    """The tokenizers library behind a memo of pieces, which are cut before each blank and newline.

    The pre-tokenizer always cuts between a non-space and a blank or newline, so a text's encoding is that of
    its pieces one after another. Texts with white space before a blank or newline are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would only take memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        #: Bytes that each id stands for; in the byte alphabet a character is a byte.
        self.widths = np.zeros(self.size, np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.marks = {m: array("I", self.tokenizer.encode(m, add_special_tokens=False).ids).tobytes() for m in ",."}
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.memo) > MEMO_PIECES:
            self.memo, self.older = {}, self.memo
        whole = [i for i, t in enumerate(texts) if _UNSAFE.search(t)]
        first, keys, ends = [], [], []
        for t in texts if not whole else ["" if _UNSAFE.search(t) else t for t in texts]:
            cut = t.replace("\n", " \n").split(" ")  # a newline's piece has the newline, a blank's has not the blank
            first.append(cut[0])
            keys += cut[1:]
            ends.append(len(keys))
        codes = list(map(self.memo.get, keys))
        missed = [i for i, c in enumerate(codes) if c is None]
        new = {keys[i] for i in missed}
        if self.older:
            known = [k for k in new if k in self.older]
            self.memo.update((k, self.older[k]) for k in known)
            new.difference_update(known)
        # a letter and the comma or full stop at the piece's end are always two pre-tokens
        ended = [k for k in new if k[-1:] in self.marks and k[-2:-1].isalpha()]
        new.difference_update(ended)
        self._learn(list(new.union(b for b in {k[:-1] for k in ended} if b not in self.memo)))
        self.memo.update((k, self.memo[k[:-1]] + self.marks[k[-1]]) for k in ended)
        new.update(ended, (k[:-1] for k in ended if len(k) > MEMO_CHARS + 1))
        for i in missed:
            codes[i] = self.memo[keys[i]]
        heads = self.tokenizer.encode_batch_fast(first, add_special_tokens=False)
        out = [array("I", h.ids).tobytes() + b"".join(codes[a:b]) for h, a, b in zip(heads, [0, *ends], ends, strict=False)]
        for i, c in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = array("I", c.ids).tobytes()
        for k in new:
            if len(k) > MEMO_CHARS:
                del self.memo[k]
        return out

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces into the memo. Those that end with no white space may stand side by side in one text,
        which costs the library less; their ids are told apart by the bytes they stand for."""
        pieces = [k if k[:1] == "\n" else " " + k for k in new]
        apart = [i for i, p in enumerate(pieces) if p[-1].isspace() or len(p) > 64]
        for i, c in zip(apart, self.tokenizer.encode_batch_fast([pieces[i] for i in apart], add_special_tokens=False), strict=True):
            self.memo[new[i]] = array("I", c.ids).tobytes()
        side = [i for i, p in enumerate(pieces) if not p[-1].isspace() and len(p) <= 64]
        if side:
            text = [pieces[i] for i in side]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(text)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in text])
            done = np.cumsum(self.widths[ids])
            at = np.searchsorted(done, ends) + 1
            if not (done[at - 1] == ends).all():
                raise ValueError("a token spans two pieces")
            raw, cuts = ids.tobytes(), (4 * np.concatenate([[0], at])).tolist()
            self.memo.update(zip([new[i] for i in side], [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    return _ENCODERS.get(path) or _ENCODERS.setdefault(path, LibraryEncoder(path))


def width_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a packed block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class ShardWriter:
    """Streams ids to ``out``; holds one block and 17 bytes for each document."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held, self.n_held, self.n, self.at = [], 0, 0, 0
        self.offsets, self.starts, self.ids, self.nulls = array("Q", [0]), array("Q", [0]), array("q"), array("B")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        self.starts.append(self.n)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        if self.n_held >= self.block_ids:
            self._drain(self.block_ids)

    def _drain(self, least: int) -> None:
        ids, at = np.concatenate(self.held) if self.held else np.empty(0, np.uint32), 0
        while len(ids) - at >= least and at < len(ids):
            raw = pack(ids[at : at + self.block_ids], self.bits)
            self.out.write(raw)
            self.at += len(raw)
            self.offsets.append(self.at)
            at += self.block_ids
        self.held = [ids[at:]] if at < len(ids) else []
        self.n_held = max(0, len(ids) - at)

    def close(self) -> None:
        self._drain(1)
        head = np.array([self.bits, self.block_ids, self.n, len(self.ids), len(self.offsets) - 1], "<u8").tobytes()
        foot = head + b"".join(np.array(x, kind).tobytes() for x, kind in ((self.offsets, "<u8"), (self.starts, "<u8"), (self.ids, "<i8"), (self.nulls, "u1")))
        self.out.write(foot + np.array([len(foot)], "<u8").tobytes() + MAGIC)


class ShardReader:
    """Random access to a shard through a seekable file."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard")
        n = int(np.frombuffer(tail[:8], "<u8")[0])
        file.seek(end - 16 - n)
        foot = file.read(n)
        self.bits, self.block_ids, self.n, self.n_docs, n_blocks = (int(x) for x in np.frombuffer(foot, "<u8", 5))
        self.offsets = np.frombuffer(foot, "<u8", n_blocks + 1, 40)
        at = 40 + 8 * (n_blocks + 1)
        self.starts = np.frombuffer(foot, "<u8", self.n_docs + 1, at)
        self.doc_ids = np.frombuffer(foot, "<i8", self.n_docs, at + 8 * (self.n_docs + 1))
        self.nulls = np.frombuffer(foot, "u1", self.n_docs, at + 8 * (self.n_docs + 1) + 8 * self.n_docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at places start to stop of the shard."""
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        out = []
        self.file.seek(int(self.offsets[first]))
        for b in range(first, last + 1):
            raw = self.file.read(int(self.offsets[b + 1] - self.offsets[b]))
            out.append(unpack(raw, self.bits, min(self.block_ids, self.n - b * self.block_ids)))
        return np.concatenate(out)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the shard, ids) in order; about ``span`` ids are unpacked at a time."""
        d = 0
        while d < self.n_docs:
            e = max(d + 1, int(np.searchsorted(self.starts, int(self.starts[d]) + span)) - 1)
            e = min(e, self.n_docs)
            base = int(self.starts[d])
            ids = self.ids(base, int(self.starts[e]))
            for k in range(d, e):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield None if self.nulls[k] else int(self.doc_ids[k]), a, ids[a - base : b - base]
            d = e


def write_shards(documents: DataFrame, directory: str, vocabulary: str, block_ids: int = BLOCK_IDS, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents; returns a stored manifest (shard, path, n_ids). Documents of equal or null id are dealt to
    shards by the hash of their text, so such an id may hold any share of the rows; only rows equal in both stay together."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))  # the text itself would be in the sample that ranges are cut from
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, enc = TaskContext.get(), encoder(vocabulary)
        fs, root = pafs.FileSystem.from_uri(directory)
        final = f"{root}/shard-{ctx.partitionId():06d}.bits"
        temp = f"{final}.{ctx.taskAttemptId()}.tmp"
        end = np.array([end_id], np.uint32)
        with fs.open_output_stream(temp, compression=None) as out:
            writer = ShardWriter(out, width_for(enc.size), block_ids)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    for doc_id, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                        writer.add(doc_id, np.concatenate([np.frombuffer(ids, np.uint32), end]))
            writer.close()
        if writer.n:
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([ctx.partitionId()], pa.int64()), "path": [final], "n_ids": pa.array([writer.n], pa.int64())})
        else:
            fs.delete_file(temp)

    fs, root = pafs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    return store(ordered.mapInArrow(run, "shard long, path string, n_ids long"), "shards")


def read_shards(manifest: DataFrame, directory: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards' bytes."""
    spark = manifest.sparkSession
    based, base = [], 0
    for shard in manifest.orderBy("shard").collect():  # a row for each shard
        based.append((shard.path, base))
        base += shard.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(directory)
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as file:
                    rows = [(k, base + a, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())) for k, a, ids in ShardReader(file).documents()]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    paths = spark.createDataFrame(based, "path string, base long")
    return paths.repartition(max(1, len(based))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    directory = new_path(spark, "bits")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), directory, default_vocabulary()), directory)
