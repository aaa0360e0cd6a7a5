"""Byte-level BPE encoding of whole texts by tree concatenation, and decoding.

A long text is cut in halves again and again down to leaves of LEAF_CHARS, which are encoded
independently; then neighbours are joined bottom-up. The upper levels of the tree are rows: a text of more
than PART_CHARS is cut into parts that different tasks encode, and FAN neighbours meet in one task, level
by level, until one row is left. A join re-encodes a window around the cut and grows
it until the window's first and last token equal the tokens that stand there already.

Why that is exact. (1) Inside one pre-token a sequence of tokens is the BPE encoding if and only if each
adjacent pair is, so agreement on one token on each side leaves only pairs known to be right. (2) The
pre-tokenizer always cuts between a character that is not white space and a following blank or newline,
and never inside a run of letters, whatever stands farther away; a window's edges must lie at such
places, otherwise it keeps growing.

Defined cases: a null text is the empty text (no ids, decodes to the empty text); the text of a special
token is that token, as the library has it, and is never cut; repeated rows are encoded one by one. An empty table gives no
rows; other columns are not read, so their names may clash; long texts are parts that several tasks encode.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import map_rows, store, table

LEAF_CHARS, PART_CHARS, FAN = 4096, 1 << 15, 8
#: Fixed value: the pattern that cuts text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file; made once per Python worker.

    Leaves go through a byte-pair encoder built from the file's own vocabulary. It merges by token id, so
    the file must list its merges in id order, which is checked."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        import tiktoken

        self.leaf_chars = leaf_chars
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        merged = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if merged != sorted(merged):
            raise ValueError("merges are not in the order of their ids")
        self.size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        ranks = {self.bytes_of[i]: i for token, i in vocab.items() if token not in special}
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.coder = tiktoken.Encoding(path, pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.special = special
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in special) + ")") if special else None

    def leaf(self, text: str) -> np.ndarray:
        """Ids of a text encoded in one go."""
        if self.at_special and self.at_special.search(text):
            parts = [[self.special[p]] if p in self.special else self.coder.encode_ordinary(p) for p in self.at_special.split(text) if p]
            return np.fromiter(chain.from_iterable(parts), np.uint32)
        return self.coder.encode_to_numpy(text)

    # -- tree -------------------------------------------------------------------------------------
    def cuts(self, text: str, most: int | None = None) -> list[str]:
        """Leaves (of at most ``most`` characters) of the tree of halves, in order; a cut that would split a special
        token moves behind it."""
        most = most or self.leaf_chars
        parts, todo = [], [(0, len(text))]
        while todo:
            a, b = todo.pop()
            m = (a + b) // 2
            for s in self.special:
                at = text.rfind(s, max(a, m - len(s) + 1), m + len(s))
                if 0 <= at < m < at + len(s):
                    m = at + len(s)
            if b - a <= most or not a < m < b:
                parts.append(text[a:b])
            else:
                todo += [(m, b), (a, m)]
        return parts

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text: leaves first, then joins of neighbours, level by level."""
        return self.joined([(p, self.leaf(p)) for p in self.cuts(text or "")])[1]

    def joined(self, level: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        """Text and ids of neighbours (text, ids) as one."""
        while len(level) > 1:
            level = [self.join(*level[i], *level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> tuple[str, np.ndarray]:
        """Text and ids of ``left + right`` from the ids of both."""
        whole = left + right
        if not len(a) or not len(b):
            return whole, a if len(a) else b
        width = self.bytes_of
        i = j = 4
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            tail = b"".join([width[t] for t in a[len(a) - i :].tolist()])
            head = b"".join([width[t] for t in b[:j].tolist()])
            start = self._edge(left, tail, True) if i < len(a) else 0
            stop = self._edge(right, head, False) if j < len(b) else len(right)
            if start is not None and stop is not None:
                window = self.leaf(left[start:] + right[:stop])
                if (i == len(a) or window[0] == a[len(a) - i]) and (j == len(b) or window[-1] == b[j - 1]):
                    return whole, np.concatenate([a[: len(a) - i], window, b[j:]])
            if start is None:
                i += 1 if i < 64 else i
            elif stop is None:
                j += 1 if j < 64 else j
            else:
                i, j = 2 * i, 2 * j

    @staticmethod
    def _edge(text: str, piece: bytes, at_end: bool) -> int | None:
        """Where the window made of ``piece`` begins (or ends) in ``text``, if a window may do so there."""
        try:
            n = len(piece.decode("utf-8"))
        except UnicodeDecodeError:
            return None  # inside a character
        p = len(text) - n if at_end else n
        before, after = text[p - 1], text[p]
        return p if (not before.isspace() and after in " \n") or (before.isalpha() and after.isalpha()) else None

    # -- decoding ---------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[t] for t in ids.tolist()]).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, leaf_chars: int = LEAF_CHARS) -> Codec:
    """This worker's codec of the file."""
    return _CODECS.get((path, leaf_chars)) or _CODECS.setdefault((path, leaf_chars), Codec(path, leaf_chars))


def id_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4", copy=False).tobytes()


def encoded(documents: DataFrame, vocabulary: str, fn: Callable[[Codec, int | None, np.ndarray], tuple], schema: str, leaf_chars: int = LEAF_CHARS, part_chars: int = PART_CHARS, fan: int = FAN) -> DataFrame:
    """A row ``fn(codec, doc_id, ids)`` for every document."""
    rows = documents.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    size = F.length(F.coalesce("text", F.lit("")))

    def whole(part: list[tuple]) -> list[tuple]:
        c = codec(vocabulary, leaf_chars)
        return [fn(c, k, c.encode(t)) for k, t in part]

    short = map_rows(rows.filter(size <= part_chars), whole, schema)
    long = rows.filter(size > part_chars)
    if not long.limit(1).count():
        return short

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row = codec(vocabulary, leaf_chars), TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                parts = c.cuts(text, part_chars)
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts)], names=["row", "doc_id", "at", "text"])
                row += 1

    def leaves(part: list[tuple]) -> list[tuple]:
        c = codec(vocabulary, leaf_chars)
        return [(row, doc_id, at, t, id_bytes(c.encode(t))) for row, doc_id, at, t in part]

    def meet(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of one (row, at // fan) stand together, in order, and become one; in the last level, what ``fn`` makes of it."""
        c, held = codec(vocabulary, leaf_chars), []

        def one() -> pa.RecordBatch:
            text, ids = c.joined([(t, np.frombuffer(raw, "<u4")) for _, _, _, t, raw in held])
            row, doc_id, at = held[0][:3]
            made = fn(c, doc_id, ids) if last else (row, doc_id, at // fan, text, id_bytes(ids))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, ends if last else level_ends, strict=True)], schema=ends if last else level_ends)

        for batch in batches:
            for i in range(batch.num_rows):
                r = tuple(x[i].as_py() for x in batch.columns)
                if held and (held[0][0], held[0][2] // fan) != (r[0], r[2] // fan):
                    yield one()
                    held = []
                held.append(r)
        if held:
            yield one()

    level_schema = "row long, doc_id long, at long, text string, ids binary"
    ends, level_ends = (to_arrow_schema(documents.sparkSession.createDataFrame([], x).schema) for x in (schema, level_schema))
    # parts are written once, so that their row numbers stay the same when a task runs again
    parts = store(long.mapInArrow(cut, "row long, doc_id long, at long, text string"), "bpe-parts")
    level = map_rows(parts.repartition("row", "at"), leaves, level_schema)
    n = parts.agg(F.max("at")).first()[0] + 1
    while True:  # one function of Python a stage, so a task needs one worker
        n = -(-n // fan)
        last = n == 1
        grouped = level.repartition("row", F.floor(F.col("at") / fan)).sortWithinPartitions("row", "at")
        level = grouped.mapInArrow(partial(meet, last=last), schema if last else level_schema)
        if last:
            return short.unionByName(level)


def encode_documents(documents: DataFrame, vocabulary: str, **sizes: int) -> DataFrame:
    """doc_id, ids (array<int>), decoded."""
    return encoded(documents, vocabulary, lambda c, k, ids: (k, ids.tolist(), c.decode(ids)), "doc_id long, ids array<int>, decoded string", **sizes)


def digest_documents(documents: DataFrame, vocabulary: str, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def fn(c: Codec, doc_id: int | None, ids: np.ndarray) -> tuple:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        return doc_id, len(ids), sha(id_bytes(ids)), sha(c.decode(ids).encode())

    return encoded(documents, vocabulary, fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", **sizes)


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_vocabulary())
