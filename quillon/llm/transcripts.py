"""Transcript parsing: roles of plain transcript lines by a hidden Markov model, then canonical turns.

States are (style, role, first or later line of a turn). A conversation keeps one style: speakers named, speakers
marked by quote marks or bullets, or not marked at all. A line shows its speaker marker, if it has one, a bucket of its
length, whether it ends as a question, whether it begins with a capital or is indented, and what the line before it
was (none, blank, short, long); given the state, these are taken to be independent. Start, transition and emission
probabilities are counted over all training rows, with additive smoothing; the counts that reach the driver are a
fixed number of cells.

A conversation may come as one text or in pieces, as rows in order: where a row begins is no feature, so the states
of the lines are the same. Training rows are turns of known roles, which say where a turn begins.

Rows are numbered within their conversation by ranges of the sort order, and BLOCK_ROWS of them are a
block, so a block is small whatever the keys are. Viterbi is exact for any length of conversation without
holding one in a task: each block becomes the best-path matrix between the state before it and its last
state, matrices combine FAN at a time up a tree, and the way down fixes the state at every block border.
Last, each block finds its own best path between its two border states.

make_transcript() writes a table of turns the way transcripts are found in the wild: five marker styles,
some without any marker, and markers left out here and there.

Defined cases: a null text is one empty line; rows of a null conversation are one conversation; a null turn
sorts first; rows with equal conversation and turn are ordered by the hash of their text; unknown or null
roles train nothing; without training rows all probabilities are even; an empty table gives no rows; other columns
are not looked at, so their names may clash; a row's text of any length is cut into lines in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, doc_fold, map_rows, store, table

ROLES = ["system", "user", "assistant"]
STYLES = ["named", "marked", "plain"]
ROLE_STATES = 2 * len(ROLES)  # role r: 2 r for a first line, 2 r + 1 for a later one
N_STATES = len(STYLES) * ROLE_STATES
BLOCK_ROWS, FAN = 32, 64
SMOOTH = 0.5
MARKERS = ["none", "system", "user", "assistant", "quote", "bullet"]
LENGTHS = [1, 20, 60, 120, 200, 300, 450, 700]
SHORT = 60
#: Numbers of values: marker, length, question, capital or indent, line before (none, blank, short, long).
FEATURES = (len(MARKERS), len(LENGTHS) + 1, 2, 3, 4)
N_SYMBOLS = int(np.prod(FEATURES))
#: Names that speakers go by in transcripts.
NAMES = {"system": "system|instructions", "user": "user|human|customer|question|q", "assistant": "assistant|ai|bot|agent|answer|a|gpt"}
_NAMED = [(k, re.compile(rf"^\s*(?:#+\s*|\*\*|\[|<\|?)?(?:{names})(?:\*\*|\]|\|?>)?\s*(?::|(?<=[\]>])|$)(?:\*\*)?\s*", re.IGNORECASE)) for k, names in NAMES.items()]
_PLAIN = [("quote", re.compile(r"^\s*>+\s*")), ("bullet", re.compile(r"^\s*\*\s+"))]


def marker(line: str) -> tuple[str, str]:
    """Kind of the line's speaker marker and the line without it."""
    for kind, pattern in (*_NAMED, *_PLAIN):
        m = pattern.match(line)
        if m:
            return kind, line[m.end() :]
    return "none", line


def symbol(line: str, before: int = 0) -> int:
    """The line's features as one number; ``before`` is the kind() of the line before it."""
    mark, rest = marker(line)
    start = 1 if line[:1].isspace() else 2 if rest[:1].isupper() else 0
    out = 0
    for n, value in zip(FEATURES, (MARKERS.index(mark), sum(len(rest) >= n for n in LENGTHS), rest.rstrip().endswith(("?", "？")), start, before), strict=True):
        out = out * n + int(value)
    return out


def kind(line: str) -> int:
    """1 for a blank line, 2 for a short and 3 for a long one; 0 stands for none."""
    return 1 if not line.strip() else 2 if len(line) < SHORT else 3


def symbols_of(lines: list[str], before: int = 0) -> list[int]:
    return [symbol(x, kind(lines[i - 1]) if i else before) for i, x in enumerate(lines)]


def style_of(symbols: list[int]) -> int:
    """Place in STYLES that a conversation's markers tell: named if any speaker is, else marked if any marker is there."""
    marks = {s // (N_SYMBOLS // len(MARKERS)) for s in symbols}
    return 0 if marks & {1, 2, 3} else 1 if marks & {4, 5} else 2


def make_transcript(conv_id: int | None, turn: int | None, role: str | None, text: str | None) -> str:
    """A turn as it may stand in a found transcript."""
    text, style = text or "", zlib.crc32(f"style {conv_id}".encode()) % 5
    if style == 4 or role not in ROLES or zlib.crc32(f"{conv_id} {turn}".encode()) % 10 == 0:
        return text
    if style == 0:
        return f"{role.capitalize()}: {text}"
    if style == 1:
        return f"[{role}] {text}"
    if style == 2:
        return f"### {'Human' if role == 'user' else role.capitalize()}:\n{text}"
    return {"user": "> ", "system": "* ", "assistant": ""}[role] + text


# -- the model ---------------------------------------------------------------------------------------


class Hmm:
    """Log probabilities; row N_STATES of ``move`` leads from the start."""

    def __init__(self, move: np.ndarray, show: np.ndarray):
        self.move, self.show = move, show

    @classmethod
    def from_counts(cls, start: dict[int, int], turns: dict[tuple[int, int], int], lines: dict[tuple[int, int, bool, int], int], styles: dict[int, int]) -> Hmm:
        """Counts of first roles, of (role, next role), of (style, role, first line, symbol), and of conversations by style."""
        n = len(ROLES)
        move = np.zeros((N_STATES + 1, N_STATES))
        counts = np.zeros((N_STATES, *FEATURES))
        for (style, r, first, s), k in lines.items():
            counts[(style * ROLE_STATES + 2 * r + (not first), *np.unravel_index(s, FEATURES))] += k
        ends = np.array([[turns.get((r, q), 0) + SMOOTH for q in range(n)] for r in range(n)])
        ends /= ends.sum(axis=1, keepdims=True)
        begin = np.array([start.get(r, 0) + SMOOTH for r in range(n)])
        share = np.array([styles.get(s, 0) + SMOOTH for s in range(len(STYLES))])
        first, later = (counts.reshape(len(STYLES), n, 2, -1).sum(axis=-1)[:, :, i] for i in (0, 1))
        go_on = (later + SMOOTH) / (first + later + 2 * SMOOTH)
        for style in range(len(STYLES)):
            at = style * ROLE_STATES
            for r in range(n):
                for a in (at + 2 * r, at + 2 * r + 1):
                    move[a, at + 2 * r + 1] = go_on[style, r]
                    move[a, at : at + ROLE_STATES : 2] = (1 - go_on[style, r]) * ends[r]
            move[N_STATES, at : at + ROLE_STATES : 2] = share[style] / share.sum() * begin / begin.sum()
        show = np.zeros((N_STATES, *FEATURES))
        for f, size in enumerate(FEATURES):
            own = counts.sum(axis=tuple(i + 1 for i in range(len(FEATURES)) if i != f)) + SMOOTH
            show += np.log(own / own.sum(axis=1, keepdims=True)).reshape(N_STATES, *(size if i == f else 1 for i in range(len(FEATURES))))
        with np.errstate(divide="ignore"):
            return cls(np.log(move), show.reshape(N_STATES, N_SYMBOLS))

    def matrix(self, symbols: list[int]) -> np.ndarray:
        """(before, last): score of the best path over the lines from the state before them to the last state."""
        best = self.move + self.show[:, symbols[0]]
        inner = self.move[:N_STATES]
        for s in symbols[1:]:
            best = (best[:, :, None] + inner[None]).max(axis=1) + self.show[:, s]
        return best

    def path(self, symbols: list[int], before: int, last: int) -> list[int]:
        """The best states of the lines between two given border states; of equals, the least state."""
        best, back = self.move[before] + self.show[:, symbols[0]], []
        for s in symbols[1:]:
            steps = best[:, None] + self.move[:N_STATES]
            back.append(steps.argmax(axis=0))
            best = steps.max(axis=0) + self.show[:, s]
        out = [last]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def join_matrices(matrices: list[np.ndarray]) -> np.ndarray:
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None, :N_STATES]).max(axis=1)
    return best


def border_states(matrices: list[np.ndarray], before: int, last: int | None) -> list[int]:
    """Best last state of each of several blocks in a row; ``last`` of the whole is given or free."""
    best, back = matrices[0][before], []
    for m in matrices[1:]:
        steps = best[:, None] + m[:N_STATES]
        back.append(steps.argmax(axis=0))
        best = steps.max(axis=0)
    out = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


# -- Spark stages ------------------------------------------------------------------------------------


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """``fn`` on the rows of each group, in order. Groups stream through sorted partitions, without a call of
    Spark's for each."""
    kinds = pa.schema([pa.field(f.name, t) for f, t in zip(df.sparkSession.createDataFrame([], schema).schema, _arrow_types(df, schema), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and any(row[k] != group[0][k] for k in keys):
                    out += fn(group)
                    group = []
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                        out = []
                group.append(row)
        if group:
            out += fn(group)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _arrow_types(df: DataFrame, schema: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema]


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, h, row, tail, …) with block: BLOCK_ROWS rows of a conversation that follow one another, and before:
    the tail of the row before. Each range of the sort order counts its rows of a conversation, and the ranges before it
    give the offset and their last tail, so a conversation of any size is numbered without being in one task."""
    order = ["conv_id", "turn", "h", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("part", "int"), ("place", "bigint"), ("before", "int")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, held = TaskContext.get().partitionId(), (), 0, None
        for batch in batches:
            places, before = [], []
            for conv_id, tail in zip(batch.column("conv_id").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                last, place, held = ((conv_id,), 0, None) if (conv_id,) != last else (last, place + 1, held)
                places.append(place)
                before.append(held)
                held = tail
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(before, pa.int32())], names=[*batch.schema.names, "part", "place", "before"])

    # written, so that parts and places stay the same when a task runs again
    counted = store(ranged.mapInArrow(run, schema), "transcript-places")
    sizes = counted.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by("tail", "place").alias("end"))  # at most one row a range and conversation
    ranges = W.partitionBy("conv_id").orderBy("part")
    before = F.coalesce(F.sum("n").over(ranges.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before.alias("offset"), F.lag("end").over(ranges).alias("above"))
    joined = counted.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    at = F.col("place") + F.col("offset")
    return joined.withColumns({"block": F.floor(at / BLOCK_ROWS), "at": at, "before": F.coalesce("before", "above", F.lit(0))}).drop("part", "place", "c", "p", "offset", "above")


def train(rows: DataFrame) -> Hmm:
    """Counts over rows (conv_id, block, at, role_no, style, symbols), which are turns; style is the least place in STYLES that a
    row's own markers tell, of which the conversation's is the least."""
    n = len(ROLES)

    def steps(group: list[dict]) -> list[tuple]:
        roles, pairs = [r["role_no"] for r in group], [0] * (n * n)
        for a, b in zip(roles, roles[1:], strict=False):
            if a is not None and b is not None:
                pairs[a * n + b] += 1
        return [(group[0]["conv_id"], group[0]["block"], roles[0], roles[-1], pairs)]

    blocks = store(map_groups(rows.select("conv_id", "block", "at", "role_no"), ["conv_id", "block"], ["at"], steps, "conv_id long, block long, first int, last int, pairs array<long>"), "transcript-steps")
    inside = blocks.agg(*(F.coalesce(F.sum(F.get("pairs", F.lit(k))), F.lit(0)) for k in range(n * n))).first()
    after = blocks.select(F.col("conv_id").alias("c"), (F.col("block") - 1).alias("b"), F.col("first").alias("next"))
    across = blocks.join(after, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).filter("last is not null and next is not null")
    turns = {divmod(k, n): inside[k] for k in range(n * n)}
    for r in across.groupBy("last", "next").agg(F.count("*").alias("n")).collect():
        turns[r["last"], r["next"]] += r["n"]
    start = blocks.filter("block = 0 and first is not null").groupBy("first").agg(F.count("*").alias("n")).collect()
    told = store(rows.groupBy(F.col("conv_id").alias("c")).agg(F.min("style").alias("whole")), "transcript-styles")
    styles = {r["whole"]: r["n"] for r in told.groupBy("whole").agg(F.count("*").alias("n")).collect()}
    known = rows.filter("role_no is not null").select("conv_id", "role_no", "symbols").join(told, F.col("conv_id").eqNullSafe(F.col("c")))
    known = known.select("whole", "role_no", F.posexplode("symbols").alias("line", "s"))
    lines = known.groupBy("whole", "role_no", (F.col("line") == 0).alias("is_first"), "s").agg(F.count("*").alias("n")).collect()
    return Hmm.from_counts({r["first"]: r["n"] for r in start}, turns, {(r.whole, r.role_no, r.is_first, r.s): r["n"] for r in lines}, styles)


def parse_transcripts(turns: DataFrame, training) -> DataFrame:
    """conv_id, turn, role, begins, n_turns, n_lines, n_agree, rendered for each row of (conv_id, turn, role, transcript), a piece of
    its conversation's text.

    role is what the model recovers for the row's first line, begins whether a turn begins there, n_turns how many begin in
    the row, n_agree how many of its lines get that role; the given role and the rows' borders, which are then turns, are
    used for training where ``training`` holds, never in recovery."""
    spark = turns.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            conv_id, turn, role, train_on, texts = (c.to_pylist() for c in batch.columns)
            lines = [(t or "").split("\n") for t in texts]
            role_no = [ROLES.index(r) if on and r in ROLES else None for r, on in zip(role, train_on, strict=True)]
            h = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            symbols = [symbols_of(own) for own in lines]
            cols = (conv_id, turn, h, range(row, row + len(turn)), role_no, [bool(x) for x in train_on], [style_of(x) for x in symbols], [kind(x[-1]) for x in lines], lines, symbols)
            row += len(turn)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            names = ["conv_id", "turn", "h", "row", "role_no", "train_on", "style", "tail", "lines", "symbols"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    given = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.coalesce(training, F.lit(False)), F.col("transcript").cast("string"))
    bound_batches(spark)
    lined = store(given.mapInArrow(cut, "conv_id long, turn long, h long, row long, role_no int, train_on boolean, style int, tail int, lines array<string>, symbols array<int>"), "transcript-lines")
    # the last feature of a row's first line is what the line before it was
    first = F.transform("symbols", lambda s, i: F.when(i == 0, s + F.col("before")).otherwise(s))
    rows = store(numbered(lined).withColumn("symbols", first), "transcript-rows")
    model = spark.sparkContext.broadcast(train(rows.filter("train_on")))  # of fixed size

    shape = (N_STATES + 1, N_STATES)
    as_matrix = lambda flat: np.array(flat).reshape(shape)
    whole = lambda group: [s for r in group for s in r["symbols"]]
    level = store(map_groups(rows.select("conv_id", "block", "at", "symbols"), ["conv_id", "block"], ["at"], lambda g: [(g[0]["conv_id"], g[0]["block"], model.value.matrix(whole(g)).ravel().tolist())], "conv_id long, block long, m array<double>"), "transcript-blocks")
    levels = [level]
    while levels[-1].agg(F.max("block")).first()[0]:
        up = levels[-1].withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(store(map_groups(up, ["conv_id", "parent"], ["block"], lambda g: [(g[0]["conv_id"], g[0]["parent"], join_matrices([as_matrix(r["m"]) for r in g]).ravel().tolist())], "conv_id long, block long, m array<double>"), "transcript-level"))
    borders_schema = "conv_id long, block long, before int, last int"
    borders = map_rows(levels[-1], lambda part: [(c, b, N_STATES, border_states([as_matrix(m)], N_STATES, None)[0]) for c, b, m in part], borders_schema)

    def down(group: list[dict]) -> list[tuple]:
        states = border_states([as_matrix(r["m"]) for r in group], group[0]["before"], group[0]["last"])
        return [(r["conv_id"], r["block"], a, b) for r, a, b in zip(group, [group[0]["before"], *states], states, strict=False)]

    for depth in range(len(levels) - 2, -1, -1):
        upper = store(borders, "transcript-borders").select(F.col("conv_id").alias("c"), F.col("block").alias("parent"), "before", "last")
        child = levels[depth].withColumn("p", F.floor(F.col("block") / FAN))
        joined = child.join(upper, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") == F.col("parent"))).select("conv_id", "parent", "block", "m", "before", "last")
        borders = map_groups(joined, ["conv_id", "parent"], ["block"], down, borders_schema)
    borders = store(borders, "transcript-borders").select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "before", "last")

    def render(group: list[dict]) -> list[tuple]:
        states, at, out = model.value.path(whole(group), group[0]["before"], group[0]["last"]), 0, []
        for r in group:
            own = [s % ROLE_STATES for s in states[at : at + len(r["lines"])]]
            at += len(own)
            text = "\n".join((f"<|{ROLES[s // 2]}|>\n" if s % 2 == 0 else "") + marker(x)[1] for s, x in zip(own, r["lines"], strict=True))
            out.append((r["conv_id"], r["turn"], ROLES[own[0] // 2], own[0] % 2 == 0, sum(s % 2 == 0 for s in own), len(own), sum(s // 2 == own[0] // 2 for s in own), text))
        return out

    final = rows.drop("before").join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "at", "turn", "lines", "symbols", "before", "last")
    return map_groups(final, ["conv_id", "block"], ["at"], render, "conv_id long, turn long, role string, begins boolean, n_turns long, n_lines long, n_agree long, rendered string")


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    written = map_rows(turns.selectExpr("cast(conv_id AS long)", "cast(turn AS long)", "role", "text"), lambda rows: [(c, t, r, make_transcript(c, t, r, x)) for c, t, r, x in rows], "conv_id long, turn long, role string, transcript string")
    return parse_transcripts(written, doc_fold(F.col("conv_id")) != 0)
