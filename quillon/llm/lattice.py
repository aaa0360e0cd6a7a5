"""Language-model scoring by the subword lattice of a unigram vocabulary.

A text is its lower-cased words, each led by the word mark, then one end symbol. Every way to write a
word as pieces of an existing vocabulary is a path of its lattice; a path's probability is the product
of its pieces' scores, and a log-space forward recursion sums over all paths. Words are independent
given the scores, so a document's log probability is the sum over its words and the end.

The vocabulary is given, never trained. Its scores start from the pieces' ranks and are re-estimated on
the training rows by expectation-maximisation: expected uses of a piece over all segmentations of every
training word, from forward and backward sums. A character that is no piece is spelt in byte pieces.

Words are counted where they lie and shuffled as (word, counts); each distinct word's lattice is summed
once. The HEAD most used words are broadcast, so the words that are joined have no hot keys.

Defined cases: a null text is the empty text, one end token; a null id counts as the empty text in the
fold; without training rows all counts are 0 and pieces keep their starting scores; repeated rows are
counted and scored one by one. An empty table gives no rows; other columns are not read, so their
names may clash; a text of any length is scored word by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, byte_words, doc_fold, store, table

MARK, END = "▁", "</s>"
HEAD = 1 << 18
ROUNDS = 2
SMOOTH = 0.05
#: Words that a partial count may hold.
PART_WORDS = 400_000
#: Least probability of a word (e to the -600) whose segmentations are summed as plain probabilities in training.
SAFE = math.exp(-600)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """Natural-log piece scores and the recursions over a word's lattice."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: Every prefix of a piece; its score if it is a piece itself.
        self.prefixes: dict[str, float | None] = {}
        for p, s in scores.items():
            if not (p.startswith("<0x") and p.endswith(">")) and p != END:
                for n in range(1, len(p)):
                    self.prefixes.setdefault(p[:n], None)
                self.prefixes[p] = s

    def _bytes(self, char: str) -> tuple[float, tuple[str, ...]]:
        names = tuple(f"<0x{b:02X}>" for b in char.encode("utf-8", "surrogatepass"))
        return sum(self.scores.get(x, -30.0) for x in names), names

    def arcs(self, word: str) -> list[tuple[int, int, float, str | tuple[str, ...]]]:
        """(start, end, score, piece or bytes), by start."""
        prefixes, n, out = self.prefixes, len(word), []
        for i in range(n):
            for j in range(i + 1, n + 1):
                p = word[i:j]
                try:
                    s = prefixes[p]
                except KeyError:
                    if j == i + 1:
                        out.append((i, j, *self._bytes(p)))
                    break
                if s is not None:
                    out.append((i, j, s, p))
                elif j == i + 1:
                    out.append((i, j, *self._bytes(p)))
        return out

    @staticmethod
    def _sum(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        top = max(terms)
        return top + math.log(sum([math.exp(t - top) for t in terms]))

    def log_probability(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations, by a forward recursion over log sums."""
        prefixes, n, total = self.prefixes, len(word), self._sum
        into: list[list[float]] = [[] for _ in range(n + 1)]
        here = 0.0
        for i in range(n):
            if i:
                here = total(into[i])
            for j in range(i + 1, n + 1):
                p = word[i:j]
                try:
                    s = prefixes[p]
                except KeyError:
                    if j == i + 1:
                        into[j].append(here + self._bytes(p)[0])
                    break
                if s is not None:
                    into[j].append(here + s)
                elif j == i + 1:
                    into[j].append(here + self._bytes(p)[0])
        return total(into[n]) if n else 0.0

    def expected(self, word: str, count: float, into: dict[str, float]) -> None:
        """Adds ``count`` times each piece's expected uses in the word. Words are summed as probabilities, those of
        less than SAFE, which may underflow whatever their length, as logs."""
        arcs, n = self.arcs(word), len(word)
        exp, forward = math.exp, [1.0] + [0.0] * n
        weights = [exp(a[2]) for a in arcs]
        for (i, j, _, _), w in zip(arcs, weights, strict=True):
            forward[j] += forward[i] * w
        if forward[n] >= SAFE:
            backward = [0.0] * n + [1.0]
            for (i, j, _, _), w in zip(reversed(arcs), reversed(weights), strict=True):
                backward[i] += w * backward[j]
            scale = count / forward[n]
            uses = [(forward[a[0]] * w * backward[a[1]] * scale, a[3]) for a, w in zip(arcs, weights, strict=True)]
        else:
            terms: list[list[float]] = [[] for _ in range(n + 1)]
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            for i, j, s, _ in arcs:
                if i and terms[i]:
                    forward[i] = self._sum(terms[i])
                    terms[i] = []
                terms[j].append(forward[i] + s)
            forward[n] = self._sum(terms[n])
            back: list[list[float]] = [[] for _ in range(n + 1)]
            for i, j, s, _ in reversed(arcs):
                if j < n and back[j]:
                    backward[j] = self._sum(back[j])
                    back[j] = []
                back[i].append(s + backward[j])
            uses = [(count * math.exp(forward[i] + s + backward[j] - forward[n]), p) for i, j, s, p in arcs]
        for share, p in uses:
            for x in (p,) if isinstance(p, str) else p:
                into[x] = into.get(x, 0.0) + share


def starting_scores(vocabulary: str) -> dict[str, float]:
    """Scores of the file's pieces from their ranks: probability falls with one over the rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i))] + [END]
    weight = [1.0 / (i + 1) for i in range(len(pieces))]
    total = sum(weight)
    return {p: math.log(w / total) for p, w in zip(pieces, weight, strict=True)}


def normalised(uses: dict[str, float], pieces: dict[str, float], end: float) -> dict[str, float]:
    """Scores of all pieces from their uses, smoothed; they sum to one with the end symbol."""
    counts = {p: uses.get(p, 0.0) + SMOOTH for p in pieces} | {END: end + SMOOTH}
    total = math.log(sum(counts.values()))
    return {p: math.log(c) - total for p, c in counts.items()}


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c, n) over rows (text, held_out): uses in training rows, uses in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            words = list(seen.keys() | held.keys())
            c = [seen[w] for w in words]
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "surrogatepass") for w in words], pa.string()), pa.array(c, pa.int64()), pa.array([x + held[w] for x, w in zip(c, words, strict=True)], pa.int64())], names=["word", "c", "n"])
            seen.clear()
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text, held_out in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in batch.columns), strict=True):
                    (held if held_out else seen).update(byte_words(text))
                if len(seen) + len(held) > PART_WORDS:
                    yield flush()
        yield flush()

    return rows.select("text", "held_out").mapInArrow(run, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def score_words(words: DataFrame, scores: dict[str, float]) -> DataFrame:
    """The word table with p, the log10 probability of each word."""
    shared = words.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, per_nat = Lattice(shared.value), 1 / math.log(10)
        for batch in batches:
            p = [lattice.log_probability(MARK + w) * per_nat for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=["word", "c", "n", "p"])

    return words.select("word", "c", "n").mapInArrow(run, "word string, c long, n long, p double")


def head_of(words: DataFrame, most: int) -> DataFrame:
    """The most used words, at most ``most`` of them: those above a bound found from a histogram of log counts."""
    step = F.floor(F.log2("n") * 16)
    left, bound = most, None
    for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect():
        if r.k > left:
            break
        left, bound = left - r.k, r.s
    return words.filter(step >= bound) if bound is not None else words.limit(0)


def reestimate(counts: DataFrame, scores: dict[str, float], end: float, rounds: int = ROUNDS) -> dict[str, float]:
    """Expectation-maximisation over the counted words; what comes to the driver is one number per piece."""
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(scores)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, uses = Lattice(shared.value), {}
            for batch in batches:
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lattice.expected(MARK + word, c, uses)
            yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.float64())], names=["piece", "uses"])

        uses = {r.piece: r.uses for r in counts.mapInArrow(run, "piece string, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        scores = normalised(uses, scores, end)
    return scores


def score_documents(documents: DataFrame, training, vocabulary: str, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; ``training`` is a condition on the rows."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~training).alias("held_out"))
    counts = store(count_words(rows), "lattice-counts")
    n_docs = rows.filter("not held_out").count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = n_words + n_docs, n_kinds + (n_docs > 0)
    scores = starting_scores(vocabulary)
    if n_docs:
        scores = reestimate(counts.filter("c > 0"), scores, n_docs, rounds)
    log_all = math.log10(tokens + 0.5 * (kinds + 1))
    words = store(score_words(counts, scores).withColumn("base", F.log10(F.col("c") + 0.5) - F.lit(log_all)), "lattice-words")
    common = {r.word.encode("utf-8", "surrogatepass"): (r.base, r.p, r.c > 0) for r in head_of(words, head).collect()}
    known = spark.sparkContext.broadcast(common)  # at most ``head`` words
    end = (math.log10(n_docs + 0.5) - log_all, scores[END] / math.log(10), int(n_docs > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value
        next_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                heads, tail_ids, tail_words, tail_uses = [], [], [], []
                for doc_id, text, held_out in zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in batch.columns), strict=True):
                    words = byte_words(text)
                    base, score, n_known = end
                    for word, n in Counter(words).items():
                        found = common.get(word)
                        if found is None:
                            tail_ids.append(next_id)
                            tail_words.append(word.decode("utf-8", "surrogatepass"))
                            tail_uses.append(n)
                        else:
                            base += n * found[0]
                            score += n * found[1]
                            n_known += n * found[2]
                    heads.append((next_id, doc_id, held_out, len(words) + 1, n_known, base, score))
                    next_id += 1
                yield _batch([*zip(*heads, strict=True)], len(heads))
                if tail_ids:
                    yield _batch([tail_ids, *[None] * 6, tail_words, tail_uses], len(tail_ids))

    scored = store(rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in COLUMNS)), "lattice-scored")
    use = F.col("u.n")
    rest = scored.filter("word is not null").alias("u").join(words.alias("w"), F.col("u.word") == F.col("w.word"))
    rest = rest.select("u.row_id", F.when(F.col("w.c") > 0, use).otherwise(0).alias("n_known"), (use * F.col("w.base")).alias("base"), (use * F.col("w.p")).alias("score"))
    first = scored.filter("word is null").drop("word", "n")
    out = first.unionByName(rest, allowMissingColumns=True).groupBy("row_id").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score")
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


COLUMNS = [
    ("row_id", "long", pa.int64()), ("doc_id", "long", pa.int64()), ("held_out", "boolean", pa.bool_()), ("n_tokens", "long", pa.int64()), ("n_known", "long", pa.int64()),
    ("base", "double", pa.float64()), ("score", "double", pa.float64()), ("word", "string", pa.string()), ("n", "long", pa.int64()),
]


def _batch(columns: list, n: int) -> pa.RecordBatch:
    """A batch of COLUMNS; those that are None or not given are null."""
    columns = [*columns, *[None] * (len(COLUMNS) - len(columns))]
    return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else pa.array(c, t) for c, (_, _, t) in zip(columns, COLUMNS, strict=True)], names=[x[0] for x in COLUMNS])


def op3_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), doc_fold(F.col("doc_id")) != 1, default_vocabulary())
