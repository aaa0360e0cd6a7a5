"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first PREFIX letters. Filters
of several widths slide over the vectors, the maximum over the whole text of each feeds a logistic
unit. Because filters are linear before the maximum, scoring sums rows of one table of hash bucket by
filter tap, whatever the text's length.

Training starts on at most SAMPLE_PER_CLASS labelled documents of each class, and at most SAMPLE_CHARS
characters of them, those with the smallest hash of the id, with 30 updates for each, at most UPDATES. If there are
more, all labelled documents train it on: dealt to shards of about SHARD_DOCS by hash of the id, each shard goes on from the
same start and takes every one of its documents, the rarer class again in turn, and the weights move by the mean of what
the shards changed, of those that changed them. A part of the documents is held back to
calibrate, all of them in bins of 1 / BINS of the logit: for each language a threshold on the logit is chosen, and the score
is the sigmoid of the logit less that threshold, so 0.5 is the calibrated cut everywhere. The language comes from the text
itself, by its most frequent function words; labels, lang, source and ids never enter a score. What the driver gets is
the start's documents, and sums of the model's size.

Defined cases: a null or wordless text scores the model's bias; a document labelled twice counts as
toxic if either label says so; without labels of both classes every document scores 0; rows repeated
are scored one by one. An empty table gives no rows; long texts are scored in spans; where documents come back,
their columns travel unchanged, so their names may clash.
"""

from __future__ import annotations

import copy
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..staging import staged
from .common import bound_batches, doc_fold, map_rows, maybe_broadcast, table

BUCKETS, DIM, FILTERS, WIDTHS, PREFIX = 1 << 15, 8, 8, (1, 2, 3), 4
SAMPLE_PER_CLASS, SAMPLE_CHARS, UPDATES, BATCH, RATE, DECAY = 1500, 16_000_000, 40_000, 8, 0.15, 1e-5
CALIBRATION_SHARE = 5
#: Documents of a shard, and documents and characters that it holds at a time; bins of the logit; parts of one that summed changes are counted in.
SHARD_DOCS, HELD_DOCS, HELD_CHARS, BINS, UNIT = 4096, 1024, 4_000_000, 1000, float(1 << 36)
SPAN = 1 << 15
_WORD = re.compile(r"[^\W\d_]+")
#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "de": "der die und das den ist nicht mit ein eine auf für von zu im dem des sich auch als",
    "en": "the of and to in is that for it with as was on be at by this from are or",
    "es": "el la que y los las del se por un una con para lo como es su al no más",
    "fr": "le la les des et un une du est que dans qui pour au ne pas sur par ce il",
}
LANGUAGES = ["other", *FUNCTION_WORDS]
#: Word to its two buckets and, above them, a bit for each language that has it as a function word.
_MEMO: dict[str, int] = {}
_BITS = BUCKETS.bit_length() - 1
_VOTES = {w: sum(1 << k for k, words in enumerate(FUNCTION_WORDS.values()) if w in words.split()) for words in FUNCTION_WORDS.values() for w in words.split()}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _code(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS | zlib.crc32(b"^" + word[:PREFIX].encode()) % BUCKETS << _BITS | _VOTES.get(word, 0) << 2 * _BITS


def features(text: str | None) -> tuple[np.ndarray, int]:
    """(n, 2) hash buckets of the words and of their prefixes; the place in LANGUAGES of the language with
    the most function words, 0 if there are none."""
    words = words_of(text)
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    try:
        codes = np.fromiter(map(_MEMO.__getitem__, words), np.int64, len(words))
    except KeyError:
        _MEMO.update((w, _code(w)) for w in set(words) if w not in _MEMO)
        codes = np.fromiter(map(_MEMO.__getitem__, words), np.int64, len(words))
    marks = np.bincount(codes >> 2 * _BITS, minlength=1 << len(FUNCTION_WORDS))
    votes = [int(sum(marks[m] for m in range(len(marks)) if m >> k & 1)) for k in range(len(FUNCTION_WORDS))]
    lang = 1 + int(np.argmax(votes)) if any(votes) else 0
    return np.stack([codes & BUCKETS - 1, codes >> _BITS & BUCKETS - 1], axis=1), lang


class Model:
    """Weights, training and scoring."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0.3, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.cut = np.zeros(1, np.float32)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)
        self.state: list[np.ndarray] | None = None  # Adagrad's sums, while training may go on

    def weights(self) -> np.ndarray:
        """All weights in rows of DIM, the embeddings first."""
        rest = np.concatenate([x.ravel() for x in (*self.filters, *self.bias, self.out, self.cut)])
        return np.concatenate([self.embed, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float64)

    def set_weights(self, rows: np.ndarray) -> None:
        self.embed[:] = rows[:BUCKETS]
        rest, at = rows[BUCKETS:].ravel(), 0
        for x in (*self.filters, *self.bias, self.out, self.cut):
            x[...] = rest[at : at + x.size].reshape(x.shape)
            at += x.size

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of all filters over word vectors ``x`` (padded) and where they stand."""
        tops, where = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = len(x) - WIDTHS[-1] + 1
            conv = sum(x[t : t + n] @ f[t] for t in range(w)) + b
            at = conv.argmax(axis=0)
            where.append(at)
            tops.append(conv[at, np.arange(FILTERS)])
        return np.concatenate(tops), where

    def train(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> None:
        """Adagrad on single documents in random order, classes in turn."""
        rng = np.random.default_rng(seed)
        sides = [np.flatnonzero(labels == c) for c in (0, 1)]
        self._update(docs, labels, (int(side[rng.integers(len(side))]) for side in (sides[step % 2] for step in range(min(UPDATES, 30 * len(docs))))))

    def train_each(self, docs: list[np.ndarray], labels: np.ndarray, seed: int = 13) -> None:
        """Every document once, in random order, classes in turn; those of the rarer class come again."""
        rng = np.random.default_rng(seed)
        sides = [rng.permutation(np.flatnonzero(labels == c)) for c in (0, 1)]
        most = max(map(len, sides))
        self._update(docs, labels, (int(side[i % len(side)]) for i in range(most) for side in sides if len(side)))

    def _update(self, docs: list[np.ndarray], labels: np.ndarray, order) -> None:
        if self.state is None:
            self.state = [np.full(x.shape, 1e-4, np.float32) for x in (self.embed[:, :1], *self.filters, self.out, self.cut)]
        g_embed, *g_filters, g_out, g_cut = self.state
        pad = np.zeros((WIDTHS[-1] - 1, DIM), np.float32)
        for k in order:
            ids = docs[k]
            x = np.concatenate([self.embed[ids[:, 0]] + self.embed[ids[:, 1]], pad]) if len(ids) else np.zeros((WIDTHS[-1], DIM), np.float32)
            tops, where = self._pooled(x)
            act = np.maximum(tops, 0) + 0.05 * np.minimum(tops, 0)
            p = 1 / (1 + np.exp(-(act @ self.out + self.cut[0])))
            err = np.float32(p - labels[k])
            if abs(err) < 0.02:
                continue
            d_out = err * act + DECAY * self.out
            d_top = err * self.out * np.where(tops > 0, 1, 0.05).astype(np.float32)
            d_x: dict[int, np.ndarray] = {}
            for m, (w, f, at) in enumerate(zip(WIDTHS, self.filters, where, strict=True)):
                d = d_top[m * FILTERS : (m + 1) * FILTERS]
                d_f = np.empty_like(f)
                for t in range(w):
                    xs = x[at + t]
                    d_f[t] = (xs * d[:, None]).T
                    back = f[t].T * d[:, None]
                    for c, place in enumerate(at):
                        d_x[int(place) + t] = d_x.get(int(place) + t, 0) + back[c]
                g_filters[m] += d_f**2
                f -= RATE * d_f / np.sqrt(g_filters[m])
                self.bias[m] -= 0.01 * d
            for place, d in d_x.items():
                if place < len(ids):
                    for b in ids[place]:
                        g_embed[b] += float(d @ d) / DIM
                        self.embed[b] -= RATE * d / np.sqrt(g_embed[b])
            g_out += d_out**2
            self.out -= RATE * d_out / np.sqrt(g_out)
            g_cut += err**2
            self.cut -= RATE * err / np.sqrt(g_cut)

    def taps(self) -> np.ndarray:
        """(BUCKETS, all taps x FILTERS): what a bucket adds to each filter at each offset."""
        return np.concatenate([self.embed @ f[t] for f, w in zip(self.filters, WIDTHS, strict=True) for t in range(w)], axis=1)

    def logit(self, ids: np.ndarray, taps: np.ndarray) -> float:
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        last = WIDTHS[-1] - 1
        for at in range(0, max(1, len(ids)), SPAN):
            part = ids[at : at + SPAN + last]
            rows = taps[part[:, 0]] + taps[part[:, 1]] if len(part) else np.zeros((1, taps.shape[1]), np.float32)
            n, col = max(1, min(SPAN, len(ids) - at)), 0
            rows = np.concatenate([rows, np.zeros((n + last - len(rows), taps.shape[1]), np.float32)])  # only at the end of the text
            for m, w in enumerate(WIDTHS):
                conv = sum(rows[t : t + n, col + t * FILTERS : col + (t + 1) * FILTERS] for t in range(w))
                col += w * FILTERS
                best[m * FILTERS : (m + 1) * FILTERS] = np.maximum(best[m * FILTERS : (m + 1) * FILTERS], conv.max(axis=0) + self.bias[m])
        act = np.maximum(best, 0) + 0.05 * np.minimum(best, 0)
        return float(act @ self.out + self.cut[0])

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, langs: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Per language the cut with the fewest errors, in the middle of the best gap; few labels lean on all languages. A row
        stands for ``counts`` documents, or one."""
        counts = np.ones(len(logits)) if counts is None else counts

        def best(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
            order = np.argsort(x, kind="stable")
            x, y, n = x[order], y[order], n[order]
            weight = n * np.where(y == 1, 1 / max(1, n[y == 1].sum()), 1 / max(1, n[y == 0].sum()))
            below = np.concatenate([[0], np.cumsum(np.where(y == 1, weight, 0))])
            above = np.concatenate([np.cumsum(np.where(y == 0, weight, 0)[::-1])[::-1], [0]])
            edges = np.concatenate([[x[0] - 2], (x[1:] + x[:-1]) / 2, [x[-1] + 2]])
            gap = np.concatenate([[0], x[1:] - x[:-1], [0]])
            cost = below + above
            cost[1:-1][x[1:] == x[:-1]] = np.inf  # no cut parts equal logits
            return float(edges[np.lexsort((-gap, np.round(cost, 9)))[0]])

        if len(set(labels.tolist())) < 2:
            return
        self.thresholds[:] = best(logits, labels, counts)
        for k in range(len(LANGUAGES)):
            own = langs == k
            if min(counts[own & (labels == c)].sum() for c in (0, 1)) >= 10:
                self.thresholds[k] = best(logits[own], labels[own], counts[own])


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, chars: int = SAMPLE_CHARS) -> list[tuple[int, str, int]]:
    """At most ``per_class`` (id, whole text, label) of each class outside fold 0, by hash of the id, and as many of those
    as ``chars`` characters a class hold, one at least."""
    here = documents.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return _sample(here, _known(here, labels), per_class, chars)


def _known(here: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1) of the labelled documents outside fold 0."""
    known = labels.filter(doc_fold(F.col("doc_id")) != 0).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.filter("toxic IN (0, 1)").join(here.select("doc_id").distinct(), "doc_id", "left_semi")


def _sample(here: DataFrame, known: DataFrame, per_class: int, chars: int = SAMPLE_CHARS) -> list[tuple[int, str, int]]:
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = picked[0].union(picked[1])  # at most twice per_class rows: may be broadcast
    sized = here.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.length("text")).alias("n"))
    w = W.partitionBy("toxic").orderBy(order, "doc_id")  # of those few rows
    fits = sized.withColumns({"total": F.sum(F.coalesce("n", F.lit(0))).over(w), "place": F.row_number().over(w)}).filter((F.col("total") <= chars) | (F.col("place") == 1))
    texts = here.join(F.broadcast(fits.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return sorted((r.doc_id, r.text or "", int(r.toxic)) for r in texts.collect())


def _learning(here: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """doc_id, toxic, text of the ``n`` ``known`` documents, dealt to tasks of about SHARD_DOCS in one order; of rows of one id the
    greatest text comes first. Few known ids are broadcast, so that only their texts are shuffled."""
    shards = -(-n // SHARD_DOCS)
    rows = here.join(maybe_broadcast(known, n), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition(shards, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", F.desc("text"))


def _first_texts(batches):
    """(toxic, features, language, characters) of each id."""
    last = None
    for batch in batches:
        for k, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != last:
                last = k
                yield toxic, *features(text), len(text)


def _train_on_all(model: Model, learning: DataFrame) -> None:
    """Each task goes on training from ``model`` with its documents; the weights move by the mean of the changes that tasks
    made. Changes are summed as whole numbers, so the sum has no order."""
    shared = learning.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [f"v{i}" for i in range(DIM)]

    def run(batches):
        own = copy.deepcopy(shared.value)
        docs, labels, held = [], [], 0
        for toxic, ids, _, n in _first_texts(batches):
            docs.append(ids.astype(np.int32))
            labels.append(toxic)
            held += n
            if len(docs) >= HELD_DOCS or held >= HELD_CHARS:
                own.train_each(docs, np.array(labels))
                docs, labels, held = [], [], 0
        if docs:
            own.train_each(docs, np.array(labels))
        change = np.round((own.weights() - shared.value.weights()) * UNIT).astype(np.int64)
        moved = np.flatnonzero(change.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(moved.astype(np.int32)), *(pa.array(change[moved, i]) for i in range(DIM))], names=["place", *names])

    changes = learning.mapInArrow(run, "place int, " + ", ".join(f"{n} long" for n in names))
    summed = changes.groupBy("place").agg(F.count("*").alias("n"), *(F.sum(n).alias(n) for n in names)).collect()  # a row for each row of weights
    weights = model.weights()
    for r in summed:
        weights[r.place] += np.array(r[2:], np.float64) / UNIT / r.n
    model.set_weights(weights)


def _logit_counts(model: Model, learning: DataFrame) -> list:
    """toxic, lang, bin, n: how many documents have a logit in a bin."""
    shared = learning.sparkSession.sparkContext.broadcast((model, model.taps()))

    def run(batches):
        own, taps = shared.value
        found: dict[tuple[int, int, int], int] = {}
        for toxic, ids, lang, _ in _first_texts(batches):
            key = toxic, lang, int(np.clip(np.floor(own.logit(ids, taps) * BINS), -64 * BINS, 64 * BINS))
            found[key] = found.get(key, 0) + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*((*k, n) for k, n in found.items()), strict=True)], names=["toxic", "lang", "bin", "k"])

    counted = learning.mapInArrow(run, "toxic int, lang int, bin int, k int")
    return sorted(counted.groupBy("toxic", "lang", "bin").agg(F.sum("k").alias("n")).collect())  # no more rows than bins


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """The model trained and calibrated on all labelled documents outside fold 0; None without both classes."""
    bound_batches(documents.sparkSession)
    here = documents.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    back = F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))) % CALIBRATION_SHARE == 0
    known = staged(_known(here, labels).select("doc_id", "toxic", back.alias("held")), "labelled")
    sizes = {(r.held, int(r.toxic)): r["count"] for r in known.groupBy("held", "toxic").count().collect()}
    if len({toxic for _, toxic in sizes}) < 2:
        return None
    apart = len(sizes) == 4  # both classes on both sides
    sample = _sample(here, known.drop("held"), per_class)
    y = np.array([s[2] for s in sample], np.int64)
    found = [features(s[1]) for s in sample]
    ids, langs = [f[0] for f in found], np.array([f[1] for f in found])
    held = np.array([apart and zlib.crc32(b"calibrate %d" % s[0]) % CALIBRATION_SHARE == 0 for s in sample])
    model = Model()
    if len(set(y[~held].tolist())) == 2:
        model.train([i for i, h in zip(ids, held, strict=True) if not h], y[~held])
    total = sum(sizes.values())
    if total > len(sample):
        learned = known.filter(~F.col("held")) if apart else known
        shown = known.filter("held") if apart else known
        n_held = sum(n for (h, _), n in sizes.items() if h)
        _train_on_all(model, _learning(here, learned.drop("held"), total - n_held if apart else total))
        model.state = None
        rows = np.array([tuple(r) for r in _logit_counts(model, _learning(here, shown.drop("held"), n_held if apart else total))])
        model.calibrate((rows[:, 2] + 0.5) / BINS, rows[:, 0], rows[:, 1], rows[:, 3])
        return model
    model.state = None
    taps = model.taps()
    on = held if held.any() else ~held
    logits = np.array([model.logit(i, taps) for i, o in zip(ids, on, strict=True) if o])
    model.calibrate(logits, y[on], langs[on])
    return model


def keep_accepted(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents, all columns as they are, less those predicted toxic."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast((model, model.taps()))
    at = documents.columns.index("text")

    def run(batches):
        model, taps = shared.value
        for batch in batches:
            keep = []
            for text in (x.as_py() for x in batch.column(at)):
                ids, lang = features(text)
                keep.append(model.logit(ids, taps) < float(model.thresholds[lang]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def score_documents(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of every row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model, model.taps()) if model else None)  # of fixed size

    def fn(rows: list[tuple]) -> list[tuple]:
        if shared.value is None:
            return [(k, 0.0, 0) for k, _ in rows]
        model, taps = shared.value
        out = []
        for k, text in rows:
            ids, lang = features(text)
            z = model.logit(ids, taps) - float(model.thresholds[lang])
            s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            out.append((k, float(s), int(s >= 0.5)))
        return out

    rows = documents.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return map_rows(rows, fn, "doc_id long, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (doc_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
