"""Line-first cleaning of web text.

Every line with a word is judged alone by three rules; failing lines go, and a document that loses too
large a share of its characters is rejected.

* punctuation: at least SYMBOL_SHARE of the words, and two of them, carry a symbol of ``#*$%&<>``, or at
  least SHOUT_SHARE of them, and two, end in a doubled exclamation or question mark, or the line is short
  (under FRAGMENT_WORDS words) and has no end mark;
* navigation: at least NAV_MARKS separators, making up NAV_SHARE of the line's words, in a line of twice
  NAV_MARKS words or more;
* boilerplate: at least one phrase of the list below for each PHRASE_WORDS words, whatever the line's
  length, or a line of STUTTER_WORDS words or more of which STUTTER_SHARE repeat the word before them, or a
  line of LEAST_CHARS characters or more that the whole corpus repeats in different surroundings: the hashes
  of the lines before it, and of those after it, fall into SURROUNDINGS or more of 64 classes each. Copies
  and near copies of a document give a line the same neighbours, so they do not make it boilerplate; a first
  or last line has one neighbour and is not counted. Such lines go, but say nothing about the rest: the share
  that a document loses is that of its other lines. A document of nothing else is rejected.

Defined cases: a null text is the empty text; lines without a word are neither judged nor counted; a
document without words is not kept; repeated rows are judged one by one. An empty table gives no rows; other
columns are not read, so their names may clash; a text of any length is judged line by line in one task.
Lines are counted by two 64-bit masks each, merged before the shuffle, so a line of any share of the rows is cheap.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, map_rows, maybe_broadcast, store, table

#: Fixed values.
SYMBOLS = "#*$%&|<>"
END_MARKS = ".!?…:;\"'”’»)]。！？"
NAV_MARK = re.compile(r"[|»›>•·]")
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|use of cookies|accept cookies|javascript"
    r"|licensed under|released under the|this work is licensed|copyright (?:\(c\)|©)|lorem ipsum|sign up for our|subscribe to our"
    r"|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados",
    re.IGNORECASE,
)
SYMBOL_SHARE, SHOUT_SHARE, FRAGMENT_WORDS, NAV_MARKS, NAV_SHARE = 0.3, 0.3, 4, 3, 0.25
PHRASE_WORDS, STUTTER_WORDS, STUTTER_SHARE = 60, 8, 0.4
LEAST_CHARS, SURROUNDINGS = 20, 10
MAX_LOST_SHARE = 0.6
#: Base rules of the contract.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_lines long, n_bad_punctuation long, n_navigation long, n_boilerplate long, n_repeated long, lost_share double, clean_text string"
)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&<>]")


def line_verdict(line: str, words: list[str]) -> str | None:
    """The rule that a line with these words fails, or None."""
    n = len(words)
    if BOILERPLATE.search(line) and PHRASE_WORDS * len(BOILERPLATE.findall(line)) >= n:
        return "boilerplate"
    if n >= STUTTER_WORDS and sum(map(eq, words, words[1:])) >= STUTTER_SHARE * n:
        return "boilerplate"
    if n >= 2 * NAV_MARKS and len(NAV_MARK.findall(line)) >= max(NAV_MARKS, NAV_SHARE * n):
        return "navigation"
    if any(c in line for c in "#*$%&<>") and sum(1 for w in words if _SYMBOL.search(w)) >= max(2, SYMBOL_SHARE * n):
        return "punctuation"
    if "!!" in line or "??" in line:
        if sum(1 for w in words if w.endswith(("!!", "??"))) >= max(2, SHOUT_SHARE * n):
            return "punctuation"
    if n < FRAGMENT_WORDS and words[-1][-1] not in END_MARKS:
        return "punctuation"
    return None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    found = Counter(grams)
    if len(found) == len(grams):
        return 0
    covered = end = 0
    for i, g in enumerate(grams):
        if found[g] > 1:
            covered += i + window - max(i, end)
            end = i + window
    return covered


def judge(doc_id: int | None, text: str | None, repeated: list[int] | None = None) -> tuple:
    """The row of a document, whose lines numbered ``repeated`` are repeated over the corpus."""
    text, repeated = text or "", frozenset(repeated or ())
    raw = text.encode("utf-8", "surrogatepass").split()
    n_words, word_chars = len(raw), len(text) - sum(text.count(c) for c in WORD_SPACE)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, n_lines, kept_lines, kept_chars, own_chars = set(), 0, 0, [], 0, word_chars
    bad = {"punctuation": 0, "navigation": 0, "boilerplate": 0, "repeated": 0}
    for at, line in enumerate(text.split("\n")):
        stripped = line.strip(WORD_SPACE)
        if not stripped:
            continue
        n_lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        words = _SPACE.split(stripped)
        rule = line_verdict(stripped, words) or ("repeated" if at in repeated else None)
        if rule:
            bad[rule] += 1
            if rule == "repeated":
                own_chars -= sum(map(len, words))
        else:
            kept_lines.append(line)
            kept_chars += sum(map(len, words))
    repeats = repeat_words(raw)
    failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    lost = 1.0 - kept_chars / own_chars if own_chars else float(word_chars > 0)
    kept = not failed and lost <= MAX_LOST_SHARE
    return doc_id, n_words, word_chars, n_symbols, dup, repeats, failed, kept, n_lines, bad["punctuation"], bad["navigation"], bad["boilerplate"], bad["repeated"], lost, "\n".join(kept_lines)


def lines_of(documents: DataFrame) -> DataFrame:
    """Lines with a word: doc_id, t (hash of the text), at (number in the text), h (hash of the line without outer white
    space), n (its characters), before and after (hashes of its neighbours, null if none)."""
    trimmed = lambda x: F.btrim(x, F.lit(WORD_SPACE))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), F.xxhash64(trimmed(x)).alias("h"), F.char_length(trimmed(x)).alias("n")))
    held = documents.select("doc_id", F.xxhash64("text").alias("t"), F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    beside = F.transform("lines", lambda x, i: F.struct(x["at"].alias("at"), x["h"].alias("h"), x["n"].alias("n"), F.get("lines", i - 1)["h"].alias("before"), F.get("lines", i + 1)["h"].alias("after")))
    return held.select("doc_id", "t", F.inline(beside))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """Hashes h of the lines that the corpus repeats in different surroundings."""
    inner = lines.filter((F.col("n") >= LEAST_CHARS) & F.col("before").isNotNull() & F.col("after").isNotNull())
    masks = [F.bit_or(F.expr(f"shiftleft(1L, cast({side} & 63 AS int))")).alias(side) for side in ("before", "after")]
    return inner.groupBy("h").agg(*masks).filter((F.bit_count("before") >= SURROUNDINGS) & (F.bit_count("after") >= SURROUNDINGS)).select("h")


def clean_lines(documents: DataFrame) -> DataFrame:
    """One row per document: the base measures, the verdict, the rules' counts and the cleaned text."""
    docs = documents.selectExpr("cast(doc_id AS long) AS doc_id", "coalesce(cast(text AS string), '') AS text")
    lines = lines_of(docs)
    found = store(repeated_lines(lines), "repeated-lines")
    held = lines.join(maybe_broadcast(found, found.count()), "h", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(F.collect_set("at").alias("repeated"))
    held = store(held, "repeated-places")
    size = held.agg(F.coalesce(F.sum(F.size("repeated") + 1), F.lit(0))).first()[0]
    told = docs.join(maybe_broadcast(held, size), (F.xxhash64("text") == F.col("u")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    return map_rows(told.select("doc_id", "text", "repeated"), lambda rows: [judge(*r) for r in rows], SCHEMA)


def op2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")
