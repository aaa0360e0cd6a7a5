"""Retrieval quality: hits per question, aggregates, the regression gate; answers and parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import characters, common_han_ratio, garble_ratio, squash
from ..staging import small, staged
from .substrings import SCANNED, holders, scanned


def keyword_hit(keywords: Column, *texts: Column) -> Column:
    whole = F.concat_ws(" ", *(F.coalesce(t, F.lit("")) for t in texts))
    return F.exists(keywords, lambda k: whole.contains(k))


def clause_hit(clauses: Column, section: Column, clause_no: Column) -> Column:
    """A wanted clause number begins a part of the section or is the chunk's own; 4.3 is not 4.30."""
    whole = F.concat_ws(" ", F.coalesce(section, F.lit("")), F.coalesce(clause_no, F.lit("")))
    return F.exists(clauses, lambda c: (c != "") & F.regexp_like(whole, F.concat(F.lit(r"(^|[\s/（(])\Q"), c, F.lit(r"\E(?![0-9.])"))))


def has_source(section: Column, page: Column) -> Column:
    return (F.coalesce(section, F.lit("")) != "") | (F.coalesce(page, F.lit(0)) != 0)


def scored_questions(gold: DataFrame, results: DataFrame) -> DataFrame:
    """Per gold question (qid, intent, kb, expect_keywords, expect_clauses): recall5, recall10, clause5, clause10 (null without
    clauses) and citation, over results (qid, rank, snippet, section, source, page, clause_no)."""
    both = gold.join(results.filter("rank <= 10"), "qid", "left")
    word = F.coalesce(keyword_hit(F.col("expect_keywords"), F.col("snippet"), F.col("section"), F.col("source")), F.lit(False)) & F.col("rank").isNotNull()
    clause = F.coalesce(clause_hit(F.col("expect_clauses"), F.col("section"), F.col("clause_no")), F.lit(False))
    wanted = F.size(F.coalesce("expect_clauses", F.array().cast("array<string>"))) > 0
    top5 = F.col("rank") <= 5
    g = both.groupBy("qid", F.col("intent"), gold["kb"]).agg(
        F.coalesce(F.max(word & top5), F.lit(False)).alias("recall5"),
        F.coalesce(F.max(word), F.lit(False)).alias("recall10"),
        F.max(F.when(wanted, clause & F.coalesce(top5, F.lit(False)))).alias("clause5"),
        F.max(F.when(wanted, clause)).alias("clause10"),
        F.coalesce(F.max(has_source(F.col("section"), F.col("page")) & F.col("rank").isNotNull()), F.lit(False)).alias("citation"),
    )
    return g


def summary(questions: DataFrame) -> DataFrame:
    """Means over all questions, by intent and by knowledge base; clause means leave questions without clauses out."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("int")), 4).alias(c)
    measures = [F.count("*").alias("n"), mean("recall5"), mean("recall10"), mean("clause5"), mean("clause10"), F.count("clause5").alias("clause_n"), mean("citation")]
    return questions.groupingSets([[], ["intent"], ["kb"]], "intent", "kb").agg(*measures)


def gate(now: DataFrame, baseline: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """measure, value, base, passed for rows (measure, value); a fall of more than the tolerance fails."""
    both = now.select("measure", "value").join(baseline.select("measure", F.col("value").alias("base")), "measure")
    return both.withColumn("passed", F.round(F.col("value") - F.col("base"), 9) >= -tolerance)


def rounds(reports: DataFrame) -> DataFrame:
    """Mean and population deviation of each measure over rounds."""
    return reports.groupBy("measure").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"))


def root_cause(target: DataFrame, *stages: tuple[str, DataFrame]) -> DataFrame:
    """qid, chunk_id, lost_at: the first stage (name, rows of qid and chunk_id) that lacks the target, null if none does."""
    out = target
    for i, (_, rows) in enumerate(stages):
        out = out.join(rows.select("qid", "chunk_id").distinct().withColumn(f"in_{i}", F.lit(True)), ["qid", "chunk_id"], "left")
    lost = F.coalesce(*(F.when(F.col(f"in_{i}").isNull(), F.lit(name)) for i, (name, _) in enumerate(stages)))
    return out.withColumn("lost_at", lost).drop(*(f"in_{i}" for i in range(len(stages))))


def unsupported_gold(gold: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, keyword of expectations that no chunk of the question's knowledge base holds. Chunks are scanned for all keywords at
    once. Beyond SCANNED of them, chunks meet the keywords that have their rarest pair of characters in them, and a keyword
    of one character the chunks that have it."""
    wanted = gold.select("qid", "kb", F.explode("expect_keywords").alias("keyword"))
    words = wanted.select(F.col("keyword").alias("pattern")).distinct()
    empty = chunks.filter("content IS NOT NULL").select("kb", F.lit("").alias("keyword")).distinct()  # stands in any text
    few = [r.pattern for r in words.filter("pattern <> ''").limit(SCANNED + 1).collect()]
    if len(few) <= SCANNED:
        held = scanned(chunks.select(F.col("kb").alias("id"), F.col("content").alias("text")), few).select(F.col("id").alias("kb"), F.col("pattern").alias("keyword"))
        return wanted.join(held.unionByName(empty), ["kb", "keyword"], "left_anti").select("qid", "keyword")
    texts = staged(chunks.select("kb", F.xxhash64("kb", "content").alias("id"), F.col("content").alias("text")).filter("text IS NOT NULL").dropDuplicates(["id", "text"]), "gold-texts")
    long = holders(texts, words.filter("length(pattern) >= 2"))
    short = texts.select("id", F.explode(characters(F.col("text"))).alias("pattern")).join(small(words.filter("length(pattern) = 1")), "pattern").select("id", "pattern")
    held = texts.select("id", "kb").join(long.unionByName(short), "id").select("kb", F.col("pattern").alias("keyword")).distinct()
    return wanted.join(held.unionByName(empty), ["kb", "keyword"], "left_anti").select("qid", "keyword")


def fact_check(answer: Column, core_words: Column, share: float = 0.8) -> Column:
    """At least this share of the core words stands in the answer, or for longer ones one of their windows of two to four
    characters; null without core words."""
    windows = lambda w: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(4)), lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))))
    hit = F.filter(core_words, lambda w: answer.contains(w) | F.exists(windows(w), lambda x: answer.contains(x)))
    return F.when(F.size(core_words) > 0, F.size(hit) >= share * F.size(core_words))


def parser_metrics(pages: DataFrame, common_han: str) -> DataFrame:
    """Adds total_chars, garble_ratio, han_ratio, clause_count to texts of parsing engines."""
    clauses = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\d.])(\d{1,2}\.\d{1,2}\.\d{1,2})(?!\d)"), F.lit(1)))
    return pages.withColumns({"total_chars": F.length(squash(F.col("text"))), "garble_ratio": F.round(garble_ratio(F.col("text")), 4), "han_ratio": F.round(common_han_ratio(F.col("text"), common_han), 4), "clause_count": F.size(clauses)})


def similarity(texts: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the ratio of matching blocks of two text columns, 0 to 1."""
    import difflib

    import pandas as pd

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)])

    return texts.withColumn("similarity", F.round(ratio(F.col(a), F.col(b)), 4))


def best_engines(scores: DataFrame) -> DataFrame:
    """The best engine of each document type; the first by name wins ties. Every engine must have seen the same pages."""
    pages = scores.groupBy("doc_type", "engine").agg(F.array_sort(F.collect_set("page")).alias("p")).groupBy("doc_type").agg(F.assert_true(F.count_distinct("p") == 1, "engines saw different pages").alias("ok"))
    mean = scores.groupBy("doc_type", "engine").agg(F.round(F.avg("score"), 6).alias("score")).join(pages, "doc_type").filter("ok is null")
    return mean.groupBy("doc_type").agg(F.min_by("engine", F.struct(-F.col("score"), "engine")).alias("engine"), F.max("score").alias("score"))


def weighted_score(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: the mean of the named measures (0 to 1 each) by weight, over those that are not null."""
    known = [F.when(F.col(name).isNotNull(), F.lit(w)).otherwise(0.0) for name, w in weights.items()]
    total = [F.coalesce(F.col(name), F.lit(0.0)) * w for name, w in weights.items()]
    return metrics.withColumn("score", F.round(F.try_divide(sum(total, F.lit(0.0)), sum(known, F.lit(0.0))), 4))
