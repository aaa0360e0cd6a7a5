"""Around the language model: prompts, evidence lists, verdicts. The model itself is an interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bad_citations, first_json_object


def numbered_evidence(results: DataFrame, length: int = 200) -> DataFrame:
    """qid, evidence: one line for each result in order of rank: number, source, page, beginning of the text."""
    page = F.when(F.coalesce("page", F.lit(0)) != 0, F.concat(F.lit(" p. "), "page")).otherwise("")
    line = F.concat(F.lit("["), "rank", F.lit("] "), "source", page, F.lit(": "), F.substring(F.coalesce("snippet", F.lit("")), 1, length))
    listed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("evidence"))


def prompts(questions: DataFrame, evidence: DataFrame, style: str = "", weak_note: str = "") -> DataFrame:
    """qid, prompt: style, references, a note where evidence is weak, and the question."""
    both = questions.join(evidence, "qid", "left")
    note = F.when(F.col("evidence_level").isin("weak", "none"), F.lit(weak_note)).otherwise("") if "evidence_level" in both.columns else F.lit("")
    parts = [F.lit(style), F.coalesce("evidence", F.lit("")), note, F.col("question")]
    return both.select("qid", F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n\n").alias("prompt"))


def citation_verdict(answers: DataFrame) -> DataFrame:
    """Answers (answer, n_sources) with bad_numbers and ok; an answer or a source list that is empty is ok."""
    bad = F.when((F.coalesce("answer", F.lit("")) == "") | (F.col("n_sources") == 0), F.array().cast("array<bigint>")).otherwise(bad_citations(F.col("answer"), F.col("n_sources")))
    return answers.withColumn("bad_numbers", bad).withColumn("ok", F.size("bad_numbers") == 0)


def completeness_verdict(reply: Column) -> Column:
    """struct(enumeration, complete, note) from a model's reply; whatever cannot be read is (false, true, '')."""
    got = F.from_json(first_json_object(reply), "enumeration boolean, complete boolean, note string")
    return F.struct(F.coalesce(got["enumeration"], F.lit(False)).alias("enumeration"), F.coalesce(got["complete"], F.lit(True)).alias("complete"), F.substring(F.coalesce(got["note"], F.lit("")), 1, 300).alias("note"))


def picked_lines(candidates: Column, reply: Column) -> Column:
    """Candidates at the places that a model's JSON list names; none if the reply cannot be read."""
    places = F.from_json(F.trim(F.translate(reply, "`", "")), "array<int>")
    return F.coalesce(F.transform(F.filter(places, lambda i: (i >= 0) & (i < F.size(candidates))), lambda i: F.get(candidates, i)), F.array().cast("array<string>"))


def confirmed_numbers(candidates: Column, reply: Column) -> Column:
    """Candidates that a model confirms as missing; all of them if the reply cannot be read."""
    got = F.from_json(first_json_object(reply), "missing array<string>")["missing"]
    return F.when(got.isNull(), candidates).otherwise(F.array_intersect(candidates, got))
