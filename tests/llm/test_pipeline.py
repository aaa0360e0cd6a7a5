"""The pipeline's stages on the small tables."""

import corpus_pipeline
from quillon.llm import bpe, decontaminate, suffixes, toxicity
from tests.llm.test_neardup import classes_by_hand


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in before.collect()}
        after = stage(spark, before, sf)
        out = {r.doc_id: r for r in after.collect()}
        assert set(out) <= set(rows)
        if name == "toxicity":
            scored = toxicity.score_documents(before, toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert set(out) == {r.doc_id for r in scored if not r.predicted}
        elif name == "near_duplicates":
            least = {}
            for k, c in zip(sorted(rows), classes_by_hand([rows[k].text for k in sorted(rows)]), strict=True):
                least.setdefault(c, k)
            assert set(out) == set(least.values())
        elif name == "repeated_strings":
            kept = {r.doc_id: bytes(r.kept).decode("utf-8", "ignore") for r in suffixes.remove_repeats(before).collect()}
            assert {k: r.text for k, r in out.items()} == kept and all(r.n_chars == len(r.text) for r in out.values() if r.text != rows[r.doc_id].text)
        elif name == "decontamination":
            bad = {r.doc_id for r in decontaminate.found_items(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(out) == set(rows) - bad
        else:
            c = bpe.codec(bpe.default_vocabulary())
            assert {k: r.n_tokens for k, r in out.items()} == {k: len(c.encode(r.text)) for k, r in rows.items()}
        if name != "tokens":
            assert after.columns == docs.columns
        before = after.sparkSession.createDataFrame(after.collect(), after.schema)


def test_run_is_the_stages(spark, sf):
    run = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
    assert run.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns whose names clash, and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, s long, label long, key string, k int, row int"
    long, extra = " ".join(f"w{i % 977}" for i in range(30_000)), (1, 2, "k", 3, 4)
    rows = [(1, None), (2, ""), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "ONE two three four five six seven"), (None, "no id here"), (None, None), (5, long), (6, long + " end"), (7, "a" * 20_000), (8, "é漢😀 \x1c x")]
    data = [(k, t, None, "s", 1, *extra) for k, t in rows] + [(None,) * 10]
    for name, n in (("full", len(data)), ("none", 0)):
        spark.createDataFrame(data[:n], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(5, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").limit(n).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "b1 b2 b3 b4 b5 b6"), (2, None)], "item_id long, text string").limit(n).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        texts = [r[1] for r in data[:n]]
        assert len(got) <= len(set(classes_by_hand(texts)))
        # of each class that no other stage touches, the row with the least id is there
        if n:
            assert {3, None} <= {r.doc_id for r in got} and not {4, 6} & {r.doc_id for r in got}
