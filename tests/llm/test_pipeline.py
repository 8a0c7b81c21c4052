"""The stages' decisions take effect, each on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from docloom.llm import bag_minhash, phrase_dedup, quality_rules

from .cases import SCHEMA, documents, words


def test_stages(spark, tmp_path):
    rows = [r for r in documents() if r[0] != 3] + [(100 + i, words(60 + i, i), "en", f"src{i % 3}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, "")
        if i < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if i == 0:
            want = quality_rules.ledger(before).filter("bits = 0")
            assert after.count() == want.count() < before.count()
        if i == 1:
            classes = bag_minhash.near_duplicates(before)
            assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in classes.filter("is_first").collect())
        if i == 2:
            left = {r.doc_id: r.n_bytes - r.n_removed for r in phrase_dedup.dedup(before).collect()}
            assert {r.doc_id for r in after.collect()} == {k for k, v in left.items() if v}
            assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
        if i == 3:
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
        before = after
    assert before.filter("NOT round_trip").count() == 0


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_without_passages_have_whole_characters(spark):
    shared = words(40, 1) + "é" * 20
    rows = [(1, "ü" + shared + "ü"), (2, "ö" + shared + "ö"), (3, None), (4, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    raw = {r.doc_id: r.kept for r in phrase_dedup.dedup(docs, keep=True).collect()}
    text = {r.doc_id: r.text for r in phrase_dedup.dedup(docs, keep="text").collect()}
    assert text == {k: v.decode(errors="ignore") for k, v in raw.items()} and text[1] == rows[0][1] and text[3] == text[4] == ""
