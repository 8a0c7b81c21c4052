"""Columns of any name go through operators and stages as they are; repeated ids stay."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docloom.llm import language_model, quality_rules, sentencepiece, url_vocabulary
from docloom.llm.common import named

from .cases import SCHEMA, documents

ODD = ["a.b", "_judged", "judged", "carried", " ", "bits", "n_words", "rest", "none", "ids", "c0", "r0", "x`y", "mix_tokens", "host", "row", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(documents(), SCHEMA)
    for i, name in enumerate(ODD):
        rows = rows.withColumn(name, F.concat(F.lit(f"mine {i} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return rows.repartition(3).cache()


def values(df, names):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", *map(named, names)).collect())


@pytest.mark.parametrize(
    "run, own",
    [
        (lambda d: sentencepiece.encode(d), ["ids"]),
        (lambda d: sentencepiece.decode(sentencepiece.encode(d, out="coded"), "coded", "host"), ["host"]),
        (lambda d: quality_rules.ledger(d), ["bits", "n_words"]),
        (lambda d: language_model.adaptive(d.filter("length(text) < 900")), []),
        (lambda d: url_vocabulary.verdicts(d, "a.b"), ["host"]),
        (lambda d: url_vocabulary.vocabulary(d, "_judged"), []),
        (lambda d: url_vocabulary.verdicts(d, "host"), ["host"]),
    ],
)
def test_operators(docs, run, own):
    out, names = run(docs), [n for n in ODD if n not in own]
    whole = docs.filter("length(text) < 900") if "adaptive_score" in out.columns else docs
    assert values(out, names) == values(whole, names)
    assert [c for c in docs.columns if c not in own] == [c for c in out.columns if c in docs.columns and c not in own]


@pytest.mark.parametrize("stage", range(4))
def test_stages(spark, docs, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    assert out.columns == docs.columns
    kept = out.select("doc_id", *map(named, ODD)).distinct()
    assert kept.exceptAll(docs.select("doc_id", *map(named, ODD)).distinct()).count() == 0
    assert out.filter("doc_id = 3").count() >= 1


def test_last_stage(spark, docs):
    out = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert out.count() == docs.count()


def test_repeated_ids_are_documents_of_their_own(spark, docs):
    three = docs.filter("doc_id = 3").count()
    assert three == 3
    for i in (0, 3):
        assert corpus_pipeline.STAGES[i][1](spark, docs, "").filter("doc_id = 3").count() >= three
    assert corpus_pipeline.STAGES[1][1](spark, docs, "").filter("doc_id = 3").count() == 1
