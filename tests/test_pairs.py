"""Pairs of query and document are made where the document is; broadcast or joined, the results are the same."""

import re
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import answers, evidence
from docloom.operators import retrieval as R

DOCS = [(1, "the red pump and the red valve", "a"), (2, "blue pump", "b"), (3, None, "a"), (4, "the valve of the pump", None), (5, "the the the lid", "b")]
ASKED = [(1, "the pump pump"), (2, "red valve lid"), (3, None), (4, "nothing")]


@contextmanager
def no_small_tables(spark):
    """Tables are as if they were large: only what is asked to be broadcast is."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, product string"), spark.createDataFrame(ASKED, "qid long, text string")


PAIRS = re.compile(r"hashpartitioning\((?:qid#\d+L?, doc_id#|doc_id#\d+L?, qid#)")


def test_bm25_pairs_are_not_shuffled(spark):
    docs, asked = tables(spark)
    with no_small_tables(spark):
        for x in (docs, R.indexed(docs)):
            assert not PAIRS.search(plan(R.bm25(x, asked)))
            assert not PAIRS.search(plan(R.bm25(x, asked, asked.select("qid", F.lit("a").alias("product")))))


@pytest.mark.parametrize("scoped", [False, True])
def test_bm25_broadcast_or_joined(spark, scoped):
    docs, asked = tables(spark)
    scope = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "qid long, product string") if scoped else None
    runs = [sorted(map(tuple, R.bm25(x, asked, scope, most).collect())) for x in (docs, R.indexed(docs)) for most in (1 << 20, 0)]
    assert runs[0] and all(r == runs[0] for r in runs)
    assert {(q, d) for q, d, _ in runs[0]} == {(1, 1), (1, 2), (1, 5)} | (set() if scoped else {(1, 4), (2, 1), (2, 4), (2, 5)})


def test_heading_pairs(spark):
    heads = spark.createDataFrame([(1, "red pump"), (2, "cleaning / red valve"), (3, None), (4, "lid")], "doc_id long, heading string")
    asked = spark.createDataFrame([(1, "clean the red valve"), (2, "pump lid"), (3, None)], "qid long, text string")
    with no_small_tables(spark):
        few = R.heading_recall(heads, asked)
        assert not PAIRS.search(plan(few))
    runs = [sorted(map(tuple, R.heading_recall(heads, asked, most).collect())) for most in (1 << 20, 0)]
    assert runs[0] == runs[1] and {r[:2] for r in runs[0]} == {(1, 1), (1, 2), (2, 1), (2, 4)}


def test_equal_keywords_are_searched_once(spark):
    docs, _ = tables(spark)
    # places from 1000 on once met the next question's first ones
    keys = spark.createDataFrame([(1, 1000, "pump"), (2, 0, "lid"), (2, 1, "pump"), (2, 2, None)], "qid long, place int, text string")
    got = {(r.qid, r.doc_id): r["rank"] for r in evidence.keyword_expansion(docs.select("doc_id", "text"), keys).collect()}
    assert {d for q, d in got if q == 1} == {1, 2, 4} and {d for q, d in got if q == 2} == {1, 2, 4, 5} and got[2, 5] == 1


def test_aliases_go_to_the_questions(spark):
    ask = spark.createDataFrame([(1, "x" * 50 + " the red robot 我的吸尘器坏了 " + "y" * 50), (2, "吸 尘器"), (3, "a robot"), (4, "尘 " + "z " * 40 + "吸尘器 x200")], "qid int, text string")
    known = spark.createDataFrame([("red robot", "r"), ("robot", "s"), ("吸尘器", "vacuum"), ("尘", "dust"), ("吸尘器 x200", "v200")], "alias string, product string")
    want = [(1, "r", 9), (2, "dust", 1), (3, "s", 5), (4, "v200", 8)]
    with no_small_tables(spark):
        df = answers.alias_route(ask, known)
        assert "SortMergeJoin" not in plan(df)
        assert sorted(map(tuple, df.collect())) == want
    assert sorted(map(tuple, answers.alias_route(ask, known, most=2).collect())) == want


@pytest.mark.parametrize("n, label", [(139, "short"), (140, "ready"), (1008, "ready"), (1009, "long")])
def test_labels_at_their_bounds(spark, n, label):
    assert spark.range(1).select(evidence.quality_label(F.repeat(F.lit("x"), F.lit(n)))).first()[0] == label


def test_nearest_with_ties_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_CHUNK", 2)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(12, 4)), np.ones((8, 4))])
    kind = [None if i % 5 == 0 else i % 2 for i in range(20)]
    v = spark.createDataFrame([(i, x[i].tolist(), kind[i]) for i in range(20)], "vec_id long, embedding array<float>, label int")
    q = v.filter("vec_id >= 9").withColumnRenamed("vec_id", "qid")
    e = x.astype(np.float32).astype(float)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    s = np.round(e @ e.T, 6)
    for scope in (None, "label"):
        got = {(r.qid, r["rank"]): r.doc_id for r in R.dense_top(v, q, 3, scope).collect()}
        want = {}
        for i in range(9, 20):  # a vector without a label has no others in its scope
            near = sorted((-s[i, j], j) for j in range(20) if not scope or (kind[i] is not None and kind[i] == kind[j]))
            want |= {(i, k + 1): j for k, (_, j) in enumerate(near[:3])}
        assert got == want
