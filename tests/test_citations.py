"""Citations, support, follow-ups about a part, and languages."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import citations as C

BLOCKS = "qid long, source long, place int, block string, answer string, pics array<string>"


def test_blocks_that_an_answer_uses(spark):
    answer = "Turn the valve to the left and wait for ten minutes"
    rows = [
        (1, 1, 0, "Unrelated words about boats and lakes", answer, []),
        (1, 1, 1, "turn the valve to the left", answer, []),
        (1, 1, 2, "See [[PIC:A1]] boats", answer, ["a1"]),
        (1, 2, 0, "zzz qqq kkk", answer, []),
        (1, 2, 1, "ppp uuu www", answer, []),
        (1, 3, 0, "电池和滤网在机器后面", answer, []),
        (1, 4, 0, None, answer, None),
        (2, 1, 0, "turn the valve", None, []),
    ]
    got = {(r.qid, r.source, r.place): r.score for r in C.cited_blocks(spark.createDataFrame(rows, BLOCKS)).collect()}
    assert got[1, 1, 1] >= 0.92 and got[1, 1, 2] == 1.0 and (1, 1, 0) not in got
    assert not any(k[:2] == (1, 2) for k in got)  # a source in the answer's language that shares nothing
    assert (1, 3, 0) in got and (1, 4, 0) in got and (2, 1, 0) in got  # of other languages nothing can be told


def test_support_of_sources(spark):
    rows = [(1, 1, "turn the valve left and wait ten long minutes", "Turn the valve left, and wait ten long minutes!", []), (1, 2, "nothing", "Turn the valve left, and wait ten long minutes!", []), (1, 3, "x [[PIC:p]]", "y", ["P "]), (1, 4, None, None, None)]
    got = {r.source: (r.support, r.whole) for r in C.supports(spark.createDataFrame(rows, "qid long, source long, content string, answer string, pics array<string>")).collect()}
    assert got[1] == (1.0, True) and got[2][0] < 0.1 and not got[2][1] and got[3] == (1.0, False) and got[4] == (0.0, False)


@pytest.mark.parametrize("question, part, said", [("它怎么清洗", "滤 网", "滤网怎么清洗"), ("该部件的位置", "前盖", "前盖的位置"), ("滤网怎么清洗", "前盖", "滤网怎么清洗"), ("它怎么清洗", None, "它怎么清洗"), (None, "a", "")])
def test_pronouns(spark, question, part, said):
    df = spark.createDataFrame([(question, part)], "q string, p string")
    assert df.select(C.about_component(F.col("q"), F.col("p")).alias("r")).first().r == said


@pytest.mark.parametrize("text, primary, has", [("清洗 filter", "en", "zh"), ("滤网清洗怎么做 ab", "zh", "zh"), ("abc", "", "en"), ("清", "", "zh"), ("清洗 a", "zh", "zh"), (None, "", "en"), ("word", "en", "en")])
def test_languages(spark, text, primary, has):
    r = spark.createDataFrame([(text,)], "t string").select(C.primary_language(F.col("t")).alias("p"), C.any_chinese(F.col("t")).alias("a")).first()
    assert (r.p, r.a) == (primary, has)


def test_subjects_of_a_former_question(spark):
    df = spark.createDataFrame([(["如何", "清洁", "滤网", "的", "Filter", "滤网", " "],)], "t array<string>")
    assert df.select(C.subject_terms(F.col("t")).alias("r")).first().r == "滤网 Filter"
