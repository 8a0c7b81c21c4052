"""Keys of letters, concepts, ordered ranges, captions by six ways, merged items and catalogue entries."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import reviewed as V


def test_questions_of_the_same_letters(spark):
    q = spark.createDataFrame([(1, "How do I ＣＬＥＡＮ it？"), (2, "how-do i clean it"), (3, "..."), (4, None), (5, "straße"), (6, "how do i clean")], "qid long, question string")
    r = spark.createDataFrame([(7, "How do I clean it?"), (8, "HOW DO I CLEAN IT"), (9, "!"), (10, "STRASSE")], "case_id long, question string")
    assert {(x.qid, x.case_id) for x in V.answers_by_letters(q, r).collect()} == {(1, 7), (2, 7), (5, 10)}


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("How to clean the dish washer filters?", ["clean", "dish", "er", "filter"]),  # concepts are put in one after the other
        ("如何更换洗碗机的滤网", ["replace", "dish", "clean", "er", "filter"]),
        ("摩托艇 转弯", ["jetski", "turn"]),
        ("冷藏室温度", ["冷藏", "藏室", "室温", "温度"]),
        ("阀门 a", ["阀门"]),
        ("请问", []),
        (None, []),
    ],
)
def test_concepts(text, tokens):
    assert V.concepts_of(text) == tokens


def test_a_segmenter_of_ones_own():
    assert V.concepts_of("冷藏室温度的", lambda run: ["冷藏室", "温度", "的"]) == ["冷藏室", "温度"]


def test_questions_of_the_same_concepts(spark):
    q = spark.createDataFrame([(1, "如何更换洗碗机的滤网"), (2, "clean vacuum filter"), (3, "x"), (4, "replace roomba")], "qid long, question string")
    r = spark.createDataFrame([(5, "How do I replace the filter of the dishwasher?"), (6, "cleaning a robot vacuum's filters"), (7, "replace dishwasher"), (8, None)], "case_id long, question string")
    assert {(x.qid, x.case_id) for x in V.answers_by_concepts(q, r).collect()} == {(1, 5), (2, 6)}


@pytest.mark.parametrize(
    "question, want",
    [
        ("第3到第5步骤", (3, 5, False)),
        ("steps 2 to 4", (2, 4, False)),
        ("items three through five", (3, 5, False)),
        ("前十二个步骤", (1, 12, False)),
        ("first three steps", (1, 3, False)),
        ("最后 2 条", (None, 2, True)),
        ("the last two items", (None, 2, True)),
        ("5-3 steps", None),
        ("有哪些步骤", None),
        ("first things", None),
        ("二十一到三十项", (21, 30, False)),
        (None, None),
    ],
)
def test_ordered_ranges(spark, question, want):
    r = spark.createDataFrame([(question,)], "q string").select(V.ordered_range(F.col("q")).alias("r")).first().r
    assert (tuple(r) if r else None) == want


def test_captions_by_six_ways(spark):
    captions = spark.createDataFrame([("发电机手册", "1", "own"), ("a", "2", "two"), ("b", "3", "x"), ("b", "3", "x"), ("a", "4", "p"), ("b", "4", "q"), ("a", "5", " "), ("A手册", "6", "m"), ("a", "6", "n"), ("c", "9", "exact")], "product string, image_id string, caption string")
    figures = spark.createDataFrame([("a", "5", None, "Head", "Head of <PIC> it"), ("b", "7", " said ", "h", "t"), ("a", "8", None, None, None), ("a", "4", "from source", "h", "t")], "product string, image_id string, caption string, heading string, text string")
    images = spark.createDataFrame([("c", "9"), ("发电机", "1"), ("z", "2"), ("z", "3"), ("z", "4"), ("a", "4"), ("a", "5"), ("z", "6"), ("z", "7"), ("a", "8"), ("z", "none")], "product string, image_id string")
    got = {(x.product, x.image_id): (x.caption, x.way) for x in V.caption_cascade(images, captions, figures).collect()}
    assert got == {
        ("c", "9"): ("exact", "exact"), ("发电机", "1"): ("own", "product"), ("z", "2"): ("two", "image"), ("z", "3"): ("x", "image"), ("z", "4"): ("from source", "source"), ("a", "4"): ("p", "exact"),
        ("a", "5"): ("手册图示上下文：Head of it", "source"), ("z", "6"): (None, None), ("z", "7"): ("said", "source"), ("a", "8"): (None, None), ("z", "none"): (None, None),
    }


def test_items_of_traces(spark):
    kind = "request_id long, path string, item_key string, place int, value string"
    old = spark.createDataFrame([(1, "s", "a", 1, "a1"), (1, "s", "b", 2, "b1"), (1, "s", "c", 3, "c1"), (1, "t", "x", 1, "x1")], kind)
    new = spark.createDataFrame([(1, "s", "d", 1, "d2"), (1, "s", "b", 2, ""), (1, "s", "a", 3, "a2"), (2, "s", "a", 1, None)], kind)
    got = [(x.request_id, x.path, x.item_key, x.place, x.value) for x in V.merged_items(old, new).orderBy("request_id", "path", "place").collect()]
    assert got == [(1, "s", "d", 1, "d2"), (1, "s", "b", 2, "b1"), (1, "s", "a", 3, "a2"), (1, "s", "c", 4, "c1"), (1, "t", "x", 1, "x1"), (2, "s", "a", 1, None)]
