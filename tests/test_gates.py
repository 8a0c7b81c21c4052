"""Gates, expansions, components, captions and the row that is handed in."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import gates as G


def one(spark, expression, **values):
    kinds = {str: "string", list: "array<string>", type(None): "string"}
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return df.select(expression.alias("r")).first().r


def test_phrases_of_a_topic(spark):
    got = one(spark, G.topic_phrases(F.col("t")), t="How does the FILTER-unit v1.2 洗涤剂 请 x manual abc")
    assert sorted(got) == sorted(["filter-unit", "v1.2", "涤剂", "洗涤剂"])  # 洗涤 is no topic
    assert one(spark, G.topic_phrases(F.col("t")), t=None) == []


def test_related_hits_pass_by_heading_or_warning(spark):
    q = spark.createDataFrame([(1, "add 洗涤剂 filter"), (2, None)], "qid long, text string")
    r = spark.createDataFrame([(1, 1, "洗涤块", "x"), (1, 2, "洗涤剂盒", "x"), (1, 3, None, "警告: the filter is hot"), (1, 4, "", "the filter"), (2, 5, "filter", "警告 filter")], "qid long, doc_id long, heading string, text string")
    assert {(x.doc_id, x.on_topic, x.warns) for x in G.topic_gate(q, r).collect()} == {(1, False, False), (2, True, False), (3, False, True), (4, False, False), (5, False, False)}


@pytest.mark.parametrize("phrase, specific", [("过滤网", True), ("使用说明", False), ("使用压力调节阀门", True), ("Cleaning it", False), ("cleaning the brush", True), ("Notes", False), (None, True), ("安全 阀", False)])
def test_phrases_that_name_something(spark, phrase, specific):
    assert one(spark, G.specific_phrase(F.col("p"), ["notes"]), p=phrase) == specific


def test_pictures_that_name_a_product(spark):
    hits = spark.createDataFrame([(1, "a", 7, 0.9), (1, "gone", 1, 0.95), (2, "a", 7, 0.9), (2, "b", 8, 0.3), (3, "gone", 1, 0.9), (4, "b", 9, 0.42), (4, "a", 2, 0.42)], "qid long, product string, image_id long, score double")
    catalogue = spark.createDataFrame([("a",), ("b",)], "product string")
    scope = spark.createDataFrame([(2, "b"), (2, "b")], "qid long, product string")
    got = {r.qid: (r.product, r.image_id, r.accepted) for r in G.visual_gate(hits, catalogue, scope).collect()}
    assert got == {1: ("a", 7, True), 2: ("b", 8, False), 4: ("a", 2, True)}


@pytest.mark.parametrize("visual, captions, text, keeps", [("Camera", ["TV"], "the red light", True), ("Camera", ["Camera", "TV"], "the red light", False), ("Camera", ["TV"], "the lens", False), (None, ["TV"], "icon", False), ("Camera", [" ", "TV"], "屏幕", True), ("Camera", [], "icon", False)])
def test_signals_that_disagree(spark, visual, captions, text, keeps):
    assert one(spark, G.keeps_products(F.col("v"), F.col("c"), F.col("t")), v=visual, c=captions, t=text) == keeps


def test_expansions(spark):
    run = lambda t, p: one(spark, G.expanded(F.col("t"), F.col("p")), t=t, p=p)
    assert run("有哪些模式", ["空调手册"]) == "有哪些模式\n" + G.COOLING_WORDS and run("有哪些模式", ["空调手册", "x"]) == "有哪些模式\n" + G.MODE_WORDS
    assert run("which smart features", []) == "which smart features\n" + G.FEATURE_WORDS and run(" plain ", []) == "plain" and run(None, []) == ""
    assert run("混合比怎么调节", ["吹风机手册"]).endswith(G.SCREW_WORDS) and run("混合比怎么调节", ["x"]) == "混合比怎么调节"
    assert len(run("有哪些模式" + "x" * 600, [])) == 500
    keys = lambda tokens, q: one(spark, G.literal_keywords(F.col("k"), F.col("q"), 3), k=tokens, q=q)
    assert keys(["a", "bb", "bb", "cc", "dd", "ee"], "q") == ["bb", "cc", "dd"] and keys(["a"], " q ") == ["q"] and keys([], None) == [""]


@pytest.mark.parametrize("question, section, part", [("怎么装", "手册 / 机身 / 滤网与电池（图 3）", "滤网与电池"), ("电池 在哪", "机身 / 滤网与电池", "电池"), ("x", "a / 安全说明", ""), ("x", "a / b", ""), ("x", None, ""), ("x", "p / " + "长" * 41, ""), ("看前盖和后盖板", "部件 / 前盖、后盖板", "后盖板")])
def test_components(spark, question, section, part):
    assert one(spark, G.turn_component(F.col("q"), F.col("s")), q=question, s=section) == part


def test_captions_of_figures(spark):
    q = spark.createDataFrame([(1, "battery status lights"), (2, "the")], "qid long, text string")
    r = spark.createDataFrame([(1, 1, "p", "primary", "valve", ["a", "b", ""]), (1, 2, "p", "support", "x", ["c", "a"]), (1, 3, "p", "other", "x", ["d"]), (1, 4, "z", "other", None, ["a"]), (2, 1, "p", "primary", "x", ["a"])], "qid long, rank int, product string, role string, text string, pics array<string>")
    c = spark.createDataFrame([("p", "a", "Light"), ("p", "b", " "), ("p", "c", "A valve"), ("p", "d", "valve"), ("z", "a", "battery status")], "product string, image_id string, caption string")
    got = {(x.product, x.image_id): (x.score, x.place) for x in G.figure_captions(q, r, c).collect()}
    assert got == {("p", "a"): (4, 1), ("p", "c"): (4, 2), ("z", "a"): (12, 3)}
    assert {(x.product, x.image_id) for x in G.figure_captions(q, r, c, 1).collect()} == {("z", "a")}


def test_clauses_that_cite_figures(spark):
    text = "Open the lid as in Figure 2. See fig. 12 for more!\nIn Fig 2 the valve\n is shown. Figure 22 is else."
    run = lambda numbers: one(spark, G.figure_clauses(F.col("t"), F.col("n")), t=text, n=numbers)
    assert run(["2"]) == "Open the lid as in Figure 2 In Fig 2 the valve" and run(["12"]).endswith("fig. 12 for more") and run(["9"]) == "" and run([]) == ""


def test_rows_that_are_handed_in(spark):
    rows = [(1, "## Open **it** <PIC> then [pic] end", ["a", "b", "c"]), (2, "text [[PIC: z9 ]] and <PIC> <PIC>", ["q"]), (3, None, ["a"]), (4, "Call 13812345678 or a@b.com <PIC> now", ["a"]), (5, "  ", None), (6, "no marks", ["a"]), (7, "x😀 <PIC>", ['a"b'])]
    df = spark.createDataFrame(rows, "id long, answer string, pics array<string>")
    got = {r.id: r.ret for r in G.submissions(df, F.col("id").isin(4, 5)).collect()}
    assert got[1] == 'Open it <PIC> then <PIC> end,["a", "b"]' and got[2] == 'text <PIC> and <PIC>,["z9", "q"]' and got[3] == G.NO_ANSWER
    assert "138" not in got[4] and "@" not in got[4] and "<PIC>" not in got[4] and got[5] == G.NO_REPLY and got[6] == "no marks" and got[7] == 'x <PIC>,["a\\"b"]'


def test_handed_in_rows_work_out_each_step_once(spark):
    df = spark.createDataFrame([(1, "a", ["b"])], "id long, answer string, pics array<string>")
    plan = G.submissions(df, F.col("id") == 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?m)^#{1,6}") == plan.count("(?i)<\\s*PIC\\s*>\\s*(") == 1
