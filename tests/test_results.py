"""Rules of answers' clean-up, narrowing and figures on small cases."""

import random

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import results as X


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(col).first()[0]


def test_picture_marks(spark):
    assert one(spark, X.picture_marks("t"), t="a < pic >man1_2</PIC> b [PIC] c <PIC> man3_4 d </pic>") == "a <PIC> b <PIC> c <PIC> d "
    assert one(spark, X.picture_marks("t"), t=None) == ""


def test_inline_pictures_there_and_back(spark):
    text, names = X.inline_pictures("t")
    assert one(spark, text, t="x [[PIC: a.png ]] y [[ pic:b ]]") == "x <PIC> y <PIC>"
    assert one(spark, names, t="x [[PIC: a.png ]] y [[ pic:b ]]") == ["a.png", "b"]
    assert one(spark, X.named_pictures("t", F.col("p")), t="x <PIC> y <PIC> z", p=["a.png"]) == "x [[PIC:a.png]] y <PIC> z"
    assert one(spark, X.named_pictures("t", F.col("p")), t="none", p=["a.png"]) == "none"


def test_bare_marks_are_mended_up_to_what_is_missing(spark):
    for n, want in ((0, "PIC a <PIC> PIC EPIC PIC"), (1, "PIC a <PIC> PIC EPIC PIC"), (2, "<PIC> a <PIC> PIC EPIC PIC"), (9, "<PIC> a <PIC> <PIC> EPIC <PIC>")):
        assert one(spark, X.repaired_marks("t", F.col("n")), t="PIC a <PIC> PIC EPIC PIC", n=n) == want


def test_reference_symbols(spark):
    assert one(spark, X.reference_symbols("t"), t="① Ⓐ ③\nⒶ ①\n$\\textcircled{\\scriptsize{10}}$ \\textcircled{1} $\\circledcirc$") == "① ② ③\nⒶ ①\n⑩ ① ②"


def test_names_and_blanks(spark):
    assert one(spark, X.without_names("t", F.col("p")), t="see pic and pic2 man1_2.", p=["pic", "", "pic2"]) == "see  and  ."
    assert one(spark, X.without_names("t", F.col("p")), t="see pic", p=[]) == "see pic"
    assert one(spark, X.tidy_blanks("t"), t="\n  \n a\t b  \n\n\n\nc \r\n ") == "a b\n\nc"


def test_compact_and_distinct(spark):
    assert one(spark, X.compact("t", 5), t=" ab  cdefg ") == "ab c…"
    assert one(spark, X.distinct_strings(F.col("v"), 9, 2), v=["A  b", "a B", " ", "c", "d"]) == ["A b", "c"]


def test_narrowing(spark):
    asked = spark.createDataFrame([(1, "clean the filter basket"), (2, "clean the filter basket"), (3, "clean the filter"), (4, "clean the filter")], "qid int, text string")
    rows = [
        (1, 1, 1, "other", None), (1, 2, 2, "Clean filter", None), (1, 3, 3, "filter", None),  # one best heading
        (2, 1, 1, "clean filter", None), (2, 2, 2, "basket", None),  # the other has a term of its own
        (3, 1, 1, "clean filter", None), (3, 2, 2, "filter clean", None),  # a tie
        (4, 1, 1, "clean filter", "primary"), (4, 2, 2, "x", "support"), (4, 3, 3, "y", None),  # a procedure and its warning
    ]
    got = X.narrowed(spark.createDataFrame(rows, "qid int, doc_id int, rank int, heading string, role string"), asked).collect()
    assert sorted((r.qid, r.doc_id) for r in got) == [(1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (4, 2)]


def test_figures_of_a_group_leave_out_seeds(spark):
    groups = spark.createDataFrame([(1, "p", i, f"f{i}") for i in range(4)] + [(2, "p", 0, "f3"), (2, "p", 1, "g")], "group_id int, product string, place int, pic_id string")
    seeds = spark.createDataFrame([(7, "p", "f1"), (8, "p", "f3"), (9, "q", "f1")], "qid int, product string, pic_id string")
    got = sorted((r.qid, r.k, r.pic_id) for r in X.group_figures(seeds, groups, 4).collect())
    assert got == [(7, 1, "f0"), (7, 2, "f2"), (7, 3, "f3"), (8, 1, "f0"), (8, 2, "f1"), (8, 3, "f2"), (8, 4, "g")]


def test_objects_in_fences(spark):
    for text, want in (('```json\n{"a": 1}\n```', 1), (' {"a": 2} ', 2), ("```\nno\n```", None), ('{"a": ', None), (None, None)):
        assert one(spark, X.fenced_json("t", "a int")["a"], t=text) == want


def test_narrowing_without_any_role(spark):
    asked = spark.createDataFrame([(1, "clean the filter basket")], "qid int, text string")
    rows = [(1, 1, 1, "other", None), (1, 2, 2, "Clean filter", None)]
    got = X.narrowed(spark.createDataFrame(rows, "qid int, doc_id int, rank int, heading string, role string"), asked).collect()
    assert [tuple(r) for r in got] == [(1, 2, "primary", 2)]


def test_patterns_read_only_texts_that_can_match(spark):
    r = random.Random(3)
    parts = ["a", " ", "  ", "\t", "\n", "\n\n\n", "\r\n", "\x85", "\u2028", "PIC", "<PIC>", "[pic]", "</pic>", "m1_2", "**b**", "# ", "- ", "`", ">", "\\*", "```"]
    rows = [("".join(r.choice(parts) for _ in range(r.randint(0, 12))),) for _ in range(400)]
    tidy = marks = bare = F.col("t")
    for pattern, by in (("\r\n?", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (r"^\n+", ""), (r"\s+$", "")):
        tidy = F.regexp_replace(tidy, pattern, by)
    for pattern, by in X.PIC_MARKS:
        marks = F.regexp_replace(marks, pattern, by)
    for pattern, by in T.MARKDOWN:
        bare = F.regexp_replace(bare, pattern, by)
    df = spark.createDataFrame(rows, "t string").select(tidy.alias("a"), X.tidy_blanks("t").alias("b"), marks.alias("c"), X.picture_marks("t").alias("d"), bare.alias("e"), T.strip_markdown(F.col("t")).alias("f"))
    assert df.filter("NOT (a <=> b AND c <=> d AND e <=> f)").collect() == []
