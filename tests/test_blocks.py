"""Repairs of headings, bounded blocks and quotations."""

import random
import re

import pytest

from docloom.operators import blocks as B


def rows(spark, values, *names):
    return spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "qid long, " + ", ".join(f"{n} string" for n in names))


REPAIRS = {
    "# 程序显示 程序显示区位于前面": "# 程序显示\n 程序显示区位于前面",
    "## 控制台功能 控制台可以打开": "## 控制台功能\n 控制台可以打开",
    "前文 # 排水连接 排水管要直": "前文 \n# 排水连接\n 排水管要直",
    "# 注意 请将电源关闭": "# 注意\n 请将电源关闭",
    "# Before First Use The unit must dry": "# Before First Use\n The unit must dry",
    "# Safety 1. Keep dry ## Care Use a cloth": "# Safety\n 1. Keep dry \n## Care\n Use a cloth",
    "# lower case title The body": None,
    "#hashtag and ####### too many": None,
    "# 安全说明\n正文": None,
    "": None,
    "# 安全说明 # 清洁 请擦": "# 安全说明 \n# 清洁\n 请擦",
    "a#  标题 <PIC> x": "a\n#  标题\n <PIC> x",
}


def test_known_headings(spark):
    got = {r.qid: r.text for r in B.heading_repairs(rows(spark, list(REPAIRS), "text"), "qid").collect()}
    for i, want in enumerate(REPAIRS.values()):
        assert got.get(i) == want, (list(REPAIRS)[i], got.get(i))


def test_only_line_breaks_come(spark):
    r = random.Random(5)
    parts = ["# ", "## ", "#", " ", "功能", "安全说明", "请将", "The", "Use", "Care", "\n", "程序显示", "区", "x", "1.", "<PIC>", "é", "😀", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + [None, "# " + "长" * 50_000 + " 请"]
    out = B.heading_repairs(rows(spark, texts, "text"), "qid").collect()
    assert len(out) > 100
    for x in out:
        before = texts[x.qid]
        assert x.text.replace("\n", "") == before.replace("\n", "") and x.line_breaks == len(x.text) - len(before) > 0
        marks = [m.start() for m in re.finditer(r"(?<!#)#{1,6} ", x.text)]
        assert all(at == 0 or x.text[at - 1] == "\n" for at in marks) and x.titles <= len(marks)


def test_blocks_under_titles():
    cases = [
        ("Start: turn the key\nThen wait\nStop: turn back", "", [], ["Start: turn the key\nThen wait", "Stop: turn back"]),
        ("- Choke: open\n- Throttle: shut", "Cold start", [], ["- Choke: open\n- Throttle: shut"]),
        ("- Choke: open\n- Throttle: shut", "The choke", [], ["- Choke: open\n- Throttle: shut"]),
        ("Intro\n- Choke: open\n- Throttle: shut", "The throttle", [], ["Intro\n- Choke: open", "- Throttle: shut"]),
        ("Fits:\n- one\n- two", "", [], ["Fits:\n- one", "Fits:\n- two"]),
        ("Fits:\n- one\ntwo", "", [], ["Fits:\n- one\ntwo"]),
        ("Steps:\n\n1. a\n2. b", "", [], ["Steps:\n1. a\n2. b"]),
        ("Steps: now\n\n1. a\n2. b", "", [], ["Steps: now", "1. a\n2. b"]),
        ("a <PIC> b <PIC>", "", ["p1"], ["a [[PIC:p1]] b <PIC>"]),
        ("A line\n\n\nmore", None, None, ["A line", "more"]),
        (None, None, None, []),
        (" \n ", "h", [], []),
        ("冷机启动：\n• 点火：打开\n• 阻风门：关", "冷机启动", [], ["冷机启动：\n• 点火：打开", "冷机启动：\n• 阻风门：关"]),
    ]
    for text, heading, pics, want in cases:
        assert B.bounded(text, heading, pics) == want, text


def test_blocks_of_a_table(spark):
    df = spark.createDataFrame([(1, "Aa: x\nBb: y", "", ["p"]), (2, None, None, None), (1, "C", "", [])], "id long, text string, heading string, pics array<string>")
    assert sorted((r.id, r.place, r.block) for r in B.bounded_blocks(df, "id").collect()) == [(1, 0, "Aa: x"), (1, 0, "C"), (1, 1, "Bb: y")]
    assert B.bounded_blocks(df.limit(0), "id").count() == 0


def flat(text):
    return re.sub(r"[^a-z0-9㐀-鿿]+", "", text.lower())


def plain_literal(answer, source):
    grams = lambda x: {x[i : i + 2] for i in range(len(x) - 1)}
    lines, src = [x.strip(" ") for x in re.split("\r\n|[\n\x0b\x0c\r\x85  ]", answer or "") if x.strip(" ")], flat(source or "")
    units = [u for line in lines[1:] for u in map(flat, re.split(r"(?<=[。！？.!?])\s*", line)) if len(u) >= 6] if src else []
    hit = sum(u in src or len(grams(u) & grams(src)) / len(grams(u)) >= 0.78 for u in units)
    return len(units), hit, bool(units) and hit / len(units) >= 0.9


def test_quotations(spark):
    r = random.Random(7)
    words = ["valve", "open", "the", "close", "pump", "before", "use", "清洁", "滤网", "机器", "and", "dry"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", ". ", "。", "! "]) for _ in range(n))
    cases = []
    for _ in range(150):
        source = "\n".join(say(12) for _ in range(6))
        lines = [say(5)] + [x if r.random() < 0.8 else say(8) for x in source.split("\n")]
        cases.append(("\n".join(lines[: r.randint(0, 7)]), source))
    cases += [(None, "x"), ("a\nlong enough unit here.", None), ("a\nlong enough unit here.", "..."), ("one line only that is long", "one line only that is long"), ("head\r\nOpen the valve, now.", "OPEN the valve now")]
    df = rows(spark, cases, "answer", "source")
    got = {x.qid: (x.units, x.matched, x.literal) for x in B.literal_answers(df.select("qid", "answer"), df.select("qid", "source")).collect()}
    want = {i: plain_literal(*c) for i, c in enumerate(cases)}
    assert got == want and {w[2] for w in want.values()} == {True, False}


def test_quotations_shuffle_no_pairs_of_characters(spark):
    df = rows(spark, [("head\nOpen the valve. Öffne das Ventil! 清洁滤网机器打开", "Öffne das Ventil, open a valve 清洁滤网打开")], "answer", "source")
    out = B.literal_answers(df.select("qid", "answer"), df.select("qid", "source"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(x.units, x.matched, x.literal) for x in out.collect()] == [plain_literal(*df.first()[1:])]


def test_answers_of_equal_id_are_judged_alone(spark):
    answers = spark.createDataFrame([(1, "a\nopen the valve"), (1, "b\nqqqqqq wwwwww")], "qid long, answer string")
    sources = spark.createDataFrame([(1, "open the valve")], "qid long, source string")
    assert [(x.units, x.matched, x.literal) for x in B.literal_answers(answers, sources).collect()] == [(2, 1, False)]


@pytest.mark.parametrize(
    "draft, source, opening",
    [
        ("Open the valve slowly. Then wait.", "open a valve, slow", "Open the valve slowly."),
        ("Open the valve.", "please open the valve.", None),
        ("Nothing alike here", "清洁滤网", None),
        ("[[PIC:1]] open the valve slowly", "open a valve, slow", None),
        ("x" * 150, "x", None),
        (None, "a", None),
    ],
)
def test_openings(spark, draft, source, opening):
    got = [r.opening for r in B.backed_openings(spark.createDataFrame([(1, draft)], "qid long, draft string"), spark.createDataFrame([(1, source)], "qid long, source string")).collect()]
    assert got == ([opening] if opening else [])
